"""Readers of JSON lines, CSV, BibTeX, page texts and term lists, and writers that never overwrite."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of the non-blank lines of a text file or folder, numbered in file order from 0 (blank ones
    count). The number is meant to be kept: joins in file order use it."""
    # A row's id is its partition's number and its place there; the partitions' sizes (a row each) give where each begins.
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("m"))
    part, place = F.shiftright("m", 33), F.col("m").bitwiseAND((1 << 33) - 1)
    starts, at = [], 0
    for r in sorted(rows.groupBy(part.alias("p")).agg((F.max(place) + 1).alias("n")).collect(), key=lambda r: r.p):
        starts.append((r.p, at))
        at += r.n
    begin = spark.createDataFrame(starts, "p long, at long")
    return rows.withColumn("p", part).join(F.broadcast(begin), "p").select((F.col("at") + place).alias("line_no"), "line").filter("trim(line) <> ''")


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, faulty): rows by the schema with line_no; faulty has line_no and line of what isn't JSON of it. Blank
    lines are neither; every other line is in exactly one."""
    parsed = numbered_lines(spark, path).withColumn("r", F.from_json("line", schema + ", __corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}))
    bad = F.col("r.__corrupt").isNotNull() | F.col("r").isNull()
    return parsed.filter(~bad).select("line_no", "r.*").drop("__corrupt"), parsed.filter(bad).select("line_no", "line")


def valid_vectors(rows: DataFrame, column: str, dim: int, required: list[str]) -> DataFrame:
    """Rows whose vector is dim numbers without nulls and whose required columns are set."""
    keep = (F.size(column) == dim) & ~F.exists(column, lambda x: x.isNull())
    for c in required:
        keep = keep & F.col(c).isNotNull()
    return rows.filter(F.coalesce(keep, F.lit(False)))


def csv_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; quoted fields may hold commas, quotes and line ends. Without a schema all is text."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def union_rows(parts: list[DataFrame]) -> DataFrame:
    """All rows under all columns; what a part lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def bib_entries(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, fields map<string,string>) of BibTeX files: values in braces, in quotes or bare, without the braces and
    with white space collapsed. A file is parsed in one task; what isn't an entry is passed over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([e for text in pdf["value"] for e in parse_bib(text)], columns=["id", "kind", "fields"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "id string, kind string, fields map<string,string>")


def parse_bib(text: str) -> list[tuple[str, str, dict[str, str]]]:
    out = []
    for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s{}]+)\s*,", text):
        fields, i = {}, m.end()
        while True:
            f = re.compile(r"[\s,]*([\w-]+)\s*=\s*").match(text, i)
            if not f:
                break
            i, depth, quoted, start = f.end(), 0, False, f.end()
            while i < len(text):
                c = text[i]
                if c == "{":
                    depth += 1
                elif c == "}":
                    if depth == 0:
                        break
                    depth -= 1
                elif c == '"' and depth == 0:
                    quoted = not quoted
                elif c == "," and depth == 0 and not quoted:
                    break
                i += 1
            value = re.sub(r"[{}]", "", text[start:i].strip().strip('"'))
            fields[f.group(1).lower()] = re.sub(r"\s+", " ", value).strip()
        out.append((m.group(2), m.group(1).lower(), fields))
    return out


def pages_of(spark: SparkSession, path: str) -> DataFrame:
    """(document, page_number, text) of text files, pages ending with a form feed; empty pages are kept as such."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.\w+)?$", 1).alias("document"), F.posexplode(F.split("value", "\f")).alias("n", "text"))
    return files.select("document", (F.col("n") + 1).alias("page_number"), F.rtrim("text").alias("text"))


def backfill(pages: DataFrame) -> DataFrame:
    """pages (document, page_number, text) with an empty page for each number missing up to a document's last."""
    every = pages.groupBy("document").agg(F.max("page_number").alias("last")).select("document", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("page_number"))
    return every.join(pages, ["document", "page_number"], "left").withColumn("missing", F.col("text").isNull()).withColumn("text", F.coalesce("text", F.lit("")))


def plausible(pages: DataFrame, least: int = 20) -> DataFrame:
    """(document, plausible): whether a document's pages hold `least` characters on average."""
    return pages.groupBy("document").agg((F.sum(F.length(F.coalesce("text", F.lit("")))) / F.greatest(F.count("*"), F.lit(1)) >= least).alias("plausible"))


def term_list(lines: DataFrame) -> DataFrame:
    """(line_no, block, term) of lines (line_no, line): numbering and what follows a bracket or dash is cut off; a line
    that ends with a colon is the header of the block below it."""
    plain = F.trim(F.regexp_replace("line", r"^[ \t]*(?:[0-9]+[.)]|[-•*])[ \t]*", ""))
    head = F.when(plain.endswith(":"), F.regexp_replace(plain, ":$", ""))
    rows = carried(lines.select("line_no", plain.alias("plain"), head.alias("head")), "line_no", "head", "block")
    return rows.filter("head is null").select("line_no", "block", F.trim(F.regexp_extract("plain", r"^(.*?)(?: *\(| +[-–—] |$)", 1)).alias("term")).filter("term <> ''")


def carried(rows: DataFrame, order: str, value: str, name: str, block: int = 100_000) -> DataFrame:
    """rows with `name`, the last value that isn't null up to the row in order of a running number. Blocks of numbers
    are filled by themselves and take what the blocks before them end with, so no task holds all rows."""
    b = F.floor(F.col(order) / block)
    ends = rows.filter(F.col(value).isNotNull()).groupBy(b.alias("_b")).agg(F.max_by(value, order).alias("_end"))
    blocks = rows.select(b.alias("_b")).distinct().join(ends, "_b", "left")  # a row a block
    before = blocks.select("_b", F.last("_end", ignorenulls=True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    w = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("_b", b).withColumn(name, F.last(value, ignorenulls=True).over(w)).join(before, "_b")
    return filled.withColumn(name, F.coalesce(name, "_before")).drop("_b", "_before")


def write_new(df: DataFrame, path: str) -> None:
    """Parquet under a path that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def marked_text(pages: DataFrame) -> DataFrame:
    """(document, text): each document's pages in order, each under a line with its number. A document is one row, as
    in the files it came from."""
    part = F.concat(F.lit("--- page "), "page_number", F.lit(" ---\n"), "text")
    return pages.groupBy("document").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", part.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def verify_copy(original: DataFrame, copy: DataFrame) -> DataFrame:
    """(path, state) of binary files (path, content) on two sides: missing, extra, mismatched or same, by sha-256."""
    a = original.select("path", F.sha2("content", 256).alias("a"))
    b = copy.select("path", F.sha2("content", 256).alias("b"))
    return a.join(b, "path", "full").select("path", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "mismatched").otherwise("same").alias("state"))


def yaml_list(text: str | None, key: str) -> list[dict[str, str]]:
    """The records of a list under a key of a plain YAML text: lines "- name: value" begin one, deeper lines add to it.
    None, an empty text or a missing key give none; quotes around values are dropped."""
    out: list[dict[str, str]] = []
    inside = False
    for line in (text or "").splitlines():
        if re.match(r"[^ \t#-]", line):
            inside = line.split("#")[0].strip() == f"{key}:"
            continue
        m = re.match(r"[ \t]*(-[ \t]+)?([\w-]+)[ \t]*:[ \t]*(.*?)[ \t]*$", line)
        if inside and m:
            if m.group(1):
                out.append({})
            if out:
                out[-1][m.group(2)] = m.group(3).strip("'\"")
    return out


# Kinds of entries under the kinds of records, all others being "other".
KINDS = {"article": "article", "book": "book", "incollection": "chapter", "inbook": "chapter", "phdthesis": "thesis", "mastersthesis": "thesis", "techreport": "report", "report": "report"}


def bib_records(entries: DataFrame) -> DataFrame:
    """(id, type, title, authors, year) of entries (id, kind, fields): editors, marked as such, where there is no author,
    and the year as the first four characters of the date or year."""
    f = lambda n: F.nullif(F.trim(F.col("fields")[n]), F.lit(""))
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    authors = F.coalesce(f("author"), F.concat(f("editor"), F.lit(" (ed.)")))
    return entries.select("id", F.coalesce(kinds[F.col("kind")], F.lit("other")).alias("type"), f("title").alias("title"), authors.alias("authors"), F.left(F.coalesce(f("date"), f("year")), F.lit(4)).alias("year"))


def without_notes(t):
    """A transcript without the section of notes at its end."""
    return F.regexp_replace(t, r"(?is)\n[ \t]*(?:interview(?:er)? )?notes?[ \t]*:.*$", "")


def edge_dump(spark: SparkSession, path: str) -> DataFrame:
    """(relation, start, end, weight) of a dump of edges, tab-separated and perhaps compressed: lines with five columns
    or more, the fifth a JSON text whose weight, if there is one, else 1, counts."""
    c = spark.read.text(path).select(F.split("value", "\t").alias("c")).filter(F.size("c") >= 5)
    weight = F.coalesce(F.get_json_object(F.col("c")[4], "$.weight").cast("double"), F.lit(1.0))
    return c.select(F.col("c")[1].alias("relation"), F.col("c")[2].alias("start"), F.col("c")[3].alias("end"), weight.alias("weight"))


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The last path by name that fits the pattern, or None."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    names = sorted(f.getPath().toString() for f in (found or []))
    return names[-1] if names else None


def write_csv(parts: list[DataFrame], path: str) -> None:
    """All parts under the union of their columns as CSV with a header, blanks for what is missing. No rows give a file
    with the header alone."""
    rows = union_rows(parts)
    rows.na.fill("").write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def append_json(rows: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key isn't in the folder yet, as JSON lines; returns how many. Run again, it adds none."""
    spark = rows.sparkSession
    if newest(spark, f"{path}/part-*"):
        rows = rows.join(spark.read.json(path).select(F.col(key).cast(rows.schema[key].dataType).alias(key)).distinct(), key, "left_anti")
    n = rows.count()
    if n:
        rows.write.mode("append").json(path)
    return n


def split_columns(rows: DataFrame, key: str, vector: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Writes metadata and vectors of rows apart, only the listed columns of each, and reads them again; it is an error
    if they don't hold as many rows."""
    rows.drop(vector).write.mode("errorifexists").parquet(f"{path}/metadata")
    rows.select(key, vector).write.mode("errorifexists").parquet(f"{path}/vectors")
    spark = rows.sparkSession
    a, b = spark.read.parquet(f"{path}/metadata"), spark.read.parquet(f"{path}/vectors")
    if a.count() != b.count():
        raise ValueError("metadata and vectors differ in their number of rows")
    return a, b
