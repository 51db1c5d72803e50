import json
import random

import pytest
from pyspark.sql import functions as F

from lexilathe.functions import text as X
from lexilathe.functions import vectors as V
from lexilathe.operators import chunking as C
from lexilathe.operators import geometry as G
from lexilathe.operators import graph as E
from lexilathe.operators import matching as M
from lexilathe.operators import models as O
from lexilathe.operators import sampling as S
from lexilathe.operators import statistics as T
from lexilathe.sources import files as IO
from lexilathe.streaming import events as W


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, None], [1.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(V.norm("a"), V.cosine("a", "b"), V.euclidean("a", "b")).collect()
    assert tuple(got[0]) == (5.0, 1.0, 0.0)
    assert got[1][1] is None and got[2][0] is None
    ok = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,), ([None, 1.0],), ([float("inf"), 1.0],)], "v array<double>")
    assert [r[0] for r in ok.select(V.is_valid(F.col("v"), 2)).collect()] == [True, False, False, False, False, False, False]


def test_centroids_and_rankings(spark):
    pts = [(i, "a" if i < 4 else "b", [float(i % 2), float(i // 2 % 2)]) for i in range(8)] + [(99, "c", None)]
    p = spark.createDataFrame(pts, "id long, grp string, vec array<double>")
    d = {r.grp: r for r in G.dispersion(p, 2).collect()}
    assert set(d) == {"a", "b"} and d["a"].n == 4 and d["a"].mean_distance == pytest.approx(0.5**0.5)
    far = G.typical_and_atypical(p, 2, 2).collect()
    assert [(r.id, r.rank) for r in far if r.grp == "a" and r.side == "typical"] == [(0, 1), (1, 2)]  # all are tied
    assert [(r.id, r.rank) for r in far if r.grp == "a" and r.side == "atypical"] == [(3, 1), (2, 2)]
    assert G.dispersion(p.filter("id < 0"), 2).count() == 0


def test_allocation_and_samples(spark):
    counts = spark.createDataFrame([("x", 70), ("y", 20), ("z", 10)], "s string, size long")
    assert rows(S.allocate_floor(counts, "s", 13).select("s", "take")) == [("x", 10), ("y", 2), ("z", 1)]
    assert rows(S.allocate_largest_remainder(counts, "s", 13).select("s", "take")) == [("x", 9), ("y", 3), ("z", 1)]
    df = spark.range(50).withColumnRenamed("id", "k")
    a, b = rows(S.simple(df, "k", 7, 1)), rows(S.simple(df.repartition(5), "k", 7, 1))
    assert a == b and len(set(a)) == 7 and len(rows(S.simple(df, "k", 99, 1))) == 50


def test_statistics(spark):
    df = spark.createDataFrame([(1, float(i % 4), i % 3 == 0) for i in range(24)] + [(1, None, True)], "g int, x double, f boolean")
    pos = [i % 4 for i in range(24) if i % 3 == 0]
    neg = [i % 4 for i in range(24) if i % 3]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert T.auc(df, "x", "f", ["g"]).first().auc == pytest.approx(want)
    up = spark.createDataFrame([(1, float(i), float(i * i)) for i in range(9)], "g int, x double, y double")
    assert T.spearman(up, "x", "y", ["g"]).first().rho == pytest.approx(1.0)
    assert {r.tercile for r in T.terciles(up, "x").collect()} == {1, 2, 3}
    flat = T.min_max(up.withColumn("x", F.lit(2.0)), "x", ["g"], "s").collect()
    assert {r.s for r in flat} == {0.0}


def greedy_loop(sizes):
    out, words, parts, chunk = [], 0, 0, 0
    for n in sizes:
        if parts and words + n > 700:
            chunk, words, parts = chunk + 1, 0, 0
        out.append(chunk)
        words, parts = words + n, parts + 1
        if parts >= 2 and (words >= 300 or parts >= 5):
            chunk, words, parts = chunk + 1, 0, 0
    return out


def test_greedy_fold_equals_loop(spark):
    rng = random.Random(4)
    lists = [[rng.choice([3, 40, 150, 320, 699, 700, 701, 1500]) for _ in range(rng.randint(0, 14))] for _ in range(60)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, s array<int>")
    for r in df.select("i", C.greedy_groups(F.col("s")).alias("c")).collect():
        assert r.c == greedy_loop(lists[r.i])


def test_paragraphs_and_fill(spark):
    df = spark.createDataFrame([(1, "a b\n \t\nc\n\n\n\nd e f"), (2, None), (3, ""), (4, " \n\n\t")], "id int, t string")
    assert rows(C.paragraphs(df, "id", "t").select("id", "paragraph_no", "n_words")) == [(1, 0, 2), (1, 1, 1), (1, 2, 3)]
    f = spark.createDataFrame([(1, 1, "A"), (1, 2, None), (1, 3, "B"), (1, 4, None), (2, 1, None)], "g int, o int, v string")
    assert rows(C.forward_fill(f, ["g"], "o", "v")) == [(1, 1, "A"), (1, 2, "A"), (1, 3, "B"), (1, 4, "B"), (2, 1, None)]


def test_text_functions(spark):
    df = spark.createDataFrame([("  a\t b \n\n\n\n c ",), (None,)], "t string")
    assert [r[0] for r in df.select(X.collapse_whitespace(F.col("t"))).collect()] == ["a b\n\nc\n", None]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.slug(F.lit("--Ein Tést: 12!"))) == "ein-t-st-12"
    assert one(X.looks_like_name(F.lit("all small"))) is False and one(X.looks_like_name(F.lit("日本"))) is True
    assert one(X.surname(F.lit("Ann de Roe (ed.)"))) == "Roe" and one(X.surname(F.lit("Roe, Ann"))) == "Roe"
    assert one(X.year_of(F.lit("x-1999-y"))) == 1999 and one(X.year_of(F.lit("19999"))) is None
    assert one(X.mixed_script_tokens(F.lit("Boliǀia ok ǀǀ"))) == 1
    assert one(X.nfc_changes(F.lit("éa"))) > 0 and one(X.hard_corruption(F.lit("clean"))) is None


def test_matching(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5), (None, 9)], "k string, o int")
    assert rows(M.occurrence(df, ["k"], ["o"])) == [("a", 1, 0), ("a", 2, 1), ("b", 5, 0), (None, 9, 0)]
    stats = M.match_statistics(df.select("k", "o"), spark.createDataFrame([("a", 1), ("c", 1)], "k string, o int"), ["k", "o"]).first()
    assert tuple(stats) == (1, 3, 1)
    up = M.upsert(spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "id int, a string, b int"), spark.createDataFrame([(2, None, 7), (3, "z", 3)], "id int, a string, b int"), "id")
    assert rows(up) == [(1, "x", 1, "kept"), (2, "y", 7, "updated"), (3, "z", 3, "created")]
    t = M.todo(df, spark.createDataFrame([("a",)], "k string"), ["k"])
    assert rows(t) == [("b", 5), (None, 9)]
    best = M.merge_best(spark.createDataFrame([(1, "k", ["s"], 3), (2, "k", ["t", "s"], 5), (3, None, ["u"], 1)], "id int, k string, src array<string>, c int"), F.col("k"), [F.desc("c")], "src")
    assert {(r.id, tuple(r.src)) for r in best.collect()} == {(2, ("s", "t")), (3, ("u",))}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "a"), (None, "b")], "x string, y string")
    assert rows(E.degrees(e, "x", "y")) == [("a", 3), ("b", 2)]
    p = spark.createDataFrame([(i, i - 1) for i in range(1, 12)], "node long, parent long")
    assert E.ancestors(p).count() == 66


def test_transform_keeps_distances(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5)) * [1, 2, 3, 0, 5]
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>")
    t = O.fit_transform(p, 5)
    assert t.ratio.sum() == pytest.approx(1.0) and t.keep(0.95) <= 4
    y = np.array([r.vec for r in t.apply(p, 5).orderBy("id").collect()])
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    assert np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(z, axis=1))
    assert O.fit_transform(p.filter("id < 0"), 5).keep() == 0


def test_files(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text('{"a": 1}\n\n{"a": 2\n{"a": 3}\n')
    good, bad = IO.json_lines(spark, str(f), "a int")
    assert rows(good) == [(0, 1), (3, 3)] and rows(bad) == [(2, '{"a": 2')]
    c = tmp_path / "x.csv"
    c.write_text('n,t\n1,"a, ""b""\nc"\n')
    assert rows(IO.csv_rows(spark, str(c))) == [("1", 'a, "b"\nc')]
    b = IO.parse_bib('junk @book{key1, title = {A {B}  c}, author="X, Y and Z", year = 1999}\n@misc{k2,note={}}')
    assert b == [("key1", "book", {"title": "A B c", "author": "X, Y and Z", "year": "1999"}), ("k2", "misc", {"note": ""})]
    d = tmp_path / "doc.txt"
    d.write_text("one\ftwo\n\f\f")
    p = IO.pages_of(spark, str(d))
    assert [(r.page_number, r.text.strip()) for r in p.orderBy("page_number").collect()] == [(1, "one"), (2, "two"), (3, ""), (4, "")]
    gap = spark.createDataFrame([("d", 1, "x"), ("d", 3, "y" * 90)], "document string, page_number int, text string")
    assert rows(IO.backfill(gap).select("page_number", "missing")) == [(1, False), (2, True), (3, False)]
    assert IO.plausible(gap).first().plausible is True
    lines = spark.createDataFrame([(0, "Cell A:"), (1, "1. Foo (bar)"), (2, "- Baz – q")], "line_no long, line string")
    assert rows(IO.term_list(lines)) == [(1, "Cell A", "Foo"), (2, "Cell A", "Baz")]
    out = str(tmp_path / "out")
    IO.write_new(lines, out)
    with pytest.raises(Exception):
        IO.write_new(lines, out)


def test_stream_equals_table(spark, tmp_path):
    data = [{"user_id": i % 3, "ts": f"2024-01-01T{10 + i // 6:02d}:{i % 6 * 10:02d}:00", "value": float(i)} for i in range(18)]
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(map(json.dumps, data)))
    schema = "user_id long, ts timestamp, value double"
    q = W.hourly(spark.readStream.schema(schema).json(str(src))).writeStream.outputMode("complete").format("memory").queryName("hourly_out").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("hourly_out")) == rows(W.hourly(spark.read.schema(schema).json(str(src))))
    for _ in range(2):  # a second run finds nothing new
        W.ingest_once(spark, str(src), schema, str(tmp_path / "sink"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 18


def test_registry_has_sql_for_most():
    from lexilathe.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())
