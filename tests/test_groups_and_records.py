"""Groups, rankings, spans, text functions and readers on small fixtures, with nulls, ties, repeated and empty rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexilathe.functions import text as X
from lexilathe.functions import vectors as V
from lexilathe.operators import geometry as G
from lexilathe.operators import groups as R
from lexilathe.operators import matching as M
from lexilathe.operators import nearest as N
from lexilathe.operators import sampling as S
from lexilathe.operators import spans as P
from lexilathe.operators import statistics as T
from lexilathe.plans import group_queries as Q
from lexilathe.plans.record_queries import spans_without_overlap, titled
from lexilathe.sources import files

POINT = "id long, grp string, st string, vec array<double>, said map<string,int>"


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, t string")


def one(spark, column, *values):
    return [r[0] for r in texts(spark, *values).select("id", column.alias("x")).orderBy("id").select("x").collect()]


def test_subgroups_and_tags(spark):
    rows = [(i, "a", "x" if i < 4 else None, [1.0], {"lit": i % 2} if i else None) for i in range(6)] + [(6, "b", "y", [1.0], None)]
    df = spark.createDataFrame(rows, POINT)
    assert [tuple(r) for r in R.subgroups(df, "grp", "st").collect()] == [("a__x", 4)]
    got = {(r.name, r.n) for r in R.tagged(df, "grp", "st", "said").groupBy("name").agg(F.count("*").alias("n")).collect()}
    assert got == {("a", 6), ("b", 1), ("a__x", 4), ("entities_lit", 3)}
    with pytest.raises(Exception, match="no subgroup"):
        R.subgroups(df.filter("id = 6"), "grp", "st").collect()


def test_rankings_leave_the_query_out_and_faults_show(spark):
    pairs = spark.createDataFrame([("q", 1, 0.0), ("q", 2, 2.0), ("q", 3, 1.0), ("q", 4, 1.0), ("r", 1, 5.0)], "q string, id long, d double")
    ranked = R.full_ranking(pairs, ["q"], "d", [F.col("d"), F.col("id")])
    assert sorted((r.q, r["rank"], r.id) for r in ranked.collect()) == [("q", 1, 3), ("q", 2, 4), ("q", 3, 2), ("r", 1, 1)]
    assert tuple(R.ranking_faults(ranked, ["q"], "d").first()) == (2, 0, 0)
    wrong = spark.createDataFrame([("q", 1, 2.0), ("q", 2, 1.0), ("s", 2, 1.0)], "q string, rank long, d double")
    assert tuple(R.ranking_faults(wrong, ["q"], "d").first()) == (2, 1, 1)
    assert tuple(R.ranking_faults(ranked.limit(0), ["q"], "d").first()) == (0, 0, 0)


def test_beside_in_blocks_equals_a_broadcast(spark, monkeypatch):
    a, b = spark.range(50).select(F.col("id")), spark.range(40).select(F.col("id").alias("q_id"))
    want = {(i, q) for i in range(50) for q in range(40) if i != q}
    for most in (10_000, 7):
        monkeypatch.setattr(G, "MOST_GROUPS", most)
        got = [tuple(r) for r in G.query_pairs(a, b).select("id", "q_id").collect()]
        assert len(got) == len(want) and set(got) == want


def test_best_equals_all_pairs(spark, monkeypatch):
    """Copies, ties, uneven lengths, a null group and invalid rows; in several chunks, tiles and batches of queries."""
    for name, most in (("CHUNK", 300), ("BATCH", 40), ("ROWS", 64), ("QUERIES", 16)):
        monkeypatch.setattr(N, name, most)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 4)).round(1).astype(np.float32) * rng.choice([1, 1, 1, 1e-6, 1e9], size=(700, 1)).astype(np.float32)
    x[100:160] = x[7]
    x[300:340] = 2 * x[8]
    data = [(i, [None, "a", "b"][i % 3], [float(c) for c in v]) for i, v in enumerate(x)]
    bad = [(900, "a", None), (901, "a", [0.0] * 4), (902, "a", [1.0, None, 1.0, 1.0]), (903, "a", [float("nan"), 1.0, 1.0, 1.0]), (904, "a", [1.0] * 3), (905, "b", [])]
    df = N.packed(spark.createDataFrame(data + bad, "id long, grp string, vec array<float>"), "vec", 4)
    live = [d for d in data if any(d[2])]
    assert df.count() == len(live)
    q = df.filter("id % 7 = 0").select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))
    for k in (1, 3):
        found = N.best(df, q, 4, k, "euclidean", "cosine").withColumn("value", F.round("value", 9)).collect()
        for measure, sign in (("euclidean", 1), ("cosine", -1)):
            got = {}
            for r in found:
                if r.measure == measure:
                    got.setdefault((r.q_id, r.grp), []).append((sign * r.value, r.id))
            got = {key: sorted(v)[:k] for key, v in got.items()}
            pairs = spark.createDataFrame(live, "id long, grp string, vec array<double>")
            every = G.query_pairs(pairs, pairs.filter("id % 7 = 0").select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec")))
            value = F.round(getattr(V, measure)("q_vec", "vec"), 9)
            want = {}
            for r in every.select("q_id", "grp", "id", value.alias("value")).collect():
                want.setdefault((r.q_id, r.grp), []).append((sign * r.value, r.id))
            assert got == {key: sorted(v)[:k] for key, v in want.items()}


def point_table(spark, tmp_path, n, groups):
    """A small shared_space of n points in these groups, in two lengths."""
    rng = np.random.default_rng(3)
    rows = [(i, groups[i // 4 % len(groups)], None, None, None, f"d{i % 5}:{i}", f" l{i % 9} " if i % 4 else None, None, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(n, 64)))]
    schema = "point_id long, source_dataset string, epistemic_status string, attribution string, point_role string, key string, label string, mention_distribution map<string,int>, vectors array<float>"
    spark.createDataFrame(rows + rows[:5], schema).write.parquet(f"{tmp_path}/shared_space.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["best_corpus", "anchor_retrieval", "exemplar_neighbours", "review_list"])
def test_nearest_tables_form_no_pairs(spark, tmp_path, monkeypatch, name):
    """The same rows as its SQL, and no join beside every query."""
    import duckdb

    d = point_table(spark, tmp_path, 300, ["literature", "miviludes", "interviews", "miviludes_criteria", "emergent_entities"])
    monkeypatch.setattr(G, "beside", lambda *a: pytest.fail("pairs are formed"))
    con = duckdb.connect()
    con.execute(f"create view shared_space as select * from '{d}/shared_space.parquet/*.parquet'")
    got = Q.QUERIES[name](spark, d)
    want = con.sql(f"select {', '.join(got.columns)} from ({Q.SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and want


def test_first_by_hash_equals_a_full_sort(spark):
    rows = [("a" if i % 3 else "b", i, 7 if i % 3 else 200) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, id long, take long")
    got = {(r.g, r.id) for r in S.first_by_hash(df, ["g"], F.md5(F.col("id").cast("string")), "id", "take").collect()}
    want = set()
    for g, take in (("a", 7), ("b", 200)):
        ids = sorted((i for x, i, _ in rows if x == g), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        want |= {(g, i) for i in ids[:take]}
    assert got == want


def test_equal_draws_and_floor_first(spark):
    df = spark.createDataFrame([(i, "abc"[min(2, i // 5)], None, [float(i)], None) for i in range(40)], POINT)
    drawn = R.equal_draws(df, "grp", "id", 3)
    assert {tuple(r) for r in drawn.groupBy("rep", "grp").count().collect()} == {(k, g, 5) for k in range(3) for g in "abc"}
    strata = spark.createDataFrame([("a", 1), ("b", 10), ("c", 100), ("d", 2)], "s string, n long")
    take = {r.s: r["take"] for r in R.floor_first(strata, 20, [F.col("s")]).collect()}
    assert sum(take.values()) == 20 and min(take.values()) >= 1 and all(take[s] <= n for s, n in (("a", 1), ("d", 2)))
    assert {r.s: r["take"] for r in R.floor_first(strata, 2, [F.col("s")]).collect()} == {"a": 1, "d": 1, "b": 0, "c": 0}


def test_places_without_a_global_sort(spark):
    values = [random.Random(1).randrange(40) for _ in range(500)] + [None, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long")
    some = sorted(v for v in values if v is not None)
    for r in T.places(df, "v", "place").collect():
        assert r.place == (501 if r.v is None else some.index(r.v) + 1)


def test_spans(spark):
    t = "Line one\n\nthe  quick\nbrown fox"
    assert [[tuple(y) for y in x] if x else x for x in one(spark, P.line_spans(F.col("t")), t, "", None)] == [[(0, 8), (9, 9), (10, 20), (21, 30)], [(0, 0)], None]
    df = spark.createDataFrame([(1, t, "quick brown"), (2, t, "Line one"), (3, t, "slow"), (4, None, "x"), (5, t, " "), (6, "a (b) [c", "(b)  [c")], "id long, t string, q string")
    got = {r.id: tuple(r.r) if r.r else None for r in df.select("id", P.resolve(F.col("t"), F.col("q")).alias("r")).collect()}
    assert got == {1: (15, 26, "quick\nbrown"), 2: (0, 8, "Line one"), 3: None, 4: None, 5: None, 6: (2, 8, "(b) [c")}


def test_spans_without_overlap_equal_a_loop(spark, tmp_path):
    rng = random.Random(2)
    spark.createDataFrame([(i, i % 3, float(rng.randrange(50))) for i in range(200)], "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {}
    for r in spans_without_overlap(spark, str(tmp_path)).collect():
        got.setdefault(r.user_id, set()).add(r.event_id)
    rng = random.Random(2)
    spans = {}
    for i in range(200):
        n = int(rng.randrange(50) % 40 + 1)
        spans.setdefault(i % 3, []).append((-n, i, i % 1000, i % 1000 + n))
    for u, x in spans.items():
        kept = []
        for s in sorted(x):
            if not any(s[2] < k[3] and s[3] > k[2] for k in kept):
                kept.append(s)
        assert got[u] == {k[1] for k in kept}


def test_kept_in_order_equals_a_loop(spark):
    rng = random.Random(5)
    rows = [("ab"[i % 2], rng.choice([None, 0, 1, 2]), i, rng.choice(["x", "y", "z", "w", "v", None])) for i in range(120)]
    df = spark.createDataFrame(rows, "d string, c int, i long, t string")
    got = {(r.d, r.i): r.state for r in M.kept_in_order(df, ["d"], "c", "i", "t", 2).collect()}
    want = {}
    for d in "ab":
        seen, n = set(), {}
        for _, c, i, t in sorted((r for r in rows if r[0] == d), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            state = "repeated" if t in seen else "over" if n.get(c, 0) >= 2 else "kept"
            if state == "kept":
                seen.add(t)
                n[c] = n.get(c, 0) + 1
            want[d, i] = state
    assert got == want and set(got.values()) == {"kept", "repeated", "over"}
    assert M.kept_in_order(df.limit(0), ["d"], "c", "i", "t").count() == 0


def test_turns(spark):
    t = "Head\nInterviewee: lost\nInterviewer: Who?\nINTERVIEWEE: Me.\n---\nInterview notes: none\nInterviewer:\nParticipant: End"
    got = [(r.turn_no, r.role, r.content) for r in P.turns(texts(spark, t, None, "", "no labels"), ["id"], "t").orderBy("id", "turn_no").collect()]
    assert got == [(0, "interviewer", "Who?"), (1, "participant", "Me."), (2, "participant", "End")]


def test_aliases_and_masks(spark):
    df = texts(spark, "The Old Oath and OLD oath.", "oaths", None, "")
    got = {(r.id, r.entity) for r in P.alias_matches(df, [("Oath", "old oath"), ("Order", "oath")], "t").collect()}
    assert got == {(0, "Oath")}
    assert one(spark, X.masked(F.col("t"), "(?i)oath"), "an Oath, oaths here", None, "") == ["an [MASK] here", None, ""]


def test_mentions_overlap_and_come_in_blocks(spark, tmp_path, monkeypatch):
    """Names within names, beside letters of any alphabet, with signs at their ends, more than a block holds; the same
    rows as the SQL of entity_mentions gives."""
    import duckdb

    from lexilathe.plans import record_queries

    said = ["The House of Ash Grove.", "house of ash, HOUSE OF ASH GROVE", "éhouse of ash", "house of ashé", "house of ash_", "(x) and (x)y z(x)", "Ash grove ash", None, "", "a, b", "no name", "Ünion 9", "ünion 99"]
    names = ["House of Ash", "House of Ash Grove", "Ash Grove", "ASH GROVE", "(x)", "Ünion 9", "", "grove"]
    docs = spark.createDataFrame([(i, f"s{i % 3}", "interviews" if i % 2 else "literature", t) for i, t in enumerate(said * 2)], "doc_id long, source string, corpus string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n,) for n in [*names, None, names[0]]], "nearest_entity string").write.parquet(f"{tmp_path}/cluster_summary.parquet")
    con = duckdb.connect()
    for t in ("documents", "cluster_summary"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for most in (100, 2):
        monkeypatch.setattr(P, "NAMES", most)
        got = record_queries.entity_mentions(spark, str(tmp_path))
        want = con.sql(f"select {', '.join(got.columns)} from ({record_queries.SQL['entity_mentions']})").fetchall()
        assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 5


def test_fuzzy_best(spark):
    df = spark.createDataFrame([(1, "abcd", ["abce", "abcf"]), (2, "bc", ["xx", "abcdefghijkl"]), (3, None, ["a"]), (4, "a", None), (5, "a", [])], "id long, w string, c array<string>")
    got = {r.id: (r.x.best, r.x.ratio) for r in df.select("id", P.fuzzy_best("w", "c").alias("x")).collect()}
    assert got[1] == ("abce", 0.75) and got[2] == ("abcdefghijkl", 0.8) and got[3][0] is None and got[4][0] is None and got[5][0] is None


def test_text_functions(spark):
    assert one(spark, X.count_class(F.col("t"), "isolated_capital"), "a W b c W d", "aW b", "the W est", None) == [2, 0, 1, 0]
    assert one(spark, X.count_class(F.col("t"), "hyphen_linebreak"), "é-\nx a-\nb", "a- \nb") == [2, 0]
    assert one(spark, X.count_class(F.col("t"), "spaced_accent"), "e´ le a ´a ´", "") == [2, 0]
    assert one(spark, X.cipher_line(F.col("t")), "aα bβ plain words here for the rest of the line and more of it so that few are odd", "αα") == [True, False]
    assert one(spark, X.surnames(F.col("t")), "Doe, J.; Jane Roe (ed.) and Doe, K.", "", None) == [["Doe", "Roe"], [], None]
    assert one(spark, X.shortened(F.col("t"), 4), "abcdef", "abcd", None) == ["abc…", "abcd", None]
    assert one(spark, X.concept_term(F.col("t")), "/c/en/a_b/n", "/c/fr/a", None) == ["a b", None, None]
    assert one(spark, X.unfenced(F.col("t")), "x ```json\n{\"a\": 1}\n``` y", "{}", None) == ['{"a": 1}', "{}", None]
    assert one(spark, X.fold_newlines(F.col("t")), "a \n\n b", None) == ["a b", None]
    assert one(spark, X.title_case(F.col("t"), ["of", "the"]), "The House of Cards", "the House", "of the", "", None) == [True, False, False, False, False]
    assert one(spark, X.unbalanced(F.col("t")), '"a', "(a)", "«a", "") == [True, False, True, False]
    assert one(spark, X.all_words_in(F.col("t"), ["um", "er"]), "Um, er.", "um yes", "", None) == [True, False, True, True]
    assert one(spark, X.lexicon_hit(F.col("t"), ["oath"]), "the-Oath!", "oaths", None) == [True, False, False]


def test_titles_must_be_known(spark):
    rows, known = texts(spark, "a", "b"), spark.createDataFrame([("a", 1.0)], "t string, title double")
    assert titled(rows.filter("t = 'a'"), known, "t", "title").first().title == 1.0
    with pytest.raises(Exception, match="unknown key b"):
        titled(rows, known, "t", "title").collect()


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\nthree\n")
    assert sorted((r.line_no, r.line) for r in files.numbered_lines(spark, f"{tmp_path}/a.txt").collect()) == [(0, "one"), (2, "two"), (3, "three")]
    (tmp_path / "e.txt").write_text("")
    assert files.numbered_lines(spark, f"{tmp_path}/e.txt").count() == 0
    assert files.yaml_list("# c\nother:\n- id: x\nrefs:\n  - id: 'a'\n    year: 1999\n  - id: b\nlast: 1\n", "refs") == [{"id": "a", "year": "1999"}, {"id": "b"}]
    assert files.yaml_list(None, "refs") == files.yaml_list("", "refs") == []
    rows = spark.createDataFrame([(i, "h" if i in (0, 5) else None) for i in range(9)] + [(9, "z")], "n long, v string")
    got = {r.n: r.b for r in files.carried(rows, "n", "v", "b", block=2).collect()}
    assert got == {**{i: "h" for i in range(9)}, 9: "z"}
    assert one(spark, files.without_notes(F.col("t")), "talk\nNotes: x\ny", "talk", None) == ["talk", "talk", None]
    assert files.newest(spark, f"{tmp_path}/*.txt").endswith("e.txt") and files.newest(spark, f"{tmp_path}/*.none") is None


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a, \"b\""), (2, None)], "k long, v string")
    files.write_csv([rows, rows.select("k", F.lit("w").alias("extra"))], f"{tmp_path}/csv")
    back = files.csv_rows(spark, f"{tmp_path}/csv")
    assert sorted(back.columns) == ["extra", "k", "v"] and back.count() == 4 and 'a, "b"' in {r.v for r in back.collect()}
    with pytest.raises(Exception, match="already exists"):
        files.write_csv([rows], f"{tmp_path}/csv")
    files.write_csv([rows.limit(0)], f"{tmp_path}/empty")
    assert files.append_json(rows, f"{tmp_path}/json", "k") == 2 and files.append_json(rows, f"{tmp_path}/json", "k") == 0
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    a, b = files.split_columns(rows, "k", "v", f"{tmp_path}/split")
    assert a.columns == ["k"] and b.count() == 2
