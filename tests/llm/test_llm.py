import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexilathe.llm import clusters, encode, language, mojibake, neighbours, scans, shared, splitting, tokenizer, transcripts

HAVE_TOKENIZER = os.path.exists(tokenizer.DEFAULT_PATH)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- 1 ---------------------------------------------------------------------------------------------------------------

VOCABULARY = [("le", 900), ("café", 60), ("témoin", 80), ("décrit", 90), ("années", 90), ("naïve", 30), ("père", 50), ("the", 900), ("group", 90), ("coração", 40), ("château", 30), ("–", 500), ("’", 300), ("“", 300), ("”", 300), ("s", 300), ("irmã", 40), ("à", 300), ("»", 90), ("«", 90), ("moreover", 50)]


def lines_of(spark, texts):
    return spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(texts)], "document_id string, page_number int, line_index_in_page int, line_text string")


def test_p1_marks_and_restores(spark):
    right = ["le témoin décrit", "le café", "années", "le père – à", "the group’s", "“the group”"]
    wrong, want = [], []
    for t in right:
        for made, read in (("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "cp850")):
            try:
                x = t.encode(made).decode(read)
            except UnicodeError:
                continue
            if x != t:
                wrong.append(x)
                want.append(t)
    twice = "le témoin".encode().decode("cp1252").encode().decode("cp1252")
    clean = ["le CHÂTEAU", "Mor´eover", "the Зорнова group", "Κορβίνη", "the Boliǀiǀ group", "25 € ½ § ©", "CORAÇÃO", "«IRMÃ»", "", None, "the V group", "pt"]
    counts = spark.createDataFrame(VOCABULARY, "key string, n long")
    texts = [*wrong, twice, "le caf�", *clean]
    got = {r.line_index_in_page: r for r in mojibake.restore_lines(lines_of(spark, texts).union(lines_of(spark, texts[:3])), counts).collect()}
    assert len(got) == len(texts)
    n = len(wrong)
    assert all(got[i].found for i in range(n + 2)), [texts[i] for i in range(n + 2) if not got[i].found]
    assert sum(got[i].restored == want[i] for i in range(n)) >= 0.8 * n
    assert got[n].restored == "le témoin" and got[n + 1].restored == "le café"
    assert [texts[i] for i in range(n + 2, len(texts)) if got[i].found] == []


# --- 2 ---------------------------------------------------------------------------------------------------------------


def test_p1_lost_bytes_anywhere_in_a_word(spark):
    lost = {"le p\ufffdre d\ufffdcrit": "le père décrit", "caf\ufffd\ufffd": "café", "t\ufffd\ufffdmoin": "témoin", "gro\ufffdp": "group", "CH\ufffdTEAU": "CHÂTEAU", "cora\ufffd\ufffdo": "coração", "zzz\ufffdq": "zzz\ufffdq", "na\ufffdve": "naïve"}
    counts = spark.createDataFrame(VOCABULARY, "key string, n long")
    got = {r.line_text: r.restored for r in mojibake.restore_lines(lines_of(spark, list(lost)), counts).collect()}
    assert got == lost


def test_p2_pieces_give_the_text_back(spark):
    rng = random.Random(1)
    units = []
    for i, n in enumerate((0, 5, 50, 51, 400, 3000)):
        units.append(("u", f"d{i}", i, " ".join(rng.choice(["Ein", "Wörd.", "x\n", "y\n\n", "z\t", "é!"]) for _ in range(n)), 50))
    units += [("u", "null", 9, None, 50), ("u", "long", 10, "q" * 100_000, 50), units[4]]
    df = spark.createDataFrame(units, "unit_kind string, document_id string, chunk_index int, text string, most int")
    got = {}
    for r in splitting.split_units(df, splitting.KEY, "text", "most", 10).orderBy("piece_no").collect():
        got.setdefault(r.document_id, []).append(r.text.split())
    want = {u[1]: u[3].split() for u in units if u[3] and len(u[3].split()) > 50}
    assert set(got) == set(want)
    for k, pieces in got.items():
        back = pieces[0]
        for p in pieces[1:]:
            assert len(p) <= 50 and p[:10] == back[-10:]
            back = back + p[10:]
        assert back == want[k]


def test_p2_ranges_equal_one_scan(spark, tmp_path):
    rng = random.Random(2)
    text = "".join(rng.choice(["word ", "ünd ", "end. ", "a\n", "b\n\n", " \t ", "lang" * 40 + " "]) for _ in range(4000))
    data = text.encode()
    s, e, k = splitting.scan(data, 0, len(data))
    for step in (700, 5000):
        parts = []
        for lo in range(0, len(data), step):
            base, hi = max(0, lo - splitting.HALO), min(lo + step, len(data))
            parts.append(np.stack(splitting.range_words(data[base : hi + splitting.HALO], base, lo, hi)))
        assert (np.concatenate(parts, axis=1) == np.stack([s, e, k])).all()
    f = tmp_path / "big.txt"
    f.write_bytes(data * 20)
    data = data * 20
    kinds = splitting.scan(data, 0, len(data))
    pieces = splitting.split_files(spark, [str(f)], 300, 40).orderBy("piece_no").collect()
    assert [(p.start_byte, p.new_byte, p.end_byte) for p in pieces] == [(kinds[0][x], kinds[0][y], kinds[1][z - 1]) for x, y, z in splitting.choose(kinds[2], 300, 40)]
    assert b" ".join(data[p.new_byte : p.end_byte] for p in pieces).split() == data.split()
    assert max(p.n_words for p in pieces) <= 300


def test_p2_words_longer_than_a_range_and_long_gaps(spark):
    long = "q" * 200_000
    texts = [f"a. {long} b" + " c" * 30, "x" * 70_000 + "\n" * 9_000 + "y " * 40 + long, " " * 70_000 + "z " * 25]
    df = spark.createDataFrame([("u", f"d{i}", i, t, 20) for i, t in enumerate(texts)], "unit_kind string, document_id string, chunk_index int, text string, most int")
    got = {}
    for r in splitting.split_units(df, splitting.KEY, "text", "most", 5).orderBy("piece_no").collect():
        words = r.text.split()
        assert len(words) == r.n_words <= 20
        got[r.document_id] = got.get(r.document_id, []) + words[5 if r.document_id in got else 0 :]
    assert [got[f"d{i}"] for i in range(3)] == [t.split() for t in texts]


# --- 3 ---------------------------------------------------------------------------------------------------------------


def roles(text, given=None):
    return [r[0] for r in transcripts.parse(text, given)]


def test_p3_turns():
    t = "INTERVIEW — 2021-01-02 (in person)\n---\nInterviewer: [0:01] How (laughter) are you?\nwrapped line\n\nR: [0:05] Uhm...\n\nInt.: [0:07] Go on.\nR: [0:09] Fine. Uh, yes.\n[Transcriber's note: nothing]\nInterview notes: a remark\nIntervewee: [0:12] More."
    assert roles(t) == ["interviewer", "participant"]
    assert transcripts.parse(t, None)[0][1] == "How are you? wrapped line Go on."
    assert roles("S2: [0:20] Later answer.\nS1: [0:10] First question?\nS2: [0:30] End.") == ["interviewer", "participant"]
    assert roles("A: Yes.\n\nB: No.\n\n[laughs]\n\nA: Hm.\n\nB: Well.") == ["interviewer", "participant"]
    assert roles("One thing: so.\n\nYes.\n\nMmm.\n\nAgain.", ["participant", "interviewer", "participant", "interviewer"]) == ["participant", "interviewer"]
    assert roles("00:00:03,111 --> **Interviewer:** Why?\n00:00:09,000 --> R : Because.") == ["interviewer", "participant"]
    assert roles("") == [] and roles("---\n\n[inaudible]", None) == []
    assert roles("P: ¿Qué?\nEntrevistada: Nada.") == ["interviewer", "participant"]
    assert roles("I: What?\nP: Nothing.") == ["interviewer", "participant"]


def test_p3_table(spark):
    df = spark.createDataFrame([("d", 0, "I: a?\nR: b.", None), ("d", 0, "I: a?\nR: b.", None), ("e", 1, None, ["interviewer"]), ("f", 2, "", []), ("g", None, "x\n\ny", [None, "participant", "interviewer"])], "document_id string, chunk_index int, text string, turn_roles array<string>")
    got = rows(transcripts.speaker_turns(df).select("document_id", "turn_no", "speaker_role"))
    assert got == [("d", 0, "interviewer"), ("d", 1, "participant"), ("g", 0, "interviewer"), ("g", 1, "participant")]


# --- 4 ---------------------------------------------------------------------------------------------------------------

SENTENCES = {
    "en": "The people of this old village were always waiting for the morning train with their heavy bags.",
    "fr": "Les gens de ce vieux village attendaient toujours le train du matin avec leurs sacs très lourds.",
    "de": "Die Leute in diesem alten Dorf warteten immer mit ihren schweren Taschen auf den Zug am Morgen.",
    "es": "La gente de este viejo pueblo siempre esperaba el tren de la mañana con sus bolsas muy pesadas.",
    "it": "La gente di questo vecchio paese aspettava sempre il treno del mattino con le sue borse pesanti.",
    "pt": "As pessoas desta velha aldeia esperavam sempre o comboio da manhã com as suas malas muito pesadas.",
}


def test_p4_segments(spark):
    data = [("document", f"{k}{i}", label, s) for i in range(4) for k, s in SENTENCES.items() for label in [k if i else "en"]]
    data += [("document", "mix", "en", SENTENCES["en"] + "\n \t\n" + SENTENCES["de"].upper()), ("document", "null", "en", None), ("document", "blank", "", " \n\n\t"), ("document", "none", "", "12 34\n\n56"), ("document", None, "fr", SENTENCES["fr"])]
    df = spark.createDataFrame(data, "record_kind string, record_id string, label string, text string")
    ranks = language.fit_on(df)
    got = {(r.record_id, r.segment_no): r for r in language.language_segments(df, ranks).collect()}
    assert all(got[f"{k}{i}", 0].lang == k for k in SENTENCES for i in range(4))
    assert got["mix", 0].lang == "en" and got["mix", 1].lang == "de"
    assert not any(k[0] in ("null", "blank") for k in got)
    assert got["none", 1].lang is None and got["none", 1].n_letters == 0
    one = spark.createDataFrame([("English (British)",), ("de-AT",), ("français",), ("und",), (None,), ("PT",), ("entity",)], "l string")
    assert [r[0] for r in one.select(language.label_column(F.col("l"))).collect()] == ["en", "de", "fr", "", "", "pt", ""]


# --- 5, 7 ------------------------------------------------------------------------------------------------------------


def vectors(spark, x, extra=()):
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in enumerate(x)] + list(extra), "id long, vec array<float>")


@pytest.mark.parametrize("k1, k2, count", [(6, 6, 11), (1, 9, 4), (9, 2, 30), (12, 12, 60), (3, 3, 1)])
def test_p5_heap_and_batch_take_the_same_cells(k1, k2, count):
    rng = np.random.default_rng(0)
    d1, d2 = rng.random((40, k1)).astype(np.float32), rng.random((40, k2)).astype(np.float32)
    q, i, j = neighbours.first_cells(d1, d2, neighbours.staircase(k1, k2, count), count)
    for x in range(40):
        heap = neighbours.multi_sequence(d1[x], d2[x], count)
        sums = [d1[x, a] + d2[x, b] for a, b in heap]
        assert sums == sorted(sums) and len(heap) == min(count, k1 * k2)
        assert set(heap) == {(int(a), int(b)) for a, b in zip(i[q == x], j[q == x])}
    tied = neighbours.first_cells(np.zeros((1, 3), np.float32), np.zeros((1, 3), np.float32), neighbours.staircase(3, 3, 2), 2)
    assert set(zip(tied[1], tied[2])) >= {(0, 0), (0, 1)}


def test_p5_cells_and_codebooks_grow_with_the_collection(spark):
    assert [neighbours.cells_of_query(n, 20) for n in (0, 10_000, 100_000_000)] == [20, 200, 2_000]
    df = spark.range(6400).select("id", F.array(*[F.randn(i) for i in range(8)]).cast("array<float>").alias("vec"))
    index = neighbours.build_index(df, 8)
    assert [len(b) for b in index.books] == [10, 10] and index.n == 6400 and not index.crowds
    index.drop(spark)


def test_p5_units_and_hot_lists_in_parts(spark, monkeypatch):
    # A third of the rows in one list, units far smaller than the collection, blocks and few hits at a time; all cells
    # are taken, so the result must be that of brute force.
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[:300] = 9 * x[0] + x[:300]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (u.astype(np.float64) @ u.T.astype(np.float64)).round(5)
    np.fill_diagonal(s, -9)
    monkeypatch.setattr(neighbours, "UNIT", 40)
    monkeypatch.setattr(neighbours, "START", 10)
    index = neighbours.build_index(vectors(spark, x), 16)
    assert sum(index.sizes.values()) == 900 and index.units > 8
    for block, hits in ((50_000, 10**6), (33, 500)):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        monkeypatch.setattr(neighbours, "HITS", hits)
        for floor in (-2.0, 0.6):
            got = {}
            for v in range(index.units):
                if index.sizes.get(v):
                    for r in neighbours.search_unit(index, v, 5, 10_000, floor, True).to_pylist():
                        got[r["key"]] = r["near"][:5], r["cos"][:5]
            for i in range(900):
                want = sorted((c for c in s[i] if c >= floor), reverse=True)[:5]
                near, cos = got.get(i, ([], []))
                assert len(set(near)) == len(near) == len(want) or any(abs(c - floor) < 1e-4 for c in s[i])
                assert cos == pytest.approx(want[: len(cos)], abs=5e-5) and s[i][near].tolist() == pytest.approx(cos, abs=5e-5)
    index.drop(spark)


def test_p5_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[200:240] = x[0]  # a group of copies
    x[240] = x[0] * 2
    df = vectors(spark, x)
    bad = spark.createDataFrame([(1001, None), (1002, [0.0] * 8), (1003, [float("nan")] * 8), (1004, [1.0]), (1005, [None] * 8), (1006, [1.0] * 7 + [None]), (None, [1.0] * 8)], "id long, vec array<float>")
    index = neighbours.build_index(df.union(df.limit(20)).union(bad), 8)
    found = neighbours.search(spark, index, 5, 300)
    got = {}
    for r in neighbours.all_neighbours(df, found, 5, index.crowds).collect():
        got.setdefault(r.id, []).append((r.near_id, r.cos))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert index.n == 260 and index.crowds == 1
    assert set(got) == set(range(300)) and all(len(v) == 5 for v in got.values())
    for i, near in got.items():
        assert i not in [n for n, _ in near]
        assert sorted((c for _, c in near), reverse=True) == pytest.approx(sorted(s[i], reverse=True)[:5], abs=5e-5)  # entries keep 16 bits of a coordinate
    empty = neighbours.build_index(bad, 8)
    assert empty.n == 0 and neighbours.search(spark, empty, 5, 300).count() == 0
    assert bad.filter(F.col("id").isNotNull() & neighbours.is_valid(F.col("vec"), 8)).count() == 0


def test_p7_clusters(spark):
    rng = np.random.default_rng(2)
    centers = np.linalg.qr(rng.normal(size=(16, 16)))[0][:4]
    x = np.concatenate([c + 0.12 * rng.normal(size=(n, 16)) for c, n in zip(centers, (30, 12, 20, 5))] + [rng.normal(size=(20, 16))])
    x[62:67] += 3  # apart
    members, stats = clusters.cluster(vectors(spark, x), 16)
    got = {}
    for r in members.collect():
        got.setdefault(r.first_id, set()).add(r.id)
    for lo, hi in ((0, 30), (30, 42), (42, 62)):
        assert len(got[lo] & set(range(lo, hi))) >= 0.9 * (hi - lo) and not got[lo] & (set(range(62)) - set(range(lo, hi)))
    assert {r["size"] for r in stats.collect()} == {len(v) for v in got.values()}


def test_p7_copies_count_as_points(spark):
    # Two near-equal vectors with 5 copies each, two with 40 each, two with 2 each, repeated rows; each pair far from all.
    x, eye = [], np.eye(16)
    for c, n in ((0, 5), (4, 40), (8, 2)):
        for side in (0.05, -0.05):
            x += [eye[c] + side * eye[c + 1]] * n
    df = vectors(spark, x)
    members, stats = clusters.cluster(df.union(df.limit(3)), 16)
    got = {}
    for r in members.collect():
        got.setdefault(r.first_id, set()).add(r.id)
    assert got == {0: set(range(10)), 10: set(range(10, 90))}
    assert {r["size"] for r in stats.collect()} == {10, 80}


def test_p7_components_and_squaring(spark):
    rng = random.Random(3)
    edges = {(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(45)) if a < b}
    for most in (10**6, 5):  # in one task, and by contraction first
        got = {}
        for r in clusters.components(spark.createDataFrame(list(edges), "a long, b long"), most).collect():
            got.setdefault(r.comp, set()).add(r.node)
        assert all(c == min(v) for c, v in got.items())
        both = [*both, got] if most < 10 else [got]
    assert both[0] == both[1]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[root(a)] = root(b)
    want = {}
    for v in list(parent):
        want.setdefault(root(v), set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    blocks = [(g * 10 + a, g * 10 + b, 0.6) for g in range(2) for a in range(6) for b in range(a + 1, 6)] + [(0, 10, 0.05)]
    df = spark.createDataFrame(blocks, "a long, b long, w double")
    by_joins = {r.node: r.label for r in clusters.mcl_by_joins(df).collect()}
    pdf = df.toPandas()
    dense = dict(zip(*clusters.mcl_dense(*(pdf[c].to_numpy() for c in "abw"))[:2]))
    for labels in (by_joins, dense):
        groups = {}
        for n, label in labels.items():
            groups.setdefault(label, set()).add(n)
        assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3, 4, 5], [10, 11, 12, 13, 14, 15]]


def partition(labels):
    groups = {}
    for n, label, *_ in labels:
        groups.setdefault(label, set()).add(n)
    return sorted(map(sorted, groups.values()))


def test_p7_large_clusters_by_either_path(spark):
    # Clusters well above 60 members, a chain whose flow takes long to be still, and two attractors at the end of chains.
    rng = random.Random(9)
    edges = [(g * 1000 + a, g * 1000 + b, round(rng.uniform(0.1, 0.6), 3)) for g, (n, p) in enumerate(((150, 1.0), (200, 0.4))) for a in range(n) for b in range(a + 1, n) if rng.random() < p]
    edges += [(0, 1000, 0.1), (1, 1001, 0.1)] + [(2000 + i, 2001 + i, 0.3) for i in range(90)] + [(3000, 3001, 0.6), (3001, 3002, 0.1), (3000, 3003, 0.1)]
    df = spark.createDataFrame(edges, "a long, b long, w double")
    pdf = df.toPandas()
    nodes, labels, flow, drawn = clusters.mcl_dense(*(pdf[c].to_numpy() for c in "abw"))
    dense = partition(zip(nodes.tolist(), labels.tolist()))
    by_joins = {r.node: (r.flow, r.drawn) for r in clusters.mcl_by_joins(df).collect()}
    assert all(by_joins[x] == pytest.approx((f, g), abs=5e-3) for x, f, g in zip(nodes.tolist(), flow, drawn))
    assert dense == partition(map(tuple, clusters.mcl_by_joins(df).collect()))
    assert list(range(150)) in dense and list(range(1000, 1200)) in dense


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_p6_noise(spark):
    body = "the household describes every member of the old community and this\ncategory follows the public record with great care because one hou-\nsehold rejects the member\n\nthe community changes the category of the record and the first- and\nsecond-hand member follows"
    pages = []
    for n in range(1, 9):
        head = "The Old Title" if n % 2 == 0 else "One Chapter" if n > 1 else "One Chapter\n"
        pages.append(("1999-the-old-title-000001", n, f"{head}\n{chr(96 + n) * 4} {body.replace('rejects', 'rejeets') if n == 3 else body} {chr(96 + n) * 5}{' co-' if n == 5 else ''}\n\n— {n + 4} —"))
    pages[5] = (*pages[5][:2], pages[5][2].replace("ffff the household", "mmunity the household", 1))
    pages += [pages[0], ("x", 1, None), ("x", 2, ""), (None, 3, "a"), ("y", None, "b"), ("z", 1, "One line")]
    pages += [("w", i, f"{chr(97 + i % 26) * (4 + i // 26)} rejects rejects rejects community category") for i in range(30)]
    df = spark.createDataFrame(pages, "document_id string, page_number int, text string")
    suspect = spark.createDataFrame([("q", 1, 1)], "document_id string, page_number int, line_no int")
    found = scans.scan_noise(df, suspect)
    got = {tuple(r)[:4] for r in found.collect()}
    d = "1999-the-old-title-000001"
    assert {g for g in got if g[3] == "header"} == {(d, n, 0, "header") for n in range(2, 9)}
    assert {g[1] for g in got if g[3] == "page_number"} == set(range(1, 9))
    hyphens = {g[:3] for g in got if g[3] == "hyphen"}
    assert (d, 2, 2) in hyphens and (d, 5, 6) in hyphens and not any(x[:2] == (d, 2) and x[2] == 5 for x in hyphens)
    assert {g for g in got if g[3] == "misread"} == {(d, 3, 3, "misread")}
    text = " ".join(r.text for r in scans.paragraphs(df, found).filter(f"document_id = '{d}' and page_number = 3").orderBy("paragraph_no").collect())
    assert "one household rejects the member" in text and "Chapter" not in text


def test_p6_hyphens_kept_or_dropped_and_words_over_a_page_end(spark):
    known = "long-term long-term long-term community community community example household " + "household " * 120 + "self self self self self made made made made made"
    pages = [("d", 1, known + "\nthe long-\nterm commu-\nnity is self-\nmade, a house-\nhoId house\xad\nhold and long\xad\nterm exam-"), ("d", 2, "ple of a com-\nmunity")]
    pages[0] = (*pages[0][:2], pages[0][2].replace("hoId", "ho1d"))
    df = spark.createDataFrame(pages, "document_id string, page_number int, text string")
    found = scans.scan_noise(df, spark.createDataFrame([], "document_id string, page_number int, line_no int"))
    got = {r.page_number: r for r in scans.paragraphs(df, found).collect()}
    assert got[1].text.endswith("the long-term community is self-made, a household household and longterm exam")
    assert got[1].open_end and got[1].glued and not got[2].glued
    assert got[2].text == "ple of a community"


# --- 8, 9 ------------------------------------------------------------------------------------------------------------


def test_p6_paragraphs_over_page_ends(spark):
    rows = [("d", 1, 0, "One.", False, False), ("d", 1, 1, "Two goes", True, False), ("d", 2, 0, "on and com", True, True), ("d", 4, 0, "munity ends.", False, False), ("d", 4, 1, "Three", True, False), ("e", 1, 0, "Alone", True, False), ("e", 2, 0, "end.", False, False), ("e", 3, 0, "Next.", False, False)]
    df = spark.createDataFrame(rows, "document_id string, page_number int, paragraph_no int, text string, open_end boolean, glued boolean")
    got = sorted(tuple(r) for r in scans.continuous(df).collect())
    assert got == [("d", 1, 0, 1, "One."), ("d", 1, 1, 4, "Two goes on and community ends."), ("d", 4, 1, 4, "Three"), ("e", 1, 0, 2, "Alone end."), ("e", 3, 0, 3, "Next.")]
    assert [scans._cased(a, b) for a, b in (("Tbe", "the"), ("TBE", "the"), ("tbe", "the"), ("0f", "of"))] == ["The", "THE", "the", "of"]


@pytest.mark.skipif(not HAVE_TOKENIZER, reason="no tokenizer files")
def test_p8_equals_the_library_and_round_trips(spark):
    import base64

    import tiktoken

    t = tokenizer.load()
    ref = tiktoken.Encoding("own", pat_str=tokenizer.SPLIT_PATTERN, mergeable_ranks=t.transducer.ranks, special_tokens={})
    rng = random.Random(5)
    pool = "aAbé ß \t\n²½١一ⅷ_'sll\x1c\x85 😀́.,!<|endoftext|>01 иΩ  \n"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["it's they'll 'twas", "x" * 5000, " ", ""]
    for s in texts:
        ids = t.encode(s)
        assert ids == ref.encode_ordinary(s), s
        assert t.decode(ids) == s
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts[:50])] + [(98, None), (99, ""), (99, ""), (None, "a")], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in encode.encode(df).collect()}
    assert got[98] == [] and got[99] == [] and got[3] == ref.encode_ordinary(texts[3])
    assert base64  # the file's format


def test_p8_streaming_utf8():
    m = tokenizer.Utf8Machine()
    data = "aé€😀z".encode()
    assert "".join(m.feed(data[i : i + 1]) for i in range(len(data))) + m.finish() == "aé€😀z"
    for bad in (b"\xc3", b"\xe2\x82a", b"\xff\xc0a", b"\xed\xa0\x80", b"\xf4\x90\x80\x80"):
        m = tokenizer.Utf8Machine()
        assert m.feed(bad) + m.finish() == bad.decode("utf-8", "replace")


@pytest.mark.skipif(not HAVE_TOKENIZER, reason="no tokenizer files")
def test_p9_shares_and_caps(spark):
    rng = random.Random(6)
    docs = [(i, "word " * rng.randint(1, 30), "big" if i % 10 else "small") for i in range(600)] + [(900, None, "big"), (901, "", "big"), (902, "x", None), (903, "x", "other")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed, shares = encode.mixture(df, targets)
    s = {r.source: r for r in shares.collect()}
    assert s["gone"].reached_share == 0 and s["small"].most_uses <= 3 and s["big"].most_uses <= 1
    assert s["big"].reached_share == pytest.approx(0.5 / 0.9, abs=0.01) and s["small"].reached_share == pytest.approx(0.4 / 0.9, abs=0.01)
    m = mixed.collect()
    assert sum(r.n_tokens * r.uses for r in m if r.source == "small") == s["small"].tokens_used == 3 * s["small"].tokens_available
    assert all(r.doc_id < 900 for r in m)
    assert encode.mixture(df.filter("doc_id < 0"), targets)[0].count() == 0


# --- 10 --------------------------------------------------------------------------------------------------------------


def shared_brute(texts, span):
    where = {}
    for i, t in texts:
        for p in range(len(t or "") - span + 1):
            where.setdefault(t[p : p + span], set()).add(i)
    pairs = {(a, b) for ids in where.values() for a in ids for b in ids if a < b}
    cover = {}
    for i, t in texts:
        hit = set()
        for p in range(len(t or "") - span + 1):
            if len(where[t[p : p + span]]) > 1:
                hit |= set(range(p, p + span))
        if hit:
            cover[i] = len(hit)
    return pairs, cover


def test_p10_share_kept_in_vain_stays_small():
    keys = np.random.default_rng(1).integers(0, 2**63, 1 << 14).astype(np.uint64)
    keys[:50] = keys[50:100]
    least = shared.estimated(keys, 16)  # the load of a full shard: four cells a key
    assert (least[:100] == 2).all() and (least[100:] == 2).mean() < 0.01
    assert shared.shards_for(0, 250) == 1 and shared.shards_for(30 * 10**9, 250) == 2747


@pytest.mark.parametrize("bits, shards", [(6, 1), (16, 1), (16, 7), (4, 40)])
def test_p10_equals_brute_force(spark, bits, shards):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdéf ") for _ in range(n))
    stretch = [word(n) for n in (20, 21, 39, 60, 100)]
    texts = []
    for i in range(60):
        t = word(rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            t += rng.choice(stretch) + word(rng.randint(0, 15))
        texts.append((i, t))
    texts += [(70, None), (71, ""), (72, "z" * 90), (73, "z" * 50), (74, texts[3][1]), (75, texts[3][1])]
    df = spark.createDataFrame(texts, "id long, text string")
    pairs, cover = shared_brute(texts, 20)
    runs = shared.shared_runs(df.repartition(3), "id", "text", span=20, bits=bits, shards=shards).cache()
    assert {tuple(r) for r in shared.shared_pairs(runs).collect()} == pairs
    assert {r.id: r.shared_chars for r in shared.shared_lengths(runs, 20).collect()} == cover


def test_p10_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(shared, "BLOCK", 64)
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (500, 19, 20, 64, 65, 84, 85, 150)] + [None]
    got = Counter()
    for _, hashes, o, p, _ in shared._runs(texts, 20):
        for i, at, h in zip(o, p, hashes):
            got[int(i), int(at)] = int(h)
    assert set(got) == {(i, p) for i, t in enumerate(texts) if t for p in range(len(t) - 19)}
    by_text = {}
    for (i, p), h in got.items():
        assert by_text.setdefault(texts[i][p : p + 20], h) == h


def test_registry():
    from lexilathe.llm import registry

    names = list(registry.queries())
    for n in (1, 2, 3, 4, 5, 6, 7, 10):
        assert f"p{n}_found" in names
    assert "p8_ids" in names and set(registry.oracle_sql()) <= set(names)
