import random
from collections import defaultdict

from chronoloom.llm import shared_spans
from chronoloom.llm.shared_spans import compact_paths, shared_graph, shared_share, shared_stretches, verified_paths


def brute(docs, least):
    owners = defaultdict(set)
    for d, t in docs:
        for p in range(len(t or "") - least + 1):
            owners[t[p : p + least]].add(d)
    out = set()
    spans = defaultdict(set)
    for d, t in docs:
        for p in range(len(t or "") - least + 1):
            if len(owners[t[p : p + least]]) > 1:
                spans[d].update(range(p, p + least))
                spans[d].add(-1)
    for d, chars in spans.items():
        chars.discard(-1)
        run = None
        for c in sorted(chars):
            if run and c == run[1]:
                run[1] = c + 1
            else:
                if run:
                    out.add((d, *run))
                run = [c, c + 1]
        out.add((d, *run))
    return sorted(out)


def found(spark, docs, least, k, hot=4096):
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id BIGINT, text STRING, seed STRING").repartition(3)
    return sorted(map(tuple, shared_stretches(df, least=least, k=k, hot=hot).collect()))


def corpus(rng, n=40):
    alphabet = "ab가𝒳 "
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(20, 120))) for _ in range(12)]
    docs = [(i, "".join(rng.choice(pool)[rng.randrange(10) :] if rng.random() < 0.6 else "".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 5)))) for i in range(n)]
    return [*docs, (900, None), (901, ""), (902, docs[0][1]), (903, docs[0][1]), (904, "a" * 300), (905, "b" + "a" * 100), (906, "xyz" * 70), (907, "yzx" * 40), (908, "q" * 200)]


def test_against_brute_force(spark):
    docs = corpus(random.Random(4))
    expected = brute(docs, 32)
    assert len(expected) > 20
    assert found(spark, docs, 32, 8) == expected
    assert found(spark, docs, 32, 8, hot=1) == expected  # every k-mer by the way of hot ones


def test_windows_need_one_other_record(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh") for _ in range(100))
    docs = [(1, text), (2, text[:60]), (3, text[40:])]
    assert found(spark, docs, 61, 16) == brute(docs, 61) == []
    assert found(spark, docs, 60, 16) == brute(docs, 60) == [(1, 0, 100), (2, 0, 60), (3, 0, 60)] or found(spark, docs, 60, 16) == brute(docs, 60)


def test_share_and_empty(spark):
    docs = spark.createDataFrame([(1, "abcd" * 10), (2, "abcd" * 10), (3, None)], "doc_id BIGINT, text STRING")
    got = {r.doc_id: (r.text_chars, r.n_stretches, r.shared_chars, r.share) for r in shared_share(docs, shared_stretches(docs, least=20, k=6)).collect()}
    assert got == {1: (40, 1, 40, 1.0), 2: (40, 1, 40, 1.0), 3: (0, 0, 0, 0.0)}
    assert found(spark, [], 20, 6) == []


def test_paths_compact_to_their_ends(spark):
    chain = [(i, i + 1 if i % 50 else None, 3, 2) for i in range(1, 51)]  # 1 -> 2 -> ... -> 50
    branch = [(100, 101, 4, 1), (101, None, 2, 5), (102, 103, 2, 0), (103, None, 2, 0), (104, 104, 2, 7)]  # 100 goes on elsewhere too
    got = {r.edge: (r.n_edges, r["size"]) for r in compact_paths(spark.createDataFrame(chain + branch, "edge BIGINT, next BIGINT, n BIGINT, span INT"), 20).collect()}
    assert got == {1: (50, 49 * 3 + 2 + 20), 100: (1, 21), 101: (1, 25), 102: (2, 21), 104: (1, 27)}
    assert compact_paths(spark.createDataFrame([], "edge BIGINT, next BIGINT, n BIGINT, span INT"), 20).count() == 0


def test_rows_come_by_the_compacted_paths(spark, monkeypatch):
    """A copied text is few paths of many edges, and without the paths nothing of it is found."""
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh") for _ in range(900))
    docs = [(1, text), (2, "x" * 7 + text), (3, text[100:500])]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    edges, segs = shared_graph(df, least=40, k=12)
    paths = verified_paths(df, edges, segs, least=40)
    assert paths.count() * 3 < edges.count() and paths.agg({"n_edges": "max"}).first()[0] > 5
    assert all(docs[r.doc_id - 1][1][r.low : r.high] in docs[0][1] for r in paths.collect())
    assert found(spark, docs, 40, 12) == brute(docs, 40)
    monkeypatch.setattr(shared_spans, "compact_paths", lambda common, least: common.select("edge", *[common.n.alias(x) for x in ("n_edges", "size")]).where("false"))
    assert found(spark, docs, 40, 12) != brute(docs, 40)


def test_texts_must_agree_at_their_places(spark, monkeypatch):
    """Edges whose hashes agree though their texts do not are found out at the source."""
    rng = random.Random(6)
    docs = [(i, "".join(rng.choice("abcdefgh") for _ in range(100))) for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    edges, segs = shared_graph(df, least=40, k=12)
    assert edges.count() == 0 and segs.count() == 0
    forged = spark.createDataFrame([(1, 1, 9, 0, d, 0, 0, 0) for d in (0, 1)], "seed BIGINT, seg BIGINT, edge BIGINT, after BIGINT, doc_id BIGINT, at BIGINT, lead INT, span INT")
    assert verified_paths(df, forged, shared_spans.distinct_edges(forged), least=40).count() == 0


def test_a_hot_key(spark):
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh") for _ in range(60))
    docs = [(i, "".join(rng.choice("abcdefgh") for _ in range(30)) + (shared if i % 10 else "") + "".join(rng.choice("abcdefgh") for _ in range(30))) for i in range(60)]
    assert found(spark, docs, 40, 12) == brute(docs, 40)
