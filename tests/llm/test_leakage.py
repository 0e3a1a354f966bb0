import random
import re
import unicodedata

from chronoloom.llm.leakage import leaked_passages, leaks, without_leaks


def words(t):
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t or "").lower())


def brute(docs, items, n=12):
    out = set()
    for i, t in items:
        w = words(t)
        size = min(n, len(w))
        grams = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
        for d, text in docs:
            v = words(text)
            if any(tuple(v[k : k + size]) in grams for k in range(len(v) - size + 1) if grams):
                out.add((d, i))
    return sorted(out)


def frames(spark, docs, items):
    return (spark.createDataFrame([(d, t, "y") for d, t in docs], "doc_id BIGINT, text STRING, item_id STRING"), spark.createDataFrame([(i, t, "z") for i, t in items], "item_id BIGINT, text STRING, doc_id STRING"))


def make(rng):
    vocabulary = ["the", "Straße", "ﬁne", "über", "화자", "x1", "²", "gain", "noise", "ＦＵＬＬ", "a_b", "½"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 6, 14, 30]))) for i in range(30)] + [(90, None), (91, ""), (92, "!!"), (93, "the gain")]
    docs = []
    for d in range(80):
        t = text(rng.randrange(40))
        if rng.random() < 0.5:
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(w) + 1)
            t += "\n" + ", ".join(w[a : a + rng.randrange(20)]).upper() + "; " + text(4)
        docs.append((d, t))
    return [*docs, (500, None), (501, ""), (502, "word " * 60_000), (7, docs[7][1])], items


def test_against_brute_force(spark):
    docs, items = make(random.Random(8))
    for n, block in ((12, 10**6), (5, 60)):
        d, i = frames(spark, docs, items)
        assert sorted(map(tuple, leaks(leaked_passages(d, i, n=n, block_chars=block)).collect())) == brute(docs, items, n)


def test_removal(spark):
    d, i = frames(spark, [(1, "Keep this. One-two three, four end"), (2, None), (3, "clean")], [(5, "two three four")])
    p = leaked_passages(d, i)
    assert {r.doc_id: r.text for r in without_leaks(d, p).collect()} == {1: "Keep this.    end", 2: None, 3: "clean"}
    assert sorted(r.doc_id for r in without_leaks(d, p, whole=True).collect()) == [2, 3]


def test_empty(spark):
    d, i = frames(spark, [(1, "a b")], [])
    assert leaked_passages(d, i).count() == 0
    d, i = frames(spark, [], [(1, "a b")])
    assert leaked_passages(d, i).count() == 0
