import random
import re

from folioflow.llm import decontaminate as d


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    out = []
    for i, text in docs:
        w, hit, of = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(size, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[s : s + n]:
                        hit |= set(range(at, at + n))
                        of |= {item} - {None}
        out.append((i, len(w), len(hit), len(of), bool(hit)))
    return sorted(out, key=str)


def check(spark, docs, items, size):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS h", "'x' AS words", "2 AS wid")
    it = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS len", "2 AS win")
    got = d.contamination(df, it, size).select("doc_id", "n_words", "n_hit", "n_items", "contaminated")
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, size)


def test_against_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["a", "B", "c", "É", "1"]) + rng.choice([".", ",", "", "!\n"]) for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(40)] + [(90, None), (91, ""), (1, "other a b"), (None, "a b c")]
    docs += [docs[0], docs[3]]
    items = [(i, text(rng.randrange(1, 14))) for i in range(12)] + [(50, None), (51, "?"), (52, "zebra"), (None, "a b c")]
    check(spark, docs, items, 4)
    check(spark, docs, [], 4)
    check(spark, [], items, 4)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x a y y b z"), (2, "a q q q q q q b"), (3, None), (4, "b b a")], "doc_id long, text string")
    phrases = spark.createDataFrame([(7, "a b"), (8, "nowhere a"), (9, "")], "phrase_id long, text string")
    got = d.proximity(d.forward_table(docs), phrases, within=3)
    assert {(r.doc_id, r.phrase_id) for r in got.collect()} == {(1, 7), (4, 7)}
