import random
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioflow.llm import common
from folioflow.llm import linededup as ld
from folioflow.llm import nearsets as ns


def shingles(line):
    return {line[i : i + 10] for i in range(max(1, len(line) - 9))} if line else set()


def brute(rows):
    lines = [((d, i), shingles(x)) for d, t in rows if t and d is not None for i, x in enumerate(t.split("\n"))]
    root = list(range(len(lines)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(lines):
        for j in range(i):
            b = lines[j][1]
            both = len(a & b)
            if a and b and 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    least, gone = {}, {}
    for i, (name, s) in enumerate(lines):
        if s:
            least[top(i)] = min(name, least.get(top(i), name))
    for i, ((d, n), s) in enumerate(lines):
        if s and least[top(i)] != (d, n):
            gone.setdefault(d, []).append(n)
    return {d: sorted(x) for d, x in gone.items()}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    pool = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 8, 12, 30, 90]))) for _ in range(60)]
    rows = []
    for d in range(60):
        own = []
        for _ in range(rng.randrange(1, 9)):
            x = rng.choice(pool)
            for _ in range(rng.choice([0, 0, 1, 3])):
                at = rng.randrange(len(x))
                x = x[:at] + rng.choice("xyzé") + x[at + 1 :]
            own.append(x)
        rows.append((d, "\n".join(own)))
    return rows


def test_against_brute_force(spark):
    rows = corpus(5) + [(900, None), (901, ""), (902, "\n\n"), (903, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (904, "aaaaaaaaaaaaaaaa"), (905, "é\né"), (None, "é")]
    greek, run = "αβγδεζηθικλμνξοπρστυφχψωάέήίόύώ", "漢字仮名交じり文章例題集成書籍目録帳簿"
    rows += [(910, greek * 3), (911, greek * 3 + "α"), (912, run[:9]), (913, run[:9] + "\n" + run[:10]), (914, run + run[::-1]), (915, run + run[::-1] + "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n", "3 AS lines", "4 AS rep", "5 AS gone_id", "6 AS gone_lines", "7 AS h", "8 AS c0", "length(text) AS n_chars")
    want = brute(rows)
    assert {r.doc_id: r.lines for r in ld.removed_lines(docs).collect()} == want
    got = ld.dedup_lines(docs)
    assert got.columns == docs.columns
    kept = {r.doc_id: r.text for r in got.collect()}
    for d, t in rows:
        left = [x for i, x in enumerate((t or "").split("\n")) if i not in want.get(d, [])]
        assert kept.get(d) == (None if d in want and not left else "\n".join(left) if d in want else t)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ld.removed_lines(docs).count() == 0 and ld.dedup_lines(docs).count() == 0


def test_ids_of_any_size_and_repeats(spark):
    """Other texts under one doc_id keep what is theirs; ids need not be small."""
    same, other = "one line that is the same in both", "and a line that nobody else has at all"
    rows = [(2**40, same), (2**41 + 2**40, same), (7, "first of seven\n" + other), (7, same + "\nlast of seven is this"), (7, same + "\nlast of seven is this"), (-5, "first of seven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in ld.dedup_lines(docs).collect()}
    assert got == {(7, other), (7, same + "\nlast of seven is this"), (-5, "first of seven")}


def test_a_line_of_every_document_stays_once(spark):
    docs = spark.createDataFrame([(d, f"the same line in all of them\nline {d} {'x' * (d % 50)} of its own {d * 7919}") for d in range(1500)], "doc_id long, text string")
    lost = {r.doc_id for r in ld.removed_lines(docs).collect() if 0 in r.lines}
    assert lost == set(range(1, 1500))


def test_sketches_leave_the_disk_before_texts_move(spark, monkeypatch):
    """Sketches are dealt out without a join of their own, and their table is gone when members get their texts."""
    seen, root = {}, Path(common.shared_dir(spark).removeprefix("file://"))
    monkeypatch.setattr(ld, "sketched_lines", lambda docs, f=ld.sketched_lines: seen.setdefault("told", f(docs)))
    monkeypatch.setattr(ld, "candidates", lambda drawn, *a, f=ld.candidates: f(seen.setdefault("drawn", drawn), *a))

    def near(*a, f=ld.near_components):
        seen["there"] = [p for p in seen["told"].inputFiles() if Path(p.removeprefix("file://")).exists()] if list(root.glob("lines-*")) == [] else ["lines"]
        return f(*a)

    before = list(root.glob("lines-*"))
    assert not before
    monkeypatch.setattr(ld, "near_components", near)
    docs = spark.createDataFrame([(d, f"a line that all have\nthe line of {d % 7} here") for d in range(20)], "doc_id long, text string")
    assert ld.removed_lines(docs).count() == 19
    assert seen["there"] == [] and "Join" not in seen["drawn"]._jdf.queryExecution().optimizedPlan().toString()


def test_classes_that_would_share_a_number_get_others(spark, monkeypatch):
    """Numbers of classes are hashes; where two classes have one, another salt names them."""
    rows, salts = corpus(8), []

    def few(salt, f=ld.class_of):
        salts.append(salt)
        return F.pmod(f(salt), F.lit(3)) if salt < 2 else f(salt)

    monkeypatch.setattr(ld, "class_of", few)
    got = ld.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.lines for r in got} == brute(rows) and max(salts) == 2


def test_sizes_part_what_cannot_link():
    """Sketches with equal bits are no candidates when their sets' sizes allow no link; sizes that allow one are never parted."""
    n = np.arange(1, 3000)
    for a in (1, 4, 5, 9, 64, 80, 1000, 2400):
        apart = (ns.size_class(n) - ns.size_class(np.array([a])) + np.uint64(1)) & np.uint64(15)
        assert (apart[100 * np.minimum(n, a) >= 80 * np.maximum(n, a)] <= 2).all()
    x = ns.size_class(np.array([100, 110, 300])) << np.uint64(60)
    bits = np.stack([x, np.zeros(3, dtype=np.uint64)], axis=1)
    a, b = ns.run_edges(np.array([7, 8, 9]), bits, np.array([0]), ld.BITS, ld.LEAST_BITS)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(7, 8)}


def test_large_components_meet_in_windows_of_sizes(spark, monkeypatch):
    """A candidate component over CELL is confirmed by windows that fit, without deals and blocks, and with them where a window is too large."""
    rng, tables = random.Random(3), []
    text = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    # Each prefix links with its neighbours only, so all of them are one component of many sizes.
    docs = spark.createDataFrame([(d, text[: int(40 * 1.09**d)]) for d in range(50)], "doc_id long, text string")
    edges = lambda *a: docs.selectExpr("doc_id - 1 AS a", "doc_id AS b").where("b > 0")
    monkeypatch.setattr(ns, "written", lambda df, name, f=ns.written: (tables.append(name), f(df, name))[1])
    classes = docs.selectExpr("doc_id AS node", "length(text) - 9 AS n")
    with_text = lambda m: m.join(docs.withColumnRenamed("doc_id", "id"), "id")
    for cell, deals in ((10, False), (3, True)):
        monkeypatch.setattr(ns, "CELL", cell)
        tables.clear()
        got = ns.near_components(edges(), classes, with_text, lambda t: ns.char_sets(t, 10), ns.compared)
        assert {tuple(r) for r in got.collect()} == {(d, 0) for d in range(1, 50)}
        assert ("placed" in tables) == deals and "windows" in tables


def test_sets_of_a_column():
    """Sets of a column are those of each text by itself."""
    texts = ["", "abc", None, "é", "漢字" * 9, "a" * 40, "abcdefghij", "ab é " * 7, "\U0001f600" * 12 + "x"]
    for column in (pa.array(texts), pa.array(["skipped é", *texts])[1:], pa.array(texts[:1]), pa.array(texts[:0], pa.string())):
        values, n = ns.char_sets(column, 10)
        own = np.split(values, np.cumsum(n)[:-1]) if len(n) else []
        assert len(own) == len(column)
        assert all(x.tolist() == ns.char_shingles(t, 10).tolist() for x, t in zip(own, column.to_pylist(), strict=True))
