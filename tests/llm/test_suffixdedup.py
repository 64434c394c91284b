import hashlib
import os
import random

import numpy as np
import pytest

from folioflow.llm import suffixdedup as sd


def brute(rows, length):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, dtype=bool)
        if d is not None:
            for i in range(len(data) - length + 1):
                w = data[i : i + length]
                if w in seen:
                    gone[i : i + length] = True
                seen.add(w)
        kept = bytes(b for b, g in zip(data, gone[:-1], strict=True) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(data) else 0
        out.append((d, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdé ") for _ in range(k))
    passages = [text(rng.randrange(90, 400)) for _ in range(10)]
    rows = []
    for d in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else text(rng.randrange(1, 200)) for _ in range(rng.randrange(1, 6))]
        t = list("".join(parts))
        if rng.random() < 0.5:
            t[rng.randrange(len(t))] = "Z"
        rows.append((d * 2, "".join(t)))
    rng.shuffle(rows)
    return rows


EDGES = [(900, None), (901, ""), (902, "x" * 700), (903, "x" * 450), (904, "ab" * 300), (905, "y" * 99), (906, "y" * 100), (None, "x" * 300), (None, None)]


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS count", "3 AS d", "4 AS runs", "5 AS anchor")
    got = sd.remove_repeats(docs)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute(rows, 100)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got.collect())


def test_against_brute_force(spark):
    check(spark, corpus(1) + EDGES)


def test_small_pieces_and_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 150)
    monkeypatch.setattr(sd, "BLOCKS", 2)
    monkeypatch.setattr(sd, "MERGE", 300)
    monkeypatch.setattr(sd, "SALTS", 3)
    check(spark, corpus(2, 40) + EDGES)


def blocks_of(seed):
    rng = random.Random(seed)
    base = [bytes(rng.choice(b"ab") for _ in range(150)) for _ in range(3)]
    blocks = [b[i : i + 120] for b in base for i in (0, 5, 30)] + [b"a" * 130, b"a" * 101, b"ba" * 60]
    rng.shuffle(blocks)
    return blocks, np.frombuffer(b"".join(blocks), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in blocks])])


def intervals(blocks, data, ends):
    place, group = sd.repeated_intervals(data, ends, 100)
    got = {}
    for p, g in zip(place.tolist(), group.tolist(), strict=True):
        got.setdefault(g, set()).add(p)
    want = {}
    for b, lo in zip(blocks, ends.tolist(), strict=False):
        for i in range(len(b) - 99):
            want.setdefault(b[i : i + 100], set()).add(lo + i)
    return sorted(map(sorted, got.values())), sorted(sorted(v) for v in want.values() if len(v) > 1)


@pytest.mark.parametrize("shards", [1, 2, 7])
def test_intervals(monkeypatch, shards):
    monkeypatch.setattr(sd, "SHARDS", shards)
    for seed in range(5):
        got, want = intervals(*blocks_of(seed))
        assert got == want


def test_intervals_of_one_letter():
    blocks = [b"a" * 130, b"a" * 101]
    got, want = intervals(blocks, np.frombuffer(b"".join(blocks), dtype=np.uint8), np.array([0, 130, 231]))
    assert got == want


@pytest.mark.parametrize("shards", [1, 4])
def test_the_merge_needs_sorted_shards(monkeypatch, shards):
    """The interleave is read against each shard's own order: in another order the same steps give other intervals."""
    monkeypatch.setattr(sd, "SHARDS", shards)
    rng = np.random.default_rng(3)

    def ends_first(letter, depth):
        order = rng.permutation(len(letter))
        return np.concatenate([order[letter[order] < 0], order[letter[order] >= 0]])

    blocks = blocks_of(1)
    assert intervals(*blocks)[0] == intervals(*blocks)[1]
    monkeypatch.setattr(sd, "sorted_shard", ends_first)
    got, want = intervals(*blocks)
    assert got != want


def test_common_prefixes_of_the_merge():
    """common is the longest common prefix, in letters, of neighbours in the merged order."""
    blocks, data, ends = blocks_of(2)
    depth, parts = 10, []
    padded = [np.append(np.frombuffer(b, dtype=np.uint8), 0) for b in blocks]
    edge = np.concatenate([[0], np.cumsum([len(x) for x in padded])])
    flat = np.concatenate(padded)
    block = np.repeat(np.arange(len(blocks)), np.diff(edge))
    letter = sd.letters(flat, edge[1:][block] - 1 - np.arange(len(flat)))
    for lo, hi in ((0, edge[4]), (edge[4], edge[-1])):
        parts.append((lo, sd.shard_transform(letter[lo:hi], edge[:-1][block[lo:hi]] - lo, depth)))
    interleave, common = sd.merged_transforms([t for _, (_, t, _) in parts], [n for _, (_, _, n) in parts], depth)
    turn = [iter((lo + order).tolist()) for lo, (order, _, _) in parts]
    places = [next(turn[s]) for s in interleave]

    def word(p):
        out = []
        while letter[p] >= 0 and len(out) < depth:
            out.append(letter[p])
            p += 10
        return tuple(out)

    words = [word(p) for p in places]
    for a, b, c in zip(words, words[1:], common[1:].tolist(), strict=False):
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert c == same


def test_empty(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_count_as_one_document(spark):
    rng = random.Random(4)
    t = "".join(rng.choice("abcdef") for _ in range(300))
    docs = spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in sd.remove_repeats(docs).collect()) == [(1, 0), (1, 0), (2, 300)]


def test_other_texts_under_one_id_are_other_documents(spark):
    rng = random.Random(5)
    a, b = ("".join(rng.choice("abcdef") for _ in range(400)) for _ in range(2))
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in sd.remove_repeats(docs).collect())
    assert got == [(1, 0), (2, 0), (2, 400), (3, 400)]


def test_ids_of_any_size(spark):
    rng = random.Random(6)
    a = "".join(rng.choice("abcdef") for _ in range(250))
    docs = spark.createDataFrame([(2**62, a), (-(2**62), a), (0, "z" + a)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in sd.remove_repeats(docs).collect()} == {-(2**62): 0, 0: 250, 2**62: 250}


def test_a_wave_moves_a_share_of_the_blocks(spark, monkeypatch):
    """Anchors are dealt out wave by wave, together all of them; the bytes cut out of documents leave the disk after the merge."""
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(d, "".join(rng.choice("abcdefgh ") for _ in range(2000)) + shared[d * 100 : d * 100 + 400]) for d in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = sd.numbered(docs).coalesce(1)
    every = sorted(tuple(r) for r in sd.anchor_rows(told, 100).collect())
    waves = [sorted(tuple(r) for r in sd.anchor_rows(told, 100, w, 2).collect()) for w in range(2)]
    assert sorted(waves[0] + waves[1]) == every and all(len(w) < 0.7 * len(every) for w in waves)
    made = []
    monkeypatch.setattr(sd, "written", lambda df, name, f=sd.written: made.append((name, f(df, name))) or made[-1][1])
    assert {r.doc_id: r.n_removed for r in sd.remove_repeats(docs).collect()} == brute_removed(rows)
    assert [n for n, _ in made].count("blocks") == sd.WAVES == 2 and [n for n, _ in made].count("texts") == sd.DEALS == 2
    assert not [p for n, df in made if n == "texts" for p in df.inputFiles() if os.path.exists(p.removeprefix("file://").removeprefix("file:"))]


def test_the_merge_gets_blocks_that_may_share_a_window(monkeypatch):
    """Of blocks with one anchor, those go on that have a longer string around it in common with another; the rest is not sorted."""
    rng = random.Random(9)
    text = lambda k: bytes(rng.choice(b"abcdefgh ") for _ in range(k))
    gram = next(g for g in iter(lambda: text(sd.K), None) if sd.grams(np.frombuffer(g, dtype=np.uint8), 1)[0] < 1 << 54)
    alone = [text(90) + gram + text(90) for _ in range(40)]
    # Two have all that stands before the anchor in common, two what follows, two some of both, by one byte more than a window and less.
    left, right = text(90), text(90)
    pairs = [left + gram + text(90), left + gram + text(90), text(90) + gram + right, text(90) + gram + right]
    pairs += [text(50) + left[50:] + gram + right[:44] + text(46) for _ in range(2)] + [text(60) + left[60:] + gram + right[:43] + text(47) for _ in range(2)]
    texts = alone + pairs
    rng.shuffle(texts)
    raw, ends = np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    piece, start, count, anchor = sd.anchors(raw, ends, 100)
    own = anchor == sd.grams(np.frombuffer(gram, dtype=np.uint8), 1)[0]
    assert own.sum() == len(texts)
    blocks = [raw[a : a + c + 99].tobytes() for a, c in zip(start[own], count[own], strict=True)]
    data, at = np.frombuffer(b"".join(blocks), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
    marked = sd.sharing(anchor[own].view(np.int64), data, at, 100)
    windows = [{b[i : i + 100] for i in range(len(b) - 99)} for b in blocks]
    shares = [any(w & v for v in windows[:i] + windows[i + 1 :]) for i, w in enumerate(windows)]
    assert sum(shares) >= 4 and not [i for i, s in enumerate(shares) if s and not marked[i]] and marked.sum() <= len(pairs)
    merged = []
    monkeypatch.setattr(sd, "covered_windows", lambda place, d, e, n, f=sd.covered_windows: merged.append(len(d)) or f(place, d, e, n))
    n = len(blocks)
    cols = [sd.pa.array(anchor[own].view(np.int64)), sd.pa.array(range(n)), *[sd.pa.array([0] * n, sd.pa.int64())] * 2, sd.pa.array(blocks, sd.pa.binary()), sd.pa.array([False] * n)]
    batch = sd.pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in sd.TEXTS.split(", ")])

    class Rows:  # the task's function runs here, on the rows themselves
        def mapInArrow(self, run, schema):
            return list(run(iter([batch])))

    found = sum(sum(b.column(3).to_pylist()) for b in sd.merged_blocks(Rows(), 100))
    want = sum(len(w) for w in windows) - len(set().union(*windows))
    assert found == want and sum(merged) <= sum(len(b) for i, b in enumerate(blocks) if marked[i]) < len(data) / 2


@pytest.mark.parametrize("seed", range(6))
def test_sharing_marks_all_that_share(monkeypatch, seed):
    """Few letters, so that strings repeat at many offsets: no block that shares a window is left out, whatever the length."""
    rng = random.Random(seed)
    length = (30, 100, 250)[seed % 3]
    base = [bytes(rng.choice(b"abc") for _ in range(3 * length)) for _ in range(4)]
    texts = [b"".join(rng.choice(base)[rng.randrange(length) : length + rng.randrange(2 * length)] for _ in range(2)) for _ in range(60)]
    raw, ends = np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    monkeypatch.setattr(sd, "STEP", 64)
    _, start, count, anchor = sd.anchors(raw, ends, length)
    assert count.sum() == sum(max(0, len(t) - length + 1) for t in texts)
    by = np.argsort(anchor, kind="stable")
    blocks = [raw[a : a + c + length - 1].tobytes() for a, c in zip(start[by], count[by], strict=True)]
    at = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
    marked = sd.sharing(anchor[by].view(np.int64), np.frombuffer(b"".join(blocks), dtype=np.uint8), at, length)
    owners = {}
    for i, b in enumerate(blocks):
        for k in range(len(b) - length + 1):
            owners.setdefault(b[k : k + length], {})[i] = anchor[by][i]
    assert all(len(set(o.values())) == 1 for o in owners.values())  # equal windows have one anchor
    assert not [i for o in owners.values() if len(o) > 1 for i in o if not marked[i]]


def test_anchors_are_the_leftmost_smallest_grams(monkeypatch):
    """Windows that are searched in steps get the anchors that each of them has alone, and pieces never share a block."""
    monkeypatch.setattr(sd, "STEP", 50)
    rng = np.random.default_rng(3)
    for sizes in ([], [99, 15], [0, 230, 100, 99, 400], [163, 164, 165]):
        raw, ends = rng.integers(97, 99, sum(sizes), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        want = []
        for p, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            last = None
            for w in range(lo, hi - 99):
                h = sd.grams(raw[w : w + 100], 85)
                at = w + int(np.argmin(h >> np.uint64(sd.PLACE_BITS)))
                if at != last:
                    want.append([p, w, 0, int(h[at - w])])
                    last = at
                want[-1][2] += 1
        assert [list(map(int, r)) for r in zip(*sd.anchors(raw, ends, 100), strict=True)] == want


def brute_removed(rows):
    first, out = {}, {}
    for d, text in sorted(rows):
        data, gone = text.encode(), set()
        for i in range(len(data) - 99):
            if data[i : i + 100] in first:
                gone.update(range(i, i + 100))
            first.setdefault(data[i : i + 100], (d, i))
        out[d] = len(gone)
    return out


def test_only_blocks_that_may_share_a_window_are_cut_out(spark):
    """Blocks of one anchor with nothing else in common stay where they are; those that share a window go on."""
    rng = random.Random(9)
    text = lambda k: bytes(rng.choice(b"abcdefgh ") for _ in range(k))
    gram = next(g for g in iter(lambda: text(sd.K), None) if sd.grams(np.frombuffer(g, dtype=np.uint8), 1)[0] < 1 << 54)
    left = text(90)
    texts = [text(90) + gram + text(90) for _ in range(40)] + [left + gram + text(90) for _ in range(2)]
    docs = spark.createDataFrame([(d, t.decode()) for d, t in enumerate(texts)], "doc_id long, text string")
    blocks = sd.anchor_rows(sd.numbered(docs), 100).repartition(1)
    assert blocks.where(f"anchor = {int(sd.grams(np.frombuffer(gram, dtype=np.uint8), 1)[0])}").count() == 42
    went = sd.told_apart(blocks.sortWithinPartitions(*sd.NAMES[:6])).where("anchor is not null").collect()
    assert {40, 41} <= {r.doc_id for r in went} and len({r.doc_id for r in went}) < 5
    assert {r.doc_id: r.n_removed for r in sd.remove_repeats(docs).collect()} == brute_removed([(d, t.decode()) for d, t in enumerate(texts)])


@pytest.mark.parametrize("wide", [1, 3])
def test_anchors_with_more_blocks_than_are_held(spark, monkeypatch, wide):
    monkeypatch.setattr(sd, "BLOCKS", 2)
    monkeypatch.setattr(sd, "WIDE", wide)
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert {r.doc_id: r.n_removed for r in sd.remove_repeats(docs).collect()} == brute_removed(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
