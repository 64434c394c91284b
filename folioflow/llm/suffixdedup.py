"""Suffix-array dedup: bytes of repeated strings, found by merging shard Burrows-Wheeler transforms.

Every window of LENGTH bytes belongs to the anchor it contains: the leftmost of
its K-byte grams with the smallest hash. Equal windows have equal anchors, so
anchors deal the windows to tasks that never need each other. The windows of one
anchor occurrence form a block of text. Copies of a block (one anchor and one
BLAKE2b digest of 120 bits of its bytes) are one string with many places and
are counted before any text moves; anchors with different blocks go on, and of these
the blocks that may share a window with another: so say hashes of a few strings around
the anchor, which stand beside the block's name.

In a task the blocks are cut into shards. Each shard's suffixes are sorted by
themselves once, which gives its transform over SYMBOL-byte letters: the letter
before each suffix, in sorted order. From there on only transforms are read. An
interleave vector says from which shard each merged place comes; every step
reads the transforms through it, shard by shard in their own order, and deals
the vector by the letters read (Holt and McMillan, 2014), which sorts it one
letter deeper. A boundary that appears between neighbours in step h + 1 says
that their common prefix is h letters long (Egidi and Manzini, 2017). Places
that no boundary divides after LENGTH bytes are the repeated intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import dropped, shuffle_partitions, slices, written
from folioflow.llm.nearsets import U, mixed, powers, sums
from folioflow.session import table

LENGTH, K, SYMBOL = 100, 16, 10
#: Bytes of text that are searched for anchors, bytes of blocks that are held to see which may share a window, and of those that are merged, together.
CHUNK, HELD, MERGE = 1 << 20, 600_000, 60_000
#: Windows whose anchors are found together, few enough to stay in a processor's cache, and the bits that number their places.
STEP, PLACE_BITS = 1 << 14, 16
#: Strings of each block of which one must occur in another block of its anchor.
PROBES = 4
#: Different blocks of one anchor that a task merges together; an anchor with more is dealt out by window.
BLOCKS = 8_000
#: So many times as many are held by name, to see which may share a window, before an anchor is dealt out unseen.
WIDE = 16
SHARDS = 4
#: Tasks that first meet the equal windows of a hot anchor, each a share of them.
SALTS = 32
#: Anchors are dealt out in so many waves, and documents whose blocks are cut out in so many, so that only a share of either is on disk at a time.
WAVES, DEALS = 2, 2


def grams(raw: np.ndarray, n: int) -> np.ndarray:
    """A hash of each of the first n strings of K bytes."""
    word = np.ndarray(len(raw) - 7, "<u8", np.ascontiguousarray(raw), strides=(1,))
    return mixed(word[:n] * U(0x9E3779B97F4A7C15) + word[K - 8 : K - 8 + n])


def anchors(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(piece, start in raw, count, anchor hash) of every block of the pieces raw[ends[i]:ends[i+1]].

    A block owns `count` windows from `start` on; it is `count + length - 1` bytes long.
    """
    return placed_anchors(raw, ends, length)[:4]


def placed_anchors(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """anchors() and the place of each block's anchor in raw."""
    n, reach = len(raw) - length + 1, length - K + 1
    if n <= 0:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    # A hash gives its low bits to its place; how many, depends on nothing, so equal windows agree wherever they stand.
    places, mask = np.arange(STEP + reach, dtype=np.uint64), U((1 << PLACE_BITS) - 1)
    found = []
    for lo in range(0, n, STEP):
        hi = min(lo + STEP, n)
        h = grams(raw[lo : hi + length - 1], hi - lo + reach - 1)
        low = (h & ~mask) | places[: len(h)]
        span = 1
        while span * 2 <= reach:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if reach > span:
            low = np.minimum(low[: span - reach], low[reach - span :])
        first = np.flatnonzero(runs_of([low]))
        at = (low[first] & mask).astype(np.int64)
        found.append((first + lo, at + lo, h[at]))
    start, at, anchor = (np.concatenate(c) for c in zip(*found, strict=True))
    # Blocks end where the anchor changes and where pieces begin or have no whole window left.
    sizes = np.maximum(np.diff(ends) - length + 1, 0)
    own = np.flatnonzero(sizes)
    begin, stop = ends[:-1][own], (ends[:-1] + sizes)[own]
    cut = np.unique(np.concatenate([start[runs_of([at])], begin, stop, [n]]))
    count, cut = np.diff(cut), cut[:-1]
    of = np.searchsorted(begin, cut, side="right") - 1
    inside = cut < np.append(stop, 0)[of]  # `of` is -1 before the first piece
    cut, count, of = cut[inside], count[inside], of[inside]
    by = np.searchsorted(start, cut, side="right") - 1
    return own[of], cut, count, anchor[by], at[by]


def probes(at: np.ndarray, begin: np.ndarray, end: np.ndarray, data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, hashes) for each of PROBES strings around the anchors at `at`; rows: blocks data[begin:end] that hold the string.

    Equal windows hold their anchor at one offset. Cut into PROBES, the offsets
    leave each window a string, less than a window by one such part, that begins
    a fixed number of bytes before the anchor: who shares a window shares that.
    """
    step = -(-(length - K) // PROBES)
    total, inverse = sums(data), powers(len(data) + 1)[1]
    for j in range(PROBES):
        start = at - step * j
        ok = np.flatnonzero((start >= begin) & (start + length - step <= end))
        yield ok, (total[start[ok] + length - step] - total[start[ok]]) * inverse[start[ok]]


def packed_probes(at: np.ndarray, begin: np.ndarray, end: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """The probes of each block in 64 bits, an equal share for each; 0 where the block lacks the string."""
    bits = 64 // PROBES
    out = np.zeros(len(at), dtype=np.uint64)
    for j, (rows, probe) in enumerate(probes(at, begin, end, data, length)):
        out[rows] |= np.maximum(mixed(probe) >> U(64 - bits), U(1)) << U(bits * j)
    return out


def may_share(keys: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Marks the blocks that have a probe in common with another of their key; equal keys stand together. All that share a window are marked."""
    bits = 64 // PROBES
    marked = np.zeros(len(keys), dtype=bool)
    group = np.cumsum(runs_of([keys])).astype(np.uint64) << U(bits)
    for j in range(PROBES):
        code = (packed >> U(bits * j)) & U((1 << bits) - 1)
        rows = np.flatnonzero(code)
        name = group[rows] | code[rows]
        by = np.argsort(name)
        alike = ~runs_of([name[by]])
        alike[:-1] |= alike[1:]
        marked[rows[by[alike]]] = True
    return marked


def block_digests(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two numbers for each block: 128 bits of BLAKE2b over its bytes."""
    of = hashlib.blake2b
    found = b"".join([of(data[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)])
    return np.frombuffer(found, dtype=np.uint64).reshape(-1, 2)


#: A block by name: its anchor, its digest (the low byte of b1 is its count of windows), its place, and its packed_probes().
PLACES = "anchor long, b1 long, b2 long, doc_id long, h long, start long, probes long"
NAMES = [f.split()[0] for f in PLACES.split(", ")]


def runs_of(columns: list[np.ndarray]) -> np.ndarray:
    """Marks the rows that differ from the row before in one of the columns."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def after(place: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Whether place comes after other, both (doc_id, h, start)."""
    (d, h, s), (d2, h2, s2) = place, other
    return (d > d2) | ((d == d2) & ((h > h2) | ((h == h2) & (s > s2))))


def anchor_rows(docs: DataFrame, length: int, wave: int = 0, waves: int = 1) -> DataFrame:
    """PLACES of every block whose anchor is of this wave; docs: (doc_id, h, text).

    A block that an equal one of the same chunk precedes is covered already: its
    start is given as -1 - start and its anchor is any number, so that copies of
    one text do not meet in one task.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            data = b"".join([p[3] for p in pieces])
            ends = np.concatenate([[0], np.cumsum([len(p[3]) for p in pieces])])
            raw = np.frombuffer(data, dtype=np.uint8)
            found = placed_anchors(raw, ends, length)
            mine = found[3] % U(waves) == wave
            piece, at, count, anchor, middle = (c[mine] for c in found)
            packed = packed_probes(middle, at, at + count + length - 1, raw, length)
            digest = block_digests(data, at, count + length - 1)
            one, two = ((digest[:, 0] >> U(8)) << U(8)) | count.astype(np.uint64), digest[:, 1]
            ids, hs, base = (np.array([p[i] for p in pieces], dtype=np.int64)[piece] for i in range(3))
            place = [ids, hs, base + at - ends[:-1][piece]]
            by = np.lexsort((place[2], place[1], place[0], two, one, anchor))
            if len(by):
                new = runs_of([anchor[by], one[by], two[by]])
                first = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
                later = by[after([c[by] for c in place], [c[first] for c in place])]
                anchor[later] = mixed(anchor[later] + place[2][later].astype(np.uint64) * U(3) + place[0][later].astype(np.uint64))
                place[2][later] = -1 - place[2][later]
            cols = [anchor.view(np.int64), one.view(np.int64), two.view(np.int64), *place, packed.view(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], NAMES)

        pieces: list[tuple[int, int, int, bytes]] = []
        held = 0
        for batch in slices(it):
            for doc, h, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode()
                # Long texts go in parts that overlap by all but one byte of a window.
                for base in range(0, len(data) - length + 1, CHUNK):
                    pieces.append((doc, h, base, data[base : base + CHUNK + length - 1]))
                    held += len(pieces[-1][3])
                    if held >= CHUNK:
                        yield flush()
                        pieces, held = [], 0
        if pieces:
            yield flush()

    return docs.mapInArrow(run, PLACES)


APART = "doc_id long, h long, start long, count int, anchor long, hot boolean"


def told_apart(blocks: DataFrame) -> DataFrame:
    """APART rows: blocks that an equal earlier block covers (anchor is null), and blocks that may share a window with others of their anchor.

    blocks: anchor_rows(), sorted by all columns but the last within partitions by anchor.
    An anchor without a second such block is passed over. hot marks those with more than BLOCKS different ones.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(cols: list[np.ndarray], named: bool, hot: np.ndarray | bool) -> pa.RecordBatch:
            a, b, _, d, h, s = cols[:6]
            name = pa.array(a) if named else pa.nulls(len(a), pa.int64())
            arrays = [pa.array(d), pa.array(h), pa.array(s), pa.array((b & 0xFF).astype(np.int32)), name, pa.array(np.broadcast_to(hot, len(a)).astype(bool))]
            return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in APART.split(", ")])

        def apart(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Whole anchors, or the last rows of the one that has gone on before."""
            keep = may_share(cols[0], cols[6].view(np.uint64))
            if hot_anchor is not None:
                keep |= cols[0] == hot_anchor
            cols = [c[keep] for c in cols]
            if len(cols[0]):
                sizes = np.diff(np.append(np.flatnonzero(runs_of(cols[:1])), len(cols[0])))
                hot = np.repeat(sizes, sizes) > BLOCKS
                yield out(cols, True, hot if hot_anchor is None else hot | (cols[0] == hot_anchor))

        open_ = [np.zeros(0, dtype=np.int64)] * 7  # the first rows of each block of the last anchor
        hot_anchor = None
        for batch in it:
            cols = [np.asarray(batch.column(i)) for i in range(7)]
            known = cols[5] < 0
            if known.any():
                yield out([*(c[known] for c in cols[:5]), -1 - cols[5][known]], False, False)
                cols = [c[~known] for c in cols]
            if not len(cols[0]):
                continue
            # The first place of the block that the last batch ended in goes before this batch.
            carried = open_
            if len(open_[0]):
                cols = [np.concatenate([x[-1:], y]) for x, y in zip(open_, cols, strict=True)]
                carried = [x[:-1] for x in open_]
            new = runs_of(cols[:3])
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            later = after(cols[3:6], [c[first] for c in cols[3:6]])
            if later.any():
                yield out([c[later] for c in cols], False, False)
            cols = [np.concatenate([x, y[new]]) for x, y in zip(carried, cols, strict=True)]
            a = cols[0]
            done = a != a[-1]
            if done.any():
                yield from apart([c[done] for c in cols])
            open_ = [c[~done] for c in cols]
            if len(open_[0]) > WIDE * BLOCKS:
                hot_anchor = int(open_[0][0])
                yield out([c[:-1] for c in open_], True, True)
                open_ = [c[-1:] for c in open_]
        if len(open_[0]):
            yield from apart(open_)

    return blocks.mapInArrow(run, APART)


TEXTS = "key long, doc_id long, h long, start long, text binary, hot boolean"


def block_texts(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """TEXTS: the bytes of wanted blocks; hot ones window by window, keyed by the window's own hash. docs: (doc_id, h, text)."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
    names = [f.split()[0] for f in TEXTS.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in slices(it):
            texts, lists = batch.column(2), batch.column(3)
            for i, (doc, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                data = texts[i].as_py().encode()
                for start, count, anchor, hot in zip(*(c.to_pylist() for c in lists[i].values.flatten()), strict=True):
                    if not hot:
                        rows.append((anchor, doc, h, start, data[start : start + count + length - 1], False))
                        continue
                    for j in range(start, start + count):
                        text = data[j : j + length]
                        rows.append((int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True), doc, h, j, text, True))
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    lists = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "count", "anchor", "hot")).alias("blocks"))
    return docs.join(lists, ["doc_id", "h"]).select("doc_id", "h", "text", "blocks").mapInArrow(run, TEXTS)


def first_windows(texts: DataFrame) -> DataFrame:
    """TEXTS of hot anchors without the windows that equal an earlier one of their share, whose start becomes -1 - start.

    Rows are sorted by (key, text, doc_id, h, start) within partitions by (key, share); a task holds one row.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, text, place = None, None, (0, 0, 0)
        for batch in it:
            keys, docs, hs, starts = (batch.column(i).to_pylist() for i in range(4))
            for i, value in enumerate(batch.column(4).to_pylist()):
                if keys[i] != key or value != text:
                    key, text, place = keys[i], value, (docs[i], hs[i], starts[i])
                elif (docs[i], hs[i], starts[i]) > place:
                    starts[i] = -1 - starts[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(starts, pa.int64()), batch.column(4), batch.column(5)], batch.schema.names)

    return texts.mapInArrow(run, TEXTS)


def dense(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Order-keeping numbers from 0 for the pairs (high, low) of small non-negative integers: one sort of packed keys."""
    n = len(high)
    if not n:
        return np.zeros(0, dtype=np.int64)
    w, k = int(low.max()).bit_length(), int(n - 1).bit_length()
    if int(high.max()).bit_length() + w + k > 63:
        return np.unique(np.stack([high, low], axis=1), axis=0, return_inverse=True)[1].ravel()
    packed = np.sort((((high.astype(np.int64) << w) | low) << k) | np.arange(n))
    pair = packed >> k
    number = np.zeros(n, dtype=np.int64)
    np.cumsum(pair[1:] != pair[:-1], out=number[1:])
    out = np.empty(n, dtype=np.int64)
    out[packed & ((1 << k) - 1)] = number
    return out


def letters(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The letter at every place: a number for its SYMBOL bytes, -1 where the block has fewer left."""
    v = np.zeros(len(data), dtype=np.int64)
    for j in range(SYMBOL // 2):
        v[: len(data) - j] |= data[j:].astype(np.int64) << (8 * j)
    half = dense(v, np.zeros(len(v), dtype=np.int64))
    other = np.zeros_like(half)
    other[: -(SYMBOL // 2)] = half[SYMBOL // 2 :]
    out = np.full(len(data), -1, dtype=np.int64)
    full = left >= SYMBOL
    out[full] = dense(half[full], other[full])
    return out


def sorted_shard(letter: np.ndarray, depth: int) -> np.ndarray:
    """The places of a shard in the order of their first `depth` letters, by doubling; a missing letter is smaller than all and unique."""
    n = len(letter)
    rank = dense(np.where(letter >= 0, letter + n, np.arange(n)), np.zeros(n, dtype=np.int64))
    have, ranks = 1, {1: rank}

    def ahead(r: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, dtype=np.int64)
        out[: max(0, n - by)] = r[by:]
        return out

    while have * 2 <= depth:
        rank = dense(rank, ahead(rank, have * SYMBOL))
        have *= 2
        ranks[have] = rank
    for part in sorted(ranks, reverse=True):
        while have + part <= depth:
            rank = dense(rank, ahead(ranks[part], have * SYMBOL))
            have += part
    return np.argsort(rank, kind="stable")


def shard_transform(letter: np.ndarray, first: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, transform, ends) of a shard: its sorted places, the letter before each of them, and how many are ends of blocks.

    letter: the letter at each place; first: where the place's block begins. The
    transform has -1 for a place without a letter before it. Ends come first in the order.
    """
    order = sorted_shard(letter, depth)
    back = order - SYMBOL
    return order, np.where(back >= first[order], letter[back], -1), int((letter < 0).sum())


def merged_transforms(transforms: list[np.ndarray], ends: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, common): the shard of every merged place, and the letters (up to `depth`) it shares with the place before.

    The transforms are all that is read. Step h turns the order by h - 1 letters
    into that by h: the interleave picks each shard's letters in the shard's own
    order, and dealing it by them, stably, puts the places before where they
    belong. Refinement ends at `depth` letters or when every place is told apart.
    """
    sizes = [len(t) for t in transforms]
    n, n_ends = sum(sizes), sum(ends)
    flat = np.concatenate(transforms) if n else np.zeros(0, dtype=np.int64)
    kind = np.uint16 if n and int(flat.max(initial=0)) < 1 << 16 else np.int64
    shard = np.uint8 if len(sizes) < 256 else np.int64
    # Ends of blocks stand first; from one letter on each is by itself.
    interleave = np.concatenate([np.repeat(np.arange(len(sizes)), ends), np.repeat(np.arange(len(sizes)), np.subtract(sizes, ends))]).astype(shard)
    common = np.full(n, depth, dtype=np.int64)
    common[: n_ends + 1] = 0
    new = common == 0
    read = np.empty(n, dtype=np.int64)
    for h in range(depth):
        group = np.cumsum(new) if h else np.zeros(n, dtype=np.int64)
        read[np.argsort(interleave, kind="stable")] = flat
        has = np.flatnonzero(read >= 0)
        letter = read[has].astype(kind)
        deal = np.argsort(letter, kind="stable")
        at = has[deal]
        letter, group = letter[deal], group[at]
        interleave[n_ends:] = interleave[at]
        edge = np.ones(len(at), dtype=bool)
        edge[1:] = (letter[1:] != letter[:-1]) | (group[1:] != group[:-1])
        edge &= ~new[n_ends:]
        if h and not edge.any():  # nothing was told apart, nor will it be
            break
        common[n_ends:][edge] = h
        new[n_ends:] |= edge
    return interleave, common


def repeated_intervals(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, interval) of all places that share their next `length` bytes with another place of these blocks.

    Blocks are data[ends[i]:ends[i+1]], none shorter than SYMBOL - 1 bytes. Shards of blocks are sorted alone and their transforms merged.
    """
    depth = length // SYMBOL
    # One place more for each block: the empty suffix, from which its last window is reached.
    block = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    padded = np.zeros(len(data) + len(ends) - 1, dtype=np.uint8)
    padded[np.arange(len(data)) + block] = data
    ends = ends + np.arange(len(ends))
    sizes = np.diff(ends)
    block = np.repeat(np.arange(len(sizes)), sizes)
    letter = letters(padded, ends[1:][block] - 1 - np.arange(len(padded)))
    cuts = ends[np.unique(np.linspace(0, len(sizes), min(SHARDS, len(sizes)) + 1).astype(np.int64))]
    shards = [shard_transform(letter[lo:hi], ends[:-1][block[lo:hi]] - lo, depth) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    interleave, common = merged_transforms([t for _, t, _ in shards], [n for _, _, n in shards], depth)
    merged = np.empty(len(interleave), dtype=np.int64)
    merged[np.argsort(interleave, kind="stable")] = np.concatenate([lo + order for lo, (order, _, _) in zip(cuts[:-1], shards, strict=True)])
    inside = common >= depth  # shares all letters with the place before
    shared = inside.copy()
    shared[:-1] |= inside[1:]
    group = np.cumsum(~inside)[shared]
    place = merged[shared]
    return place - block[place], group


def covered_windows(place: list[np.ndarray], data: np.ndarray, ends: np.ndarray, length: int) -> list[np.ndarray]:
    """(doc_id, h, start) of the windows in these blocks that also start earlier in them; place: those of the blocks."""
    at, group = repeated_intervals(data, ends, length)
    own = np.searchsorted(ends, at, side="right") - 1
    found = [place[0][own], place[1][own], place[2][own] + at - ends[own]]
    by = np.lexsort((found[2], found[1], found[0], group))
    found, group = [c[by] for c in found], group[by]
    first = np.maximum.accumulate(np.where(runs_of([group]), np.arange(len(group)), 0))
    later = after(found, [c[first] for c in found])
    return [c[later] for c in found]


def sharing(keys: np.ndarray, data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Marks the blocks that may share a window with another block of their key; every one that does is marked.

    Who shares a window shares one of its probes(), here by a hash of 64 bits.
    A block without its key among its grams (a window of a hot anchor) is marked.
    """
    marked = np.zeros(len(keys), dtype=bool)
    sizes = np.diff(ends)
    if not len(data):
        return marked
    h = np.append(grams(data, len(data) - K + 1), np.zeros(K - 1, dtype=np.uint64)) if len(data) >= K else np.zeros(len(data), dtype=np.uint64)
    hit = np.flatnonzero(h == np.repeat(keys.view(np.uint64), sizes))
    own, first = np.unique(np.searchsorted(ends, hit, side="right") - 1, return_index=True)
    at = np.full(len(keys), -1)
    at[own] = hit[first]
    marked |= at < 0
    for ok, probe in probes(at, ends[:-1], ends[1:], data, length):
        by = np.lexsort((probe, keys[ok]))
        alike = ~runs_of([keys[ok][by], probe[by]])
        alike[:-1] |= alike[1:]
        marked[ok[by[alike]]] = True
    return marked


RUNS = "doc_id long, h long, start long, count int"


def spans_of(place: list[np.ndarray]) -> pa.RecordBatch:
    """Windows (doc_id, h, start) as RUNS."""
    by = np.lexsort(place[::-1])
    docs, hs, starts = (c[by] for c in place)
    new = runs_of([docs, hs])
    new[1:] |= starts[1:] > starts[:-1] + 1
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(docs)) - 1
    arrays = [pa.array(docs[at]), pa.array(hs[at]), pa.array(starts[at]), pa.array((starts[last] - starts[at] + 1).astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in RUNS.split(", ")])


def merged_blocks(texts: DataFrame, length: int) -> DataFrame:
    """RUNS of windows that also start earlier, out of TEXTS sorted by key; a negative start is a window known to be one."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merge(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            keys, *place = (np.concatenate([h[i] for h in held]) for i in range(4))
            data = np.concatenate([h[4] for h in held])
            ends = np.concatenate([[0], np.cumsum(np.concatenate([h[5] for h in held]))])
            whole = len(keys) if final else int(np.flatnonzero(runs_of([keys]))[-1])  # the last key may go on
            held = [(keys[whole:], *(c[whole:] for c in place), data[ends[whole] :], np.diff(ends[whole:]))] if whole < len(keys) else []
            keys, data, ends = keys[:whole], data[: ends[whole]], ends[: whole + 1]
            may = sharing(keys, data, ends, length)
            data = data[np.repeat(may, np.diff(ends))]
            ends = np.concatenate([[0], np.cumsum(np.diff(ends)[may])])
            keys, place = keys[may], [c[:whole][may] for c in place]
            stops = np.append(np.flatnonzero(runs_of([keys]))[1:], len(keys)) if len(keys) else keys
            lo = 0
            while len(stops):
                fit = stops[ends[stops] - ends[lo] <= MERGE]
                hi = int(fit[-1] if len(fit) else stops[0])
                got = covered_windows([c[lo:hi] for c in place], data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo], length)
                if len(got[0]):
                    yield spans_of(got)
                lo, stops = hi, stops[stops > hi]

        for batch in it:
            cols = [np.asarray(batch.column(i)) for i in range(4)]
            known = cols[3] < 0
            if known.any():
                yield spans_of([cols[1][known], cols[2][known], -1 - cols[3][known]])
                batch = batch.filter(pa.array(~known))
                cols = [c[~known] for c in cols]
            if not batch.num_rows:
                continue
            text = batch.column(4)
            offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
            held.append((*cols, data, np.diff(offsets)))
            if sum(len(h[4]) for h in held) > HELD:
                yield from merge(False)
        if held:
            yield from merge(True)

    return texts.mapInArrow(run, RUNS)


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text) of rows with an id and a text; h tells apart the texts of one doc_id."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    return rows.where("doc_id is not null and text is not null")


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """RUNS of windows of `length` bytes that also start earlier: by smaller (doc_id, h), or earlier in the same document."""
    if length % SYMBOL or not K <= length - 9 or length > 250:
        raise ValueError(f"length must be a multiple of {SYMBOL}, from {K + 9} to 250")
    n = shuffle_partitions(docs.sparkSession)
    rows = numbered(docs)
    told = [told_apart(anchor_rows(rows, length, w, WAVES).repartition(n, "anchor").sortWithinPartitions(*NAMES[:-1])) for w in range(WAVES)]
    apart = reduce(DataFrame.union, [written(df, "blocks") for df in told])
    any_hot = apart.where("anchor is not null and hot").limit(1).count() > 0
    # Each document moves once; what is cut out of it goes to the shared folder, and on from there.
    deal, wanted = F.pmod(F.xxhash64("doc_id"), F.lit(DEALS)), apart.where("anchor is not null")
    cut = [block_texts(wanted.where(deal == d), rows.where(deal == d), length) for d in range(DEALS)]
    cut = reduce(DataFrame.union, [written(df, "texts") for df in cut])
    runs = []
    for w in range(WAVES):
        own = cut.where(F.pmod(F.xxhash64("key"), F.lit(WAVES)) == w)
        texts = own.where("not hot")
        if any_hot:
            # Equal windows of a hot anchor meet in shares first, so that the merge gets a few of each.
            share = F.pmod(F.xxhash64("doc_id", "h"), F.lit(SALTS))
            dealt = own.where("hot").withColumn("share", share).repartition(n, "key", "share")
            dealt = dealt.sortWithinPartitions("key", "share", "text", "doc_id", "h", "start").drop("share")
            texts = texts.union(first_windows(dealt))
        runs.append(written(merged_blocks(texts.repartition(n, "key").sortWithinPartitions("key", "doc_id", "h", "start"), length), "runs"))
    dropped(cut)
    return reduce(DataFrame.union, [apart.where("anchor is null").select("doc_id", "h", "start", "count"), *runs])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row of docs.

    Texts are UTF-8 bytes. A byte goes if a string of `length` bytes covers it
    that also starts earlier: in a document with a smaller doc_id or earlier in
    the same one; strings are judged on the input. n_spans counts maximal
    removed runs. Null texts are empty. Rows without doc_id have no place in the
    order: they lose nothing and take nothing. Rows that repeat a doc_id with the
    same text count as one document; with different texts they are documents of
    their own, ordered by a hash of the text. Other columns are not read. An empty table gives no rows.
    """
    runs = repeated_runs(docs, length)
    lists = runs.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "count")).alias("runs")).withColumnsRenamed({"doc_id": "d", "h": "g"})

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            out: list[list] = [[], [], [], [], []]
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = (text or "").encode()
                n_spans, left = 0, [data]
                if own.is_valid and len(own):
                    start, count = (np.asarray(c, dtype=np.int64) for c in own.values.flatten())
                    by = np.argsort(start, kind="stable")
                    start, end = start[by], np.minimum((start + count + length - 1)[by], len(data))
                    far = np.maximum.accumulate(end)
                    new = np.ones(len(start), dtype=bool)
                    new[1:] = start[1:] > far[:-1]
                    lo, hi = start[new], far[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
                    n_spans = len(lo)
                    left = [data[a:b] for a, b in zip(np.append(0, hi).tolist(), np.append(lo, len(data)).tolist(), strict=True)]
                rest = b"".join(left)
                for to, x in zip(out, (len(data), len(data) - len(rest), n_spans, hashlib.sha256(rest).hexdigest(), rest if keep_bytes else None), strict=True):
                    to.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], [f.split()[0] for f in RESULT.split(", ")])

    joined = docs.select(F.col("doc_id").cast("long"), "text").join(lists, (F.col("doc_id") == F.col("d")) & (F.xxhash64("text") == F.col("g")), "left")
    out = joined.select("doc_id", "text", "runs").mapInArrow(run, RESULT)
    return out if keep_bytes else out.drop("kept")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every whole text of `documents` that a 100-byte string covers which also starts earlier; see remove_repeats() for null, empty and repeated rows."""
    return remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)
