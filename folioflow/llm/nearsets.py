"""Near-duplicate classes of sets by HyperMinHash, as connected components of exact Jaccard links.

A set of 64-bit shingle hashes is sketched in REGISTERS registers. A register
holds what HyperMinHash (Yu and Weber, 2017) keeps of the smallest hash in its
bucket: the count of leading zeros and MANTISSA bits after them. Large sets deal
their hashes to the buckets by one hash; small sets, which would leave buckets
empty, use a hash function for each register.

Bands of ROWS registers deal the sketches into buckets. There the lowest bits of
all registers give a first estimate of the Jaccard similarity, corrected for the
half of the bits that agree by chance; what it relates becomes a candidate
component. Inside a component every pair is estimated from whole registers,
corrected for their collisions, and what that allows is compared in full.
Bands and cuts below are those of the one similarity that links here, NUM / DEN.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import components, dropped, shuffle_partitions, slices, small, spread_join, written

REGISTERS, ROWS, MANTISSA = 128, 4, 10
BANDS = REGISTERS // ROWS
#: The least Jaccard similarity of a link.
NUM, DEN = 80, 100
#: Sets of fewer than SPLIT_HIGH hashes are sketched by a function for each register, sets of SPLIT_LOW or more by one function.
#: Linked sets are always both in one of the two, since SPLIT_LOW / SPLIT_HIGH is no more than NUM / DEN.
SPLIT_LOW, SPLIT_HIGH = 512, 640
#: A register estimate below this, seven standard deviations under NUM / DEN, is taken for certain to be no link.
LEAST_ESTIMATE = NUM / DEN - 7 * math.sqrt(NUM / DEN * (1 - NUM / DEN) / REGISTERS)
#: Rows of a bucket that are compared together; sets and shingles of a candidate component that one task takes together.
BUCKET, CELL, WEIGHT = 20_000, 4_096, 8_000_000
DEALS = 3


def least_bits(registers: int, bits: int, sds: float) -> float:
    """The least bit_estimate() of a pair with similarity NUM / DEN, `sds` standard deviations under it."""
    q = 1 - NUM / DEN
    var = registers * (q * (bits + bits * bits) / 4 - (bits * q / 2) ** 2)
    return 1 - 2 * (registers * bits * q / 2 + sds * math.sqrt(var)) / (registers * bits)


def bit_estimate(differ: np.ndarray, bits: int) -> np.ndarray:
    """The Jaccard estimate of sketches of which `differ` of `bits` bits differ; half the bits of unrelated registers agree by chance."""
    return 1 - 2 * differ / bits


#: Steps of the logarithm of sizes, a little longer than the largest ratio of linked sets, so that neither rounding nor a size that misses a few hashes can part them.
STEP = math.log(DEN / NUM) + 1e-3


def size_class(n: np.ndarray) -> np.ndarray:
    """Four bits of the logarithm of a set's size: those of sets that may link differ by one at most, modulo 16."""
    return np.floor(np.log(np.maximum(n, 1)) / STEP).astype(np.uint64) & np.uint64(15)


#: The sketch of a set in a bucket: one bit of each register.
LEAST_BITS = least_bits(REGISTERS, 1, 6)

U = np.uint64
_rng = np.random.default_rng(7)
LETTERS = _rng.integers(0, 2**64, 256, dtype=np.uint64)
SEEDS = _rng.integers(0, 2**64, REGISTERS, dtype=np.uint64) | U(1)
STEPS = _rng.integers(0, 2**64, 64, dtype=np.uint64) | U(1)
BASE = 0x9E3779B97F4A7C15
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, without repeats; np.unique hashes and is far slower on 64-bit values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def sums(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of which the difference between two places, times the inverse power of the first, hashes what is between."""
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(LETTERS[raw] * powers(len(raw))[0], out=out[1:])
    return out


def word_shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of `size` consecutive words, A-Z lower-cased, words ended by ASCII white space.

    A text of fewer words is one shingle; without words the set is empty.
    """
    raw = np.frombuffer((text or "").encode().lower(), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    edge = np.diff(np.concatenate([[True], SPACES[raw], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    total = sums(raw)
    words = mixed((total[end] - total[start]) * powers(len(raw) + 1)[1][start] + (end - start).astype(np.uint64))
    k = min(size, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out += words[j : j + n] * STEPS[j]
    return distinct(mixed(out))


def char_shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of `size` consecutive characters; a shorter text is one shingle, an empty one none."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    if len(raw) == len(text):  # characters are bytes
        k = min(size, len(raw))
        total = sums(raw)
        return distinct(mixed((total[k:] - total[:-k]) * powers(len(raw) + 1)[1][: len(raw) - k + 1] + U(k * int(STEPS[40]) % 2**64)))
    edge = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    k = min(size, len(edge) - 1)
    lo, hi = edge[:-k], edge[k:]
    total = sums(raw)
    return distinct(mixed((total[hi] - total[lo]) * powers(len(raw) + 1)[1][lo] + (hi - lo).astype(np.uint64) * STEPS[40]))


def registers(hashes: np.ndarray, large: bool) -> np.ndarray:
    """The HyperMinHash registers of a set; an empty bucket is 0xFFFF."""
    if large:
        edges = np.arange(REGISTERS, dtype=np.uint64) << U(57)
        first = np.searchsorted(hashes, edges)
        low = np.append(hashes, U(0))[first] << U(7)
        filled = np.append(first[1:], len(hashes)) > first
    else:
        low = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(hashes), 512):
            part = hashes[at : at + 512, None] * SEEDS[None, :]
            part ^= part >> U(32)
            part *= U(0xD6E8FEB86659FD93)
            np.minimum(low, part.min(axis=0), out=low)
        filled = np.ones(REGISTERS, dtype=bool)
    # frexp's exponent counts the leading zeros; the bits under the leading one are the mantissa.
    frac, exp = np.frexp(np.maximum(low, U(1)).astype(np.float64))
    zeros = np.clip(64 - exp, 0, 63).astype(np.uint16)
    mantissa = ((frac - 0.5) * (2 << MANTISSA)).astype(np.int64).clip(0, (1 << MANTISSA) - 1).astype(np.uint16)
    return np.where(filled, zeros << np.uint16(MANTISSA) | mantissa, np.uint16(0xFFFF)).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of one sketch against many, without what collisions of short registers add."""
    used = (a != 0xFFFF) | (b != 0xFFFF)
    same = ((a == b) & used).sum(axis=-1)
    n = np.maximum(used.sum(axis=-1), 1)
    chance = 2.0**-MANTISSA / 3  # registers of unrelated sets agree in zeros with about 1/3, in mantissas with 2**-MANTISSA
    return np.maximum(0.0, (same / n - chance) / (1 - chance))


SKETCHES = "array<struct<keys: array<long>, x: long, y: long>>"
SIGNED = f"id long, h long, n long, k1 long, k2 long, sketches {SKETCHES}"
LISTS = pa.list_(pa.struct([("keys", pa.list_(pa.int64())), ("x", pa.int64()), ("y", pa.int64())]))


def sketches(hashes: np.ndarray) -> list[dict]:
    """A sketch for each kind of registers that the set's size calls for: the keys of its bands, and the registers' lowest bits."""
    out = []
    for large in (False, True):
        if len(hashes) and (len(hashes) >= SPLIT_LOW if large else len(hashes) < SPLIT_HIGH):
            reg = registers(hashes, large)
            place = np.arange(BANDS, dtype=np.uint64) + U(BANDS * large)
            keys = mixed((reg.reshape(BANDS, ROWS).astype(np.uint64) * STEPS[:ROWS]).sum(axis=1, dtype=np.uint64) + place * STEPS[ROWS])
            x, y = np.packbits(reg & 1).view(np.int64).tolist()
            out.append({"keys": keys.view(np.int64).tolist(), "x": x, "y": y})
    return out


def signed(rows: DataFrame, shingles: Callable[[str | None], np.ndarray]) -> DataFrame:
    """(id, text) to SIGNED, written to the shared folder; h is the text's hash, k1 and k2 are equal for equal sets."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            out: list[list] = [[] for _ in range(4)]
            for text in batch.column(2).to_pylist():
                x = shingles(text)
                one, two = x.sum(dtype=np.uint64), mixed(x ^ U(BASE)).sum(dtype=np.uint64)
                for to, value in zip(out, (len(x), int(one.view(np.int64)), int(two.view(np.int64)), sketches(x)), strict=True):
                    to.append(value)
            cols = [pa.array(x, kind) for x, kind in zip(out, [pa.int64(), pa.int64(), pa.int64(), LISTS], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["id", "h", "n", "k1", "k2", "sketches"])

    return written(rows.select(F.col("id").cast("long"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, SIGNED), "signed")


def groups(it: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of two or more rows with equal first `keys` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in it:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(keys)]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(new), [batch.num_rows]])
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                if sum(b.num_rows for b in held) > 1:
                    yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if sum(b.num_rows for b in held) > 1:
        yield pa.Table.from_batches(held)


def alike(bits: np.ndarray, other: np.ndarray, size: int, least: float) -> np.ndarray:
    """Which sketches may link with `other`, one for all or one for each: by the estimate, and by size_class() in the last four bits of x where `size` leaves these free."""
    differ = bits ^ other
    if size > 60:
        return bit_estimate(np.bitwise_count(differ).sum(axis=1), size) >= least
    differ[:, 0] &= U((1 << 60) - 1)
    apart = ((bits[:, 0] >> U(60)) - (other[..., 0] >> U(60)) + U(1)) & U(15)
    return (apart <= 2) & (bit_estimate(np.bitwise_count(differ).sum(axis=1), size) >= least)


def related(bits: np.ndarray, size: int, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Groups of sketches of `size` bits that alike() connects, as (first row, the other rows)."""
    rest = np.arange(len(bits))
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        first, found = front[0], []
        while front and len(rest):
            at = front.pop()
            near = alike(bits[rest], bits[at], size, least)
            if near.any():
                found.append(rest[near])
                front += rest[near].tolist()
                rest = rest[~near]
        if found:
            yield first, np.concatenate(found)


def run_edges(ids: np.ndarray, bits: np.ndarray, starts: np.ndarray, size: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the related groups of each run of rows; runs begin at `starts`.

    Rows near the first of their run are found for all runs at once; only runs
    with others besides are taken one by one.
    """
    sizes = np.diff(np.append(starts, len(ids)))
    first = np.repeat(starts, sizes)
    near = alike(bits, bits[first], size, least)
    near[starts] = False
    a, b = [ids[first[near]]], [ids[near]]
    far = np.add.reduceat(near, starts, dtype=np.int64) + 1 < sizes
    for lo, own_size in zip(starts[far & (sizes > 2)].tolist(), sizes[far & (sizes > 2)].tolist(), strict=True):
        own = ids[lo : lo + own_size]
        for head, others in related(bits[lo : lo + own_size], size, least):
            a.append(np.full(len(others), own[head]))
            b.append(own[others])
    return np.concatenate(a), np.concatenate(b)


def bucket_edges(it: Iterator[pa.RecordBatch], size: int, least: float) -> Iterator[pa.RecordBatch]:
    """run_edges() of the buckets in batches (key, id, x, y) sorted by key; a bucket over BUCKET rows is one group without estimates."""

    def batch_of(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def edges(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
        sizes = np.diff(np.append(starts, len(cols[0])))
        keep = np.repeat(sizes > 1, sizes)
        ids, bits = cols[1][keep], np.stack([cols[2][keep], cols[3][keep]], axis=1).view(np.uint64)
        own = sizes[sizes > 1]
        if len(ids):
            yield from batch_of(*run_edges(ids, bits, np.cumsum(own) - own, size, least))

    held: list[np.ndarray] = []
    whole: tuple[int, int] | None = None  # key and first id of a bucket that goes on beyond BUCKET rows
    for batch in it:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(4)]
        if whole is not None:
            n = int(np.searchsorted(cols[0], whole[0], side="right"))
            yield from batch_of(np.full(n, whole[1]), cols[1][:n])
            cols = [c[n:] for c in cols]
            if not len(cols[0]):
                continue
            whole = None
        held = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)] if held else cols
        open_at = int(np.searchsorted(held[0], held[0][-1], side="left"))
        if open_at:
            yield from edges([c[:open_at] for c in held])
        held = [c[open_at:] for c in held]
        if len(held[0]) > BUCKET:
            whole = int(held[0][0]), int(held[1][0])
            yield from batch_of(np.full(len(held[0]), whole[1]), held[1])
            held = []
    if held:
        yield from edges(held)


#: Rows of buckets that a task packs together, and those that a part of all buckets holds on average.
PACK, PART = 1_000_000, 1_000_000


def parts_for(rows: int, tasks: int) -> int:
    """Parts into which `rows` rows of buckets are cut for `tasks` tasks: one for each, more only where it would hold over PART rows.

    Every task that packs makes a row for each part, so parts beyond need multiply the rows that move.
    """
    return tasks * max(1, math.ceil(rows / (tasks * PART)))


def packed(it: Iterator[pa.RecordBatch], parts: int, wave: int = 0, waves: int = 1) -> Iterator[pa.RecordBatch]:
    """(part, width, rows) out of (id, sketches): the rows (key, id, x, y) of each part of all keys as bytes; without y where it is 0.

    An id that comes again among the rows that are packed together is passed over. Of each sketch's keys, every one in `waves` goes, from number `wave` on.
    """
    held: list[list[np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        *cols, ids, n = (np.concatenate([h[i] for h in held]) for i in range(6))
        first = np.unique(ids, return_index=True)[1]
        if len(first) < len(ids):
            keep = np.zeros(len(ids), dtype=bool)
            keep[first] = True
            keep = np.repeat(keep, n)
            cols = [c[keep] for c in cols]
        part = (cols[0].view(np.uint64) % U(parts)).astype(np.int32)
        by = np.argsort(part, kind="stable")
        part, width = part[by], 3 + bool(cols[3].any())
        rows = np.stack([c[by] for c in cols[:width]], axis=1)
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        offsets = (np.append(starts, len(part)) * 8 * width).astype(np.int32)
        blobs = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])
        return pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(np.full(len(starts), width, dtype=np.int32)), blobs], ["part", "width", "rows"])

    for batch in it:
        lists = batch.column(1)
        keys, x, y = lists.flatten().flatten()
        if not len(x):
            continue
        own, m = np.asarray(batch.column(0)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        n = keys.value_lengths().to_numpy(zero_copy_only=False)
        key = np.asarray(keys.flatten())
        if waves > 1:
            turn = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
            key, n = key[turn % waves == wave], (n - wave + waves - 1) // waves
        all_n = np.diff(np.append(0, np.cumsum(n))[np.append(0, np.cumsum(m))])
        held.append([key, *(np.repeat(np.asarray(c), n) for c in (np.repeat(own, m), x, y)), own[m > 0], all_n[m > 0]])
        if sum(len(h[0]) for h in held) >= PACK:
            yield flush()
            held = []
    if held:
        yield flush()


def unpacked(it: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """(key, id, x, y), sorted by key, of each part in batches (part, width, rows) sorted by part; a part is in memory at a time."""

    def rows() -> list[np.ndarray]:
        cols = np.concatenate(held)
        return list(cols[np.argsort(cols[:, 0])].T)

    held: list[np.ndarray] = []
    last = None
    for batch in it:
        for part, width, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if held and part != last:
                yield rows()
                held = []
            last, own = part, np.frombuffer(blob.as_buffer(), dtype=np.int64).reshape(-1, width)
            held.append(np.pad(own, ((0, 0), (0, 4 - width))))
    if held:
        yield rows()


def dealt(sketched: DataFrame, rows: int, wave: int = 0, waves: int = 1) -> DataFrame:
    """(part, width, rows) of packed(), each part whole in one partition and sorted by part; rows: about how many keys (id, sketches) has in the wave."""
    n = shuffle_partitions(sketched.sparkSession)
    parts = parts_for(rows, n)
    moved = sketched.select("id", "sketches").mapInArrow(lambda it: packed(it, parts, wave, waves), "part int, width int, rows binary")
    # By number and not by hash, which would leave a third of the tasks without a part and give others several.
    return moved.repartitionById(n, F.col("part") % n).sortWithinPartitions("part")


def candidates(sketched: DataFrame, rows: int, size: int, least: float, waves: int = 1) -> DataFrame:
    """Edges (a, b), some repeated, that span the groups of related sketches of each bucket; sketched: (id, sketches), each of `size` bits.

    Keys, about `rows` in all, are dealt into parts, whose rows move as bytes, 24
    or 32 for each. A task holds one part and up to BUCKET rows of a bucket
    besides. A bucket that goes beyond them, a hot group of near copies, is a
    candidate component as it is: more is compared in full then, and nothing is
    left out. Bands meet only in themselves, so they can be dealt in `waves`, one
    after the other, each of which has its share of the rows on disk; the edges of
    more than one are written to the shared folder.
    """

    def edges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in unpacked(it):
            part = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "id", "x", "y"])
            yield from bucket_edges((part.slice(at, 10_000) for at in range(0, part.num_rows, 10_000)), size, least)

    out = [dealt(sketched, rows // waves, w, waves).mapInArrow(edges, "a long, b long").where("a <> b") for w in range(waves)]
    return out[0] if waves == 1 else reduce(DataFrame.union, [written(df, "candidates") for df in out])


def confirmed(sets: list[np.ndarray], left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links DEN * |A and B| >= NUM * |A or B| that span the components of these sets; an estimate goes before every full comparison.

    With `left`, only pairs in which at least one set is marked are compared.
    """
    g = len(sets)
    sizes = np.array([len(s) for s in sets])
    few, many = np.flatnonzero(sizes < SPLIT_HIGH), np.flatnonzero(sizes >= SPLIT_LOW)
    regs = {large: np.full((g, REGISTERS), 0xFFFF, dtype=np.uint16) for large in (False, True)}
    for large, own in ((False, few), (True, many)):
        for i in own.tolist():
            regs[large][i] = registers(sets[i], large)
    part = np.arange(g)
    found: list[tuple[int, int]] = []
    for i in range(g - 1):
        fit = (part[i + 1 :] != part[i]) & (DEN * np.minimum(sizes[i], sizes[i + 1 :]) >= NUM * np.maximum(sizes[i], sizes[i + 1 :]))
        if left is not None:
            fit &= left[i] | left[i + 1 :]
        js = np.arange(i + 1, g)[fit]
        if not len(js):
            continue
        # Sets whose sizes allow a link are both of the few or both of the many.
        est = np.where((sizes[js] < SPLIT_HIGH) & (sizes[i] < SPLIT_HIGH), estimate(regs[False][i], regs[False][js]), estimate(regs[True][i], regs[True][js]))
        order = np.argsort(-est, kind="stable")
        for at in order[est[order] >= LEAST_ESTIMATE].tolist():
            j = int(js[at])
            if part[j] == part[i]:
                continue
            both = common_size(sets[i], sets[j])
            if DEN * both >= NUM * (sizes[i] + sizes[j] - both):
                part[part == part[j]] = part[i]
                found.append((i, j))
    return found


def common_size(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes two sorted sets share."""
    both = np.concatenate([a, b])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


#: Sets that are compared pair by pair rather than by the sets that hold each hash.
FEW = 4


def pairs_compared(sets: list[np.ndarray], sizes: np.ndarray, left: np.ndarray | None) -> list[tuple[int, int]]:
    """compared() of a few sets."""
    part, found = list(range(len(sets))), []
    for i in range(len(sets)):
        for j in range(i):
            if part[i] != part[j] and (left is None or left[i] or left[j]):
                both = common_size(sets[i], sets[j])
                if DEN * both >= NUM * (sizes[i] + sizes[j] - both):
                    part = [part[j] if x == part[i] else x for x in part]
                    found.append((i, j))
    return found


def compared(sets: list[np.ndarray], left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """What confirmed() gives, without estimates: a set is counted against all that are not reached yet, by the sets that hold each of its hashes.

    A set is taken once, so a dense group of near copies costs few passes, and
    sets that share little cost little.
    """
    g = len(sets)
    sizes = np.array([len(s) for s in sets])
    if g == 2:
        both = common_size(*sets)
        return [(0, 1)] * bool(DEN * both >= NUM * (sizes.sum() - both) and (left is None or left.any()))
    if g <= FEW:
        return pairs_compared(sets, sizes, left)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    new = np.append(True, values[order][1:] != values[order][:-1])
    code = np.empty(len(values), dtype=np.int64)
    code[order] = np.cumsum(new) - 1
    # Hashes of one set alone are in no intersection.
    shared = np.bincount(code) > 1
    starts = np.cumsum(sizes) - sizes
    own = [c[shared[c]] for c in (code[lo : lo + n] for lo, n in zip(starts.tolist(), sizes.tolist(), strict=True))]
    # The owners of each hash lie together, in its order; those that are reached are taken out when they are half.
    owner, code = np.repeat(np.arange(g, dtype=np.int32), sizes)[order], code[order]
    owner, code = owner[shared[code]], code[shared[code]]
    at_code = np.searchsorted(code, np.arange(len(shared) + 1))
    alive = np.ones(g, dtype=bool)
    gone, held = 0, np.array([len(x) for x in own])
    found: list[tuple[int, int]] = []
    for first in range(g):
        front = [first] * bool(alive[first])
        gone += int(held[first]) * bool(alive[first])
        alive[first] = False
        while front:
            at = front.pop()
            if 2 * gone > len(owner):
                keep = alive[owner]
                owner, code, gone = owner[keep], code[keep], 0
                at_code = np.searchsorted(code, np.arange(len(shared) + 1))
            lo, n = at_code[own[at]], at_code[own[at] + 1] - at_code[own[at]]
            total = int(n.sum())
            if not total:
                continue
            place = np.arange(total) + np.repeat(lo - (np.cumsum(n) - n), n)
            both = np.bincount(owner[place], minlength=g)
            near = alive & (DEN * both >= NUM * (sizes[at] + sizes - both))
            if left is not None and not left[at]:
                near &= left
            js = np.flatnonzero(near).tolist()
            if js:
                found += [(at, j) for j in js]
                front += js
                alive[js] = False
                gone += int(held[js].sum())
    return found


#: What gives the sorted distinct hashes of each text of a column, one after the other, and how many each has.
Sets = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
#: Bytes of text of which sets are made together.
TEXTS = 1 << 18


def one_by_one(shingles: Callable[[str | None], np.ndarray]) -> Sets:
    """Sets out of a function of one text."""

    def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [shingles(x) for x in texts.to_pylist()]
        return np.concatenate([np.zeros(0, dtype=np.uint64), *found]), np.array([len(x) for x in found])

    return sets


def char_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """char_shingles() of every text of a column."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where characters begin
    stops = np.searchsorted(at, ends - ends[0])
    chars = np.diff(stops)
    k = np.minimum(chars, size)
    count = np.where(chars > 0, chars - k + 1, 0)
    starts = np.cumsum(count) - count
    first = np.arange(int(count.sum())) + np.repeat(stops[:-1] - starts, count)
    lo, hi = at[first], at[first + np.repeat(k, count)]
    total = sums(raw)
    h = mixed((total[hi] - total[lo]) * powers(len(raw) + 1)[1][lo] + (hi - lo).astype(np.uint64) * STEPS[40])
    for a, b in zip(starts.tolist(), (starts + count).tolist(), strict=True):
        h[a:b].sort()
    keep = np.append(True, h[1:] != h[:-1])[: len(h)]
    keep[starts[count > 0]] = True
    return h[keep], np.diff(np.append(0, np.cumsum(keep))[np.append(starts, len(h))])


def links(cells: DataFrame, sets: Sets, judge: Callable[[list[np.ndarray], np.ndarray | None], list[tuple[int, int]]]) -> DataFrame:
    """The links (a, b) that judge, confirmed() or compared(), finds inside each cell; cells: (cell, part, id, text, mark)."""

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ends = np.cumsum(pc.binary_length(batch.column(3)).fill_null(0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TEXTS, side="right")))
                values, n = sets(batch.column(3).slice(lo, hi - lo))
                own = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int64()), pa.array(values))
                cut = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(cut.column(i) for i in (0, 1, 2, 4)), own], ["cell", "part", "id", "mark", "set"])
                lo = hi

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(hashed(it), 2):
            ids, marks = np.asarray(t["id"]), np.asarray(t["mark"])
            cut = [(x.values.to_numpy(), x.offsets.to_pylist()) for x in t["set"].chunks]
            own = [values[a:b] for values, ends in cut for a, b in pairwise(ends)]
            got = judge(own, None if marks.all() else marks)
            if got:
                at = np.array(got)
                yield pa.RecordBatch.from_pydict({"a": pa.array(ids[at[:, 0]], pa.int64()), "b": pa.array(ids[at[:, 1]], pa.int64())})

    n = shuffle_partitions(cells.sparkSession)
    dealt = cells.select("cell", "part", "id", "text", "mark").repartition(n, "cell", "part").sortWithinPartitions("cell", "part")
    return dealt.mapInArrow(run, "a long, b long")


def windowed(members: DataFrame) -> DataFrame:
    """Rows with a column comp, twice: for the two windows of sizes of its candidate component that each belongs to, of which comp becomes the number.

    A window holds two steps of sizes, so sets of one step or of two neighbours, all that may link, are in one window together.
    """
    step = F.floor(F.log(F.greatest("n", F.lit(1))) / STEP)
    return members.withColumn("window", F.explode(F.array(step - 1, step))).withColumn("comp", F.xxhash64("comp", "window")).drop("window")


def near_components(
    edges: DataFrame,
    classes: DataFrame,
    texts: Callable[[DataFrame], DataFrame],
    sets: Sets,
    judge: Callable[[list[np.ndarray], np.ndarray | None], list[tuple[int, int]]] = confirmed,
) -> DataFrame:
    """(node, component) of the nodes that have a confirmed link, out of candidate edges (a, b).

    classes: (node, n) with the size of each node's set; texts adds the column
    text to a table with a column id, which names a node; sets makes the sets of texts and judge finds the links among them.

    Candidate components of up to CELL sets and WEIGHT shingles are confirmed in
    one task. Larger ones are cut into windows of sizes, in which every two sets
    that may link meet, and a window that fits is confirmed in one task. Larger
    windows are dealt into cells DEALS times by other hashes, which joins what is
    dense; what is then outside the largest part of its window is compared with
    all of it, in blocks.
    """
    found = components(edges)
    # The smallest member is a node of its own component.
    cand = found.union(found.select("component", "component").distinct()).toDF("node", "comp")
    cand = written(cand.join(classes.select("node", "n"), "node").select(F.col("node").alias("id"), "comp", "n"), "cand")
    sizes = cand.groupBy("comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    members = written(cand.join(sizes, "comp").select("id", "comp", "n", "c", "w"), "members")
    dropped(found, cand)
    with_text = texts(members)
    is_big = (F.col("c") > CELL) | (F.col("w") > WEIGHT)
    spent, any_big = [members], members.where(is_big).limit(1).count() > 0
    if any_big:  # both kinds are read then, but the corpus moves once
        with_text = written(with_text, "texts")
        spent.append(with_text)
    whole = lambda rows: rows.where(~is_big).select(F.col("comp").alias("cell"), F.lit(0).alias("part"), "id", "text", F.lit(True).alias("mark"))
    plain, texts_big = whole(with_text), None
    if any_big:
        counts = windowed(members.where(is_big).select("id", "comp", "n")).groupBy("comp").agg(F.count("*").alias("c"), F.sum("n").alias("w")).where("c > 1")
        counts = written(counts, "windows")
        spent.append(counts)
        rows, any_big = counts.agg(F.count("*"), F.count_if(is_big)).first()
        texts_big = windowed(with_text.where(is_big).select("id", "comp", "n", "text")).join(small(counts, rows), "comp")
        plain = plain.union(whole(texts_big))
    edges = written(links(plain, sets, judge), "links")
    if any_big:
        parts = lambda c, w: F.ceil(F.greatest(c * 2 / CELL, w * 2 / WEIGHT)).cast("int")
        texts_big = texts_big.where(is_big).select("id", "comp", "n", "c", "w", "text")
        spent.append(edges)
        for deal in range(DEALS):
            cells = texts_big.select(F.col("comp").alias("cell"), F.pmod(F.xxhash64("id", F.lit(deal)), parts(F.col("c"), F.col("w"))).cast("int").alias("part"), "id", "text", F.lit(True).alias("mark"))
            spent.append(written(links(cells, sets, judge), "links"))
            edges = edges.union(spent[-1])
        so_far = components(edges)
        placed = texts_big.select("id", "comp", "n", "c", "w").join(so_far.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        placed = written(placed, "placed")
        counted = placed.groupBy("comp", "component").agg(F.count("*").alias("m"), F.sum("n").alias("mw"))
        largest = counted.groupBy("comp").agg(F.max(F.struct("m", "component", "mw")).alias("z")).select("comp", F.col("z.component").alias("main"), F.col("z.m").alias("m"), F.col("z.mw").alias("mw"))
        # Blocks of the outsiders (k) by blocks of everything (part): outsiders go to every part of their block, all rows to every block.
        placed = placed.join(largest.where("m > 0"), "comp").where("m < c")
        placed = placed.select("id", "comp", (F.col("component") != F.col("main")).alias("mark"), parts(F.col("c"), F.col("w")).alias("p_all"), parts(F.col("c") - F.col("m"), F.col("w") - F.col("mw")).alias("k"))
        every = texts_big.select("id", "comp", "text").join(placed, ["id", "comp"]).withColumn("p", F.pmod(F.xxhash64("id", F.lit(98)), F.col("p_all")).cast("int"))
        cell = (F.col("b") * F.col("p_all") + F.col("p")).cast("int").alias("part")
        own = F.pmod(F.xxhash64("id", F.lit(99)), F.col("k")).cast("int")
        base = every.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).where(~F.col("mark") | (own != F.col("b")))
        out = every.where("mark").withColumn("b", own).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("p_all") - 1)))
        both = base.select("comp", cell, "id", "text", F.lit(False).alias("mark")).union(out.select("comp", cell, "id", "text", F.lit(True).alias("mark")))
        spent.append(written(links(both.withColumnRenamed("comp", "cell"), sets, judge), "links"))
        edges = edges.union(spent[-1])
        spent.append(so_far)
    else:
        spent.append(edges)
    out = components(edges)
    dropped(*spent)
    return out


def reached(joined: DataFrame, classes: DataFrame, least: str) -> DataFrame:
    """(node, reached) of every node in a component of two or more: the smallest value of the column `least` of classes there."""
    every = joined.union(joined.select("component", "component").distinct()).toDF("node", "component")
    every = written(every.join(classes.select("node", least), "node").select("node", "component", least), "every")
    low = every.groupBy("component").agg(F.min(least).alias("reached"))
    out = written(every.join(low, "component").select("node", "reached"), "reached")
    dropped(every)
    return out


def near_classes(rows: DataFrame, shingles: Callable[[str | None], np.ndarray]) -> DataFrame:
    """(id, h, n, component) for every row of (id, text): its text's hash, the size of its set and the smallest id that links reach.

    Equal sets are one class before anything is compared, so copies cost one
    row; a class is a node with a number of its own. Empty sets link with nothing.
    Where one id has several texts each row follows its own text; a null id
    never names a component but follows one.
    """
    told = signed(rows, shingles)
    named = told.where("n > 0").select("k1", "k2", "id", F.struct("id", "h", "n", "sketches").alias("s"))
    made = named.groupBy("k1", "k2").agg(F.min("s").alias("s"), F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = written(made.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "least", "copies", "s.*"), "classes")
    source = rows.select(F.col("id").cast("long").alias("o"), F.xxhash64("text").alias("g"), "text")
    edges = written(candidates(classes.select(F.col("node").alias("id"), "sketches"), classes.count() * BANDS, REGISTERS, LEAST_BITS), "candidates")

    def with_text(members: DataFrame) -> DataFrame:
        place = classes.select("node", F.col("id").alias("at"), "h")
        named = members.join(place, F.col("id") == F.col("node"))
        return source.hint("merge").join(named, F.col("o").eqNullSafe(F.col("at")) & (F.col("g") == F.col("h"))).select(*members.columns, "text")

    joined = near_components(edges, classes, with_text, one_by_one(shingles))
    reach = reached(joined, classes, "least")
    fate = classes.select("node", "k1", "k2", "least", "copies").join(reach, "node", "left").where("copies > 1 or reached is not null or least is null")
    fate = written(fate.select("k1", "k2", "copies", F.coalesce("reached", "least").alias("component")), "fate")
    dropped(edges, joined, reach, classes)
    some = spread_join(told.where("n > 0").select("id", "h", "n", "k1", "k2"), fate, ["k1", "k2"]).select("id", "h", "n", F.coalesce("component", "id").alias("component"))
    out = written(some.union(told.where("n = 0").select("id", "h", "n", F.col("id").alias("component"))), "near")
    dropped(told, fate)
    return out
