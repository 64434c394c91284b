"""Fuzzy line dedup: MinHash over character shingles, exact Jaccard, union-find; one line of each component stays.

Lines are sketched in whole Arrow batches inside numpy: a line's distinct
shingle hashes are sorted together with its number, so buckets are contiguous
and their minima are one reduction. Equal lines are one class; related lines are
confirmed on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import dropped, slices, spread_join, written
from folioflow.llm.nearsets import BASE, LISTS, SEEDS, SKETCHES, STEPS, U, candidates, char_sets, compared, least_bits, mixed, near_components, powers, reached, size_class, sums
from folioflow.session import table

#: Characters of a shingle; chance similarity of unrelated lines of one language is then about 0.0001.
SHINGLE = 10
#: Ten bands of three registers: a pair with similarity 0.8 is missed with probability 0.0008, one with 0.9 with 0.000002.
BANDS, ROWS = 10, 3
REGS = BANDS * ROWS
#: Bands are dealt out in so many waves, so that only a share of their rows is on disk at a time.
WAVES = 2
#: Lines of fewer distinct shingles use a hash function for each register, lines of LOW or more ROWS functions over BANDS buckets.
LOW, HIGH = 64, 80
#: Two bits of each register, and the least estimate of linked lines: five standard deviations under their similarity.
BITS = 2 * REGS
LEAST_BITS = least_bits(REGS, 2, 5)
#: Bytes of text that are sketched together.
CHUNK = 1 << 18
V40 = U((1 << 40) - 1)


def compressed(low: np.ndarray) -> np.ndarray:
    """Leading zeros and ten mantissa bits of 64-bit minima."""
    frac, exp = np.frexp(np.maximum(low, U(1)).astype(np.float64))
    return (np.clip(64 - exp, 0, 63).astype(np.uint64) << U(10)) | ((frac - 0.5) * 2048).astype(np.int64).clip(0, 1023).astype(np.uint64)


#: Register of band j, row f: function f, bucket j + 3 f, so that a band's rows come from different parts of the line.
_BUCKET = (np.arange(BANDS)[:, None] + 3 * np.arange(ROWS)[None, :]) % BANDS


def keyed(regs: np.ndarray, tier: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and sketch bits, with the size class above them, of registers shaped lines x BANDS x ROWS and the sizes of their sets."""
    place = np.arange(BANDS, dtype=np.uint64) + U(BANDS * tier + 1)
    keys = mixed((regs * STEPS[:ROWS]).sum(axis=2, dtype=np.uint64) + place * STEPS[40])
    bits = ((regs & U(3)).reshape(len(regs), REGS) << (U(2) * np.arange(REGS, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
    return keys, bits | size_class(n) << U(BITS)


def sketch_lines(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """n, k1, k2 of every line (raw[ends[i]:ends[i+1]]) and, for each tier, (lines, keys, bits)."""
    size = np.diff(ends)
    down = powers(len(raw) + 1)[1]
    total = sums(raw)
    # k1 and k2 tell lines apart by all their bytes.
    whole = (total[ends[1:]] - total[ends[:-1]]) * down[ends[:-1]]
    k1 = mixed(whole + size.astype(np.uint64) * STEPS[41])
    # Where characters begin: a shingle is the bytes of SHINGLE characters.
    if len(raw) and raw.max() < 0x80:
        stops, chars = ends, size
        every = mixed((total[SHINGLE:] - total[:-SHINGLE]) * down[: max(0, len(raw) - SHINGLE + 1)] + U(SHINGLE * int(STEPS[42]) % 2**64))
    else:
        at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        stops = np.searchsorted(at, ends)
        chars = np.diff(stops)
        # Of places, prefix sums and powers what is at a character and SHINGLE further on are slices of one gathering.
        here, places = total[at], at.view(np.uint64)
        every = here[SHINGLE:] - here[:-SHINGLE]
        every *= down[at[:-SHINGLE]]
        every += (places[SHINGLE:] - places[:-SHINGLE]) * STEPS[42]
        every = mixed(every)
    # No shingle begins at a line's last characters, which are fewer than SHINGLE.
    inside = np.ones(len(raw) if stops is ends else len(at) - 1, dtype=bool)
    for back in range(1, SHINGLE):
        inside[stops[1:][chars >= back] - back] = False
    h = every[inside[: len(every)]]
    # Lines shorter than a shingle are one shingle.
    short = np.flatnonzero((size > 0) & (chars < SHINGLE))
    count = np.maximum(chars - SHINGLE + 1, 0)
    k2 = k1 ^ STEPS[43]
    full = np.flatnonzero(count > 0)
    if len(full):
        k2[full] = np.add.reduceat(h, (np.cumsum(count) - count)[full]) ^ STEPS[43]
    lines = np.arange(len(size), dtype=np.uint64) << U(40)
    key = np.repeat(lines, count)
    key |= h >> U(24)
    if len(short):
        key = np.concatenate([key, lines[short] | (mixed(whole[short]) >> U(24))])
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    n = np.diff(np.searchsorted(key, np.append(lines, U(len(size) << 40))))
    value = key & V40
    tiers = []
    small = (n > 0) & (n < HIGH)
    if small.any():
        own = np.flatnonzero(small)
        v, starts = value[np.repeat(small, n)] + U(BASE), np.concatenate([[0], np.cumsum(n[own])[:-1]])
        low = np.stack([np.minimum.reduceat(v * SEEDS[f], starts) for f in range(REGS)], axis=1)
        tiers.append((own, *keyed(compressed(low).reshape(-1, BANDS, ROWS), 0, n[own])))
    large = n >= LOW
    if large.any():
        own = np.flatnonzero(large)
        v = value[np.repeat(large, n)]
        slot = ((v * U(BANDS)) >> U(40)).astype(np.int32)
        slot += np.repeat(np.arange(len(own), dtype=np.int32) * np.int32(BANDS), n[own])
        starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        low = np.full((ROWS, len(own) * BANDS), np.iinfo(np.uint64).max, dtype=np.uint64)
        v += U(BASE)
        for f in range(ROWS):
            low[f, slot[starts]] = np.minimum.reduceat(v * SEEDS[REGS + f], starts)
        regs = compressed(low).reshape(ROWS, len(own), BANDS)
        picked = np.stack([regs[f][:, _BUCKET[:, f]] for f in range(ROWS)], axis=2)
        tiers.append((own, *keyed(picked, 1, n[own])))
    return n, k1.view(np.int64), k2.view(np.int64), tiers


def sketch_column(n: int, tiers: list[tuple[np.ndarray, np.ndarray, np.ndarray]], wanted: np.ndarray) -> pa.ListArray:
    """The sketches of `wanted` lines as lists of structs; other lines have none."""
    tiers = [(own[wanted[own]], keys[wanted[own]], bits[wanted[own]]) for own, keys, bits in tiers]
    own = np.concatenate([t[0] for t in tiers]) if tiers else np.zeros(0, dtype=np.int64)
    order = np.argsort(own, kind="stable")
    keys = np.concatenate([t[1] for t in tiers])[order] if tiers else np.zeros((0, BANDS), dtype=np.uint64)
    bits = np.concatenate([t[2] for t in tiers])[order] if tiers else np.zeros(0, dtype=np.uint64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1) * BANDS, pa.int32()), pa.array(keys.ravel().view(np.int64)))
    structs = pa.StructArray.from_arrays([lists, pa.array(bits.view(np.int64)), pa.array(np.zeros(len(order), dtype=np.int64))], ["keys", "x", "y"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs).cast(LISTS)


def sketched_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, h, line, n, k1, k2, sketches) of every line of every document, written to the shared folder.

    h tells apart the texts of one doc_id. Of equal lines in a chunk only the first
    has sketches, so a line that many documents share is sketched a few times.
    """

    def chunk(ids: np.ndarray, hs: np.ndarray, seg: np.ndarray, doc_end: np.ndarray) -> pa.RecordBatch:
        size = np.diff(doc_end, prepend=0)
        breaks = np.flatnonzero(seg == 10)
        # A document's end comes before a line break at the start of the next one.
        full = np.flatnonzero(size > 0)
        ends = np.concatenate([doc_end[full], breaks])
        by = np.argsort(ends, kind="stable")
        at_break = by >= len(full)
        doc = np.concatenate([full, np.searchsorted(doc_end, breaks, side="right")])[by]
        ends = ends[by]
        sizes = np.diff(ends, prepend=0)
        sizes[1:] -= at_break[:-1]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        turn = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
        n, k1, k2, tiers = sketch_lines(seg[seg != 10], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
        place = (ids[doc], hs[doc], turn)
        wanted = np.zeros(len(sizes), dtype=bool)
        by = np.lexsort((*place[::-1], k2, k1))
        wanted[by] = np.concatenate([[True], (k1[by][1:] != k1[by][:-1]) | (k2[by][1:] != k2[by][:-1])])
        cols = [*map(pa.array, place), pa.array(n.astype(np.int64)), pa.array(k1), pa.array(k2), sketch_column(len(sizes), tiers, wanted)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "line", "n", "k1", "k2", "sketches"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            ids, hs, text = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2).cast(pa.large_string())
            offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
            lo = 0
            while lo < len(ids):
                hi = min(len(ids), max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK))))
                if offsets[hi] > offsets[lo]:
                    yield chunk(ids[lo:hi], hs[lo:hi], data[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo])
                lo = hi

    return written(numbered(docs).mapInArrow(run, f"doc_id long, h long, line long, n long, k1 long, k2 long, sketches {SKETCHES}"), "lines")


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text) of rows with an id and a text."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text").where("doc_id is not null and text is not null")


MEMBERS = ["id", "comp", "n", "c", "w"]


def line_texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MEMBERS and text of the lines that each document's list names; a document is split once."""
    kinds = (*[pa.int64()] * len(MEMBERS), pa.string())
    for whole in it:
        for at in range(0, whole.num_rows, 256):
            batch, rows = whole.slice(at, 256), [[] for _ in kinds]
            for text, own in zip(batch.column(0), batch.column(1), strict=True):
                lines = text.as_py().split("\n")
                for line, *member in zip(*(x.to_pylist() for x in own.values.flatten()), strict=True):
                    for to, x in zip(rows, (*member, lines[line]), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], [*MEMBERS, "text"])


PLACE = ["doc_id", "h", "line"]


def class_of(salt: int) -> Column:
    """The number of a line's class of equal lines, of k1 and k2."""
    return F.xxhash64("k1", "k2", F.lit(salt))


def line_classes(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """(node, copies, n, place) of each class of equal lines, the salt of class_of() by which node names it, and how many there are.

    place is that of the first line. No two classes have one node: a salt by which two would is passed over.
    """
    for salt in count():
        told = rows.select(class_of(salt).alias("node"), "k1", "k2", F.struct(*PLACE, "n").alias("p"))
        ends = [f(k).alias(f"{f.__name__}_{k}") for k in ("k1", "k2") for f in (F.min, F.max)]
        made = told.groupBy("node").agg(F.min("p").alias("p"), F.count("*").alias("copies"), *ends)
        shared = (F.col("min_k1") < F.col("max_k1")) | (F.col("min_k2") < F.col("max_k2"))
        classes = written(made.select("node", "copies", "p.n", F.struct(*[f"p.{c}" for c in PLACE]).alias("place"), shared.alias("shared")), "classes")
        n, clash = classes.agg(F.count("*"), F.count_if("shared")).first()
        if not clash:
            return classes.drop("shared"), salt, n
        dropped(classes)


def removed_lines(docs: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, h, lines): the numbers of the lines of each document that go; documents that lose nothing have no row.

    h is xxhash64(text) and tells apart the texts of one doc_id. Lines with a
    Jaccard similarity of 0.8 or more over their distinct shingles of SHINGLE
    characters are linked; a line shorter than that is one shingle. Of every
    component the line with the smallest (doc_id, h, line number) stays; equal
    rows of docs are one document. Lines of fewer than `least` shingles, empty ones among them, always stay.
    """
    told = sketched_lines(docs)
    classes, salt, n = line_classes(told.where(F.col("n") >= least))
    node = class_of(salt)
    # Sketches name their class themselves, so they are dealt out without a join before.
    drawn = told.where((F.size("sketches") > 0) & (F.col("n") >= least)).select(node.alias("id"), "sketches")
    found = candidates(drawn, n * BANDS, BITS, LEAST_BITS, WAVES)
    # Sketches leave the disk before the texts move.
    rows = written(told.where(F.col("n") >= least).select(*PLACE, node.alias("node")), "rows")
    dropped(told)
    first = classes.select("node", *[F.col(f"place.{c}") for c in PLACE])

    def with_text(members: DataFrame) -> DataFrame:
        placed = members.join(first, F.col("id") == F.col("node"))
        lists = placed.groupBy("doc_id", "h").agg(F.collect_list(F.struct("line", *MEMBERS)).alias("own"))
        joined = numbered(docs).hint("merge").join(lists, ["doc_id", "h"])
        return joined.select("text", "own").mapInArrow(line_texts, "id long, comp long, n long, c long, w long, text string")

    joined = near_components(found, classes, with_text, partial(char_sets, size=SHINGLE), compared)
    reach = reached(joined, classes, "place")
    fate = classes.join(reach, "node", "left").where("copies > 1 or reached is not null")
    fate = written(fate.select("node", "copies", F.coalesce("reached", "place").alias("stays")), "fate")
    dropped(found, joined, reach, classes)
    gone = spread_join(rows, fate, ["node"]).where(F.struct(*PLACE) != F.col("stays"))
    out = written(gone.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.col("line").cast("int"))).alias("lines")), "gone")
    dropped(rows, fate)
    return out


def dedup_lines(docs: DataFrame, least: int = 1) -> DataFrame:
    """docs, with all columns, without the lines that removed_lines() names; a document that loses every line goes.

    Null and empty texts and rows without doc_id stay as they are. Other texts
    under one doc_id are documents of their own; equal rows lose the same lines.
    n_chars, where there is such a column, follows the new text. Columns may have any names.
    """
    gone = removed_lines(docs, least).toDF("gone_id", "gone_h", "gone_lines")
    at, schema = docs.columns.index("text"), docs.schema
    # Columns go by place, so that none of them can be taken for one of the join's.
    own = docs.toDF(*[f"c{i}" for i in range(len(schema))])
    doc, text = F.col(f"c{docs.columns.index('doc_id')}").cast("long"), F.col(f"c{at}")
    out = own.hint("merge").join(gone, (doc == F.col("gone_id")) & (F.xxhash64(text) == F.col("gone_h")), "left").select(*own.columns, "gone_lines")

    def strip(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            texts = batch.column(at).to_pylist()
            keep = np.ones(len(texts), dtype=bool)
            for i, own in enumerate(batch.column(len(schema)).to_pylist()):
                if own:
                    drop = set(own)
                    left = [x for n, x in enumerate(texts[i].split("\n")) if n not in drop]
                    texts[i], keep[i] = "\n".join(left), bool(left)
            cols = [pa.array(texts, batch.column(at).type) if i == at else batch.column(i) for i in range(len(schema))]
            yield pa.RecordBatch.from_arrays(cols, own_names).filter(pa.array(keep))

    own_names = own.columns
    out = out.mapInArrow(strip, own.schema)
    if "n_chars" in docs.columns:
        n_chars = f"c{docs.columns.index('n_chars')}"
        out = out.withColumn(n_chars, F.length(text).cast(schema["n_chars"].dataType)).select(own_names)
    return out.toDF(*docs.columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and removed_lines (their numbers, from 0) of every document; a null or empty text has no lines.

    The report of what goes; dedup_lines() is the operator that takes the lines away.
    """
    docs = table(spark, sf_dir, "documents")
    gone = removed_lines(docs)
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    n = F.when(F.coalesce(F.octet_length("text"), F.lit(0)) > 0, breaks + 1).otherwise(0)
    out = docs.select("doc_id", F.xxhash64("text").alias("h"), n.alias("n_lines")).join(gone, ["doc_id", "h"], "left")
    none = F.array().cast("array<int>")
    return out.select("doc_id", "n_lines", F.size(F.coalesce("lines", none)).alias("n_removed"), F.coalesce("lines", none).alias("removed_lines"))
