"""Repair of conversations to the form `(s?(ua)+)?` at the least cost, by cost layers of grammar states.

Before every turn a word holds, layer by layer, the grammar states from which the
rest of the conversation can be brought to an accepted end at a cost of no more
than the layer's: four bits for each cost, counted from the first layer that is
not empty. Reading the turns from the last to the first, a layer comes from older
ones by shifts: deleting takes the layer three costs below, keeping the one at
the same cost, a new role the one two below, an inserted turn the same word's
layer two below. From every state any other can be had by a few edits, so the
states' costs lie within LAYERS of each other and the word holds all of them. The
first layer of the first word that holds the start state is the cost; following
set bits from there, the least letter first, gives the least audit.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.llm.common import dropped, written
from folioflow.session import table

START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a turn with a role initial leads from each state; other initials lead nowhere.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ACCEPTED = 1 << START | 1 << ASSISTANT
#: Costs of the edits, by letter; a truncated turn that stays adds one.
DELETE, INSERT, ROLE, CUT = 3, 2, 2, 1
#: The states' costs to an accepted end differ by seven at most: an assistant's turn can be led back (delete a system turn: 3),
#: a start led on (insert two: 4).
LAYERS = 8
SPACE = " \t\n\x0b\f\r"


def before(letters: str) -> list[int]:
    """For each set of states, those that one turn with one of the letters leads into it."""
    return [sum({1 << q for x in letters for q, to in STEPS.get(x, {}).items() if states >> to & 1}) for states in range(16)]


INTO = {x: before(x) for x in ("s", "u", "a", "")}
INTO_FREE = before("ua")


class Layers:
    """The cost layers of one conversation, told its turns from the last to the first.

    A turn is a code: 0 to 3 for the initials s, u, a and others, plus 4 if it is
    truncated; DOOMED for one that must go. Words are few and known by number,
    with the codes that lead from one to the next, so a turn costs a lookup.
    """

    DOOMED = 8
    words: list[tuple[int, ...]] = []
    numbers: dict[tuple[int, ...], int] = {}
    moves: dict[tuple[int, int], tuple[int, int]] = {}

    @classmethod
    def number(cls, layers: list[int]) -> tuple[int, int]:
        """(number of the word, costs that its first layer lies above the first of `layers`), after all insertions."""
        for c in range(INSERT, len(layers)):
            layers[c] |= INTO_FREE[layers[c - INSERT]]
        for c in range(1, len(layers)):
            layers[c] |= layers[c - 1]
        rise = next(c for c, states in enumerate(layers) if states)
        word = tuple(layers[rise : rise + LAYERS])
        if word not in cls.numbers:
            cls.numbers[word] = len(cls.words)
            cls.words.append(word)
        return cls.numbers[word], rise

    @classmethod
    def step(cls, number: int, code: int) -> tuple[int, int]:
        if (number, code) not in cls.moves:
            old, layers = cls.words[number], []
            at = lambda c: 0 if c < 0 else old[min(c, LAYERS - 1)]
            for c in range(LAYERS + DELETE):
                states = at(c - DELETE)
                if code != cls.DOOMED:
                    extra = CUT if code & 4 else 0
                    states |= INTO["sua"[code & 3] if code & 3 < 3 else ""][at(c - extra)] | INTO_FREE[at(c - ROLE - extra)]
                layers.append(states)
            cls.moves[number, code] = cls.number(layers)
        return cls.moves[number, code]

    def __init__(self, codes: bytes) -> None:
        """codes: of all turns in their order. Holds three bytes for each turn."""
        number, _ = self.number([ACCEPTED] + [0] * (LAYERS + DELETE))
        self.codes, self.at, self.rises = codes, array("H", bytes(2 * len(codes) + 2)), bytearray(len(codes))
        self.at[len(codes)] = number
        for i in range(len(codes) - 1, -1, -1):
            number, self.rises[i] = self.step(number, codes[i])
            self.at[i] = number
        self.cost = sum(self.rises) + next(c for c, states in enumerate(self.words[number]) if states >> START & 1)

    def audit(self) -> str:
        """The least of the cheapest edits' letters: D, I, K and R for delete, insert, keep and a new role."""
        out, state, i, base = bytearray(), START, 0, sum(self.rises)
        left, n = self.cost, len(self.codes)

        def holds(word: int, base: int, state: int, cost: int) -> bool:
            return cost >= base and bool(self.words[word][min(cost - base, LAYERS - 1)] >> state & 1)

        while i < n or left:
            free = next(to for x in "ua" for q, to in STEPS[x].items() if q == state)
            after = base - self.rises[i] if i < n else 0
            if i < n and holds(self.at[i + 1], after, state, left - DELETE):
                letter, to, paid = b"D", state, DELETE
            elif holds(self.at[i], base, free, left - INSERT):
                letter, to, paid = b"I", free, INSERT
            else:
                code = self.codes[i]
                extra = CUT if code & 4 else 0
                kept = STEPS["sua"[code & 3]].get(state) if code & 3 < 3 else None
                if kept is not None and holds(self.at[i + 1], after, kept, left - extra):
                    letter, to, paid = b"K", kept, extra
                else:
                    letter, to, paid = b"R", free, ROLE + extra
            out += letter
            state, left = to, left - paid
            if letter != b"I":
                i, base = i + 1, after
        return out.decode()


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): the turns after damage by crc32(`conv_id:turn`) % 20, nulls read as one space.

    0 drops a turn (it stays here with gone = true, so that its conversation is known), 1 empties its text,
    2 takes out `.!?`, 3 repeats it, 4 makes it the user's.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    rows = rows.withColumns({"role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "text": text, "gone": F.col("kind") == 0})
    return rows.withColumn("_", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0))))).drop("_", "kind")


TURN = ["conv_id", "turn", "role", "digest"]


def digested(turns: DataFrame) -> DataFrame:
    return turns.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def faulty(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, gone, code, blank, duplicate, truncated): the first fault of each turn, without texts.

    Turns stand by turn (nulls first), then role, then digest of the text, so ties have an order. A duplicate is told by
    role and SHA-256 of the text; one row each of a conversation's equal turns is read at a time, none is held.
    """
    told = F.rtrim(F.col("text"), F.lit(SPACE))
    blank, cut = F.length(told) == 0, ~F.right(told, F.lit(1)).isin(".", "!", "?")
    first = F.left("role", F.lit(1))
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    rows = digested(turns).select(*TURN, F.coalesce("gone", F.lit(False)).alias("gone"), blank.alias("blank"), cut.alias("cut"), initial.alias("initial"))
    # Dealt by conversation once: the window and the order of the turns both build on that.
    rows = rows.repartition("conv_id")
    again = F.row_number().over(W.partitionBy("conv_id", "role", "digest", "gone").orderBy(F.asc_nulls_first("turn"))) > 1
    duplicate, truncated = ~F.col("blank") & again, ~F.col("blank") & ~F.col("again") & F.col("cut")
    rows = rows.withColumn("again", again).withColumns({"duplicate": ~F.col("blank") & F.col("again"), "truncated": truncated})
    code = F.when(F.col("blank") | F.col("duplicate"), Layers.DOOMED).otherwise(F.col("initial") + F.when(F.col("truncated"), 4).otherwise(0))
    return rows.select(*TURN, "gone", code.cast("tinyint").alias("code"), "initial", "blank", "duplicate", "truncated")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
PLAN = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string"
#: Pairs of initials (by code) that may stand next to each other: su, ua, au.
LEGAL = {(0, 1), (1, 2), (2, 1)}


def plans(turns: DataFrame) -> DataFrame:
    """The counts of each conversation's faults, the cost of its cheapest repair and that repair's audit.

    turns: (conv_id long, turn long, role, text, gone), as damaged() gives them. Returns a row for each conv_id,
    null as one of them; conversations whose turns are all gone have zeros and an empty audit. gaps beyond a long
    is null. Empty texts are blank; very long ones are read by Spark alone. Only a code of one
    byte for each turn of a conversation is held, as the audit itself is one letter for each.
    Further columns are not read. An empty table gives an empty one.
    """
    rows = faulty(turns).sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, done = None, []
        for batch in it:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "gone", "code", "initial", "blank", "duplicate", "truncated")]
            for conv, turn, gone, code, initial, *faults in zip(*columns, strict=True):
                if open_ is None or open_.conv != conv:
                    if open_ is not None:
                        done.append(open_.row())
                    open_ = Conversation(conv)
                if not gone:
                    open_.add(turn, code, initial, faults)
            yield packed(done)
            done = []
        if open_ is not None:
            yield packed([open_.row()])

    return rows.mapInArrow(run, PLAN)


class Conversation:
    """What plans() holds of the conversation that it is reading."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.codes, self.last = conv, bytearray(), None
        self.low = self.high = self.turn = None
        self.distinct = self.illegal = 0
        self.faults = [0, 0, 0]

    def add(self, turn: int | None, code: int, initial: int, faults: list[bool]) -> None:
        self.codes.append(code)
        self.illegal += self.last is not None and (self.last, initial) not in LEGAL
        self.last = initial
        self.faults = [n + bool(x) for n, x in zip(self.faults, faults, strict=True)]
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high, self.turn, self.distinct = turn, turn, self.distinct + 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        layers = Layers(bytes(self.codes))
        return (self.conv, gaps if gaps < 2**63 else None, *self.faults, self.illegal, layers.cost, layers.audit())


def packed(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", *COUNTS, "audit"]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "audit" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)


PLANNED = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ",audit:string>"
REPAIRED = f"conv_id long, place long, edit string, role string, text string, plan {PLANNED}"


def repaired(turns: DataFrame, told: DataFrame) -> DataFrame:
    """The repaired conversations as rows, in order within a partition: (conv_id, place, edit, role, text, plan).

    told: plans() of these turns. Each conversation begins with a row of place 0 that has its plan and no text; the turns
    follow with places from 1: kept ones (K), those with a new role (R) and inserted ones with empty text (I).
    Turns stream past their conversation's audit, one batch at a time; no text is held.
    """
    plan = F.struct(*COUNTS, "audit")
    rows = digested(turns).where(~F.coalesce("gone", F.lit(False))).select(*TURN, "text", F.lit(None).cast(PLANNED).alias("plan"))
    heads = told.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("text"), plan.alias("plan"))
    both = heads.unionByName(rows).repartition("conv_id")
    both = both.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.col("plan").isNull(), F.asc_nulls_first("turn"), "role", "digest")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                out = []
                part = batch.slice(at, 256)
                for conv, plan, role, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "plan", "role", "text")), strict=True):
                    if plan is not None:
                        walk = Walk(conv, plan["audit"])
                        out.append((conv, 0, None, None, None, plan))
                        out += walk.inserted()
                    else:
                        out += walk.edited(role, text)
                        out += walk.inserted()
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "place", "edit", "role", "text", "plan"), r, strict=True)) for r in out], schema=kinds)

    counts = [pa.field(c, pa.int64()) for c in COUNTS] + [pa.field("audit", pa.string())]
    kinds = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("plan", pa.struct(counts))])
    return both.mapInArrow(run, REPAIRED)


class Walk:
    """An audit put into effect, turn by turn."""

    def __init__(self, conv: int | None, audit: str) -> None:
        self.conv, self.audit, self.at, self.place = conv, audit, 0, 0
        # The form is (s?(ua)+)?: an odd number of turns begins with the system's.
        self.odd = sum(x != "D" for x in audit) % 2

    def role(self) -> str:
        """The role that an inserted turn or one with a new role has at the next place."""
        return "user" if (self.place + self.odd) % 2 == 0 else "assistant"

    def row(self, edit: str, role: str, text: str) -> tuple:
        self.place += 1
        return (self.conv, self.place, edit, role, text, None)

    def inserted(self) -> list[tuple]:
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            out.append(self.row("I", self.role(), ""))
            self.at += 1
        return out

    def edited(self, role: str, text: str) -> list[tuple]:
        edit = self.audit[self.at]
        self.at += 1
        return [] if edit == "D" else [self.row(edit, self.role() if edit == "R" else role, text)]


def digests(rows: DataFrame) -> DataFrame:
    """A row for each conversation of repaired(): its plan and the SHA-256 of its `role:text` turns joined by newlines.

    Works within the partitions of repaired(), whose order it needs; a conversation streams through one hash, as SHA-256 asks.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, plan, hashed, done = None, None, None, []
        for batch in it:
            for conv, place, role, text, told in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text", "plan")), strict=True):
                if place == 0:
                    if plan is not None:
                        done.append((head, *plan.values(), hashed.hexdigest()))
                    head, plan, hashed = conv, told, hashlib.sha256()
                else:
                    hashed.update((("\n" if place > 1 else "") + role + ":" + text).encode("utf-8", "replace"))
            yield out(done)
            done = []
        if plan is not None:
            yield out([(head, *plan.values(), hashed.hexdigest())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < len(COUNTS) + 1 else pa.string()) for i, c in enumerate(columns)], names)

    return rows.mapInArrow(run, PLAN + ", repaired_sha256 string")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages `conversations` and repairs them; a row for each conv_id, null as one of them. See plans() for odd input."""
    turns = damaged(table(spark, sf_dir, "conversations"))
    told = written(plans(turns), "plans")
    out = written(digests(repaired(turns, told)), "repaired")
    dropped(told)
    return out


def _paid(v: str, cost: int | str, letter: str, row: str = "''") -> str:
    return f"CASE WHEN {v} IS NOT NULL THEN [lpad(CAST(CAST(left({v}[1], 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || substr({v}[1], 9) || '{letter}', {v}[2] || {row}] END"


def _inserted(inner: str) -> str:
    """One more insertion where that is cheaper; states are v0 to v3, each the least [cost and audit, repaired text]."""
    user = ", ".join(_paid(v, INSERT, "I", "chr(10) || 'user:'") for v in ("v0", "v1", "v3"))
    return f"SELECT * REPLACE (least(v2, {user}) AS v2, least(v3, {_paid('v2', INSERT, 'I', "chr(10) || 'assistant:'")}) AS v3) FROM ({inner})"


def _turn() -> str:
    """The states after one more turn (columns k = initial, role, text, cut, doomed)."""
    kept, user, reply = "chr(10) || role || ':' || text", "chr(10) || 'user:' || text", "chr(10) || 'assistant:' || text"
    keep = lambda v, k: f"CASE WHEN NOT doomed AND k = '{k}' THEN {_paid(v, 'cut', 'K', kept)} END"
    role = lambda v, row: f"CASE WHEN NOT doomed THEN {_paid(v, f'{ROLE} + cut', 'R', row)} END"
    gone = [_paid(f"v{q}", DELETE, "D") for q in range(4)]
    into = [
        gone[0],
        f"least({gone[1]}, {keep('v0', 's')})",
        "least(" + ", ".join([gone[2], *(keep(v, "u") for v in ("v0", "v1", "v3")), *(role(v, user) for v in ("v0", "v1", "v3"))]) + ")",
        f"least({gone[3]}, {keep('v2', 'a')}, {role('v2', reply)})",
    ]
    return f"SELECT w.conv_id AS conv_id, w.i + 1 AS i, {', '.join(f'{x} AS v{q}' for q, x in enumerate(into))} FROM walk w JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1"


ORACLE = f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS name FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(name, lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, n: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS kind FROM raw),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, range(2) n(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM hurt),
faults AS (
  SELECT *, left(role, 1) AS k, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') AS open,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
told AS (SELECT *, blank OR again AS doomed, CASE WHEN NOT blank AND NOT again AND open THEN 1 ELSE 0 END AS cut FROM faults),
every AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (
  SELECT * FROM ({_inserted(_inserted("SELECT conv_id, 0 AS i, ['00000000', ''] AS v0, CAST(NULL AS VARCHAR[]) AS v1, CAST(NULL AS VARCHAR[]) AS v2, CAST(NULL AS VARCHAR[]) AS v3 FROM every"))})
  UNION ALL SELECT * FROM ({_inserted(_inserted(_turn()))})),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(CASE WHEN blank THEN 1 ELSE 0 END) AS blank,
         sum(CASE WHEN again AND NOT blank THEN 1 ELSE 0 END) AS duplicate, sum(cut) AS truncated,
         sum(CASE WHEN before IS NOT NULL AND before || k NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS illegal FROM told GROUP BY conv_id),
ended AS (
  SELECT e.conv_id, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, least(w.v0, w.v3) AS best
  FROM every e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
  JOIN walk w ON w.conv_id IS NOT DISTINCT FROM e.conv_id AND w.i = coalesce(c.n, 0))
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(left(best[1], 8) AS BIGINT) AS cost,
       substr(best[1], 9) AS audit, sha256(substr(best[2], 2)) AS repaired_sha256 FROM ended
"""
