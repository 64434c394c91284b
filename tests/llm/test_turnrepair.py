import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from folioflow.llm import turnrepair

SCHEMA = "conv_id long, turn long, role string, text string, gone string, code long, plan string"
BLANK = " \t\n\x0b\f\r"


def least(rows):
    """(cost, audit, repaired) by the least (cost, audit) of each grammar state, from the first turn on."""
    step = turnrepair.STEPS
    best = {0: (0, "", ())}

    def put(to, q, v):
        if q not in to or v[:2] < to[q][:2]:
            to[q] = v

    def closed(at):
        for _ in range(4):
            for q, (c, a, r) in list(at.items()):
                for x, role in (("u", "user"), ("a", "assistant")):
                    if q in step[x]:
                        put(at, step[x][q], (c + 2, a + "I", (*r, f"{role}:")))
        return at

    best = closed(best)
    for role, text, doomed, cut in rows:
        nxt = {}
        for q, (c, a, r) in best.items():
            put(nxt, q, (c + 3, a + "D", r))
            if not doomed:
                if q in step.get(role[:1], {}):
                    put(nxt, step[role[:1]][q], (c + cut, a + "K", (*r, f"{role}:{text}")))
                for x, name in (("u", "user"), ("a", "assistant")):
                    if q in step[x]:
                        put(nxt, step[x][q], (c + 2 + cut, a + "R", (*r, f"{name}:{text}")))
        best = closed(nxt)
    cost, audit, out = min(best[q] for q in (0, 3) if q in best)
    return cost, audit, "\n".join(out)


def brute(table):
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, told, n = set(), [], [0, 0, 0]
        for _, role, text in rows:
            blank, again, cut = not text.strip(BLANK), (role, text) in seen, not text.rstrip(BLANK).endswith((".", "!", "?"))
            seen.add((role, text))
            fault = 0 if blank else 1 if again else 2 if cut else None
            if fault is not None:
                n[fault] += 1
            told.append((role, text, blank or again, int(fault == 2)))
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(told))
        cost, audit, text = least(told)
        out.append((conv, gaps, *n, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def table(seed, convs=60, longest=14):
    rng, out = random.Random(seed), []
    for conv in [*range(convs), None]:
        for turn in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "u", "Assistant"])
            text = rng.choice(["Yes.", "No!", "why", "", " \t", "A?\n", None, "A.\x0b", "x\x85", "long. " * 50] + [f"t{i}." for i in range(9)])
            out.append((conv, rng.choice([turn, turn, turn, turn * 3, None, -turn]), role, text))
    return out


@pytest.fixture(params=[1, 2])
def rows(request):
    return table(request.param)


def test_against_brute_force_and_sql(spark, rows, monkeypatch, tmp_path):
    df = spark.createDataFrame([(*r, "extra", 1, "x") for r in rows], SCHEMA).repartition(5)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, turnrepair.op13_turn_repair(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(duck.execute(turnrepair.ORACLE).fetchall(), key=str) == got


def test_layers_against_least_paths():
    """Every conversation of up to four turns over all codes: cost and least audit."""
    texts = {0: "s", 1: "u", 2: "a", 3: "x"}
    for n in range(5):
        for codes in itertools.product([*range(8), turnrepair.Layers.DOOMED], repeat=n):
            told = [(texts[c & 3], "t", c == 8, c >> 2 & 1 if c < 8 else 0) for c in codes]
            layers = turnrepair.Layers(bytes(codes))
            assert (layers.cost, layers.audit()) == least(told)[:2], codes


def test_words_hold_every_state():
    assert turnrepair.Layers.words and all(w[-1] == 15 and len(w) == turnrepair.LAYERS for w in turnrepair.Layers.words)
    assert len(turnrepair.Layers.words) < 200


def test_long_conversation():
    rng = random.Random(3)
    codes = bytes(rng.choice([0, 1, 1, 2, 2, 3, 5, 6, 8]) for _ in range(50_000))
    layers = turnrepair.Layers(codes)
    audit = layers.audit()
    paid, at = 0, iter(codes)
    for letter in audit:
        code = None if letter == "I" else next(at)
        paid += {"D": 3, "I": 2, "R": 2, "K": 0}[letter] + (letter in "KR" and code >> 2 & 1)
    assert paid == layers.cost and next(at, None) is None


def test_repaired_turns_keep_texts_and_empty_table(spark):
    rows = [(8, 1, "user", "Hi."), (8, 2, "user", "There!"), (8, 3, "assistant", "x" * 3_000_000 + ".")]
    turns = turnrepair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("gone", turnrepair.F.lit(False))
    told = turnrepair.plans(turns)
    out = turnrepair.repaired(turns, told).where("place > 0").orderBy("place").collect()
    assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in out))
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    turns = turnrepair.damaged(empty)
    assert turnrepair.digests(turnrepair.repaired(turns, turnrepair.plans(turns))).count() == 0


def test_gaps_beyond_a_long(spark):
    rows = [(3, -(2**63), "user", "a."), (3, 2**63 - 1, "assistant", "b.")]
    turns = spark.createDataFrame([(*r, False) for r in rows], "conv_id long, turn long, role string, text string, gone boolean")
    got = turnrepair.plans(turns).first()
    assert got.gaps is None and got.audit == "KK"
