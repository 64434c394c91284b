"""Pagination with feedback, histories, edits by path, provenance, extents, list HTML and journaled saves."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioflow.functions import jsonpath as J
from folioflow.operators import audit, cascade, catalog, extent, history, insertion, ordered, provenance, reflow, repair, reports, sequence, setops
from folioflow.operators.fold import fold_sorted
from folioflow.operators.paginate import greedy
from folioflow.sources import listing, sinks

ROOM, GAP = 100.0, 4.0
UNITS = "book int, n int, type string, heading boolean, hard_break boolean, pair boolean, parts array<double>, widths array<struct<width:double,height:double>>, page int"


def mended(units):
    """Pages by plain trial, page after page: [(unit, first, last, width)] and whether the page is too high."""
    h = lambda p: p[3][1] if p[3] else sum(units[p[0]]["parts"][p[1] : p[2]])
    size = lambda page: sum(map(h, page)) + GAP * (len(page) - 1)
    packed = greedy([sum(u["parts"]) for u in units], [u["heading"] for u in units], [u["hard_break"] for u in units], ROOM)
    pages = [[(u, 0, len(units[u]["parts"]), None) for u in range(len(units)) if packed[u] == p] for p in range(packed[-1] + 1)]
    out, i = [], 0
    while i < len(pages):
        page = pages[i]
        if not page:
            del pages[i]
            continue
        if size(page) <= ROOM + 1:
            out.append((page, False))
            i += 1
            continue
        if i + 1 == len(pages):
            pages.append([])
        last, unit, led = page[-1], units[page[-1][0]], len(page) == 2 and units[page[0][0]]["heading"]
        if len(page) == 1 and not unit["pair"] and not last[3]:
            fit = [w for w in unit["widths"] if w[1] <= ROOM + 1]
            if fit:
                pages[i] = [(*last[:3], fit[0])]
                continue
        if (len(page) == 1 or led) and not unit["pair"]:
            cuts = [k for k in range(last[1] + 1, last[2]) if size([*page[:-1], (last[0], last[1], k, None)]) <= ROOM + 1]
            total = last[2] - last[1]
            least = min(3, total - 1) if unit["type"] in ("paragraph", "note", "side_note") else 1
            if cuts and cuts[-1] - last[1] >= least:
                pages[i] = [*page[:-1], (last[0], last[1], cuts[-1], None)]
                pages[i + 1].insert(0, (last[0], cuts[-1], last[2], None))
                continue
        if len(page) == 1 or led:
            out.append((page, True))
            i += 1
            continue
        moved = [page.pop()]
        if units[page[-1][0]]["heading"]:
            moved.insert(0, page.pop())
        pages[i + 1][:0] = moved
    return out


def book(rng, n):
    out = []
    for _ in range(n):
        type_ = rng.choice(["section_heading", "figure", "dialogue", "list", "paragraph", "paragraph", "note", None])
        many = type_ in ("list", "paragraph", "note")
        parts = [float(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 14))] if many else [float(rng.randrange(5, 160))]
        widths = sorted(((float(w), float(rng.randrange(60, 150))) for w in rng.sample(range(100, 500), 3))) if type_ == "figure" and rng.random() < 0.7 else []
        out.append({"type": type_, "heading": type_ == "section_heading", "hard_break": rng.random() < 0.05, "pair": type_ == "dialogue", "parts": parts, "widths": widths})
    return out


def frame(spark, books):
    rows = [(b, n, u["type"], u["heading"], u["hard_break"], u["pair"], u["parts"], u["widths"] or None, 7) for b, units in books.items() for n, u in enumerate(units)]
    return spark.createDataFrame(rows, UNITS).repartition(3)


def test_mended_pages_equal_plain_trial(spark):
    rng = random.Random(7)
    books = {b: book(rng, rng.randrange(1, 60)) for b in range(40)}
    placed = repair.paginate_repaired(frame(spark, books).drop("page"), ["book"], ["n"], ROOM, GAP)
    got = {}
    for r in placed.collect():
        got.setdefault(r.book, {}).setdefault(r.page, []).append((r.n, r.from_part, r.to_part, r.width, r.overflow is not None))
    report = {r.book: r for r in repair.repair_report(placed, ["book"], ["n"]).collect()}
    for b, units in books.items():
        want = mended(units)
        assert {p: sorted(x) for p, x in got[b].items()} == {p: sorted((*q[:3], q[3] and q[3][0], high) for q in page) for p, (page, high) in enumerate(want)}
        pieces = [q for page, _ in want for q in page]
        cuts = {}
        for u in {q[0] for q in pieces}:
            n = sum(q[0] == u for q in pieces) - 1
            if n:
                cuts[units[u]["type"]] = cuts.get(units[u]["type"], 0) + n
        r = report[b]
        assert (r.pages, r.split_items, r.resized_figures, r.oversize_items) == (len(want), sum(cuts.values()), sum(q[3] is not None for q in pieces), sum(high for _, high in want))
        assert {s.type: s.cuts for s in r.splits_by_type} == cuts
        assert all(sum(q[2] - q[1] for q in pieces if q[0] == u) == len(units[u]["parts"]) for u in range(len(units)))


def test_nothing_is_left_over_and_odd_units(spark):
    rows = [(1, 0, "figure", None, None, None, None, None, 0), (1, 1, "paragraph", None, None, None, [], None, 0), (1, 2, "list", False, None, None, [300.0, None, -5.0], None, 0), (None, 0, "list", None, None, None, [1.0], None, 0)]
    placed = repair.paginate_repaired(spark.createDataFrame(rows, UNITS).drop("page"), ["book"], ["n"], ROOM)
    assert sorted((r.n, r.page, r.from_part, r.to_part, r.overflow) for r in placed.collect()) == [(0, 0, 0, 1, None), (1, 0, 0, 1, None), (2, 1, 0, 3, 200.0)]
    assert [(r.n, r.type, r.overflow) for r in repair.oversize(placed, ["book"], ["n"]).collect()] == [(2, "list", 200.0)]
    assert repair.paginate_repaired(spark.createDataFrame([], UNITS).drop("page"), ["book"], ["n"], ROOM).count() == 0


def test_heading_above_what_cannot_be_cut_stays_with_it(spark):
    rows = [(1, 0, "section_heading", True, False, False, [20.0], None, 0), (1, 1, "dialogue", False, False, True, [150.0], None, 0), (1, 2, "paragraph", False, False, False, [10.0], None, 0)]
    placed = repair.paginate_repaired(spark.createDataFrame(rows, UNITS).drop("page"), ["book"], ["n"], ROOM)
    assert sorted((r.n, r.page, r.overflow) for r in placed.collect()) == [(0, 0, 70.0), (1, 0, 70.0), (2, 1, None)]
    assert [(r.n, r.type) for r in repair.oversize(placed, ["book"], ["n"]).collect()] == [(1, "sequence_pair")]


def test_figure_widths(spark):
    df = spark.createDataFrame([(100.0,), (None,), (10.0,), (580.0,), (700.0,)], "w double")
    got = [r[0] for r in df.select(repair.figure_widths(F.col("w"), F.lit(600.0))).collect()]
    assert got == [[120.0, 140.0, 165.0, 200.0], [408.0, 476.0, 561.0, 600.0], [96.0, 112.0, 132.0, 160.0], [600.0], []]


def test_fold_over_books_larger_than_a_batch(spark):
    """Books that end inside, at and far behind the end of an Arrow batch are folded whole, once each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        df = spark.range(237).selectExpr("int(case when id < 35 then 1 when id < 40 then 2 when id < 43 then 3 else 4 + (id - 43) div 90 end) as b", "id as n").repartition(2)
        got = fold_sorted(df, ["b"], ["n"], [], lambda rows, bounds: rows.assign(n=[hi - lo for lo, hi in bounds for _ in range(lo, hi)])).groupBy("b", "n").count().collect()
        assert sorted((r.b, r.n, r["count"]) for r in got) == [(1, 35, 35), (2, 5, 5), (3, 3, 3), (4, 90, 90), (5, 90, 90), (6, 14, 14)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_replay_against_plain_lists(spark):
    rng = random.Random(3)
    rows = [(u, n, rng.choice(["command", "command", "undo", "undo", "redo", "redo", "clear", "other", None] if u else ["command", "undo"])) for u in (0, 1, None) for n in range(300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "u int, n long, kind string, depth_ string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        replay = history.replayed(df, ["u"], ["n"], "kind", "n", 5)
        got = sorted(((r.u, r.n, r.reaches, r.depth, r.ahead) for r in replay.collect()), key=str)
        live = {(r.u, r.command) for r in history.live_commands(replay, ["u"], ["n"], "kind").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, holds = [], set()
    for u in (0, 1, None):
        done, undone = [], []
        for _, n, kind in [r for r in rows if r[0] == u]:
            hit = None
            if kind == "command":
                done, undone, hit = [*done, n][-5:], [], n
                holds.add((u, n))
            elif kind == "undo" and done:
                hit = done.pop()
                undone.append(hit)
                holds.discard((u, hit))
            elif kind == "redo" and undone:
                hit = undone.pop()
                done = [*done, hit][-5:]
                holds.add((u, hit))
            elif kind == "clear":
                done, undone = [], []
            want.append((u, n, hit, len(done), len(undone)))
    assert got == sorted(want, key=str) and live == holds


@pytest.mark.parametrize(
    ("document", "path", "value", "want"),
    [
        ("{}", ["a", 0, "b"], "1", {"a": [{"b": 1}]}),
        ('{"a":[1]}', ["a", 3], '"x"', {"a": [1, None, None, "x"]}),
        ('{"a":{"b":1}}', ["a", "b"], None, {"a": {}}),
        ('{"a":[1,2]}', ["a", 0], None, {"a": [None, 2]}),
        ('{"a":[1,2]}', ["a", 9], None, {"a": [1, 2]}),
        ('{"a":{}}', ["a", 1], "2", {"a": {"1": 2}}),
        ('[{"k":1}]', [0, "k"], '{"z":[]}', [{"k": {"z": []}}]),
        ('{"a":5}', ["a", "b"], "1", None),
        ('{"a":[]}', ["a", "b"], "1", None),
        ("not json", ["a"], "1", None),
        (None, ["a"], "1", None),
        ("{}", ["a"], "not json", None),
        ("null", ["a"], "1", None),
        ('{"ό κλ":1}', ["ό κλ", ], '"έ"', {"ό κλ": "έ"}),
    ],
)
def test_set_at_path(spark, document, path, value, want):
    df = spark.createDataFrame([(document, value)], "d string, v string")
    got = df.select(J.set_at_path(F.col("d"), path, F.col("v"))).first()[0]
    assert (json.loads(got) if got is not None else None) == want
    if want is not None and value is not None and path != ["a", 1]:
        kept = spark.createDataFrame([(got,)], "d string").select(J.canonical(F.to_json(F.try_variant_get(F.try_parse_json("d"), J.path_text(path), "variant")))).first()[0]
        assert json.loads(kept) == json.loads(value)


def test_equal_json(spark):
    df = spark.createDataFrame([('{"a":1,"b":[1,{"c":2,"d":3}]}', '{ "b":[1,{"d":3,"c":2}], "a":1}'), ('{"a":[1,2]}', '{"a":[2,1]}'), ("x", "x"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(J.equal(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_three_way_and_rebase(spark):
    df = spark.sql("SELECT map('a','1','b','2','c','3','d','4') AS base, map('a','1','b','2x','c','3','e','5') AS applied, map('a','1','b','2y','d','4','e','5','f','') AS local, cast(null AS map<string,string>) AS none")
    got = df.select(provenance.three_way(F.col("base"), F.col("applied"), F.col("local"))).first()[0]
    assert [tuple(e) for e in got] == [("a", "1", "base"), ("b", "2y", "conflict"), ("c", None, "local"), ("d", None, "applied"), ("e", "5", "both")]
    assert df.select(provenance.rebased(F.col("base"), F.col("applied"), F.col("local"))).first()[0] == {"a": "1", "b": "2y", "e": "5"}
    assert df.select(provenance.three_way(F.col("none"), F.col("none"), F.col("none"))).first()[0] == []
    set_to = lambda v: df.select(provenance.with_parameter(F.col("base"), F.lit("a"), F.lit(v))).first()[0]
    assert set_to(" 9 ")["a"] == "9" and "a" not in set_to("  ") and "a" not in set_to(None)


def test_scene_source_names_what_is_its_own(spark):
    items = spark.createDataFrame([(1, 0, "c", "interactive_callout", None), (1, 1, "p", "paragraph", None)], "book int, ord int, id string, type string, scene_id string")
    scenes = spark.sql("SELECT 1 AS book, 's' AS id, 'c' AS anchor, 'after' AS placement, map('a','1','b','2') AS base, map('a','9') AS applied")
    got = {r.id: r for r in provenance.insert_scenes(items, scenes, ["book"], "ord").collect()}
    assert [got[i].ord for i in ("c", "s", "p")] == [0, 1, 2] and got["c"].scene_id == "s" and got["p"].source is None
    assert got["s"].source.asDict() == {"applied_query": {"a": "9"}, "local_query": {"a": "9"}, "removed_keys": ["b"]}


def test_extent_of_nested_boxes(spark):
    boxes = [
        (1, 1, None, 10.0, 50.0, 10.0, 0.0, "none", 40.0), (1, 2, 1, 30.0, 20.0, 5.0, 5.0, "left", 40.0), (1, 3, 2, 5.0, 20.0, 5.0, None, None, 40.0), (1, 4, 9, 500.0, 0.0, 0.0, 9.0, "none", 40.0),
        (1, 5, 6, 1.0, 99.0, 1.0, 0.0, "none", 40.0), (1, 6, 5, 1.0, 99.0, 1.0, 0.0, "none", 40.0), (2, 1, 1, 0.0, None, None, None, None, 7.0),
    ]
    df = spark.createDataFrame(boxes, "page int, box int, parent int, top double, height double, width double, margin double, float string, flow_height double")
    got = {r.page: r for r in extent.visual_extent(extent.absolute_tops(df, ["page"]), ["page"], "box", 60.0).collect()}
    assert (got[1].used, got[1].overflow, got[1].fits, got[1].overflow_kind, got[1].culprit) == (65.0, 5.0, False, "float-bottom", 2)
    assert (got[2].used, got[2].fits, got[2].culprit) == (7.0, True, None)
    deep = spark.range(200).selectExpr("1 AS page", "int(id) AS box", "int(id) - 1 AS parent", "1.0D AS top", "1.0D AS height", "1.0D AS width", "0.0D AS margin", "'none' AS float", "0.0D AS flow_height")
    assert extent.visual_extent(extent.absolute_tops(deep, ["page"]), ["page"], "box", 60.0).first().culprit_bottom == 201.0


def list_html(entries):
    least = min(level for level, _ in entries)
    entries = [(level - least, text) for level, text in entries]
    at = 0

    def level_of(n):
        nonlocal at
        out = '<ul class="callout-list">'
        while at < len(entries) and entries[at][0] >= n:
            if entries[at][0] > n:
                out += level_of(entries[at][0])
                continue
            out += f"<li>{entries[at][1]}"
            at += 1
            while at < len(entries) and entries[at][0] > n:
                out += level_of(entries[at][0])
            out += "</li>"
        return out + "</ul>"

    return level_of(0)


def test_nested_list_html(spark):
    rng = random.Random(5)
    lists = {k: [(rng.randrange(6), f"t{i}") for i in range(rng.randrange(1, 15))] for k in range(150)}
    df = spark.createDataFrame([(k, i, level, text) for k, x in lists.items() for i, (level, text) in enumerate(x)], "k int, ord int, level int, text string").repartition(3)
    got = {r.k: r.html for r in reports.nested_list_html(df, ["k"], "ord", "level", "text").collect()}
    assert got == {k: list_html(x) for k, x in lists.items()}


class Crash(Exception):
    pass


STEPS = ["journal temp", "staging written", "journal target", "old table moved", "new table moved", "journal complete"]


@pytest.mark.parametrize("stop", STEPS)
def test_save_stopped_after_every_step(spark, tmp_path, stop):
    path = str(tmp_path / "book")
    old, new = spark.range(5), spark.range(7)
    sinks.save_journaled(old, path, datetime(2024, 1, 1))

    def step(name):
        if name == stop:
            raise Crash(name)

    with pytest.raises(Crash):
        sinks.save_journaled(new, path, datetime(2024, 1, 2), step=step)
    said = sinks.recover(spark, path)
    assert said == {0: "dropped", 1: "dropped", 5: "nothing"}.get(STEPS.index(stop), "saved")
    assert spark.read.parquet(path).count() == (5 if said == "dropped" else 7)
    assert sinks.recover(spark, path) == "nothing"
    assert not [p.name for p in tmp_path.iterdir() if "staging" in p.name]
    if said != "dropped":
        assert spark.read.parquet(f"{path}.backups/book_20240102T000000Z").count() == 5
    sinks.save_journaled(spark.range(9), path, datetime(2024, 1, 3))
    assert spark.read.parquet(path).count() == 9


def test_save_recovers_an_unfinished_one_and_refuses_errors(spark, tmp_path):
    path = str(tmp_path / "book")

    def step(name):
        if name == "journal target":
            raise Crash(name)

    with pytest.raises(Crash):
        sinks.save_journaled(spark.range(3), path, datetime(2024, 1, 1), step=step)
    kept = sinks.save_journaled(spark.range(4), path, datetime(2024, 1, 2))
    assert spark.read.parquet(kept).count() == 3 and spark.read.parquet(path).count() == 4
    bad = lambda df: df.selectExpr("'error' AS severity").limit(1)
    with pytest.raises(ValueError, match="errors"):
        sinks.save_journaled(spark.range(1), path, datetime(2024, 1, 3), validate=bad)
    assert spark.read.parquet(path).count() == 4


def test_style_cascade_layers_and_themes(spark):
    raw = lambda **kw: F.create_map(*[F.lit(x) for kv in kw.items() for x in kv]) if kw else F.create_map().cast("map<string,string>")
    themes = F.create_map(F.lit("major"), F.lit("Georgia"))
    rows = [("a", None, raw(sz="24", color="auto", before="300")), ("b", "a", raw(asciiTheme="majorHAnsi", color="xyz", line="480", lineRule="exact")), ("c", "b", raw(hAnsiTheme="minorHAnsi", hanging="150", b="0")), ("x", "y", raw(jc="both")), ("y", "x", raw(sz="30"))]
    styles = None
    for id_, up, m in rows:
        one = spark.range(1).select(F.lit(id_).alias("style_id"), F.lit(up).cast("string").alias("based_on"), cascade.visual(m, themes).alias("props"))
        styles = one if styles is None else styles.unionByName(one)
    paragraphs = spark.createDataFrame([(1, "c"), (2, "b"), (3, None), (4, "x"), (5, "unknown")], "n int, style_id string").withColumn("direct", F.when(F.col("n") == 2, cascade.visual(raw(sz="27", fill="#00ff00"))))
    out = cascade.cascade(paragraphs, styles, {"fontSizePx": "14", "lineHeight": "1.15"}, default_style="a")
    got = {r.n: {k: tuple(v) for k, v in r.resolved.items()} for r in out.collect()}
    assert got[1] == {"fontFamily": ("Calibri", "style:c"), "textIndentPx": ("-10", "style:c"), "bold": ("false", "style:c"), "lineHeightPx": ("32", "style:b"), "textColor": ("#000000", "style:a"), "fontSizePx": ("16", "style:a"), "marginTopPx": ("20", "style:a"), "lineHeight": ("1.15", "default")}
    assert got[2]["fontSizePx"] == ("18", "direct") and got[2]["fontFamily"] == ("Georgia", "style:b") and got[2]["backgroundColor"] == ("#00FF00", "direct")
    assert got[3] == got[5] == {"fontSizePx": ("16", "style:a"), "textColor": ("#000000", "style:a"), "marginTopPx": ("20", "style:a"), "lineHeight": ("1.15", "default")}
    assert got[4]["align"] == ("both", "style:x") and got[4]["fontSizePx"] == ("20", "style:y")
    text = {r.n: r.css for r in out.select("n", cascade.css(cascade.values(F.col("resolved"))).alias("css")).collect()}
    assert text[4].startswith("text-align:justify;text-justify:inter-word;hyphens:auto;") and text[1].endswith('font-family:"Calibri";font-size:16px;line-height:1.15;margin-top:20px;text-indent:-10px')


@pytest.mark.parametrize(("html", "want"), [("<ul class='x'><li>a</li></ul>", "<ul class='x' style=\"a:&quot;b&quot;\"><li>a</li></ul>"), ("text", '<span class="docx-paragraph-format" style="display:block;a:&quot;b&quot;">text</span>'), (None, '<span class="docx-paragraph-format" style="display:block;a:&quot;b&quot;"></span>')])
def test_root_style(spark, html, want):
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(cascade.root_styled(F.col("h"), F.lit('a:"b"'))).first()[0] == want


def test_counts_of_nested_and_flat_books_agree(spark):
    pages = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "book int, page int")
    items = spark.createDataFrame([(10,), (10,), (20,), (99,)], "page int")
    flat = sorted(map(tuple, catalog.counts(pages, items, "book", "page").collect()))
    nested = spark.createDataFrame([(1, [([1, 2],), (None,)]), (2, [([3],)])], "book int, pages array<struct<items:array<int>>>")
    assert flat == sorted((r.book, r.n_pages, r.n_items) for r in catalog.nested_counts(nested).collect()) == [(1, 2, 2), (2, 1, 1)]
    assert catalog.nested_counts(spark.createDataFrame([(1, None)], "book int, pages array<struct<items:array<int>>>")).first().n_pages == 0


def test_spread_join_and_matches(spark):
    rows = spark.range(3000).selectExpr("id AS n", "CASE WHEN id < 2000 THEN 1 WHEN id < 2990 THEN id ELSE NULL END AS k").repartition(4)
    found = spark.createDataFrame([(1, "hot"), (2500, "one")], "k long, v string")
    got = setops.spread_join(rows, found, ["k"])
    assert got.count() == 3000 and {r.v: r["count"] for r in got.groupBy("v").count().collect()} == {"hot": 2000, "one": 1, None: 999}
    lookup = spark.createDataFrame([(1, None, "n"), (1, 5, "a"), (1, 7, "b"), (2, 1, "c")], "k int, o int, v string")
    left = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    assert sorted(((r.k, r.v) for r in setops.first_match(left, lookup, ["k"], "o").collect()), key=str) == [(1, "n"), (2, "c"), (3, None), (None, None)]
    assert sorted(((r.k, r.v) for r in setops.last_match(left, lookup, ["k"], "o").collect()), key=str) == [(1, "b"), (2, "c"), (3, None), (None, None)]


def test_reflow_puts_contents_first(spark):
    rows = [(1, p, o, [40.0], p == 2 and o == 0, f"{p}.{o}") for p in range(4) for o in range(3)]
    df = spark.createDataFrame(rows, "book int, page int, ord int, parts array<double>, toc boolean, name string")
    df = df.selectExpr("*", "'list' AS type", "false AS heading", "false AS hard_break", "false AS pair", "cast(null AS array<struct<width:double,height:double>>) AS widths")
    out = reflow.reflow(df, ["book"], "page", "ord", F.col("toc"), 100.0)
    got = {}
    for r in out.collect():
        got.setdefault((r.new_page, r.section), []).append(r.name)
    assert {k: sorted(v) for k, v in got.items()} == {(0, "contents-flow"): ["2.0", "2.1"], (1, "contents-flow"): ["2.2"], (2, "document-flow"): ["0.0", "0.1"], (3, "document-flow"): ["0.2", "1.0"], (4, "document-flow"): ["1.1", "1.2"], (5, "document-flow"): ["3.0", "3.1"], (6, "document-flow"): ["3.2"]}
    assert {r.new_page: r.source_range for r in reflow.page_sources(out, ["book"], "page").collect()}[3] == "0-1"
    old = spark.createDataFrame([(1, 0, 0, "", "text"), (1, 0, 1, None, " <TABLE x>"), (1, 1, 0, "<ul>", None), (2, 0, 0, "<p>", "<ol>")], "book int, page int, ord int, a string, b string")
    assert [tuple(r) for r in reflow.opaque_items(old, ["book"], "page", "ord", "a", "b").collect()] == [(1, 0, 1, "table")]


@pytest.mark.parametrize(
    ("root", "href", "want"),
    [
        ("http://h/books/", "one/", "http://h/books/one/"), ("http://h/books/index.html?x#y", "./one/", "http://h/books/one/"), ("http://h/books/", "/books/two/?C=N", "http://h/books/two/"), ("http://h/books/", "/other/", None),
        ("http://h/books/", "http://h/books/t%C3%A9/", "http://h/books/t%C3%A9/"), ("http://h/books/", "//h/books/x/", "http://h/books/x/"), ("http://h/books/", "../up/", None), ("http://h/books/", "?C=M", None), ("http://h/books/", "#a", None),
        ("http://h/books/", "file.json", None), ("http://h/books/", "_trash/", None), ("http://h", "a/", "http://h/a/"), ("http://h/books/", "mailto:x@y/", None),
    ],
)
def test_listing(spark, root, href, want):
    html = f"<A class=x href='{href}'>n</a><a>no</a><abbr href=\"z/\">"
    df = spark.createDataFrame([(1, root, html), (2, root, None)], "id int, url string, html string")
    got = [r.folder_url for r in listing.listed_books(df, ["id"]).collect()]
    assert got == ([] if want is None else [want])


def test_names_in_listings(spark):
    df = spark.createDataFrame([(1, "http://h/b/", '<a href="t%C3%A9st+1/">x</a><a href="bad%zz/">y</a><a title="a > b" href=plain/>z</a>')], "id int, url string, html string")
    assert [(r.ord, r.name, r.book_url) for r in listing.listed_books(df, ["id"]).collect()] == [(0, "tést+1", "http://h/b/t%C3%A9st+1/book.json"), (1, "bad%zz", "http://h/b/bad%zz/book.json"), (2, "plain", "http://h/b/plain/book.json")]


def test_manifest_outranks_hits(spark):
    entries = spark.createDataFrame([(d, o, f"1:{o}", "A.docx" if d < 3 else "b.docx", f"s{o}" if d != 2 else f"t{o}") for d in (1, 2, 3, 4) for o in range(3)], "d int, o int, key string, file string, sig string")
    done = spark.createDataFrame([("x9", "a.DOCX", "1:0", "1:2"), ("x1", "a.docx", "1:0", "1:2"), ("x0", "b.docx", "1:0", "1:1")], "insertion_id string, source_file string, start_key string, end_key string")
    known = spark.createDataFrame([("s0",), ("s1",), ("s2",), ("s2",)], "sig string")
    got = sorted(map(tuple, insertion.import_evidence(entries, done, known, ["d"], "o", "key", "file", ["sig"]).collect()))
    assert got == [(1, "manifest", "x1", 3, 3), (2, "manifest", "x1", 0, 3), (3, "sourceRef", None, 3, 3), (4, "sourceRef", None, 3, 3)]


def test_canonical_styles(spark):
    props = F.create_map(*[F.lit(x) for x in ("align", "both", "marginLeftPx", "20", "textIndentPx", "-5", "textColor", "#FF0000", "bold", "true", "fontSizePx", "16", "lineHeight", "")])
    df = spark.range(1)
    assert df.select(cascade.canonical_style(props)).first()[0] == {"align": "justify", "hyphenate": "true", "marginLeftPx": "20", "textIndentPx": "-5", "fontSizePx": "16", "color": "#FF0000"}
    assert df.select(cascade.canonical_style(props, True, False)).first()[0] == {"align": "justify", "hyphenate": "false", "fontSizePx": "16", "color": "#FF0000"}
    assert df.select(cascade.canonical_style(F.lit(None).cast("map<string,string>"))).first()[0] == {"align": "left", "hyphenate": "true"}


def test_candidate_report_and_restore(spark, tmp_path):
    folder = str(tmp_path)
    first = sinks.save_candidate(spark.range(2), spark.range(1), folder)
    assert first["backup"] is None and spark.read.parquet(first["candidate"]).count() == 2
    sinks.save_journaled(spark.range(5), f"{folder}/book", datetime(2024, 1, 1))
    again = sinks.save_candidate(spark.range(3), spark.range(2), folder)
    assert [spark.read.parquet(again[k]).count() for k in ("candidate", "backup")] == [3, 5] and spark.read.json(again["report"]).count() == 2
    assert spark.read.parquet(f"{folder}/book").count() == 5
    with pytest.raises(ValueError, match="errors"):
        sinks.save_candidate(spark.range(9), spark.range(1), folder, validate=lambda df: df.selectExpr("'error' AS severity"))
    kept = sinks.restore(spark, again["candidate"], f"{folder}/book", datetime(2024, 1, 2))
    assert spark.read.parquet(f"{folder}/book").count() == 3 and spark.read.parquet(kept).count() == 5 and spark.read.parquet(again["candidate"]).count() == 3


def test_local_scenes(spark):
    rows = [(1, "scene", " http://H:80/a "), (1, "scene", "http://h:80/a"), (1, "scene", "https://x/a"), (1, "figure", "http://h:80/f"), (2, "scene", None)]
    got = audit.local_scenes(spark.createDataFrame(rows, "book int, type string, src string"), ["book"], "http://h:80")
    assert sorted(map(tuple, got.collect())) == [(1, "http://H:80/a"), (1, "http://h:80/a")]


def test_scene_lookup_in_print_expansion(spark):
    """Scenes after, right before and long before their callout, on another page, named twice, and a callout that is a scene itself."""
    rows = [
        (1, 0, 0, "early", None, 0), (1, 0, 1, "x", None, 0), (1, 0, 2, "c1", "early", 2), (1, 0, 3, "s", None, 0), (1, 0, 4, "c2", "s", 1), (1, 0, 5, "c3", "late", 1), (1, 0, 6, "late", None, 0),
        (1, 1, 0, "c4", "early", 1), (1, 1, 1, "late2", None, 0), (1, 1, 2, None, None, 0), (1, 1, 3, "c5", "gone", 1), (1, 1, 4, "c6", "c5", 1), (1, 1, 5, "c7", None, 1),
    ]
    df = spark.createDataFrame(rows, "b int, p int, o int, id string, scene_id string, n int").selectExpr("b", "p", "o", "id", "scene_id", "CASE WHEN n > 0 THEN sequence(1, n) END AS steps")
    got = [(r.p, r.o, r.id, r.step_ord, r.part) for r in sequence.expand_print(df, ["b"], "p", "o").orderBy("p", "o").collect()]
    assert got == [
        (0, 0, "early", None, 0), (0, 1, "x", None, 0), (0, 2, "c1", 0, 0), (0, 3, "early", 0, 1), (0, 4, "c1", 1, 0), (0, 5, "early", 1, 1), (0, 6, "c2", 0, 0), (0, 7, "s", 0, 1), (0, 8, "c3", 0, 0), (0, 9, "late", 0, 1),
        (1, 0, "c4", 0, 0), (1, 1, "early", 0, 1), (1, 2, "late2", None, 0), (1, 3, None, None, 0), (1, 4, "c6", 0, 0), (1, 5, "c5", 0, 1), (1, 6, "c7", None, 0),
    ]


def test_list_formats_runs_widths_and_defaults(spark):
    nums = spark.createDataFrame([(1, 10), (2, 10), (3, 99)], "num_id int, abstract_id int")
    levels = spark.createDataFrame([(10, 0, "lowerLetter", 4), (10, 1, "bullet", None)], "abstract_id int, level int, num_fmt string, start int")
    overrides = spark.createDataFrame([(2, 0, 7), (9, 0, 3)], "num_id int, level int, start int")
    rows = spark.createDataFrame([(n, num, level) for n, (num, level) in enumerate([(1, 0), (2, 0), (2, 1), (3, 0), (9, 0), (None, 0), (1, 5)])], "n int, num_id int, level int")
    got = sorted((r.n, r.num_fmt, r.start) for r in ordered.list_formats(rows, nums, levels, overrides).collect())
    assert got == [(0, "lowerLetter", 4), (1, "lowerLetter", 7), (2, "bullet", 1), (3, "decimal", 1), (4, "decimal", 3), (5, None, None), (6, "decimal", 1)]
    flags = spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 3, None), (1, 4, True), (2, 1, True), (3, 1, False)], "t int, o int, f boolean")
    assert sorted(map(tuple, ordered.leading_run(flags, ["t"], "o", F.col("f")).collect())) == [(1, 2), (2, 1), (3, 0)]
    cells = spark.createDataFrame([(1, 1, 2), (1, 1, None), (1, 2, 0), (2, 1, 5)], "t int, r int, s int")
    assert sorted(map(tuple, reports.widest_row(cells, ["t"], ["r"], "s").collect())) == [(1, 3), (2, 5)]
    labs = spark.createDataFrame([("b",), ("a",), ("b",)], "k string")
    asked = spark.createDataFrame([("b",), ("z",), (None,)], "x string")
    assert sorted(((r.x, r.y) for r in setops.with_default(asked, labs, "x", "k", "y").collect()), key=str) == [("b", "b"), ("z", "a"), (None, "a")]
    assert [r.y for r in setops.with_default(asked, labs.limit(0), "x", "k", "y").collect()] == [None] * 3
