"""References, presets, names, diffs and reports on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from folioflow.functions import items, mathexpr
from folioflow.functions import text as X
from folioflow.operators import audit, paginate, reports, sequence, setops


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_link_targets_are_windows(spark):
    node = "struct<type:string,href:string,target:string,children:array<struct<type:string,href:string,target:string>>>"
    rows = [
        (1, "paragraph", None, ([("link", "https://x.org/a", "_blank", None), ("text_run", "#no", None, [("link", "#deep", None)]), ("link", None, "t", None)],)),
        (2, "figure", "a.png", None), (3, "paragraph", "b.png", ([],)), (4, "scene", "s.html", ([("link", "#", None, None)],)),
    ]
    df = spark.createDataFrame(rows, f"k int, type string, src string, body struct<nodes:array<{node}>>")
    edges = audit.reference_edges(df, ["k"])
    got = sorted(map(tuple, edges.collect()))
    assert got == [(1, "external-link", ""), (1, "external-link", "https://x.org/a"), (1, "internal-link", "deep"), (2, "asset", "a.png"), (4, "internal-link", ""), (4, "scene", "s.html")]
    nav = audit.nav_edges(spark.createDataFrame([(9, "#g", [("e",), (None,), ("#deep",)]), (8, None, None)], "k int, target string, entries array<struct<target:string>>"), ["k"])
    ids = spark.createDataFrame([("deep",), ("g",)], "id string")
    assert [tuple(r) for r in audit.broken_references(edges.unionByName(nav), ids).select("k", "kind", "target").collect()] == [(9, "nav-target", "e")]


def test_a_suppressed_preset_frees_its_keys(spark):
    rows = [(1, 0, "a", ["a"]), (1, 1, "b", ["a", "b"]), (1, 2, "c", ["b"]), (1, 3, "a", ["z"]), (1, 4, " ", []), (1, 5, None, None), (2, 0, "a", ["a"])]
    df = spark.createDataFrame(rows, "lab int, o int, id string, keys array<string>")
    got = sorted((r.lab, r.o) for r in setops.suppress_overlaps(df, ["lab"], "keys", ["o"], "id").collect())
    assert got == [(1, 0), (1, 2), (1, 4), (1, 5), (2, 0)]
    assert setops.suppress_overlaps(df.limit(0), ["lab"], "keys", ["o"], "id").count() == 0


@pytest.mark.parametrize(("raw", "want"), [("Dvořák Szűcs", "dvorak-szucs"), ("Ώρα ΐ", "ωρα-ι"), ("  ", "item"), (None, "item"), ("a" * 70, "a" * 60)])
def test_slugs_of_any_marks(spark, raw, want):
    assert one(spark, X.slugify, raw) == want


def test_long_digit_runs_sort_by_value(spark):
    names = ["a1234567890124x", "a1234567890123x", "a99999999999999999999", "a2", "a010", "a9"]
    got = [r.x for r in spark.createDataFrame([(n,) for n in names], "x string").orderBy(X.natural_key(F.col("x"))).collect()]
    assert got == ["a2", "a9", "a010", "a1234567890123x", "a1234567890124x", "a99999999999999999999"]


def test_hard_breaks_are_flags(spark):
    df = spark.createDataFrame([(None, None), (True, None), (False, True), (False, False)], "a boolean, b boolean")
    assert [r[0] for r in df.select(items.is_hard_break(F.col("a"), F.col("b"))).collect()] == [False, True, True, False]


def test_splits_of_lists_keep_one_part(spark):
    df = spark.createDataFrame([(t, 0, [1.0] * 4, False) for t in ("list", "note")], "t string, o int, h array<double>, hd boolean")
    got = sorted((r.t, r.page, r.from_part, r.to_part) for r in paginate.paginate_split(df, ["t"], ["o"], "h", "hd", 3.0, type_="t").collect())
    assert [g for g in got if g[0] == "list"] == [("list", 0, 0, 3), ("list", 1, 3, 4)] and ("note", 0, 0, 4) in got


def test_marks_and_spans(spark):
    assert tuple(one(spark, lambda x: X.earliest(x, ["b", "a"]), "xxab")) == (3, "a") and one(spark, lambda x: X.earliest(x, ["q"]), "xx") is None
    spans = lambda s: [tuple(r) for r in one(spark, X.math_spans, s)]
    assert spans(r"a \(x\) b $$y$$\[z\]") == [("a ", None), ("x", "inline"), (" b ", None), ("y", "block"), ("z", "block")]
    assert spans(r"a \(x $$y$$") == [("a ", None), (r"\(x $$y$$", None)] and spans("") == [] and spans("$$$$") == [("", "block")] and spans("cost $5") == [("cost $5", None)]


def test_names_and_labels(spark):
    assert one(spark, X.asset_name, "Σχήμα 1.PNG") == "σχημα-1.png" and one(spark, X.asset_name, "x") == "x.png"
    assert [one(spark, lambda x: X.display_label(x, X.YES_NO), v) for v in ("1", "false", "q", None)] == ["ναι", "όχι", "q", None]


def test_object_diff(spark):
    df = spark.createDataFrame([({"a": "1", "b": None, "c": "3"}, {"a": "1", "b": None, "c": "4", "d": None}), (None, {"a": "1"}), ({"a": "1"}, None)], "x map<string,string>, y map<string,string>")
    got = [r[0] for r in df.select(setops.object_diff(F.col("x"), F.col("y"))).collect()]
    assert got == [{"c": "4", "d": None}, {"a": "1"}, None]


def test_book_of_entries_and_reports(spark):
    rows = [(1, 0, 1, "A", 3), (1, 1, None, "p", 3), (1, 2, 4, "D", 5), (2, 0, None, "q", 1)]
    df = spark.createDataFrame(rows, "b int, o int, level int, title string, page int")
    book = reports.book_of_entries(df, ["b"], "o", "level", "title")
    got = sorted((r.b, r.page_ord, r.ord, r.kind, r.title) for r in book.collect())
    assert got == [
        (1, 0, 0, "part_title", "Περιεχόμενα"), (1, 0, 1, "paragraph", "A"), (1, 1, 0, "section_heading", "A"), (1, 1, 1, "paragraph", "p"), (1, 1, 2, "section_heading", "D"),
        (2, 0, 0, "part_title", "Περιεχόμενα"), (2, 1, 0, "paragraph", "q"),
    ]
    assert {r.page_ord for r in reports.book_of_entries(df, ["b"], "o", "level", "title", with_toc=False).collect()} == {0}
    made = reports.range_summary(df, ["b"], "o", "page", F.col("level").isNotNull(), F.col("title") == "p")
    assert sorted(map(tuple, made.collect())) == [(1, 3, 2, 1, 3, 5), (2, 1, 0, 0, 1, 1)]
    names = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, " "), (2, None)], "k int, n string")
    assert {r.k: r.names for r in reports.name_union(names, ["k"], "n").collect()} == {1: ["a", "b"], 2: []}


def test_parents_of_nested_lists(spark):
    df = spark.createDataFrame([(1, i, lv) for i, lv in enumerate([0, 2, 1, 2, 0, 1])], "k int, o long, level int")
    assert [r.parent for r in reports.nested_parents(df, ["k"], "o", "level").orderBy("o").collect()] == [None, 0, 0, 2, None, 4]
    assert reports.nested_parents(df.limit(0), ["k"], "o", "level").count() == 0


def test_located_and_materialized(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a")], "k int, o long, id string")
    refs = spark.createDataFrame([(1, "a"), (1, "2"), (1, "3"), (1, "z"), (2, "0"), (1, None)], "k int, ref string")
    got = {(r.k, r.ref): (r.found, r.error is None) for r in sequence.located(rows, refs, ["k"], "o", "id", "ref").collect()}
    assert got == {(1, "a"): (0, True), (1, "2"): (2, True), (1, "3"): (None, False), (1, "z"): (None, False), (2, "0"): (None, False), (1, None): (None, False)}
    flagged = spark.createDataFrame([(1, True)], "id int, printOnly boolean")
    assert sequence.materialized(flagged, "print").columns == ["id"] and sequence.materialized(flagged, "screen").columns == ["id", "printOnly"]


def test_math_rows_close_in_any_order():
    to = mathexpr.to_mathml
    assert to("x_1^2").count("msubsup") == 2 and to("x^2_1") == to("x_1^2")
    for bad in ("{x", "x}", "(x", "x^}", r"\text x", r"\text{x"):
        with pytest.raises(mathexpr.MathError):
            to(bad)
    assert "<mfrac><mrow><mi>a</mi></mrow><mrow></mrow></mfrac>" in to(r"\frac{a}")
    assert to("a;b || c").count("<mtd>") == 4 and "<mo fence" in to("a;b")
