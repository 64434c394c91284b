import math

import pytest
from pyspark.sql import functions as F

from folioflow.functions import mathexpr as m
from folioflow.functions import text as X
from folioflow.operators import setops as S


def text(spark, f, x):
    return spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("v")).first()["v"]


@pytest.mark.parametrize(("x", "want"), [("Άλφα  Βήτα!", "αλφα-βητα"), ("Élan & Co", "elan-co"), ("", "item"), (None, "item"), ("--a--", "a"), ("x" * 80, "x" * 60)])
def test_slugify(spark, x, want):
    assert text(spark, X.slugify, x) == want


@pytest.mark.parametrize(("x", "want"), [(" a b ", "a-b"), ("9x", "id-9x"), ("", ""), (None, ""), ("_k", "_k"), ("--", "")])
def test_normalize_id(spark, x, want):
    assert text(spark, X.normalize_id, x) == want


@pytest.mark.parametrize(("x", "want"), [("16/9", 16 / 9), ("natural", None), ("1.44", 1.44), ("", None), (None, None), ("4/0", None)])
def test_aspect(spark, x, want):
    got = text(spark, X.parse_aspect, x)
    assert got == want or math.isclose(got, want)


def test_atoms_and_html(spark):
    assert text(spark, X.atoms, "ab  cd e") == ["ab  ", "cd ", "e"]
    assert text(spark, X.atoms, " a") == [" ", "a"]
    assert text(spark, X.html_text, "<p>a<br>b&nbsp;&amp;lt; c</p>") == "a b < c"
    assert text(spark, X.escape_html, "<a href='x'>&</a>") == "&lt;a href=&#39;x&#39;&gt;&amp;&lt;/a&gt;"


def test_dialogue(spark):
    row = lambda x: tuple(text(spark, X.dialogue_row, x))
    assert row("A | b | c | d") == ("A", "b | c", "d")
    assert row("A | b") == ("A", "b", "")
    assert row("a|b") == ("", "a|b", "")


def test_status_and_natural_order(spark):
    assert [text(spark, X.status_class, x) for x in ("Έτοιμο", "Archived ready", "draft", "x", None)] == ["ready", "ready", "draft", "", ""]
    names = ["Chapter 10", "chapter 2", "Άλφα 20", "αλφα 3"]
    got = [r.x for r in spark.createDataFrame([(n,) for n in names], "x string").orderBy(X.natural_key(F.col("x"))).collect()]
    assert got == ["αλφα 3", "Άλφα 20", "chapter 2", "Chapter 10"]  # the Greek collation puts Greek first
    marked = ["za", "őa", "ob", "Řeka 2", "reka 10", "reka 1"]
    got = [r.x for r in spark.createDataFrame([(n,) for n in marked], "x string").orderBy(X.natural_key(F.col("x"))).collect()]
    assert got == ["őa", "ob", "reka 1", "Řeka 2", "reka 10", "za"]


def test_maps(spark):
    assert text(spark, S.lines_map, "a=1\nb\nc=x=y") == {"a": "1", "b": "1", "c": "x=y"}
    assert text(spark, S.query_map, "a=1&a=2&b=x%20y&&c") == {"a": "2", "b": "x y", "c": "1"}
    assert text(spark, S.canonical_url, "http://h/p?b=2&a=1#f") == "http://h/p?a=1&b=2"
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "1", "b": "3", "c": "4"}), ({"a": "1", "b": "2"}, {"a": "1", "b": ""})], "p map<string,string>, q map<string,string>")
    got = df.select(S.map_changed(F.col("p"), F.col("q")), S.map_removed(F.col("p"), F.col("q")), S.layered(F.col("p"), F.col("q"))).collect()
    assert [tuple(r) for r in got] == [({"b": "3", "c": "4"}, [], {"a": "1", "b": "3", "c": "4"}), ({}, ["b"], {"a": "1"})]


def test_math():
    assert "<mfrac><mrow><mi>a</mi></mrow><mrow><mi>b</mi></mrow></mfrac>" in m.to_mathml(r"\frac{a}{b}")
    assert "<msubsup><mi>x</mi><mrow><mi>i</mi></mrow><mrow><mn>2</mn></mrow></msubsup>" in m.to_mathml("x_{i}^{2}")
    assert m.to_mathml("a\nb").count("<mtr>") == 2 and m.to_mathml("a ; b").count("<mtr>") == 2
    for bad in ("{a", "}", "(a", r"\text a", r"\text{a"):
        with pytest.raises(m.MathError):
            m.to_mathml(bad)
    assert m.repaired("(a") == "(a)" and m.repaired("a)") == "a" and m.repaired("{[a") == "{[a}]"
    for s in (r"\frac{a}{b}", "x_{i}^{2}", r"\sqrt{x}", r"\text{ab}"):
        assert m.to_mathml(m.to_source(m.to_mathml(s))) == m.to_mathml(s)
    assert [k for k, _ in m.tokenize(r"\alpha_2,5 + b")] == ["command", "_", "number", "operator", "identifier"]


def test_math_udf(spark):
    df = spark.createDataFrame([("x^2",), ("{",), (None,)], "s string").select(m.parse_math(F.col("s")).alias("p"))
    assert [r.p.ok for r in df.collect()] == [True, False, True]


def test_rich_text(spark):
    from folioflow.functions import richtext as R

    df = spark.createDataFrame([("<p><b>ab  cd</b> e<br>f <a href='u'>l <i>x</i></a></p><br>",), (None,)], "h string").select(R.from_html(F.col("h")).alias("n"))
    nodes = df.first().n
    assert [(r.type, r.text, r.bold, r.italic, r.href) for r in nodes] == [("text_run", "ab cd", True, None, None), ("text_run", " e", None, None, None), ("line_break", None, None, None, None), ("text_run", "f ", None, None, None), ("text_run", "l ", None, None, "u"), ("text_run", "x", None, True, "u")]
    first, rest = R.split_runs(F.col("n"), 2)
    got = df.select(R.plain_text(F.col("n")), R.to_html(F.col("n")), R.plain_text(first), R.plain_text(rest), F.size(R.collapse_runs(R.explode_runs(F.col("n"))))).first()
    assert tuple(got) == ("ab cd e\nf l x", '<strong>ab cd</strong> e<br>f <a href="u">l </a><a href="u"><em>x</em></a>', "ab cd", "e\nf l x", 6)
    assert R.cleaned("<p onclick='x' style='color:red;position:fixed'>a<script>b</script><a href='javascript:x'>c</a></p>") == '<p style="color:red">a<a>c</a></p>'


def test_unique_ids(spark):
    from folioflow.operators.identity import ensure_unique, unique_ids

    assert unique_ids(["a", "a", "a"]) == ["a", "a-2", "a-3"]
    assert unique_ids(["x-2", "x", "x", None, ""]) == ["x-2", "x", "x-3", "id", "id-2"]
    df = spark.createDataFrame([(b, i, "k") for b in (1, 2) for i in range(3)], "b int, o int, id string")
    assert sorted(r.unique_id for r in ensure_unique(df, ["b"], ["o"], "id", suffix="_{n}").collect()) == ["k", "k", "k_2", "k_2", "k_3", "k_3"]


def test_items(spark):
    from folioflow.functions import items as I

    df = spark.createDataFrame([("l", "list", ["a", "b", "c", "d", "e"], 5, True, 0), ("t", "table", ["h", "1", "2", "3"], 1, False, 1), ("s", "list", ["a"], 1, False, 0)], "id string, type string, rows array<string>, start int, ordered boolean, header_rows int")
    got = {(r.id, r.split_part): (r.rows, r.start) for r in I.split_rows(df, F.lit(3)).collect()}
    assert got == {("l", 1): (["a", "b", "c"], 5), ("l--cont-2", 2): (["d", "e"], 8), ("t", 1): (["h", "1", "2"], 1), ("t--cont-2", 2): (["h", "3"], 1), ("s", 1): (["a"], 1)}
    one = spark.createDataFrame([(["↳ • x", "↳ ↳ y", "  ", "- z", None],)], "v array<string>").select(I.bullets(F.col("v")).alias("b"), I.bullets_text(I.bullets(F.col("v"))).alias("t")).first()
    assert [tuple(e) for e in one.b] == [(1, "x"), (2, "y"), (0, "z")] and one.t == "↳ x\n↳ ↳ y\nz"
    v = spark.createDataFrame([(["a", "b", "c"], '{"a":[{"b":7}]}')], "v array<string>, j string")
    row = v.select(I.set_at(F.col("v"), 1, F.lit("x")), I.remove_at(F.col("v"), 0), I.insert_at(F.col("v"), 1, F.lit("n")), I.move_at(F.col("v"), 0, 1), I.move_at(F.col("v"), 2, -9), I.value_at(F.col("j"), "$.a[0].b", "int"), I.value_at(F.col("j"), "$.z")).first()
    assert tuple(row) == (["a", "x", "c"], ["b", "c"], ["a", "n", "b", "c"], ["b", "a", "c"], ["c", "a", "b"], 7, None)
    calls = spark.createDataFrame([("k", "T", "L", [("S", ""), (None, "M")])], "id string, title string, label string, steps array<struct<title:string,label:string>>")
    assert sorted(tuple(r) for r in I.step_callouts(calls, [], ["title", "label"]).collect()) == [("k-step-1", 0, "S", "L"), ("k-step-2", 1, "T", "M")]
    a = spark.createDataFrame([("x y", "paragraph", "p", 0, 0, "t"), (None, "figure", None, 1, 2, "My Fig"), (None, "paragraph", "p", 0, 0, "t")], "id string, type string, page_id string, page_ord int, item_ord int, title string")
    assert [r.a for r in a.select(I.anchor_id(*[F.col(c) for c in a.columns]).alias("a")).collect()] == ["x-y", "page-2-3-my-fig", ""]
    t = spark.createDataFrame([("paragraph", None, "a b c", None), ("side_note", "float", "a b", None), ("table", None, None, ["r"]), ("hero", None, "a", None)], "y string, p string, t string, r array<string>")
    assert [r.u for r in t.select(I.splittable_units(*[F.col(c) for c in t.columns]).alias("u")).collect()] == [3, 0, 1, 0]
