from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioflow.operators import audit, catalog, mutate, ordered, paginate, sequence, setops
from folioflow.sources import books, html_blocks, sinks


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_list_numbering(spark):
    df = spark.createDataFrame([(1, i, lv, 1) for i, lv in enumerate([0, 1, 1, 0, 1])] + [(2, i, 0, 5) for i in range(3)], "d int, o int, level int, s int")
    got = ordered.list_numbering(df, ["d"], ["o"], "level", "s").orderBy("d", "o").collect()
    assert [r.value for r in got] == [1, 1, 2, 2, 1, 5, 6, 7]


def test_stable_ids_and_ranges(spark):
    df = spark.createDataFrame([(i, "a") for i in range(3)], "o long, b string")
    assert [r.stable_id for r in ordered.stable_ids(df, [], ["o"], "b").orderBy("o").collect()] == ["a", "a-2", "a-3"]
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate("pqrst")], "d int, o long, k string")
    pick = lambda a, b: "".join(r.k for r in ordered.entries_in_range(df, ["d"], "o", "k", a, b).orderBy("o").collect())
    assert (pick("s", "q"), pick(None, "q"), pick("r", None), pick("x", "x")) == ("qrs", "pq", "r", "p")


def test_greedy_pagination(spark):
    g = lambda h, hd=(), br=(), a=7: paginate.greedy(list(h), [i in hd for i in range(len(h))], [i in br for i in range(len(h))], a)
    assert g([3, 4, 5]) == [0, 0, 1]
    assert g([3, 2, 4], hd={1}) == [0, 1, 1]
    assert g([5, 4], hd={0}) == [0, 0]
    assert g([1, 1, 1], br={0, 2}) == [0, 0, 1]
    assert g([0, None, 9]) == [0, 0, 1]
    df = spark.createDataFrame([(b, i, float(1 + (b * i) % 5), i % 3 == 0, False) for b in range(40) for i in range(b)], "b int, o int, h double, hd boolean, br boolean")
    got = {}
    for r in paginate.paginate(df, ["b"], ["o"], "h", "hd", "br", 7).orderBy("b", "o").collect():
        got.setdefault(r.b, []).append(r.page)
    assert got == {b: g([float(1 + (b * i) % 5) for i in range(b)], hd={i for i in range(b) if i % 3 == 0}) for b in range(1, 40)}


def test_continuations(spark):
    pages = spark.createDataFrame([(1, i, n, i > 1) for i, n in enumerate(["p", "q", "p-r3", "p-r2"])] + [(1, 4, "z-r2", True)], "b int, o long, id string, print_only boolean")
    got = sequence.continuation_order(pages, ["b"], "o").orderBy("new_ord").collect()
    assert [r.id for r in got] == ["p", "p-r2", "p-r3", "q", "z-r2"]


def test_print_expansion(spark):
    items = [(1, 0, 0, "h", None, None), (1, 0, 1, "c", "s", ["a", "b"]), (1, 0, 2, "s", None, None), (1, 1, 0, "s0", None, None), (1, 1, 1, "x", None, None), (1, 1, 2, "c2", "s0", ["a"]), (1, 2, 0, "c3", "none", ["a"])]
    df = spark.createDataFrame(items, "b int, p int, o long, id string, scene_id string, steps array<string>")
    got = sequence.expand_print(df, ["b"], "p", "o").orderBy("p", "o").collect()
    by = {}
    for r in got:
        by.setdefault(r.p, []).append(r.id)
    assert by == {0: ["h", "c", "s", "c", "s"], 1: ["s0", "x", "c2", "s0"], 2: ["c3"]}


def test_print_filter(spark):
    pages = spark.createDataFrame([(1, False, None), (2, None, None), (3, None, None)], "p int, screen_only boolean, shown boolean")
    items = spark.createDataFrame([(1, 0, None), (2, 0, True), (3, 0, False)], "p int, o int, shown boolean")
    shown = sequence.visible_in_mode("print", F.lit(None).cast("boolean"), F.lit(False), F.col("shown"))
    p, i = sequence.filter_for_print(pages, items, ["p"], F.lit(True), shown)
    assert rows(p, "p") == [(1,), (2,)] and rows(i, "p") == [(1,), (2,)]
    assert sequence.filter_for_print(pages, items, ["p"], F.lit(True), shown, keep_empty=True)[0].count() == 3


@pytest.mark.parametrize("many", [0, 11])
def test_print_filter_deals_rows_out(spark, many):
    """Keys go to as many tasks as their rows ask for: they are not broadcast, nor put together because they compress well."""
    pages = spark.range(1000).selectExpr("id AS p", "id % 3 = 0 AS gone")
    items = spark.range(4000).selectExpr("id % 1100 AS p", "id AS o", "id % 7 = 0 AS gone")
    p, i = sequence.filter_for_print(pages, items, ["p"], ~F.col("gone"), ~F.col("gone"), rows=many * sequence.PART_ROWS)
    both = p.join(i.groupBy("p").agg(F.count("*").alias("n")).hint("merge"), "p")
    want = {}
    for k in range(4000):
        if k % 7 and k % 1100 < 1000 and k % 1100 % 3:
            want[k % 1100] = want.get(k % 1100, 0) + 1
    assert {r.p: r.n for r in both.collect()} == want and p.count() == len(want)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and p.columns == pages.columns and i.columns == items.columns
    n = max(many, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert [x.rdd.getNumPartitions() for x in (p, i, both)] == [n] * 3


def test_styles_with_cycle(spark):
    s = spark.createDataFrame([("a", None, {"f": "1", "g": "2"}), ("b", "a", {"f": "3"}), ("c", "b", {"h": ""}), ("x", "y", {"f": "x"}), ("y", "x", {"g": "y"})], "style_id string, based_on string, props map<string,string>")
    got = {r.style_id: r.props for r in setops.resolve_styles(s).collect()}
    assert got == {"a": {"f": "1", "g": "2"}, "b": {"f": "3", "g": "2"}, "c": {"f": "3", "g": "2"}, "x": {"f": "x", "g": "y"}, "y": {"f": "x", "g": "y"}}


def test_audit(spark):
    refs = spark.createDataFrame([("a",), ("",), (None,), ("zz",)], "target string")
    assert rows(audit.broken_references(refs, spark.createDataFrame([("a",)], "id string")), "target") == [("zz",)]
    e = spark.createDataFrame([(1, "p"), (1, "q"), (1, "r"), (2, "p")], "d int, t string")
    got = rows(audit.duplicate_evidence(e, spark.createDataFrame([("p",), ("q",), ("r",)], "t string"), ["d"], ["t"]), "d", "n", "hits", "duplicate")
    assert got == [(1, 3, 3, True), (2, 1, 1, False)]
    assert audit.stats_by_type(e.limit(0), ["d"], "t").count() == 0


def test_catalog(spark):
    df = spark.createDataFrame([("Αλφα 2", 1, "x"), ("αλφα 10", 1, None), ("beta", 5, "y")], "title string, pages int, status string")
    assert [r.title for r in catalog.sort_catalog(df, "pages", True).collect()] == ["beta", "αλφα 10", "Αλφα 2"]
    assert [r.title for r in catalog.facet_search(df, ["title", "status"], " BETA ", {"status": "y", "level": ""}).collect()] == ["beta"]
    assert rows(catalog.facet_values(df, "status"), "value") == [("x",), ("y",)]


def test_mutations(spark):
    df = spark.createDataFrame([(1, 0, i, k, "t", "pay" + k, {}) for i, k in enumerate("abc")], "b int, p int, o int, id string, type string, payload string, kept map<string,string>")
    ids = lambda t: "".join(r.id for r in t.orderBy("p", "o").collect())
    assert ids(mutate.move_row(df, ["b"], "o", F.col("id") == "a", 1)) == "bac"
    assert ids(mutate.move_row(df, ["b"], "o", F.col("id") == "c", -9)) == "cab"
    assert ids(mutate.delete_rows(df, ["b"], "o", F.col("id") == "b")) == "ac"
    assert ids(mutate.insert_after(df, df.where("id = 'a'").withColumn("id", F.lit("z")), ["b"], "o", 0)) == "azbc"
    assert ids(mutate.clone_row(df, ["b"], "o", F.col("id") == "b", "id")) == "abb-copyc"
    split = mutate.split_page(df, ["b"], "p", "o", 0, 1)
    assert [(r.p, r.o, r.id) for r in split.orderBy("p", "o").collect()] == [(0, 0, "a"), (1, 0, "b"), (1, 1, "c")]
    assert ids(mutate.merge_pages(split, ["b"], "p", "o", 0)) == "abc"
    there = mutate.change_type(df, F.col("id") == "a", "u")
    back = mutate.change_type(there, F.col("id") == "a", "t").where("id = 'a'").first()
    assert there.where("id = 'a'").first().payload is None and (back.type, back.payload) == ("t", "paya")
    grid = spark.createDataFrame([([["x", "y"], ["z"]],)], "g array<array<string>>").select(mutate.resize_grid(F.col("g"), 3, 2).alias("g")).first().g
    assert grid == [["x", "y"], ["z", ""], ["", ""]]
    bad = lambda t: t.select(F.lit("error").alias("severity"))
    assert mutate.execute(df, lambda t: t.limit(1), bad) == (df, False)


def test_html_blocks(spark):
    html = "<body><nav><ul><li>n</ul></nav><article><h1>T</h1><p>one<p>two &amp; three<ul><li>a<li>b</ul><div>short</div><div>a text of more than twenty-five characters</div><table><tr><td colspan=2>x<td>y</table><figure><img src='i.png' alt='A'><figcaption>C</figcaption></figure><aside><p>gone</p></aside><script>if(a>b)'</p>'</script></article>"
    got = html_blocks.blocks(html, "http://h/d/")
    assert [(b["type"], b.get("text")) for b in got] == [("part_title", "T"), ("paragraph", "one"), ("paragraph", "two & three"), ("list", "a · b"), ("paragraph", "a text of more than twenty-five characters"), ("table", "x | y"), ("figure", "C")]
    assert got[5]["columns"] == 3 and got[6]["src"] == "http://h/d/i.png"
    df = spark.createDataFrame([(1, "u", html), (2, None, None), (3, "", "plain")], "page_id long, url string, html string")
    assert rows(html_blocks.block_rows(df, "page_id").groupBy("page_id").count(), "page_id", "count") == [(1, 7)]


def test_catalog_scan_and_sinks(spark, tmp_path):
    for folder, body in {"good": '{"meta":{"title":"G"},"pages":[{"id":"p","items":[{"id":"i","type":"odd"},{"id":"f","type":"figure"}]}]}', "bad": "{nope", "_hidden": "{}", ".dot": "{}"}.items():
        (tmp_path / "books" / folder).mkdir(parents=True)
        (tmp_path / "books" / folder / "book.json").write_text(body)
    cat = books.scan_catalog(spark, str(tmp_path / "books"))
    assert rows(cat, "folder", "error") == [("bad", "invalid JSON"), ("good", None)]
    assert rows(books.items_of(cat), "id", "type", "placement") == [("f", "figure", "float-right"), ("i", "paragraph", "wide")]
    target, at = str(tmp_path / "t"), datetime(2024, 1, 2, 3, 4, 5)
    assert sinks.save_verified(spark.range(3).toDF("x"), target, at) is None
    kept = sinks.save_verified(spark.range(5).toDF("x"), target, at)
    assert spark.read.parquet(target).count() == 5 and spark.read.parquet(kept).count() == 3 and kept.endswith("book_20240102T030405Z")
    with pytest.raises(Exception, match="exists"):
        sinks.save_new(spark.range(1).toDF("x"), target)


def test_presets(spark):
    from folioflow.operators import presets as P

    labs = spark.createDataFrame([("b", 1, "http://h:1/x"), ("a", 0, "http://h:1/y"), ("c", 2, "https://k")], "lab_id string, lab_ord int, base_url string")
    scenes = spark.createDataFrame([(0, "T", "http://h:1/s?b=2&a=1#z"), (1, "", "http://h:1/s?a=1&b=2"), (2, None, "https://k/q"), (3, "n", ""), (4, "o", "http://other/")], "ord int, title string, src string")
    got = {r.ord: (r.lab_id, r.title, r.query) for r in P.discover(scenes, labs).collect()}
    assert got == {0: ("a", "T", {"a": "1", "b": "2"}), 2: ("c", "https://k/q", {})}
    known = spark.createDataFrame([("a", ["http://h:1/s?a=1&b=2"]), ("c", ["http://other/"])], "lab_id string, compare_keys array<string>")
    assert [r.ord for r in P.discover(scenes, labs, known).collect()] == [2]
    df = spark.createDataFrame([("l", "p", "One", "d", "ready", {"k": "v"}, None, None), ("l", "q", "Two", "d", "archived", {}, None, "planned")], "lab_id string, preset_id string, title string, description string, status string, query map<string,string>, url string, previous_status string")
    assert rows(P.visible(df, F.col("status")), "preset_id") == [("p",)]
    assert rows(P.visible(df, F.col("status"), '"K":"V"'), "preset_id") == [("p",)]
    there = P.archive(df, F.col("preset_id") == "p")
    assert rows(there, "preset_id", "status", "previous_status") == [("p", "archived", "ready"), ("q", "archived", "planned")]
    assert rows(P.restore(there, F.lit(True)), "preset_id", "status") == [("p", "ready"), ("q", "planned")]


def test_insertion(spark):
    from folioflow.operators import insertion as I
    from folioflow.sources.html_blocks import block_rows

    page = spark.createDataFrame([(1, "u", "<article><h2>T</h2><p>one two</p><p>three</p></article>")], "page_id long, url string, html string")
    blocks = block_rows(page, "page_id")
    assert [r.label for r in I.entry_keys(blocks, "page_id").orderBy("block_ord").collect()] == ["H2 · T", "paragraph · one two", "paragraph · three"]
    new = I.blocks_to_items(blocks, ["page_id"], "block_ord")
    old = new.where("item_ord < 2").withColumn("id", F.concat(F.lit("old-"), "item_ord"))
    draft, evidence = I.insertion_draft(old, new, ["page_id"], "item_ord", 0, ["type", "text"], "i1")
    assert [r.id for r in draft.orderBy("item_ord").collect()] == ["old-0", "import-1-0", "import-1-1", "import-1-2", "old-1"]
    assert tuple(evidence.select("n", "hits", "duplicate").first()) == (3, 1, False)


def test_split_pagination(spark):
    r = paginate.repaired
    assert r([[1.0] * 4, [1.0] * 10], [False, False], 10) == [(0, 0, 0, 4), (1, 0, 0, 6), (1, 1, 6, 10)]
    assert r([[1.0] * 9, [1.0] * 4], [False, False], 10) == [(0, 0, 0, 9), (1, 1, 0, 4)]
    assert r([[5.0], [1.0], [9.0]], [False, True, False], 10) == [(0, 0, 0, 1), (1, 1, 0, 1), (2, 1, 0, 1)]
    assert r([[25.0], [1.0]], [False, False], 10) == [(0, 0, 0, 1), (1, 1, 0, 1)]
    assert r([[1.0] * 25], [False], 10) == [(0, 0, 0, 10), (0, 1, 10, 20), (0, 2, 20, 25)]
    for heights in ([[2.0] * n for n in (3, 9, 1, 30, 2)], [[float(i % 4 + 1)] * (i % 7 + 1) for i in range(30)]):
        got = r(heights, [False] * len(heights), 12.0)
        assert [x for u, _, a, b in got for x in [(u, i) for i in range(a, b)]] == [(u, i) for u, h in enumerate(heights) for i in range(len(h))]
        assert [p for _, p, _, _ in got] == sorted(p for _, p, _, _ in got)
    df = spark.createDataFrame([(1, 0, [1.0] * 25, False), (2, 0, None, True)], "b int, o int, h array<double>, hd boolean")
    assert rows(paginate.paginate_split(df, ["b"], ["o"], "h", "hd", 10.0), "b", "page", "from_part", "to_part") == [(1, 0, 0, 10), (1, 1, 10, 20), (1, 2, 20, 25), (2, 0, 0, 1)]
