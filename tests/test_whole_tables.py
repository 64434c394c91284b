"""Queries over whole tables, on rows that a filter or a fixed bound would lose."""

from pyspark.sql import functions as F

from folioflow.operators import ordered, setops
from folioflow.plans import catalog_queries, content_queries


def test_styles_of_any_depth_and_cycle(spark):
    deep = [(f"s{i}", f"s{i - 1}" if i else "s0", {"own": str(i)} if i % 2 else {"root": "r"} if not i else {}) for i in range(70)]
    ring = [(f"c{i}", f"c{(i + 1) % 20}", {f"k{i}": "v", "n": str(i)}) for i in range(20)]
    tail = [("t", "c3", {"t": "1"}), ("lost", "nowhere", {"l": "1"}), ("none", None, {"m": "1"})]
    df = spark.createDataFrame(deep + ring + tail, "style_id string, based_on string, props map<string,string>")
    got = {r.style_id: r.props for r in setops.resolve_styles(df).collect()}
    assert len(got) == 93
    for i in range(70):
        near = i if i % 2 else i - 1
        assert got[f"s{i}"] == {"root": "r"} | ({"own": str(near)} if i else {})
    keys = {f"k{i}": "v" for i in range(20)}
    assert all(got[f"c{i}"] == keys | {"n": str(i)} for i in range(20))
    assert got["t"] == keys | {"n": "3", "t": "1"} and got["lost"] == {"l": "1"} and got["none"] == {"m": "1"}
    assert setops.resolve_styles(df.limit(0)).count() == 0


def test_style_inherit(spark, tmp_path):
    # Part 65536 has its brand 15 ancestors up, part 3 its own.
    ids = [0, *[1 << i for i in range(17)], 3]
    rows = [(i, f"b{i}", f"t{i}") for i in ids]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.style_id: (r.font, r.size) for r in content_queries.style_inherit(spark, str(tmp_path)).collect()}
    want = {i: ("b0", "t0") for i in ids} | {3: ("b3", "t0")}
    assert got == want


def test_slug_of_every_line(spark, tmp_path):
    rows = [(1, "Öl & Äpfel\n\nZweite Zeile", "de", "s"), (2, "Straße ß\nx", None, "s"), (3, "a", "en", "s"), (4, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in content_queries.slug(spark, str(tmp_path)).collect())
    assert got == [(1, 0, "ol-apfel"), (1, 1, "item"), (1, 2, "zweite-zeile"), (2, 0, "stra-e"), (2, 1, "x"), (3, 0, "a")]


def test_dialogue_of_every_line(spark, tmp_path):
    rows = [("c", 0, "Ann", "hi | ho\r\n  \n\nlast"), ("c", 1, None, "x"), ("c", 2, "Bob", None)]
    spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in content_queries.dialogue_parse(spark, str(tmp_path)).collect())
    assert got == [("c", 0, 0, "Ann", "hi", "ho"), ("c", 0, 3, "Ann", "last", ""), ("c", 1, 0, "", "x", "")]


def test_positions_of_every_part(spark, tmp_path):
    rows = [(k, f"item {k * 7 % 300}", "b", k * 37 % 51) for k in range(300)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = [r.p_partkey for r in catalog_queries.catalog_sort_natural(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (-r[3], -(r[0] * 7 % 300), r[0]))]
    few = ordered.positions(spark.range(3), [F.desc("id")], "pos")
    assert sorted(map(tuple, few.collect())) == [(0, 3), (1, 2), (2, 1)] and ordered.positions(spark.range(0), [F.asc("id")], "pos").count() == 0


def test_evidence_among_all_documents(spark, tmp_path):
    rows = [(1, "a\nb\nc", "en", "s"), (3, "a\nb\nx", "en", "s"), (2, "d\nd", "en", "s"), (4, "e\nf", "en", "s"), (6, "e\nf\ng", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalog_queries.dup_evidence(spark, str(tmp_path)).select("doc_id", "n", "hits", "duplicate").collect())
    assert got == [(1, 3, 2, False), (2, 2, 0, False), (3, 3, 2, False), (4, 2, 2, True), (6, 3, 2, False)]
