"""Validation and migration of whole books."""

import json

from pyspark.sql import functions as F

from folioflow.operators import migration, plainpages, validation
from folioflow.plans import book_queries as Q


def messages(spark, book):
    df = spark.createDataFrame([(1, json.dumps(book))], "book int, json string")
    return sorted(tuple(r)[3:] for r in validation.validate(df, validation.split_books(df, ["book"]), ["book"]).collect())


def test_every_code_is_planted_and_no_other():
    planted = {m[:2] for plants in (Q.ITEM_PLANTS, Q.PAGE_PLANTS, Q.HEAD_PLANTS) for _, said in plants for m in said}
    ruled = {(r.severity, r.code) for r in validation.RULES}
    assert ruled <= planted and {code for _, code in planted - ruled} == {"link-broken", "nav-broken"}
    assert len({r.code for r in validation.RULES}) == len(validation.RULES) >= 40


def test_whole_book(spark):
    run = {"type": "text_run", "text": "x"}
    item = {"id": "b", "type": "paragraph", "body": {"format": "rich-text-v1", "nodes": [{"type": "link", "href": "#a", "children": [run, {"type": "link", "href": "#c", "children": []}]}]}}
    book = {"schemaVersion": "bookwriter-v4", "meta": {"title": "t"}, "nav": {"mode": "auto", "groups": [{"target": "#b"}]}, "pages": [{"id": "a", "items": [item, {"id": "a", "type": "clear"}]}, {"id": "a", "items": []}]}
    assert messages(spark, book) == [
        ("error", "pages[0].items[1].id", "id-duplicate"), ("error", "pages[1].id", "id-duplicate"), ("error", "pages[1].id", "page-id-repeated"),
        ("warning", "pages[0].items[0].body.nodes[0].children[1].href", "link-broken"),
    ]


def test_odd_documents(spark):
    rows = [(1, "not json"), (2, None), (3, "[]"), (None, "{}"), (5, '{"pages": "x"}')]
    df = spark.createDataFrame(rows, "book int, json string")
    got = validation.validate(df, validation.split_books(df, ["book"]), ["book"]).groupBy("book").agg(F.sort_array(F.collect_list("code")).alias("c"))
    lacks = ["meta-missing", "nav-missing", "pages-missing", "schema-version"]
    assert {r.book: r.c for r in got.collect()} == {b: sorted([*(["book-not-object"] if b in (1, 2, 3) else []), *lacks]) for b in (1, 2, 3, None, 5)}
    none = df.limit(0)
    assert validation.validate(none, validation.split_books(none, ["book"]), ["book"]).count() == 0


def legacy(spark):
    pages = [
        (1, 0, json.dumps({"id": "p one", "pdfPage": 4, "items": [{"type": "paragraph", "html": "a<br>b", "note_en": 1}, {"type": "paragraph", "html": "a b"}, {"type": "figure", "id": "p-one", "src": "x"}]})),
        (1, 1, json.dumps({"items": [{"type": "scene", "singleSrc": "s", "navLabel": "N"}, None, 7, {"type": "table", "rows": [{"cells": []}], "columns": 1}]})),
        (2, 0, "no json"),
    ]
    return spark.createDataFrame(pages, "book int, page int, json string")


def test_migration_makes_valid_books_with_unique_ids(spark):
    out = migration.migrate(legacy(spark), ["book"]).cache()
    pages = {(r.book, r.page): r for r in out.collect()}
    first = json.loads(pages[1, 0].json)
    assert first["id"] == "p-one" and first["sourcePage"] == 4 and first["header"] == {"inherit": False, "left": "", "center": "", "right": ""}
    assert [i["id"] for i in first["items"]] == ["p-one-paragraph-a-b-1", "p-one-paragraph-a-b-2", "p-one-2"]
    assert first["items"][0]["legacySourceHtml"] == "a<br>b" and first["items"][2]["layout"]["placement"] == "float-right"
    second = json.loads(pages[1, 1].json)
    assert second["id"] == "page-2" and [i["type"] for i in second["items"]] == ["scene", "paragraph", "paragraph", "table"]
    assert second["items"][0]["src"] == "s" and second["items"][0]["nav"] == {"show": True, "label": "N"} and second["items"][3]["rows"] == [{"cells": []}]
    assert json.loads(pages[2, 0].json)["items"] == [] and pages[2, 0].rules == []
    assert pages[1, 0].dropped == ["note_en"] and sorted(pages[1, 0].rules) == ["html-body", "html-body", "translation-dropped"]
    assert pages[1, 0].assigned == 3
    heads = migration.migrated_head(spark.createDataFrame([(1, '{"meta":{"title":"T","title_en":"E"}}'), (2, None)], "book int, json string"), ["book"])
    assert json.loads(heads.where("book = 1").first().json)["meta"]["title"] == "T"
    assert validation.validate(heads, out.select("book", "page", "json"), ["book"]).where("severity = 'error'").count() == 0


def test_migrating_again_changes_nothing(spark):
    first = [(r.book, r.page, r.json) for r in migration.migrate(legacy(spark), ["book"]).collect()]
    once = spark.createDataFrame(first, "book int, page int, json string")
    again = migration.migrate(once, ["book"])
    rows = again.collect()
    assert not [r for r in rows if r.rules or r.assigned or r.dropped]
    assert sorted((r.book, r.page, r.json) for r in rows) == sorted(first)


def test_observed_counts_come_with_the_write(spark, tmp_path):
    table, seen = migration.observed(migration.migrate(legacy(spark), ["book"]))
    table.write.parquet(str(tmp_path / "new"))
    counts = seen.get
    assert counts["pages"] == 3 and counts["html-body"] == 2 and counts["scene-source"] == 1 and counts["nav-label"] == 1 and counts["type-unknown"] == 2 and counts["dropped"] == 1


def varied_pages():
    """JSON of pages of every legacy item and of fields that are cast, escaped, missing or of another kind, some plain and some not."""
    run = {"type": "text_run", "text": 'k "q" \\ é'}
    items = [json.loads(x.replace("{n}", n)) for x in Q.LEGACY for n in ("7", "12345678", "0", "")]
    items += [None, 7, "x", [], {}, {"type": 5, "id": True}, {"type": "paragraph", "body": {"format": "rich-text-v1", "nodes": []}, "html_en": None, "a_en": 1}]
    items += [{"type": "note", "body": {"nodes": [{"z": 1, "type": "text_run", "text": t, "a": None}], "format": "rich-text-v1"}, "style": None, "label": 3} for t in ("ΑΒΓ Ωμέγα", 5, True, None, {"x": 1})]
    items += [{"type": "paragraph", "html": h, "legacySourceHtml": s} for h, s in (("a<BR/>b &AMP;lt; c\n\t d", 1), (" <i>Σοφός</i> ", "kept"), ("é  &nbsp;x", None), (5, None), ("  <b", ""))]
    items += [{"type": "figure", "frameWidth": w, "wrapTight": t, "placement": p, "layout": o} for w, t, p, o in (("", "Yes", "", None), (10_000_000, "0", "float-x", {}), (-5, "what", 4, {"widthPx": None}), ("1e3", " true", "wide", {"wrap": 1}), (0.5, False, None, [1]))]
    items += [{"type": "interactive_callout", "aspect": "1/2", "sequenceSteps": [{"b": 1, "a": [None, True, "é/"]}], "visibility": {"screen": False, "print": "no"}}, {"type": "interactive_callout", "title": "  "}, {"type": "section_heading", "level": "", "title": "É é — x"}]
    items += [{"type": "section_heading", "sourceHeadingLevel": n} for n in (0, "3", 123456789, "x", -2)] + [{"type": "hero", "title": "\x01", "eyebrow": "\U0001f600"}, {"type": "list", "items": [1.50, 12345678901234567890]}, {"type": "table", "rows": {"b": 1, "a": 2}, "columns": None, "nav": {"show": "maybe", "label": 1}}]
    items += [{"type": "scene", "src": None, "singleSrc": 3, "id": "--Ω x--"}, {"type": "side_note", "id": "9", "title": " Title ", "navLabel": "nav", "showInNav": "t"}]
    heads = [{}, {"id": "!!"}, {"id": 4, "sourcePage": "12", "header": {"inherit": True, "left": 1, "center": None, "right": [1]}}, {"sourcePage": None, "pdfPage": "x"}, {"header": {"inherit": "true"}}]
    texts = [json.dumps({**h, "items": [i]}, ensure_ascii=False) for n, i in enumerate(items) for h in (heads[0], heads[n % len(heads)])]
    return [*texts, json.dumps({"items": items[:12]}), json.dumps({"items": items}), "[]", "7", '{"a":1,"a":2}', '{"items":[{"id":-0,"id_en":NaN}]}', "{", "", '{"items":{"a":1}}', None]


def test_plain_pages_become_what_expressions_make_of_them(spark):
    rows = [(n % 3, n, text) for n, text in enumerate(varied_pages())]
    given = spark.createDataFrame(rows, "book int, page int, _json string")
    names = ["page", "book", "page_id", "_head", "_ids", "_bases", "_items", "rules", "dropped"]
    kept = lambda df: {r.page: tuple(sorted(x) if c == "rules" else x for c, x in zip(names, r, strict=True)) for r in df.select(names).collect()}
    wanted = kept(migration.rewritten(given.withColumn("_row", F.col("page").cast("long")), ["book"]))
    got = kept(migration._all_rewritten(given, ["book"]))
    assert len(wanted) == len(rows)
    assert {p: (got[p], wanted[p], rows[p][2]) for p in wanted if got.get(p) != wanted[p]} == {}
    plain = [rewrites(text) for _, _, text in rows]
    assert 60 < sum(plain) < len(rows) - 5
    assert all(rewrites(json.dumps({"items": [json.loads(x.replace("{n}", "7"))]})) for x in Q.LEGACY)


def rewrites(text):
    try:
        return bool(plainpages.rewriter(migration.MOVES, migration.TEXTS, migration.WHOLE)(text or "", 0))
    except plainpages.Odd:
        return False


def test_rows_that_repeat_a_page_stay_pages(spark):
    pages = spark.createDataFrame([(1, 0, '{"items":[{"type":"clear","id":"a"}]}'), (1, 0, '{"items":[{"type":"clear","id":"a"}, 1.5]}')], "book int, page int, json string")
    made = [json.loads(r.json) for r in migration.migrate(pages, ["book"]).collect()]
    assert sorted(len(m["items"]) for m in made) == [1, 2] and len({i["id"] for m in made for i in [m, *m["items"]]}) == 5
