"""What a row costs is paid once: no plan evaluates a document, a rule or a style a second time, to filter by it."""

import pytest

import __spark_entry__ as e
from folioflow.operators import migration, validation
from folioflow.plans import book_queries

SF = e.SMOKE_DIR


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["migration_report", "style_cascade"])
def test_arrays_are_not_made_twice_to_filter_by_their_size(spark, name):
    assert not [line for line in plan(e.queries()[name](spark, SF)).splitlines() if "Filter" in line and "size(" in line]


def test_migrated_pages_are_read_and_rewritten_once(spark):
    assert "parse_json" not in plan(migration.migrate(book_queries.legacy_pages(spark, SF), ["book"]))


def test_rules_are_checked_once(spark):
    _, pages = book_queries.planted(spark, SF)
    found = validation.facts(validation.page_elements(pages, ["book"]), ["book"])
    assert not [line for line in plan(found).splitlines() if "Filter" in line and ("concat_ws" in line or "transform(" in line)]


def test_css_resolves_a_paragraph_once(spark):
    assert plan(e.queries()["style_css"](spark, SF)).count("transform_values") < 10


def test_odd_pages_migrate(spark):
    rows = [(1, 0, '{"items":[{"type":"note","label":7,"visibility":{"print":false}},null]}'), (1, 1, "no json"), (1, 2, '{"items":{}}'), (None, 3, "{}")]
    pages = spark.createDataFrame(rows, "book int, page int, json string")
    out = {r.page: r for r in migration.migrate(pages, ["book"]).collect()}
    assert set(out) == {0, 1, 2} and '"items":[]' in out[1].json and '"items":[]' in out[2].json
    assert out[0].json.count('"type":') >= 2 and '"label":"7"' in out[0].json and sorted(out[0].rules) == ["html-body", "type-unknown"][-1:]
    counts = migration.report(migration.applied_rules(pages, ["book"]), ["book"]).collect()
    assert [(r.book, r.rule, r.n) for r in counts] == [(1, "type-unknown", 1)]


@pytest.mark.parametrize("name", ["reflow_book", "repair_report"])
def test_books_are_folded_once(spark, name):
    assert len([line for line in plan(e.queries()[name](spark, SF)).splitlines() if "MapInArrow" in line or "MapInPandas" in line]) == 1
