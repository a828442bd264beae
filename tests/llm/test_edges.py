"""Every training-data query on empty tables, and on tables with nulls, repeats, long texts and clashing columns."""

import pytest

from provenir.llm.queries import QUERIES

FOUND = [n for n in QUERIES if n.endswith("_found") or n == "p9_selection"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() <= 7


@pytest.mark.parametrize("name", FOUND)
def test_dirt_changes_nothing_for_other_rows(spark, plain_dir, dirty_dir, name):
    plain, dirty = QUERIES[name](spark, plain_dir), QUERIES[name](spark, dirty_dir)
    assert plain.columns == dirty.columns
    rows = dirty.collect()
    assert len(set(rows)) == len(rows)
    if name in ("p1_found", "p6_found", "p7_found", "p8_found"):  # exact operators: the rows stay
        assert set(plain.collect()) <= set(rows)
    else:
        assert rows


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in FOUND])
def test_reports_run_on_dirt(spark, dirty_dir, name):
    assert QUERIES[name](spark, dirty_dir).count() > 0
