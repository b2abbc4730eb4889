"""Every named query against DuckDB."""

import pytest
from conftest import SMALL, rows_equal

from logweir.model import Settings
from logweir.plans import catalog
from logweir.streaming.ingest import Engine


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_duckdb(spark, duck, name):
    names, rows = duck(catalog.ORACLE_SQL[name], SMALL)
    rows_equal(catalog.QUERIES[name](spark, SMALL), names, rows)


def test_stream_fold_sums_bins_of_several_folds(spark, duck, tmp_path, monkeypatch):
    """Three copies of the events with ids of their own: every bin has rows in several folds."""
    duck(f"COPY (SELECT * REPLACE (event_id + 1000 * k AS event_id) FROM events, range(3) copies(k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)", SMALL)
    made = []
    monkeypatch.setattr(catalog, "Engine", lambda *args, **more: made.append(Engine(*args, Settings(max_fold_rows=700), **more)) or made[-1])
    names, rows = duck(catalog.ORACLE_SQL["stream_fold_equals_batch"], str(tmp_path))
    rows_equal(catalog.QUERIES["stream_fold_equals_batch"](spark, str(tmp_path)), names, rows)
    assert made[0].rollup.state()["refreshes"] == 5 and made[0].rollup.read().count() > len(rows)


def test_tokens_find_every_row(spark):
    row = catalog.QUERIES["attr_token_selfconsistency"](spark, SMALL).first()
    assert row.n_hits == row.n_rows > 0


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_plans_push_filters_and_prune(spark):
    plan = catalog.QUERIES["agg_1h_service"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert "props" not in plan  # no column is read that isn't needed
    top = catalog.QUERIES["page_first"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top
