"""Every query against its SQL, and the invariants of the issue classes."""

from __future__ import annotations

import duckdb
import pytest

from veilgrid.plans.editing import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype.kind in "fiu":
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{SF}/events.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    got, want = rows(QUERIES[name](spark, SF).toPandas()), rows(con.sql(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert ((got == want) | (got.isna() & want.isna())).all().all()


def test_known_counts(spark):
    assert QUERIES["gap_fill"](spark, SF).count() == 123
    assert QUERIES["temporal_filter"](spark, SF).count() == 888


def test_known_counts_after_the_repair(spark):
    got = {r["issue"]: r["count"] for r in QUERIES["issues"](spark, SF).groupBy("issue").count().collect()}
    assert got == {"noface": 283, "flicker": 36, "lowconf": 69}


def test_issue_classes(spark):
    found = QUERIES["issues"](spark, SF).toPandas()
    sets = {k: set(zip(g.video_id, g.frame_index)) for k, g in found.groupby("issue")}
    assert sets["flicker"] <= sets["noface"]
    assert not sets["lowconf"] & sets["noface"]


def test_estimates_of_long_videos_are_as_in_sql(spark, tmp_path):
    """Frames beyond the total of the estimate: 0 milliseconds are left, and samples that do not rise are no rows."""
    con = duckdb.connect()
    con.execute(f"create view events as select event_id + k * 266000 event_id from '{SF}/events.parquet' cross join (select unnest([0, 1, 2]) k)")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got, want = rows(QUERIES["eta_sliding"](spark, str(tmp_path)).toPandas()), rows(con.sql(ORACLES["eta_sliding"]).df())
    assert (want["eta_ms"] == 0).sum() > 700 and len(got) == len(want)
    assert ((got == want) | (got.isna() & want.isna())).all().all()
