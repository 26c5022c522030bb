"""Queries against DuckDB on the smallest tables."""

import math
import numbers

import duckdb
import pandas as pd
import pytest

import barkgraph.queries as Q

SF = "/root/testdata/sf0.001"
FAST = [n for n in Q.oracle_sql() if not n.startswith(("FLAGSHIP", "JN26", "AG06", "AG1", "AG2", "ST", "OR", "JN01", "JN02", "PRJ19", "WN13", "FN11"))] + ["ST01_merge_log", "ST02_suppression", "AG17_confusion"]


def rows(df):
    cell = lambda x: "~" if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, numbers.Real) and not isinstance(x, bool) else str(x)
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_same_as_duckdb(spark, duck, name):
    got, want = Q.queries()[name](spark, SF).toPandas(), duck.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_point_without_the_corpus_operators(spark):
    import __spark_entry__ as e

    assert set(Q.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["ST04_stable_tracker", "ST05_sort", "ST06_bytetrack", "ST07_botsort"])
def test_trackers_get_every_frame(spark, name):
    whole = Q.Tables(spark, SF).tracks.groupBy("video_id").max("frame").collect()
    assert {r[1] > 2000 for r in whole} == {True}
    seen = Q.queries()[name](spark, SF).toPandas().groupby("video_id").frame.max()
    assert set(seen.index) == {r[0] for r in whole} and all(seen[v] > last - 300 for v, last in whole)  # SORT may drop the last ones


def test_event_matching_takes_every_event(spark):
    ev = Q.Tables(spark, SF).ev.where("end - start > 0.5").toPandas()  # each overlaps its own guess by far
    got = Q.queries()["ST09_event_matching"](spark, SF).toPandas()
    hit = ev[ev.event_id.isin(got.gt_id)]
    assert set(hit.event_type) == set(ev.event_type) and hit.start.max() > 200 and len(hit) > 0.9 * len(ev)


def test_metrics_take_every_frame(spark):
    got = Q.queries()["ST11_mot_metrics"](spark, SF).toPandas()
    parts = got[got.sequence.notna()]
    assert len(parts) == 5 and (parts.IDF1 < 50).all() and (parts.idsw >= 18).all()  # six identities, each with three changes of fragment
    assert got[got.sequence.isna()].idsw.iloc[0] == parts.idsw.sum()


def test_temporal_iou_of_every_event_as_brute_force(spark):
    ev = Q.Tables(spark, SF).ev.where("end > start").toPandas()
    want = {}
    for _, v in ev.groupby("video_id"):
        e = list(v[["event_id", "start", "end"]].itertuples(index=False, name=None))
        for i, s, t in e:
            for j, x, y in e:
                if i < j and t >= x and s <= y:
                    want[i, j] = max(0.0, min(t, y) - max(s, x)) / (max(t, y) - min(s, x))
    got = Q.queries()["JN20_temporal_iou_of_every_event"](spark, SF).toPandas()
    assert len(got) == len(want) and all(math.isclose(r.iou, want[r.a, r.b], abs_tol=1e-6) for r in got.itertuples())
    small = Q.queries()["JN20_temporal_iou"](spark, SF).count()
    assert len(got) > 50 * max(small, 1)


def test_mot_rows_of_every_video(spark):
    got = Q.queries()["SNK07_mot_rows_of_every_video"](spark, SF).toPandas()
    assert got.groupby("video_id").size().to_dict() == Q.Tables(spark, SF).tracks.toPandas().groupby("video_id").size().to_dict()
