"""Runs that fail in part, go on where they stopped, and replace what was there."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import barkgraph.queries as Q
from barkgraph.operators import assign, fusion, profiles, runs, trackers
from barkgraph.sources import files

SF = "/root/testdata/sf0.001"
BAD = 3


def split(isolated, key="video_id"):
    """Results and failures, from one run of the stage."""
    rows = isolated.collect()
    names = [c for c in isolated.columns if c not in ("error", "details")]
    return [{c: r[c] for c in names} for r in rows if r.error is None], [(r[key], r.error, r.details) for r in rows if r.error is not None]


def listed(df):
    return [r.asDict() for r in df.collect()]


def alike(got, want):
    sort = lambda rows: sorted(repr(sorted(r.items())) for r in rows)
    assert sort(got) == sort(want) and want


def others(df):
    return listed(df.where(F.col("video_id") != BAD))


@pytest.mark.parametrize("method, vector, detector", [("stable", "v", "track_id"), ("sort", None, None), ("bytetrack", None, None), ("botsort", "v", None)])
def test_a_poisoned_video_leaves_the_other_tracks(spark, method, vector, detector):
    seen = Q._seen(Q.Tables(spark, SF)).where("frame < 400")
    poison = seen.withColumn("frame", F.when((F.col("video_id") != BAD) | (F.col("frame") > 50), F.col("frame")))  # frames that are null
    good, bad = split(trackers.tracked(poison, method, vector, detector, isolate=True))
    alike(good, others(trackers.tracked(seen, method, vector, detector)))
    assert [b[:2] for b in bad] == [(BAD, "ValueError")]
    with pytest.raises(Exception, match="ValueError"):
        trackers.tracked(poison, method, vector, detector).count()


def test_a_poisoned_video_leaves_the_other_fusions(spark):
    rows = [(v, e, float(e), e + 1.0, "dog_1" if e % 2 else None, [1.0, 0.1 * e] if v != BAD or e < 3 else [1.0]) for v in range(5) for e in range(6)]
    events = spark.createDataFrame(rows, "video_id long, event_id long, start double, end double, visual_profile string, vector array<double>")
    good, bad = split(fusion.fused(events, isolate=True))
    alike(good, listed(fusion.fused(events.where(F.col("video_id") != BAD))))
    assert [b[:2] for b in bad] == [(BAD, "ValueError")]


def test_a_poisoned_video_leaves_the_other_merges(spark):
    t = Q.Tables(spark, SF)
    wrong = t.decisions.withColumn("r", F.when((F.col("video_id") == BAD) & F.col("priority").isNotNull(), F.col("l")).otherwise(F.col("r")))
    good, bad = split(profiles.merged(wrong, t.tracks, isolate=True))
    alike(good, others(profiles.merged(t.decisions, t.tracks)))
    assert bad == [(BAD, "ValueError", "a pair of a track with itself")]


def test_a_poisoned_stretch_leaves_the_other_matches(spark):
    rows = [(v, e, 400.0 * e, 400.0 * e + 3) for v in range(5) for e in range(6)]
    truth = spark.createDataFrame(rows, "video_id long, id long, start double, end double")
    guess = truth.withColumn("start", F.col("start") + 1)
    wrong = guess.withColumn("end", F.when((F.col("video_id") == BAD) & (F.col("id") == 4), F.col("start") - 5).otherwise(F.col("end")))
    good, bad = split(assign.matched_events(truth, wrong, isolate=True))
    alike(good, listed(assign.matched_events(truth, guess).where(f"video_id <> {BAD} or gt_id not in (3, 4)")))
    assert [b[:2] for b in bad] == [(BAD, "ValueError")]


def test_sparse_stretches_share_a_group(spark, monkeypatch):
    """Python is called for many stretches at once, not for each; few intervals are matched as many are."""
    calls, plain = [], assign.by_group
    monkeypatch.setattr(assign, "by_group", lambda df, keys, *a, **k: (calls.append(df.select(*keys).distinct().count()), plain(df, keys, *a, **k))[1])
    rng = np.random.default_rng(3)
    rows = [(v, 4 * e + k, 1000.0 * e + 3 * k + float(rng.random()), 1000.0 * e + 3 * k + 2 + 3 * float(rng.random())) for v in range(4) for e in range(40) for k in range(e % 4 + 1)]
    truth = spark.createDataFrame(rows, "video_id long, id long, start double, end double")
    guess = truth.withColumn("start", F.col("start") - F.col("id") % 3).withColumn("end", F.col("end") + F.col("id") % 2)
    got = listed(assign.matched_events(truth, guess))
    assert got and calls == [1]
    monkeypatch.setattr(assign, "FEW", 0)
    alike(listed(assign.matched_events(truth, guess)), got)


def test_a_poisoned_video_leaves_the_other_identities(spark):
    rows = [(v, f"p{i}", f"g{(i + 1) % 3}", 5 - i) for v in range(5) for i in range(3)]
    counts = spark.createDataFrame(rows, "video_id long, profile string, identity string, n long")
    wrong = counts.unionByName(spark.createDataFrame([(BAD, None, "g1", 1)], counts.schema))
    good, bad = split(assign.aligned_identities(wrong, isolate=True))
    alike(good, others(assign.aligned_identities(counts)))
    assert [b[:2] for b in bad] == [(BAD, "TypeError")]


def test_islands_as_a_sweep(spark):
    rng = np.random.default_rng(2)
    rows = [(int(v), int(s), int(i), float(a), float(a + d)) for i, (v, s, a, d) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 2, 400), rng.integers(0, 3000, 400), rng.integers(0, 12, 400), strict=True))]
    rows.append((0, 0, 1000, 100.0, 2500.0))  # over many bins
    df = spark.createDataFrame(rows, "video_id long, side int, id long, start double, end double")
    got = {(r.video_id, r.id): r.island for r in assign.islands(df, bin_length=100.0).collect()}
    for v in range(3):
        reach = first = None
        for _, side, i, a, b in sorted((r for r in rows if r[0] == v), key=lambda r: (r[3], r[4], r[1], r[2])):
            if reach is None or a >= reach:
                first = a
            reach = b if reach is None else max(reach, b)
            assert got[v, i] == first


# --- going on ----------------------------------------------------------------------------------------------------

def stages(spark):
    """The stages that a run resumes, each over the videos at hand; `calls` counts how often a stage is started."""
    t = Q.Tables(spark, SF)
    seen = Q._seen(t).where("frame < 300")
    heard = [(v, e, float(e), e + 1.0, "dog_1" if e % 2 else None, [1.0, 0.1 * e]) for v in range(5) for e in range(6)]
    events = spark.createDataFrame(heard, "video_id long, event_id long, start double, end double, visual_profile string, vector array<double>")
    key = ["video_id"]
    return {
        "tracker": (trackers.SCHEMA, lambda items: trackers.tracked(runs.only(seen, items, key), "stable", "v", "track_id", isolate=True), lambda: trackers.tracked(seen, "stable", "v", "track_id")),
        "fusion": (fusion.SCHEMA, lambda items: fusion.fused(runs.only(events, items, key), isolate=True), lambda: fusion.fused(events)),
        "merge": (profiles.SCHEMA, lambda items: profiles.merged(runs.only(t.decisions, items, key), runs.only(t.tracks, items, key), isolate=True), lambda: profiles.merged(t.decisions, t.tracks)),
    }


@pytest.mark.parametrize("name", ["tracker", "fusion", "merge"])
def test_a_second_run_does_what_is_left(spark, tmp_path, name):
    schema, stage, whole = stages(spark)[name]
    asked = []

    def counted(items):
        asked.append(sorted(r.video_id for r in items.collect()))
        return stage(items)

    videos = spark.range(5).withColumnRenamed("id", "video_id")
    store = runs.Store(spark, f"{tmp_path}/s", ["video_id"], schema)
    assert store.results().count() == 0
    assert store.run(videos.where("video_id < 2"), counted) | {"run": 0} == {"run": 0, "complete": 2, "failed": 0, "skipped": 0}
    assert store.run(videos, counted) | {"run": 0} == {"run": 0, "complete": 3, "failed": 0, "skipped": 2}
    assert store.run(videos, counted) == {"run": None, "complete": 0, "failed": 0, "skipped": 5}
    assert asked == [[0, 1], [2, 3, 4]]
    alike(listed(store.results()), listed(whole()))
    assert store.run(videos.where("video_id = 4"), counted, force=True)["complete"] == 1
    alike(listed(store.results()), listed(whole()))


def test_failures_and_changes_are_done_again(spark, tmp_path):
    items = spark.createDataFrame([(i, f"v{i}") for i in range(4)], "item long, fingerprint string")
    broken = {2}

    def stage(todo):
        bad = set(broken)

        def one(table):
            if table["item"][0].as_py() in bad:
                raise RuntimeError("no frames")
            return table.select(["item"]).append_column("n", table["item"])

        return runs.by_group(todo.where("item <> 3"), ["item"], one, "item long, n long", isolate=True)

    store = runs.Store(spark, f"{tmp_path}/s", ["item"], "item long, n long")
    assert store.run(items, stage)["failed"] == 1
    assert [tuple(r) for r in store.failures().collect()] == [(2, "RuntimeError", "no frames")]
    assert sorted(r.item for r in store.results().collect()) == [0, 1]  # item 3 is complete, without rows
    assert sorted(r.item for r in store.remaining(items).collect()) == [2]
    broken.clear()
    changed = items.withColumn("fingerprint", F.when(F.col("item") == 0, "new").otherwise(F.col("fingerprint")))
    assert store.run(changed, stage) | {"run": 0} == {"run": 0, "complete": 2, "failed": 0, "skipped": 2}
    assert sorted(r.item for r in store.results().collect()) == [0, 1, 2] and store.failures().count() == 0


def test_a_run_cut_off_before_its_commit_counts_for_nothing(spark, tmp_path):
    items = spark.range(3).withColumnRenamed("id", "item")
    stage = lambda todo: todo.select("item", F.col("item").alias("n"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("details"))
    store = runs.Store(spark, f"{tmp_path}/s", ["item"], "item long, n long")
    stage(items).withColumn("n", F.lit(-1).cast("long")).write.parquet(f"{tmp_path}/s/rows/run=00000000000000000001-dead")
    assert store.results().count() == 0 and store.run(items, stage)["complete"] == 3
    assert sorted(r.n for r in store.results().collect()) == [0, 1, 2]


# --- replacing ---------------------------------------------------------------------------------------------------

def broken(df, column):
    return df.withColumn(column, F.when(F.rand() < 2, F.raise_error(F.lit("disk on fire")).cast("long")))


def test_a_failed_write_leaves_the_old_result(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n long, s string")
    for write, read in ((files.write_csv, lambda p: files.read_csv(spark, p, "n long, s string")), (files.write_json, lambda p: spark.read.schema(df.schema).json(p))):
        path = f"{tmp_path}/{write.__name__}"
        write(df, path)
        with pytest.raises(Exception, match="disk on fire"):
            write(broken(df, "n"), path)
        assert sorted(map(tuple, read(path).collect())) == [(1, "a"), (2, None)]
        write(read(path).where("n = 2"), path)  # what is read is replaced
        assert list(map(tuple, read(path).collect())) == [(2, None)]
    assert {x for x in os.listdir(tmp_path) if not x.endswith(".crc")} == {"write_csv", "write_json"}


def test_a_swap_that_was_cut_off_is_put_right(spark, tmp_path):
    df = spark.range(3).withColumnRenamed("id", "n")
    path = f"{tmp_path}/t"
    files.write_json(df, path)
    os.rename(path, f"{tmp_path}/.t.old")
    with pytest.raises(Exception, match="disk on fire"):
        files.write_json(broken(df, "n"), path)
    assert spark.read.json(path).count() == 3 and not os.path.exists(f"{tmp_path}/.t.old")


def test_embeddings_replace_their_own_videos(spark, tmp_path):
    e = spark.createDataFrame([(v, t, [float(v), float(t)]) for v in (1, 2) for t in (4, 5)], "video_id long, track_id long, v array<double>")
    path = f"{tmp_path}/e"
    rows = lambda: sorted((r.video_id, r.name, r.vector) for r in spark.read.parquet(path).collect())
    files.write_embeddings(e, path)
    files.write_embeddings(e.where("video_id = 2 and track_id = 4"), path)
    assert [r[:2] for r in rows()] == [(1, "track_4"), (1, "track_5"), (2, "track_4")]
    with pytest.raises(Exception, match="disk on fire"):
        files.write_embeddings(broken(e, "track_id"), path)
    assert [r[:2] for r in rows()] == [(1, "track_4"), (1, "track_5"), (2, "track_4")]
    tracks = spark.createDataFrame([(v, 1, f) for v in (1, 2) for f in (3, 1)], "video_id long, track_id long, frame long")
    files.write_tracks(tracks, f"{tmp_path}/t")
    files.write_tracks(tracks.where("video_id = 1 and frame = 3"), f"{tmp_path}/t")
    assert sorted((r.video_id, r.frame) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, 3), (2, 1), (2, 3)]
