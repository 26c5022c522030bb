"""Operators on hand-made rows, and properties of the pure ones."""

import itertools
import math
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barkgraph.config import FROZEN, FusionConfig
from barkgraph.functions import audio
from barkgraph.functions import temporal as T
from barkgraph.functions import text as X
from barkgraph.operators import assign, evaluation, mot, profiles, runs, trackers
from barkgraph.operators import events as E
from barkgraph.operators import joins as J
from barkgraph.operators import profiles as P
from barkgraph.operators import rows as R
from barkgraph.operators import tracks as K
from barkgraph.operators.fusion import FusionState, fold, fused
from barkgraph.sources import cvat, files
from barkgraph.sources.mot import mot_lines, parse_mot


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.randoms(use_true_random=False))
def test_assignment_is_optimal(n, m, rnd):
    cost = np.array([[rnd.randint(0, 9) for _ in range(m)] for _ in range(n)], float)
    got = assign.hungarian(cost)
    assert len(got) == min(n, m) == len({i for i, _ in got}) == len({j for _, j in got})
    if n <= m:
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
    else:
        best = min(sum(cost[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
    assert sum(cost[i, j] for i, j in got) == best


def matched(a, b):
    """Total IoU of the events' assignment, and of the dense one over all pairs."""
    a, b = (np.array(x, float).reshape(-1, 2) for x in (a, b))
    b = b[np.argsort(b[:, 0], kind="stable")]
    at, columns, iou = assign._overlaps(a[:, 0], a[:, 1], b[:, 0], b[:, 1])
    shared = np.maximum(0, np.minimum(a[:, None, 1], b[None, :, 1]) - np.maximum(a[:, None, 0], b[None, :, 0]))
    dense = np.where(shared > 0, shared / np.maximum(1e-12, np.maximum(a[:, None, 1], b[None, :, 1]) - np.minimum(a[:, None, 0], b[None, :, 0])), 0)
    got = assign.sparse_assignment(at, columns, iou, len(b))
    assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) and all(dense[i, j] > 0 for i, j in got)
    return sum(dense[i, j] for i, j in got), sum(dense[i, j] for i, j in assign.hungarian(-dense))


SPANS = st.lists(st.tuples(st.integers(0, 40), st.integers(0, 12)).map(lambda x: (x[0], x[0] + x[1])), max_size=14)


@settings(max_examples=300, deadline=None)
@given(SPANS, SPANS)
def test_sparse_assignment_is_optimal(a, b):
    got, want = matched(a, b)
    assert math.isclose(got, want, abs_tol=1e-9)


def test_sparse_assignment_of_one_dense_group():
    r = np.random.default_rng(5)
    starts = np.sort(r.integers(0, 300, 240)) / 10
    a = np.column_stack([starts, starts + r.exponential(1, 240)])
    got, want = matched(a, a + [0.05, 0.08])
    assert math.isclose(got, want, abs_tol=1e-7)


def test_empty_assignment():
    assert assign.hungarian(np.zeros((0, 3))) == []


@settings(max_examples=80, deadline=None)
@given(st.floats(0, 100), st.floats(0, 12))
def test_window_starts_by_rule(start, length):
    """The rule that the column expression follows."""
    end = start + length
    starts = [start] if end - 2 <= start + 1e-6 else [start + i for i in range(math.floor(end - 2 - start + 1e-6) + 1)]
    if len(starts) > 1 and starts[-1] < end - 2 - 1e-6:
        starts.append(end - 2)
    assert starts[0] == start and (length <= 2 or starts[-1] + 2 >= end - 1.0)


def test_window_starts(spark):
    df = spark.createDataFrame([(0.0, 1.5), (0.0, 2.0), (0.0, 4.0), (1.0, 4.5)], "s double, e double")
    got = [r[0] for r in df.select(T.window_starts(F.col("s"), F.col("e"))).collect()]
    assert got == [[0.0], [0.0], [0.0, 1.0, 2.0], [1.0, 2.0, 2.5]]


def test_evenly(spark):
    got = spark.range(1).select(*[T.evenly(F.lit(n).cast("long"), F.lit(k)).alias(f"c{n}_{k}") for n, k in ((1, 5), (3, 5), (10, 4), (7, 1))]).first()
    assert [list(x) for x in got] == [[0], [0, 1, 2], [0, 3, 6, 9], [0]]


def test_points_in_intervals_keep_both_ends(spark):
    p = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.5), (2, 1.5)], "k int, t double")
    i = spark.createDataFrame([(1, 1.0, 2.0, "a"), (1, 2.0, 2.0, "b"), (1, 3.0, 1.0, "c")], "k int, s double, e double, n string")
    got = sorted((r.t, r.n) for r in J.points_in_intervals(p, i, ["k"], "t", "s", "e").collect())
    assert got == [(1.0, "a"), (2.0, "a"), (2.0, "b")]


def test_nearest_prefers_the_smaller_frame(spark):
    q = spark.createDataFrame([(1, 10), (1, 30)], "k int, at long")
    r = spark.createDataFrame([(1, 8), (1, 12), (1, 36)], "k int, frame long")
    assert [(x.at, x.frame) for x in J.nearest(q, r, ["k"], "at", "frame", 5, ["k", "at"]).collect()] == [(10, 8)]


def test_interpolation_cases(spark):
    rows = spark.createDataFrame([(1, f, float(f), 0.0, f + 10.0, 10.0) for f in (10, 14, 100)], "k int, frame long, x1 double, y1 double, x2 double, y2 double")
    q = spark.createDataFrame([(1, a) for a in (10, 12, 16, 50, 99, 7, 200)], "k int, at long")
    got = {r["at"]: r.x1 for r in J.interpolated(q, rows, ["k"], "at", "frame", 4).collect()}
    assert got == {10: 10.0, 12: 12.0, 16: 14.0, 50: None, 99: 100.0, 7: 10.0, 200: None}


def test_islands_and_suffixes(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 1, 9, 1, None, 1])], "k int, i int, v int")
    got = R.islands(df, ["k"], "i", F.col("v") < 5).groupBy("island").count().orderBy("island").collect()
    assert [r["count"] for r in got] == [2, 1, 1]
    ids = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, n int")
    assert sorted(r.id for r in R.suffixed_ids(ids, "id", [F.col("n")]).collect()) == ["a", "a__2", "b"]


def decisions(spark, rows):
    schema = "video_id long, l long, r long, pair_decision string, priority int, primary_score double, secondary_score double, nearest_frame_gap long, nearest_time_gap_sec double, blocks boolean"
    return spark.createDataFrame(rows, schema)


def test_merge_veto_and_part_exception(spark):
    tracks = spark.createDataFrame([(0, t) for t in (1, 2, 3, 4)], "video_id long, track_id long")
    reid, part = "candidate_fragment_reid", "candidate_part_based_duplicate"
    rows = [
        (0, 1, 2, reid, 1, 0.9, -1.0, 5, 0.5, False),
        (0, 2, 3, reid, 1, 0.8, -1.0, 5, 0.5, False),  # 1 and 3 block each other
        (0, 1, 3, "blocked_simultaneous_different_dogs", None, None, None, 0, 0.0, True),
        (0, 3, 4, reid, 1, 0.7, -1.0, 5, 0.5, False),
    ]
    m = profiles.merged(decisions(spark, rows), tracks)
    assert m.first().labels == {1: 1, 2: 1, 3: 3, 4: 3}
    rows[1] = (0, 2, 3, part, 3, 0.95, -0.1, 5, 0.5, False)
    # the part-based candidate comes first and is free of the veto, which then keeps 1 from the cluster of 3
    assert profiles.merged(decisions(spark, rows), tracks).first().labels == {1: 1, 2: 2, 3: 2, 4: 2}
    rows[1] = (0, 1, 3, part, 3, 0.95, -0.1, 5, 0.5, True)
    assert profiles.merged(decisions(spark, rows[:2] + rows[3:]), tracks).first().labels == {1: 1, 2: 1, 3: 1, 4: 1}


def test_video_without_candidates(spark):
    tracks = spark.createDataFrame([(0, 1), (0, 2)], "video_id long, track_id long")
    r = profiles.merged(decisions(spark, []), tracks).first()
    assert r.labels == {1: 1, 2: 2} and r.merges == []


def test_one_row_track_is_not_sparse(spark):
    from barkgraph.operators.tracks import quality

    t = spark.createDataFrame([(0, 1, 5, 0.5, 0.0, 0.0, 4.0, 3.0, 1.0)], "video_id long, track_id long, frame long, time_sec double, x1 double, y1 double, x2 double, y2 double, confidence double")
    r = quality(t, FROZEN).first()
    assert (r.observation_density, r.sparse_suspect, r.median_box_diagonal) == (1.0, False, 5.0)


def test_fusion_decisions():
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [
        (0, 1, 0.0, 0.1, "dog_1", a),
        (0, 2, 0.0, 9.0, None, a),
        (0, 3, 1.0, 2.0, "dog_1", a),
        (0, 4, 2.0, 3.0, None, a),
        (0, 5, 3.0, 4.0, None, b),
        (0, 6, 4.0, 5.0, "dog_2", b),
        (0, 7, 5.0, 6.0, "dog_1", None),
    ]
    got = fold(rows, FusionState(FusionConfig()))
    assert [g[9] for g in got] == [
        "visible_profile_audio_not_scored", "unassigned_audio_not_scored", "attached_to_visible_all_dog_profile", "offscreen_matched_existing_profile_by_audio",
        "created_offscreen_audio_only_profile", "audio_visual_identity_conflict", "empty_audio_clip",
    ]
    assert got[3][4] == "dog_1" and got[4][4] == "audio_only_dog_1" and got[6][4] == "dog_1"


def test_perfect_tracker_scores_full(spark):
    rows = [(1, f, i, 10.0 * f + 100 * i, 5.0, 20.0, 20.0) for f in range(6) for i in range(3)]
    df = spark.createDataFrame(rows, "sequence long, frame long, id long, x double, y double, w double, h double")
    for r in mot.metrics(mot.statistics(df, df)).collect():
        assert (r.HOTA, r.DetA, r.AssA, r.MOTA, r.IDF1, r.fp, r.fn, r.idsw) == (100.0, 100.0, 100.0, 100.0, 100.0, 0, 0, 0)


def test_identity_switch_counts():
    truth = pd.DataFrame([(f, 1, 0.0, 0.0, 10.0, 10.0) for f in range(4)], columns=["frame", "id", "x", "y", "w", "h"])
    guess = truth.assign(id=[7, 7, 8, 8])
    s = mot.sequence_stats(truth, guess)
    assert (s["idsw"], s["clear_tp"], s["idtp"], s["idfp"], s["idfn"]) == (1, 4, 2, 2, 2)


@pytest.mark.parametrize("method", sorted(trackers.METHODS))
def test_trackers_hold_two_apart(method):
    t = trackers.METHODS[method]()
    seen = []
    for f in range(8):
        boxes = np.array([[10.0 + 2 * f, 0, 40 + 2 * f, 30], [200.0 - 2 * f, 0, 230 - 2 * f, 30]])
        seen.append(dict(t.step(boxes, np.array([0.9, 0.9]), None)))
    assert seen[-1][0] != seen[-1][1] and all(s.get(k, seen[-1][k]) == seen[-1][k] for s in seen for k in (0, 1))


def test_appearance_recovers_an_id(spark):
    a, b = [3.0, 0.0, 4.0], [0.0, 2.0, 0.0]
    rows = [(0, f, 10.0, 0.0, 40.0, 30.0, 0.9, a) for f in range(5)] + [(0, f, 400.0, 0.0, 430.0, 30.0, 0.9, b if f != 3 else None) for f in range(12)]
    rows += [(0, f, 120.0, 90.0, 150.0, 120.0, 0.9, a) for f in range(9, 12)]  # the first one, elsewhere after four frames unseen
    df = spark.createDataFrame(rows, "video_id long, frame long, x1 double, y1 double, x2 double, y2 double, confidence double, v array<double>")
    for method, vector, same in (("botsort", "v", True), ("stable", "v", True), ("botsort", None, False), ("bytetrack", "v", False), ("bytetrack", None, False)):
        got = trackers.tracked(df, method, vector).collect()
        ids = {(r.frame, r.x1): r.track_id for r in got}
        assert len(got) == len(rows) and len({i for (_, x), i in ids.items() if x == 400.0}) == 1, method
        assert len({ids[f, 10.0] for f in range(5)} | {ids[f, 120.0] for f in range(9, 12)}) == (1 if same else 2), method


def test_detections_without_a_vector_are_weighed_by_overlap():
    for make in (trackers.BotSort, trackers.Stable):
        t = make()
        boxes = np.array([[0.0, 0, 30, 30], [200.0, 0, 230, 30]])
        first = dict(t.step(boxes, np.array([0.9, 0.9]), np.zeros((2, 3))))
        assert dict(t.step(boxes + [8, 0, 8, 0], np.array([0.9, 0.9]), np.array([[1.0, 0, 0], [0, 1, 0]]))) == first
        assert all(np.isclose(np.linalg.norm(x.feature), 1) for x in t.tracks)


def test_mot_parsing(spark):
    lines = ["0\t1,,1,2,3,4,0.5", "0,1,9,9,9,9,0.9", "1,1,1,2,3,4", ""]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "file string, row_no int, value string")
    got = sorted((r.frame, r.id, r.x, r.conf, r.vis) for r in parse_mot(df).collect())
    assert got == [(1, 1, 9.0, 0.9, 1.0), (2, 1, 1.0, 1.0, 1.0)]
    named = spark.createDataFrame([("f", 0, "1,b,1,1,1,1"), ("f", 1, "1,a,1,1,1,1"), ("f", 2, "2,b,1,1,1,1")], "file string, row_no int, value string")
    assert sorted((r.frame, r.id) for r in parse_mot(named).collect()) == [(1, 1), (1, 2), (2, 1)]
    with pytest.raises(Exception, match="fewer than six"):
        parse_mot(spark.createDataFrame([("f", 0, "1,2,3")], "file string, row_no int, value string")).collect()


def test_mot_lines(spark):
    df = spark.createDataFrame([(3, 7, 1, 2, 11, 22)], "frame long, track_id long, x1 long, y1 long, x2 long, y2 long")
    assert mot_lines(df, truth=True).first().value == "3,7,1,2,10,20,1,1,1"


XML = """<annotations><track id="4" label="Dog"><box frame="0" xtl="1" ytl="2" xbr="3" ybr="4" outside="0"><attribute name="vocalization">Barking</attribute></box>
<box frame="1" xtl="1" ytl="2" xbr="3" ybr="4" outside="1"/></track><track id="5" label="cat"><box frame="2" xtl="1" ytl="2" xbr="3" ybr="4" outside="0"/></track></annotations>"""


def test_cvat(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    tracks = cvat.read_cvat(spark, str(tmp_path))
    assert sorted((r.ident, r.frame, r.state) for r in cvat.boxes(tracks, offset=10).collect()) == [("4", 10, "barking"), ("5", 12, "")]
    assert [(r.frame, r.track_id) for r in cvat.truth_rows(tracks).collect()] == [(1, 4)]
    with pytest.raises(ValueError):
        cvat.barking_boxes(tracks, "Howling")


def test_tolerant_sources(spark, tmp_path):
    assert files.read_csv(spark, f"{tmp_path}/none.csv", "a long, b string", tolerant=True).count() == 0
    (tmp_path / "x.csv").write_text("B,a\nq,1\n,z\n")
    assert [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/x.csv", "a long, b string").collect()] == [(1, "q"), (None, None)]
    (tmp_path / "l.json").write_text('[{"a": 1}, 5, {"a": 2}]')
    assert sorted(r.a for r in files.read_json_list(spark, f"{tmp_path}/l.json", "a long").collect()) == [1, 2]
    (tmp_path / "o.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="not a JSON list"):
        files.read_json_list(spark, f"{tmp_path}/o.json", "a long").collect()


def test_clip_of_event(spark):
    ev = spark.createDataFrame([("bark_3",), ("bark_012",), ("none",)], "event_id string")
    clips = spark.createDataFrame([("03",), ("3",), ("012",)], "folder string")
    assert sorted((r.event_id, r.folder) for r in cvat.clip_of(ev, clips).collect()) == [("bark_012", "012"), ("bark_3", "03")]


def test_model_stage_is_deterministic(spark):
    from barkgraph.operators.models import HashEncoder, encoded

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, k string")
    one, two = ({r.id: r.v for r in encoded(df.repartition(n), ["id", "k"], HashEncoder).collect()} for n in (1, 3))
    assert one == two and abs(sum(x * x for x in one[1]) - 1) < 1e-9


# --- filters and trackers as computed by hand --------------------------------------------------------------------

def at(x, size=30.0):
    return np.array([x - size / 2, 0.0, x + size / 2, size])


def test_shape_filter_by_hand():
    """The first correction has no weight; then gains 1/2 and 1.51/2.51, and 0.01/2.51 for the velocity."""
    t = trackers._Track(1, trackers.ShapeFilter(at(25)), at(25), None)
    t.see(at(99), None)
    assert t.filter.state[0] == 25
    for x, want, speed in ((27, 26.0, 0.0), (29, 26 + 3 * 1.51 / 2.51, 3 * 0.01 / 2.51)):
        t.predict()
        t.see(at(x), None)
        assert abs(t.filter.state[0] - want) < 1e-9 and abs(t.filter.state[4] - speed) < 1e-9
    assert np.allclose(t.filter.box()[[1, 3]], [0, 30])


def test_size_filter_waits_for_a_prediction():
    f = trackers.SizeFilter(at(10))
    f.correct(f.measure(at(50)))
    assert f.state[0] == 10
    f.predict()
    f.correct(f.measure(at(50)))
    assert abs(f.state[0] - (10 + 40 * 0.5 / 0.55)) < 1e-9  # its spread is gone after the first correction


def test_sort_counts_hits_in_a_row():
    t, one = trackers.Sort(), np.array([0.9])
    out = [t.step(at(10 + f)[None] if f not in (6, 7) else np.zeros((0, 4)), one if f not in (6, 7) else np.zeros(0), None, f) for f in range(12)]
    assert [len(x) for x in out] == [1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 1, 1]  # seen again after two frames, it needs three in a row
    assert {i for x in out for _, i in x} == {1}


def test_thresholds_of_the_two_stage_trackers():
    boxes = np.array([at(0), at(200), at(400), at(600)])
    assert [i for i, _ in trackers.Byte().step(boxes, np.array([0.75, 0.65, 0.3, 0.05]), None)] == [0]
    assert [i for i, _ in trackers.BotSort().step(boxes, np.array([0.75, 0.65, 0.3, 0.05]), None)] == [0, 1]
    t = trackers.Byte()
    t.step(boxes[:1], np.array([0.9]), None)
    assert t.step(boxes[:1] + 2, np.array([0.2]), None) == [(0, 1)]  # a weak box keeps a track


def test_stable_ids_follow_the_detector_while_boxes_overlap():
    t, score = trackers.Stable(), np.array([0.9])
    assert t.step(at(0)[None], score, None, 1, [7]) == [(0, 1)]
    assert t.step(at(5)[None], score, None, 2, [7]) == [(0, 1)]
    assert t.step(at(500)[None], score, None, 3, [7]) == [(0, 2)]  # the detector's id jumped to another place
    assert t.step(np.array([at(500), at(6)]), np.array([0.9, 0.9]), None, 4, [7, 8]) == [(0, 2), (1, 1)]
    a = np.array([[1.0, 0.0]])
    t = trackers.Stable()
    t.step(at(0)[None], score, a, 1, [1])
    t.step(np.zeros((0, 4)), np.zeros(0), np.zeros((0, 2)), 40, [])
    assert t.lost and t.step(at(300)[None], score, a, 41, [2]) == [(0, 1)]  # lost, and found by its looks


# --- merging, gaps, brackets -------------------------------------------------------------------------------------

@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.booleans()), max_size=25), st.sets(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=12))
def test_partition_as_labels(joins, blocked):
    """Union-find with vetoes gives what plain relabelling gives."""
    blocked = {(a, b) for a, b in blocked if a != b}
    state, label = P.Partition(blocked), {x: x for x in range(10)}
    for a, b, free in joins:
        la, lb = label[a], label[b]
        across = any({label[x], label[y]} == {la, lb} for x, y in blocked) if la != lb else False
        ra, rb = state.find(a), state.find(b)
        assert (ra != rb) == (la != lb) and (ra == rb or state.apart(ra, rb) == across)
        if la != lb and (free or not across):
            state.join(ra, rb)
            label = {x: min(la, lb) if v in (la, lb) else v for x, v in label.items()}
    assert all(state.label(x) == v for x, v in label.items())


def test_frame_gaps_as_all_pairs(spark):
    rnd = np.random.default_rng(3)
    rows = sorted({(v, int(t), int(f)) for v in range(2) for t in range(6) for f in rnd.choice(60, 8) + 25 * (t % 3)})
    df = spark.createDataFrame([(v, t, f, 0.0, 0.0, 1.0, 1.0) for v, t, f in rows], "video_id long, track_id long, frame long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.video_id, r.l, r.r): r.nearest_frame_gap for r in K.frame_gaps(df).collect()}
    want = {}
    for v, t, f in rows:
        for w, u, g in rows:
            if v == w and t < u:
                want[v, t, u] = min(want.get((v, t, u), 999), abs(f - g))
    assert got == want


def test_brackets_are_linear(spark):
    """One key with many rows and questions ends in time, and both neighbours are right."""
    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 4).alias("frame"), F.col("id").cast("double").alias("v"))
    asks = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("q"), (F.col("id") * 4 + F.col("id") % 4).alias("at"))
    began = time.monotonic()
    got = J.bracketed(asks, rows, ["k"], "at", "frame", ["v"])
    wrong = got.where("prev.frame <> at - at % 4 or coalesce(next.frame, -1) <> case when at % 4 = 0 then at when at > 4 * 99999 then -1 else at - at % 4 + 4 end")
    assert wrong.count() == 0 and time.monotonic() - began < 60


# --- inputs, runs, features --------------------------------------------------------------------------------------

def test_evaluators_inputs(spark):
    raw = spark.createDataFrame([(5, "7", "1.5", "2"), (6, "x", "1", "2"), (9, "8", "", "3"), (200_001, "9", "4", "5")], "n long, predicted_track_id string, start_time_sec string, end_time_sec string")
    got = sorted((r.event_id, r.pred_track_id, r.start, r.end) for r in evaluation.localized_predictions(raw, "n").collect())
    assert got == [("event_000000", 7, 1.5, 2.0), ("event_000003", 9, 4.0, 5.0)]
    kept = evaluation.event_predictions(raw.withColumnRenamed("n", "Bark_ID").where("start_time_sec <> ''")).collect()
    assert [(r.event_id, r.predicted_track_id, r.status) for r in sorted(kept, key=lambda r: r.event_id)] == [("200001", 9.0, "predicted"), ("5", 7.0, "predicted"), ("6", None, "predicted")]
    with pytest.raises(KeyError):
        evaluation.event_predictions(raw)
    a = spark.createDataFrame([(0, 1.0, 2.0, "d")], "n long, start double, end double, dog_id string")
    a, b = evaluation.identity_events(a, "gt", evaluation.DOG, "n"), evaluation.identity_events(a.withColumn("video", F.lit("v1")), "pred", evaluation.DOG, "n")
    assert [r.video_id for r in evaluation.same_video(a, b).collect()] == ["v1"] == [r.video_id for r in evaluation.same_video(b, a).collect()]
    two = b.unionByName(b.withColumn("video_id", F.lit("v2")))
    assert [r.video_id for r in evaluation.same_video(a, two).collect()] == [evaluation.SINGLE]


def test_rows_are_numbered_across_classes(spark):
    df = spark.range(1000).select((F.col("id") * 977 % 10007).alias("n"))
    got = [r.i for r in R.numbered(df, "n", "i", 100).orderBy("n").collect()]
    assert got == list(range(1000))


def test_json_text(spark):
    import json

    values = [0.0, 1.0, 0.25, 0.00005, 0.00012345, 1e-8, 0.123456789, 12.5, -0.5]
    df = spark.createDataFrame([(values, [("12", 0.5), ("3", 0.000012)])], "v array<double>, m array<struct<k:string,v:double>>")
    r = df.select(X.json_list(F.col("v")).alias("a"), X.json_map(F.col("m")).alias("b")).first()
    assert r.a == json.dumps([round(x, 8) for x in values]) and r.b == json.dumps({"12": 0.5, "3": 0.000012}, sort_keys=True)


def test_drawn_boxes(spark):
    t = spark.createDataFrame([(0, 1, f, float(f), 0.0, f + 10.0, 10.0) for f in (5, 9, 40)], "video_id long, track_id long, frame long, x1 double, y1 double, x2 double, y2 double")
    shown = spark.createDataFrame([(0, 6, 3, 1), (0, 7, 3, 1)], "video_id long, frame long, event_id long, predicted_track_id long")
    scores = spark.createDataFrame([(0, 3, 1, 0.75)], "video_id long, event_id long, track_id long, mean_score double")
    got = {r.frame: r for r in evaluation.draw_list(t, shown, scores, 3, 42, 100, 100).collect()}
    assert sorted(got) == [2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 37, 38, 39, 40, 41]
    assert [got[f].x1 for f in (2, 5, 7, 12, 37, 41)] == [5, 5, 7, 9, 40, 40]
    assert (got[6].label, got[6].winner, got[6].line, got[5].label, got[7].line) == ("BARKING | dog #1 | 0.750", True, 2, "dog #1", 2)


def test_runs_resume_reuse_and_isolate(spark):
    items = spark.createDataFrame([(i, f"/v{i}", 10, 5) for i in range(4)], "item long, path string, size_bytes long, mtime_ns long")
    past = items.where("item < 3").withColumn("mtime_ns", F.when(F.col("item") == 1, 6).otherwise(5).cast("long")).withColumn("status", F.when(F.col("item") == 2, "failed").otherwise("complete"))
    assert {r.item: r.reusable for r in runs.reusable(items, past, ["item"]).collect()} == {0: True, 1: False, 2: False, 3: False}
    assert {r.item for r in runs.remaining(items, past, ["item"]).collect()} == {3}
    assert runs.remaining(items, past, ["item"], force=True).count() == 4

    def broken(pdf):
        if pdf["item"].iloc[0] == 2:
            raise RuntimeError("no frames")
        return pdf[["item"]].assign(n=len(pdf))

    out = runs.isolated(items, ["item"], broken, "item long, n long")
    assert {r.item for r in runs.results(out).collect()} == {0, 1, 3}
    assert [tuple(r) for r in runs.failures(out, ["item"]).collect()] == [(2, "RuntimeError", "no frames")]
    stage = runs.Stage("copy", {"largest": F.max("item")})
    assert stage.run(items, lambda df: df.write.format("noop").mode("overwrite").save()) | {"seconds": 0} == {"stage": "copy", "status": "complete", "error": None, "rows": 4, "largest": 3, "seconds": 0}
    with pytest.raises(ZeroDivisionError):
        stage.run(items, lambda df: 1 / 0)
    assert (stage.record["status"], stage.record["error"]) == ("failed", "ZeroDivisionError")


def test_features_of_many_waves_are_made_few_at_a_time(spark):
    waves = [pd.Series([np.arange(3.0) + i for i in range(150)] + [None]), pd.Series([[1.0, 2.0]])]
    made = list(audio._vectors(audio.mfcc).func(iter(waves)))
    assert max(map(len, made)) <= audio.AT_ONCE and sum(map(len, made)) == 152
    whole = [x for part in made for x in part]
    assert whole[150] is None and np.allclose(whole[149], audio.mfcc(np.arange(3.0) + 149)) and np.allclose(whole[151], audio.mfcc([1.0, 2.0]))


def test_spectra_as_plain_sums(spark):
    rnd = np.random.default_rng(1)
    wave = np.sin(np.arange(4000) * 0.3) + 0.1 * rnd.normal(size=4000)
    power = audio.mel_power(wave, 16000, 400, 160, 80)
    padded, k = np.pad(wave, 200), np.arange(201)[:, None] * np.arange(400)[None] / 400
    hann = 0.5 * (1 - np.cos(2 * np.pi * np.arange(400) / 400))
    frame = padded[160 * 7 : 160 * 7 + 400] * hann
    spectrum = np.abs((frame * np.exp(-2j * np.pi * k)).sum(axis=1)) ** 2
    assert power.shape == (80, 26) and np.allclose(power[:, 7], audio.mel_filters(16000, 400, 80) @ spectrum)
    loudest = np.fft.rfftfreq(400, 1 / 16000)[spectrum.argmax()]
    filters = audio.mel_filters(16000, 400, 80)
    assert abs(np.fft.rfftfreq(400, 1 / 16000)[filters[power[:, 7].argmax()].argmax()] - loudest) < 100
    x = audio.log_mel(wave)
    assert x.shape == (200, 80) and x[:26].max() == 0 and (x[26:] == 0).all() and x.min() >= -80
    assert audio.log_mel(np.tile(wave, 20)).shape == (200, 80) and audio.mfcc(wave).shape == (80,)
    df = spark.createDataFrame([(wave.tolist(),), ([],), (None,)], "w array<double>")
    got = [r.m for r in df.select(audio.mfcc_column(F.col("w")).alias("m")).collect()]
    assert np.allclose(got[0], audio.mfcc(wave)) and got[1:] == [None, None]
    r = df.limit(1).select(audio.peak_normalized(F.col("w")).alias("p"), audio.time_slice(F.col("w"), F.lit(-1.0), F.lit(0.01), F.lit(16000.0)).alias("s")).first()
    assert abs(max(map(abs, r.p)) - 1) < 1e-6 and r.s == wave[:160].tolist()


def test_video_metadata_and_embeddings(spark, tmp_path):
    from barkgraph.sources.files import checked_meta, video_meta, write_embeddings

    v = spark.createDataFrame([(1, 25.0, 640, 480, 100), (2, 0.0, 640, 480, 100), (3, None, 1, 1, 1)], "video_id long, fps double, width int, height int, frames long")
    assert [(r.valid, r.duration_sec) for r in video_meta(v).orderBy("video_id").collect()] == [(True, 4.0), (False, None), (False, None)]
    with pytest.raises(Exception, match="invalid video metadata of 2"):
        checked_meta(v).where("video_id = 2").collect()
    e = spark.createDataFrame([(1, 4, [0.5, 1.0])], "video_id long, track_id long, v array<double>")
    write_embeddings(e, f"{tmp_path}/e")
    assert [(r.video_id, r.name, r.vector) for r in spark.read.parquet(f"{tmp_path}/e").collect()] == [(1, "track_4", [0.5, 1.0])]


def test_a_pair_of_intervals_is_met_once_whatever_its_order(spark):
    rows = [("v", 1, 5.0, 6.0), ("v", 2, 4.0, 5.0), ("v", 3, 4.0, 9.0), ("v", 4, 7.5, 7.5), ("w", 5, 4.0, 9.0), ("v", 6, 4.0, 5.0)]
    got = sorted((r.a, r.b) for r in J.meeting(spark.createDataFrame(rows, "video_id string, id long, s double, e double"), ["video_id"], "id", "s", "e", 0.25).collect())
    same = [(a, b) for (v, a, s, e), (w, b, t, f) in itertools.product(rows, rows) if v == w and a < b and s <= f and t <= e]
    assert got == sorted(same)


def test_assignment_makes_pairs_when_it_looks_at_them():
    asked = []
    table = [([0, 1], [3.0, 2.0]), ([0], [2.5]), ([2], [1.0])]

    def edges(i):
        asked.append(i)
        return np.array(table[i][0]), np.array(table[i][1])

    assert assign.assigned(edges, 3, 3) == [(0, 1), (1, 0), (2, 2)] and set(asked) == {0, 1, 2}


def test_what_many_ask_is_looked_for_once(spark):
    asks = spark.range(2000).selectExpr("id", "id % 2 as k", "10L as at")
    rows = spark.createDataFrame([(0, 8, 1.0), (0, 11, 2.0), (1, 30, 3.0)], "k long, frame long, v double")
    near = J.nearest(asks, rows, ["k"], "at", "frame", 5, ["id", "at"])
    assert {(r.id % 2, r.frame) for r in near.collect()} == {(0, 11)} and near.count() == 1000
    both = J.bracketed(asks, rows, ["k"], "at", "frame", ["v"])
    assert {(r.k, r.prev and r.prev.frame, r.next and r.next.frame) for r in both.collect()} == {(0, 8, 11), (1, None, 30)} and both.count() == 2000
    sorts = both._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in sorts and "Aggregate" in sorts[sorts.index("Window") :]  # what is sorted within a key was made distinct before


def test_frames_with_several_times_are_visible_once(spark):
    tracks = spark.createDataFrame([(0, 1, 5, 0.5), (0, 1, 5, 0.7), (0, 1, 6, 9.0), (0, 2, 7, 0.6), (0, 2, None, 0.6), (0, 3, None, 0.6)], "video_id long, track_id long, frame long, time_sec double")
    events = spark.createDataFrame([(0, 1, 0.4, 0.8), (0, 2, 0.6, 0.6), (0, 3, 0.0, 100.0), (0, 4, 0.8, 0.4)], "video_id long, event_id long, start double, end double")
    out = E.visibility(tracks, events, F.lit(10.0))
    assert {(r.event_id, r.track_id): r.visible_frames for r in out.collect()} == {(1, 1): 1, (1, 2): 1, (1, 3): 0, (2, 2): 1, (2, 3): 0, (3, 1): 2, (3, 2): 1, (3, 3): 0}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(video_id#" in plan and ", event_id#" not in "".join(line for line in plan.splitlines() if "hashpartitioning(" in line and "start" not in line)


def test_a_video_longer_than_a_batch_is_fused_in_order(spark):
    rows = [(v, e, float(e % 7), e % 7 + 1.0, "dog_1" if e % 3 else None, [1.0 + (v or 0), 0.1 * (e % 11)]) for v in (0, 1, None) for e in range(300)]
    events = spark.createDataFrame(rows, "video_id long, event_id long, start double, end double, visual_profile string, vector array<double>")
    want = sorted(fold(sorted((r for r in rows if r[0] == 0), key=lambda r: (r[2], r[3], r[1])), FusionState(FusionConfig())))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = fused(events)
        assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
        got = [tuple(r) for r in got.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r for r in got if r[0] == 0) == want and len(got) == 900


def test_equal_intervals_cost_no_more_than_one():
    r = np.random.default_rng(8)
    starts = np.sort(r.integers(0, 80, 70)) / 10
    s, e = starts, starts + r.exponential(1, 70)
    plain, calls = assign._meeting(s, e, s + 0.05, e + 0.08), []
    edges = lambda i: (calls.append(i), plain(i))[1]
    one = assign.assigned(edges, 70, 70)
    asked = len(calls)
    many = assign.carried(edges, np.full(70, 50), np.full(70, 50))
    assert many == [(i, j, 50) for i, j in one] and len(calls) == 2 * asked > 140


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=4, max_size=4), max_size=4), st.lists(st.integers(1, 4), min_size=8, max_size=8))
def test_carried_pairs_as_those_of_each_alone(gain, counts):
    g = np.array(gain, float).reshape(-1, 4)
    supply, demand = np.array(counts[: len(g)], int), np.array(counts[4:])
    got = assign.carried(lambda i: (np.flatnonzero(g[i]), g[i][g[i] > 0]), supply, demand)
    alone = np.repeat(np.repeat(g, supply, 0), demand, 1)
    assert sum(g[i, j] * k for i, j, k in got) == sum(alone[i, j] for i, j in assign.hungarian(-alone))
    assert all(sum(k for i, _, k in got if i == x) <= n for x, n in enumerate(supply)) and all(sum(k for _, j, k in got if j == x) <= n for x, n in enumerate(demand))


def test_copies_of_events_are_matched_each(spark):
    rows = [(1, 0, 1.0, 3.0), (1, 1, 1.5, 3.5), (1, 2, 1.4, 2.0), (2, 3, 1.0, 3.0)]
    truth = spark.createDataFrame([(v, i + 10 * k, s, e) for v, i, s, e in rows for k in range(5)], "video_id long, id long, start double, end double")
    guess = truth.where("id <> 41").select("video_id", (F.col("id") + 100).alias("id"), (F.col("start") + 0.25).alias("start"), "end")
    got = assign.matched_events(truth, guess).collect()
    assert len({r.gt_id for r in got}) == len({r.pred_id for r in got}) == len(got) == 19
    t, g = ([r for r in df.collect() if r.video_id == 1] for df in (truth, guess))
    iou = np.array([[max(0, min(a.end, b.end) - max(a.start, b.start)) / (max(a.end, b.end) - min(a.start, b.start)) for b in g] for a in t])
    assert math.isclose(sum(r.iou for r in got if r.video_id == 1), sum(iou[i, j] for i, j in assign.hungarian(-iou)), abs_tol=1e-9)


def test_equal_intervals_meet_as_one_row(spark):
    """What is measured, and read by the join, goes with the different intervals; the pairs are those of all."""
    few = [("v", 0.0, 2.0), ("v", 1.0, 3.0), ("v", 1.0, 2.5), ("w", 0.0, 2.0), ("v", 2.0, 2.0)]
    rows = [(v, 10 * k + i, s, e) for i, (v, s, e) in enumerate(few) for k in range(7)]
    measured = spark.sparkContext.accumulator(0)
    length = F.udf(lambda s, e, t, f: (measured.add(1), min(e, f) - max(s, t))[1], "double").asNondeterministic()
    got = J.meeting(spark.createDataFrame(rows, "video_id string, id long, s double, e double"), ["video_id"], "id", "s", "e", 0.25, lambda *ends: length(*ends))
    want = {(a, b): min(e, f) - max(s, t) for (v, a, s, e), (w, b, t, f) in itertools.product(rows, rows) if v == w and a < b and s <= f and t <= e}
    pairs = got.collect()
    assert {(r.a, r.b): r.value for r in pairs} == want and len(pairs) == len(want) == 399 and measured.value <= 15
