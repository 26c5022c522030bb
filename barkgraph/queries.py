"""Registered queries: one for each operator, over tables derived from the test data, with DuckDB equivalents.

Doubles are rounded to six places on both sides. A query is a plan over Tables and, where SQL can say it, a
statement over the common table expressions of plans.fixtures."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import audio
from .functions import geometry as G
from .functions import temporal as T
from .functions import text as X
from .functions import vectors as V
from .operators import assign, evaluation, fusion, mot, runs, trackers
from .operators import events as E
from .operators import joins as J
from .operators import profiles as P
from .operators import rows as R
from .operators import scenes as S
from .operators import tracks as K
from .plans.fixtures import FPS, SECONDS, Tables, sql
from .session import ship

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{n}`"), places).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def query(name: str, oracle: str | None = None, *ctes: str):
    def add(plan: Callable[[Tables], DataFrame]):
        _QUERIES[name] = plan
        if oracle is not None:
            _ORACLES[name] = sql(oracle, *ctes)
        return plan

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistent profiles of each video, and how many merges each rule made."""
    t = Tables(spark, sf_dir)
    n = t.profiles.groupBy("video_id").agg(F.count_distinct("persistent_profile_id").alias("profiles"), F.count("*").alias("tracks"))
    why = P.merge_log(t.merged).groupBy("video_id").agg(*[F.count_if(F.col("merge_reason") == f"candidate_{k}").alias(k) for k in ("fragment_reid", "part_based_duplicate", "duplicate_overlap")])
    zeros = [F.coalesce(k, F.lit(0)).alias(k) for k in ("fragment_reid", "part_based_duplicate", "duplicate_overlap")]
    return n.join(why, "video_id", "left").select("video_id", "tracks", "profiles", *zeros)


query("FLAGSHIP_profiles_by_video", "SELECT p.video_id, count(*) AS tracks, count(DISTINCT persistent_profile_id) AS profiles, any_value(coalesce(a, 0)) AS fragment_reid, any_value(coalesce(b, 0)) AS part_based_duplicate, any_value(coalesce(c, 0)) AS duplicate_overlap FROM profiles p LEFT JOIN (SELECT video_id, count(*) FILTER (decision = 'candidate_fragment_reid') AS a, count(*) FILTER (decision = 'candidate_part_based_duplicate') AS b, count(*) FILTER (decision = 'candidate_duplicate_overlap') AS c FROM merges GROUP BY ALL) m USING (video_id) GROUP BY ALL", "profiles", "merges")(lambda t: flagship(t.spark, t.dir))


# --- sources, projections, normalisation -------------------------------------------------------------------------

@query("PRJ01_alias_columns", "SELECT l_orderkey AS track_id, l_linenumber AS frame, l_quantity AS x1 FROM lineitem")
def _(t):
    from .schema import aliased

    return aliased(t.raw("lineitem"), {"track_id": ["track_id", "track", "L_ORDERKEY"], "frame": ["frame", "l_linenumber"], "x1": ["x1", "xtl", "l_quantity"]})


@query("PRJ02_normalize_tracks", "SELECT video_id, track_id, frame, round(frame / 10.0, 6) AS time_sec, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(confidence, 6) AS confidence FROM det QUALIFY row_number() OVER (PARTITION BY video_id, track_id, frame ORDER BY det.confidence, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) = 1", "det")
def _(t):
    from .schema import normalized_tracks

    raw = t.det.select("video_id", F.col("track_id").cast("string").alias("track"), F.col("frame").cast("string").alias("frame_idx"), F.col("x1").cast("string").alias("xtl"), F.col("y1").cast("string").alias("ytl"), F.col("x2").cast("string").alias("xbr"), F.col("y2").cast("string").alias("ybr"), F.col("confidence").alias("conf"), *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")])
    last = [F.asc("confidence"), *[F.desc(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")]]
    return rounded(normalized_tracks(raw, FPS, ["video_id", "track_id", "frame"], last))


@query("PRJ03_coerce_and_drop", "SELECT CAST(event_id AS BIGINT) AS event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'x' || value ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS number FROM events WHERE event_id % 7 <> 0")
def _(t):
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("x"), F.col("value").cast("string"))).otherwise(F.col("value").cast("string"))
    return t.raw("events").select("event_id", X.number(text).alias("number")).where("number is not null")


@query("PRJ04_normalize_events", """SELECT event_id, video_id, "start", least("end", 200.0) AS "end" FROM (SELECT CASE WHEN k = 1 THEN id ELSE id || '__' || k END AS event_id, video_id, round("start", 6) AS "start", round("end", 6) AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS k FROM (SELECT event_id AS n, CASE WHEN event_id % 3 = 0 THEN 'e' || (event_id % 50) WHEN event_id % 3 = 1 THEN 'clip_' || (event_id % 40) ELSE 'bark_' || lpad(CAST(event_id AS VARCHAR), CAST(greatest(3, length(CAST(event_id AS VARCHAR))) AS INTEGER), '0') END AS id, video_id, "start", "end" FROM ev WHERE "end" > "start" AND "start" < 200.0 AND "end" <= 200.25)))""", "ev")
def _(t):
    n = F.col("event_id")
    raw = t.ev.select(n.alias("row_no"), "video_id", "start", "end", F.when(n % 3 == 0, F.concat(F.lit(" e"), (n % 50).cast("string"))).otherwise(F.lit("")).alias("event_id"), F.when(n % 3 == 1, F.concat(F.lit("a/b/clip_"), (n % 40).cast("string"), F.lit(".wav"))).alias("audio_file"))
    return rounded(E.normalized_events(raw, F.lit(200.0)).select("event_id", "video_id", "start", "end"))


@query("PRJ05_catalog_timestamps", """SELECT video_id, round("start", 6) AS "start", round("end", 6) AS "end", 'bark_' || lpad(CAST(k AS VARCHAR), CAST(greatest(3, length(CAST(k AS VARCHAR))) AS INTEGER), '0') || '.wav' AS audio_file FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY "start", "end") - 1 AS k FROM (SELECT DISTINCT video_id, "start", "end" FROM ev WHERE "end" > "start"))""", "ev")
def _(t):
    return rounded(E.catalog_timestamps(t.ev))


@query("PRJ09_state", "SELECT user_id, CASE user_id % 5 WHEN 0 THEN 'barking' WHEN 1 THEN 'not_barking' WHEN 2 THEN 'barking' WHEN 3 THEN 'not_barking' ELSE 'half_asleep' END AS state FROM (SELECT DISTINCT user_id FROM events)")
def _(t):
    text = F.element_at(F.array(*[F.lit(x) for x in (" Barking", "not barking", "BARK", "Not-Barking ", "half asleep")]), (F.col("user_id") % 5 + 1).cast("int"))
    return t.raw("events").select("user_id").distinct().select("user_id", X.state(text).alias("state"))


@query("PRJ10_clamp_boxes", "SELECT video_id, track_id, frame, CAST(greatest(0, least(300, floor(x1))) AS BIGINT) AS x1, CAST(greatest(0, least(150, floor(y1))) AS BIGINT) AS y1, CAST(greatest(0, least(300, ceil(x2))) AS BIGINT) AS x2, CAST(greatest(0, least(150, ceil(y2))) AS BIGINT) AS y2 FROM tracks WHERE least(300, floor(x1)) < least(300, ceil(x2)) AND least(150, floor(y1)) < least(150, ceil(y2))", "tracks")
def _(t):
    b = G.clamp(G.box(), F.lit(300), F.lit(150))
    return t.tracks.select("video_id", "track_id", "frame", *[c.alias(n) for c, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)]).where("x1 < x2 and y1 < y2")


@query("PRJ11_padded_crop", "SELECT video_id, track_id, frame, CAST(greatest(0, floor(x1 - greatest(2.0, (x2 - x1) * 0.1))) AS BIGINT) AS cx1, CAST(least(640, ceil(x2 + greatest(2.0, (x2 - x1) * 0.1))) AS BIGINT) AS cx2 FROM tracks", "tracks")
def _(t):
    b = G.padded_crop(G.box(), 0.1, F.lit(640), F.lit(480))
    return t.tracks.select("video_id", "track_id", "frame", b.x1.alias("cx1"), b.x2.alias("cx2"))


@query("PRJ12_confidence_filter", "SELECT video_id, count(*) AS n FROM det WHERE confidence >= 0.95 GROUP BY ALL", "det")
def _(t):
    return t.det.where("confidence >= 0.95").groupBy("video_id").agg(F.count("*").alias("n"))


@query("PRJ13_eligible_tracks", "SELECT video_id, track_id, count(*) AS n FROM tracks GROUP BY ALL HAVING count(*) >= 50", "tracks")
def _(t):
    return R.least_rows(t.tracks, ["video_id", "track_id"], 50).groupBy("video_id", "track_id").agg(F.count("*").alias("n"))


@query("PRJ14_infer_fps", "SELECT video_id, round(median(frame / time_sec), 6) AS fps FROM tracks WHERE time_sec > 0 AND frame / time_sec > 1 GROUP BY ALL", "tracks")
def _(t):
    return rounded(E.inferred_fps(t.tracks))


@query("PRJ15_fps_two_sources", "SELECT video_id, round(coalesce(median(f / s) FILTER (f / s > 1 AND f / s < 240), 30.0), 6) AS fps FROM (SELECT video_id, floor(\"start\" * 10) AS f, nullif(\"start\", 0) AS s FROM ev) GROUP BY ALL", "ev")
def _(t):
    e = t.ev.withColumn("start_frame", F.floor(F.col("start") * 10))
    return rounded(evaluation.fps_of(e, t.tracks))


@query("PRJ16_tracking_fps", "SELECT video_id, round(1 / median(d) FILTER (d > 0), 6) AS tracking_fps FROM (SELECT video_id, time_sec - lag(time_sec) OVER (PARTITION BY video_id ORDER BY time_sec) AS d FROM (SELECT DISTINCT video_id, time_sec FROM tracks)) GROUP BY ALL", "tracks")
def _(t):
    return rounded(E.tracking_fps(t.tracks))


@query("PRJ17_frame_stride", "SELECT video_id, count(*) AS n FROM tracks WHERE frame % 3 = 0 GROUP BY ALL", "tracks")
def _(t):
    step = F.greatest(F.lit(1), F.rint(F.lit(30.0) / F.lit(10.0))).cast("long")
    return t.tracks.where(F.pmod(F.col("frame"), step) == 0).groupBy("video_id").agg(F.count("*").alias("n"))


@query("PRJ18_safe_divide", "SELECT event_id, round(value / nullif(user_id % 3, 0), 6) AS ratio FROM events")
def _(t):
    return rounded(t.raw("events").select("event_id", X.safe_divide(F.col("value"), (F.col("user_id") % 3).cast("double")).alias("ratio")))


@query("PRJ19_sentinel_lookup", "SELECT k.video_id, k.track_id, coalesce(p.persistent_profile_id, '__unmapped__') AS profile FROM (SELECT DISTINCT video_id, track_id FROM tracks) k LEFT JOIN (SELECT * FROM profiles WHERE track_id % 3 <> 0) p USING (video_id, track_id)", "profiles")
def _(t):
    keys, known = t.tracks.select("video_id", "track_id").distinct(), t.profiles.where("track_id % 3 <> 0")
    return keys.join(known, ["video_id", "track_id"], "left").select("video_id", "track_id", F.coalesce("persistent_profile_id", F.lit("__unmapped__")).alias("profile"))


@query("SNK04_long_metrics", "UNPIVOT (SELECT CAST(count(*) AS DOUBLE) AS events, round(avg(value), 6) AS mean_value, round(max(value), 6) AS max_value FROM events) ON events, mean_value, max_value INTO NAME metric VALUE value")
def _(t):
    return R.long_metrics(rounded(t.raw("events").agg(F.count("*").cast("double").alias("events"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"))))


@query("SNK07_mot_rows", "SELECT concat_ws(',', frame, track_id, x1, y1, x2 - x1, y2 - y1, 1, 1, 1) AS value FROM (SELECT frame, track_id, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2 FROM tracks WHERE video_id = 0)", "tracks")
def _(t):
    from .sources.mot import mot_lines

    b = t.tracks.where("video_id = 0").select("frame", "track_id", *[F.col(c).cast("long").alias(c) for c in J.BOX])
    return mot_lines(b, truth=True)


@query("SNK07_mot_rows_of_every_video", "SELECT video_id, concat_ws(',', frame, track_id, x1, y1, x2 - x1, y2 - y1, 1, 1, 1) AS value FROM (SELECT video_id, frame, track_id, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2 FROM tracks)", "tracks")
def _(t):
    from .sources.mot import mot_lines

    b = t.tracks.select("video_id", "frame", "track_id", *[F.col(c).cast("long").alias(c) for c in J.BOX])
    return mot_lines(b, truth=True, keys=["video_id"])


# --- joins -------------------------------------------------------------------------------------------------------

@query("JN01_merge_mapping", "SELECT t.video_id, count(*) AS rows, count(*) FILTER (p.persistent_profile_id IS NULL) AS unmatched FROM tracks t LEFT JOIN (SELECT * FROM profiles WHERE track_id % 4 <> 1) p USING (video_id, track_id) GROUP BY ALL", "tracks", "profiles")
def _(t):
    df = t.tracks.join(t.profiles.where("track_id % 4 <> 1").select("video_id", "track_id", "persistent_profile_id"), ["video_id", "track_id"], "left")
    return df.groupBy("video_id").agg(F.count("*").alias("rows"), F.count_if(F.col("persistent_profile_id").isNull()).alias("unmatched"))


@query("JN02_profile_of_prediction", "SELECT p.video_id, p.event_id, q.persistent_profile_id FROM predictions p LEFT JOIN profiles q ON q.video_id = p.video_id AND q.track_id = p.predicted_track_id", "predictions", "profiles")
def _(t):
    q = t.profiles.select("video_id", F.col("track_id").alias("predicted_track_id"), "persistent_profile_id")
    return t.predictions.join(q, ["video_id", "predicted_track_id"], "left").select("video_id", "event_id", "persistent_profile_id")


@query("JN03_event_candidates", "SELECT * FROM candidates", "candidates")
def _(t):
    return E.candidates(t.tracks, t.ev)


@query("JN03_offscreen_events", "SELECT e.video_id, e.event_id FROM ev e ANTI JOIN candidates c USING (video_id, event_id)", "candidates")
def _(t):
    return E.offscreen(t.ev, E.candidates(t.tracks, t.ev)).select("video_id", "event_id")


@query("JN04_seen_windows", "SELECT video_id, event_id, track_id, window_index, round(window_start, 6) AS window_start FROM scored", "scored")
def _(t):
    return rounded(E.seen_windows(t.windows, t.tracks))


@query("JN05_cooccurrence", "SELECT video_id, l, r, n AS common_frames FROM common", "common")
def _(t):
    return K.cooccurring(t.tracks).groupBy("video_id", "l", "r").agg(F.count("*").alias("common_frames"))


@query("JN06_track_pairs", "SELECT video_id, l, r FROM gaps", "gaps")
def _(t):
    return K.pairs(t.tracks)


@query("JN07_nearest_box", "SELECT a.video_id, a.event_id, a.at, t.frame, round(t.x1, 6) AS x1, round(t.y2, 6) AS y2 FROM asked a JOIN tracks t ON t.video_id = a.video_id AND t.track_id = a.track_id AND abs(t.frame - a.at) <= 5 QUALIFY row_number() OVER (PARTITION BY a.event_id, a.at ORDER BY abs(t.frame - a.at), t.frame) = 1", "asked", "tracks")
def _(t):
    return rounded(J.nearest(t.asked, t.tracks.select("video_id", "track_id", "frame", *J.BOX), ["video_id", "track_id"], "at", "frame", 5, ["event_id", "at"]).select("video_id", "event_id", "at", "frame", "x1", "y2"))


@query("JN08_nearest_annotation_each", "SELECT a.video_id, a.event_id, a.at, g.ident, g.frame FROM asked a JOIN truth g ON g.video_id = a.video_id AND abs(g.frame - a.at) <= 4 QUALIFY row_number() OVER (PARTITION BY a.event_id, a.at, g.ident ORDER BY abs(g.frame - a.at), g.frame) = 1", "asked", "truth")
def _(t):
    return J.nearest(t.asked, t.truth.select("video_id", "ident", "frame"), ["video_id"], "at", "frame", 4, ["event_id", "at", "ident"]).select("video_id", "event_id", "at", "ident", "frame")


@query("JN09_nearest_frame_gap", "SELECT video_id, l, r, frame_gap AS nearest_frame_gap FROM gaps", "gaps")
def _(t):
    return K.frame_gaps(t.tracks)


_PREV_NEXT = """
a AS MATERIALIZED (SELECT q.*, p.frame AS pf, p.x1 AS px1, p.y1 AS py1, p.x2 AS px2, p.y2 AS py2{ps}, n.frame AS nf, n.x1 AS nx1, n.y1 AS ny1, n.x2 AS nx2, n.y2 AS ny2{ns}
  FROM (SELECT q.*, (SELECT max(frame) FROM {t} r WHERE {on} AND r.frame <= q.at) AS f0, (SELECT min(frame) FROM {t} r WHERE {on} AND r.frame >= q.at) AS f1 FROM {q} q) q
  LEFT JOIN {t} p ON {onp} AND p.frame = q.f0 LEFT JOIN {t} n ON {onn} AND n.frame = q.f1)"""


def _around(body, q, table, keys, states=False):
    on, onp, onn = (" AND ".join(f"{a}.{k} = q.{k}" for k in keys) for a in ("r", "p", "n"))
    head = _PREV_NEXT.format(t=table, q=q, on=on, onp=onp, onn=onn, ps=", p.state AS ps" if states else "", ns=", n.state AS ns" if states else "")
    return head, body


def _interpolated_sql():
    head, _ = _around("", "asked", "tracks", ("video_id", "track_id"))
    cols = ", ".join(f"round(CASE WHEN pf = at THEN p{c} WHEN pf < nf AND nf - pf <= 20 THEN p{c} * (1 - (at - pf) / (nf - pf)) + n{c} * ((at - pf) / (nf - pf)) WHEN pf IS NOT NULL AND (nf IS NULL OR at - pf <= nf - at) AND at - pf <= 10 THEN p{c} WHEN nf IS NOT NULL AND (pf IS NULL OR nf - at < at - pf) AND nf - at <= 10 THEN n{c} END, 6) AS {c}" for c in J.BOX)
    full = sql("", "asked", "tracks").rstrip()
    return f"{full},{head}\nSELECT video_id, event_id, at, {cols} FROM a"


def _annotated_sql(bracket: bool):
    head, _ = _around("", "(SELECT DISTINCT a.video_id, a.event_id, a.at, g.ident FROM asked a JOIN (SELECT DISTINCT video_id, ident FROM truth) g USING (video_id))", "truth", ("video_id", "ident"), True)
    inside = "pf < at AND at < nf" + (" AND nf - pf <= 2 AND ps = ns" if bracket else "")
    cols = ", ".join(f"round(CASE WHEN pf = at THEN p{c} WHEN {inside} THEN p{c} * (1 - (at - pf) / (nf - pf)) + n{c} * ((at - pf) / (nf - pf)) END, 6) AS {c}" for c in J.BOX)
    full = sql("", "asked", "truth").rstrip()
    return f"{full},{head}\nSELECT video_id, event_id, at, ident, {cols}, CASE WHEN pf = at THEN ps WHEN {inside} AND ps = ns THEN ps ELSE '' END AS state FROM a"


_QUERIES["JN10_interpolated_box"] = lambda t: rounded(J.interpolated(t.asked.select("video_id", "event_id", "track_id", "at"), t.tracks, ["video_id", "track_id"], "at", "frame", 10).select("video_id", "event_id", "at", *J.BOX))
_ORACLES["JN10_interpolated_box"] = _interpolated_sql()


def _asked_truth(t):
    return t.asked.select("video_id", "event_id", "at").distinct().join(t.truth.select("video_id", "ident").distinct(), "video_id")


_QUERIES["JN11_annotation_at_frame"] = lambda t: rounded(J.annotated_at(_asked_truth(t), t.truth, ["video_id", "ident"], "at", "frame").select("video_id", "event_id", "at", "ident", *J.BOX, "state"))
_ORACLES["JN11_annotation_at_frame"] = _annotated_sql(False)
_QUERIES["JN12_annotation_short_gap"] = lambda t: rounded(J.annotated_at(_asked_truth(t), t.truth, ["video_id", "ident"], "at", "frame", 2).select("video_id", "event_id", "at", "ident", *J.BOX, "state"))
_ORACLES["JN12_annotation_short_gap"] = _annotated_sql(True)


@query("JN13_clip_frame", "SELECT event_id, at, CAST(round_even(100 + (at - floor(\"start\" * 10.0)) / greatest(1, ceil(\"end\" * 10.0) - floor(\"start\" * 10.0)) * 40, 0) AS BIGINT) AS clip_frame FROM asked", "asked")
def _(t):
    lo, hi = F.floor(F.col("start") * FPS), F.ceil(F.col("end") * FPS)
    return t.asked.select("event_id", "at", evaluation.clip_frame(F.col("at"), lo, hi, F.lit(100), F.lit(140)).alias("clip_frame"))


_BEST = "SELECT video_id, event_id, at, ident, iou FROM (SELECT t.video_id, t.event_id, t.at, g.ident, round(greatest(0, least(t.x2, g.x2) - greatest(t.x1, g.x1)) * greatest(0, least(t.y2, g.y2) - greatest(t.y1, g.y1)) / ((t.x2 - t.x1) * (t.y2 - t.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) - greatest(0, least(t.x2, g.x2) - greatest(t.x1, g.x1)) * greatest(0, least(t.y2, g.y2) - greatest(t.y1, g.y1))), 9) AS iou FROM (SELECT a.event_id, a.at, r.* FROM asked a JOIN tracks r ON r.video_id = a.video_id AND r.track_id = a.track_id AND r.frame = a.at) t JOIN truth g ON g.video_id = t.video_id AND g.frame = t.frame) QUALIFY row_number() OVER (PARTITION BY event_id, at ORDER BY iou DESC, ident) = 1"


@query("JN14_best_annotation", f"SELECT video_id, event_id, at, ident, round(iou, 6) AS iou FROM ({_BEST})", "asked", "tracks", "truth")
def _(t):
    return rounded(evaluation.best_annotation(_boxes_asked(t), t.truth))


def _boxes_asked(t):
    return t.asked.select("video_id", "event_id", "track_id", F.col("at"), F.col("at").alias("frame")).join(t.tracks.select("video_id", "track_id", "frame", *J.BOX), ["video_id", "track_id", "frame"])


@query("JN15_best_event_match", f"SELECT video_id, event_id, at, ident, round(iou, 6) AS iou FROM ({_BEST}) WHERE iou > 0 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY iou DESC, at, ident) = 1", "asked", "tracks", "truth")
def _(t):
    return rounded(R.keep_one(evaluation.best_annotation(_boxes_asked(t), t.truth).where("iou > 0"), ["event_id"], [F.desc("iou"), F.asc("at"), F.asc("ident")]))


@query("JN16_active_tracks", "SELECT video_id, frame, side, active FROM near", "near")
def _(t):
    s = S.with_active_tracks(S.boundary_samples(t.samples, t.videos), t.tracks)
    return s.select("video_id", "frame", F.col("boundary_side").alias("side"), F.col("active_track_count").alias("active"))


@query("JN17_rows_in_intervals", "SELECT t.video_id, t.track_id, count(*) AS track_rows, count(*) FILTER (EXISTS (SELECT 1 FROM intervals i WHERE i.video_id = t.video_id AND t.time_sec BETWEEN i.start_sec AND i.end_sec)) AS static_rows FROM tracks t GROUP BY ALL", "tracks", "intervals")
def _(t):
    return S.static_share(t.tracks, t.intervals).select("video_id", "track_id", "track_rows", "static_rows")


@query("JN18_interval_overlap", "SELECT i.video_id, f.track_id, count(*) AS matching_intervals, string_agg(DISTINCT side, ',' ORDER BY side) AS matching_sides FROM infos f JOIN intervals i ON i.video_id = f.video_id AND f.last_time_sec >= i.start_sec AND f.first_time_sec <= i.end_sec GROUP BY ALL", "infos", "intervals")
def _(t):
    return S.touching(t.tracks, t.intervals).select("video_id", "track_id", "matching_intervals", "matching_sides")


@query("JN19_remove_tracks", "SELECT t.video_id, count(*) AS n FROM tracks t WHERE NOT (t.track_id % 5 = 2) GROUP BY ALL", "tracks")
def _(t):
    listed = t.tracks.select("video_id", "track_id", (F.col("track_id") % 5 == 2).alias("remove")).distinct()
    return S.without(t.tracks, listed).groupBy("video_id").agg(F.count("*").alias("n"))


def _temporal_iou(events):
    """Pairs of a video's events that meet."""
    e = events.where("end > start")
    pairs = J.meeting(e, ["video_id"], "event_id", "start", "end", 0.25, lambda *ends: F.round(T.interval_iou(*ends), 6))
    return pairs.select("a", "b", F.col("value").alias("iou"))


_SMALL = "(SELECT * FROM ev WHERE event_type = 'error' AND \"start\" < 60)"


@query("JN20_temporal_iou", f"SELECT a.event_id AS a, b.event_id AS b, round(greatest(0, least(a.\"end\", b.\"end\") - greatest(a.\"start\", b.\"start\")) / (greatest(a.\"end\", b.\"end\") - least(a.\"start\", b.\"start\")), 6) AS iou FROM {_SMALL} a JOIN {_SMALL} b ON a.video_id = b.video_id AND a.event_id < b.event_id AND a.\"end\" >= b.\"start\" AND a.\"start\" <= b.\"end\" AND a.\"end\" > a.\"start\" AND b.\"end\" > b.\"start\"", "ev")
def _(t):
    return _temporal_iou(t.ev.where("event_type = 'error' and start < 60"))


@query("JN20_temporal_iou_of_every_event", "SELECT a.event_id AS a, b.event_id AS b, round(greatest(0, least(a.\"end\", b.\"end\") - greatest(a.\"start\", b.\"start\")) / (greatest(a.\"end\", b.\"end\") - least(a.\"start\", b.\"start\")), 6) AS iou FROM ev a JOIN ev b ON a.video_id = b.video_id AND a.event_id < b.event_id AND a.\"end\" >= b.\"start\" AND a.\"start\" <= b.\"end\" AND a.\"end\" > a.\"start\" AND b.\"end\" > b.\"start\"", "ev")
def _(t):
    return _temporal_iou(t.ev)


@query("JN21_unmatched", "SELECT e.event_id FROM ev e ANTI JOIN (SELECT event_id FROM ev WHERE event_id % 3 = 0) m USING (event_id)", "ev")
def _(t):
    return t.ev.join(t.ev.where("event_id % 3 = 0").select("event_id"), "event_id", "left_anti").select("event_id")


@query("JN22_optional_summaries", "SELECT v.video_id, coalesce(n, 0) AS events, m.total_dogs FROM (SELECT DISTINCT video_id FROM tracks) v LEFT JOIN (SELECT video_id, count(*) AS n FROM ev WHERE video_id < 4 GROUP BY ALL) e USING (video_id) LEFT JOIN (SELECT video_id, count(DISTINCT ident) AS total_dogs FROM tracks WHERE video_id > 0 GROUP BY ALL) m USING (video_id)", "tracks", "ev")
def _(t):
    n = t.ev.where("video_id < 4").groupBy("video_id").agg(F.count("*").alias("n"))
    m = t.tracks.where("video_id > 0").groupBy("video_id").agg(F.count_distinct("ident").alias("total_dogs"))
    return t.videos.select("video_id").join(n, "video_id", "left").join(m, "video_id", "left").select("video_id", F.coalesce("n", F.lit(0)).alias("events"), "total_dogs")


@query("JN23_sampled_frames_only", "SELECT video_id, count(*) AS n FROM truth g SEMI JOIN (SELECT DISTINCT video_id, frame FROM tracks WHERE track_id % 2 = 0) t USING (video_id, frame) GROUP BY ALL", "truth", "tracks")
def _(t):
    return t.truth.join(t.tracks.where("track_id % 2 = 0").select("video_id", "frame").distinct(), ["video_id", "frame"], "left_semi").groupBy("video_id").agg(F.count("*").alias("n"))


@query("JN24_sequences_of_every_tracker", "SELECT o_custkey AS seq FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def _(t):
    return evaluation.in_every(t.raw("orders").select(F.col("o_custkey").alias("seq"), F.col("o_orderpriority").alias("tracker")), "seq", "tracker")


@query("JN25_frame_events", "SELECT video_id, frame, event_id, predicted_track_id FROM (SELECT *, unnest(range(CAST(floor(\"start\" * 10.0) AS BIGINT), CAST(ceil(\"end\" * 10.0) AS BIGINT) + 1)) AS frame FROM predictions) QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY coalesce(top_score, -1) DESC, \"start\", \"end\", event_id) = 1", "predictions")
def _(t):
    return E.frame_events(t.predictions, F.lit(FPS))


@query("JN26_representative_frames", "SELECT m.video_id, m.l, m.r, CASE WHEN len(c.fs) > 0 THEN c.fs[len(c.fs) // 2 + 1] ELSE g.a END AS left_frame, CASE WHEN len(c.fs) > 0 THEN c.fs[len(c.fs) // 2 + 1] ELSE g.b END AS right_frame FROM merges m LEFT JOIN (SELECT video_id, l, r, list_sort(list(frame)) AS fs FROM co0 GROUP BY ALL) c USING (video_id, l, r) LEFT JOIN (SELECT a.video_id, a.track_id AS l, b.track_id AS r, a.frame AS a, b.frame AS b FROM tracks a JOIN tracks b ON a.video_id = b.video_id AND a.track_id < b.track_id QUALIFY row_number() OVER (PARTITION BY a.video_id, a.track_id, b.track_id ORDER BY abs(a.frame - b.frame), a.frame, b.frame) = 1) g USING (video_id, l, r)", "merges", "co0")
def _(t):
    return K.representative_frames(t.tracks, P.merge_log(t.merged))


# --- aggregations ------------------------------------------------------------------------------------------------

@query("AG01_track_info", "SELECT video_id, track_id, first_frame, last_frame, round(first_time_sec, 6) AS first_time_sec, round(last_time_sec, 6) AS last_time_sec, track_rows, round(mean_confidence + 0.000000001, 6) AS mean_confidence FROM infos", "infos")
def _(t):
    # means of two-place values often end in a five: away from it, the order of summing doesn't show
    return rounded(t.infos.withColumn("mean_confidence", F.col("mean_confidence") + 1e-9))


@query("AG02_track_quality", "SELECT video_id, track_id, round(duration_sec, 6) AS duration_sec, frame_span, rows, round(total_center_movement, 4) AS total_center_movement, round(median_box_diagonal, 6) AS median_box_diagonal, round(observation_density, 6) AS observation_density, round(normalized_motion, 4) AS normalized_motion, static_suspect, sparse_suspect FROM quality", "quality")
def _(t):
    q = t.quality
    return rounded(q.withColumn("total_center_movement", F.round("total_center_movement", 4)).withColumn("normalized_motion", F.round("normalized_motion", 4)))


@query("AG03_track_classes", "SELECT video_id, track_id, track_classification, intro_only, outro_only, boundary_only, nearly_pixel_static, likely_image_or_screen FROM classes", "classes")
def _(t):
    return t.classes.select("video_id", "track_id", "track_classification", "intro_only", "outro_only", "boundary_only", "nearly_pixel_static", "likely_image_or_screen")


@query("AG04_pair_metrics", "SELECT video_id, l, r, n AS common_observed_frames, round(share, 6) AS overlap_fraction_of_shorter_track, round(miou, 6) AS median_bbox_iou, round(aiou, 6) AS mean_bbox_iou, round(gap, 6) AS median_normalized_edge_gap, round(dist, 6) AS median_normalized_center_distance, round(ios, 6) AS median_intersection_over_smaller, round(ratio, 6) AS median_area_ratio, round(sim, 6) AS appearance_similarity, frame_gap AS nearest_frame_gap, round(gap_sec, 6) AS nearest_time_gap_sec FROM metrics", "metrics")
def _(t):
    return rounded(t.pair_metrics)


@query("AG05_pair_decisions", "SELECT video_id, l, r, decision AS pair_decision FROM decisions", "decisions")
def _(t):
    return t.decisions.select("video_id", "l", "r", "pair_decision")


@query("AG06_profile_rollup", "SELECT video_id, persistent_profile_id, round(min(first_time_sec), 6) AS first_seen_time, round(max(last_time_sec), 6) AS last_seen_time, string_agg(CAST(track_id AS VARCHAR), ',' ORDER BY track_id) AS track_ids, count(*) AS track_fragments, string_agg(DISTINCT track_classification, ',' ORDER BY track_classification) AS classifications, bool_or(likely_image_or_screen) AS uncertain FROM profiles JOIN infos USING (video_id, track_id) JOIN classes USING (video_id, track_id) GROUP BY ALL", "profiles", "classes")
def _(t):
    df = P.rollup(t.profiles, t.infos, t.classes)
    return rounded(df.withColumn("track_ids", F.array_join(F.col("track_ids").cast("array<string>"), ",")).withColumn("classifications", F.array_join("classifications", ",")))


@query("AG07_centroids", "SELECT video_id, ident, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY video_id, ident)), 6) AS x FROM (SELECT video_id, ident, pos, avg(x) AS x FROM (SELECT video_id, ident, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM emb) GROUP BY ALL)", "emb")
def _(t):
    c = K.centroids(t.emb, ["video_id", "ident"])
    return rounded(c.select("video_id", "ident", F.posexplode("v").alias("pos", "x")).withColumn("pos", F.col("pos").cast("long")))


@query("AG08_internal_motion", "SELECT video_id, track_id, internal_motion_pairs, round(mean_internal_motion, 6) AS mean_internal_motion, round(median_internal_motion, 6) AS median_internal_motion, round(max_internal_motion, 6) AS max_internal_motion FROM motion", "motion")
def _(t):
    return rounded(K.internal_motion(t.diffs))


@query("AG09_candidate_scores", "SELECT video_id, event_id, track_id, round(mean_score, 6) AS mean_score, round(max_score, 6) AS max_score, window_count, array_to_string(list_transform(window_scores, lambda s: CAST(CAST(round(s * 1000, 0) AS BIGINT) AS VARCHAR)), ',') AS window_scores FROM scores", "scores")
def _(t):
    s = t.scores.withColumn("window_scores", F.array_join(F.transform("window_scores", lambda x: F.round(x * 1000, 0).cast("long").cast("string")), ","))
    return rounded(s.drop("window_starts_sec"))


@query("AG10_visibility", "SELECT e.video_id, e.event_id, t.track_id, count(DISTINCT t.frame) AS visible_frames, CAST(greatest(1, ceil((e.\"end\" - e.\"start\") * 10.0)) AS BIGINT) AS expected_frames, round(least(1, count(DISTINCT t.frame) / greatest(1, ceil((e.\"end\" - e.\"start\") * 10.0))), 6) AS visible_fraction FROM ev e JOIN tracks t ON t.video_id = e.video_id AND t.time_sec >= e.\"start\" - 0.000000001 AND t.time_sec <= e.\"end\" + 0.000000001 GROUP BY e.video_id, e.event_id, t.track_id, e.\"start\", e.\"end\"", "ev", "tracks")
def _(t):
    return rounded(E.visibility(t.tracks, t.ev, F.lit(FPS)))


@query("AG11_predictions", "SELECT video_id, event_id, status, num_candidates, predicted_track_id, round(top_score, 6) AS top_score, round(second_score, 6) AS second_score, round(top_score - second_score, 6) AS margin, coalesce(ids, '') AS ids FROM predictions", "predictions")
def _(t):
    p = t.predictions.select("video_id", "event_id", "status", "num_candidates", "predicted_track_id", "top_score", "second_score", "margin", F.coalesce(F.array_join(F.col("all_candidate_ids").cast("array<string>"), ","), F.lit("")).alias("ids"))
    return rounded(p)


@query(
    "AG12_fusion_summary",
    """SELECT video_id, count(*) AS bark_events, count(profile) AS assigned, count(*) FILTER (decision = 'audio_visual_identity_conflict') AS conflicts, count(*) FILTER (decision = 'created_offscreen_audio_only_profile') AS audio_only_profiles,
       count(*) FILTER (decision = 'offscreen_matched_existing_profile_by_audio') AS matched_by_audio FROM voiced WHERE k > 0 GROUP BY ALL""",
    "voiced",
)
def _(t):
    return fusion.summary(_fused(t))


@query("AG13_merge_reasons", "SELECT video_id, count(*) FILTER (decision = 'candidate_fragment_reid') AS fragment_reid, count(*) FILTER (decision = 'candidate_part_based_duplicate') AS part_based_duplicate, count(*) FILTER (decision = 'candidate_duplicate_overlap') AS duplicate_overlap FROM merges GROUP BY ALL", "merges")
def _(t):
    r = F.col("merge_reason")
    return P.merge_log(t.merged).groupBy("video_id").agg(*[F.count_if(r == f"candidate_{k}").alias(k) for k in ("fragment_reid", "part_based_duplicate", "duplicate_overlap")])


_RESULT = "SELECT v.video_id, v.tracks, coalesce(p.profiles, 0) AS profiles, v.tracks - coalesce(p.profiles, 0) AS track_fragments_merged, coalesce(e.events, 0) AS bark_events, coalesce(e.assigned, 0) AS assigned, CASE WHEN p.profiles IS NULL THEN 'missing_visual' WHEN e.events IS NULL THEN 'no_bark_events' WHEN e.assigned = 0 THEN 'unassigned' ELSE 'complete' END AS evaluation_status FROM (SELECT video_id, count(DISTINCT track_id) AS tracks FROM tracks GROUP BY ALL) v LEFT JOIN (SELECT video_id, count(DISTINCT persistent_profile_id) AS profiles FROM profiles GROUP BY ALL) p USING (video_id) LEFT JOIN (SELECT video_id, count(*) AS events, count(predicted_track_id) AS assigned FROM predictions WHERE video_id <> 3 GROUP BY ALL) e USING (video_id)"


def _results(t):
    return evaluation.video_results(t.tracks, t.profiles, t.predictions.where("video_id <> 3"))


@query("AG14_video_results", f"SELECT *, round(track_fragments_merged / nullif(tracks, 0), 6) AS reduction_rate, round(assigned / nullif(bark_events, 0), 6) AS assignment_rate FROM ({_RESULT})", "tracks", "profiles", "predictions")
def _(t):
    return rounded(_results(t))


@query("AG15_aggregate_results", f"SELECT count(*) AS videos, count(*) FILTER (evaluation_status = 'complete') AS complete, CAST(sum(tracks) AS BIGINT) AS tracks, CAST(sum(profiles) AS BIGINT) AS profiles, round(sum(track_fragments_merged) / sum(tracks), 6) AS reduction_rate, round(avg(profiles), 6) AS mean_profiles, round(sum(assigned) FILTER (evaluation_status = 'complete') / nullif(sum(bark_events) FILTER (evaluation_status = 'complete'), 0), 6) AS assignment_rate FROM ({_RESULT})", "tracks", "profiles", "predictions")
def _(t):
    return rounded(evaluation.aggregate_results(_results(t)))


@query("AG16_merge_breakdown", "SELECT decision AS merge_reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM merges GROUP BY ALL", "merges")
def _(t):
    return rounded(evaluation.shares(P.merge_log(t.merged), "merge_reason"))


_CONF = "SELECT a.video_id, a.event_id, a.at, coalesce(g.state, '') = 'barking' AS truth, p.top_score >= 0.7 AS guess FROM asked a JOIN predictions p USING (video_id, event_id) LEFT JOIN truth g ON g.video_id = a.video_id AND g.frame = a.at AND g.ident = a.track_id // 4"


def _judged(t):
    g = t.truth.select("video_id", F.col("frame").alias("at"), "ident", "state")
    a = t.asked.join(t.predictions.select("video_id", "event_id", "top_score"), ["video_id", "event_id"]).withColumn("ident", F.floor(F.col("track_id") / 4))
    return a.join(g, ["video_id", "at", "ident"], "left").select("video_id", "event_id", "at", (F.coalesce("state", F.lit("")) == "barking").alias("truth"), (F.col("top_score") >= 0.7).alias("guess"))


_RATES = "count(*) FILTER (truth AND guess) AS tp, count(*) FILTER (NOT truth AND guess) AS fp, count(*) FILTER (truth AND NOT guess) AS fn, count(*) FILTER (NOT truth AND NOT guess) AS tn"


@query("AG17_confusion", f"SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy FROM (SELECT {_RATES} FROM ({_CONF}))", "asked", "predictions", "truth")
def _(t):
    return rounded(R.confusion(_judged(t), F.col("truth"), F.col("guess")))


@query("AG18_micro_macro", f"SELECT round(sum(tp + tn) / sum(tp + fp + fn + tn), 6) AS micro_accuracy, round(avg((tp + tn) / (tp + fp + fn + tn)), 6) AS macro_accuracy FROM (SELECT video_id, {_RATES} FROM ({_CONF}) GROUP BY ALL)", "asked", "predictions", "truth")
def _(t):
    return rounded(evaluation.micro_macro(R.confusion(_judged(t), F.col("truth"), F.col("guess"), ["video_id"])))


@query("AG19_weighted_mean", f"SELECT round(sum(iou * n) / sum(n), 6) AS weighted_mean_iou FROM (SELECT video_id, avg(iou) AS iou, count(*) AS n FROM ({_BEST}) GROUP BY ALL)", "asked", "tracks", "truth")
def _(t):
    v = evaluation.best_annotation(_boxes_asked(t), t.truth).groupBy("video_id").agg(F.avg("iou").alias("iou"), F.count("*").alias("n"))
    return rounded(v.agg((F.sum(F.col("iou") * F.col("n")) / F.sum("n")).alias("weighted_mean_iou")))


@query("AG20_count_errors", "SELECT round(avg(p - d), 6) AS bias, round(avg(abs(p - d)), 6) AS mae, round(avg(CASE WHEN p = d THEN 1.0 ELSE 0.0 END), 6) AS exact_rate, round(avg(CASE WHEN p > d THEN 1.0 ELSE 0.0 END), 6) AS over_rate FROM (SELECT video_id, count(DISTINCT persistent_profile_id) AS p FROM profiles GROUP BY ALL) JOIN (SELECT video_id, count(DISTINCT ident) AS d FROM tracks GROUP BY ALL) USING (video_id)", "profiles")
def _(t):
    p = t.profiles.groupBy("video_id").agg(F.count_distinct("persistent_profile_id").alias("guess"))
    d = t.tracks.groupBy("video_id").agg(F.count_distinct("ident").alias("truth"))
    return rounded(evaluation.count_errors(p.join(d, "video_id")))


_OF = "(SELECT p.video_id, p.persistent_profile_id AS profile, t.ident, t.track_id FROM profiles p JOIN (SELECT DISTINCT video_id, track_id, ident FROM tracks) t USING (video_id, track_id))"


def _profile_idents(t):
    return t.profiles.select("video_id", "track_id", F.col("persistent_profile_id").alias("profile")).join(t.tracks.select("video_id", "track_id", "ident").distinct(), ["video_id", "track_id"])


@query("AG21_profile_purity", f"SELECT video_id, profile, ident, n, CAST(sum(n) OVER (PARTITION BY video_id, profile) AS BIGINT) AS total, count(*) OVER (PARTITION BY video_id, profile) AS \"distinct\", count(*) OVER (PARTITION BY video_id, profile) > 1 AS merge_error FROM (SELECT video_id, profile, ident, count(*) AS n, min(track_id) AS first FROM {_OF} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY video_id, profile ORDER BY n DESC, first) = 1", "profiles", "tracks")
def _(t):
    return R.majority(_profile_idents(t), ["video_id", "profile"], "ident", F.col("track_id")).withColumn("merge_error", F.col("distinct") > 1)


@query("AG22_fragmentation", f"SELECT video_id, ident, count(DISTINCT profile) AS profiles, string_agg(DISTINCT profile, ',' ORDER BY profile) AS profile_list, count(DISTINCT profile) > 1 AS fragmented FROM {_OF} GROUP BY ALL", "profiles", "tracks")
def _(t):
    return _profile_idents(t).groupBy("video_id", "ident").agg(F.count_distinct("profile").alias("profiles"), F.concat_ws(",", F.array_sort(F.collect_set("profile"))).alias("profile_list")).withColumn("fragmented", F.col("profiles") > 1)


@query("AG23_annotation_summary", "SELECT video_id, ident, min(frame) AS first_frame, max(frame) AS last_frame, count(DISTINCT frame) AS frames, round(avg(x2 - x1), 6) AS mean_width, round(count(DISTINCT frame) / (max(frame) - min(frame) + 1), 6) AS density FROM truth GROUP BY ALL", "truth")
def _(t):
    return rounded(evaluation.annotation_summary(t.truth))


@query("AG24_mode_smallest", "SELECT video_id, ident FROM (SELECT video_id, ident, count(*) AS n FROM truth GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY n DESC, ident) = 1", "truth")
def _(t):
    return R.majority(t.truth, ["video_id"], "ident", F.col("ident")).select("video_id", "ident")


@query("AG25_event_localization", f"SELECT a.video_id, a.event_id, count(*) AS sampled, count(b.iou) AS evaluable, round(avg(b.iou), 6) AS mean_iou, round(max(b.iou), 6) AS max_iou, coalesce(max(b.iou) >= 0.30, false) AS localized FROM asked a LEFT JOIN ({_BEST}) b USING (video_id, event_id, at) GROUP BY ALL", "asked", "tracks", "truth")
def _(t):
    return rounded(evaluation.localization(t.asked, evaluation.best_annotation(_boxes_asked(t), t.truth)))


@query("AG26_identity_confusion", f"SELECT video_id, profile, ident, count(*) AS n FROM {_OF} GROUP BY ALL", "profiles", "tracks")
def _(t):
    return _profile_idents(t).groupBy("video_id", "profile", "ident").agg(F.count("*").alias("n"))


@query("AG27_annotation_statistics", "SELECT video_id, count(*) AS boxes, count(DISTINCT frame) AS frames, count(DISTINCT ident) AS tracks, round(count(*) / count(DISTINCT frame), 6) AS boxes_per_frame, round(count(*) / count(DISTINCT ident), 6) AS mean_track_length, (SELECT max(n) FROM (SELECT count(*) AS n FROM truth b WHERE b.video_id = a.video_id GROUP BY b.ident)) AS max_track_length FROM truth a GROUP BY ALL", "truth")
def _(t):
    return rounded(evaluation.annotation_statistics(t.truth))


@query("AG28_coerced_totals", "SELECT CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, round(sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) / count(*), 6) AS rate FROM events")
def _(t):
    k = F.get_json_object("props", "$.k")
    return rounded(t.raw("events").agg(F.sum(k.try_cast("long")).alias("total"), (F.sum(X.number(k)) / F.count("*")).alias("rate")))


@query("AG29_grouped_and_total", "SELECT coalesce(dataset, 'combined') AS dataset, count(*) AS events, round(avg(num_candidates), 6) AS mean_candidates, round(count(predicted_track_id) / count(*), 6) AS assigned FROM (SELECT CASE WHEN video_id < 2 THEN 'dataset_a' ELSE 'dataset_b' END AS dataset, * FROM predictions) GROUP BY ROLLUP (dataset)", "predictions")
def _(t):
    df = t.predictions.withColumn("dataset", F.when(F.col("video_id") < 2, "dataset_a").otherwise("dataset_b"))
    out = df.rollup("dataset").agg(F.count("*").alias("events"), F.avg("num_candidates").alias("mean_candidates"), (F.count("predicted_track_id") / F.count("*")).alias("assigned"))
    return rounded(out.withColumn("dataset", F.coalesce("dataset", F.lit("combined"))))


@query("AG30_static_intervals", "SELECT video_id, side, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec, start_frame, end_frame, samples, round(median_difference, 6) AS median_difference, max_active, round(median_active, 6) AS median_active, round(duration_sec, 6) AS duration_sec FROM intervals", "intervals")
def _(t):
    return rounded(t.intervals.withColumnsRenamed({"boundary_side": "side", "max_active_tracks": "max_active", "median_active_tracks": "median_active"}))


@query("AG31_static_tracks", "SELECT t.video_id, t.track_id, round(count(*) FILTER (EXISTS (SELECT 1 FROM intervals i WHERE i.video_id = t.video_id AND t.time_sec BETWEEN i.start_sec AND i.end_sec)) / count(*), 6) AS static_fraction FROM tracks t GROUP BY ALL", "tracks", "intervals")
def _(t):
    return rounded(S.removals(t.tracks, t.intervals).select("video_id", "track_id", "static_fraction"))


@query("AG32_run_metrics", "SELECT count(*) AS events, count(*) FILTER (status = 'predicted') AS predicted, count(*) FILTER (status = 'outside_or_offscreen') AS offscreen FROM predictions", "predictions")
def _(t):
    s = F.col("status")
    return t.predictions.agg(F.count("*").alias("events"), F.count_if(s == "predicted").alias("predicted"), F.count_if(s == "outside_or_offscreen").alias("offscreen"))


@query(
    "AG33_conflict_rows",
    """SELECT video_id, event_id, round("start", 6) AS "start", round("end", 6) AS "end", profile AS all_dog_profile_id, source AS assignment_source, best AS audio_best_profile_id, round(score, 6) AS audio_similarity, agreement AS audio_visual_agreement, decision AS v2_decision, status AS audio_clip_status
       FROM voiced WHERE k > 0 AND (agreement = false OR decision = 'audio_visual_identity_conflict')""",
    "voiced",
)
def _(t):
    return rounded(fusion.conflicts(_fused(t)))


# --- windows, order, sets ----------------------------------------------------------------------------------------

@query("WN01_keep_best", "SELECT video_id, track_id, frame, round(confidence, 6) AS confidence, round(x2, 6) AS x2 FROM tracks", "tracks")
def _(t):
    return rounded(t.tracks.select("video_id", "track_id", "frame", "confidence", "x2"))


@query("WN02_rank_candidates", "SELECT video_id, event_id, track_id, rank FROM ranks", "ranks")
def _(t):
    return E.rankings(t.scores).select("video_id", "event_id", "track_id", "rank")


@query("WN03_center_steps", "SELECT video_id, track_id, frame, round(sqrt(dx * dx + dy * dy), 6) AS step FROM steps", "steps")
def _(t):
    from pyspark.sql import Window

    w, b = Window.partitionBy("video_id", "track_id").orderBy("frame"), G.box()
    return rounded(t.tracks.select("video_id", "track_id", "frame", F.hypot(G.center_x(b) - F.lag(G.center_x(b)).over(w), G.center_y(b) - F.lag(G.center_y(b)).over(w)).alias("step")))


@query("WN04_guarded_lag", "SELECT video_id, i, frame_difference FROM near", "near")
def _(t):
    return S.guarded_difference(S.boundary_samples(t.samples, t.videos)).select("video_id", "i", "frame_difference")


@query("WN05_islands", "SELECT video_id, side, CAST(island AS BIGINT) AS island, count(*) AS n FROM runs WHERE frame_difference <= 3.0 GROUP BY ALL", "runs")
def _(t):
    s = R.islands(t.scene_samples, ["video_id", "boundary_side"], "time_sec", F.col("frame_difference") <= 3.0)
    return s.groupBy("video_id", F.col("boundary_side").alias("side"), "island").agg(F.count("*").alias("n"))


@query("WN06_recent_cut", "SELECT video_id, i, max(coalesce(frame_difference >= 20, false)) OVER (PARTITION BY video_id, side ORDER BY time_sec ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS recent_cut FROM near", "near")
def _(t):
    return S.recent_cut(t.scene_samples).select("video_id", "i", "recent_cut")


@query("WN07_even_rows", "SELECT video_id, track_id, frame FROM sampled", "sampled")
def _(t):
    return R.sampled_rows(t.tracks, ["video_id", "track_id"], [F.col("frame")], 9).select("video_id", "track_id", "frame")


@query("WN08_even_frames", "SELECT event_id, at FROM asked", "asked")
def _(t):
    return t.asked.select("event_id", "at")


@query("WN09_sliding_windows", "SELECT video_id, event_id, window_index, round(window_start, 6) AS window_start, round(window_end, 6) AS window_end FROM windows", "windows")
def _(t):
    return rounded(t.windows.select("video_id", "event_id", "window_index", "window_start", "window_end"))


@query("WN10_source_frames", "SELECT event_id, window_index, array_to_string(list_transform(range(0, 16), lambda i: CAST(greatest(0, least(2499, CAST(round_even((window_start + least(i, greatest(1, least(16, CAST(ceil(greatest(0, window_end - window_start) * 8.0) AS BIGINT))) - 1) / 8.0) * 10.0, 0) AS BIGINT))) AS VARCHAR)), ',') AS frames FROM windows", "windows")
def _(t):
    f = E.source_frames(F.col("window_start"), F.col("window_end"), F.lit(FPS), 8.0, F.lit(2499).cast("long"))
    return t.windows.select("event_id", "window_index", F.array_join(f.cast("array<string>"), ",").alias("frames"))


@query("WN11_nearest_fill", "SELECT video_id, i, CASE WHEN ok THEN i WHEN p IS NULL THEN n WHEN n IS NULL THEN p WHEN i - p <= n - i THEN p ELSE n END AS source FROM (SELECT video_id, i, gray < 12 AS ok, max(CASE WHEN gray < 12 THEN i END) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, min(CASE WHEN gray < 12 THEN i END) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM samples)", "samples")
def _(t):
    return evaluation.nearest_valid(t.samples, ["video_id"], "i", F.col("gray") < 12).select("video_id", "i", "source")


@query("WN12_suffix_duplicates", "SELECT CASE WHEN k = 1 THEN event_type ELSE event_type || '__' || k END AS id, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events)")
def _(t):
    return R.suffixed_ids(t.raw("events").select(F.col("event_type").alias("id"), "event_id"), "id", [F.col("event_id")])


@query("WN13_profile_numbers", "SELECT video_id, track_id, cluster, persistent_profile_id FROM profiles", "profiles")
def _(t):
    return t.profiles.select("video_id", "track_id", "cluster", "persistent_profile_id")


@query("WN14_dense_ids", "SELECT DISTINCT event_type, dense_rank() OVER (ORDER BY first) AS id FROM (SELECT event_type, min(event_id) AS first FROM events GROUP BY ALL)")
def _(t):
    df = t.raw("events").select("event_type", "event_id", F.lit(1).alias("file"))
    return R.dense_by_first_seen(df, "event_type", "event_id", ["file"], "id").select("event_type", "id").distinct()


@query("WN15_majority_first_seen", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1")
def _(t):
    return R.majority(t.raw("events"), ["user_id"], "event_type", F.col("event_id")).select("user_id", "event_type", "n")


@query("SO01_multi_key_order", "SELECT video_id, l, r, k FROM cand", "cand")
def _(t):
    order = [F.desc(c) for c in ("priority", "primary_score", "secondary_score")] + [F.asc("nearest_frame_gap")] + [F.desc(c) for c in ("nearest_time_gap_sec", "pair_decision", "l", "r")]
    return R.ranked(t.decisions.where("priority is not null"), ["video_id"], order, "k").select("video_id", "l", "r", "k")


@query("SO02_numeric_string_order", "SELECT id, row_number() OVER (ORDER BY CAST(id AS BIGINT)) AS k FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events)")
def _(t):
    ids = t.raw("events").select(F.col("user_id").cast("string").alias("id"), F.lit(1).alias("one")).distinct()
    return R.ranked(ids, ["one"], [F.col("id").cast("long")], "k").select("id", "k")


@query("SO03_length_then_text", "SELECT id, row_number() OVER (ORDER BY length(id), id) AS k FROM (SELECT DISTINCT 'seq' || user_id AS id FROM events)")
def _(t):
    ids = t.raw("events").select(F.concat(F.lit("seq"), F.col("user_id").cast("string")).alias("id"), F.lit(1).alias("one")).distinct()
    return R.ranked(ids, ["one"], [F.length("id"), F.col("id")], "k").select("id", "k")


@query("SO04_top_two", "SELECT video_id, event_id, track_id, rank FROM ranks WHERE rank <= 2", "ranks")
def _(t):
    return R.top(t.scores, ["video_id", "event_id"], [F.desc("mean_score"), F.asc("track_id")], 2).select("video_id", "event_id", "track_id", "rank")


@query("SE01_union_all", "SELECT 'a' AS part, count(*) AS n FROM tracks WHERE video_id = 0 UNION ALL SELECT 'b', count(*) FROM tracks WHERE video_id = 1", "tracks")
def _(t):
    a, b = (t.tracks.where(f"video_id = {v}").agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "n") for v, p in ((0, "a"), (1, "b")))
    return a.unionByName(b, allowMissingColumns=True)


@query("SE02_union_ids", "SELECT video_id FROM tracks UNION SELECT video_id FROM ev", "tracks", "ev")
def _(t):
    return t.tracks.select("video_id").union(t.ev.select("video_id")).distinct()


@query("SE03_intersect_frames", "SELECT frame FROM tracks WHERE video_id = 0 INTERSECT SELECT frame FROM tracks WHERE video_id = 1", "tracks")
def _(t):
    return t.tracks.where("video_id = 0").select("frame").intersect(t.tracks.where("video_id = 1").select("frame"))


@query("SE04_difference", "SELECT frame FROM tracks WHERE video_id = 0 EXCEPT SELECT frame FROM tracks WHERE video_id = 1", "tracks")
def _(t):
    return t.tracks.where("video_id = 0").select("frame").subtract(t.tracks.where("video_id = 1").select("frame"))


@query("SE05_distinct", "SELECT DISTINCT video_id, event_type FROM ev", "ev")
def _(t):
    return t.ev.select("video_id", "event_type").distinct()


# --- scalar functions --------------------------------------------------------------------------------------------

@query("FN01_iou", "SELECT video_id, l, r, frame, round(inter / (aa + ab - inter), 6) AS iou FROM co0", "co0")
def _(t):
    return rounded(K.cooccurring(t.tracks).select("video_id", "l", "r", "frame", G.iou(G.box("l_"), G.box("r_")).alias("iou")))


@query("FN02_geometry", "SELECT video_id, l, r, frame, round(sqrt(gx * gx + gy * gy), 6) AS edge_gap, round(sqrt(cx * cx + cy * cy), 6) AS center_distance, round(inter / greatest(0.000001, least(aa, ab)), 6) AS ios, round(least(aa, ab) / greatest(aa, ab), 6) AS ratio FROM co0", "co0")
def _(t):
    a, b = G.box("l_"), G.box("r_")
    return rounded(K.cooccurring(t.tracks).select("video_id", "l", "r", "frame", G.edge_gap(a, b).alias("edge_gap"), G.center_distance(a, b).alias("center_distance"), G.intersection_over_smaller(a, b).alias("ios"), G.area_ratio(a, b).alias("ratio")))


@query("FN03_cosine", "SELECT video_id, l, r, round(sim, 6) AS sim FROM sims", "sims")
def _(t):
    return rounded(K.appearance(K.pairs(t.tracks), t.emb).withColumnRenamed("appearance_similarity", "sim"))


@query("FN04_unit_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))))), 5) AS total FROM embeddings")
def _(t):
    v = V.normalized(F.col("embedding").cast("array<double>"))
    return t.raw("embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("FN07_interval_iou", "SELECT event_id, round(greatest(0, least(\"end\", 100.5) - greatest(\"start\", 99.0)) / (greatest(\"end\", 100.5) - least(\"start\", 99.0)), 6) AS iou FROM ev", "ev")
def _(t):
    return rounded(t.ev.select("event_id", T.interval_iou(F.col("start"), F.col("end"), F.lit(99.0), F.lit(100.5)).alias("iou")))


@query("FN08_xywh", "SELECT video_id, track_id, frame, round(x1, 6) AS x, round(y1, 6) AS y, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h FROM tracks", "tracks")
def _(t):
    return rounded(t.tracks.select("video_id", "track_id", "frame", *[c.alias(n) for c, n in zip(G.xywh(G.box()), "xywh", strict=True)]))


@query("FN10_time_to_frame", "SELECT event_id, CAST(floor(\"start\" * 29.97) AS BIGINT) AS first, CAST(ceil(\"end\" * 29.97) AS BIGINT) AS last, CAST(round_even(\"start\" * 29.97, 0) AS BIGINT) AS near FROM ev", "ev")
def _(t):
    fps = F.lit(29.97)
    return t.ev.select("event_id", T.first_frame(F.col("start"), fps).alias("first"), T.last_frame(F.col("end"), fps).alias("last"), T.frame_of(F.col("start"), fps).alias("near"))


@query("FN11_palette", "SELECT video_id, track_id, CAST(regexp_replace(persistent_profile_id, '[^0-9]', '', 'g') AS BIGINT) % 7 AS color FROM profiles", "profiles")
def _(t):
    return t.profiles.select("video_id", "track_id", X.palette_index(X.digits(F.col("persistent_profile_id")).cast("long"), 7).alias("color"))


@query("FN13_last_number", "SELECT o_orderkey, CAST(o_orderkey % 97 AS BIGINT) AS n FROM orders")
def _(t):
    text = F.format_string("clip12_part_%03d.wav", F.col("o_orderkey") % 97)
    return t.raw("orders").select("o_orderkey", X.last_number(text).alias("n"))


# --- sequential algorithms ---------------------------------------------------------------------------------------

@query("ST01_merge_log", "SELECT video_id, merge_seq, l, r, decision AS merge_reason FROM merges", "merges")
def _(t):
    return P.merge_log(t.merged)


@query("ST01_clusters", "SELECT * FROM clusters", "clusters")
def _(t):
    return t.clusters


@query("ST02_suppression", "SELECT * FROM fates", "fates")
def _(t):
    return t.fates


def _heard(t):
    p = t.predictions.select("video_id", "event_id", "start", "end", F.col("predicted_track_id").alias("track_id"))
    p = p.withColumn("track_id", F.when(F.col("event_id") % 4 != 0, F.col("track_id")))  # every fourth event is off screen
    known = p.join(t.profiles.select("video_id", "track_id", F.col("persistent_profile_id").alias("visual_profile")), ["video_id", "track_id"], "left")
    return t.vector(known, F.col("video_id") * 7 + F.col("event_id") % 3, F.col("event_id") * 29 + 11).withColumnRenamed("v", "vector")


def _fused(t):
    return fusion.fused(_heard(t))


_FUSED_SQL = """SELECT video_id, event_id, round("start", 6) AS "start", round("end", 6) AS "end", profile AS all_dog_profile_id, source AS assignment_source, best AS audio_best_profile_id, round(score, 6) AS audio_similarity, agreement AS audio_visual_agreement, decision AS v2_decision, status AS audio_clip_status FROM voiced WHERE k > 0"""


@query("ST03_fusion", _FUSED_SQL, "voiced")
def _(t):
    return rounded(_fused(t))


def _seen(t):
    """Detections with appearance vectors: one base for each identity, and a part that changes from one to the next."""
    return t.vector(t.tracks, F.col("video_id") * 7 + F.col("ident"), F.col("frame") * 31 + F.col("track_id") * 17 + 50)


@query("ST04_stable_tracker")
def _(t):
    return rounded(trackers.tracked(_seen(t), "stable", "v", "track_id"))


@query("ST07_botsort")
def _(t):
    return rounded(trackers.tracked(_seen(t), "botsort", "v"))


for _name, _method in (("ST05_sort", "sort"), ("ST06_bytetrack", "bytetrack")):
    query(_name)(lambda t, m=_method: rounded(trackers.tracked(t.tracks, m)))


@query("ST09_event_matching")
def _(t):
    e = t.ev.where("end > start")
    truth = e.select("video_id", F.col("event_id").alias("id"), "start", "end")
    return rounded(assign.matched_events(truth, truth.select("video_id", F.col("id"), (F.col("start") + 0.05).alias("start"), (F.col("end") + 0.08).alias("end"))))


@query("ST10_identity_alignment")
def _(t):
    n = _profile_idents(t).groupBy("video_id", "profile", F.col("ident").cast("string").alias("identity")).agg(F.count("*").alias("n"))
    return assign.aligned_identities(n)


def _mot(df, ident):
    return df.select(F.col("video_id").alias("sequence"), "frame", F.col(ident).alias("id"), *[c.alias(n) for c, n in zip(G.xywh(G.box()), "xywh", strict=True)])


@query("ST11_mot_metrics")
def _(t):
    return mot.metrics(mot.statistics(_mot(t.truth, "ident"), _mot(t.tracks.where("frame % 3 = 0"), "track_id")))


@query("OR07_review_sheet", "SELECT video_id, merge_seq, l, r, decision AS merge_reason, CAST(NULL AS VARCHAR) AS manual_verdict, CAST(NULL AS VARCHAR) AS manual_notes FROM merges", "merges")
def _(t):
    blank = F.lit(None).cast("string")
    return P.merge_log(t.merged).withColumn("manual_verdict", blank).withColumn("manual_notes", blank)


@query("SS01_event_counts", "SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    from .streaming.windows import tumbling_counts

    df = tumbling_counts(t.raw("events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour")
    return df.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


# --- evaluators' inputs, rendering, features, runs, sources ---------------------------------------------------------


@query(
    "PRJ06_localized_predictions",
    """SELECT event_id, track % 40 AS pred_track_id, round("start", 6) AS "start", round("end", 6) AS "end" FROM (
         SELECT 'event_' || lpad(CAST(row_number() OVER (ORDER BY event_id) - 1 AS VARCHAR), 6, '0') AS event_id, event_id AS n, event_id AS track, "start", "end" FROM ev)
       WHERE n % 7 <> 0 AND n % 11 <> 0""",
    "ev",
)
def _(t):
    n = F.col("event_id")
    track = F.when(n % 7 == 0, "n/a").otherwise((n % 40).cast("string"))
    raw = t.ev.select(n.alias("row_no"), track.alias("predicted_track_id"), F.col("start").cast("string").alias("start_time_sec"), F.when(n % 11 != 0, F.col("end").cast("string")).alias("end_time_sec"))
    return rounded(evaluation.localized_predictions(raw, "row_no"))


@query(
    "PRJ07_event_predictions",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, round("start", 6) AS "start", round("end", 6) AS "end", CAST(predicted_track_id AS DOUBLE) AS predicted_track_id, 'predicted' AS status
       FROM predictions""",
    "predictions",
)
def _(t):
    p = t.predictions
    raw = p.select(F.col("event_id").alias("BarkSeq_ID"), F.col("start").cast("string").alias("start_time"), F.col("end").cast("string").alias("end_time"), F.coalesce(F.col("predicted_track_id").cast("string"), F.lit("none")).alias("predicted_id"))
    return rounded(evaluation.event_predictions(raw))


@query(
    "PRJ08_identity_inputs",
    """SELECT 'gt' AS side, 'clip_7' AS video_id, 'gt_' || lpad(CAST(n AS VARCHAR), 6, '0') AS event_id, round("start", 6) AS "start", round("end", 6) AS "end", 'dog ' || (id % 4) AS who
       FROM (SELECT event_id AS id, row_number() OVER (ORDER BY event_id) - 1 AS n, "start", "end" FROM ev) WHERE id % 9 <> 0
       UNION ALL SELECT 'pred', 'clip_7', CAST(event_id AS VARCHAR), round("start", 6), round("end", 6), 'dog_' || (event_id % 5) FROM ev""",
    "ev",
)
def _(t):
    n = F.col("event_id")
    truth = t.ev.select(n.alias("row_no"), "start", F.when(n % 9 != 0, F.col("end")).alias("end"), F.concat(F.lit("dog "), (n % 4).cast("string")).alias("dog_id"))
    guess = t.ev.select(n.alias("row_no"), n.alias("bark_id"), F.lit("clip_7").alias("video"), "start", "end", F.concat(F.lit("dog_"), (n % 5).cast("string")).alias("profile_id"))
    a, b = evaluation.identity_events(truth, "gt", evaluation.DOG, "row_no"), evaluation.identity_events(guess, "pred", evaluation.PROFILE, "row_no")
    a, b = evaluation.same_video(a, b), evaluation.same_video(b, a)
    return rounded(a.select(F.lit("gt").alias("side"), "*").unionByName(b.select(F.lit("pred").alias("side"), "*")))


@query(
    "SNK09_draw_list",
    """, n AS (SELECT video_id, track_id, frame AS p, x1, y1, x2, y2, lag(frame) OVER w AS before, lead(frame) OVER w AS n, lead(x1) OVER w AS nx1, lead(y1) OVER w AS ny1, lead(x2) OVER w AS nx2, lead(y2) OVER w AS ny2
               FROM tracks WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)),
         f AS (SELECT *, unnest(list_concat(CASE WHEN before IS NULL THEN range(greatest(0, p - 10), p) ELSE [] END,
                 CASE WHEN n IS NULL THEN range(p, least(2499, p + 10) + 1) WHEN n - p <= 20 THEN range(p, n) ELSE list_concat(range(p, p + 11), range(n - 10, n)) END)) AS frame FROM n),
         b AS (SELECT video_id, track_id, frame, {boxes} FROM f),
         shown AS (SELECT video_id, frame, event_id, predicted_track_id FROM (SELECT *, unnest(range(CAST(floor("start" * 10.0) AS BIGINT), CAST(ceil("end" * 10.0) AS BIGINT) + 1)) AS frame FROM predictions)
                   QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY coalesce(top_score, -1) DESC, "start", "end", event_id) = 1)
       SELECT video_id, frame, track_id, x1, y1, x2, y2, coalesce(predicted_track_id = track_id, false) AS winner, round(mean_score, 6) AS score,
              CASE WHEN coalesce(predicted_track_id = track_id, false) THEN 'BARKING | ' ELSE '' END || 'dog #' || track_id AS label,
              CASE WHEN coalesce(predicted_track_id = track_id, false) AND (frame // 6) % 2 = 0 THEN 6 ELSE 2 END AS line, track_id % 7 AS color
       FROM b LEFT JOIN shown USING (video_id, frame) LEFT JOIN scores USING (video_id, event_id, track_id)""".replace(
        "{boxes}",
        ", ".join(
            f"CAST(greatest(0, least({m - 1}, round_even(CASE WHEN frame > p AND n - p <= 20 THEN {c} * (1 - (frame - p) / (n - p)) + n{c} * ((frame - p) / (n - p)) WHEN frame > p AND n - p > 20 AND frame >= n - 10 THEN n{c} ELSE {c} END, 0))) AS BIGINT) AS {c}"
            for c, m in zip(J.BOX, (400, 250, 400, 250), strict=True)
        ),
    ),
    "tracks",
    "predictions",
    "scores",
)
def _(t):
    shown = E.frame_events(t.predictions, F.lit(FPS))
    drawn = evaluation.draw_list(t.tracks, shown, t.scores, 10, int(SECONDS * FPS), 400, 250)
    return rounded(drawn.withColumn("label", F.regexp_replace("label", r" \| [0-9.]+$", "")))


@query(
    "FN12_json_scores",
    """SELECT video_id, event_id, track_id, '[' || array_to_string(list_transform(window_scores, lambda x: CAST(round(x, 8) AS VARCHAR)), ', ') || ']' AS window_scores, a.all_scores
       FROM scores JOIN (SELECT video_id, event_id, '{' || string_agg('"' || track_id || '": ' || CAST(round(mean_score, 8) AS VARCHAR), ', ' ORDER BY CAST(track_id AS VARCHAR)) || '}' AS all_scores FROM scores GROUP BY ALL) a
       USING (video_id, event_id)""",
    "scores",
)
def _(t):
    entry = F.struct(F.col("track_id").cast("string").alias("k"), F.col("mean_score").alias("v"))
    whole = t.scores.groupBy("video_id", "event_id").agg(X.json_map(F.collect_list(entry)).alias("all_scores"))
    each = t.scores.select("video_id", "event_id", "track_id", X.json_list(F.col("window_scores")).alias("window_scores"))
    return each.join(whole, ["video_id", "event_id"])


_NEXT = "embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _vector_pairs(t):
    e = t.raw("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


def _blend_sql(x: str) -> str:
    """The unit vector of a list expression over positions i of a.embedding and b.embedding: length and first value."""
    return f"SELECT vec_id, len(v) AS dims, round(CASE WHEN list_dot_product(v, v) > 0 THEN v[1] / sqrt(list_dot_product(v, v)) ELSE v[1] END, 6) AS first FROM (SELECT a.vec_id, list_transform(range(1, len(a.embedding) + 1), lambda i: {x}) AS v FROM {_NEXT})"


_A, _B = "CAST(a.embedding[i] AS DOUBLE)", "CAST(b.embedding[i] AS DOUBLE)"


def _first(v):
    return lambda t: rounded(_vector_pairs(t).select("vec_id", v().alias("v")).select("vec_id", F.size("v").cast("long").alias("dims"), F.get("v", F.lit(0)).alias("first")))


query("FN05_running_centroid", _blend_sql(f"({_A} * CAST(3 AS DOUBLE) + {_B}) / CAST(4 AS DOUBLE)"))(_first(lambda: V.running_centroid(F.col("a"), F.lit(3.0), F.col("b"))))
query("FN06_ema_blend", _blend_sql(f"{_A} * CAST(0.7 AS DOUBLE) + {_B} * CAST(0.3 AS DOUBLE)"))(_first(lambda: V.ema(F.col("a"), F.col("b"))))


@query("FN14_audio_features")
def _(t):
    ship(t.spark)
    e = t.raw("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("wave"))
    out = e.select("vec_id", audio.mfcc_column(F.col("wave")).alias("m"), audio.log_mel_column(F.col("wave")).alias("l"))
    least = F.array_min("l")
    return rounded(out.select("vec_id", F.size("m").cast("long").alias("coefficients"), F.get("m", F.lit(0)).alias("first"), F.size("l").cast("long").alias("cells"), least.alias("lowest_db")))


@query(
    "FN15_waveforms",
    """SELECT vec_id, round(list_max(list_transform(w, lambda x: abs(x))), 6) AS peak, len(s) AS samples, round(list_sum(list_transform(s, lambda x: abs(x))), 6) AS total
       FROM (SELECT *, list_transform(w, lambda x: x / m) AS w1, list_slice(list_transform(w, lambda x: x / m), 6, 20) AS s FROM (
         SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) + CAST(0.00000001 AS DOUBLE) AS m FROM embeddings))""",
)
def _(t):
    e = t.raw("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("w"))
    part = audio.time_slice(audio.peak_normalized(F.col("w")), F.lit(0.5), F.lit(2.0), F.lit(10.0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))
    return rounded(e.select("vec_id", F.array_max(F.transform("w", lambda x: F.abs(x))).alias("peak"), F.size(part).cast("long").alias("samples"), total(part).alias("total")))


@query("FN16_gray_difference", f"SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: abs({_A} - {_B}))) / len(a.embedding), 6) AS difference FROM {_NEXT}")
def _(t):
    return rounded(_vector_pairs(t).select("vec_id", audio.gray_difference(F.col("a"), F.col("b")).alias("difference")))


@query(
    "OR01_remaining",
    "SELECT o_orderkey FROM orders ANTI JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag = 'R') d USING (o_orderkey)",
)
def _(t):
    done = t.raw("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return runs.remaining(t.raw("orders"), done, ["o_orderkey"]).select("o_orderkey")


@query("OR02_reusable", "SELECT o_orderkey AS item, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AS reusable FROM orders")
def _(t):
    n = F.col("o_orderkey")
    items = t.raw("orders").select(n.alias("item"), F.concat(F.lit("/videos/"), n.cast("string")).alias("path"), (n * 11).alias("size_bytes"), (n * 13).alias("mtime_ns"))
    k = F.col("item")
    before = items.withColumn("size_bytes", F.when(k % 5 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
    before = before.withColumn("mtime_ns", F.when(k % 7 == 0, F.col("mtime_ns") - 1).otherwise(F.col("mtime_ns")))
    past = before.withColumn("status", F.when(k % 3 == 0, "running").otherwise("complete"))
    return runs.reusable(items, past, ["item"]).select("item", "reusable")


def _counted(pdf):
    video = int(pdf.video_id.iloc[0])
    if video == 3:
        raise ValueError(f"bad video {video}")
    return pdf.groupby("video_id", as_index=False).agg(boxes=("frame", "size"), last_frame=("frame", "max"))


@query(
    "OR03_failure_isolation",
    """SELECT video_id, CASE WHEN video_id <> 3 THEN count(*) END AS boxes, CASE WHEN video_id <> 3 THEN max(frame) END AS last_frame, CASE WHEN video_id = 3 THEN 'ValueError' END AS error,
       CASE WHEN video_id = 3 THEN 'bad video 3' END AS details FROM tracks GROUP BY video_id""",
    "tracks",
)
def _(t):
    return runs.isolated(t.tracks.select("video_id", "frame"), ["video_id"], _counted, "video_id long, boxes long, last_frame long")


@query("OR03_missing_inputs", "SELECT video_id, 'missing_required_files' AS error, CASE WHEN video_id = 0 THEN 'predictions.csv;tracks.csv' ELSE 'tracks.csv' END AS details FROM (SELECT DISTINCT video_id FROM tracks) WHERE video_id < 2", "tracks")
def _(t):
    files = t.videos.select("video_id", F.explode(F.array(F.lit("predictions.csv"), F.lit("tracks.csv"), F.lit("notes.txt"))).alias("name"))
    files = files.where("not (video_id = 0 and name <> 'notes.txt') and not (video_id = 1 and name = 'tracks.csv')")
    return runs.missing_inputs(t.videos, files, ["video_id"], ["tracks.csv", "predictions.csv"])


@query("OR04_run_metadata", "SELECT 'tracks' AS stage, 'complete' AS status, count(*) AS rows, max(frame) AS last_frame FROM tracks", "tracks")
def _(t):
    stage = runs.Stage("tracks", {"last_frame": F.max("frame")})
    r = stage.run(t.tracks, lambda df: df.write.format("noop").mode("overwrite").save())
    return t.spark.createDataFrame([(r["stage"], r["status"], r["rows"], r["last_frame"])], "stage string, status string, rows long, last_frame long")


@query(
    "SRC08_mot_truth",
    """SELECT concat_ws(',', frame + 1, video_id * 100 + ident, x1, y1, x2 - x1, y2 - y1, 1, 1, 1) AS value FROM truth WHERE ident % 2 = 0 AND frame % 5 <> 0""",
    "truth",
)
def _(t):
    from .sources.cvat import truth_rows
    from .sources.mot import mot_lines

    said = F.array(F.struct(F.lit("vocalization").alias("_name"), F.col("state").alias("_VALUE")))
    box = F.struct(F.col("frame").alias("_frame"), (F.col("frame") % 5 == 0).cast("int").alias("_outside"), *[F.col(c).alias(n) for c, n in zip(J.BOX, ("_xtl", "_ytl", "_xbr", "_ybr"), strict=True)], said.alias("attribute"))
    annotated = t.truth.groupBy("video_id", "ident").agg(F.collect_list(box).alias("box"))
    label = F.when(F.col("ident") % 2 == 0, "Dog").otherwise("cat")
    return mot_lines(truth_rows(annotated.select((F.col("video_id") * 100 + F.col("ident")).cast("string").alias("_id"), label.alias("_label"), "box")), truth=True)


@query("SRC10_lookup_video", "SELECT 'clip-' || lpad(CAST(o_custkey % 60 AS VARCHAR), 4, '0') AS video_id, o_orderkey AS row_no FROM orders WHERE o_custkey % 60 = 42 ORDER BY o_orderkey LIMIT 1")
def _(t):
    from .sources.files import lookup_video

    catalog = t.raw("orders").select(F.format_string("clip-%04d", F.col("o_custkey") % 60).alias("video_id"), F.col("o_orderkey").alias("row_no"))
    return lookup_video(catalog, "video_0042")


@query(
    "SRC12_clip_of_event",
    """SELECT 'e' || event_id || '_clip' || (event_id % 130) AS event_id, folder
       FROM events JOIN (SELECT i AS n, CASE i % 3 WHEN 0 THEN lpad(CAST(i AS VARCHAR), CAST(greatest(2, length(CAST(i AS VARCHAR))) AS INTEGER), '0') WHEN 1 THEN CAST(i AS VARCHAR) ELSE lpad(CAST(i AS VARCHAR), 3, '0') END AS folder FROM range(100) t(i)) c
       ON c.n = event_id % 130""",
)
def _(t):
    from .sources.cvat import clip_of

    n = F.col("id")
    folder = F.when(n % 3 == 0, F.format_string("%02d", n)).when(n % 3 == 1, n.cast("string")).otherwise(F.format_string("%03d", n))
    e = t.raw("events").select(F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit("_clip"), (F.col("event_id") % 130).cast("string")).alias("event_id"))
    return clip_of(e, t.spark.range(100).select(folder.alias("folder"))).select("event_id", "folder")


@query("SRC13_manifest_clips", "SELECT event_id, event_id * 7 AS clip_start_frame FROM events WHERE event_id % 4 <> 0")
def _(t):
    from .sources.cvat import manifest_clips

    e = t.raw("events").select("event_id")
    return manifest_clips(e, e.where("event_id % 4 <> 0").withColumn("clip_start_frame", F.col("event_id") * 7)).select("event_id", "clip_start_frame")


@query("SRC15_video_meta", "SELECT p_partkey AS video_id, p_size % 4 <> 0 AND p_partkey % 9 <> 0 AS valid, round(CASE WHEN p_size % 4 <> 0 AND p_partkey % 9 <> 0 THEN (p_partkey % 9) * 100 / CAST((p_size % 4) * 10 AS DOUBLE) END, 6) AS duration_sec FROM part")
def _(t):
    from .sources.files import video_meta

    meta = t.raw("part").select(F.col("p_partkey").alias("video_id"), ((F.col("p_size") % 4) * 10).cast("double").alias("fps"), F.lit(640).alias("width"), F.lit(480).alias("height"), ((F.col("p_partkey") % 9) * 100).alias("frames"))
    return rounded(video_meta(meta).select("video_id", "valid", "duration_sec"))


@query("SNK06_embedding_table", "SELECT video_id, 'track_' || track_id AS name, len(v) AS dims, round(CAST(CAST(v[1] AS FLOAT) AS DOUBLE), 4) AS first FROM emb", "emb")
def _(t):
    from .sources.files import embedding_table

    return rounded(embedding_table(t.emb).select("video_id", "name", F.size("vector").cast("long").alias("dims"), F.get("vector", F.lit(0)).cast("double").alias("first")), 4)


@query("SNK08_report", "SELECT printf('events: %d, users: %d, largest value: %.2f', count(*), count(DISTINCT user_id), max(value)) AS value FROM events")
def _(t):
    from .sources.files import report

    row = t.raw("events").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.max("value").alias("largest"))
    return report(row, "events: %d, users: %d, largest value: %.2f", "events", "users", "largest")


@query(
    "SS02_bursts",
    """SELECT video_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (
         SELECT *, sum(CASE WHEN gap IS NULL OR gap > 601000000 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM (
           SELECT user_id % 5 AS video_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id % 5 ORDER BY ts) AS gap FROM events)) GROUP BY video_id, burst""",
)
def _(t):
    from .streaming.windows import bursts

    e = t.raw("events").select((F.col("user_id") % 5).alias("video_id"), F.col("ts").cast("timestamp").alias("ts"))
    return bursts(e, "601 seconds").select("video_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, plan=plan: plan(Tables(spark, sf_dir))) for name, plan in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: re.sub(r'(?<!")\bat\b(?!")', '"at"', text) for name, text in _ORACLES.items()}  # a reserved word there

from . import file_queries  # noqa: E402, F401  registers the queries that go through files
