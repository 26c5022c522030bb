"""Tracking tables derived from the star-schema test tables, as DataFrames and as DuckDB common table expressions.

Every formula is integer arithmetic or one floating-point operation, so both engines hold equal values. See
FIXTURES.md for the formulas' reasons."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import profiles as P
from ..operators import rows as R
from ..operators import scenes as S
from ..operators import tracks as K
from ..session import written

FPS, SECONDS = 10.0, 250.0
TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


class Tables:
    """The derived tables of one folder; each is built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def det(self) -> DataFrame:
        """Detections with repeated (video, track, frame)."""
        li = self.raw("lineitem")
        df = li.select(*TIES, "l_discount", (F.col("l_suppkey") % 5).alias("video_id"), (F.col("l_partkey") % 6).alias("ident"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long").alias("frame"))
        ident, video, frame = F.col("ident"), F.col("video_id"), F.col("frame")
        half = F.floor(ident / 2)
        x1 = (half * 120 + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 21 + (ident % 2) * (video * 25)).cast("double")
        y1 = (F.floor(ident / 4) * 60 + (F.col("l_orderkey") * 11) % 17).cast("double")
        df = df.withColumn("track_id", ident * 4 + F.floor(frame / 700)).withColumn("time_sec", frame / FPS).withColumn("x1", x1).withColumn("y1", y1)
        return df.withColumn("x2", F.col("x1") + 100 + F.col("l_quantity")).withColumn("y2", F.col("y1") + 80 + 4 * F.col("l_linenumber")).withColumn("confidence", 1 - F.col("l_discount"))

    @property
    def best_first(self):
        return [F.desc("confidence"), *[F.asc(c) for c in TIES]]

    @cached_property
    def tracks(self) -> DataFrame:
        best = R.keep_one(self.det, ["video_id", "track_id", "frame"], self.best_first).select("video_id", "track_id", "ident", "frame", "time_sec", "x1", "y1", "x2", "y2", "confidence")
        return best.persist()  # a row for each track and frame; most plans read it several times

    @cached_property
    def videos(self) -> DataFrame:
        return self.tracks.select("video_id").distinct().select("video_id", F.lit(FPS).alias("fps"), F.lit(SECONDS).alias("video_duration_sec"))

    def vector(self, keys: DataFrame, a, b) -> DataFrame:
        """keys with v = E[a mod n] + 0.35 E[b mod n]."""
        e = self.raw("embeddings").select("vec_id", "embedding")
        n = e.agg(F.count("*").alias("__n"))
        e1, e2 = (e.select(F.col("vec_id").alias(i), F.col("embedding").alias(v)) for i, v in (("__a", "__va"), ("__b", "__vb")))
        picked = keys.join(F.broadcast(n)).withColumn("__a", a % F.col("__n")).withColumn("__b", b % F.col("__n"))  # n is one row
        joined = picked.join(e1, "__a").join(e2, "__b")
        return joined.withColumn("v", F.zip_with("__va", "__vb", lambda x, y: x.cast("double") + 0.35 * y.cast("double"))).drop("__a", "__b", "__n", "__va", "__vb")

    @cached_property
    def emb(self) -> DataFrame:
        keys = self.tracks.select("video_id", "track_id", "ident").distinct()
        return self.vector(keys, F.col("video_id") * 7 + F.floor(F.col("ident") / 2), F.col("video_id") * 31 + F.col("track_id") * 17 + 50)

    @cached_property
    def ev(self) -> DataFrame:
        e = self.raw("events")
        start = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 100000) % 2400) / 10.0
        return e.select("event_id", (F.col("user_id") % 5).alias("video_id"), start.alias("start"), (start + F.col("value") / 50.0).alias("end"), "event_type")

    @cached_property
    def infos(self) -> DataFrame:
        return K.info(self.tracks)

    @cached_property
    def quality(self) -> DataFrame:
        return K.quality(self.tracks)

    @cached_property
    def diffs(self) -> DataFrame:
        """Consecutive crop differences, standing in for decoded crops."""
        t = R.sampled_rows(self.tracks, ["video_id", "track_id"], [F.col("frame")], 9)
        return t.select("video_id", "track_id", "frame", (((F.col("frame") * 7 + F.col("track_id") * 3) % 40) / 10.0).alias("difference"))

    @cached_property
    def classes(self) -> DataFrame:
        return K.classified(self.quality, self.infos, K.internal_motion(self.diffs).select("video_id", "track_id", "median_internal_motion"), self.videos)

    @cached_property
    def pair_metrics(self) -> DataFrame:
        return K.pair_metrics(self.tracks, self.emb, self.videos)

    @cached_property
    def decisions(self) -> DataFrame:
        return K.decided(self.pair_metrics).persist()  # a row for each pair of tracks; candidates, vetoes and reports read it

    @cached_property
    def merged(self) -> DataFrame:
        return P.merged(self.decisions, self.tracks).persist()  # a row for each video

    @cached_property
    def clusters(self) -> DataFrame:
        return P.clusters(self.merged)

    @cached_property
    def fates(self) -> DataFrame:
        return P.suppressed(self.clusters, self.classes)

    @cached_property
    def profiles(self) -> DataFrame:
        return P.numbered(self.clusters, self.fates, self.infos)

    @cached_property
    def windows(self) -> DataFrame:
        return E.windows(self.ev)

    @cached_property
    def scored(self) -> DataFrame:
        """Window scores by a fixed rule in place of a classifier."""
        seen = E.seen_windows(self.windows, self.tracks)
        return seen.withColumn("score", ((F.col("event_id") * 37 + F.col("track_id") * 101 + F.col("window_index") * 13) % 1000) / 1000.0)

    @cached_property
    def scores(self) -> DataFrame:
        return E.candidate_scores(self.scored)

    @cached_property
    def predictions(self) -> DataFrame:
        return E.predictions(self.ev, E.rankings(self.scores))

    @cached_property
    def truth(self) -> DataFrame:
        """Annotated boxes: each identity's anchor, without jitter, on every third of its frames."""
        f = self.tracks.where("frame % 3 = 0").select("video_id", "ident", "frame").distinct()
        ident, video = F.col("ident"), F.col("video_id")
        x1 = (F.floor(ident / 2) * 120 + 10 + (ident % 2) * (video * 25)).cast("double")
        y1 = (F.floor(ident / 4) * 60 + 8).cast("double")
        f = f.withColumn("x1", x1).withColumn("y1", y1).withColumn("x2", x1 + 125).withColumn("y2", y1 + 96)
        return f.withColumn("state", F.when(F.col("frame") % 50 < 20, "barking").otherwise("not_barking"))

    @cached_property
    def asked(self) -> DataFrame:
        """Predicted events with five evenly spaced frames each."""
        p = self.predictions.where("predicted_track_id is not null").select("video_id", "event_id", "start", "end", F.col("predicted_track_id").alias("track_id"))
        lo, hi = F.floor(F.col("start") * FPS), F.ceil(F.col("end") * FPS)
        k = F.least(F.lit(5), hi - lo + 1)
        at = F.when(hi <= lo, F.array(lo)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), k.cast("long") - 1), lambda i: F.rint(lo + i * ((hi - lo) / F.greatest(k - 1, F.lit(1)))).cast("long"))))
        return written(p.select("*", F.explode(at).alias("at")))  # most plans read it twice

    @cached_property
    def samples(self) -> DataFrame:
        """Frame samples every half second, still for eight seconds after 2 s and before the end."""
        v = self.videos.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(SECONDS * 2) - 1).cast("long"))).alias("i"))
        v = v.withColumn("time_sec", F.col("i") / 2.0).withColumn("frame", F.col("i") * 5)
        calm = F.col("i").between(4, 20) | F.col("i").between(470, 490)
        return v.withColumn("gray", F.when(calm, ((F.col("video_id") * 5 + F.col("i")) % 4).cast("double")).otherwise(((F.col("video_id") * 53 + F.col("i") * 17) % 25).cast("double")))

    @cached_property
    def scene_samples(self) -> DataFrame:
        return S.guarded_difference(S.with_active_tracks(S.boundary_samples(self.samples, self.videos), self.tracks))

    @cached_property
    def intervals(self) -> DataFrame:
        return S.static_intervals(self.scene_samples)


#: DuckDB: name -> (names it needs, text). Written from the formulas, not from the plans above.
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "det0": ((), "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_suppkey % 5 AS video_id, l_partkey % 6 AS ident, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS frame FROM lineitem"),
    "det1": (("det0",), "SELECT *, ident * 4 + frame // 700 AS track_id, frame / 10.0 AS time_sec, CAST((ident // 2) * 120 + (l_orderkey * 7 + l_linenumber * 13) % 21 + (ident % 2) * (video_id * 25) AS DOUBLE) AS x1, CAST((ident // 4) * 60 + (l_orderkey * 11) % 17 AS DOUBLE) AS y1 FROM det0"),
    "det": (("det1",), "SELECT *, x1 + 100 + l_quantity AS x2, y1 + 80 + 4 * l_linenumber AS y2, 1 - l_discount AS confidence FROM det1"),
    "tracks": (("det",), "SELECT video_id, track_id, ident, frame, time_sec, x1, y1, x2, y2, confidence FROM det QUALIFY row_number() OVER (PARTITION BY video_id, track_id, frame ORDER BY confidence DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) = 1"),
    "emb": (("tracks",), "SELECT k.*, list_transform(range(1, len(a.embedding) + 1), lambda i: CAST(a.embedding[i] AS DOUBLE) + CAST(0.35 AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)) AS v FROM (SELECT DISTINCT video_id, track_id, ident FROM tracks) k JOIN embeddings a ON a.vec_id = (k.video_id * 7 + k.ident // 2) % (SELECT count(*) FROM embeddings) JOIN embeddings b ON b.vec_id = (k.video_id * 31 + k.track_id * 17 + 50) % (SELECT count(*) FROM embeddings)"),
    "ev": ((), "SELECT event_id, user_id % 5 AS video_id, ((epoch_us(ts) // 100000) % 2400) / 10.0 AS \"start\", ((epoch_us(ts) // 100000) % 2400) / 10.0 + value / 50.0 AS \"end\", event_type FROM events"),
    "infos": (("tracks",), "SELECT video_id, track_id, min(frame) AS first_frame, max(frame) AS last_frame, min(time_sec) AS first_time_sec, max(time_sec) AS last_time_sec, count(*) AS track_rows, avg(confidence) AS mean_confidence FROM tracks GROUP BY ALL"),
    "steps": (("tracks",), "SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS diag, (x1 + x2) / 2 - lag((x1 + x2) / 2) OVER w AS dx, (y1 + y2) / 2 - lag((y1 + y2) / 2) OVER w AS dy FROM tracks WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)"),
    "quality0": (("steps",), "SELECT video_id, track_id, max(time_sec) - min(time_sec) AS duration_sec, greatest(1, max(frame) - min(frame) + 1) AS frame_span, count(*) AS rows, coalesce(sum(sqrt(dx * dx + dy * dy)), 0.0) AS total_center_movement, median(diag) AS median_box_diagonal FROM steps GROUP BY ALL"),
    "quality": (("quality0",), "SELECT *, rows / frame_span AS observation_density, total_center_movement / greatest(median_box_diagonal, 0.000001) AS normalized_motion, duration_sec >= 5.0 AND total_center_movement / greatest(median_box_diagonal, 0.000001) <= 0.15 AS static_suspect, rows / frame_span <= 0.02 AND rows <= 20 AS sparse_suspect FROM quality0"),
    "sampled": (("tracks",), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY video_id, track_id) AS n FROM tracks) WHERE list_contains(list_transform(range(0, least(9, n)), lambda k: CAST(round_even(k * ((n - 1) / greatest(least(9, n) - 1, 1)), 0) AS BIGINT)), i)"),
    "motion": (("sampled",), "SELECT video_id, track_id, count(*) AS internal_motion_pairs, avg(((frame * 7 + track_id * 3) % 40) / 10.0) AS mean_internal_motion, median(((frame * 7 + track_id * 3) % 40) / 10.0) AS median_internal_motion, max(((frame * 7 + track_id * 3) % 40) / 10.0) AS max_internal_motion FROM sampled GROUP BY ALL"),
    "classes": (("quality", "infos", "motion"), "SELECT q.*, m.median_internal_motion, i.last_time_sec <= 15 AS intro_only, i.first_time_sec >= 235 AS outro_only, i.last_time_sec <= 15 OR i.first_time_sec >= 235 AS boundary_only, coalesce(m.median_internal_motion <= 1.5, false) AS nearly_pixel_static, (i.last_time_sec <= 15 OR i.first_time_sec >= 235) AND q.static_suspect AND coalesce(m.median_internal_motion <= 1.5, false) AS likely_image_or_screen, CASE WHEN (i.last_time_sec <= 15 OR i.first_time_sec >= 235) AND q.static_suspect AND coalesce(m.median_internal_motion <= 1.5, false) THEN 'likely_intro_outro_image' WHEN q.static_suspect AND NOT coalesce(m.median_internal_motion <= 1.5, false) THEN 'static_real_candidate' WHEN q.static_suspect THEN 'static_uncertain' WHEN q.sparse_suspect THEN 'sparse_candidate' ELSE 'active_real_candidate' END AS track_classification FROM quality q JOIN infos i USING (video_id, track_id) LEFT JOIN motion m USING (video_id, track_id)"),
    "co0": (("tracks",), "SELECT a.video_id, a.track_id AS l, b.track_id AS r, a.frame, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter, (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ab, greatest(0, a.x1 - b.x2, b.x1 - a.x2) AS gx, greatest(0, a.y1 - b.y2, b.y1 - a.y2) AS gy, (a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2 AS cx, (a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2 AS cy, greatest(0.000001, least(sqrt((a.x2 - a.x1) ** 2 + (a.y2 - a.y1) ** 2), sqrt((b.x2 - b.x1) ** 2 + (b.y2 - b.y1) ** 2))) AS diag FROM tracks a JOIN tracks b ON a.video_id = b.video_id AND a.frame = b.frame AND a.track_id < b.track_id"),
    "common": (("co0",), "SELECT video_id, l, r, count(*) AS n, median(inter / (aa + ab - inter)) AS miou, avg(inter / (aa + ab - inter)) AS aiou, median(sqrt(gx * gx + gy * gy) / diag) AS gap, median(sqrt(cx * cx + cy * cy) / diag) AS dist, median(inter / greatest(0.000001, least(aa, ab))) AS ios, median(least(aa, ab) / greatest(0.000001, aa, ab)) AS ratio FROM co0 GROUP BY ALL"),
    "gaps": (("tracks",), "SELECT a.video_id, a.track_id AS l, b.track_id AS r, min(abs(a.frame - b.frame)) AS frame_gap FROM tracks a JOIN tracks b ON a.video_id = b.video_id AND a.track_id < b.track_id GROUP BY ALL"),
    "sims": (("emb",), "SELECT a.video_id, a.track_id AS l, b.track_id AS r, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 0.000000000001), 9) AS sim FROM emb a JOIN emb b ON a.video_id = b.video_id AND a.track_id < b.track_id"),
    "metrics": (("gaps", "common", "sims", "infos"), "SELECT g.video_id, g.l, g.r, coalesce(c.n, 0) AS n, coalesce(c.n, 0) / greatest(1, least(a.track_rows, b.track_rows)) AS share, c.miou, c.aiou, c.gap, c.dist, c.ios, c.ratio, s.sim, g.frame_gap, g.frame_gap / 10.0 AS gap_sec FROM gaps g LEFT JOIN common c USING (video_id, l, r) LEFT JOIN sims s USING (video_id, l, r) JOIN infos a ON a.video_id = g.video_id AND a.track_id = g.l JOIN infos b ON b.video_id = g.video_id AND b.track_id = g.r"),
    "flags": (("metrics",), "SELECT *, coalesce(n >= 3 AND round(miou, 9) < 0.20, false) AS different, coalesce(n >= 2 AND round(miou, 9) >= 0.35 AND sim >= 0.75, false) AS dup, coalesce(n >= 2 AND sim >= 0.88 AND round(dist, 9) <= 0.50 AND (round(miou, 9) >= 0.08 OR round(ios, 9) >= 0.25), false) AS part, coalesce(n < 3 AND gap_sec <= 120 AND sim >= 0.65, false) AS again FROM metrics"),
    "decisions": (("flags",), "SELECT *, CASE WHEN dup THEN 'candidate_duplicate_overlap' WHEN part THEN 'candidate_part_based_duplicate' WHEN again AND NOT different THEN 'candidate_fragment_reid' WHEN different THEN 'blocked_simultaneous_different_dogs' ELSE 'below_merge_threshold' END AS decision, CASE WHEN dup THEN 2 WHEN part THEN 3 WHEN again AND NOT different THEN 1 END AS priority FROM flags"),
    "cand": (("decisions",), "SELECT video_id, l, r, decision, part AND NOT dup AS free, row_number() OVER (PARTITION BY video_id ORDER BY priority DESC, CASE priority WHEN 2 THEN round(miou, 9) ELSE sim END DESC, CASE priority WHEN 2 THEN sim WHEN 3 THEN coalesce(-round(gap, 9), -999.0) ELSE coalesce(round(miou, 9), -1.0) END DESC, frame_gap, gap_sec DESC, decision DESC, l DESC, r DESC) AS k FROM decisions WHERE priority IS NOT NULL"),
    "ids": (("tracks",), "SELECT video_id, list_sort(list(DISTINCT track_id)) AS ids FROM tracks GROUP BY ALL"),
    "blocked": (("decisions",), "SELECT video_id, list({'a': l, 'b': r}) AS bs FROM decisions WHERE different GROUP BY ALL"),
    "fold": (("cand", "ids", "blocked"), """
      SELECT i.video_id, CAST(0 AS BIGINT) AS k, i.ids, i.ids AS lab, [] :: BIGINT[] AS acc, coalesce(b.bs, []) AS bs FROM ids i LEFT JOIN blocked b USING (video_id)
      UNION ALL
      SELECT video_id, k, ids, CASE WHEN ok THEN list_transform(lab, lambda x: CASE WHEN x = greatest(la, lb) THEN least(la, lb) ELSE x END) ELSE lab END, CASE WHEN ok THEN list_append(acc, k) ELSE acc END, bs
      FROM (SELECT *, la <> lb AND (free OR NOT coalesce(list_bool_or(list_transform(bs, lambda p: (lab[list_position(ids, p.a)] = la AND lab[list_position(ids, p.b)] = lb) OR (lab[list_position(ids, p.a)] = lb AND lab[list_position(ids, p.b)] = la))), false)) AS ok
            FROM (SELECT f.video_id, c.k, f.ids, f.lab, f.acc, f.bs, c.free, f.lab[list_position(f.ids, c.l)] AS la, f.lab[list_position(f.ids, c.r)] AS lb FROM fold f JOIN cand c ON c.video_id = f.video_id AND c.k = f.k + 1))"""),
    "folded": (("fold",), "SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY k DESC) = 1"),
    "clusters": (("folded",), "SELECT video_id, unnest(ids) AS track_id, unnest(lab) AS cluster FROM folded"),
    "merges": (("folded", "cand"), "SELECT c.video_id, c.l, c.r, c.decision, row_number() OVER (PARTITION BY c.video_id ORDER BY c.k) - 1 AS merge_seq FROM folded f JOIN cand c ON c.video_id = f.video_id AND list_contains(f.acc, c.k)"),
    "fates": (("clusters", "classes"), "SELECT video_id, cluster, bool_and(sparse_suspect) AS all_sparse, bool_and(likely_image_or_screen) AS all_images, count(*) AS tracks, CASE WHEN bool_and(sparse_suspect) THEN 'standalone_sparse_track' END AS suppress_reason FROM clusters JOIN classes USING (video_id, track_id) GROUP BY ALL"),
    "profiles": (("clusters", "fates", "infos"), "SELECT c.video_id, c.track_id, c.cluster, 'dog_' || n.n AS persistent_profile_id FROM clusters c JOIN (SELECT video_id, cluster, row_number() OVER (PARTITION BY video_id ORDER BY t, least) AS n FROM (SELECT video_id, cluster, min(first_time_sec) AS t, min(track_id) AS least FROM clusters JOIN infos USING (video_id, track_id) JOIN fates USING (video_id, cluster) WHERE suppress_reason IS NULL GROUP BY video_id, cluster)) n USING (video_id, cluster)"),
    "heard": (("predictions", "profiles"), """
      SELECT p.video_id, p.event_id, p."start", p."end", p."end" - p."start" AS dur, q.persistent_profile_id AS vis, row_number() OVER (PARTITION BY p.video_id ORDER BY p."start", p."end", p.event_id) AS k,
             list_transform(range(1, len(a.embedding) + 1), lambda i: CAST(a.embedding[i] AS DOUBLE) + CAST(0.35 AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)) AS v
      FROM predictions p JOIN embeddings a ON a.vec_id = (p.video_id * 7 + p.event_id % 3) % (SELECT count(*) FROM embeddings) JOIN embeddings b ON b.vec_id = (p.event_id * 29 + 11) % (SELECT count(*) FROM embeddings)
      LEFT JOIN profiles q ON q.video_id = p.video_id AND q.track_id = p.predicted_track_id AND p.event_id % 4 <> 0"""),
    "voiced": (("heard",), """
      SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS k, [] :: VARCHAR[] AS names, [] :: BIGINT[] AS counts, [] :: DOUBLE[][] AS cents, CAST(0 AS BIGINT) AS created, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS DOUBLE) AS "start", CAST(NULL AS DOUBLE) AS "end",
             CAST(NULL AS VARCHAR) AS profile, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS best, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS BOOLEAN) AS agreement, CAST(NULL AS VARCHAR) AS decision, CAST(NULL AS VARCHAR) AS status FROM heard
      UNION ALL
      SELECT video_id, k, CASE WHEN NOT ok THEN names WHEN place > 0 THEN names ELSE list_append(names, target) END,
             CASE WHEN NOT ok THEN counts WHEN place > 0 THEN list_transform(counts, lambda c, i: c + CASE WHEN i = place THEN 1 ELSE 0 END) ELSE list_append(counts, CAST(1 AS BIGINT)) END,
             CASE WHEN NOT ok THEN cents WHEN place > 0 THEN list_transform(cents, lambda c, i: CASE WHEN i = place THEN list_transform(mixed, lambda x: x / sqrt(list_dot_product(mixed, mixed))) ELSE c END) ELSE list_append(cents, list_transform(mixed, lambda x: x / sqrt(list_dot_product(mixed, mixed)))) END,
             created + CASE WHEN ok AND fresh THEN 1 ELSE 0 END, event_id, "start", "end",
             CASE WHEN ok THEN target ELSE vis END, CASE WHEN NOT ok THEN CASE WHEN vis IS NULL THEN 'none' ELSE 'visual' END WHEN vis IS NULL THEN 'audio' ELSE 'visual_plus_audio' END,
             CASE WHEN ok THEN best END, CASE WHEN ok THEN CASE WHEN vis IS NULL THEN score ELSE coalesce(own, score) END END,
             CASE WHEN NOT ok OR fresh THEN NULL WHEN vis IS NULL THEN true ELSE NOT clash AND coalesce(best = vis, true) END,
             CASE WHEN NOT ok THEN CASE WHEN vis IS NULL THEN 'unassigned_audio_not_scored' ELSE 'visible_profile_audio_not_scored' END WHEN fresh THEN 'created_offscreen_audio_only_profile' WHEN vis IS NULL THEN 'offscreen_matched_existing_profile_by_audio'
                  WHEN clash THEN 'audio_visual_identity_conflict' ELSE 'attached_to_visible_all_dog_profile' END,
             CASE WHEN ok THEN 'ok' ELSE printf('invalid_duration_%.3f', dur) END
      FROM (SELECT *, coalesce(list_position(names, target), 0) AS place, list_transform(range(1, len(v) + 1), lambda i: coalesce((cents[list_position(names, target)][i] * counts[list_position(names, target)] + v[i]) / (counts[list_position(names, target)] + 1), v[i])) AS mixed
        FROM (SELECT *, vis IS NULL AND NOT coalesce(score >= 0.6, false) AS fresh, vis IS NOT NULL AND coalesce(best <> vis AND score >= 0.6, false) AS clash,
                     CASE WHEN vis IS NOT NULL THEN vis WHEN coalesce(score >= 0.6, false) THEN best ELSE 'audio_only_dog_' || (created + 1) END AS target
          FROM (SELECT *, names[list_position(scores, list_max(scores))] AS best, list_max(scores) AS score, scores[list_position(names, vis)] AS own
            FROM (SELECT w.video_id, h.k, w.names, w.counts, w.cents, w.created, h.event_id, h."start", h."end", h.dur, h.vis, h.v, h.dur >= 0.25 AND h.dur <= 5.0 AS ok,
                         list_transform(w.cents, lambda c: round(list_dot_product(c, h.v) / (sqrt(list_dot_product(h.v, h.v)) * sqrt(list_dot_product(c, c)) + 0.000000000001), 9)) AS scores
                  FROM voiced w JOIN heard h ON h.video_id = w.video_id AND h.k = w.k + 1))))"""),
    "candidates": (("ev", "tracks"), "SELECT DISTINCT e.video_id, e.event_id, t.track_id FROM ev e JOIN tracks t ON t.video_id = e.video_id AND t.time_sec >= e.\"start\" - 0.000000001 AND t.time_sec <= e.\"end\" + 0.000000001"),
    "windows": (("ev",), "SELECT video_id, event_id, \"start\", \"end\", unnest(range(0, len(ws))) AS window_index, unnest(ws) AS window_start, least(\"end\", unnest(ws) + 2.0) AS window_end FROM (SELECT *, CASE WHEN \"end\" - \"start\" <= 2.0 + 0.000001 THEN [\"start\"] ELSE list_concat(list_transform(range(0, CAST(floor(\"end\" - 2.0 - \"start\" + 0.000001) AS BIGINT) + 1), lambda i: \"start\" + i * 1.0), CASE WHEN \"start\" + floor(\"end\" - 2.0 - \"start\" + 0.000001) < \"end\" - 2.0 - 0.000001 THEN [\"end\" - 2.0] ELSE [] END) END AS ws FROM ev)"),
    "scored": (("windows", "tracks"), "SELECT DISTINCT w.video_id, w.event_id, t.track_id, w.window_index, w.window_start, ((w.event_id * 37 + t.track_id * 101 + w.window_index * 13) % 1000) / 1000.0 AS score FROM windows w JOIN tracks t ON t.video_id = w.video_id AND t.time_sec >= w.window_start - 0.000000001 AND t.time_sec <= w.window_end + 0.000000001"),
    "scores": (("scored",), "SELECT video_id, event_id, track_id, round(avg(score), 9) AS mean_score, max(score) AS max_score, count(*) AS window_count, list(score ORDER BY window_index) AS window_scores, list(window_start ORDER BY window_index) AS starts FROM scored GROUP BY ALL"),
    "ranks": (("scores",), "SELECT *, row_number() OVER (PARTITION BY video_id, event_id ORDER BY mean_score DESC, track_id) AS rank FROM scores"),
    "predictions": (("ev", "ranks"), "SELECT e.video_id, e.event_id, e.\"start\", e.\"end\", CASE WHEN count(r.track_id) = 0 THEN 'outside_or_offscreen' ELSE 'predicted' END AS status, count(r.track_id) AS num_candidates, max(r.track_id) FILTER (WHERE rank = 1) AS predicted_track_id, max(mean_score) FILTER (WHERE rank = 1) AS top_score, max(mean_score) FILTER (WHERE rank = 2) AS second_score, string_agg(CAST(r.track_id AS VARCHAR), ',' ORDER BY rank) AS ids FROM ev e LEFT JOIN ranks r USING (video_id, event_id) GROUP BY ALL"),
    "truth": (("tracks",), "SELECT DISTINCT video_id, ident, frame, CAST((ident // 2) * 120 + 10 + (ident % 2) * (video_id * 25) AS DOUBLE) AS x1, CAST((ident // 4) * 60 + 8 AS DOUBLE) AS y1, CAST((ident // 2) * 120 + 10 + (ident % 2) * (video_id * 25) AS DOUBLE) + 125 AS x2, CAST((ident // 4) * 60 + 8 AS DOUBLE) + 96 AS y2, CASE WHEN frame % 50 < 20 THEN 'barking' ELSE 'not_barking' END AS state FROM tracks WHERE frame % 3 = 0"),
    "asked": (("predictions",), "SELECT video_id, event_id, \"start\", \"end\", track_id, unnest(list_distinct(CASE WHEN hi <= lo THEN [lo] ELSE list_transform(range(0, k), lambda i: CAST(round_even(lo + i * ((hi - lo) / greatest(k - 1, 1)), 0) AS BIGINT)) END)) AS at FROM (SELECT video_id, event_id, \"start\", \"end\", predicted_track_id AS track_id, CAST(floor(\"start\" * 10.0) AS BIGINT) AS lo, CAST(ceil(\"end\" * 10.0) AS BIGINT) AS hi, least(5, CAST(ceil(\"end\" * 10.0) AS BIGINT) - CAST(floor(\"start\" * 10.0) AS BIGINT) + 1) AS k FROM predictions WHERE predicted_track_id IS NOT NULL)"),
    "samples": (("tracks",), "SELECT video_id, i, i / 2.0 AS time_sec, i * 5 AS frame, CASE WHEN i BETWEEN 4 AND 20 OR i BETWEEN 470 AND 490 THEN CAST((video_id * 5 + i) % 4 AS DOUBLE) ELSE CAST((video_id * 53 + i * 17) % 25 AS DOUBLE) END AS gray, CASE WHEN i / 2.0 <= 20 THEN 'intro' ELSE 'outro' END AS side FROM (SELECT DISTINCT video_id FROM tracks), range(0, 500) t(i)"),
    "near": (("samples", "tracks"), "SELECT s.*, CASE WHEN s.time_sec - lag(s.time_sec) OVER w <= 0.75 THEN s.gray END AS frame_difference, (SELECT count(DISTINCT t.track_id) FROM tracks t WHERE t.video_id = s.video_id AND t.frame BETWEEN s.frame - 3 AND s.frame + 3) AS active FROM samples s WHERE s.time_sec <= 20 OR s.time_sec >= 230 WINDOW w AS (PARTITION BY s.video_id ORDER BY s.time_sec)"),
    "runs": (("near",), "SELECT *, sum(CASE WHEN coalesce(frame_difference <= 3.0, false) THEN 0 ELSE 1 END) OVER (PARTITION BY video_id, side ORDER BY time_sec ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM near"),
    "intervals": (("runs",), "SELECT video_id, side, min(time_sec) AS start_sec, max(time_sec) AS end_sec, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS samples, median(frame_difference) AS median_difference, max(active) AS max_active, median(active) AS median_active, max(time_sec) - min(time_sec) + 0.5 AS duration_sec FROM runs WHERE frame_difference <= 3.0 GROUP BY video_id, side, island HAVING max(time_sec) - min(time_sec) + 0.5 >= 3.0"),
}


#: Those that read themselves.
RECURSIVE = ("fold", "voiced")


def sql(body: str, *names: str) -> str:
    """body with the common table expressions it names, and those they need, before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in CTE[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    # a table read twice is made once: DuckDB would put its text in both places
    ctes = ",\n".join(f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({CTE[n][1]})" for n in order)
    return f"WITH RECURSIVE {ctes}\n{body}" if ctes else body
