"""Registered queries that go through files: each writes a table with a sink, or as text in a source's format, and reads it back.

Files lie in a scratch folder that all executors share. Their SQL is on the tables that they were made of."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from .functions import geometry as G
from .operators import assign, mot, runs
from .operators import joins as J
from .queries import _FUSED_SQL, _heard, query, rounded
from .session import scratch, written
from .sources import cvat, files
from .sources.mot import read_mot

_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
_ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice FROM orders"
_ORDERS_SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"


def _put(path, value, key):
    """One text file for each row, in a folder key=..."""
    value.repartition(key).write.partitionBy(key).text(path)


# --- CSV and JSON ------------------------------------------------------------------------------------------------

@query("SRC01_csv", _ORDERS_SQL)
def _(t):
    path = scratch(t.spark)
    t.raw("orders").select("o_orderstatus", F.col("o_totalprice").alias("O_TotalPrice"), "o_custkey", "o_orderkey", "o_orderdate").write.option("header", True).csv(path)
    return rounded(files.read_csv(t.spark, path, _ORDERS_SCHEMA))  # by name, in any order and case


@query("SRC02_tolerant_csv", "SELECT c_custkey, c_name, CAST(NULL AS DOUBLE) AS c_score FROM customer")
def _(t):
    base = scratch(t.spark)
    t.raw("customer").select("c_custkey", "c_name").write.option("header", True).csv(f"{base}/some")
    t.spark.range(1).select(F.lit("").alias("value")).write.text(f"{base}/empty")
    schema = "c_custkey long, c_name string, c_score double"
    out = files.read_csv(t.spark, f"{base}/some", schema, tolerant=True)
    for nothing in ("none", "empty"):
        out = out.unionByName(files.read_csv(t.spark, f"{base}/{nothing}", schema, tolerant=True).where("c_custkey is not null"))
    return out


@query("SRC03_json_list", "SELECT s_suppkey, s_name, round(s_acctbal, 6) AS s_acctbal FROM supplier")
def _(t):
    path = scratch(t.spark)
    each = F.to_json(F.struct("s_suppkey", "s_name", "s_acctbal"))
    lists = t.raw("supplier").groupBy("s_nationkey").agg(F.concat(F.lit("\n[7, "), F.array_join(F.collect_list(each), ", \"no object\", "), F.lit(", null]")).alias("value"))
    _put(path, lists, "s_nationkey")
    return rounded(files.read_json_list(t.spark, path, "s_suppkey long, s_name string, s_acctbal double"))


@query("SRC04_json_documents", "SELECT s_nationkey AS nation, count(*) AS suppliers, max(s_suppkey) AS last FROM supplier GROUP BY ALL")
def _(t):
    path = scratch(t.spark)
    whole = F.to_json(F.struct(F.col("s_nationkey").alias("nation"), F.col("n").alias("suppliers"), "last"))
    docs = t.raw("supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.max("s_suppkey").alias("last")).select(F.col("s_nationkey").alias("part"), whole.alias("value"))
    _put(path, docs.unionByName(t.spark.createDataFrame([(-1, "{ broken")], docs.schema)), "part")
    schema = "nation long, suppliers long, last long"
    found = files.read_json_document(t.spark, path, schema).where("nation is not null")
    return found.unionByName(files.read_json_document(t.spark, f"{path}/none", schema))


@query("SNK01_csv", _ORDERS_SQL)
def _(t):
    path = scratch(t.spark)
    files.write_csv(t.raw("orders"), path, _ORDERS)
    return rounded(t.spark.read.option("header", True).schema(_ORDERS_SCHEMA).csv(path))


@query("SNK02_replaced_csv", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0")
def _(t):
    path = scratch(t.spark)
    orders = t.raw("orders")
    files.write_csv(orders, path, ["o_orderkey", "o_orderstatus", "o_comment"] if "o_comment" in orders.columns else ["o_orderkey", "o_orderstatus"])
    back = files.read_csv(t.spark, path, "o_orderkey long, o_orderstatus string")
    files.write_csv(back.where("o_orderkey % 3 = 0"), path)  # the table that is read is the one that is replaced
    return files.read_csv(t.spark, path, "o_orderkey long, o_orderstatus string")


@query("SNK03_json", "SELECT video_id, tracks, round(seconds, 6) AS seconds, last FROM (SELECT video_id, count(*) AS tracks, sum(last_time_sec - first_time_sec) AS seconds, max(last_frame) AS last FROM infos GROUP BY ALL)", "infos")
def _(t):
    path = scratch(t.spark)
    files.write_json(t.infos.groupBy("video_id").agg(F.count("*").alias("tracks"), F.sum(F.col("last_time_sec") - F.col("first_time_sec")).alias("seconds"), F.max("last_frame").alias("last")), path)
    return rounded(t.spark.read.schema("video_id long, tracks long, seconds double, last long").json(path))


# --- annotation files --------------------------------------------------------------------------------------------

def _annotated(t) -> str:
    """The truth as annotation files, one for each video."""
    path = scratch(t.spark)
    _put(path, _documents(t.truth, ["video_id"]), "video_id")
    return path


def _documents(truth, keys):
    """An annotation document for each key. Every fifth frame's box is outside; names of attributes change their case, and a second
    one of that name says something else."""
    said = F.concat(F.lit('<attribute name="'), F.when(F.col("frame") % 2 == 0, "Vocalization").otherwise("vocalization"), F.lit('">'), F.initcap(F.translate("state", "_", " ")), F.lit('</attribute><attribute name="Vocalization">other</attribute>'))
    numbers = [F.concat(F.lit(f' {n}="'), F.col(c).cast("string"), F.lit('"')) for n, c in zip(("frame", "xtl", "ytl", "xbr", "ybr"), ("frame", *J.BOX), strict=True)]
    box = F.concat(F.lit('<box outside="'), (F.col("frame") % 5 == 0).cast("int").cast("string"), F.lit('"'), *numbers, F.lit(">"), said, F.lit("</box>"))
    track = F.concat(F.lit('<track id="'), F.col("ident").cast("string"), F.lit('" label="'), F.when(F.col("ident") % 2 == 0, "Dog").otherwise("cat"), F.lit('">'), F.array_join(F.collect_list(box), "\n"), F.lit("</track>"))
    tracks = truth.groupBy(*keys, "ident").agg(track.alias("track"))
    whole = F.concat(F.lit('<?xml version="1.0"?>\n<annotations>\n'), F.array_join(F.collect_list("track"), "\n"), F.lit("\n</annotations>"))
    return tracks.groupBy(*keys).agg(whole.alias("value"))


_BOX_SQL = """SELECT video_id, CAST(ident AS VARCHAR) AS ident, CASE WHEN ident % 2 = 0 THEN 'Dog' ELSE 'cat' END AS label, frame{offset} AS frame, x1, y1, x2, y2, {state} FROM truth WHERE frame % 5 <> 0"""


def _of_video(t, path, read):
    """read for each video's file, as a driver does: the files are few, their rows are not."""
    videos = [r.video_id for r in t.videos.select("video_id").orderBy("video_id").collect()]
    parts = [read(cvat.read_cvat(t.spark, f"{path}/video_id={v}")).withColumn("video_id", F.lit(v).cast("long")) for v in videos]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("value")


@query("SRC05_barking_boxes", _BOX_SQL.format(offset="", state="state") + " AND state = 'barking'", "truth")
def _(t):
    return _of_video(t, _annotated(t), lambda x: cvat.barking_boxes(x, "Barking"))


@query("SRC06_boxes", _BOX_SQL.format(offset="", state="state"), "truth")
def _(t):
    return _of_video(t, _annotated(t), cvat.boxes)


@query("SRC07_shifted_boxes", _BOX_SQL.format(offset=" + 250", state="state"), "truth")
def _(t):
    return _of_video(t, _annotated(t), lambda x: cvat.boxes(x, offset=250))


@query("UD03_ground_truth", "SELECT video_id, video_id * 1000 + frame // 50 AS event_id, CAST(ident AS VARCHAR) AS ident, CASE WHEN ident % 2 = 0 THEN 'Dog' ELSE 'cat' END AS label, frame, x1, y1, x2, y2, state FROM truth WHERE (frame - frame // 50 * 50) % 5 <> 0 AND (frame // 50) % 4 <> 1 AND (frame // 50) % 7 <> 2", "truth")
def _(t):
    """Clips of five seconds, of which every fourth is not annotated and every seventh not asked for. A clip's frames begin at 0."""
    path = scratch(t.spark)
    n = F.floor(F.col("frame") / 50)
    clips = t.truth.withColumn("event_id", F.col("video_id") * 1000 + n).withColumn("start", n * 50)
    events = written(clips.select("video_id", "event_id", F.col("start").alias("clip_start_frame")).distinct())
    annotated = clips.where((F.col("start") / 50) % 4 != 1).withColumn("frame", F.col("frame") - F.col("start"))
    docs = _documents(annotated, ["video_id", "event_id"]).withColumn("clip", F.concat(F.lpad(F.col("event_id").cast("string"), 7, "0"), F.lit("_bark")))
    docs.select("video_id", "clip", "value").repartition("video_id", "clip").write.partitionBy("video_id", "clip").text(path)
    asked = events.where((F.col("clip_start_frame") / 50) % 7 != 2)
    return cvat.ground_truth(t.spark, path, asked).drop("value")


@query(
    "SRC09_mot_text",
    """, rows AS (SELECT video_id, frame - least(0, min(frame) OVER (PARTITION BY video_id)) + CASE WHEN min(frame) OVER (PARTITION BY video_id) = 0 THEN 1 ELSE 0 END AS frame, track_id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h, confidence AS conf FROM tracks),
         named AS (SELECT track_id, row_number() OVER (ORDER BY first) AS n FROM (SELECT track_id, min(frame * 1000 + track_id) AS first FROM tracks WHERE video_id = 4 GROUP BY ALL))
       SELECT video_id, frame, CASE WHEN video_id = 4 THEN n ELSE r.track_id END AS id, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h, round(CASE WHEN video_id = 1 THEN 1 ELSE conf END, 6) AS conf, 1.0 AS cls, 1.0 AS vis
       FROM rows r LEFT JOIN named USING (track_id)""",
    "tracks",
)
def _(t):
    path = scratch(t.spark)
    video = F.col("video_id")
    name = F.when(video == 4, F.concat(F.lit("dog_"), F.col("track_id").cast("string"))).otherwise(F.col("track_id").cast("string"))
    parts = [c.cast("string") for c in (F.col("frame"), *G.xywh(G.box()))]
    line = F.concat_ws(",", parts[0], name, *parts[1:], F.when(video != 1, F.col("confidence").cast("string")))
    line = F.when(video == 2, F.concat(F.translate(line, ",", "\t"), F.lit("\t\t"))).otherwise(line)
    lines = t.tracks.select("video_id", "frame", "track_id", line.alias("value"), F.lit(0).alias("again"))
    again = lines.where("video_id = 3").select("video_id", "frame", "track_id", F.concat_ws(",", F.slice(F.split("value", ","), 1, 6), F.lit("-1")).alias("value"), F.lit(1).alias("again"))  # less sure
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("again", "frame", "track_id", "value"))), lambda x: x["value"])
    _put(path, lines.unionByName(again).groupBy("video_id").agg(F.array_join(in_order, "\n").alias("value")), "video_id")
    found = read_mot(t.spark, path)
    return rounded(found.withColumn("video_id", F.regexp_extract("file", "video_id=([0-9]+)", 1).cast("long")).drop("file"))


# --- finding files -----------------------------------------------------------------------------------------------

@query("SRC11_work_items", "SELECT CAST(n_nationkey AS BIGINT) AS item, 1 AS files FROM nation WHERE n_nationkey % 4 <> 3")
def _(t):
    path = scratch(t.spark)
    n = F.col("n_nationkey")
    folder = F.when(n % 4 != 3, F.concat(F.lpad(n.cast("string"), 3, "0"), F.lit("_clip"))).otherwise(F.concat(F.lit("notes-"), n.cast("string")))
    _put(path, t.raw("nation").select(folder.alias("clip"), F.col("n_name").alias("value")), "clip")
    return files.work_items(t.spark, path).groupBy("item").agg(F.count("*").alias("files"))


@query(
    "SRC14_first_existing",
    """SELECT o_custkey, arg_min(layout, o_orderkey % 5 * 10000000 + o_orderkey) AS layout FROM (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN 'raw' WHEN 1 THEN 'full' ELSE 'clips' END || '/' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS layout FROM orders WHERE o_orderkey % 7 < 4) GROUP BY ALL""",
)
def _(t):
    n = F.col("o_orderkey")
    path = F.concat(F.when(n % 5 == 0, "raw").when(n % 5 == 1, "full").otherwise("clips"), F.lit("/"), F.lpad(n.cast("string"), 10, "0"))
    tried = t.raw("orders").select("o_custkey", path.alias("path"), (n % 5).alias("priority"), (n % 7 < 4).alias("exists"))
    return files.first_existing(tried, ["o_custkey"], "priority").select("o_custkey", F.col("path").alias("layout"))


# --- matrices and assignments ------------------------------------------------------------------------------------

@query("FN09_iou_matrix", "SELECT video_id, frame, l, r, round(inter / (aa + ab - inter), 6) AS iou FROM co0 WHERE inter > 0", "co0")
def _(t):
    """IoU matrices of a video's frames, some hundred of them in a group."""

    def run(table: pa.Table) -> pd.DataFrame:
        pdf, out = table.to_pandas().sort_values(["frame", "track_id"]), []
        for frame, rows in pdf.groupby("frame"):
            m = mot.boxes_iou(rows[list("xywh")].to_numpy(float), rows[list("xywh")].to_numpy(float))
            i, j = np.nonzero(np.triu(m, 1))
            ids = rows.track_id.to_numpy()
            out.append(pd.DataFrame({"video_id": pdf.video_id.iloc[0], "frame": frame, "l": ids[i], "r": ids[j], "iou": m[i, j]}))
        return pd.concat(out)

    boxes = t.tracks.select("video_id", "frame", "track_id", *[c.alias(n) for c, n in zip(G.xywh(G.box()), "xywh", strict=True)], F.floor(F.col("frame") / 250).alias("stretch"))
    return rounded(runs.by_group(boxes, ["video_id", "stretch"], run, "video_id long, frame long, l long, r long, iou double"))


@query(
    "ST08_assignment",
    "SELECT vec_id, round(greatest(e[1] + e[5] + e[9], e[1] + e[6] + e[8], e[2] + e[4] + e[9], e[2] + e[6] + e[7], e[3] + e[4] + e[8], e[3] + e[5] + e[7]), 6) AS total FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)",
)
def _(t):
    """The best assignment of three rows to three columns, whose matrix is a vector's first nine values."""
    e = t.raw("embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 9).alias("m"), F.expr("vec_id div 500").alias("part"))

    def run(table: pa.Table) -> pa.Table:
        m = np.array(table["m"].to_pylist()).reshape(-1, 3, 3)
        total = [sum(x[i, j] for i, j in assign.hungarian(-x)) for x in m]
        return pa.table({"vec_id": table["vec_id"], "total": pa.array(total, pa.float64())})

    return rounded(runs.by_group(e, ["part"], run, "vec_id long, total double"))


def _pairs_of(ev):
    """Two events and two guesses in each event's own stretch of time; which guess lies nearer depends on its value."""
    n, x = F.col("event_id") * 20, (F.col("end") - F.col("start"))
    both = lambda a, b: ev.select("video_id", F.explode(F.array(*[F.struct((F.col("event_id") * 2 + k).alias("id"), (n + s).cast("double").alias("start"), (n + s + d).cast("double").alias("end")) for k, (s, d) in enumerate((a, b))])).alias("e")).select("video_id", "e.*")
    return both((F.lit(0.0), F.lit(4.0)), (F.lit(3.0), F.lit(5.0))), both((x % 3, F.lit(4.5)), (x % 5 + 2.0, F.lit(3.0)))


@query(
    "ST09_islands",
    """, g AS (SELECT video_id, event_id, event_id * 20 AS n, "end" - "start" AS x FROM ev),
         s AS (SELECT *, n + 0.0 AS a1, n + 0.0 + 4.0 AS b1, n + 3.0 AS a2, n + 3.0 + 5.0 AS b2, n + x % 3 AS c1, n + x % 3 + 4.5 AS d1, n + (x % 5 + 2.0) AS c2, n + (x % 5 + 2.0) + 3.0 AS d2 FROM g),
         w AS (SELECT *, greatest(0, least(b1, d1) - greatest(a1, c1)) / (greatest(b1, d1) - least(a1, c1)) AS i11, greatest(0, least(b1, d2) - greatest(a1, c2)) / (greatest(b1, d2) - least(a1, c2)) AS i12,
                 greatest(0, least(b2, d1) - greatest(a2, c1)) / (greatest(b2, d1) - least(a2, c1)) AS i21, greatest(0, least(b2, d2) - greatest(a2, c2)) / (greatest(b2, d2) - least(a2, c2)) AS i22 FROM s),
         p AS (SELECT video_id, event_id * 2 AS gt_id, CASE WHEN i11 + i22 >= i12 + i21 THEN event_id * 2 ELSE event_id * 2 + 1 END AS pred_id, CASE WHEN i11 + i22 >= i12 + i21 THEN i11 ELSE i12 END AS iou FROM w
               UNION ALL SELECT video_id, event_id * 2 + 1, CASE WHEN i11 + i22 >= i12 + i21 THEN event_id * 2 + 1 ELSE event_id * 2 END, CASE WHEN i11 + i22 >= i12 + i21 THEN i22 ELSE i21 END FROM w)
       SELECT video_id, gt_id, pred_id, round(iou, 6) AS iou FROM p WHERE iou >= 0.1""",
    "ev",
)
def _(t):
    return rounded(assign.matched_events(*_pairs_of(t.ev)))


# --- streams -----------------------------------------------------------------------------------------------------

#: Rows of a file of in_batches.
FILE_ROWS = 250_000


def in_batches(spark, rows, cuts, schema):
    """A stream of rows (ts, ...) from files written one after the other, each batch up to one of the cuts, and a last row long after. A
    batch is one file, or of large tables as many as any other."""
    path, parts = scratch(spark), []
    for before, c in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if before is None else rows.where(F.col("ts") >= before)
        parts.append(part if c is None else part.where(F.col("ts") < c))
    files = max(1, min(p.count() for p in parts) // FILE_ROWS)
    for i, part in enumerate(parts):
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(path)
        if files > 1 and len(spark.read.schema(schema).parquet(path).inputFiles()) != files * (i + 1):
            raise ValueError("a batch has another number of files")
    last = rows.limit(1).withColumn("video_id", F.lit(-1).cast("long")).withColumn("ts", F.timestamp_seconds(F.lit(10**6)))
    last.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


@query("SS03_fused_stream", _FUSED_SQL, "voiced")
def _(t):
    """The fusion over a stream of the same events, in four batches, an hour after time 0: a stream's first watermark."""
    from .streaming.windows import drained, fused_stream

    events = written(_heard(t).withColumn("ts", F.timestamp_millis(F.round((F.col("start") + 3600) * 1000).cast("long"))).drop("track_id"))
    stream = in_batches(t.spark, events, [F.timestamp_seconds(F.lit(s)) for s in (3650, 3710, 3770)], events.schema)
    return rounded(drained(fused_stream(stream)).where("video_id >= 0"))


# --- runs --------------------------------------------------------------------------------------------------------

@query("OR01_resumed_merge", "SELECT video_id, count(*) AS tracks, count(DISTINCT cluster) AS clusters, CASE WHEN video_id % 2 = 0 THEN 1 ELSE 2 END AS run FROM clusters GROUP BY ALL", "clusters")
def _(t):
    """The merge stage in two runs: the second takes the videos that the first didn't."""
    from .operators import profiles as P

    key = ["video_id"]
    store = runs.Store(t.spark, scratch(t.spark), key, P.SCHEMA)
    stage = lambda items: P.merged(runs.only(t.decisions, items, key), runs.only(t.tracks, items, key), isolate=True)
    first = store.run(t.videos.where("video_id % 2 = 0"), stage)["run"]
    store.run(t.videos, stage)
    of_run = store.commits().select("video_id", F.when(F.col("run") == first, 1).otherwise(2).alias("run"))
    made = P.clusters(store.results()).groupBy("video_id").agg(F.count("*").alias("tracks"), F.count_distinct("cluster").alias("clusters"))
    return made.join(of_run, "video_id")


@query(
    "OR03_isolated_merge",
    """SELECT video_id, CASE WHEN video_id <> 3 THEN count(*) END AS tracks, CASE WHEN video_id = 3 THEN 'ValueError' END AS error FROM clusters GROUP BY video_id""",
    "clusters",
)
def _(t):
    """The merge stage with one broken video, whose rows are its failure."""
    from .operators import profiles as P

    broken = t.decisions.withColumn("r", F.when((F.col("video_id") == 3) & (F.col("blocks") | F.col("priority").isNotNull()), F.col("l")).otherwise(F.col("r")))
    return P.merged(broken, t.tracks, isolate=True).select("video_id", F.size(F.map_keys("labels")).cast("long").alias("tracks"), "error")
