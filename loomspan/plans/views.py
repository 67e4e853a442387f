"""Views that give the supplied tables the shape of detections, tracks, ball sightings and call logs.

Each view exists twice: as a DataFrame, and as a common table expression for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Hours of events that make one clip; a clip is what partitions all sequential work.
CLIP_FRAMES = 120


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection per event: clip, frame, idx, x, y, w, h, kit, num, conf, trk, event_id."""
    e = table(spark, sf_dir, "events").withColumns({
        "frame": F.expr("int(timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', cast(ts AS timestamp_ntz)))"),
        "k": F.get_json_object("props", "$.k").cast("int"),
    })
    h = F.expr("(50 + k % 50) / 1000.0e0")
    return e.select(
        F.expr(f"int(frame div {CLIP_FRAMES})").alias("clip"),
        "frame",
        F.row_number().over(Window.partitionBy("frame").orderBy("event_id")).alias("idx"),
        F.expr("(user_id * 7 % 20) / 20.0e0").alias("x"),
        F.expr("0.1e0 + 7 * ((50 + k % 50) / 1000.0e0) + (user_id % 20) / 100.0e0").alias("y"),
        F.expr("0.04e0 + (user_id % 5) / 100.0e0").alias("w"),
        h.alias("h"),
        F.col("event_type").alias("kit"),
        F.expr("if(k % 3 = 0, k, null)").alias("num"),
        F.expr("least(1.0e0, value / 150.0e0)").alias("conf"),
        F.col("user_id").alias("trk"),
        "event_id",
    )


DET = f"""det AS (
  SELECT CAST(frame // {CLIP_FRAMES} AS INTEGER) AS clip, frame,
         CAST(row_number() OVER (PARTITION BY frame ORDER BY event_id) AS INTEGER) AS idx,
         (user_id * 7 % 20) / 20.0e0 AS x,
         0.1e0 + 7 * ((50 + k % 50) / 1000.0e0) + (user_id % 20) / 100.0e0 AS y,
         0.04e0 + (user_id % 5) / 100.0e0 AS w, (50 + k % 50) / 1000.0e0 AS h,
         event_type AS kit, CASE WHEN k % 3 = 0 THEN k END AS num,
         least(1.0e0, value / 150.0e0) AS conf, user_id AS trk, event_id
  FROM (SELECT *, CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 3600000000 AS INTEGER) AS frame,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def det_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with faults: off-scale x, ribbons, and frames in which one box is repeated."""
    d = det(spark, sf_dir).withColumns({
        "x": F.expr("if(event_id % 97 = 0 or (frame % 50 = 0 and idx % 2 = 0), x * 1000, x)"),
        "w": F.expr("if(event_id % 89 = 0, w * 6, w)"),
    })
    one = Window.partitionBy("frame").orderBy("idx")
    return d.withColumns({c: F.when(F.col("frame") % 70 == 1, F.first(c).over(one)).otherwise(F.col(c)) for c in "xywh"})


DET_RAW = DET + """,
det_f AS (SELECT * REPLACE (CASE WHEN event_id % 97 = 0 OR (frame % 50 = 0 AND idx % 2 = 0) THEN x * 1000 ELSE x END AS x,
                            CASE WHEN event_id % 89 = 0 THEN w * 6 ELSE w END AS w) FROM det),
det_raw AS (SELECT a.* REPLACE (CASE WHEN a.frame % 70 = 1 THEN b.x ELSE a.x END AS x, CASE WHEN a.frame % 70 = 1 THEN b.y ELSE a.y END AS y,
                                CASE WHEN a.frame % 70 = 1 THEN b.w ELSE a.w END AS w, CASE WHEN a.frame % 70 = 1 THEN b.h ELSE a.h END AS h)
            FROM det_f a JOIN det_f b ON a.frame = b.frame AND b.idx = 1)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foot points of tracks: trk, frame, x, y, w, h, conf, kit, num; one row a track and frame."""
    d = det(spark, sf_dir)
    first = d.withColumn("_r", F.row_number().over(Window.partitionBy("trk", "frame").orderBy("event_id"))).where("_r = 1")
    return first.select("trk", "frame", F.expr("x + w / 2 + (frame % 7) / 100.0e0").alias("x"), F.expr("y + h").alias("y"), "w", "h", "conf", "kit", "num")


TRACKS = DET + """,
tracks AS (SELECT trk, frame, x + w / 2 + (frame % 7) / 100.0e0 AS x, y + h AS y, w, h, conf, kit, num
           FROM det QUALIFY row_number() OVER (PARTITION BY trk, frame ORDER BY event_id) = 1)"""


def ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings of one object: clip, frame, x, y (centre), w, h, conf; the purchase of highest value in a frame."""
    d = det(spark, sf_dir).where("kit = 'purchase'")
    top = d.withColumn("_r", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("conf"), "event_id"))).where("_r = 1")
    return top.select("clip", "frame", F.expr("x + w / 2").alias("x"), F.expr("y + h / 2").alias("y"), F.expr("w / 4").alias("w"), F.expr("h / 5").alias("h"), "conf")


BALL = DET + """,
ball AS (SELECT clip, frame, x + w / 2 AS x, y + h / 2 AS y, w / 4 AS w, h / 5 AS h, conf FROM det WHERE kit = 'purchase'
         QUALIFY row_number() OVER (PARTITION BY frame ORDER BY conf DESC, event_id) = 1)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call log from line items: arm, call_id, latency_s, cost_usd, ok, error, tokens, submitted, day, tier."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        F.col("l_returnflag").alias("arm"),
        F.expr("l_orderkey * 10 + l_linenumber").alias("call_id"),
        F.col("l_quantity").alias("latency_s"),
        F.expr("if(l_linestatus = 'O' or l_linenumber % 2 = 0, l_extendedprice, null)").alias("cost_usd"),
        (F.col("l_linestatus") == "O").alias("ok"),
        F.expr("if(l_linestatus = 'O', null, concat(if(l_tax > 0.04e0, 'timeout', 'http'), ': ', l_suppkey))").alias("error"),
        F.expr("l_partkey % 3000").alias("tokens"),
        F.expr("l_orderkey % 10").alias("submitted"),
        F.col("l_shipdate").alias("ts"),
        F.expr("if(l_discount > 0.05e0, 'flex', 'standard')").alias("tier"),
    )


CALLS = """calls AS (
  SELECT l_returnflag AS arm, l_orderkey * 10 + l_linenumber AS call_id, l_quantity AS latency_s,
         CASE WHEN l_linestatus = 'O' OR l_linenumber % 2 = 0 THEN l_extendedprice END AS cost_usd, l_linestatus = 'O' AS ok,
         CASE WHEN l_linestatus <> 'O' THEN concat(CASE WHEN l_tax > 0.04e0 THEN 'timeout' ELSE 'http' END, ': ', l_suppkey) END AS error,
         l_partkey % 3000 AS tokens, l_orderkey % 10 AS submitted, l_shipdate AS ts,
         CASE WHEN l_discount > 0.05e0 THEN 'flex' ELSE 'standard' END AS tier FROM lineitem)"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model catalogue from parts: id, name, modalities, max_output, in_per_m, out_per_m, structured."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.expr("concat(p_brand, '/', p_type, ' ', p_name)").alias("name"),
        F.expr("if(p_size % 3 = 0, array('text', 'image'), if(p_size % 3 = 1, array('text'), array('images', 'audio')))").alias("modalities"),
        F.expr("if(p_size % 5 = 0, null, p_size * 1000)").alias("max_output"),
        F.expr("if(p_partkey % 41 = 0, 'n/a', cast(p_size as string))").alias("price_text"),
        F.expr("p_size / 10.0e0 - if(p_partkey % 53 = 0, 10.0e0, 0.0e0)").alias("in_per_m"),
        F.expr("p_retailprice / 100.0e0").alias("out_per_m"),
        F.expr("p_partkey % 4 <> 0").alias("structured"),
    )


CATALOGUE = """catalogue AS (
  SELECT p_partkey AS id, concat(p_brand, '/', p_type, ' ', p_name) AS name,
         CASE p_size % 3 WHEN 0 THEN ['text', 'image'] WHEN 1 THEN ['text'] ELSE ['images', 'audio'] END AS modalities,
         CASE WHEN p_size % 5 <> 0 THEN p_size * 1000 END AS max_output,
         CASE WHEN p_partkey % 41 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS price_text,
         p_size / 10.0e0 - CASE WHEN p_partkey % 53 = 0 THEN 10.0e0 ELSE 0.0e0 END AS in_per_m,
         p_retailprice / 100.0e0 AS out_per_m, p_partkey % 4 <> 0 AS structured FROM part)"""
