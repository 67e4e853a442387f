"""Queries over call logs and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators import reports
from loomspan.plans import views
from loomspan.plans.catalog import query

C, D, G = views.CALLS, views.DET, views.CATALOGUE


@query("arm_report", f"WITH {C} SELECT arm, count(*) AS calls, count(*) FILTER (WHERE ok) AS good, count(cost_usd) AS costed, round(sum(cost_usd), 2) AS cost, CAST(sum(tokens) FILTER (WHERE ok) AS BIGINT) AS tokens, round(sum(tokens) FILTER (WHERE ok) / greatest(count(*) FILTER (WHERE ok), 1), 6) AS tokens_per_good FROM calls GROUP BY arm")
def arm_report(spark, d) -> DataFrame:
    return reports.arm_report(views.calls(spark, d))


@query("latency_sections", f"WITH {C} SELECT arm, count(*) AS n, list_sort(list(latency_s))[count(*) // 2 + 1] AS p50, list_sort(list(latency_s))[CAST(floor(count(*) * 0.9e0) AS BIGINT) + 1] AS p90, max(latency_s) AS max FROM calls GROUP BY arm")
def latency_sections(spark, d) -> DataFrame:
    return reports.ranked_values(views.calls(spark, d), ["arm"], "latency_s", {"p50": 0.5, "p90": 0.9})


@query("latency_spread", f"WITH {C} SELECT tier, round(median(latency_s), 6) AS med, min(latency_s) AS least, max(latency_s) AS most FROM calls GROUP BY tier")
def latency_spread(spark, d) -> DataFrame:
    return views.calls(spark, d).groupBy("tier").agg(F.round(F.median("latency_s"), 6).alias("med"), F.min("latency_s").alias("least"), F.max("latency_s").alias("most"))


@query("latency_by_submission", f"WITH {C} SELECT submitted, round(median(latency_s), 6) AS p50, round(count(*) FILTER (WHERE latency_s > 20) / count(*), 6) AS slow_share FROM calls GROUP BY submitted")
def latency_by_submission(spark, d) -> DataFrame:
    return views.calls(spark, d).groupBy("submitted").agg(F.round(F.median("latency_s"), 6).alias("p50"), F.round(F.count_if(F.col("latency_s") > 20) / F.count("*"), 6).alias("slow_share"))


@query("error_classes", f"WITH {C} SELECT string_split(error, ':')[1] AS error_class, count(*) AS n FROM calls WHERE NOT ok GROUP BY 1")
def error_classes(spark, d) -> DataFrame:
    return reports.error_classes(views.calls(spark, d))


@query("top_errors", f"WITH {C} SELECT string_split(error, ':')[1] AS error_class, count(*) AS n FROM calls WHERE NOT ok GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1")
def top_errors(spark, d) -> DataFrame:
    return reports.error_classes(views.calls(spark, d), 1)


@query("tier_by_year", f"WITH {C} SELECT CAST(year(ts) AS INTEGER) AS y, count(*) FILTER (WHERE tier = 'flex') AS flex, count(*) FILTER (WHERE tier = 'standard') AS standard FROM calls GROUP BY 1")
def tier_by_year(spark, d) -> DataFrame:
    return views.calls(spark, d).groupBy(F.year("ts").alias("y")).pivot("tier", ["flex", "standard"]).count().fillna(0, ["flex", "standard"])


@query("deadline_what_if", f"WITH {C}, t AS (SELECT * FROM (VALUES (10.0e0), (20.0e0), (30.0e0), (40.0e0)) v(deadline)) SELECT deadline, count(*) FILTER (WHERE latency_s > deadline) AS lost, max(latency_s) FILTER (WHERE latency_s <= deadline) AS wall FROM calls, t GROUP BY deadline")
def deadline_what_if(spark, d) -> DataFrame:
    return reports.deadline_what_if(views.calls(spark, d), spark.createDataFrame([(10.0,), (20.0,), (30.0,), (40.0,)], "deadline double"))


@query("latency_correlation", f"WITH {C} SELECT arm, round(corr(latency_s, tokens), 6) AS by_tokens, round(corr(latency_s, submitted), 6) AS by_submission FROM calls GROUP BY arm")
def latency_correlation(spark, d) -> DataFrame:
    return views.calls(spark, d).groupBy("arm").agg(F.round(F.corr("latency_s", "tokens"), 6).alias("by_tokens"), F.round(F.corr("latency_s", "submitted"), 6).alias("by_submission"))


@query("wall_call", f"WITH {C} SELECT arm, arg_max(call_id, (latency_s, call_id)) AS call_id, max(latency_s) AS latency_s FROM calls GROUP BY arm")
def wall_call(spark, d) -> DataFrame:
    return views.calls(spark, d).groupBy("arm").agg(F.max_by("call_id", F.struct("latency_s", "call_id")).alias("call_id"), F.max("latency_s").alias("latency_s"))


@query("throughput_slope", f"WITH {C} SELECT arm, submitted, round((arg_max(latency_s, (call_id, latency_s)) - arg_min(latency_s, (call_id, latency_s))) / (max(call_id) - min(call_id)), 9) AS slope FROM calls GROUP BY arm, submitted")
def throughput_slope(spark, d) -> DataFrame:
    return reports.first_last_slope(views.calls(spark, d), ["arm", "submitted"], "call_id", "latency_s").withColumn("slope", F.round("slope", 9))


@query("ledger", f"WITH {C} SELECT 'log' AS source, count(*) AS calls, count(*) FILTER (WHERE cost_usd IS NULL) AS uncosted, round(sum(cost_usd), 2) AS cost FROM calls WHERE arm <> 'N' UNION ALL SELECT 'probe', count(*), count(*), NULL FROM calls WHERE arm = 'N'")
def ledger(spark, d) -> DataFrame:
    c = views.calls(spark, d)
    return reports.ledger(c.where("arm <> 'N'").select(F.lit("log").alias("source"), "cost_usd"), c.where("arm = 'N'").select(F.lit("probe").alias("source"), "tokens"))


@query("cost_rank", f"WITH {G} SELECT id, round(in_per_m * 250000 / 1e6 + out_per_m * 90000 / 1e6, 6) AS cost FROM catalogue WHERE in_per_m >= 0 AND out_per_m >= 0 AND structured AND coalesce(max_output, 0) >= 8000 AND in_per_m * 250000 / 1e6 + out_per_m * 90000 / 1e6 <= 1.6e0")
def cost_rank(spark, d) -> DataFrame:
    return reports.catalogue_rank(views.catalogue(spark, d), 250000.0, 90000.0, 1.6).select("id", F.round("cost", 6).alias("cost"))


@query("cost_top", f"WITH {G} SELECT id, round(in_per_m * 250000 / 1e6 + out_per_m * 90000 / 1e6, 6) AS cost FROM catalogue WHERE in_per_m >= 0 AND out_per_m >= 0 AND structured AND coalesce(max_output, 0) >= 8000 AND in_per_m * 250000 / 1e6 + out_per_m * 90000 / 1e6 <= 9 ORDER BY cost, in_per_m, id LIMIT 12")
def cost_top(spark, d) -> DataFrame:
    ranked = reports.catalogue_rank(views.catalogue(spark, d), 250000.0, 90000.0, 9.0)
    return ranked.withColumn("cost", F.round("cost", 6)).orderBy("cost", "in_per_m", "id").limit(12).select("id", "cost")


@query("catalogue_filter", f"WITH {G} SELECT id, TRY_CAST(price_text AS DOUBLE) AS price, list_contains(modalities, 'image') OR list_contains(modalities, 'images') AS vision, len(modalities) AS n_modalities FROM catalogue WHERE list_contains(modalities, 'image') OR list_contains(modalities, 'images')")
def catalogue_filter(spark, d) -> DataFrame:
    vision = F.exists("modalities", lambda m: m.isin("image", "images"))
    return views.catalogue(spark, d).where(vision).select("id", F.col("price_text").try_cast("double").alias("price"), vision.alias("vision"), F.size("modalities").cast("long").alias("n_modalities"))


@query("anti_unpinned", "SELECT DISTINCT l_suppkey AS model FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def anti_unpinned(spark, d) -> DataFrame:
    used = views.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("model")).distinct()
    return reports.unpinned(used, views.table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("model")), "model")


SPEC = "CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ':v2' WHEN 2 THEN p_brand || ':v9:high' WHEN 3 THEN p_brand || '::medium:grid' ELSE ':v1' END"


@query("spec_parse", f"""WITH s AS (SELECT p_partkey AS id, string_split({SPEC}, ':') AS p FROM part)
SELECT id, nullif(trim(p[1]), '') AS model, coalesce(nullif(trim(p[2]), ''), 'v1') AS version, coalesce(nullif(trim(p[3]), ''), 'low') AS effort, coalesce(nullif(trim(p[4]), ''), 'none') AS overlay,
 CASE WHEN len(p) > 4 THEN 'too many parts' WHEN nullif(trim(p[1]), '') IS NULL THEN 'no model' WHEN coalesce(nullif(trim(p[2]), ''), 'v1') NOT IN ('v1', 'v2', 'v3') THEN 'unknown version' END AS problem FROM s""")
def spec_parse(spark, d) -> DataFrame:
    rows = views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(SPEC).alias("spec"))
    return reports.parsed_spec(rows, "spec", ["v1", "v2", "v3"]).drop("spec")


ROTATION = f"WITH {D}, f AS (SELECT clip, frame, row_number() OVER (PARTITION BY clip ORDER BY frame) - 1 AS i FROM (SELECT DISTINCT clip, frame FROM det)), a AS (SELECT * FROM (VALUES ('A', 0), ('B', 1), ('C', 2)) v(arm, j)) SELECT clip, frame, arm, (j - i % 3 + 3) % 3 AS slot FROM f, a"


@query("arm_rotation_clips", ROTATION)
@query("arm_rotation", ROTATION)
def arm_rotation(spark, d) -> DataFrame:
    from pyspark.sql import Window

    f = views.det(spark, d).select("clip", "frame").distinct().withColumn("i", F.row_number().over(Window.partitionBy("clip").orderBy("frame")) - 1)
    return reports.rotated_arms(f, spark.createDataFrame([("A", 0), ("B", 1), ("C", 2)], "arm string, j int"), 3).select("clip", "frame", "arm", F.col("slot").cast("long").alias("slot"))


@query("blind_spell", f"WITH {views.BALL}, g AS (SELECT clip, lead(frame) OVER (PARTITION BY clip ORDER BY frame) - frame AS gap FROM ball) SELECT clip, max(gap) AS worst_gap FROM g GROUP BY clip")
def blind_spell(spark, d) -> DataFrame:
    return reports.blind_spells(views.ball(spark, d), "clip")


@query("fabrication_check", f"WITH {D} SELECT kit, round(stddev_samp(h), 6) AS h_spread, count(*) - count(DISTINCT (x, y)) AS repeated, count(DISTINCT num) AS numbers FROM det GROUP BY kit")
def fabrication_check(spark, d) -> DataFrame:
    return views.det(spark, d).groupBy("kit").agg(F.round(F.stddev_samp("h"), 6).alias("h_spread"), (F.count("*") - F.countDistinct(F.struct("x", "y"))).alias("repeated"), F.countDistinct("num").alias("numbers"))


@query("digit_histogram", f"WITH {D}, g AS (SELECT CAST(round_even(h * 1000, 0) AS BIGINT) % 10 AS digit, count(*) AS n FROM det GROUP BY 1) SELECT digit, n, round(n / (SELECT sum(n) FROM g), 6) AS share FROM g")
def digit_histogram(spark, d) -> DataFrame:
    g = views.det(spark, d).groupBy(F.pmod(F.rint(F.expr("h * 1000")).cast("long"), F.lit(10)).alias("digit")).agg(F.count("*").alias("n"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("all")))).select("digit", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("numbers_per_sighting", f"WITH {D} SELECT clip, round(count(num) / greatest(count(*), 1), 6) AS read_share, count(DISTINCT (frame, trk)) AS sightings FROM det GROUP BY clip")
def numbers_per_sighting(spark, d) -> DataFrame:
    return views.det(spark, d).groupBy("clip").agg(F.round(F.count("num") / F.greatest(F.count("*"), F.lit(1)), 6).alias("read_share"), F.countDistinct(F.struct("frame", "trk")).alias("sightings"))


@query("box_ratio", f"WITH {views.DET_RAW} SELECT clip, round(list_sort(list(w / h))[count(*) // 2 + 1], 6) AS p50, round(max(greatest(x + w, y + h)), 6) AS reach FROM det_raw GROUP BY clip")
def box_ratio(spark, d) -> DataFrame:
    raw = views.det_raw(spark, d)
    half = reports.ranked_values(raw.withColumn("ratio", F.expr("w / h")), ["clip"], "ratio", {"p50": 0.5})
    reach = raw.groupBy("clip").agg(F.round(F.max(F.greatest(F.expr("x + w"), F.expr("y + h"))), 6).alias("reach"))
    return half.join(reach, "clip").select("clip", F.round("p50", 6).alias("p50"), "reach")


@query("markers_per_frame", f"WITH {D}, g AS (SELECT clip, frame, count(*) AS n FROM det GROUP BY ALL) SELECT clip, min(n) AS least, median(n) AS med, max(n) AS most FROM g GROUP BY clip")
def markers_per_frame(spark, d) -> DataFrame:
    return views.det(spark, d).groupBy("clip", "frame").agg(F.count("*").alias("n")).groupBy("clip").agg(F.min("n").alias("least"), F.median("n").alias("med"), F.max("n").alias("most"))


@query("run_comparison", f"WITH {D}, a AS (SELECT clip, count(DISTINCT trk) AS ids FROM det WHERE conf >= 0.5e0 GROUP BY clip), b AS (SELECT clip, count(DISTINCT trk) AS ids FROM det WHERE clip > 0 GROUP BY clip) SELECT clip, a.ids AS before, b.ids AS after FROM a FULL JOIN b USING (clip)")
def run_comparison(spark, d) -> DataFrame:
    r = views.det(spark, d)
    a = r.where("conf >= 0.5").groupBy("clip").agg(F.countDistinct("trk").alias("before"))
    return a.join(r.where("clip > 0").groupBy("clip").agg(F.countDistinct("trk").alias("after")), "clip", "full")


@query("log_join", f"WITH {C}, {D}, t AS (SELECT submitted AS clip, count(*) AS calls, count(*) FILTER (WHERE ok) AS good, round(sum(cost_usd), 2) AS cost FROM calls GROUP BY submitted), o AS (SELECT CAST(clip AS BIGINT) AS clip, count(*) AS detections, count(DISTINCT frame) AS frames FROM det GROUP BY clip) SELECT * FROM t JOIN o USING (clip)")
def log_join(spark, d) -> DataFrame:
    """The call log against the detections that came of it, by clip (calls are submitted a clip at a time); both are counted before they meet."""
    t = views.calls(spark, d).groupBy(F.col("submitted").alias("clip")).agg(F.count("*").alias("calls"), F.count_if("ok").alias("good"), F.round(F.sum("cost_usd"), 2).alias("cost"))
    o = views.det(spark, d).groupBy(F.col("clip").cast("long").alias("clip")).agg(F.count("*").alias("detections"), F.countDistinct("frame").alias("frames"))
    return t.join(o, "clip")


@query("tier_by_date", f"WITH {C} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, tier, count(*) AS calls FROM calls GROUP BY ALL")
def tier_by_date(spark, d) -> DataFrame:
    return views.calls(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "tier").agg(F.count("*").alias("calls"))


@query("submission_order", f"WITH {C} SELECT arm, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, call_id, row_number() OVER (PARTITION BY arm, CAST(ts AS DATE) ORDER BY submitted, call_id, latency_s, tokens) - 1 AS place, row_number() OVER (PARTITION BY arm, CAST(ts AS DATE) ORDER BY latency_s, call_id, tokens) - 1 AS landed_place FROM calls")
def submission_order(spark, d) -> DataFrame:
    """Results of a pool (an arm on a day) by the order of submission, whatever the order in which they came back."""
    c = views.calls(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out = reports.submission_places(c, ["arm", "day"], ["submitted", "call_id", "latency_s", "tokens"], ["latency_s", "call_id", "tokens"])
    return out.select("arm", "day", "call_id", *[F.col(p).cast("long").alias(p) for p in ("place", "landed_place")])


@query("pinned_models", "SELECT DISTINCT l_suppkey AS model FROM lineitem")
def pinned_models(spark, d) -> DataFrame:
    """Models of a run, every one of which must have a convention: the query ends with an error where one has none."""
    used = views.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("model")).distinct()
    return reports.all_pinned(used, views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("model")), "model")


@query("catalogue_flatten", """SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CASE WHEN p_size % 7 = 0 THEN [] WHEN p_size % 3 = 0 THEN ['text', 'image'] ELSE ['text'] END AS modalities,
 CASE WHEN p_size % 4 = 0 THEN p_size * 2000 ELSE p_size * 1000 END AS context, CASE WHEN p_size % 5 <> 0 THEN p_size * 100 END AS max_output,
 round(coalesce(TRY_CAST(CASE WHEN p_partkey % 41 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) || 'e-7' END AS DOUBLE), 0) * 1e6, 6) AS in_per_m, round(p_size * 4e-7 * 1e6, 6) AS out_per_m,
 p_partkey % 3 = 0 AS structured, p_partkey % 3 = 1 AS reasoning, p_partkey % 2 = 0 AS moderated FROM part""")
def catalogue_flatten(spark, d) -> DataFrame:
    """A nested catalogue (made of parts, with missing branches and prices that can't be read) as flat rows."""
    p = views.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.lit(0).cast("long").alias("created"),
        F.expr("if(p_size % 7 = 0, null, named_struct('input_modalities', if(p_size % 3 = 0, array('text', 'image'), array('text')), 'output_modalities', array('text')))").alias("architecture"),
        F.expr("cast(if(p_size % 4 = 0, 0, p_size * 1000) as bigint)").alias("context_length"),
        F.expr("named_struct('context_length', cast(p_size * 2000 as bigint), 'max_completion_tokens', if(p_size % 5 = 0, null, cast(p_size * 100 as bigint)), 'is_moderated', if(p_partkey % 2 = 0, true, null))").alias("top_provider"),
        F.expr("named_struct('prompt', if(p_partkey % 41 = 0, 'n/a', concat(p_size, 'e-7')), 'completion', cast(p_size * 4e-7D as string), 'image', cast(null as string))").alias("pricing"),
        F.expr("case p_partkey % 3 when 0 then array('structured_outputs', 'tools') when 1 then array('include_reasoning') end").alias("supported_parameters"),
    )
    flat = reports.flattened(p)
    return flat.select("id", "name", "modalities", "context", "max_output", F.round("in_per_m", 6).alias("in_per_m"), F.round("out_per_m", 6).alias("out_per_m"), "structured", "reasoning", "moderated")


@query("set_operations", f"WITH {views.TRACKS}, a AS (SELECT DISTINCT trk FROM tracks WHERE conf >= 0.9e0), b AS (SELECT DISTINCT trk FROM tracks WHERE num IS NOT NULL AND conf >= 0.95e0) SELECT 'both' AS part, trk FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'unclaimed', trk FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'all', trk FROM (SELECT * FROM a UNION SELECT * FROM b)")
def set_operations(spark, d) -> DataFrame:
    t = views.tracks(spark, d)
    a, b = t.where("conf >= 0.9").select("trk").distinct(), t.where("num is not null and conf >= 0.95").select("trk").distinct()
    tag = lambda df, name: df.select(F.lit(name).alias("part"), "trk")
    return tag(a.intersect(b), "both").unionByName(tag(a.exceptAll(b), "unclaimed")).unionByName(tag(a.union(b).distinct(), "all"))
