"""Detection documents, track documents, call logs and probes: readers with a schema, and sinks.

Readers name their schema, so that files of older versions (without roles, kits or run facts) read as the same
tables with nulls, and no pass over the files is spent on finding it out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BALL = "struct<x:double,y:double,w:double,h:double,conf:double>"
PLAYER = "struct<x:double,y:double,w:double,h:double,kit:string,num:int,role:string,conf:double>"
VARIANT = "struct<container:boolean,system:boolean,image_first:boolean,compact:boolean,ruler:boolean,grid:boolean,provider_order:array<string>>"
DETECTIONS = f"""clip string, model string, fps int, width int, tag string, ts string, effort string, scene_last boolean, terse_schema boolean, timeout_s double,
variant {VARIANT}, coord_convention string, prompt_version string, arm string, arm_set array<string>, source_fps int, wall_s double, n_source_frames int,
frames array<struct<frame:int,scene:string,kits:array<struct<colour:string,accent:string>>,players:array<{PLAYER}>,ball:{BALL},ball_candidates:array<{BALL}>>>,
dropped array<struct<frame:int,error:string>>"""
TRACKS = """clip string, model string, tag string, fps_sampled int, source_fps int, n_frames int, teams map<string,string>, accents map<string,string>, kit_counts map<string,int>,
identities map<string,struct<team:string,kit:string,number:string,number_source:string>>, cuts array<struct<frame:int,h_ratio:double,d_n:int,n_ratio:double,kit_l1:double>>,
frames array<struct<frame:int,players:array<struct<id:string,track:int,fade:double,team:string,label:string,read:boolean,x:double,y:double,w:double,h:double,on_ball:boolean>>,ball:struct<x:double,y:double,w:double,h:double>>>"""
CALLS = """stage string, tag string, ts string, clip string, model string, fps int, width int, frame int, bytes long, prompt_version string, arm string, effort string, status int, ok boolean,
error string, latency_s double, t_encode_s double, t_ttfb_s double, t_stream_s double, t_parse_s double, t_start_s double, t_done_s double, prompt_tokens double, completion_tokens double,
reasoning_tokens double, cost_usd double, provider string, retries int, retry_wait_s double"""
PROBES = """probe string, width int, jpeg_bytes long, wire_bytes long, n int, ttfb_s double, first_byte_s double, first_data_s double, first_content_s double, total_s double, total_min_s double,
total_max_s double, wall_s double, slowest_s double, median_s double, fastest_s double, ok int, fail int, max_tokens int, prompt_tokens double, completion_tokens double, reasoning_tokens double"""

CATALOGUE = """id string, name string, created long, architecture struct<input_modalities:array<string>,output_modalities:array<string>>, context_length long,
top_provider struct<context_length:long,max_completion_tokens:long,is_moderated:boolean>, pricing struct<prompt:string,completion:string,image:string>, supported_parameters array<string>"""

#: What a clip, a model's prices and its coordinate convention are called: relations that are part of a run's setup.
CLIP_COLUMNS = "clip string, source string, start_s double, length_s double"
PRICE_COLUMNS = "model string, in_per_m double, out_per_m double"
CONVENTION_COLUMNS = "model string, convention string"


def registry(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small relation given inline."""
    return spark.createDataFrame(rows, columns)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """One row a run, frames nested."""
    return spark.read.schema(DETECTIONS).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def run_table(runs: DataFrame) -> DataFrame:
    """Facts of the runs, with defaults for what old files lack."""
    last = F.array_max(F.transform("frames", lambda f: f["frame"]))
    return runs.withColumns({
        "n_frames": F.greatest(F.size("frames"), F.lit(0)),
        "n_dropped": F.greatest(F.size("dropped"), F.lit(0)),
        "source_fps": F.coalesce("source_fps", F.lit(30)),
        "fps": F.coalesce("fps", F.lit(10)),
        "n_source_frames": F.coalesce("n_source_frames", last + 1),
    }).drop("frames", "dropped")


def frame_table(runs: DataFrame) -> DataFrame:
    return runs.select("clip", "tag", F.inline("frames"))


def player_table(runs: DataFrame) -> DataFrame:
    """One row a detection: clip, tag, frame, idx (place in the list, from 1), box, kit in canonical form, num, role,
    conf (1 where the version has none)."""
    f = frame_table(runs).select("clip", "tag", "frame", F.posexplode("players").alias("idx", "p"))
    kit = F.lower(F.regexp_replace("p.kit", r"^\s+|\s+$", ""))
    return f.select("clip", "tag", "frame", (F.col("idx") + 1).alias("idx"), "p.x", "p.y", "p.w", "p.h", kit.alias("kit"), "p.num", "p.role", F.coalesce("p.conf", F.lit(1.0)).alias("conf"))


def ball_table(runs: DataFrame) -> DataFrame:
    """Centres of the frames that have a ball."""
    f = frame_table(runs).where("ball is not null")
    return f.select("clip", "tag", "frame", F.expr("ball.x + ball.w / 2").alias("x"), F.expr("ball.y + ball.h / 2").alias("y"), "ball.w", "ball.h", F.coalesce("ball.conf", F.lit(1.0)).alias("conf"))


def dropped_table(runs: DataFrame) -> DataFrame:
    return runs.select("clip", "tag", F.inline("dropped"))


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACKS).option("multiLine", True).json(path)


def read_call_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are passed over."""
    return spark.read.schema(CALLS).json(path).where("coalesce(stage, tag, ts, clip, model, error) is not null or ok is not null")


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROBES).json(path).where("probe is not null")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Models of a provider's catalogue (a document with them in ``data``), still nested."""
    return spark.read.schema(f"data array<struct<{CATALOGUE.replace(' struct', ':struct').replace(' array', ':array').replace(' string', ':string').replace(' long', ':long')}>>").option("multiLine", True).json(path).select(F.inline("data"))


def track_documents(runs: DataFrame, players: DataFrame, cuts: DataFrame | None = None, identities: DataFrame | None = None, balls: DataFrame | None = None, keys: tuple[str, ...] = ("clip",)) -> DataFrame:
    """One row a clip in the shape that :func:`read_tracks` reads: facts of the run, cuts, identities, and every frame with
    its players (by track) and its ball.

    runs: keys and any of the top-level facts; players: keys, frame, track, and any fields of a player; cuts: keys, frame and any fields of a
    cut; identities: keys, id and any fields of an identity; balls: keys, frame, x, y, w, h. A clip's document is one row, so a clip
    bounds what one task holds.
    """
    fields = [c for c in players.columns if c not in (*keys, "frame")]
    order = ["track", *[c for c in fields if c != "track"]]
    rows = players.groupBy(*keys, "frame").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("players"))
    if balls is not None:
        rows = rows.join(balls.select(*keys, "frame", F.struct("x", "y", "w", "h").alias("ball")), [*keys, "frame"], "full").withColumn("players", F.coalesce("players", F.array().cast(rows.schema["players"].dataType)))
    frames = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame", "players", *(["ball"] if balls is not None else [])))).alias("frames"))
    out = runs.join(frames, list(keys), "left")
    if cuts is not None:
        out = out.join(cuts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame", *[c for c in cuts.columns if c not in (*keys, "frame")]))).alias("cuts")), list(keys), "left")
    if identities is not None:
        rest = [c for c in identities.columns if c not in (*keys, "id")]
        out = out.join(identities.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", F.struct(*rest).alias("v"))))).alias("identities")), list(keys), "left")
    return out


def write_tracks(documents: DataFrame, path: str) -> None:
    """A JSON file for each document."""
    documents.write.option("maxRecordsPerFile", 1).json(path)


def write_costs(pairs: DataFrame, path: str, clip: str | None = None) -> None:
    """The audit of an association as JSON lines, by clip where there is one."""
    (pairs.write.partitionBy(clip) if clip else pairs.write).json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_detections(boxes: DataFrame, path: str) -> None:
    """Columns by clip and tag, so that a run's rows are found without reading others."""
    boxes.write.partitionBy("clip", "tag").parquet(path)


def write_arms(rows: DataFrame, path: str) -> None:
    """A folder for each arm."""
    rows.write.partitionBy("arm").json(path)


def nested_frames(boxes: DataFrame, keys: tuple[str, ...] = ("clip", "tag")) -> DataFrame:
    """Back to one row a run with its frames nested, for export."""
    players = boxes.groupBy(*keys, "frame").agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y", "w", "h", "kit", "num", "conf"))).alias("players"))
    return players.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame", "players"))).alias("frames"))


def rewritten(rows: DataFrame, old: str, new: str) -> str:
    """Write corrected rows beside the old path; the old files stay as they are."""
    if old.rstrip("/") == new.rstrip("/"):
        raise ValueError("a document is never rewritten in place")
    rows.write.mode("errorifexists").parquet(new)
    return new


def encoded_images(spark: SparkSession, path: str) -> DataFrame:
    """Files as base64, with their size and the size on the wire."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.base64("content").alias("payload"), F.octet_length("content").alias("bytes"), F.length(F.base64("content")).alias("wire_bytes"))
