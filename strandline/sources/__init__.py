"""Readers of batch configurations, manifests, summaries, prompts, notes and frame files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import OPTION_TYPES

OPTIONS = ", ".join(f"{k}: {v}" for k, v in OPTION_TYPES.items())
RANGE = f"struct<label: string, start: double, end: double, priority: string, needs_followup: string, output: string, {OPTIONS}>"
CONFIG = f"video string, output_dir string, summary_output string, defaults {RANGE}, ranges array<{RANGE}>"
TILE = (
    "struct<tile_index: int, filename: string, path: string, start_frame: int, end_frame: int, start_timestamp_sec: double, "
    "end_timestamp_sec: double, frame_count: int>"
)
MANIFEST = f"source struct<video_path: string, duration_sec: double>, extraction struct<start_sec: double, end_sec: double, fps: double>, tiles array<{TILE}>"
SUMMARY = "video string, config string, results array<struct<index: int, label: string, status: string, output: string, manifest_path: string, start_sec: double, end_sec: double>>"


def plain_path(address: Column) -> Column:
    """A file's address as a path: without escapes, and without ``file:``."""
    return F.regexp_replace(F.url_decode(F.replace(address, F.lit("+"), F.lit("%2B"))), "^file:/*", "/")


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("file", plain_path(F.col("_metadata.file_path")))


def _need(holds: Column, what: str) -> Column:
    return F.when(holds, F.lit(True)).otherwise(F.raise_error(F.lit(what)))


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """One row a range of each configuration, ``range_index`` from 0, with the configuration's
    ``defaults``.  A configuration without a video or ranges is an error."""
    docs = _documents(spark, path, CONFIG)
    docs = docs.where(_need(F.coalesce(F.col("video"), F.lit("")) != "", "configuration without a video")).where(_need(F.coalesce(F.size("ranges"), F.lit(0)) > 0, "configuration without ranges"))
    return docs.select("file", "video", "output_dir", "summary_output", "defaults", F.posexplode("ranges").alias("range_index", "range"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row a tile of each manifest; a manifest without tiles is an error."""
    docs = _documents(spark, path, MANIFEST).where(_need(F.coalesce(F.size("tiles"), F.lit(0)) > 0, "manifest without tiles"))
    return docs.select("file", "source", "extraction", F.explode("tiles").alias("tile"))


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, manifest_path) of each result that has a manifest."""
    rows = _documents(spark, path, SUMMARY).select("file", F.posexplode("results").alias("position", "r"))
    return rows.select("file", "position", F.col("r.manifest_path").alias("manifest_path")).where("coalesce(manifest_path, '') <> ''")


def read_prompt(spark: SparkSession, path: str) -> DataFrame:
    """A prompt's text with plain line ends, white space at both ends cut."""
    plain = F.regexp_replace("value", "\r*\n", "\n")
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(F.regexp_replace(plain, r"^\s+", ""), r"\s+$", "").alias("prompt"))


def parse_notes(lines: DataFrame, column: str = "value") -> DataFrame:
    """Candidates from note lines such as ``- 38-46s: priority=high, reason=...``; others are passed over."""
    form = r"^-\s*([0-9.]+)-([0-9.]+)s:\s*(.*)$"
    fields = F.str_to_map(F.regexp_extract(column, form, 3), F.lit(", "), F.lit("="))
    rows = lines.where(F.col(column).rlike(form)).withColumn("_f", fields)
    bound = lambda k: F.regexp_extract(column, form, k).try_cast("double")
    out = {"start_sec": bound(1), "end_sec": bound(2), "priority": F.col("_f.priority"), "needs_followup": F.col("_f.needs_followup"), "reason": F.col("_f.reason")}
    return rows.withColumns(out).drop("_f")


def parse_size(column: str) -> list[Column]:
    """width and height from ``WxH``, null where the text is of another form."""
    parts = F.split(F.trim(column), "x")
    return [F.when(F.size(parts) == 2, F.get(parts, F.lit(k)).try_cast("int")).alias(n) for k, n in enumerate(("width", "height"))]


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frame files of a folder in the order of their numbers, taken as numbers and not as text.  A
    folder without any is an error."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "frame_*.*").load(folder)
    rows = rows.withColumn("frame_index", F.regexp_extract("path", r"frame_(\d+)\.\w+$", 1).cast("int"))
    if rows.select("path").isEmpty():
        raise ValueError(f"no frames in {folder}")
    return rows.orderBy("frame_index")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, content) of the image files of a folder, content as RGB bytes.  Spark's
    reader gives blue, green, red; files that it can't read are left out."""
    image = spark.read.format("image").option("dropInvalid", "true").load(folder).select("image.*").where("nChannels = 3")
    turned = F.unhex(F.regexp_replace(F.hex("data"), "(..)(..)(..)", "$3$2$1"))
    return image.select(F.col("origin").alias("path"), "width", "height", turned.alias("content"))


def resolve_video(spark: SparkSession, video: str, config_folder: str, folder: str) -> str:
    """Where a configuration's video is: as it stands if absolute, else in the configuration's
    folder, else in ``folder``; one that is nowhere is an error."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    absolute = video.startswith("/") or "://" in video
    for place in (video,) if absolute else (f"{config_folder.rstrip('/')}/{video}", f"{folder.rstrip('/')}/{video}"):
        at = hadoop(place)
        if at.getFileSystem(conf).exists(at):
            return place
    raise FileNotFoundError(f"no such video: {video}")
