"""Whole runs: tiles of ranges, batches from configurations, and the analysis of manifests.

All ranges of a run are rows of one plan; nothing loops over them.  What a run writes is read again
by the next step, so that pictures are made once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.timefmt import cell_label
from ..operators import analysis, drawing, manifests, ranges, tiling
from ..operators.ranges import OPTION_TYPES, Options
from ..sinks import write_files
from ..sources import media, plain_path, read_config, read_manifests, read_prompt, read_summaries, resolve_video

RESULT = ["index", "label", "status", "output", "manifest_path", "start_sec", "end_sec"]
SUMMARY = "batch_summary.json"


@dataclass(frozen=True)
class Run:
    """Where a run writes, how it decodes, and the text of its time."""

    root: str
    decoder: media.Decoder
    created_at: str | None = None


def laid_out(asked: DataFrame, run: Run) -> DataFrame:
    """Ranges (video, start, end, output and options) with the source's size, bounds, tiles and
    paths; ``failure`` names the rule that a range breaks, which then has no tiles."""
    sizes = media.probed(asked, run.decoder)
    bounded = ranges.with_bounds(asked.join(sizes, "video", "left"))
    own = F.coalesce(F.nullif("output", F.lit("")), manifests.default_output(F.col("video"), F.col("start_sec"), F.col("end_sec"), F.col("fps")))
    return manifests.with_paths(tiling.planned(bounded, with_cells=True).withColumn("output", own))


def pictures(planned: DataFrame, key: list[str], run: Run) -> DataFrame:
    """(path, content) of all tiles of ranges without a failure."""
    good = planned.where("failure is null")
    frames = media.decoded(good, key, run.decoder)
    geometry = good.select(*key, "start_sec", "fps", "label_height", "gap", F.explode("tiles").alias("t"))
    geometry = geometry.select(*key, "start_sec", "fps", "label_height", "gap", *(f"t.{n}" for n in ("tile_index", "start_frame", "end_frame", "grid_cols", "cell_w", "cell_h", "tile_w", "tile_h", "path")))
    per = good.select(*key, "frames_per_tile")
    cells = frames.join(per, key).withColumn("tile_index", F.floor(F.col("frame_index") / F.col("frames_per_tile")).cast("int")).join(geometry, [*key, "tile_index"])
    at = F.col("start_sec") + F.col("frame_index") / F.col("fps")
    cells = cells.withColumn("local_index", F.col("frame_index") - F.col("start_frame")).withColumn("label_text", cell_label(F.col("frame_index"), at))
    cells = cells.withColumn("font_size", tiling.font_size(F.col("label_height"))).withColumn("label_inset", tiling.label_inset(F.col("label_height")))
    drawn = drawing.draw_tiles(cells, key)
    return drawn.join(geometry.select(*key, "tile_index", "path"), [*key, "tile_index"]).select("path", "content")


def tile_ranges(asked: DataFrame, key: list[str], run: Run) -> DataFrame:
    """Decode, draw and write the tiles and manifests of ranges; returns them with their paths and
    ``failure``.  Nothing is written for a range that breaks a rule."""
    planned = laid_out(asked, run)
    good = planned.where("failure is null")
    write_files(pictures(planned, key, run), run.root)
    text = manifests.document(created_at=F.lit(run.created_at).cast("string"))
    write_files(good.select(F.col("manifest_path").alias("path"), text.alias("content")), run.root)
    return planned


def _first(name: str, kind: str | None = None) -> Column:
    found = F.coalesce(F.col(f"range.{name}"), F.col(f"defaults.{name}"))
    return (found.cast(kind) if kind else found).alias(name)


def config_ranges(spark: SparkSession, path: str, options: Options, folder: str, merge: bool = False) -> DataFrame:
    """The ranges of configurations: (file, index, video, output, label, options...), merged first
    where that is asked for, then filled from the configuration's defaults and ``options``.  A range
    without start or end is an error."""
    rows = read_config(spark, path)
    heads = rows.select("file", "video", "output_dir", "summary_output", "defaults").dropDuplicates(["file"])
    if merge:
        raw = rows.select("file", "range_index", _first("start"), _first("end"), *(F.col(f"range.{n}").alias(n) for n in ("label", "priority", "needs_followup")))
        merged = ranges.merge_ranges(raw, ["file"], "range_index", options.overlap_threshold, parity=True)
        # A range that absorbed others keeps the rest of the first one's options.
        first = rows.select("file", "range_index", "range", _first("start").alias("_s"), _first("end").alias("_e"))
        first = first.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("_s", "_e", "range_index")))
        upto = Window.partitionBy("file").orderBy("merged_index").rowsBetween(Window.unboundedPreceding, -1)
        merged = merged.withColumn("_n", F.coalesce(F.sum("merged_count").over(upto), F.lit(0)) + 1)
        both = merged.join(first.drop("_s", "_e", "range_index"), ["file", "_n"])
        for name in ("start", "end", "label", "priority", "needs_followup"):
            both = both.withColumn("range", F.col("range").withField(name, F.col(name)))
        rows = both.select("file", F.col("merged_index").alias("range_index"), "range").join(heads, "file")
    flat = rows.select("file", F.col("range_index").cast("int").alias("index"), "video", "output_dir", "summary_output", *(_first(n) for n in ("label", "start", "end", "output", *OPTION_TYPES)))
    flat = ranges.overlay(flat, None, options)
    for name in ("start", "end"):
        flat = flat.withColumn(name, F.coalesce(F.col(name), F.raise_error(F.concat(F.lit(f"range without {name}: "), F.col("index").cast("string")))))
    found = {(r.file, r.video): resolve_video(spark, r.video, r.file.rpartition("/")[0], folder) for r in heads.select("file", "video").collect()}  # one a configuration
    where = spark.createDataFrame([(*k, v) for k, v in found.items()], "file string, video string, _video string")
    flat = flat.join(F.broadcast(where), ["file", "video"]).withColumn("video", F.col("_video")).drop("_video")
    out = F.coalesce(F.nullif("output_dir", F.lit("")), F.lit(manifests.FOLDER))
    return flat.withColumn("output", manifests.batch_output(out, F.col("output"), F.col("label"), F.col("start"), F.col("end"), F.col("fps")))


def run_config(spark: SparkSession, path: str, options: Options, run: Run, folder: str) -> DataFrame:
    """A batch from each configuration, with ``options.merge_overlaps`` and ``options.dry_run``;
    writes tiles, manifests and each batch's summary, and returns the summary's results.  A dry run
    decodes nothing and still writes its summary."""
    asked = config_ranges(spark, path, options, folder, options.merge_overlaps)
    if options.dry_run:
        done = asked.withColumn("status", F.lit("dry_run")).withColumn("manifest_path", F.lit(None).cast("string"))
    else:
        done = tile_ranges(asked, ["file", "index"], run).withColumn("status", F.coalesce(F.concat(F.lit("failed: "), F.col("failure")), F.lit("ok")))
    results = done.select("file", "video", "summary_output", "index", "label", "status", "output", "manifest_path", F.col("start").alias("start_sec"), F.col("end").alias("end_sec"))
    made = manifests.summary(results.withColumn("config", F.col("file")), ["file", "video", "config", "summary_output"])
    at = F.coalesce(F.nullif("summary_output", F.lit("")), F.lit(f"{manifests.FOLDER}/{SUMMARY}"))
    write_files(made.select(at.alias("path"), F.col("document").alias("content")), run.root)
    failed = results.where("status like 'failed%'").limit(1).collect()
    if failed:
        raise ValueError(f"range {failed[0]['index']} {failed[0]['status']}")
    return results


def run_one(spark: SparkSession, options: Options, run: Run, folder: str, config: str | None = None, video: str | None = None) -> DataFrame:
    """A batch if a configuration is given, else one range of ``video``."""
    if config:
        return run_config(spark, config, options, run, folder)
    if not video:
        raise ValueError("a configuration or a video is needed")
    asked = spark.createDataFrame([(0, resolve_video(spark, video, folder, folder), float(options.start), options.end, options.output)], "index int, video string, start double, end double, output string")
    done = tile_ranges(ranges.overlay(asked, None, options), ["index"], run)
    failed = done.where("failure is not null").select("failure").limit(1).collect()
    if failed:
        raise ValueError(f"the range breaks the rule {failed[0]['failure']}")
    return done.select("output", "manifest_path", "tile_count", F.col("frame_total").alias("frame_count"))


def analysis_requests(spark: SparkSession, root: str, model: str, prompt: str, summary: str | None = None, given: list[str] | None = None, folder: str | None = None, output: str | None = None) -> DataFrame:
    """One request for each manifest that a summary names or that is given; the file ``prompt`` is
    read, and each manifest with its tiles, which must exist under ``root``."""
    none = spark.createDataFrame([], "position bigint, manifest_path string")
    named = read_summaries(spark, summary).select(F.col("position").cast("bigint"), "manifest_path") if summary else none
    listed = spark.createDataFrame(list(enumerate(given or ())), "position bigint, manifest_path string")
    wanted = manifests.collect_manifests(named, listed, "position")
    places = [r.manifest_path for r in wanted.select("manifest_path").collect()]  # a batch's manifests, by name
    if not places:
        raise ValueError("no manifest is given and no summary names one")
    whole = {p: p if p.startswith("/") else f"{root.rstrip('/')}/{p}" for p in places}
    tiles = read_manifests(spark, list(whole.values())).select("file", "extraction.*", "tile.*")
    tiles = tiles.withColumn("_folder", paths.parent(F.col("file"))).withColumn("_stored", paths.join(F.lit(root.rstrip("/")), F.col("path")))
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,jpeg,png}").load(root).select(plain_path(F.col("path")).alias("path"))
    tiles = manifests.resolved(tiles, "_folder", "_stored", "filename", there, strict=True)
    each = tiles.groupBy("file", "start_sec", "end_sec", "fps").agg(F.array_sort(F.collect_list(F.struct("tile_index", F.col("found").alias("path"), "start_timestamp_sec", "end_timestamp_sec", "start_frame", "end_frame"))).alias("tiles"))
    each = manifests.tile_context(each.withColumnRenamed("file", "manifest_path"))
    body = read_prompt(spark, prompt).first()["prompt"]
    return manifests.requests(each, model, body, folder, output).select("manifest_path", "model", "prompt_text", "images", "output_path")


def run_analysis(requests: DataFrame, client: analysis.Client, run: Run, table: str) -> DataFrame:
    """Call the client once for each request, write the outcomes as the table ``table`` and the
    analyses to their paths; raises n/m if any failed, when all have been tried and written."""
    analysis.outcomes(requests, client).write.mode("overwrite").parquet(table)
    done = requests.sparkSession.read.parquet(table)
    write_files(done.where("status = 'ok'").select(F.col("output_path").alias("path"), F.col("analysis").alias("content")), run.root)
    analysis.require_all(done)
    return done
