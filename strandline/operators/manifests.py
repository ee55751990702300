"""Where tiles and their documents go, the documents, and the requests that are made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.timefmt import fixed, for_path


#: Where images and the summary of a batch go that name no place.
FOLDER = "output/tiles"


def default_output(video: Column, start: Column, end: Column, fps: Column, folder: str = FOLDER) -> Column:
    """The image path of a range of a video that names none, from its padded bounds."""
    stem = F.concat_ws("_", paths.stem(video), for_path(start), for_path(end), F.concat(F.lit("fps"), for_path(fps)))
    return paths.join(F.lit(folder), F.concat(stem, F.lit(".jpg")))


def batch_output(folder: Column, output: Column, label: Column, start: Column, end: Column, fps: Column) -> Column:
    """The image path of a batch's range: its own, or one from its label or its bounds."""
    stem = F.coalesce(F.nullif(label, F.lit("")), F.concat_ws("_", for_path(start), for_path(end)))
    return F.coalesce(F.nullif(output, F.lit("")), paths.join(folder, F.concat(stem, F.lit("_fps"), for_path(fps), F.lit(".jpg"))))


def _folder(output: Column) -> Column:
    return F.when(paths.is_image(output), paths.with_suffix(output, "")).otherwise(output)


def tile_path(output: Column, tile_count: Column, tile_index: Column) -> Column:
    """A lone tile takes the output path, several go into a folder of its name."""
    return F.when(tile_count == 1, output).otherwise(F.concat(_folder(output), F.lit("/"), F.format_string("tile_%03d.jpg", tile_index)))


def manifest_path(output: Column, tile_count: Column, chosen: Column | None = None) -> Column:
    own = F.when(tile_count == 1, paths.with_suffix(output, ".json")).otherwise(F.concat(_folder(output), F.lit("/manifest.json")))
    return own if chosen is None else F.coalesce(F.nullif(chosen, F.lit("")), own)


def basename(manifest: Column) -> Column:
    """What a manifest is of: its folder's name if it is called manifest, else its own stem."""
    return F.when(paths.stem(manifest) == "manifest", paths.name(paths.parent(manifest))).otherwise(paths.stem(manifest))


def analysis_path(manifest: Column, folder: str | None = None, output: str | None = None) -> Column:
    """Where a manifest's analysis goes: the folder given, else the file given (for one manifest
    only; see ``requests``), else beside the image."""
    name = F.concat(basename(manifest), F.lit("_analysis.txt"))
    if folder:
        return paths.join(F.lit(folder), name)
    if output:
        return F.lit(output)
    up = paths.parent(manifest)
    return paths.join(F.when(paths.stem(manifest) == "manifest", paths.parent(up)).otherwise(up), name)


def manifests(tiles: DataFrame, key: list[str]) -> DataFrame:
    """One row a range: its tiles in order, their number, all frames, and the first tile's grid."""
    at = "tile_index"
    rest = [c for c in tiles.columns if c not in key]
    return tiles.groupBy(*key).agg(
        F.count("*").cast("int").alias("tile_count"),
        F.sum("frame_count").alias("frame_count_total"),
        F.min_by("grid_cols", at).alias("cols"),
        F.min_by("grid_rows", at).alias("rows"),
        F.array_sort(F.collect_list(F.struct(at, *(c for c in rest if c != at)))).alias("tiles"),
    )


#: What a manifest says of itself with one tile and with several.
KINDS = ("frame_tile", "frame_tiles")


def document(kinds: tuple[str, str] = KINDS, created_at: Column | None = None) -> Column:
    """The manifest of a range (see ``tiling.planned`` with cells and ``with_paths``) as JSON text,
    nulls written out: source, extraction, tiling and tiles.  ``created_at``: text of the time.

    With one tile, ``tiling`` has that tile's fields; with several, the first one's grid and sizes
    and the options."""
    c = F.col
    span = [c("requested_start_sec"), c("requested_end_sec"), c("start_sec"), c("end_sec"), (c("end_sec") - c("start_sec")).alias("duration_sec"), c("pad").alias("pad_sec"), c("fps"), c("width").alias("extract_width")]
    kept = F.lit(None).cast("string").alias("kept_frames_dir")
    entry = lambda t: F.struct(
        t["tile_index"].alias("tile_index"), paths.name(t["path"]).alias("filename"), t["path"].alias("path"),
        *(t[n].alias(n) for n in ("start_frame", "end_frame", "start_timestamp_sec", "end_timestamp_sec", "frame_count")),
        F.struct(t["grid_cols"].alias("cols"), t["grid_rows"].alias("rows")).alias("grid"), t["cells"].alias("cells"),
        t["cell_w"].alias("cell_width"), t["cell_h"].alias("cell_height"), t["tile_w"].alias("tile_width"), t["tile_h"].alias("tile_height"),
    )
    tiles = F.transform("tiles", entry)
    first = tiles[0]
    size = [first[n].alias(n) for n in ("cell_width", "cell_height")]
    whole = [first[n].alias(n) for n in ("tile_width", "tile_height")]
    head = [c("frames_per_tile"), c("tile_count")]
    lone = F.struct(*head, *(first[n].alias(n) for n in ("tile_index", "path", "start_frame", "end_frame", "start_timestamp_sec", "end_timestamp_sec", "frame_count", "grid", "cells")), *size, *whole)
    many = F.struct(*head, first["grid"]["cols"].alias("cols"), first["grid"]["rows"].alias("rows"), *size, c("label_height"), c("gap"), *whole)
    source = F.struct(c("video").alias("video_path"), c("duration_sec"), c("source_width").alias("width"), c("source_height").alias("height")).alias("source")
    made = (created_at if created_at is not None else F.lit(None).cast("string")).alias("created_at")

    def text(kind: str, extraction: Column, tiling: Column) -> Column:
        parts = F.struct(F.lit(1).alias("version"), made, F.lit(kind).alias("approach"), source, extraction.alias("extraction"), tiling.alias("tiling"), tiles.alias("tiles"))
        return F.to_json(parts, {"ignoreNullFields": "false", "pretty": "true"})

    return F.when(c("tile_count") == 1, text(kinds[0], F.struct(*span, kept), lone)).otherwise(text(kinds[1], F.struct(*span, c("frame_total").alias("frame_count_total"), kept), many))


def summary(results: DataFrame, key: list[str]) -> DataFrame:
    """One row a batch (``key``: its columns, among them video and config): the summary as JSON
    text, results in order of ``index``.  A dry run's results name no manifest."""
    made = F.struct("index", "label", "status", "output", "manifest_path", "start_sec", "end_sec")
    planned = F.struct("index", "label", "status", "output", "start_sec", "end_sec")
    entry = F.when(F.col("status") == "dry_run", F.to_json(planned, {"ignoreNullFields": "false"})).otherwise(F.to_json(made, {"ignoreNullFields": "false"}))
    each = results.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("index", entry.alias("text")))).alias("_all"))
    head = F.concat(F.lit('{"video":'), _quoted("video"), F.lit(',"config":'), _quoted("config"), F.lit(',"results":['))
    return each.select(*key, F.concat(head, F.array_join("_all.text", ","), F.lit("]}")).alias("document"))


def _quoted(name: str) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.struct(F.col(name).alias("x")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def with_paths(ranges: DataFrame) -> DataFrame:
    """Add its image's path to each of a range's ``tiles``, and ``manifest_path``, from ``output``,
    ``tile_count`` and, where a range names its own manifest, ``metadata_output``."""
    own = F.col("metadata_output") if "metadata_output" in ranges.columns else None
    place = lambda t: t.withField("path", tile_path(F.col("output"), F.col("tile_count"), t["tile_index"]))
    return ranges.withColumn("tiles", F.transform("tiles", place)).withColumn("manifest_path", manifest_path(F.col("output"), F.col("tile_count"), own))


def tile_line(t: Column) -> Column:
    return F.concat(
        F.lit("- Tile "), t["tile_index"], F.lit(": "), paths.name(t["path"]), F.lit(" (t="), fixed(t["start_timestamp_sec"], 1), F.lit("s-"),
        fixed(t["end_timestamp_sec"], 1), F.lit("s, frames "), t["start_frame"], F.lit("-"), t["end_frame"], F.lit(")"),
    )


def tile_context(ranges: DataFrame) -> DataFrame:
    """Add ``context``, the text that tells a model what the images of a manifest are, and
    ``images``, the tiles' paths in order, from start_sec, end_sec, fps and ``tiles`` with paths."""
    head = F.concat(F.lit("Tiles of one range, in order of time.\nRange: "), fixed(F.col("start_sec"), 3), F.lit("s to "), fixed(F.col("end_sec"), 3), F.lit("s\nRate: "), fixed(F.col("fps"), 3), F.lit("\nTiles: "), F.size("tiles"), F.lit("\n\n"))
    foot = F.lit("\n\nEach cell is labelled F<number> t=<seconds>s; seconds count from the start of the source.\nDescribe what goes on across tiles as one event.\n")
    lines = F.array_join(F.transform("tiles", tile_line), "\n")
    return ranges.withColumn("context", F.concat(head, lines, foot)).withColumn("images", F.col("tiles.path"))


def requests(contexts: DataFrame, model: str, prompt: str, folder: str | None = None, output: str | None = None) -> DataFrame:
    """One request a manifest: prompt and context, images in order, output.  One ``output`` for
    several manifests is an error when the requests are read; keys and other secrets are the
    client's and in no row."""
    out = contexts.withColumn("output_path", analysis_path(F.col("manifest_path"), folder, output))
    if output and not folder:
        several = contexts.agg(F.min("manifest_path") < F.max("manifest_path")).scalar()
        refused = F.raise_error(F.lit("one output file can't take several manifests' analyses: give a folder"))
        out = out.withColumn("output_path", F.when(several, refused).otherwise(F.col("output_path")))
    return out.withColumn("model", F.lit(model)).withColumn("prompt_text", F.concat(F.lit(prompt.strip()), F.lit("\n\n"), "context"))


def arguments(words: list[str], model: str = "--model", text: str = "--text", output: str = "--output", image: str = "--image") -> Column:
    """A request as a command line that begins with ``words``, each value after its flag."""
    images = F.flatten(F.transform("images", lambda x: F.array(F.lit(image), x)))
    head = F.array(*map(F.lit, words), F.lit(model), F.col("model"), F.lit(text), F.col("prompt_text"), F.lit(output), F.col("output_path"))
    return F.concat(head, images)


def collect_manifests(summary: DataFrame, given: DataFrame, position: str, path: str = "manifest_path") -> DataFrame:
    """The summary's paths, then those given, each path where it first stands; none empty."""
    both = summary.select(F.lit(0).alias("_from"), position, path).unionByName(given.select(F.lit(1).alias("_from"), position, path))
    first = both.where(F.coalesce(F.col(path), F.lit("")) != "").groupBy(path).agg(F.min(F.struct("_from", position)).alias("_at"))
    return first.select(path, F.col("_at._from").alias("source_rank"), F.col(f"_at.{position}").alias("position"))


def resolved(tiles: DataFrame, folder: str, path: str, filename: str, files: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``found``: the stored path if such a file exists, else the folder's file of that name,
    null if there is neither, which is an error with ``strict``."""
    known = files.select(F.col("path").alias("_file")).distinct()
    out = tiles.withColumn("_beside", F.concat_ws("/", folder, filename))
    for name in (path, "_beside"):
        hit = known.withColumnRenamed("_file", f"_hit{name}")
        out = out.join(hit, F.col(name) == F.col(f"_hit{name}"), "left")
    found = F.coalesce(f"_hit{path}", "_hit_beside")
    if strict:
        found = F.coalesce(found, F.raise_error(F.concat(F.lit("no such tile: "), F.coalesce(F.col(filename), F.lit("?")))))
    return out.withColumn("found", found).drop("_beside", f"_hit{path}", "_hit_beside")


def zipped(tiles: Column, found: Column) -> Column:
    """Each tile with the file found for it, by position; unequal lengths are an error."""
    same = F.assert_true(F.size(tiles) == F.size(found), F.lit("as many files as tiles are needed"))
    return F.when(same.isNull(), F.zip_with(tiles, found, lambda t, f: F.struct(t.alias("tile"), f.alias("found"))))


def status_counts(results: DataFrame) -> DataFrame:
    failed = F.count_if(F.col("status") == "failed")
    return results.agg(failed.alias("failed"), F.count("*").alias("total"), F.concat(failed.cast("string"), F.lit("/"), F.count("*").cast("string")).alias("summary"))


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)
