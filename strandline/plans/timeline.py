"""The operators over the events table: each user is a source, each event a range of its timeline.

Seconds count from the first of January 2024, a thousand of them as one, so that ranges (an event's
value is its length) overlap as often as they don't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefmt import cell_label, fixed, iso_utc, micro
from ..operators import analysis, manifests, ranges, sampling, tiling, triage
from ..sources import parse_notes, parse_size

OPTIONS = ranges.Options(fps=0.2)
DEFAULTS = [("error", 0.5, 2.0, None, None), ("click", 0.25, None, 16, 3), ("view", 0.1, None, 9, None), ("purchase", None, 2.0, None, None)]
PROMPT, MODEL, MOST, PER_SOURCE = "Name what happens.", "vision-1", 20.0, 3
KEY = ["source_id", "range_id"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) / 1e9")
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("source_id"), F.col("event_id").alias("range_id"), start.alias("start"), (start + F.col("value")).alias("end"), kind.alias("label"),
        F.expr("case event_type when 'error' then 'high' when 'purchase' then 'medium' when 'signup' then 'low' when 'view' then 'odd' end").alias("priority"),
        F.expr("case when value > 100 then 'yes' when value > 50 then 'no' end").alias("needs_followup"), "value",
    )


EV = """ev as (select user_id source_id, event_id range_id, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 1e9 s,
  date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 1e9 + value e, event_type as label,
  case event_type when 'error' then 'high' when 'purchase' then 'medium' when 'signup' then 'low' when 'view' then 'odd' end as priority,
  case when value > 100 then 'yes' when value > 50 then 'no' end nf, value from events)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("source_id").agg(F.max("start").alias("duration_sec")).selectExpr(
        "*", "cast(480 + 16 * (source_id % 9) as int) source_width", "cast(270 + 10 * (source_id % 7) as int) source_height")


SRC = """src as (select source_id, max(s) duration_sec, cast(480 + 16 * (source_id % 9) as int) source_width,
  cast(270 + 10 * (source_id % 7) as int) source_height from ev group by source_id)"""


def frame_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = sources(spark, sf_dir).select("source_id", F.concat_ws("x", "source_width", F.when(F.col("source_id") % 11 == 0, "?").otherwise(F.col("source_height").cast("string"))).alias("probe"))
    return text.select("source_id", *parse_size("probe"))


def overlaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    defaults = spark.createDataFrame(DEFAULTS, "label string, fps double, pad double, frames_per_tile int, cols int")
    return ranges.overlay(events(spark, sf_dir), defaults, OPTIONS, on=["label"])


OV = """ov as (select *, case label when 'error' then 0.5::double when 'click' then 0.25::double when 'view' then 0.1::double else 0.2::double end fps,
  case when label in ('error', 'purchase') then 2.0::double else 0.0::double end pad,
  cast(case label when 'click' then 16 when 'view' then 9 else 12 end as int) frames_per_tile, cast(case label when 'click' then 3 end as int) fixed_cols from ev)"""


def bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.with_bounds(overlaid(spark, sf_dir).join(sources(spark, sf_dir), "source_id"))


BD = """bd0 as (select ov.*, duration_sec, source_width, source_height, case when not duration_sec > 0 then 'duration' when not s >= 0 then 'start' when not e > s then 'end_after_start'
    when not s < duration_sec then 'start_in_source' when not least(duration_sec, least(e, duration_sec) + pad) > greatest(0, s - pad) then 'padded_empty' end failure
    from ov join src using (source_id)),
  bd as (select *, case when failure is null then s end requested_start_sec, case when failure is null then least(e, duration_sec) end requested_end_sec,
    case when failure is null then greatest(0, s - pad) end start_sec, case when failure is null then least(duration_sec, least(e, duration_sec) + pad) end end_sec from bd0)"""


def gridded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.frames(bounded(spark, sf_dir).where("failure is null"))


FR = """fr0 as (select *, greatest(1, cast(floor((end_sec - start_sec) * fps + 0.5) as int)) n from bd where failure is null),
  fr1 as (select *, cast(unnest(range(n)) as int) frame_index from fr0), fr as (select *, start_sec + frame_index / fps t from fr1)"""


def frame_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("timestamp_sec")
    return gridded(spark, sf_dir).select("range_id", "frame_index", at, micro(at).alias("stored_sec"), cell_label(F.col("frame_index"), at).alias("label_text"))


def grid_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = gridded(spark, sf_dir).select("source_id", "range_id", "frame_index", "timestamp_sec")
    rows = events(spark, sf_dir)
    return sampling.nearest_before(grid, rows, "source_id", "timestamp_sec", "start", "range_id", "value", stretch=500.0)


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.with_geometry(tiling.chunk(gridded(spark, sf_dir)))


GE = """ge0 as (select *, cast(floor(frame_index / frames_per_tile) as int) tile_index from fr),
  ge1 as (select *, frame_index - tile_index * frames_per_tile local_index, least(frames_per_tile, n - tile_index * frames_per_tile) k from ge0),
  ge2 as (select *, coalesce(fixed_cols, greatest(1, cast(ceil(sqrt(least(k, frames_per_tile))) as int))) grid_cols, source_height / source_width::double aspect from ge1),
  ge3 as (select *, cast(ceil(k / grid_cols::double) as int) grid_rows from ge2),
  ge4 as (select *, greatest(1, cast(floor(least((1920 - (grid_cols - 1) * 4) / grid_cols::double,
    greatest(1.0::double, (1080 - (grid_rows - 1) * 4) / grid_rows::double - 32) / aspect)) as int)) cell_w from ge3),
  ge5 as (select *, greatest(1, cast(round_even(cell_w * aspect, 0) as int)) cell_h from ge4),
  ge as (select *, grid_cols * cell_w + (grid_cols - 1) * 4 tile_w, grid_rows * (cell_h + 32) + (grid_rows - 1) * 4 tile_h,
    local_index // grid_cols as row_at, local_index % grid_cols as col_at from ge5)"""


def tile_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry(spark, sf_dir).select("range_id", "frame_index", "tile_index", "local_index", "grid_cols", "grid_rows", "cell_w", "cell_h", "tile_w", "tile_h", F.col("row").alias("row_at"), F.col("col").alias("col_at"), F.col("left").alias("left_px"), F.col("top").alias("top_px"))


def planned(spark: SparkSession, sf_dir: str, with_cells: bool = False) -> DataFrame:
    """Valid ranges with their tiles in the range's row."""
    return tiling.planned(bounded(spark, sf_dir).where("failure is null"), with_cells)


def tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["tile_index", "start_frame", "end_frame", "start_timestamp_sec", "end_timestamp_sec", "frame_count", "grid_cols", "grid_rows", "tile_w", "tile_h"]
    rows = planned(spark, sf_dir).select("range_id", F.explode("tiles").alias("t"))
    return rows.select("range_id", *(f"t.{n}" for n in names), tiling.frame_name(F.col("t.start_frame")).alias("first_file"))


def tiles_of_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from rows of frames, as a table of decoded frames has them."""
    found = tiling.tiles(geometry(spark, sf_dir), ["range_id"])
    cells = F.array_join(F.transform("cells", lambda x: F.concat_ws(":", x["frame_index"], x["row"], x["col"])), ",")
    return found.select("range_id", "tile_index", "start_frame", "end_frame", "frame_count", "cell_w", "cell_h", cells.alias("cells"))


TL = """tl as (select source_id, range_id, label, fps, start_sec, end_sec, tile_index, cast(min(frame_index) as int) start_frame, cast(max(frame_index) as int) end_frame,
  cast(printf('%.6f', min(t)) as double) start_timestamp_sec, cast(printf('%.6f', max(t)) as double) end_timestamp_sec, cast(count(*) as int) frame_count,
  any_value(grid_cols) grid_cols, any_value(grid_rows) grid_rows, any_value(tile_w) tile_w, any_value(tile_h) tile_h from ge group by all)"""


def outputs(spark: SparkSession, sf_dir: str, with_cells: bool = False) -> DataFrame:
    """Ranges with their tiles and all paths."""
    folder = F.concat(F.lit("out/"), F.col("source_id"))
    name = F.when(F.col("range_id") % 3 == 0, F.lit(None)).otherwise(F.concat_ws("_", "label", "range_id"))
    output = manifests.batch_output(folder, F.lit(None).cast("string"), name, F.col("start_sec"), F.col("end_sec"), F.col("fps"))
    return manifests.with_paths(planned(spark, sf_dir, with_cells).withColumn("output", output))


MF = """mf0 as (select source_id, range_id, label, fps, start_sec, end_sec, cast(count(*) as int) tile_count, cast(sum(frame_count) as bigint) frame_count_total,
    arg_min(grid_cols, tile_index) cols, arg_min(grid_rows, tile_index) as rows_of from tl group by all),
  mf1 as (select *, case when range_id % 3 = 0 then PATHNUM(start_sec) || '_' || PATHNUM(end_sec) else label || '_' || range_id end stem from mf0),
  mf2 as (select *, stem || '_fps' || PATHNUM(fps) name, 'out/' || source_id folder from mf1),
  mf as (select *, folder || '/' || name || '.jpg' as output, folder || '/' || name || case when tile_count = 1 then '.json' else '/manifest.json' end manifest_path,
    folder || '/' || name || '_analysis.txt' analysis_path from mf2)"""
MF = MF.replace("PATHNUM(start_sec)", "replace(rtrim(rtrim(printf('%.3f', start_sec), '0'), '.'), '.', '_')").replace("PATHNUM(end_sec)", "replace(rtrim(rtrim(printf('%.3f', end_sec), '0'), '.'), '.', '_')").replace("PATHNUM(fps)", "replace(rtrim(rtrim(printf('%.3f', fps), '0'), '.'), '.', '_')")


def manifest_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("manifest_path")
    first = F.col("tiles")[0]
    return outputs(spark, sf_dir).select("range_id", "tile_count", F.col("frame_total").cast("long").alias("frame_count_total"), first["grid_cols"].alias("cols"), first["grid_rows"].alias("rows_of"), "output", at, manifests.basename(at).alias("name"), manifests.analysis_path(at).alias("analysis_path"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.tile_context(outputs(spark, sf_dir))


def tile_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(spark, sf_dir).select("range_id", "context")


CX = """cx0 as (select mf.*, tl.tile_index, tl.start_frame, tl.end_frame, tl.start_timestamp_sec t0, tl.end_timestamp_sec t1,
    case when tile_count = 1 then output else folder || '/' || name || '/' || printf('tile_%03d.jpg', tile_index) end path from mf join tl using (source_id, range_id)),
  cx as (select range_id, manifest_path, analysis_path, 'Tiles of one range, in order of time.' || chr(10) || 'Range: ' || printf('%.3f', start_sec) || 's to ' || printf('%.3f', end_sec) || 's' || chr(10) ||
    'Rate: ' || printf('%.3f', fps) || chr(10) || 'Tiles: ' || tile_count || chr(10) || chr(10) ||
    string_agg('- Tile ' || tile_index || ': ' || regexp_extract(path, '[^/]*$') || ' (t=' || printf('%.1f', t0) || 's-' || printf('%.1f', t1) || 's, frames ' || start_frame || '-' || end_frame || ')', chr(10) order by tile_index)
    || chr(10) || chr(10) || 'Each cell is labelled F<number> t=<seconds>s; seconds count from the start of the source.' || chr(10) || 'Describe what goes on across tiles as one event.' || chr(10) context,
    string_agg('--image ' || path, ' ' order by tile_index) images from cx0 group by range_id, manifest_path, analysis_path, start_sec, end_sec, fps, tile_count)"""


def analysis_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = manifests.requests(contexts(spark, sf_dir), MODEL, PROMPT)
    return made.select("range_id", F.array_join(manifests.arguments(["tool", "recognize-image"]), " ").alias("command"))


def manifest_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all manifests, some results without one, and all given again by hand."""
    found = outputs(spark, sf_dir).select(F.col("range_id").alias("at"), "manifest_path")
    summary = found.select("at", F.when(F.col("at") % 5 != 0, F.col("manifest_path")).alias("manifest_path"))
    return manifests.collect_manifests(summary, found, "at")


def resolved_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = events(spark, sf_dir).select("range_id", F.concat(F.lit("d/"), F.col("source_id")).alias("folder"), F.concat(F.lit("tile_"), F.col("range_id"), F.lit(".jpg")).alias("filename"))
    made = made.withColumn("stored", F.concat(F.lit("moved/"), "filename"))
    files = made.where("range_id % 2 = 0").select(F.concat_ws("/", "folder", "filename").alias("path")).unionAll(made.where("range_id % 3 = 0").select("stored"))
    return manifests.resolved(made, "folder", "stored", "filename", files).select("range_id", "found")


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.overlapping_pairs(events(spark, sf_dir), "source_id", "range_id", 0.5, 100.0)


def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranges.merge_ranges(events(spark, sf_dir), ["source_id"], "range_id", 0.5)
    return found.withColumnsRenamed({"start": "start_sec", "end": "end_sec"})


_RANK = "case {} when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end"
_HIGHER = f"{_RANK.format('''coalesce(o.priority, 'low')''')} > {_RANK.format('''coalesce(r.priority, 'low')''')}"
MG = f"""o as (select *, row_number() over (partition by source_id order by s, e, range_id) rn from ev),
  r as (select source_id, rn, 0 merged_index, s, e, label, nf, priority, 1 merged_count from o where rn = 1
    union all
    select source_id, rn, case when hit then merged_index else merged_index + 1 end, case when hit then least(rs, s) else s end, case when hit then greatest(re, e) else e end,
      case when not hit or rlabel = label then label else rlabel || '_' || label end,
      case when not hit then nf when rnf = 'yes' or nf = 'yes' then 'yes' else coalesce(rnf, nf) end,
      case when not hit then priority when higher then coalesce(priority, 'low') else coalesce(rpriority, 'low') end, case when hit then merged_count + 1 else 1 end
    from (select o.*, r.merged_index, r.merged_count, r.s rs, r.e re, r.label rlabel, r.nf rnf, r.priority rpriority, {_HIGHER} higher,
      case when least(r.e, o.e) <= greatest(r.s, o.s) then 0 else (least(r.e, o.e) - greatest(r.s, o.s)) / least(r.e - r.s, o.e - o.s) end >= 0.5 hit
      from r join o on o.source_id = r.source_id and o.rn = r.rn + 1)),
  mg as (select * from r qualify row_number() over (partition by source_id, merged_index order by rn desc) = 1)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source's merged ranges that go on to the second stage, the first few."""
    going = merged_ranges(spark, sf_dir).where(triage.needs_detail())
    return triage.top_candidates(going, ["source_id"], PER_SOURCE, [triage.rank(F.col("priority")).desc(), F.col("start_sec"), F.col("merged_index")])


def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("source_id", "candidate_rank", "merged_index", "start_sec", "end_sec", "label", "priority")


CA = f"""ca as (select * from (select *, row_number() over (partition by source_id order by {_RANK.format('priority')} desc, s, merged_index) candidate_rank
  from mg where coalesce(priority = 'high', false) or coalesce(nf = 'yes', false)) where candidate_rank <= {PER_SOURCE})"""


def split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates cut into parts short enough to look at closely."""
    found = candidates(spark, sf_dir).withColumnsRenamed({"start_sec": "start", "end_sec": "end"})
    return ranges.split_long(found, MOST).select("source_id", "candidate_rank", "part", F.col("start").alias("start_sec"), F.col("end").alias("end_sec"))


SP = f"""sp0 as (select *, greatest(1, cast(ceil((e - s) / {MOST}::double) as int)) parts from ca),
  sp1 as (select *, cast(unnest(range(parts)) as int) part from sp0),
  sp as (select source_id, candidate_rank, part, s + part * {MOST}::double start_sec, least(e, s + part * {MOST}::double + {MOST}::double) end_sec from sp1)"""


def coarse_to_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overview, merge, triage, split, and the frames and tiles that the last stage will take."""
    fps = triage.STAGES[2][1]
    parts = split_parts(spark, sf_dir).withColumn("frames", sampling.frame_count(F.col("start_sec"), F.col("end_sec"), F.lit(fps)))
    parts = parts.withColumn("tiles", F.ceil(F.col("frames") / OPTIONS.frames_per_tile))
    return parts.groupBy("source_id", "candidate_rank").agg(F.count("*").alias("parts"), F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.sum("frames").alias("frames"), F.sum("tiles").alias("tiles"))


def refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges to look at once more: of low confidence, or at their tile's edge."""
    rows = events(spark, sf_dir).selectExpr("range_id", "start as start_sec", "end as end_sec", "floor(start / 50) * 50D as tile_start_sec", "floor(start / 50) * 50D + 50D as tile_end_sec", "case when value < 5 then 'low' when value > 20 then 'high' end confidence")
    return rows.where(triage.needs_refining()).select("range_id", "start_sec", "end_sec")


def joined_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).selectExpr("source_id", "label", "start as start_sec", "end as end_sec")
    return triage.join_titles(rows, ["source_id"], "label", 5.0).withColumnRenamed("events", "n_events")


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = lambda c: fixed(F.col(c), 2)
    line = F.concat(F.lit("- "), second("start"), F.lit("-"), second("end"), F.lit("s: priority="), F.coalesce("priority", F.lit("none")), F.lit(", needs_followup="), F.coalesce("needs_followup", F.lit("no")), F.lit(", reason="), "label")
    lines = events(spark, sf_dir).select("range_id", F.when(F.col("range_id") % 7 == 0, F.lit("# heading")).otherwise(line).alias("value"))
    return parse_notes(lines).drop("value")


def tile_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = sampling.frame_count(F.col("start_sec"), F.col("end_sec"), F.col("fps"))
    rows = bounded(spark, sf_dir).where("failure is null").withColumn("frame_total", n).withColumn("frames_per_tile", F.col("frames_per_tile") + F.lit(8) * (F.col("range_id") % 2))
    return rows.select("range_id", F.array_join(tiling.warnings(), ",").alias("warned"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.status_counts(bounded(spark, sf_dir).select(F.when(F.col("failure").isNull(), "ok").otherwise("failed").alias("status")))


def timeline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each candidate of a source, in order of time."""
    line = F.concat(F.lit("- "), fixed(F.col("start_sec"), 1), F.lit("s to "), fixed(F.col("end_sec"), 1), F.lit("s: "), "label")
    rows = candidates(spark, sf_dir).withColumn("line", line).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("start_sec", "merged_index", "line"))).alias("lines"))
    return rows.select("source_id", F.array_join("lines.line", "\n").alias("report"))


def rule_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of which each breaks one or two of all rules, or none, by its number."""
    rows = overlaid(spark, sf_dir).join(sources(spark, sf_dir), "source_id")
    broken = {"fps": "double('nan')", "start": "-1D", "pad": "double('infinity')", "frames_per_tile": "0", "cols": "0", "cell_width": "-2", "tile_width": "0", "width": "0", "label_height": "0", "gap": "-1", "quality": "96", "duration_sec": "0D"}
    for k, (name, value) in enumerate(broken.items()):
        rows = rows.withColumn(name, F.when((F.col("range_id") % 17 == k) | (F.col("range_id") % 23 == k + 3), F.expr(value)).otherwise(F.col(name)))
    rows = rows.withColumn("end", F.when(F.col("range_id") % 17 == 13, F.col("start")).when(F.col("range_id") % 17 == 14, F.lit(None)).otherwise(F.col("end")))
    return ranges.with_bounds(rows).select("range_id", "failure", "start_sec", "end_sec")


_BROKEN = ("fps", "start", "pad", "frames_per_tile", "cols", "cell_width", "tile_size", "width", "label_height", "gap", "quality", "duration")
_FAIL = " ".join(f"when range_id % 17 = {k} or range_id % 23 = {k + 3} then '{name}'" for k, name in enumerate(_BROKEN))
RF = f"""rf0 as (select *, case when range_id % 17 = 13 then s when range_id % 17 = 14 then null else e end e2 from ov join src using (source_id)),
  rf1 as (select *, coalesce(e2, duration_sec) e3, case {_FAIL} when not coalesce(e2, duration_sec) > s then 'end_after_start' when not s < duration_sec then 'start_in_source'
    when not least(duration_sec, least(coalesce(e2, duration_sec), duration_sec) + pad) > greatest(0, s - pad) then 'padded_empty' end failure from rf0)"""


def one_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of defaults for all ranges, with options that only some ranges set."""
    rows = events(spark, sf_dir).withColumn("cell_width", F.expr("case when range_id % 4 = 0 then 100 + cast(range_id % 50 as int) end")).withColumn("label_height", F.expr("cast(1 + range_id % 60 as int)"))
    one = spark.createDataFrame([(0.5, None, 20)], "fps double, pad double, label_height int")
    found = ranges.overlay(rows.withColumn("label_height", F.when(F.col("range_id") % 2 == 0, F.col("label_height"))), one, OPTIONS).join(sources(spark, sf_dir), "source_id")
    laid = tiling.planned(ranges.with_bounds(found).where("failure is null"))
    t = F.col("tiles")[0]
    return laid.select("range_id", "fps", "pad", "label_height", t["cell_w"].alias("cell_w"), t["cell_h"].alias("cell_h"), tiling.font_size(F.col("label_height")).alias("font_size"), tiling.label_inset(F.col("label_height")).alias("label_inset"))


OO = """oo0 as (select ev.*, duration_sec, source_height / source_width::double aspect, case when range_id % 4 = 0 then 100 + cast(range_id % 50 as int) end cell_width,
    case when range_id % 2 = 0 then cast(1 + range_id % 60 as int) else 20 end label_height, greatest(0, s) s0, least(e, duration_sec) e0 from ev join src using (source_id) where s < duration_sec and e > s),
  oo1 as (select *, greatest(1, cast(floor((e0 - s0) * 0.5::double + 0.5) as int)) n from oo0), oo2 as (select *, least(12, n) k from oo1),
  oo3 as (select *, greatest(1, cast(ceil(sqrt(k)) as int)) g from oo2), oo4 as (select *, cast(ceil(k / g::double) as int) h from oo3),
  oo as (select *, coalesce(cell_width, greatest(1, cast(floor(least((1920 - (g - 1) * 4) / g::double, greatest(1.0::double, (1080 - (h - 1) * 4) / h::double - label_height) / aspect)) as int))) cell_w from oo4)"""


def explicit_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs and manifests that ranges name themselves, and analyses that go to one folder."""
    rows = planned(spark, sf_dir).withColumn("own", F.expr("case range_id % 4 when 0 then concat('deep/x', range_id, '.JPEG') when 1 then concat('y.z/', range_id, '.png') when 2 then concat('plain', range_id) else '' end"))
    rows = rows.withColumn("output", manifests.batch_output(F.lit("top/"), F.col("own"), F.concat(F.lit("n"), F.col("range_id")), F.col("start_sec"), F.col("end_sec"), F.col("fps")))
    rows = manifests.with_paths(rows.withColumn("metadata_output", F.expr("case when range_id % 5 = 0 then concat('/abs/', range_id, '.json') when range_id % 5 = 1 then '' end")))
    at = F.col("manifest_path")
    lone = manifests.default_output(F.concat(F.lit("in/film."), F.col("source_id"), F.lit(".mp4")), F.col("start_sec"), F.col("end_sec"), F.col("fps"))
    return rows.select("range_id", "output", at, F.element_at("tiles.path", -1).alias("last_path"), manifests.analysis_path(at, folder="all").alias("in_folder"), manifests.analysis_path(at, output="one.txt").alias("in_file"), lone.alias("lone_output"))


EL = """el0 as (select *, case range_id % 4 when 0 then 'deep/x' || range_id when 1 then 'y.z/' || range_id when 2 then 'plain' || range_id else 'top/n' || range_id || '_fps' || PATHNUM(fps) end base,
    case range_id % 4 when 0 then '.JPEG' when 1 then '.png' when 2 then '' else '.jpg' end tail, cast(ceil(n / frames_per_tile::double) as int) tile_count from fr0),
  el1 as (select *, base || tail as output, case when range_id % 5 = 0 then '/abs/' || range_id || '.json' when tile_count = 1 then base || '.json' else base || '/manifest.json' end manifest_path from el0),
  el as (select *, case when range_id % 5 = 0 then cast(range_id as varchar) else regexp_extract(base, '[^/]*$') end name from el1)""".replace("PATHNUM(fps)", "replace(rtrim(rtrim(printf('%.3f', fps), '0'), '.'), '.', '_')")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of each range as JSON text."""
    made = outputs(spark, sf_dir, with_cells=True).withColumn("video", F.concat(F.lit("in/"), F.col("source_id")))
    instant = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(range_id % 5 * 0.25 + range_id as decimal(18, 6)))")
    return made.select(*KEY, "label", "start", "end", "output", "manifest_path", "video", manifests.document(created_at=iso_utc(instant)).alias("document"))


def manifest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifests say, read again from their text."""
    tile = "struct<tile_index: int, filename: string, path: string, start_frame: int, end_frame: int, start_timestamp_sec: double, end_timestamp_sec: double, frame_count: int, grid: struct<cols: int, rows: int>, cells: array<struct<frame_index: int, timestamp_sec: double, filename: string, row: int, col: int>>, cell_width: int, tile_height: int>"
    whole = f"version int, created_at string, approach string, source struct<video_path: string, duration_sec: double, width: int, height: int>, extraction struct<requested_start_sec: double, requested_end_sec: double, start_sec: double, end_sec: double, duration_sec: double, pad_sec: double, fps: double, extract_width: int, frame_count_total: int, kept_frames_dir: string>, tiling struct<frames_per_tile: int, tile_count: int, cols: int, rows: int, cell_width: int, label_height: int, tile_width: int, tile_height: int, path: string>, tiles array<{tile}>"
    rows = documents(spark, sf_dir).select("range_id", "document", F.from_json("document", whole).alias("d"))
    last = F.element_at("d.tiles", -1)
    return rows.select("range_id", "d.version", "d.created_at", "d.approach", "d.source.video_path", "d.source.width", "d.extraction.requested_end_sec", "d.extraction.duration_sec", "d.extraction.pad_sec", "d.extraction.frame_count_total", "d.tiling.tile_count", "d.tiling.cols", "d.tiling.label_height", "d.tiling.tile_height", F.col("d.tiling.path").alias("lone_path"), F.size("d.tiles").alias("n_tiles"), last["filename"].alias("last_file"), last["end_timestamp_sec"].alias("last_sec"), last["grid"]["rows"].alias("last_rows"), F.element_at(last["cells"], -1)["filename"].alias("last_frame"), F.element_at(last["cells"], -1)["col"].alias("last_col"), F.col("document").contains('"kept_frames_dir" : null').alias("says_null"))


MD = """md0 as (select source_id, range_id, max(tile_index) last_index from tl group by all),
  md as (select mf.*, bd.duration_sec, bd.requested_end_sec, bd.pad, bd.source_width, d.tile_index last_index, d.end_timestamp_sec last_sec, d.grid_rows last_rows, d.grid_cols last_cols, d.end_frame last_frame, d.frame_count last_count, f.tile_h first_h
    from mf join bd using (source_id, range_id) join md0 using (source_id, range_id) join tl d on d.source_id = mf.source_id and d.range_id = mf.range_id and d.tile_index = md0.last_index
    join tl f on f.source_id = mf.source_id and f.range_id = mf.range_id and f.tile_index = 0)"""


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's ranges as one batch, one batch in three as a dry run: the summary, read again."""
    w = "row_number() over (partition by source_id order by range_id) - 1"
    rows = documents(spark, sf_dir).withColumn("index", F.expr(w).cast("int")).withColumn("config", F.concat(F.lit('conf "'), F.col("source_id"), F.lit('".json')))
    rows = rows.withColumn("status", F.when(F.col("source_id") % 3 == 0, "dry_run").otherwise("ok")).withColumn("start_sec", F.col("start")).withColumn("end_sec", F.col("end"))
    made = manifests.summary(rows, ["source_id", "video", "config"])
    shape = "video string, config string, results array<struct<index: int, label: string, status: string, output: string, manifest_path: string, start_sec: double, end_sec: double>>"
    read = made.select("source_id", F.from_json("document", shape).alias("d"), F.col("document").contains("manifest_path").alias("names_manifests"))
    return read.select("source_id", "d.video", "d.config", "names_manifests", F.explode("d.results").alias("r")).select("source_id", "video", "config", "names_manifests", F.col("r.index").alias("place"), "r.label", "r.status", "r.output", "r.manifest_path", "r.start_sec", "r.end_sec")


def new_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd ranges as new ones against even ones that are there."""
    rows = events(spark, sf_dir)
    return triage.fold_into(rows.where("range_id % 2 = 0"), rows.where("range_id % 2 = 1"), "source_id", "range_id", 0.5, 100.0).select("source_id", "range_id", "into_id", F.col("start").alias("start_sec"), F.col("end").alias("end_sec"))


NC = """nc0 as (select a.source_id, a.range_id, b.range_id into_id, a.s, a.e, (least(a.e, b.e) - greatest(a.s, b.s)) / least(a.e - a.s, b.e - b.s) ratio
    from ev a join ev b on a.source_id = b.source_id and a.range_id % 2 = 1 and b.range_id % 2 = 0 and a.s < b.e and b.s < a.e),
  nc1 as (select * from nc0 where ratio >= 0.5 qualify row_number() over (partition by range_id order by ratio desc, into_id) = 1),
  nc as (select ev.source_id, ev.range_id, nc1.into_id, s0 start_sec, e0 end_sec from (select *, s s0, e e0 from ev where range_id % 2 = 1) ev left join nc1 using (range_id)
    union all select b.source_id, b.range_id, null, least(b.s, min(nc1.s)), greatest(b.e, max(nc1.e)) from ev b left join nc1 on nc1.into_id = b.range_id where b.range_id % 2 = 0 group by b.source_id, b.range_id, b.s, b.e)"""


def analysis_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to a stand-in for a model that refuses some; each outcome by itself."""
    made = manifests.requests(contexts(spark, sf_dir), MODEL, PROMPT).withColumn("prompt_text", F.concat("prompt_text", F.when(F.col("range_id") % 13 == 0, F.lit(analysis.REFUSED)).otherwise("")))
    return analysis.outcomes(made.select("range_id", "manifest_path", "model", "prompt_text", "images", "output_path"), analysis.StandIn()).select("range_id", "status", "error", "analysis")


def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's report with all its sections."""
    found = candidates(spark, sf_dir).select("source_id", "start_sec", "end_sec", F.col("label").alias("title"), F.concat_ws(" of ", "priority", "merged_count").alias("summary"), F.concat(F.lit("part "), F.col("merged_index")).alias("evidence"))
    looked = split_parts(spark, sf_dir).select("source_id", "start_sec", "end_sec", F.lit(triage.STAGES[2][1]).alias("fps"), F.concat(F.lit("m"), F.col("part")).alias("manifest"), F.concat(F.lit("a"), F.col("part")).alias("analysis"))
    heads = sources(spark, sf_dir).select("source_id", F.concat(fixed(F.col("duration_sec"), 1), F.lit(" s in all")).alias("overview"), F.when(F.col("source_id") % 2 == 0, F.lit("no sound")).alias("cautions"))
    return triage.report(heads, found, looked, ["source_id"])


FRP = f"""frp0 as (select source_id, string_agg('### ' || k || '. ' || label || ' (' || printf('%.1f', s) || 's - ' || printf('%.1f', e) || 's)' || chr(10) || '- title: ' || label || chr(10) || '- start_sec / end_sec: ' || printf('%.1f', s) || ' / ' || printf('%.1f', e) || chr(10)
      || '- summary: ' || concat_ws(' of ', priority, merged_count) || chr(10) || '- evidence: part ' || merged_index, chr(10) || chr(10) order by k) found,
      string_agg('- ' || printf('%.1f', s) || 's to ' || printf('%.1f', e) || 's: ' || label, chr(10) order by k) line
    from (select *, row_number() over (partition by source_id order by s, e, label) k from ca) group by source_id),
  frp1 as (select source_id, string_agg('- ' || printf('%.1f', start_sec) || 's to ' || printf('%.1f', end_sec) || 's, fps=8.0, manifest=m' || part || ', analysis=a' || part, chr(10) order by start_sec, end_sec, part) looked from sp group by source_id),
  frp as (select source_id, '## Overview' || chr(10) || printf('%.1f', duration_sec) || ' s in all' || chr(10) || chr(10) || '## Candidates' || chr(10) || coalesce(found, '') || chr(10) || chr(10) || '## Ranges looked at again' || chr(10) || coalesce(looked, '')
    || chr(10) || chr(10) || '## Timeline' || chr(10) || coalesce(line, '') || chr(10) || chr(10) || '## Cautions' || chr(10) || case when source_id % 2 = 0 then 'no sound' else '' end report
    from src left join frp0 using (source_id) left join frp1 using (source_id))"""


def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", iso_utc(F.col("ts")).alias("created_at"))


def _sql(last: str, *parts: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",\n".join((EV, *parts)) + f"\n{last}"


_TO_BD = (SRC, OV, BD)
_TO_GE = (*_TO_BD, FR, GE)
_TO_MF = (*_TO_GE, TL, MF)

QUERIES = {
    "source_bounds": (sources, _sql("select * from src", SRC)),
    "frame_sizes": (frame_sizes, _sql("select source_id, source_width width, case when source_id % 11 != 0 then source_height end height from src", SRC)),
    "range_defaults": (
        lambda s, d: overlaid(s, d).select("range_id", "fps", "pad", "frames_per_tile", F.col("cols").alias("fixed_cols"), "tile_width", "quality"),
        _sql("select range_id, fps, pad, frames_per_tile, fixed_cols, 1920 tile_width, 90 quality from ov", OV),
    ),
    "range_validation": (
        lambda s, d: bounded(s, d).select("range_id", "failure", "requested_start_sec", "requested_end_sec", "start_sec", "end_sec"),
        _sql("select range_id, failure, requested_start_sec, requested_end_sec, start_sec, end_sec from bd", *_TO_BD),
    ),
    "overlap_pairs": (
        overlap_pairs,
        _sql("""select * from (select a.source_id, a.range_id left_range_id, b.range_id right_range_id, (least(a.e, b.e) - greatest(a.s, b.s)) / least(a.e - a.s, b.e - b.s) ratio
          from ev a join ev b on a.source_id = b.source_id and a.range_id < b.range_id and a.s < b.e and b.s < a.e) where ratio >= 0.5"""),
    ),
    "merged_ranges": (merged_ranges, _sql("select source_id, merged_index, s start_sec, e end_sec, label, nf needs_followup, priority, merged_count from mg", MG, recursive=True)),
    "frame_grid": (frame_grid, _sql("select range_id, frame_index, t timestamp_sec, cast(printf('%.6f', t) as double) stored_sec, 'F' || frame_index || ' t=' || printf('%.1f', t) || 's' label_text from fr", *_TO_BD, FR)),
    "grid_resample": (
        grid_resample,
        _sql("""select fr.source_id, fr.range_id, frame_index, t timestamp_sec, coalesce(v.value, f.value) as value
          from fr asof left join (select source_id, s, value from ev) v on fr.source_id = v.source_id and fr.t > v.s
          join (select source_id, arg_min(value, s) as value from ev group by 1) f on f.source_id = fr.source_id""", *_TO_BD, FR),
    ),
    "tile_cells": (
        tile_cells,
        _sql("""select range_id, frame_index, tile_index, local_index, grid_cols, grid_rows, cell_w, cell_h, tile_w, tile_h, row_at, col_at,
          col_at * (cell_w + 4) left_px, row_at * (cell_h + 32 + 4) top_px from ge""", *_TO_GE),
    ),
    "tile_bounds": (
        tile_bounds,
        _sql("""select range_id, tile_index, start_frame, end_frame, start_timestamp_sec, end_timestamp_sec, frame_count, grid_cols, grid_rows, tile_w, tile_h,
          printf('frame_%06d.jpg', start_frame) first_file from tl""", *_TO_GE, TL),
    ),
    "manifest_layout": (manifest_layout, _sql("select range_id, tile_count, frame_count_total, cols, rows_of, output, manifest_path, name, analysis_path from mf", *_TO_MF)),
    "tile_context": (tile_context, _sql("select range_id, context from cx", *_TO_MF, CX)),
    "analysis_requests": (
        analysis_requests,
        _sql(f"select range_id, 'tool recognize-image --model {MODEL} --text {PROMPT}' || chr(10) || chr(10) || context || ' --output ' || analysis_path || ' ' || images command from cx", *_TO_MF, CX),
    ),
    "manifest_union": (
        manifest_union,
        _sql("""select manifest_path, source_rank, position from (select manifest_path, 0 source_rank, range_id as position from mf where range_id % 5 != 0
          union all select manifest_path, 1, range_id from mf) qualify row_number() over (partition by manifest_path order by source_rank, position) = 1""", *_TO_MF),
    ),
    "resolved_tiles": (
        resolved_tiles,
        _sql("select range_id, case when range_id % 3 = 0 then 'moved/tile_' || range_id || '.jpg' when range_id % 2 = 0 then 'd/' || source_id || '/tile_' || range_id || '.jpg' end as found from ev"),
    ),
    "top_candidates": (top_candidates, _sql("select source_id, cast(candidate_rank as int) candidate_rank, merged_index, s start_sec, e end_sec, label, priority from ca", MG, CA, recursive=True)),
    "split_parts": (split_parts, _sql("select * from sp", MG, CA, SP, recursive=True)),
    "flagship_coarse_to_fine": (
        coarse_to_fine,
        _sql(f"""select source_id, candidate_rank, count(*) parts, min(start_sec) start_sec, max(end_sec) end_sec, cast(sum(frames) as bigint) frames, cast(sum(ceil(frames / {OPTIONS.frames_per_tile}::double)) as bigint) tiles
          from (select *, greatest(1, cast(floor((end_sec - start_sec) * 8.0::double + 0.5) as int)) frames from sp) group by source_id, candidate_rank""", MG, CA, SP, recursive=True),
    ),
    "refined_ranges": (
        refined,
        _sql("select range_id, s start_sec, e end_sec from ev where value < 5 or s <= floor(s / 50) * 50 or e >= floor(s / 50) * 50 + 50"),
    ),
    "joined_titles": (
        joined_titles,
        _sql("""select source_id, label, min(s) start_sec, max(e) end_sec, count(*) n_events from (select *, sum(fresh) over (partition by source_id, label order by s, e rows unbounded preceding) run
          from (select *, case when s <= max(e) over (partition by source_id, label order by s, e rows between unbounded preceding and 1 preceding) + 5 then 0 else 1 end fresh from ev)) group by source_id, label, run"""),
    ),
    "candidate_notes": (
        noted,
        _sql("""select range_id, cast(printf('%.2f', s) as double) start_sec, cast(printf('%.2f', e) as double) end_sec, coalesce(priority, 'none') as priority, coalesce(nf, 'no') needs_followup, label reason
          from ev where range_id % 7 != 0"""),
    ),
    "tile_warnings": (
        tile_warnings,
        _sql("""select range_id, case when n <= k then '' else case when k > 16 then 'large_tiles,' else '' end || 'split_into_' || cast(ceil(n / k::double) as int) end warned
          from (select range_id, n, frames_per_tile + 8 * (range_id % 2) k from fr0)""", *_TO_BD, FR),
    ),
    "status_counts": (status_counts, _sql("select count(failure) failed, count(*) total, count(failure) || '/' || count(*) summary from bd", *_TO_BD)),
    "timeline_report": (
        timeline_report,
        _sql("select source_id, string_agg('- ' || printf('%.1f', s) || 's to ' || printf('%.1f', e) || 's: ' || label, chr(10) order by s, merged_index) report from ca group by source_id", MG, CA, recursive=True),
    ),
    "tiles_of_frames": (
        tiles_of_frames,
        _sql("""select range_id, tile_index, cast(min(frame_index) as int) start_frame, cast(max(frame_index) as int) end_frame, cast(count(*) as int) frame_count, any_value(cell_w) cell_w, any_value(cell_h) cell_h,
          string_agg(frame_index || ':' || row_at || ':' || col_at, ',' order by frame_index) cells from ge group by range_id, tile_index""", *_TO_GE),
    ),
    "rule_failures": (
        rule_failures,
        _sql("""select range_id, failure, case when failure is null then greatest(0, s - pad) end start_sec, case when failure is null then least(duration_sec, least(e3, duration_sec) + pad) end end_sec from rf1""", SRC, OV, RF),
    ),
    "one_overlay": (
        one_overlay,
        _sql("""select range_id, 0.5::double fps, 0.0::double pad, label_height, cell_w, greatest(1, cast(round_even(cell_w * aspect, 0) as int)) cell_h,
          greatest(12, least(24, cast(round_even(label_height * 0.55::double, 0) as int))) font_size, greatest(1, cast(round_even(label_height * 0.18::double, 0) as int)) label_inset from oo""", SRC, OO),
    ),
    "explicit_layout": (
        explicit_layout,
        _sql("""select range_id, output, manifest_path, case when tile_count = 1 then output else base || printf('/tile_%03d.jpg', tile_count - 1) end last_path, 'all/' || name || '_analysis.txt' in_folder, 'one.txt' in_file,
          'output/tiles/film.' || source_id || '_' || PATHNUM(start_sec) || '_' || PATHNUM(end_sec) || '_fps' || PATHNUM(fps) || '.jpg' lone_output from el""".replace("PATHNUM(start_sec)", "replace(rtrim(rtrim(printf('%.3f', start_sec), '0'), '.'), '.', '_')").replace("PATHNUM(end_sec)", "replace(rtrim(rtrim(printf('%.3f', end_sec), '0'), '.'), '.', '_')").replace("PATHNUM(fps)", "replace(rtrim(rtrim(printf('%.3f', fps), '0'), '.'), '.', '_')"), *_TO_BD, FR, EL),
    ),
    "manifest_documents": (
        manifest_documents,
        _sql("""select range_id, 1 as version, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(range_id * 1000000 + range_id % 5 * 250000), '%Y-%m-%dT%H:%M:%S')
            || case range_id % 5 when 0 then '' when 1 then '.250000' when 2 then '.500000' when 3 then '.750000' else '' end || '+00:00' created_at,
          case when tile_count = 1 then 'frame_tile' else 'frame_tiles' end approach, 'in/' || source_id video_path, source_width width, requested_end_sec, end_sec - start_sec duration_sec, pad pad_sec,
          case when tile_count > 1 then cast(frame_count_total as int) end frame_count_total, tile_count, case when tile_count > 1 then cols end cols, case when tile_count > 1 then 32 end label_height, first_h tile_height,
          case when tile_count = 1 then output end lone_path, tile_count n_tiles, case when tile_count = 1 then name || '.jpg' else printf('tile_%03d.jpg', last_index) end last_file, last_sec, last_rows,
          printf('frame_%06d.jpg', last_frame) last_frame, (last_count - 1) % last_cols last_col, true says_null from md""", *_TO_MF, MD),
    ),
    "batch_summary": (
        batch_summary,
        _sql("""select source_id, 'in/' || source_id video, 'conf "' || source_id || '".json' config, source_id % 3 != 0 names_manifests, cast(row_number() over (partition by source_id order by range_id) - 1 as int) place, label,
          case when source_id % 3 = 0 then 'dry_run' else 'ok' end status, output, case when source_id % 3 != 0 then manifest_path end manifest_path, s start_sec, e end_sec from mf join (select range_id, s, e from bd) using (range_id)""", *_TO_MF),
    ),
    "new_candidates": (new_candidates, _sql("select * from nc", NC)),
    "analysis_outcomes": (
        analysis_outcomes,
        _sql(f"""select range_id, case when range_id % 13 = 0 then 'failed' else 'ok' end status, case when range_id % 13 = 0 then 'refused' end error,
          case when range_id % 13 != 0 then len(string_split(images, '--image ')) - 1 || ' images, ' || md5('{MODEL}' || chr(10) || '{PROMPT}' || chr(10) || chr(10) || context) end analysis from cx""", *_TO_MF, CX),
    ),
    "full_report": (full_report, _sql("select * from frp", SRC, MG, CA, SP, FRP, recursive=True)),
    "instants": (instants, "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when microsecond(ts) % 1000000 != 0 then '.' || printf('%06d', microsecond(ts) % 1000000) else '' end || '+00:00' created_at from events"),
}
