"""Whole runs with stand-ins for the decoder and the model, drawing, sinks, and the streaming merge."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandline import streaming
from strandline.functions import pixels
from strandline.operators import analysis, drawing, manifests, ranges
from strandline.plans import runs
from strandline.sinks import write_files
from strandline.sources import media, read_frames, read_images, read_summaries

DECODER = media.StandIn(duration=40.0, width=64, height=36)


@pytest.fixture()
def place(tmp_path):
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf/film.mp4").write_bytes(b"x")
    return tmp_path


def config(place, name="c", **more):
    body = {"video": "film.mp4", "output_dir": "out", "defaults": {"fps": 2, "pad": 1, "frames_per_tile": 6, "tile_width": 200, "tile_height": 160, "width": 32, "label_height": 12}, "ranges": [{"label": "a é", "start": 4, "end": 8, "priority": "high"}, {"start": 6, "end": 9, "fps": 1.0, "needs_followup": "yes"}, {"label": "c", "start": 20, "end": 20.5}]} | more
    (place / f"conf/{name}.json").write_text(json.dumps(body))
    return str(place / f"conf/{name}.json")


def test_batch(spark, place):
    root = place / "root"
    run = runs.Run(f"file://{root}", DECODER, "2024-01-01T00:00:00+00:00")
    found = runs.run_config(spark, config(place, summary_output="sum.json"), ranges.Options(), run, str(place)).orderBy("index").collect()
    assert [(r["index"], r.label, r.status, r.output) for r in found] == [(0, "a é", "ok", "out/a é_fps2.jpg"), (1, None, "ok", "out/6_9_fps1.jpg"), (2, "c", "ok", "out/c_fps2.jpg")]
    said = json.loads((root / "sum.json").read_text())
    assert said["video"].endswith("conf/film.mp4") and [r["manifest_path"] for r in said["results"]] == ["out/a é_fps2/manifest.json", "out/6_9_fps1.json", "out/c_fps2.json"]
    doc = json.loads((root / "out/a é_fps2/manifest.json").read_text())
    assert doc["extraction"]["start_sec"] == 3.0 and doc["extraction"]["frame_count_total"] == 12 and doc["extraction"]["kept_frames_dir"] is None
    assert [t["filename"] for t in doc["tiles"]] == ["tile_000.jpg", "tile_001.jpg"] and doc["tiles"][1]["cells"][0] == {"frame_index": 6, "timestamp_sec": 6.0, "filename": "frame_000006.jpg", "row": 0, "col": 0}
    lone = json.loads((root / "out/c_fps2.json").read_text())
    assert lone["approach"] == "frame_tile" and lone["tiling"]["tile_index"] == 0 and lone["tiling"]["path"] == "out/c_fps2.jpg"

    tile, t = pixels.opened((root / "out/a é_fps2/tile_001.jpg").read_bytes()), doc["tiles"][1]
    assert tile.shape == (t["tile_height"], t["tile_width"], 3)
    for c in t["cells"]:
        left, top = c["col"] * (t["cell_width"] + 4), c["row"] * (t["cell_height"] + 12 + 4)
        assert tuple(tile[top, left]) == DECODER.colour(said["video"], 3.0 + c["frame_index"] / 2)
        strip = tile[top + t["cell_height"] : top + t["cell_height"] + 12, left : left + t["cell_width"]]
        assert (strip == 255).any() and (strip[:, :6] == 0).all()
    assert (tile[: t["cell_height"], t["cell_width"] : t["cell_width"] + 4] == pixels.BACKGROUND).all()

    prompt = place / "p.txt"
    prompt.write_bytes(b"  Name it.\r\nAll of it.\n")
    asked = runs.analysis_requests(spark, str(root), "m", str(prompt), summary=str(root / "sum.json"), given=["out/c_fps2.json"])
    rows = asked.orderBy("manifest_path").collect()
    assert len(rows) == 3 and rows[1].prompt_text.startswith("Name it.\nAll of it.\n\nTiles of one range") and [os.path.basename(x) for x in rows[1].images] == ["tile_000.jpg", "tile_001.jpg"]
    done = runs.run_analysis(asked, analysis.StandIn(), run, str(place / "outcomes"))
    assert done.count() == 3 and (root / "out/a é_fps2_analysis.txt").read_text().startswith("2 images, ")
    bad = asked.withColumn("prompt_text", F.when(F.col("manifest_path").contains("/c_"), F.lit("x" + analysis.REFUSED)).otherwise(F.col("prompt_text")))
    with pytest.raises(RuntimeError, match="^1/3 analyses failed"):
        runs.run_analysis(bad, analysis.StandIn(), run, str(place / "outcomes"))
    with pytest.raises(Exception, match="give a folder"):
        manifests.requests(asked, "m", "p", output="one.txt").collect()
    (root / "out/c_fps2.jpg").unlink()
    with pytest.raises(Exception, match="no such tile: c_fps2.jpg"):
        runs.analysis_requests(spark, str(root), "m", str(prompt), given=["out/c_fps2.json"]).collect()
    with pytest.raises(Exception, match="no manifest is given"):
        runs.analysis_requests(spark, str(root), "m", str(prompt)).collect()


def test_merge_and_dry_run(spark, place):
    root = place / "root"
    run = runs.Run(f"file://{root}", DECODER)
    options = ranges.Options(merge_overlaps=True, dry_run=True)
    found = runs.run_config(spark, config(place), options, run, str(place)).orderBy("index").collect()
    assert [(r.start_sec, r.end_sec, r.label, r.status) for r in found] == [(4.0, 9.0, "a é", "dry_run"), (20.0, 20.5, "c", "dry_run")]
    said = json.loads((root / "output/tiles/batch_summary.json").read_text())
    assert [set(r) for r in said["results"]] == [{"index", "label", "status", "output", "start_sec", "end_sec"}] * 2
    assert [os.path.relpath(p, root) for p, _, names in os.walk(root) for n in names if not n.startswith(".")] == ["output/tiles"]
    assert read_summaries(spark, str(root / "output/tiles/batch_summary.json")).count() == 0


def test_one_and_refused(spark, place):
    run = runs.Run(f"file://{place}/root", DECODER)
    found = runs.run_one(spark, ranges.Options(start=1.0, end=90.0, fps=0.5), run, str(place / "conf"), video="film.mp4").first()
    assert (found.output, found.manifest_path, found.tile_count, found.frame_count) == ("output/tiles/film_1_40_fps0_5.jpg", "output/tiles/film_1_40_fps0_5/manifest.json", 2, 20)
    for more, what in (({}, "a configuration or a video"), ({"video": "none.mp4"}, "no such video")):
        with pytest.raises((ValueError, FileNotFoundError), match=what):
            runs.run_one(spark, ranges.Options(), run, str(place), **more)
    with pytest.raises(ValueError, match="start_in_source"):
        runs.run_one(spark, ranges.Options(start=50.0, end=60.0), run, str(place / "conf"), video="film.mp4")
    for bad, what in (({"video": ""}, "without a video"), ({"ranges": []}, "without ranges"), ({"ranges": [{"start": 1}]}, "without end")):
        with pytest.raises(Exception, match=what):
            runs.run_config(spark, config(place, **bad), ranges.Options(), run, str(place)).collect()
    with pytest.raises(ValueError, match="range 1 failed: fps"):
        runs.run_config(spark, config(place, ranges=[{"start": 1, "end": 2}, {"start": 1, "end": 2, "fps": -1}]), ranges.Options(), run, str(place))


def test_frames_source(spark, place):
    spark.dataSource.register(media.Frames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"video": "v", "decoder": "standin", "fps": "4", "width": "16", "stretch": "7"}
    whole = spark.read.format("media_frames").options(**options).load()
    assert whole.count() == 240
    part = whole.where("timestamp_sec >= 10 and timestamp_sec < 12.5")
    assert [r.frame_index for r in part.orderBy("frame_index").collect()] == list(range(40, 50))
    reader = media.Frames(options).reader(None)
    list(reader.pushFilters([media.GreaterThanOrEqual(("timestamp_sec",), 10.0), media.LessThan(("timestamp_sec",), 12.5)]))
    assert [p.value for p in reader.partitions()] == [(39, 45), (46, 51)]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    for row in part.select("frame_index", "content").collect():
        (place / f"frame_{row.frame_index:06d}.png").write_bytes(bytes(row.content))
    assert [r.frame_index for r in read_frames(spark, str(place)).collect()] == list(range(40, 50))
    image = read_images(spark, str(place)).orderBy("path").first()
    assert (image.width, image.height) == (16, 8) and tuple(image.content[:3]) == media.StandIn().colour("v", 10.0)
    with pytest.raises(ValueError, match="no frames"):
        read_frames(spark, str(place / "conf"))


def test_commands():
    with pytest.raises(RuntimeError, match="no such command"):
        analysis.run_command(["no-such-command-here"], "x")
    with pytest.raises(RuntimeError, match="ended with 3: oh"):
        analysis.run_command(["sh", "-c", "echo oh >&2; exit 3"], "x")
    assert analysis.CommandClient(["echo", "said"]).describe("m", "p", ["a"]) == "said --model m --text p --image a"
    assert analysis.locate("given", "x") == "given" and analysis.locate(None, "sh").endswith("sh")
    with pytest.raises(RuntimeError, match="name one"):
        analysis.locate(None, "no-such-command-here")


def test_pictures():
    rng = np.random.default_rng(1)
    some = rng.integers(0, 256, (7, 9, 3)).astype(np.uint8)
    assert (pixels.opened(pixels.png(some)) == some).all() and (pixels.resized(some, 9, 7) == some).all()
    assert pixels.split(pixels.png(some) + pixels.png(some[:3])) == [pixels.png(some), pixels.png(some[:3])]
    flat = np.full((5, 8, 3), 77, np.uint8)
    assert (pixels.resized(flat, 31, 3) == 77).all() and (pixels.resized(flat, 2, 20) == 77).all()


def test_sink(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", "é"), ("c.txt", None)], "path string, content string")
    assert write_files(rows, f"file://{tmp_path}") == 2 and (tmp_path / "a/b.txt").read_text() == "é" and (tmp_path / "c.txt").read_bytes() == b""
    with pytest.raises(ValueError, match="a/b.txt"):
        write_files(rows.unionAll(rows.limit(1)), f"file://{tmp_path}")


def test_zip(spark):
    df = spark.createDataFrame([([1, 2], ["a", "b"])], "t array<int>, f array<string>")
    assert [tuple(x) for x in df.select(manifests.zipped(F.col("t"), F.col("f"))).first()[0]] == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="as many files"):
        df.select(manifests.zipped(F.col("t"), F.slice("f", 1, 1))).collect()


def test_overlay_rows(spark):
    rows = spark.createDataFrame([(1, 0.0, 2.0, "a")], "k int, start double, end double, label string")
    one = spark.createDataFrame([("a", 3.0), ("a", 4.0)], "label string, fps double")
    assert ranges.overlay(rows, one.where("false"), ranges.Options()).first().fps == 1.0
    assert ranges.overlay(rows, one.where("false"), ranges.Options(), on=["label"]).first().fps == 1.0
    assert ranges.overlay(rows, one.limit(1), ranges.Options(), on=["label"]).first().fps == 3.0
    for on in (None, ["label"]):
        with pytest.raises(Exception, match="(?i)more than one row|two rows"):
            ranges.overlay(rows, one if on else one.drop("label"), ranges.Options(), on=on).collect()


def test_streaming_merge(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("user_id < 40")
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) / 1e9")
    rows = events.select("user_id", "event_id", start.alias("start"), (start + F.col("value")).alias("end"), F.col("event_type").alias("label"), F.when(F.col("value") > 50, "yes").alias("needs_followup"), F.when(F.col("event_type") == "click", "high").alias("priority"))
    want = ranges.merge_ranges(rows, ["user_id"], "event_id", 0.5).drop("merged_index")
    timed = rows.withColumn("time", F.timestamp_seconds("start"))
    last = timed.limit(1).withColumn("user_id", F.lit(-1).cast("long")).withColumn("start", F.lit(1e9)).withColumn("end", F.lit(1e9 + 1)).withColumn("time", F.timestamp_seconds("start"))
    timed.unionByName(last).withColumn("part", F.expr("if(user_id < 0, 4, pmod(hash(event_id), 4))")).repartition("part").write.partitionBy("part").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    found = streaming.merge_stream(source, "user_id", "event_id", "time", 0.5, late="400 days")
    query = found.writeStream.format("memory").queryName("merged").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    got = spark.table("merged")
    assert got.count() > 20 and got.exceptAll(want).isEmpty() and want.exceptAll(got.where("user_id >= 0")).isEmpty()
