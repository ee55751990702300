"""Frames of media, through a decoder that is passed in, and a scan of them as a data source.

A decoder has ``probe(video) -> (duration_sec, width, height)`` and ``frames(video, start, end, fps,
width)``, which yields one encoded picture for each instant ``start + k / fps`` before ``end``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions import pixels
from ..operators.analysis import run_command

#: Frames that are decoded by one task at a time.
STRETCH = 256


class Decoder(Protocol):
    def probe(self, video: str) -> tuple[float, int, int]: ...

    def frames(self, video: str, start: float, end: float, fps: float, width: int) -> Iterator[bytes]: ...


def frames_between(start: float, end: float, fps: float) -> int:
    """Frames of a range: its length times the rate, rounded half up, at least one."""
    return max(1, math.floor((end - start) * fps + 0.5))


class StandIn:
    """A medium's stand-in: pictures of one colour each, made from the video's name and the time."""

    def __init__(self, duration: float = 60.0, width: int = 64, height: int = 36) -> None:
        self.size = (duration, width, height)

    def probe(self, video: str) -> tuple[float, int, int]:
        return self.size

    def colour(self, video: str, at: float) -> tuple[int, int, int]:
        mark = zlib.crc32(f"{video} {at:.3f}".encode())
        return mark & 255, mark >> 8 & 255, mark >> 16 & 255

    def frames(self, video: str, start: float, end: float, fps: float, width: int) -> Iterator[bytes]:
        _, wide, high = self.size
        shape = (max(1, round(width * high / wide / 2)) * 2, width, 3)
        for k in range(frames_between(start, end, fps)):
            yield pixels.png(np.broadcast_to(np.array(self.colour(video, start + k / fps), np.uint8), shape).copy())


class CommandDecoder:
    """Media through the command-line tools ffprobe and ffmpeg, where they are installed."""

    def probe(self, video: str) -> tuple[float, int, int]:
        show = ["ffprobe", "-v", "error", "-of", "csv=p=0:s=x", "-show_entries"]
        duration = float(run_command([*show, "format=duration", video], "probe"))
        if not (math.isfinite(duration) and duration > 0):
            raise RuntimeError(f"no duration: {video}")
        wide, high = run_command([*show, "stream=width,height", "-select_streams", "v:0", video], "probe").decode().strip().split("x")[:2]
        return duration, int(wide), int(high)

    def frames(self, video: str, start: float, end: float, fps: float, width: int) -> Iterator[bytes]:
        words = ["ffmpeg", "-v", "error", "-ss", f"{start:.6f}", "-t", f"{end - start:.6f}", "-i", video, "-vf", f"fps={fps},scale={width}:-2", "-f", "image2pipe", "-c:v", "png", "-"]
        found = pixels.split(run_command(words, "decode"))
        if not found:
            raise RuntimeError(f"no frames in {start}s to {end}s of {video}")
        yield from found


def probed(videos: DataFrame, decoder: Decoder) -> DataFrame:
    """Add duration_sec, source_width and source_height to the distinct ``video`` of a table."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decoder.probe(v.as_py()) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(d) for d, _, _ in found], pa.float64()), pa.array([w for _, w, _ in found], pa.int32()), pa.array([h for _, _, h in found], pa.int32())], names=["video", "duration_sec", "source_width", "source_height"])

    return videos.select("video").where("video is not null").distinct().mapInArrow(look, "video string, duration_sec double, source_width int, source_height int")


def decoded(ranges: DataFrame, key: list[str], decoder: Decoder, stretch: int = STRETCH) -> DataFrame:
    """Rows (key, frame_index, content) for ranges (key, video, start_sec, fps, width, frame_total):
    a range is decoded in stretches of frames, each by itself, so that a long one is many tasks'."""
    parts = ranges.select(*key, "video", "start_sec", "fps", "width", "frame_total", F.explode(F.sequence(F.lit(0), F.col("frame_total") - 1, F.lit(stretch))).alias("_from"))
    parts = parts.withColumn("_n", F.least(F.lit(stretch), F.col("frame_total") - F.col("_from")))
    shape = parts.select(*key).withColumn("frame_index", F.lit(0)).withColumn("content", F.lit(b"")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch[n][k].as_py() for n in ("video", "start_sec", "fps", "width", "_from", "_n")}
                start = row["start_sec"] + row["_from"] / row["fps"]
                found = decoder.frames(row["video"], start, start + row["_n"] / row["fps"], row["fps"], row["width"])
                for n, content in enumerate(found):
                    own = [batch[c].slice(k, 1) for c in key]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([row["_from"] + n], pa.int32()), pa.array([content], pa.binary())], names=[*key, "frame_index", "content"])

    return parts.repartition("video", "start_sec", "_from").mapInArrow(read, shape)


class Frames(DataSource):
    """``spark.read.format("media_frames")`` with options video, start, end, fps, width, stretch and
    decoder (``standin`` or ``command``).  Bounds on timestamp_sec narrow what is decoded where the
    session has spark.sql.python.filterPushdown.enabled."""

    @classmethod
    def name(cls) -> str:
        return "media_frames"

    def schema(self) -> str:
        return "frame_index int, timestamp_sec double, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.video, self.width = options["video"], int(options.get("width", 640))
        self.decoder = CommandDecoder() if options.get("decoder", "command") == "command" else StandIn()
        duration, _, _ = self.decoder.probe(self.video)
        self.start, self.fps, self.stretch = float(options.get("start", 0)), float(options.get("fps", 1)), int(options.get("stretch", STRETCH))
        total = frames_between(self.start, min(float(options.get("end", duration)), duration), self.fps)
        self.least, self.most = 0, total - 1

    def pushFilters(self, filters):
        """Whole frames only go; Spark still applies every bound."""
        for f in filters:
            if f.attribute == ("timestamp_sec",) if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) else False:
                at = (float(f.value) - self.start) * self.fps
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.least = max(self.least, math.floor(at) - 1)
                else:
                    self.most = min(self.most, math.ceil(at) + 1)
            yield f

    def partitions(self):
        return [InputPartition((k, min(k + self.stretch - 1, self.most))) for k in range(self.least, self.most + 1, self.stretch)]

    def read(self, partition):
        first, last = partition.value
        start = self.start + first / self.fps
        for k, content in enumerate(self.decoder.frames(self.video, start, start + (last - first + 1) / self.fps, self.fps, self.width)):
            yield first + k, self.start + (first + k) / self.fps, content
