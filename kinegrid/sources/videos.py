"""Lists of videos, their files, stored maps, and frames from a decoder."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..schemas import FRAMES, VIDEOS
from .files import file_system


def listed(lines: DataFrame, column: str = "value") -> DataFrame:
    """video_id of each line that is neither blank nor a comment; repeats stay."""
    text = F.trim(F.col(column))
    return lines.select(text.alias("video_id")).where((F.col("video_id") != "") & ~F.col("video_id").startswith("#"))


def video_list(spark: SparkSession, path: str, fallback: list[str] | None = None) -> DataFrame:
    """The listed videos of a text file, `fallback` if there is no such file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fallback is not None and not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([(v,) for v in fallback], "video_id string")
    return listed(spark.read.text(path))


def chosen(spark: SparkSession, ids: list[str] | None = None, one: str | None = None, path: str | None = None, stored: DataFrame | None = None, fallback: list[str] | None = None) -> DataFrame:
    """The videos of a run: those named, else the one, else the listed ones of a text file, else those that a store holds, else the fallback.
    What is empty counts as not given; a file that does not exist is an error where there is no fallback."""
    named = lambda names: spark.createDataFrame([(v,) for v in names], "video_id string")
    if ids:
        return named(ids)
    if one:
        return named([one])
    if path:
        return video_list(spark, path, fallback)
    if stored is not None and not (found := stored_videos(stored)).isEmpty():
        return found
    if fallback:
        return named(fallback)
    raise ValueError("no videos: give ids, a list, a store or a fallback")


def best_files(found: DataFrame) -> DataFrame:
    """The file of each id: the first root, a direct hit before a deeper one, then the first path."""
    order = Window.partitionBy("id").orderBy("root_rank", F.desc("is_direct"), "path")
    return found.withColumn("at", F.row_number().over(order)).where("at = 1").drop("at")


def resolve(spark: SparkSession, videos: DataFrame, roots: list[str], suffix: str = ".mp4") -> tuple[DataFrame, DataFrame]:
    """(video_id, path of the best file under the roots; the ids without one). Only names are read, no contents."""
    found = None
    for rank, root in enumerate(roots):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root).select("path")
        name = F.regexp_extract("path", r"([^/]+)$", 1)
        direct = F.size(F.split(F.replace(F.col("path"), F.lit(root.rstrip("/") + "/"), F.lit("\x01")), "/")) == 1
        files = files.select(F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias("id"), F.lit(rank).alias("root_rank"), direct.cast("int").alias("is_direct"), "path")
        found = files if found is None else found.union(files)
    best = best_files(found).select(F.col("id").alias("video_id"), "path")
    return videos.join(best, "video_id"), videos.join(best, "video_id", "left_anti")


def stored_maps(paths: DataFrame, fusion: str = "rms") -> DataFrame:
    """The stored second stage of each video, of (video_id, path) rows: that of the wanted fusion, else of any, else by an older
    name; of equally good ones the first path."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[a-z]+)?/?$", 1)
    rank = F.when(name == F.concat(F.col("video_id"), F.lit(f"_gap_fusion_{fusion}")), 0)
    for i, kind in enumerate(("gap_fusion", "stage2_agg", "stage3_agg"), 1):
        rank = rank.when(name.startswith(F.concat(F.col("video_id"), F.lit(f"_{kind}_"))), i)
    order = Window.partitionBy("video_id").orderBy("rank", "path")
    return paths.withColumn("rank", rank).where("rank is not null").withColumn("at", F.row_number().over(order)).where("at = 1").select("video_id", "path")


def stored_videos(maps: DataFrame) -> DataFrame:
    """The ids that a stored map holds; a partition column is read from the listing alone."""
    return maps.select("video_id").distinct().orderBy("video_id")


Frame = tuple[int, float, int, int, bytes]
#: `decoder(path)` yields (frame_idx, native fps, h, w, gray) of all frames in order.
Decoder = Callable[[str], Iterator[Frame]]
#: What a decoder that says no rate has.
USUAL_FPS = 30.0


class SeekingDecoder(Protocol):
    """A decoder that can start anywhere: a long video is then several partitions."""

    def probe(self, path: str) -> tuple[float, int, int, int]:
        """(native fps, number of frames, width, height), without decoding frames."""

    def frames(self, path: str, first: int, end: int) -> Iterator[Frame]:
        """Frames first..end - 1, each as a plain decoder yields it."""


def probed(videos: DataFrame, decoder: SeekingDecoder) -> DataFrame:
    """The VIDEOS row of each (video_id, path), and `error`, which says why a file cannot be opened; nothing else of its row is known then."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for video, path in zip(batch["video_id"], batch["path"], strict=True):
                try:
                    rows.append((video, path, *decoder.probe(path), None))
                except Exception as e:  # whatever a decoder raises is a fault of this video alone
                    rows.append((video, path, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["video_id", "path", "native_fps", "frame_count", "width", "height", "error"]).astype({c: "Int32" for c in ("frame_count", "width", "height")})

    return videos.select("video_id", "path").mapInPandas(run, f"{VIDEOS}, error string")


class _Range(InputPartition):
    """Frames first..end - 1 of a video, or all that its decoder yields if `end` is None."""

    def __init__(self, video_id: str, path: str, fps: float | None, first: int, end: int | None, error: str | None = None):
        super().__init__((video_id, first))
        self.video_id, self.path, self.fps, self.first, self.end, self.error = video_id, path, fps, first, end, error


def _step(native: float, fps: float) -> int:
    return max(1, round(native / fps))


class _FrameReader(DataSourceReader):
    """Sampled frames, and a row with `error` in place of the frames that a decoder could not give."""

    def __init__(self, videos: list[tuple], decoder: Decoder | SeekingDecoder, fps: float, frames_each: int):
        self.videos, self.decoder, self.fps, self.frames_each = videos, decoder, fps, frames_each
        self.seconds = (float("-inf"), float("inf"))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on video_id leave whole videos out, those on timestamp_sec whole ranges of frames; the latter are tested again by Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("video_id",):
                self.videos = [v for v in self.videos if v[0] == f.value]
            elif isinstance(f, In) and f.attribute == ("video_id",):
                self.videos = [v for v in self.videos if v[0] in f.value]
            else:
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo)) and f.attribute == ("timestamp_sec",):
                    low, high = self.seconds
                    low = max(low, f.value) if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)) else low
                    high = min(high, f.value) if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)) else high
                    self.seconds = (low, high)
                yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for video, path, native, count, error in self.videos:
            if error is not None or count is None:
                out.append(_Range(video, path, native, 0, None, error))
                continue
            native = native if native and native > 0 else USUAL_FPS
            low, high = self.seconds
            first = max(0, math.floor(low * native)) if math.isfinite(low) else 0
            end = min(count, math.floor(high * native) + 1) if math.isfinite(high) else count
            # whole samples only, so that no range starts between two
            each = max(1, self.frames_each // _step(native, self.fps)) * _step(native, self.fps)
            out += [_Range(video, path, native, i, min(i + each, end)) for i in range(first // each * each, end, each)]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        video, at, native = partition.video_id, partition.first, partition.fps or USUAL_FPS
        try:
            if partition.error is not None:
                raise _Known(partition.error)
            plain = partition.end is None
            found = self.decoder(partition.path) if plain else self.decoder.frames(partition.path, partition.first, partition.end)
            for frame, rate, h, w, gray in found:
                if plain:
                    native = rate if rate > 0 else USUAL_FPS
                if frame / native > self.seconds[1]:
                    break
                at = frame + 1
                step = _step(native, self.fps)
                if frame % step == 0 and frame / native >= self.seconds[0]:
                    yield video, frame // step, frame, frame / native, h, w, gray, None
            else:
                if not plain and at < partition.end:
                    raise EOFError(f"frames {at} to {partition.end - 1} are missing")
        except Exception as e:  # whatever a decoder raises is a fault of this video alone
            yield video, None, at, at / native, None, None, None, str(e) if isinstance(e, _Known) else f"{type(e).__name__}: {e}"


class _Known(Exception):
    """A fault that probing has found."""


def frame_source(videos: list[tuple], decoder: Decoder | SeekingDecoder, fps: float = 5.0, frames_each: int = 9000) -> type[DataSource]:
    """A data source of sampled frames of (video_id, path, native_fps, frame_count, error) rows: a partition for each `frames_each`
    native frames of a video whose count is known, else for each video."""

    class FrameSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "video_frames"

        def schema(self) -> str:
            return f"{FRAMES}, error string"

        def reader(self, schema: StructType) -> DataSourceReader:
            return _FrameReader(videos, decoder, fps, frames_each)

    return FrameSource


def read_frames(spark: SparkSession, listed: list[tuple[str, str]], decoder: Decoder | SeekingDecoder, fps: float = 5.0, frames_each: int = 9000) -> DataFrame:
    """Sampled frames of (video_id, path) pairs. Filters on video_id and timestamp_sec reach the source.

    A decoder that fails, at once or half way, ends its own video only: a row with `error` says why, and frame_idx and timestamp_sec
    say where; `stages.base_and_errors` takes such videos out. Videos of a seeking decoder are probed by Spark first, a row for each."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    known = [(*v, None, None, None) for v in listed]
    if hasattr(decoder, "probe") and listed:
        names = spark.createDataFrame(listed, "video_id string, path string").repartition(min(len(listed), 1024))
        known = [(r.video_id, r.path, r.native_fps, r.frame_count, r.error) for r in probed(names, decoder).collect()]
    spark.dataSource.register(frame_source(known, decoder, fps, frames_each))
    return spark.read.format("video_frames").load()


class Y4m:
    """Frames of uncompressed YUV4MPEG2 files, by their luma plane; every frame has its place, so it seeks."""

    #: Fixed values of the format: bytes of both chroma planes, in quarters of the luma plane.
    CHROMA = {"mono": 0, "420": 2, "422": 4, "444": 8}

    def _head(self, stream) -> tuple[int, float, int, int, int]:
        """(length of the header line, fps, width, height, bytes of a frame)."""
        line = stream.read(1024).split(b"\n", 1)[0]
        words = line.decode("ascii", "replace").split(" ")
        if words[0] != "YUV4MPEG2":
            raise ValueError("no YUV4MPEG2 file")
        tags = {w[0]: w[1:] for w in words[1:] if w}
        w, h = int(tags["W"]), int(tags["H"])
        over, under = (int(x) for x in tags.get("F", "0:1").split(":"))
        kind = next((k for k in self.CHROMA if tags.get("C", "420").startswith(k)), None)
        if kind is None or re.search(r"p\d+$", tags.get("C", "420").removeprefix(kind)):
            raise ValueError(f"planes of kind {tags['C']} are not known")
        half_w, half_h = (w + 1) // 2 if kind in ("420", "422") else w, (h + 1) // 2 if kind == "420" else h
        return len(line) + 1, over / under if under else 0.0, w, h, w * h + (2 * half_w * half_h if kind != "mono" else 0)

    def _open(self, path: str):
        store, at = file_system(path)
        return store.open_input_file(at)

    def probe(self, path: str) -> tuple[float, int, int, int]:
        with self._open(path) as stream:
            head, fps, w, h, size = self._head(stream)
            return fps, (stream.size() - head) // (size + 6), w, h

    def frames(self, path: str, first: int, end: int) -> Iterator[Frame]:
        with self._open(path) as stream:
            head, fps, w, h, size = self._head(stream)
            for i in range(first, end):
                stream.seek(head + i * (size + 6))
                if stream.read(6) != b"FRAME\n":
                    raise ValueError(f"frame {i} does not start where it should")
                gray = stream.read(w * h)
                if len(gray) < w * h:
                    raise EOFError(f"frame {i} is cut off")
                yield i, fps, h, w, gray
