"""Maps as NumPy archives (.npz), the exchange format: read by blocks of frames, written a file for each video.

An archive is a zip of .npy members. Reading looks at the directory and the members' headers first, in a Spark job; a task then
opens only the members that its columns need, and of uncompressed ones only its own frames. Writing streams one member after the
other, a frame at a time, through `files`, so that a video that fails leaves no file and the others are written.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby
from typing import Any
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .files import TaskFiles, file_system, save

#: Frames of a partition, where the archive allows to start anywhere.
BLOCK = 512
#: Fixed values of the format: names of fused maps in the order in which readers look for them, by kind. {} is the wanted fusion.
FUSED = {"mu": ("MU_fused", "MU_{}", "MU_rms", "MU_mean", "MU_max", "MU_median"), "m": ("M_fused", "M_{}", "M_rms", "M_max", "M_mean", "M_median")}
#: Fixed values of the format: single numbers of a run and the columns that they become.
NUMBERS = {"align_start_sampled_index": "align_start", "num_sampled_frames": "num_sampled", "original_cell_px": "cell_px", "unit_cell_px": "unit_px", "video_width": "width", "video_height": "height"}


def _open(path: str) -> zipfile.ZipFile:
    store, at = file_system(path)
    return zipfile.ZipFile(store.open_input_file(at))


def _header(member: zipfile.ZipExtFile) -> tuple[tuple[int, ...], bool, np.dtype]:
    """(shape, whether columns come first, type) of a .npy member, which is then at its first value."""
    version = np.lib.format.read_magic(member)
    return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(member)


def directory(path: str) -> dict[str, tuple[tuple[int, ...], str, bool]]:
    """Shape, type and whether it is stored uncompressed, of each array of an archive."""
    out = {}
    with _open(path) as found:
        for info in found.infolist():
            with found.open(info) as member:
                shape, by_column, kind = _header(member)
            if by_column and len(shape) > 1:
                raise ValueError(f"{info.filename}: arrays by column are not known")
            out[info.filename.removesuffix(".npy")] = (shape, kind.str, info.compress_type == zipfile.ZIP_STORED)
    return out


def listed(files: DataFrame) -> DataFrame:
    """video_id, path, arrays (name, shape, stored) of each (video_id, path), and `error` for an archive that cannot be opened. Values are not read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for video, path in zip(batch["video_id"], batch["path"], strict=True):
                try:
                    rows.append((video, path, [{"name": n, "shape": list(s), "stored": stored} for n, (s, _, stored) in directory(path).items()], None))
                except Exception as e:  # whatever is wrong with an archive is a fault of its video alone
                    rows.append((video, path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["video_id", "path", "arrays", "error"])

    return files.select("video_id", "path").mapInPandas(run, "video_id string, path string, arrays array<struct<name:string,shape:array<long>,stored:boolean>>, error string")


class _Block(InputPartition):
    def __init__(self, video_id: str, path: str, first: int, end: int, error: str | None = None):
        super().__init__((video_id, first))
        self.video_id, self.path, self.first, self.end, self.error = video_id, path, first, end, error


@dataclass
class _Column:
    """A column: the names of the arrays that may hold it, the best first, and the component of a vector."""

    name: str
    arrays: tuple[str, ...]
    component: int | None = None
    needed: bool = True


def _pick(column: _Column, known: Iterable[str]) -> str | None:
    return next((a for a in column.arrays if a in known), None)


class _ArrayReader(DataSourceReader):
    def __init__(self, archives: list, columns: list[_Column], block: int, schema: pa.Schema):
        self.archives, self.columns, self.block, self.schema = archives, columns, block, schema

    def partitions(self) -> list[InputPartition]:
        out = []
        for video, path, arrays, error in self.archives:
            known = {a["name"]: (a["shape"], a["stored"]) for a in arrays or []}
            used = [_pick(c, known) for c in self.columns]
            if error is None:
                missing = dict.fromkeys(c.arrays[0] for c, n in zip(self.columns, used, strict=True) if c.needed and n is None)
                shapes = {tuple(known[n][0][:3]) for n in used if n}
                error = f"{', '.join(missing)} missing" if missing else "maps of different shapes" if len(shapes) > 1 else "no maps of frames, rows and columns" if any(len(s) != 3 for s in shapes) else None
            if error is not None:
                out.append(_Block(video, path, 0, 0, error))
                continue
            frames = next(iter(shapes))[0]
            # a compressed array is read from its start, so once by one task
            each = self.block if all(known[n][1] for n in used if n) else max(1, frames)
            out += [_Block(video, path, t, min(t + each, frames)) for t in range(0, frames, each)]
        return out

    def _fault(self, block: _Block, error: str) -> pa.RecordBatch:
        values = {"video_id": [block.video_id], "error": [error]}
        return pa.RecordBatch.from_arrays([pa.array(values.get(f.name, [None]), f.type) for f in self.schema], schema=self.schema)

    def read(self, block: _Block) -> Iterator[pa.RecordBatch]:
        if block.error is not None:
            yield self._fault(block, block.error)
            return
        try:
            yield from self._frames(block)
        except Exception as e:  # whatever is wrong with an archive is a fault of its video alone
            yield self._fault(block, f"{type(e).__name__}: {e}")

    def _frames(self, block: _Block) -> Iterator[pa.RecordBatch]:
        with _open(block.path) as found:
            known = {n.removesuffix(".npy") for n in found.namelist()}
            used = [_pick(c, known) for c in self.columns]
            opened = {}
            for name in {n for n in used if n}:
                member = found.open(f"{name}.npy")
                shape, _, kind = _header(member)
                size = int(np.prod(shape[1:])) * kind.itemsize
                member.seek(member.tell() + block.first * size)
                opened[name] = member, shape, kind, size
            for t in range(block.first, block.end):
                slabs = {}
                for name, (member, shape, kind, size) in opened.items():
                    data = member.read(size)
                    if len(data) < size:
                        raise EOFError(f"{name} ends before frame {t}")
                    slabs[name] = np.frombuffer(data, kind).reshape(shape[1:])
                h, w = next(iter(slabs.values())).shape[:2]
                y, x = (a.ravel() for a in np.indices((h, w), np.int32))
                columns = {"video_id": pa.DictionaryArray.from_arrays(np.zeros(h * w, np.int32), [block.video_id]).cast(pa.string()), "t": pa.array(np.full(h * w, t, np.int32)), "y": pa.array(y), "x": pa.array(x)}
                for c, name in zip(self.columns, used, strict=True):
                    if name:
                        columns[c.name] = pa.array(np.ascontiguousarray(slabs[name] if c.component is None else slabs[name][..., c.component]).ravel())
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(h * w, f.type) for f in self.schema], schema=self.schema)


def _read(spark: SparkSession, files: list[tuple[str, str]], columns: list[_Column], kinds: dict[str, str], block: int) -> DataFrame:
    arrow = {"float": pa.float32(), "boolean": pa.bool_()}
    fields = [("video_id", pa.string()), *((n, pa.int32()) for n in "tyx"), *((c.name, arrow[kinds.get(c.name, "float")]) for c in columns), ("error", pa.string())]
    columns_ddl = "video_id string, t int, y int, x int, " + ", ".join(f"{c.name} {kinds.get(c.name, 'float')}" for c in columns) + ", error string"
    names = spark.createDataFrame(files, "video_id string, path string").repartition(max(1, min(len(files), 1024)))
    wanted = [a for c in columns for a in c.arrays]
    # of the directories only what the columns may need reaches the driver: a row for each archive
    found = listed(names).select("video_id", "path", F.filter("arrays", lambda a: a["name"].isin(wanted)).alias("arrays"), "error").collect()
    archives = [(r.video_id, r.path, [a.asDict() for a in r.arrays or []], r.error) for r in found]

    class Arrays(DataSource):
        @classmethod
        def name(cls) -> str:
            return "numpy_archives"

        def schema(self) -> str:
            return columns_ddl

        def reader(self, schema: StructType) -> DataSourceReader:
            return _ArrayReader(archives, columns, block, pa.schema(fields))

    spark.dataSource.register(Arrays)
    return spark.read.format("numpy_archives").load()


def read_base_cells(spark: SparkSession, files: list[tuple[str, str]], gaps: tuple[int, ...] = (1,), block: int = BLOCK) -> DataFrame:
    """video_id, gap, t, y, x, u, v, m (null where it is not stored; see `stages.with_magnitude`), and for gap 1 p15 and keep, of first-stage
    archives; a row with `error` for each archive that has not the maps or cannot be read."""
    out = None
    for gap in gaps:
        columns = [_Column("u", (f"U{gap}",), 0), _Column("v", (f"U{gap}",), 1), _Column("m", (f"M{gap}",), needed=False)]
        columns += [_Column("p15", ("P15",) if gap == 1 else (), needed=False), _Column("keep", ("stage1_keep",) if gap == 1 else (), needed=False)]
        cells = _read(spark, files, columns, {"keep": "boolean"}, block)
        cells = cells.select("video_id", F.lit(gap).alias("gap"), *(c for c in cells.columns if c != "video_id"))
        out = cells if out is None else out.union(cells)
    return out


def read_fused(spark: SparkSession, files: list[tuple[str, str]], fusion: str = "rms", units: bool = True, block: int = BLOCK) -> DataFrame:
    """video_id, t, y, x and mu, the unit map of second-stage archives under any of its names, or with units=False the cells' m; a row
    with `error` as above."""
    name = "mu" if units else "m"
    return _read(spark, files, [_Column(name, tuple(dict.fromkeys(n.format(fusion) for n in FUSED[name])))], {}, block)


def read_numbers(files: DataFrame) -> DataFrame:
    """video_id and the single numbers of a run, of each (video_id, path); null where an archive has none. No map is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for video, path in zip(batch["video_id"], batch["path"], strict=True):
                with _open(path) as found:
                    known = {n.removesuffix(".npy") for n in found.namelist()}
                    rows.append((video, *(int(np.lib.format.read_array(found.open(f"{n}.npy"))) if n in known else None for n in NUMBERS)))
            yield pd.DataFrame(rows, columns=["video_id", *NUMBERS.values()]).astype({c: "Int32" for c in NUMBERS.values()})

    return files.select("video_id", "path").mapInPandas(run, "video_id string, " + ", ".join(f"{c} int" for c in NUMBERS.values()))


def write_arrays(cells: DataFrame, path: str, maps: dict[str, tuple[str, ...]], numbers: DataFrame | None = None, suffix: str = "maps", compressed: bool = True) -> list[dict[str, Any]]:
    """Writes (video_id, t, y, x, ...) rows, an archive `<video_id>/<video_id>_<suffix>.npz` for each video, and returns a note for each: video_id,
    file, frames, error. `maps` has the columns of each array (several make a vector), `numbers` a row of single numbers for each
    video. Cells without a row are 0. A video that fails leaves no file; its note says why."""
    values = list(dict.fromkeys(c for cs in maps.values() for c in cs))
    size = cells.groupBy("video_id").agg(*((F.max(c) + 1).alias(n) for c, n in (("t", "frames"), ("y", "h"), ("x", "w"))))
    extra = numbers.select("video_id", F.to_json(F.struct(*(c for c in numbers.columns if c != "video_id"))).alias("numbers")) if numbers is not None else size.select("video_id", F.lit("{}").alias("numbers"))
    frames = cells.groupBy("video_id", "t").agg(F.collect_list(F.struct("y", "x", *values)).alias("cells"))
    # one array after the other, as a zip is written
    rows = frames.join(size.join(extra, "video_id", "left"), "video_id").withColumn("array", F.explode(F.array(*(F.lit(n) for n in maps))))
    rows = rows.select("video_id", "array", "t", "frames", "h", "w", "numbers", "cells").repartition("video_id").sortWithinPartitions("video_id", "array", "t")

    def write(out: pa.NativeFile, rows: Iterator[dict[str, Any]]) -> int:
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if compressed else zipfile.ZIP_STORED) as archive:
            first = None
            for name, own in groupby(rows, key=lambda r: r["array"]):
                own = chain([first := next(own)], own)
                columns, at = maps[name], 0
                shape = (first["h"], first["w"], len(columns)) if len(columns) > 1 else (first["h"], first["w"])
                with archive.open(f"{name}.npy", "w", force_zip64=True) as member:
                    np.lib.format.write_array_header_1_0(member, {"descr": "<f4", "fortran_order": False, "shape": (first["frames"], *shape)})
                    for row in own:
                        slab = np.zeros(shape, np.float32)
                        y, x = (np.array([c[k] for c in row["cells"]]) for k in "yx")
                        if row["t"] < at or min(y.min(), x.min()) < 0:
                            raise IndexError(f"frame {row['t']} has cells outside of its grid")
                        for k, c in enumerate(columns):
                            slab[(y, x, k) if len(columns) > 1 else (y, x)] = np.array([v[c] if v[c] is not None else np.nan for v in row["cells"]], np.float32)
                        member.write(bytes(4 * slab.size * (row["t"] - at)))
                        member.write(slab.tobytes())
                        at = row["t"] + 1
            for name, value in json.loads(first["numbers"] or "{}").items():
                with archive.open(f"{name}.npy", "w") as member:
                    np.lib.format.write_array(member, np.asarray(value, np.int32 if isinstance(value, int) else np.float32))
            return first["frames"]

    def task(batches: Iterator[pa.RecordBatch], files: TaskFiles) -> Iterator[dict[str, Any]]:
        every = (row for batch in batches for start in range(0, batch.num_rows, 16) for row in batch.slice(start, 16).to_pylist())
        for video, own in groupby(every, key=lambda r: r["video_id"]):
            yield one_file(files, video, f"{quote(video, safe='')}/{quote(video, safe='')}_{suffix}.npz", own, write)

    return save(rows, path, task)["notes"]


def one_file(files: TaskFiles, video: str, name: str, rows: Iterator, write) -> dict[str, Any]:
    """The note about a video's file, which `write(file, rows)` writes and tells the frames of; a failing one is removed."""
    try:
        with files.create(name) as out:
            frames = write(out, rows)
        return {"video_id": video, "file": name, "frames": frames, "error": None}
    except Exception as e:  # whatever a writer raises is a fault of this video alone
        files.remove(name)
        for _ in rows:
            pass
        return {"video_id": video, "file": None, "frames": 0, "error": f"{type(e).__name__}: {e}"}
