"""Stored maps, tracks and run summaries."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import one_file
from .files import TaskFiles, file_system, save


def write_map(cells: DataFrame, path: str) -> None:
    """A folder for each video, so that a filter on video_id reads no others."""
    cells.write.mode("overwrite").partitionBy("video_id").parquet(path)


def write_stage_one(cells: DataFrame, frame_meta: DataFrame, run_meta: DataFrame, path: str) -> None:
    """Base cells with their diagnostics, what each map was made of, and the run's parameters, each by video."""
    for name, table in (("cells", cells), ("frame_meta", frame_meta), ("run_meta", run_meta)):
        write_map(table, f"{path}/{name}")


def write_stage_two(fused: DataFrame, units: DataFrame, gap_maps: DataFrame, frame_meta: DataFrame, run_meta: DataFrame, path: str) -> None:
    """Fused and unit maps, the map of each gap raw and normalised, frames and parameters, each by video."""
    for name, table in (("fused", fused), ("units", units), ("gap_maps", gap_maps), ("frame_meta", frame_meta), ("run_meta", run_meta)):
        write_map(table, f"{path}/{name}")


def with_aliases(fused: DataFrame, fusion: str) -> DataFrame:
    """Columns by the names that readers probe for; m_max is the fused map whatever the fusion is."""
    out = fused.withColumns({f"m_{fusion}": F.col("m")})
    return out.withColumn("m_max", F.col("m")) if fusion != "max" else out


def track_json(tracks: DataFrame) -> DataFrame:
    """video_id, json: a document for each video with its tubes."""
    tube = F.struct(*(c for c in tracks.columns if c != "video_id"))
    found = tracks.groupBy("video_id").agg(F.count("*").alias("num_tubes"), F.array_sort(F.collect_list(tube)).alias("tubes"))
    return found.select("video_id", F.to_json(F.struct("video_id", "num_tubes", "tubes")).alias("json"))


def write_track_files(tracks: DataFrame, path: str, suffix: str = "roi_tubes") -> list[dict[str, Any]]:
    """Writes the JSON document of each video to a file of its own and returns a note for each: video_id, file, frames (tubes), error."""
    rows = track_json(tracks).join(tracks.groupBy("video_id").agg(F.count("*").alias("n")), "video_id").select("video_id", "n", "json")

    def task(batches: Iterator[pa.RecordBatch], files: TaskFiles) -> Iterator[dict[str, Any]]:
        for batch in batches:
            for row in batch.to_pylist():
                name = quote(row["video_id"], safe="")
                yield one_file(files, row["video_id"], f"{name}/{name}_{suffix}.json", iter([row]), lambda out, rows: [(out.write(r["json"].encode()), r["n"])[1] for r in rows][0])

    return save(rows, path, task)["notes"]


def write_summary(spark: SparkSession, path: str, notes: list[dict[str, Any]], errors: DataFrame | None = None) -> dict[str, Any]:
    """Writes `summary.json` beside a job's files: which were written, and the error of each other video, of earlier `errors` (video_id,
    error) and of the writer's `notes`. A row for each video."""
    failed = {n["video_id"]: n["error"] for n in notes if n["error"]}
    if errors is not None:
        failed |= {r.video_id: r.error for r in errors.select("video_id", "error").collect()}
    done = sorted(({"video_id": n["video_id"], "file": n["file"]} for n in notes if n["video_id"] not in failed), key=lambda n: n["video_id"])
    out = {"num_ok": len(done), "num_failed": len(failed), "written": done, "failed": [{"video_id": v, "error": e} for v, e in sorted(failed.items())]}
    store, root = file_system(path)
    with store.open_output_stream(f"{root}/summary.json") as stream:
        stream.write(json.dumps(out).encode())
    return out


def run_summary(results: DataFrame) -> DataFrame:
    """num_ok, num_failed, num_suppressed over (video_id, error, num_suppressed) rows."""
    return results.agg(F.count_if(F.col("error").isNull()).alias("num_ok"), F.count_if(F.col("error").isNotNull()).alias("num_failed"), F.coalesce(F.sum("num_suppressed"), F.lit(0)).alias("num_suppressed"))


def figure_summary(results: DataFrame) -> DataFrame:
    """num_ok, num_failed and the sorted figures of the videos that went well, over (video_id, error, figure) rows."""
    return results.agg(F.count_if(F.col("error").isNull()).alias("num_ok"), F.count_if(F.col("error").isNotNull()).alias("num_failed"), F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.col("figure")))).alias("images"))
