"""Detection results in JSON, one row per detection or per image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "images array<struct<shape array<int>, speed struct<preprocess double, inference double, postprocess double>, "
    "results array<struct<name string, confidence double, box struct<x1 double, y1 double, x2 double, y2 double>>>>>, metadata struct<functionTimeCall double, version string>"
)


def parsed(df: DataFrame, json: str) -> DataFrame:
    return df.withColumn("detected", F.from_json(json, SCHEMA))


def _image() -> Column:
    return F.get(F.col("detected.images"), F.lit(0))


def detections(df: DataFrame, ids: list[str], json: str) -> DataFrame:
    """ids, no, name, confidence (percent), box corners; one row with nulls where nothing was detected."""
    rows = parsed(df, json).select(*ids, F.posexplode_outer(_image()["results"]).alias("no", "r"))
    return rows.select(*ids, "no", F.when(F.col("r").isNotNull(), F.coalesce("r.name", F.lit("Unknown"))).alias("name"), (F.coalesce("r.confidence", F.lit(0.0)) * 100).alias("confidence"), *[F.col(f"r.box.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


def latencies(df: DataFrame, ids: list[str], json: str) -> DataFrame:
    """ids, n_detections, parts and sum of the time in ms, and what the call took beyond it (never below 0); missing is 0."""
    speed = _image()["speed"]
    part = {c: F.coalesce(speed[c], F.lit(0.0)) for c in ("preprocess", "inference", "postprocess")}
    total = part["preprocess"] + part["inference"] + part["postprocess"]
    call = F.coalesce(F.col("detected.metadata.functionTimeCall"), F.lit(0.0)) * 1000
    return parsed(df, json).select(*ids, F.greatest(F.lit(0), F.coalesce(F.size(_image()["results"]), F.lit(0))).alias("n_detections"), *[v.alias(k) for k, v in part.items()], total.alias("total"), F.greatest(F.lit(0.0), call - total).alias("network"))
