"""Snapshots that arrive as files, as a stream of changes to contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripple.sources import manifest as M


def nodes(spark: SparkSession, folder: str, side: str = "head", files_at_once: int = 16) -> DataFrame:
    """A streaming DataFrame of the nodes of every manifest that lands in a folder, with its file and time."""
    texts = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_at_once).text(folder)
    raw = texts.select("value", F.input_file_name().alias("file"), F.current_timestamp().alias("arrived"), F.from_json("value", M.MANIFEST).alias("m"))
    rows = raw.select("file", "arrived", F.explode("m.nodes").alias("unique_id", "json")).where(M.is_object(F.col("json")))
    e = F.from_json("json", M.ENTRY)
    return rows.select(F.lit(side).alias("side"), "file", "arrived", "unique_id", e.alias("e")).select("side", "file", "arrived", "unique_id", "e.name", "e.resource_type", M._depends(F.col("e.depends_on")).alias("depends_on"))


def latest_counts(stream: DataFrame, within: str = "1 hour") -> DataFrame:
    """Nodes by type and window of arrival; state older than the watermark is dropped."""
    return stream.withWatermark("arrived", within).groupBy(F.window("arrived", within), "resource_type").agg(F.count("*").alias("nodes"))
