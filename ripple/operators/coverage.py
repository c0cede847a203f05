"""How much of a project could be analysed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripple.functions import evidence as E
from ripple.operators.contracts import models_only


def _model_states(nodes: DataFrame, states: DataFrame) -> DataFrame:
    have = states.select(F.col("node_id").alias("unique_id"), "resolution", "reason")
    return models_only(nodes).select("unique_id", "name").join(have, "unique_id", "left").withColumn("resolution", F.coalesce("resolution", F.lit("unknown"))).fillna("", ["reason"])


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole to one decimal, halves to even; 0 for an empty whole."""
    return F.when(whole > 0, F.bround(100.0 * part / F.nullif(whole, F.lit(0)), 1)).otherwise(F.lit(0.0))


def coverage(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """One row: models by resolution, percentage analysed, whether all are exact, and how many gaps a catalog would close."""
    s = _model_states(nodes, states)
    counts = s.agg(F.count("*").alias("total_models"), *[F.count_if(F.col("resolution") == x).alias(x) for x in ("exact", "partial", "unknown")], F.count_if(F.col("reason").isin(*E.BY_CATALOG)).alias("catalog_would_help"))
    return counts.select(
        "*", percent(F.col("exact") + F.col("partial"), F.col("total_models")).alias("analysed_pct"), ((F.col("partial") == 0) & (F.col("unknown") == 0)).alias("is_complete")
    )


def reasons(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """(reason, models), without models that have none."""
    return _model_states(nodes, states).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("models"))


def unanalysable(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """(name, why) of models nothing is known of."""
    return _model_states(nodes, states).where("resolution = 'unknown' and reason <> ''").select("name", E.explain(F.col("reason")).alias("why"))


def headline() -> Column:
    """A sentence over a row of ``coverage``."""
    return F.concat(
        F.lit("analysed "), (F.col("exact") + F.col("partial")).cast("string"), F.lit("/"), F.col("total_models").cast("string"), F.lit(" models ("), F.format_number("analysed_pct", 1),
        F.lit("%): "), F.col("exact").cast("string"), F.lit(" exact, "), F.col("partial").cast("string"), F.lit(" partial, "), F.col("unknown").cast("string"), F.lit(" not analysed"),
    )


def edge_stats(edges: DataFrame) -> DataFrame:
    """(confidence, edges) by name of confidence."""
    return edges.groupBy(E.confidence_name(F.col("confidence")).alias("confidence")).agg(F.count("*").alias("edges"))


def macro_stats(macros: DataFrame) -> DataFrame:
    """One row: macros in all, those that are plain, those that are not."""
    return macros.agg(F.count("*").alias("total"), F.count_if("is_plain").alias("plain"), F.count_if(~F.col("is_plain")).alias("skipped_non_macro"))


def summarise(results: DataFrame, project: str, kind: str, good: Column) -> DataFrame:
    """(kind, models, weighted_pct, mean_pct): the share of good rows over all models, and the mean of the projects' shares."""
    per = results.groupBy(kind, project).agg(F.count("*").alias("n"), F.count_if(good).alias("good"))
    return per.groupBy(kind).agg(F.sum("n").alias("models"), (100 * F.sum("good") / F.sum("n")).alias("weighted_pct"), F.avg(100 * F.col("good") / F.col("n")).alias("mean_pct"))


def top_reasons(results: DataFrame, reason: str, k: int = 25) -> DataFrame:
    """(reason, models): the most frequent reasons that are not empty, ties by name."""
    return results.where(F.coalesce(F.col(reason), F.lit("")) != "").groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("models")).orderBy(F.desc("models"), "reason").limit(k)


def edges_by_kind(edges: DataFrame) -> DataFrame:
    """(kind, confidence, edges)."""
    return edges.groupBy("kind", E.confidence_name(F.col("confidence")).alias("confidence")).agg(F.count("*").alias("edges"))


def unearned(edges: DataFrame, states: DataFrame, recovered: DataFrame) -> DataFrame:
    """Edges said to be confirmed whose model is not exact or whose SQL was only rendered; there must be none."""
    have = states.select("side", F.col("node_id").alias("down_node"), "resolution").join(recovered.select("side", F.col("node_id").alias("down_node"), "sql_source"), ["side", "down_node"])
    earned = (F.col("resolution") == "exact") & F.col("sql_source").isin("manifest_compiled", "disk_compiled")
    return edges.where(F.col("confidence") == E.CONFIRMED).join(have, ["side", "down_node"]).where(~earned)
