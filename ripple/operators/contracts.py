"""Joins over nodes and contracts: dependencies, differences, mentions, drift.

All of them are equi-joins or set operations on DataFrames with the schemas of
``ripple.plans.analysis``; null keys match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def models_only(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("resource_type") == "model")


def dependency_edges(nodes: DataFrame, others: tuple[str, ...] = ()) -> DataFrame:
    """(side, child, parent) for dependencies on nodes that exist."""
    pairs = nodes.select("side", F.col("unique_id").alias("child"), F.explode("depends_on").alias("parent"))
    known = nodes.select(F.col("side").alias("s"), F.col("unique_id").alias("id"))
    return pairs.join(known, (F.col("side") == F.col("s")) & (F.col("parent") == F.col("id")), "left_semi").distinct()


def parent_contracts(nodes: DataFrame, contracts: DataFrame) -> DataFrame:
    """(side, child, parent, relation_key, columns): the columns a node's parents offer it."""
    edges = dependency_edges(nodes)
    offered = contracts.groupBy("side", "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column"))), lambda x: x["column"]).alias("columns"))
    keyed = nodes.select("side", F.col("unique_id").alias("parent"), "relation_key").join(offered.withColumnRenamed("node_id", "parent"), ["side", "parent"], "left")
    return edges.join(keyed, ["side", "parent"]).select("side", "child", "parent", "relation_key", F.coalesce("columns", F.array().cast("array<string>")).alias("columns"))


def models_removed(base: DataFrame, head: DataFrame) -> DataFrame:
    return models_only(base).join(models_only(head).select("unique_id"), "unique_id", "left_anti").select("unique_id", "name")


def models_added(base: DataFrame, head: DataFrame) -> DataFrame:
    return models_removed(head, base)


def models_common(base_nodes: DataFrame, head_nodes: DataFrame, base_states: DataFrame, head_states: DataFrame) -> DataFrame:
    """(node_id, name, base_resolution, head_resolution) of models on both sides."""
    both = models_only(head_nodes).select(F.col("unique_id").alias("node_id"), "name").join(models_only(base_nodes).select(F.col("unique_id").alias("node_id")), "node_id")
    b = base_states.select("node_id", F.col("resolution").alias("base_resolution"))
    h = head_states.select("node_id", F.col("resolution").alias("head_resolution"))
    return both.join(b, "node_id").join(h, "node_id")


def comparable() -> Column:
    return (F.col("base_resolution") == "exact") & (F.col("head_resolution") == "exact")


def incomparable(common: DataFrame) -> DataFrame:
    """(node_id, name, detail) of models that are not exact on both sides; the base's reason goes first."""
    why = F.when(F.col("base_resolution") != "exact", F.concat(F.lit("the base contract is "), "base_resolution")).otherwise(F.concat(F.lit("the head contract is "), "head_resolution"))
    return common.where(~comparable()).select("node_id", "name", why.alias("detail"))


def columns_removed(common: DataFrame, base_contracts: DataFrame, head_contracts: DataFrame) -> DataFrame:
    """(node_id, name, column) in the base's contract and not in the head's, of comparable models; letter case does not matter."""
    pairs = common.where(comparable()).select("node_id", "name").join(base_contracts.select("node_id", "ordinal", "column"), "node_id")
    there = head_contracts.select(F.col("node_id").alias("n"), F.lower("column").alias("c"))
    return pairs.join(there, (F.col("node_id") == F.col("n")) & (F.lower("column") == F.col("c")), "left_anti").select("node_id", "name", "column")


def columns_added(common: DataFrame, base_contracts: DataFrame, head_contracts: DataFrame) -> DataFrame:
    return columns_removed(common, head_contracts, base_contracts)


def dangling_refs(removed: DataFrame, head_nodes: DataFrame, exact: bool = False) -> DataFrame:
    """(removed, dependent): head nodes that still depend on a removed model.

    A dependency counts by the removed model's name as its last dotted part; with
    ``exact`` by its whole id.
    """
    wants = head_nodes.select(F.col("name").alias("dependent"), F.explode("depends_on").alias("dep"))
    if exact:
        return wants.join(removed, F.col("dep") == F.col("unique_id")).select(F.col("name").alias("removed"), "dependent").distinct()
    # A name may hold dots itself, so each dependency is tried with every one of its suffixes: an equi-join still.
    parts = F.split("dep", r"\.")
    suffixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    tails = wants.where(F.size(parts) > 1).select("dependent", F.explode(suffixes).alias("tail"))
    return tails.join(removed, F.col("tail") == F.col("name")).select(F.col("name").alias("removed"), "dependent").distinct()


def head_mentions(references: DataFrame, removed_columns: DataFrame) -> DataFrame:
    """(node_id, column, models): models of the head whose text still names a removed column."""
    hit = references.join(removed_columns.select("node_id", "column"), (F.col("up_node") == F.col("node_id")) & (F.lower("up_col") == F.lower("column")))
    return hit.groupBy("node_id", "column").agg(F.array_sort(F.collect_set("down_node")).alias("models"))


def edges_upstream_of(edges: DataFrame, node: str, column: str) -> DataFrame:
    return edges.where((F.col("down_node") == node) & (F.col("down_col") == column))


def edges_downstream_of(edges: DataFrame, node: str, column: str) -> DataFrame:
    return edges.where((F.col("up_node") == node) & (F.col("up_col") == column))


def dependents_of(edges: DataFrame, required: DataFrame, node: str, column: str) -> DataFrame:
    """(node): models that take the column or need it to run."""
    at = (F.col("up_node") == node) & (F.col("up_col") == column)
    return edges.where(at).select(F.col("down_node").alias("node")).union(required.where(at).select("down_node")).distinct()


def edge_dedupe(edges: DataFrame) -> DataFrame:
    """Of the edges between one pair of columns the surest, of equally sure ones the first kind."""
    pair = ["down_node", "down_col", "up_node", "up_col"]
    # An aggregate, and so combined before the shuffle: the least of (less confidence first, kind).
    best = F.min(F.struct((-F.col("confidence")).alias("c"), F.col("kind").alias("k")))
    return edges.groupBy(*pair).agg(best.alias("b")).select(*pair, F.col("b.k").alias("kind"), (-F.col("b.c")).cast("int").alias("confidence"))


def doc_drift(declared: DataFrame, inferred: DataFrame) -> DataFrame:
    """(node_id, undocumented, absent) of two tables (node_id, columns); nodes without declared columns have no drift."""
    both = inferred.select("node_id", F.col("columns").alias("i")).join(declared.select("node_id", F.col("columns").alias("d")), "node_id", "left")
    d = F.coalesce("d", F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return both.select(
        "node_id",
        F.when(F.size(d) > 0, F.array_except("i", d)).otherwise(none).alias("undocumented"),
        F.when(F.size(d) > 0, F.array_except(d, F.col("i"))).otherwise(none).alias("absent"),
    )
