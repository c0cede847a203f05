"""What a removed column reaches: columns, queries, models, tests and exposures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripple.functions.evidence import UNKNOWN
from ripple.operators.graph import reach
from ripple.sources.shared import written


def _ref(node: str, column: str):
    return F.struct(F.col(node).alias("node"), F.col(column).alias("col"))


def uses_only_star(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node_id, column, star_only): whether all takers of a column reach it through a star; false without takers."""
    hit = seeds.select("node_id", "column").join(edges, (F.col("up_node") == F.col("node_id")) & (F.col("up_col") == F.lower("column")), "left")
    return hit.groupBy("node_id", "column").agg(F.coalesce(F.bool_and(F.col("kind") == "star_expanded"), F.lit(False)).alias("star_only"))


def affected_exposures(exposures: DataFrame, affected: DataFrame) -> DataFrame:
    """(seed, name) of exposures that depend on a node affected by the seed; ``affected`` has (seed, node)."""
    pairs = exposures.select("name", F.explode("depends_on").alias("node"))
    return pairs.join(affected, "node").select("seed", "name").distinct()


def affected_tests(tests: DataFrame, affected: DataFrame) -> DataFrame:
    """(seed, name) of tests that break.

    A test must depend on, or be attached to, a node affected by the seed; a test
    of one column must, besides, name the seed's column on the seed's own node.
    """
    targets = F.array_distinct(F.concat("depends_on", F.when(F.col("attached_node").isNotNull(), F.array("attached_node")).otherwise(F.array().cast("array<string>"))))
    pairs = tests.select("name", "column_name", targets.alias("targets")).select("name", "column_name", "targets", F.explode("targets").alias("node"))
    hit = pairs.join(affected, "node")
    own = F.col("column_name").isNull() | ((F.lower("column_name") == F.col("seed.col")) & F.array_contains("targets", F.col("seed.node")))
    return hit.where(own).select("seed", "name").distinct()


def blast_radius(seeds: DataFrame, edges: DataFrame, required: DataFrame, tests: DataFrame, exposures: DataFrame) -> DataFrame:
    """What depends on each seed column, over the base's graph.

    ``seeds`` has (node_id, column).  A query that only needs a column (to filter,
    join or group) breaks without passing anything on.  Confidence is the least of
    all edges and needs met on the way, unknown where nothing is met.  All seeds
    are followed at once.
    """
    # Contracts may be written in any case; lineage is in lower case.
    starts = seeds.select(F.struct(F.col("node_id").alias("node"), F.lower("column").alias("col")).alias("seed"), "node_id", "column").distinct()
    links = edges.select(_ref("up_node", "up_col").alias("a"), _ref("down_node", "down_col").alias("b"), "confidence")
    needs = required.select(_ref("up_node", "up_col").alias("a"), F.col("down_node").alias("breaks"), "confidence")
    starts = written(starts, "seeds")  # both are read many times below
    reached = written(reach(links.select("a", "b"), starts.select("seed"), keep_seeds=True), "reached")
    met = reached.select("seed", F.col("node").alias("a")).union(starts.select("seed", "seed")).distinct()

    columns = reached.groupBy("seed").agg(F.array_sort(F.collect_set(F.concat("node.node", F.lit("."), "node.col"))).alias("columns"), F.collect_set("node.node").alias("column_models"))
    broken = met.join(needs, "a")
    breaks = broken.groupBy("seed").agg(F.array_sort(F.collect_set("breaks")).alias("query_breaks"))
    trust = met.join(links.select("a", "confidence"), "a").select("seed", "confidence").union(broken.select("seed", "confidence"))
    trust = trust.groupBy("seed").agg(F.min("confidence").alias("confidence"))
    affected = reached.select("seed", F.col("node.node").alias("node")).union(broken.select("seed", "breaks")).union(starts.select("seed", "node_id")).distinct()
    hit_tests = affected_tests(tests, affected).groupBy("seed").agg(F.array_sort(F.collect_set("name")).alias("tests"))
    hit_exposures = affected_exposures(exposures, affected).groupBy("seed").agg(F.array_sort(F.collect_set("name")).alias("exposures"))
    out = starts
    for part in (columns, breaks, trust, hit_tests, hit_exposures):
        out = out.join(part, "seed", "left")
    none = F.array().cast("array<string>")
    full = {c: F.coalesce(c, none) for c in ("columns", "query_breaks", "tests", "exposures", "column_models")}
    return out.select(
        "node_id",
        "column",
        full["columns"].alias("columns"),
        F.array_sort(F.array_union(full["column_models"], full["query_breaks"])).alias("models"),
        full["tests"].alias("tests"),
        full["exposures"].alias("exposures"),
        full["query_breaks"].alias("query_breaks"),
        F.coalesce("confidence", F.lit(UNKNOWN)).alias("confidence"),
    )


def impact_total():
    """How many things an impact names: columns, breaking queries, tests, exposures."""
    return F.size("columns") + F.size("query_breaks") + F.size("tests") + F.size("exposures")


def impact_summary():
    """The counts that are not zero, in words."""
    parts = []
    for column, one, many in (("columns", "downstream column", "downstream columns"), ("query_breaks", "query", "queries"), ("tests", "test", "tests"), ("exposures", "exposure", "exposures")):
        n = F.size(column)
        parts.append(F.when(n == 1, F.lit(f"1 {one}")).when(n > 1, F.concat(n.cast("string"), F.lit(f" {many}"))))
    said = F.concat_ws(", ", *parts)
    return F.when(said == "", F.lit("nothing")).otherwise(said)
