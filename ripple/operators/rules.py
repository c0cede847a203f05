"""Findings: what changed, how grave it is, how sure that is.

R001 a column was removed, R002 a model was removed, R003 a column was added, R900 a
model could not be compared.  Each rule is joins and one chain of conditions; the
first that holds decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ripple.functions import evidence as E
from ripple.operators import contracts as C
from ripple.operators import coverage as V
from ripple.operators import impact as I
from ripple.sources.shared import written

IMPACT = "struct<columns:array<string>,models:array<string>,tests:array<string>,exposures:array<string>,query_breaks:array<string>>"
FINDING = ("rule", "severity", "confidence", "node_name", "node_id", "column", "summary", "detail", "impact")
MAX_DEPENDENTS, MAX_NAMES = 10, 8


@dataclass(frozen=True)
class Sides:
    """What the rules need of both sides."""

    base: object
    head: object

    @property
    def common(self) -> DataFrame:
        return C.models_common(self.base.snapshot.nodes, self.head.snapshot.nodes, self.base.states, self.head.states)


def _finding(df: DataFrame, **columns: Column | str) -> DataFrame:
    none = {"node_id": F.lit(None).cast("string"), "column": F.lit(None).cast("string"), "detail": F.lit(""), "impact": F.lit(None).cast(IMPACT)}
    full = none | {k: F.lit(v) if isinstance(v, (str, int)) else v for k, v in columns.items()}
    return df.select(*[full[k].alias(k) for k in FINDING])


def removed_columns(removed: DataFrame, radius: DataFrame, mentions: DataFrame, stars: DataFrame, complete: Row) -> DataFrame:
    """R001 over (node_id, name, column), their radius, what still names them, and star use; ``complete`` is the head's coverage row."""
    on = ["node_id", "column"]
    x = removed.join(radius, on, "left").join(mentions.withColumnRenamed("models", "named_in"), on, "left").join(stars, on, "left")
    x = x.withColumn("is_complete", F.lit(complete["is_complete"])).withColumn("analysed_pct", F.lit(float(complete["analysed_pct"])))
    none = F.array().cast("array<string>")
    x = x.withColumns({c: F.coalesce(c, none) for c in ("columns", "models", "tests", "exposures", "query_breaks", "named_in")})
    x = x.withColumn("confidence", F.coalesce("confidence", F.lit(E.UNKNOWN))).withColumn("star_only", F.coalesce("star_only", F.lit(False)))
    empty, named = I.impact_total() == 0, F.size("named_in") > 0
    severity = (
        F.when(empty & ~named & F.col("is_complete"), "safe").when(empty & ~named, "possibly_breaking").when(named, "breaking").when(F.col("star_only"), "possibly_breaking").otherwise("safe")
    )
    confidence = F.when(empty, E.LIKELY).when(named | F.col("star_only"), F.col("confidence")).otherwise(E.LIKELY)
    last = F.transform(F.slice("named_in", 1, MAX_NAMES), lambda m: F.element_at(F.split(m, r"\."), -1))
    detail = (
        F.when(empty & ~named & F.col("is_complete"), F.lit("nothing downstream refers to it"))
        .when(empty & ~named, F.concat(F.lit("no consumer was found among the "), F.format_number("analysed_pct", 1), F.lit("% of models that could be analysed; others may refer to it")))
        .when(named, F.concat(F.lit("still named by "), F.array_join(last, ", "), F.when(empty, F.lit("")).otherwise(F.concat(F.lit("; it breaks "), I.impact_summary()))))
        .when(F.col("star_only"), F.lit("consumers take it through a star only: they go on without it, with fewer columns"))
        .otherwise(F.lit("its consumers no longer refer to it"))
    )
    return _finding(
        x, rule="R001", severity=severity, confidence=confidence.cast("int"), node_name=F.col("name"), node_id=F.col("node_id"), column=F.col("column"),
        summary=F.concat(F.lit("column "), "name", F.lit("."), "column", F.lit(" was removed")), detail=detail, impact=F.struct("columns", "models", "tests", "exposures", "query_breaks"),
    )


def removed_models(removed: DataFrame, dangling: DataFrame, complete: Row) -> DataFrame:
    """R002 over (unique_id, name) and what in the head still refers to them."""
    wanted = dangling.groupBy(F.col("removed").alias("name")).agg(F.array_sort(F.collect_list("dependent")).alias("dependents"))
    x = removed.join(wanted, "name", "left").withColumn("is_complete", F.lit(complete["is_complete"]))
    some = F.col("dependents").isNotNull()
    severity = F.when(some, "breaking").when(F.col("is_complete"), "safe").otherwise("possibly_breaking")
    detail = (
        F.when(some, F.concat(F.lit("still referred to by "), F.array_join(F.slice("dependents", 1, MAX_DEPENDENTS), ", ")))
        .when(F.col("is_complete"), F.lit("nothing refers to it"))
        .otherwise(F.lit("nothing was found to refer to it, but not all models could be analysed"))
    )
    summary = F.concat(F.lit("model "), "name", F.lit(" was removed"))
    return _finding(x, rule="R002", severity=severity, confidence=F.when(some, E.CONFIRMED).otherwise(E.LIKELY).cast("int"), node_name=F.col("name"), summary=summary, detail=detail)


def added_columns(added: DataFrame) -> DataFrame:
    """R003 over (node_id, name, column)."""
    summary = F.concat(F.lit("column "), "name", F.lit("."), "column", F.lit(" was added"))
    return _finding(added, rule="R003", severity="safe", confidence=E.LIKELY, node_name=F.col("name"), node_id=F.col("node_id"), column=F.col("column"), summary=summary)


def not_comparable(rows: DataFrame) -> DataFrame:
    """R900 over (node_id, name, detail)."""
    return _finding(rows, rule="R900", severity="info", confidence=E.UNKNOWN, node_name=F.col("name"), summary=F.concat(F.col("name"), F.lit(" could not be compared")), detail=F.col("detail"))


def findings(base, head) -> DataFrame:
    """All findings of a change from base to head."""
    sides = Sides(base, head)
    common = sides.common
    complete = V.coverage(head.snapshot.nodes, head.states).first()  # one row
    removed = written(C.columns_removed(common, base.contracts_df, head.contracts_df), "removed")
    radius = I.blast_radius(removed, base.edges, base.required, base.snapshot.tests, base.snapshot.exposures)
    gone = C.models_removed(base.snapshot.nodes, head.snapshot.nodes)
    parts = [
        removed_columns(removed, radius, C.head_mentions(head.references, removed), I.uses_only_star(base.edges, removed), complete),
        removed_models(gone, C.dangling_refs(gone, head.snapshot.nodes), complete),
        added_columns(C.columns_added(common, base.contracts_df, head.contracts_df)),
        not_comparable(C.incomparable(common)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ordered(found: DataFrame) -> DataFrame:
    """Gravest first, then surest, then by rule, model and column."""
    return found.orderBy(F.desc(E.severity_rank(F.col("severity"))), F.desc("confidence"), "rule", "node_name", F.coalesce("column", F.lit("")))


def failing(found: DataFrame, fail_on: str) -> DataFrame:
    """Findings at or above a severity; none for ``never``."""
    if fail_on == "never":
        return found.where(F.lit(False))
    return found.where(E.severity_rank(F.col("severity")) >= E.SEVERITIES.index(fail_on.replace("-", "_")))


def top_k(found: DataFrame, k: int) -> DataFrame:
    return ordered(found).limit(k)
