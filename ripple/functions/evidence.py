"""Confidence, resolution and severity as ordered codes, and what combines them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN, LIKELY, CONFIRMED = 0, 1, 2
CONFIDENCES = ("unknown", "likely", "confirmed")
RESOLUTIONS = ("unknown", "partial", "exact")
SEVERITIES = ("info", "safe", "possibly_breaking", "breaking")

REASONS = {
    "": "",
    "no_sql": "there is no SQL in it",
    "python_model": "it is written in Python",
    "unparseable_jinja": "its template does not render without a connection",
    "needs_warehouse": "its template asks the warehouse",
    "sql_parse_error": "the SQL does not parse",
    "qualify_error": "some of its columns cannot be resolved",
    "surviving_star": "a star stands for columns that are not known",
    "upstream_unknown": "columns of a parent are not known",
    "no_output_columns": "no output column could be found",
}
#: Reasons that a catalog of the warehouse's columns would remove.
BY_CATALOG = ("surviving_star", "upstream_unknown")


def _code(names: tuple[str, ...], column: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(names):
        out = F.when(column == name, F.lit(i)).otherwise(out)
    return out


def _name(names: tuple[str, ...], column: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), column.cast("int") + 1)


def resolution_rank(column: Column) -> Column:
    return _code(RESOLUTIONS, column)


def severity_rank(column: Column) -> Column:
    return _code(SEVERITIES, column)


def confidence_name(column: Column) -> Column:
    return _name(CONFIDENCES, column)


def weakest_confidence(column: Column) -> Column:
    """Aggregate: the least of the codes; UNKNOWN for none."""
    return F.coalesce(F.min(column), F.lit(UNKNOWN))


def weakest_resolution(column: Column) -> Column:
    """Aggregate: the least resolved; unknown for none."""
    return F.coalesce(_name(RESOLUTIONS, F.min(resolution_rank(column))), F.lit("unknown"))


def worst_severity(column: Column) -> Column:
    """Aggregate: the gravest; null for none."""
    return F.max_by(column, severity_rank(column))


def confidence_for(resolution: Column, compiled: Column, heuristic: Column | None = None) -> Column:
    """What resolution, origin of the SQL and use of a guess leave of confidence."""
    caps = [F.coalesce(resolution_rank(resolution), F.lit(UNKNOWN)), F.when(compiled, CONFIRMED).otherwise(LIKELY)]
    if heuristic is not None:
        caps.append(F.when(heuristic, LIKELY).otherwise(CONFIRMED))
    return F.least(*caps).cast("int")


def explain(reason: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[reason], F.lit(""))
