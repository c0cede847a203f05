"""Scalar functions over text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_PREFIX = "rk"
CELL_CHARS = 120


def _slug(part: Column) -> Column:
    return F.regexp_replace(part, "[^0-9a-zA-Z_]", "_")


def relation_key(*parts: Column) -> Column:
    """A surrogate relation name: the parts that are not empty, each of letters, digits and underscores, joined."""
    full = F.filter(F.array(*[F.coalesce(_slug(p), F.lit("")) for p in parts]), lambda x: x != "")
    return F.concat(F.lit(f"{KEY_PREFIX}_"), F.array_join(full, "_"))


def neutral_html(text: Column) -> Column:
    """``&``, ``<`` and ``>`` as entities."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def markdown_escape(text: Column) -> Column:
    """Text that is inert in Markdown, cut after 120 characters with an ellipsis; null as empty."""
    marked = F.regexp_replace(neutral_html(F.coalesce(text, F.lit(""))), r"([\\`*_{}\[\]()#+\-.!|~])", r"\\$1")
    marked = F.replace(marked, F.lit("@"), F.lit("&#64;"))
    return F.when(F.char_length(marked) > CELL_CHARS, F.concat(F.substring(marked, 1, CELL_CHARS), F.lit("…"))).otherwise(marked)


def markdown_code(text: Column) -> Column:
    """Text as an inert code span of at most 120 characters; null and empty as empty."""
    text = F.coalesce(text, F.lit(""))
    inner = F.replace(neutral_html(F.replace(text, F.lit("`"), F.lit(""))), F.lit("@"), F.lit("&#64;"))
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit("`"), F.substring(inner, 1, CELL_CHARS), F.lit("`")))


def short_ref(text: Column) -> Column:
    """The last two of more than two dotted parts."""
    parts = F.split(text, r"\.")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(text)


def column_of(text: Column) -> Column:
    """The last dotted part, without double quotes at its ends."""
    return F.regexp_replace(F.element_at(F.split(text, r"\."), -1), '^"+|"+$', "")


def schema_version(url: Column) -> Column:
    """N of ``/manifest/vN.json``; null where there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"/manifest/v(\d+)\.json", 1)
    return F.when(found != "", found.cast("int"))


def plain_macro(text: Column) -> Column:
    """Whether a macro's text begins with a macro tag, after white space of any kind."""
    return F.coalesce(text.rlike(r"^[\s\x1C-\x1F\x85\p{Z}]*\{%[-+]?\s*macro\b"), F.lit(False))
