"""Findings as JSON, Markdown and plain text.

Order, caps and escaping are done by DataFrame expressions; only rows that are
shown come to the driver.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripple.functions import evidence as E
from ripple.functions import text as T
from ripple.operators import coverage as V
from ripple.operators import rules as R

SCHEMA_VERSION = 1
SHOWN, SHOWN_IMPACT, SHOWN_GAPS = 50, 8, 20
LABELS = {"breaking": "BREAKS", "possibly_breaking": "MAY BREAK", "safe": "safe", "info": "note"}
ACTIONS = {"R001": "was removed", "R002": "was removed", "R003": "was added", "R900": "could not be compared"}


def _map(values: dict[str, str], column: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[column]


def findings_json(found: DataFrame) -> DataFrame:
    """One row a finding: its JSON with sorted keys, and the columns it is ordered by."""
    impact = F.struct(*[F.coalesce(F.col(f"impact.{c}"), F.array().cast("array<string>")).alias(c) for c in ("columns", "exposures", "models", "query_breaks", "tests")])
    payload = F.to_json(
        F.struct(F.col("column"), E.confidence_name(F.col("confidence")).alias("confidence"), F.col("detail"), impact.alias("impact"), F.col("node_id"), F.col("node_name"), F.col("rule"), F.col("severity"), F.col("summary")),
        {"ignoreNullFields": "false"},
    )
    return found.select("severity", "confidence", "rule", "node_name", "column", payload.alias("json"))


def _shown(items: Column, code: Column | None = None) -> Column:
    """At most SHOWN_IMPACT items as code spans, and how many more there are."""
    spans = F.transform(F.slice(items, 1, SHOWN_IMPACT), T.markdown_code) if code is None else code
    more = F.size(items) - SHOWN_IMPACT
    return F.concat(F.array_join(spans, ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))


def markdown_rows(found: DataFrame) -> DataFrame:
    """One row a finding: its block for grave ones, its table row for others; everything from the project escaped."""
    subject = F.when(F.col("column").isNotNull(), F.concat(F.lit("column "), T.markdown_code(F.concat("node_name", F.lit("."), "column")))).otherwise(F.concat(F.lit("model "), T.markdown_code(F.col("node_name"))))
    label, action = _map(LABELS, F.col("severity")), _map(ACTIONS, F.col("rule"))
    none = F.array().cast("array<string>")
    part = {c: F.coalesce(F.col(f"impact.{c}"), none) for c in ("columns", "query_breaks", "tests", "exposures")}
    lines = [
        F.concat(F.lit("- **"), label, F.lit("** "), subject, F.lit(" "), action, F.lit(" ("), "rule", F.lit(", "), E.confidence_name(F.col("confidence")), F.lit(")")),
        F.when(F.col("detail") != "", F.concat(F.lit("  - why: "), T.markdown_escape(F.col("detail")))),
        F.when(F.size(part["columns"]) > 0, F.concat(F.lit("  - columns: "), _shown(part["columns"], F.transform(F.slice(part["columns"], 1, SHOWN_IMPACT), lambda x: T.markdown_code(T.short_ref(x)))))),
        F.when(F.size(part["query_breaks"]) > 0, F.concat(F.lit("  - queries that need it to run: "), _shown(part["query_breaks"]))),
        F.when(F.size(part["tests"]) > 0, F.concat(F.lit("  - tests: "), _shown(part["tests"]))),
        F.when(F.size(part["exposures"]) > 0, F.concat(F.lit("  - exposures: "), _shown(part["exposures"]))),
    ]
    block = F.concat_ws("\n", *lines)
    row = F.concat(F.lit("| "), "rule", F.lit(" | "), label, F.lit(" | "), subject, F.lit(" "), action, F.lit(" | "), T.markdown_escape(F.col("detail")), F.lit(" |"))
    return found.select("severity", "confidence", "rule", "node_name", "column", F.when(F.col("severity").isin("breaking", "possibly_breaking"), block).otherwise(row).alias("markdown"))


def _plural(n: int, one: str) -> str:
    return f"{n} {one}" + ("s" if n != 1 else "")


def _fold(summary: str, body: str) -> str:
    return f"<details>\n<summary>{summary}</summary>\n\n{body}\n\n</details>"


class Report:
    """One comparison: findings and the head's coverage."""

    def __init__(self, found: DataFrame, head: Any) -> None:
        self.found = found.cache()
        self.coverage = V.coverage(head.snapshot.nodes, head.states).first().asDict()
        self.reasons = {r["reason"]: r["models"] for r in V.reasons(head.snapshot.nodes, head.states).orderBy("reason").collect()}
        self.gaps = [(r["name"], r["why"]) for r in V.unanalysable(head.snapshot.nodes, head.states).orderBy("name", "why").toLocalIterator()]
        self.macro_stats = head.macro_stats
        self.counts = {r["severity"]: r["count"] for r in found.groupBy("severity").count().collect()}

    def headline(self) -> str:
        c = self.coverage
        return f"analysed {c['exact'] + c['partial']}/{c['total_models']} models ({c['analysed_pct']}%): {c['exact']} exact, {c['partial']} partial, {c['unknown']} not analysed"

    def failed(self, fail_on: str) -> bool:
        return R.failing(self.found, fail_on).limit(1).count() > 0

    def json(self, fail_on: str) -> str:
        rows = [json.loads(r["json"]) for r in R.ordered(findings_json(self.found)).toLocalIterator()]
        coverage = self.coverage | {"reasons": self.reasons, "macros": self.macro_stats, "unanalysable": [list(x) for x in self.gaps]}
        return json.dumps({"schema_version": SCHEMA_VERSION, "fail_on": fail_on, "failed": self.failed(fail_on), "findings": rows, "coverage": coverage}, indent=2, sort_keys=True, ensure_ascii=False)

    def text(self) -> str:
        out = []
        for r in R.ordered(self.found).toLocalIterator():
            out.append(f"{r['severity'].upper().replace('_', ' ')}  {r['summary']}  [{r['rule']}, {E.CONFIDENCES[r['confidence']]}]" + (f"\n    {r['detail']}" if r["detail"] else ""))
        if not out:
            out.append("no changes to column contracts")
        out.append(self.headline())
        if not self.coverage["is_complete"]:
            out.append("not all models were analysed in full: there may be impact that is not listed")
        return "\n".join(out) + "\n"

    def markdown(self, title: str = "Column contracts") -> str:
        """The counts first, then what needs a decision, then all else and the coverage, folded."""
        n = {k: self.counts.get(k, 0) for k in E.SEVERITIES}
        said = ", ".join(f"{n[k]} {LABELS[k].lower()}" for k in reversed(E.SEVERITIES) if n[k]) or "no change"
        lines = [f"# {escaped(title)}: {said}", ""]
        if not self.coverage["is_complete"]:
            lines += ["_Not all models were analysed in full: there may be impact that is not listed._", ""]
        rows = markdown_rows(self.found)
        for severity in ("breaking", "possibly_breaking"):
            lines += [r["markdown"] for r in R.ordered(rows.where(F.col("severity") == severity)).limit(SHOWN).collect()]
            if n[severity] > SHOWN:
                lines.append(f"- … and {n[severity] - SHOWN} more of **{LABELS[severity]}**")
        other = n["safe"] + n["info"]
        if other:
            table = ["| rule | verdict | change | why |", "|---|---|---|---|"]
            table += [r["markdown"] for r in R.ordered(rows.where(F.col("severity").isin("safe", "info"))).limit(SHOWN).collect()]
            if other > SHOWN:
                table.append(f"| | | … and {other - SHOWN} more | |")
            lines += ["", _fold(f"{_plural(other, 'other finding')}", "\n".join(table))]
        return "\n".join([*lines, "", self._coverage()]).rstrip() + "\n"

    def _coverage(self) -> str:
        body = [f"- {escaped(E.REASONS.get(k, k))} ({escaped(k)}): {_plural(v, 'model')}" for k, v in self.reasons.items()]
        if self.coverage["catalog_would_help"]:
            body += ["", f"With the columns of the warehouse known, {self.coverage['catalog_would_help']} of these would be resolved."]
        if self.gaps:
            body += ["", "Nothing is known of:", ""] + [f"- {coded(a)}: {escaped(b)}" for a, b in self.gaps[:SHOWN_GAPS]]
            if len(self.gaps) > SHOWN_GAPS:
                body.append(f"- … and {len(self.gaps) - SHOWN_GAPS} more")
        return _fold(self.headline(), "\n".join(body) or "Every model is resolved.")


def escaped(text: str) -> str:
    """``markdown_escape`` for text that is already on the driver."""
    import re

    out = re.sub(r"([\\`*_{}\[\]()#+\-.!|~])", r"\\\1", text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")).replace("@", "&#64;")
    return out[: T.CELL_CHARS] + "…" if len(out) > T.CELL_CHARS else out


def coded(text: str) -> str:
    """``markdown_code`` for text that is already on the driver."""
    inner = text.replace("`", "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("@", "&#64;")
    return f"`{inner[: T.CELL_CHARS]}`" if text else ""
