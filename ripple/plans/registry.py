"""Registered queries of the model-project engine and their SQL counterparts.

Four kinds: models that are run over the tables; contracts of the real tables;
graphs whose edges come from the data; and the bundled project, whose expected
rows are written by hand from its SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripple.functions import evidence as E
from ripple.functions import text as T
from ripple.operators import contracts as C
from ripple.operators import coverage as V
from ripple.operators import graph as G
from ripple.operators import impact as I
from ripple.operators import rules as R
from ripple.plans import bundled, report
from ripple.plans.analysis import Analysis, both
from ripple.plans.catalyst import FrontEnd
from ripple.sources import manifest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_analysed: dict[str, tuple[str, Analysis, Analysis]] = {}


def sides(spark: SparkSession) -> tuple[Analysis, Analysis]:
    """Both sides of the bundled project, analysed once a session."""
    app = spark.sparkContext.applicationId
    if app not in _analysed:
        base, head = both(spark, *(manifest.from_text(spark, bundled.manifest(s), s) for s in ("base", "head")))
        _analysed.clear()
        _analysed[app] = (app, base, head)
    return _analysed[app][1:]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of the bundled change; its sources' contracts are those of the tables in ``sf_dir``."""
    for t, columns in bundled.SOURCES.items():
        have = _table(spark, sf_dir, t).columns
        if have != columns:
            raise ValueError(f"{t} has columns {have}")
    return R.ordered(R.findings(*sides(spark)))


def values(rows: Iterable[tuple], names: str) -> str:
    """Rows as SQL VALUES with column names; lists become lists."""

    def cell(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, (int, float)):
            return str(x)
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(cell, x)) + "]" + ("::VARCHAR[]" if not x else "")
        return "'" + str(x).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS t({names})"


# ------------------------------------------------------------ models that are run

for _name, (_template, _sql) in bundled.SHAPES.items():
    register(f"model_{_name}", _sql)(lambda spark, sf_dir, name=_name: bundled.run_shape(spark, sf_dir, name))


# ------------------------------------------------------------------ text functions

_SLUG = "regexp_replace({}, '[^0-9a-zA-Z_]', '_', 'g')"
_HTML = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@register("relation_key", f"SELECT doc_id, concat_ws('_', 'rk', 'source', {_SLUG.format('source')}, nullif({_SLUG.format('text')}, '')) AS relation_key FROM documents")
def relation_key(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.relation_key(F.lit("source"), F.col("source"), F.col("text")).alias("relation_key"))


@register("html_neutralise", f"SELECT page_id, {_HTML.format('html')} AS inert FROM pages")
def html_neutralise(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.neutral_html(F.col("html")).alias("inert"))


_ESCAPED = "replace(regexp_replace(" + _HTML.format("coalesce({}, '')") + r", '([\\`*_{{}}\[\]()#+\-.!|~])', '\\\1', 'g'), '@', '&#64;')"


@register("markdown_escape", "SELECT doc_id, CASE WHEN length(e) > 120 THEN left(e, 120) || '…' ELSE e END AS escaped FROM (SELECT doc_id, " + _ESCAPED.format("text") + " AS e FROM documents)")
def markdown_escape(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.markdown_escape(F.col("text")).alias("escaped"))


@register(
    "markdown_code",
    "SELECT conv_id, turn, CASE WHEN coalesce(text, '') = '' THEN '' ELSE '`' || left(replace(" + _HTML.format("replace(text, '`', '')") + ", '@', '&#64;'), 120) || '`' END AS code FROM conversations",
)
def markdown_code(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.markdown_code(F.col("text")).alias("code"))


@register("short_ref", "SELECT page_id, CASE WHEN len(p) > 2 THEN p[len(p) - 1] || '.' || p[len(p)] ELSE url END AS ref FROM (SELECT page_id, url, string_split(url, '.') AS p FROM pages)")
def short_ref(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.short_ref(F.col("url")).alias("ref"))


@register("column_of", "SELECT page_id, string_split(url, '.')[-1] AS col FROM pages")
def column_of(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.column_of(F.col("url")).alias("col"))


@register("schema_version_extract", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN -1 ELSE CAST(page_id % 40 AS INT) END AS version FROM pages")
def schema_version_extract(spark, sf_dir):
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://x/manifest/"), "url")).otherwise(F.concat(F.lit("https://x/manifest/v"), (F.col("page_id") % 40).cast("string"), F.lit(".json")))
    return _table(spark, sf_dir, "pages").select("page_id", F.coalesce(T.schema_version(url), F.lit(-1)).alias("version"))


_MACROS = [
    ("a", "{% macro a() %}x{% endmacro %}"), ("b", "  \n{%- macro b(x) -%}{% endmacro %}"), ("c", "{% test c(m) %}{% endtest %}"), ("d", "select 1"), ("e", "{% macrox %}"), ("f", None),
    ("g", "\n\n{% macro g() %}{% endmacro %}"), ("h", "\t\r\n {%-\nmacro h() %}{% endmacro %}"), ("i", "\u00a0\u2003{% macro i() %}{% endmacro %}"), ("j", "x {% macro j() %}{% endmacro %}"), ("k", "\x0b\x0c{%macro k() %}{% endmacro %}"), ("l", ""),
]


@register("plain_macro_filter", "SELECT name FROM " + values(_MACROS, "name, sql") + r" WHERE regexp_matches(sql, '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]*\{%[-+]?\s*macro\b')")
def plain_macro_filter(spark, sf_dir):
    return spark.createDataFrame(_MACROS, "name string, sql string").where(T.plain_macro(F.col("sql"))).select("name")


# -------------------------------------------------------------------- evidence

_EVIDENCE = [(r, c, h) for r in E.RESOLUTIONS for c in (True, False) for h in (True, False)]


@register(
    "confidence_for",
    "SELECT resolution, compiled, heuristic, least(CASE resolution WHEN 'exact' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END, CASE WHEN compiled THEN 2 ELSE 1 END, CASE WHEN heuristic THEN 1 ELSE 2 END) AS confidence FROM "
    + values(_EVIDENCE, "resolution, compiled, heuristic"),
)
def confidence_for(spark, sf_dir):
    df = spark.createDataFrame(_EVIDENCE, "resolution string, compiled boolean, heuristic boolean")
    return df.select("*", E.confidence_for(F.col("resolution"), F.col("compiled"), F.col("heuristic")).alias("confidence"))


@register("severity_rank", "SELECT * FROM " + values([(s, i) for i, s in enumerate(E.SEVERITIES)], "severity, rank"))
def severity_rank(spark, sf_dir):
    return spark.createDataFrame([(s,) for s in E.SEVERITIES], "severity string").select("severity", E.severity_rank(F.col("severity")).alias("rank"))


@register("confidence_weakest", "SELECT o_custkey, CAST(min(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END) AS INT) AS confidence FROM orders GROUP BY o_custkey")
def confidence_weakest(spark, sf_dir):
    code = F.when(F.col("o_orderstatus") == "F", E.CONFIRMED).when(F.col("o_orderstatus") == "O", E.LIKELY).otherwise(E.UNKNOWN)
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(E.weakest_confidence(code).cast("int").alias("confidence"))


@register(
    "resolution_weakest",
    "SELECT o_custkey, CASE min(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END) WHEN 2 THEN 'exact' WHEN 1 THEN 'partial' ELSE 'unknown' END AS resolution FROM orders GROUP BY o_custkey",
)
def resolution_weakest(spark, sf_dir):
    name = F.when(F.col("o_orderstatus") == "F", "exact").when(F.col("o_orderstatus") == "O", "partial").otherwise("unknown")
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(E.weakest_resolution(name).alias("resolution"))


@register("worst_severity", "SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) WHEN 1 THEN 'safe' WHEN 2 THEN 'possibly_breaking' ELSE 'breaking' END AS severity FROM orders GROUP BY o_custkey")
def worst_severity(spark, sf_dir):
    name = F.when(F.col("o_orderstatus") == "F", "safe").when(F.col("o_orderstatus") == "O", "possibly_breaking").otherwise("breaking")
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(E.worst_severity(name).alias("severity"))


# ----------------------------------------------------- contracts of the real tables

_TABLES = tuple(bundled.SOURCES)
#: What another side of the tables' contracts would be: lineitem loses and gains columns, part is gone, depot is new.
_HEAD = {
    **{t: c for t, c in bundled.SOURCES.items() if t != "part"},
    "lineitem": [c for c in bundled.SOURCES["lineitem"] if c not in ("l_tax", "l_linestatus")] + ["l_comment", "L_SHIPMODE"],
    "depot": ["d_depotkey"],
}
_REAL = f"real AS (SELECT table_name AS node_id, CAST(ordinal_position AS INT) - 1 AS ordinal, column_name AS col FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in _TABLES)}))"
_HEAD_SQL = "head AS (SELECT * FROM " + values([(t, i, c) for t, cs in _HEAD.items() for i, c in enumerate(cs)], "node_id, ordinal, col") + ")"


def _real_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("base", t, i, c) for t in _TABLES for i, c in enumerate(_table(spark, sf_dir, t).columns)]
    return spark.createDataFrame(rows, "side string, node_id string, ordinal int, column string")


def _head_contracts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("head", t, i, c) for t, cs in _HEAD.items() for i, c in enumerate(cs)], "side string, node_id string, ordinal int, column string")


def _as_nodes(contracts: DataFrame) -> DataFrame:
    return contracts.select("side", F.col("node_id").alias("unique_id"), F.col("node_id").alias("name"), F.lit("model").alias("resource_type")).distinct()


def _as_states(contracts: DataFrame) -> DataFrame:
    return contracts.select("node_id", F.lit("exact").alias("resolution"), F.lit("").alias("reason")).distinct()


def _common(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head = _real_contracts(spark, sf_dir), _head_contracts(spark)
    return C.models_common(_as_nodes(base), _as_nodes(head), _as_states(base), _as_states(head))


@register("columns_removed", f"WITH {_REAL}, {_HEAD_SQL} SELECT node_id, col AS column_name FROM real WHERE node_id IN (SELECT node_id FROM head) AND (node_id, lower(col)) NOT IN (SELECT node_id, lower(col) FROM head)")
def columns_removed(spark, sf_dir):
    return C.columns_removed(_common(spark, sf_dir), _real_contracts(spark, sf_dir), _head_contracts(spark)).select("node_id", F.col("column").alias("column_name"))


@register("columns_added", f"WITH {_REAL}, {_HEAD_SQL} SELECT node_id, col AS column_name FROM head WHERE node_id IN (SELECT node_id FROM real) AND (node_id, lower(col)) NOT IN (SELECT node_id, lower(col) FROM real)")
def columns_added(spark, sf_dir):
    return C.columns_added(_common(spark, sf_dir), _real_contracts(spark, sf_dir), _head_contracts(spark)).select("node_id", F.col("column").alias("column_name"))


@register("models_removed", f"WITH {_REAL}, {_HEAD_SQL} SELECT DISTINCT node_id AS name FROM real WHERE node_id NOT IN (SELECT node_id FROM head)")
def models_removed(spark, sf_dir):
    return C.models_removed(_as_nodes(_real_contracts(spark, sf_dir)), _as_nodes(_head_contracts(spark))).select("name")


@register("models_added", f"WITH {_REAL}, {_HEAD_SQL} SELECT DISTINCT node_id AS name FROM head WHERE node_id NOT IN (SELECT node_id FROM real)")
def models_added(spark, sf_dir):
    return C.models_added(_as_nodes(_real_contracts(spark, sf_dir)), _as_nodes(_head_contracts(spark))).select("name")


@register("models_common", f"WITH {_REAL}, {_HEAD_SQL} SELECT DISTINCT node_id AS name FROM head WHERE node_id IN (SELECT node_id FROM real)")
def models_common(spark, sf_dir):
    return _common(spark, sf_dir).select("name")


@register(
    "doc_drift",
    f"WITH {_REAL}, {_HEAD_SQL}, r AS (SELECT node_id, list(col ORDER BY ordinal) AS c FROM real GROUP BY node_id), h AS (SELECT node_id, list(col ORDER BY ordinal) AS c FROM head GROUP BY node_id) "
    "SELECT r.node_id, array_to_string(CASE WHEN h.c IS NULL THEN [] ELSE list_filter(r.c, lambda x: NOT list_contains(h.c, x)) END, ',') AS undocumented, "
    "array_to_string(CASE WHEN h.c IS NULL THEN [] ELSE list_filter(h.c, lambda x: NOT list_contains(r.c, x)) END, ',') AS absent FROM r LEFT JOIN h USING (node_id)",
)
def doc_drift(spark, sf_dir):
    def listed(df):
        return df.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column"))), lambda x: x["column"]).alias("columns"))

    return C.doc_drift(listed(_head_contracts(spark)), listed(_real_contracts(spark, sf_dir))).select("node_id", F.array_join("undocumented", ",").alias("undocumented"), F.array_join("absent", ",").alias("absent"))


@register("csv_header", f"WITH {_REAL} SELECT ordinal, col AS column_name FROM real WHERE node_id = 'nation'")
def csv_header(spark, sf_dir):
    """The header of a seed that holds a real table's columns, quoted or not, read as a project's seed is."""
    from ripple.sources.project import header

    names = [f'"{c}"' if i else f" {c} " for i, c in enumerate(_table(spark, sf_dir, "nation").columns)]
    return spark.createDataFrame(list(enumerate(header(",".join(names) + "\r\n"))), "ordinal int, column_name string")


# ------------------------------------------------------------- graphs from the data

_EDGES_SQL = """edges AS (
  SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer
  UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row depends on which: orders on customers, these and suppliers on nations, nations on regions."""

    def pair(table: str, a: str, child: str, b: str, parent: str) -> DataFrame:
        return _table(spark, sf_dir, table).select(F.concat(F.lit(a), F.col(child).cast("string")).alias("child"), F.concat(F.lit(b), F.col(parent).cast("string")).alias("parent"))

    parts = pair("customer", "c", "c_custkey", "n", "c_nationkey"), pair("supplier", "s", "s_suppkey", "n", "s_nationkey"), pair("nation", "n", "n_nationkey", "r", "n_regionkey"), pair("orders", "o", "o_orderkey", "c", "o_custkey")
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).distinct()


@register(
    "topo_levels",
    f"WITH RECURSIVE {_EDGES_SQL}, walk(node, level) AS (SELECT DISTINCT parent, 0 FROM edges WHERE parent NOT IN (SELECT child FROM edges) UNION SELECT e.child, w.level + 1 FROM walk w JOIN edges e ON e.parent = w.node) SELECT node, CAST(max(level) AS INT) AS level FROM walk GROUP BY node",
)
def topo_levels(spark, sf_dir):
    return G.topo_levels(_edges(spark, sf_dir))


@register("reverse_edges", f"WITH {_EDGES_SQL} SELECT node, coalesce(string_agg(child, ',' ORDER BY child), '') AS children FROM (SELECT child AS node FROM edges UNION SELECT parent FROM edges) n LEFT JOIN edges e ON e.parent = n.node GROUP BY node")
def reverse_edges(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent"))
    return G.reverse_edges(edges, nodes).select("node", F.array_join("children", ",").alias("children"))


@register("descendants", f"WITH RECURSIVE {_EDGES_SQL}, walk(node) AS (SELECT 'r1' UNION SELECT 'n3' UNION SELECT e.child FROM walk w JOIN edges e ON e.parent = w.node) SELECT node FROM walk WHERE node NOT IN ('r1', 'n3')")
def descendants(spark, sf_dir):
    return G.descendants(_edges(spark, sf_dir), spark.createDataFrame([("r1",), ("n3",), ("none",)], "seed string"))


@register(
    "cycle_nodes",
    "WITH RECURSIVE edges AS (SELECT 'n' || n_nationkey AS child, 'n' || ((n_nationkey + 5) % 20) AS parent FROM nation UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), "
    "walk(seed, node) AS (SELECT parent, child FROM edges UNION SELECT w.seed, e.child FROM walk w JOIN edges e ON e.parent = w.node) SELECT DISTINCT node FROM walk WHERE seed = node",
)
def cycle_nodes(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("n"), ((F.col("n_nationkey") + 5) % 20).cast("string")).alias("parent"))
    s = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("child"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent"))
    return G.cycle_nodes(n.union(s))


@register("dependency_edges", f"WITH {_EDGES_SQL} SELECT child, parent FROM edges WHERE parent IN (SELECT child FROM edges)")
def dependency_edges(spark, sf_dir):
    """Dependencies on rows that have dependencies themselves; the regions are dangling."""
    nodes = _edges(spark, sf_dir).groupBy(F.lit("base").alias("side"), F.col("child").alias("unique_id")).agg(F.collect_list("parent").alias("depends_on"))
    return C.dependency_edges(nodes).select("child", "parent")


_COLUMN_EDGES_SQL = """e AS (
  SELECT 'o' || o_orderkey AS down_node, lower(o_orderstatus) AS down_col, 'c' || o_custkey AS up_node, 'k' || (o_orderkey % 3) AS up_col,
         CASE o_orderkey % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'expression' WHEN 2 THEN 'aggregate' ELSE 'star_expanded' END AS kind, CAST(o_orderkey % 3 AS INT) AS confidence FROM orders)"""


def _column_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "direct").when(k % 4 == 1, "expression").when(k % 4 == 2, "aggregate").otherwise("star_expanded")
    return _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), k.cast("string")).alias("down_node"), F.lower("o_orderstatus").alias("down_col"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("up_node"),
        F.concat(F.lit("k"), (k % 3).cast("string")).alias("up_col"), kind.alias("kind"), (k % 3).cast("int").alias("confidence"),
    )


@register(
    "edge_dedupe",
    f"WITH {_COLUMN_EDGES_SQL}, d AS (SELECT up_node AS down_node, down_col, 'x' AS up_node, up_col, kind, confidence FROM e) SELECT down_node, down_col, up_node, up_col, kind, confidence FROM (SELECT *, row_number() OVER (PARTITION BY down_node, down_col, up_node, up_col ORDER BY confidence DESC, kind) AS nth FROM d) WHERE nth = 1",
)
def edge_dedupe(spark, sf_dir):
    edges = _column_edges(spark, sf_dir).select(F.col("up_node").alias("down_node"), "down_col", F.lit("x").alias("up_node"), "up_col", "kind", "confidence")
    return C.edge_dedupe(edges)


@register("edge_stats", f"WITH {_COLUMN_EDGES_SQL} SELECT CASE confidence WHEN 2 THEN 'confirmed' WHEN 1 THEN 'likely' ELSE 'unknown' END AS confidence, count(*) AS edges FROM e GROUP BY 1")
def edge_stats(spark, sf_dir):
    return V.edge_stats(_column_edges(spark, sf_dir))


@register("edges_upstream_of", f"WITH {_COLUMN_EDGES_SQL} SELECT * FROM e WHERE down_node = 'o7' AND down_col = (SELECT lower(o_orderstatus) FROM orders WHERE o_orderkey = 7)")
def edges_upstream_of(spark, sf_dir):
    edges = _column_edges(spark, sf_dir)
    status = _table(spark, sf_dir, "orders").where("o_orderkey = 7").select(F.lower("o_orderstatus")).first()
    return C.edges_upstream_of(edges, "o7", status[0] if status else "")


@register("edges_downstream_of", f"WITH {_COLUMN_EDGES_SQL} SELECT * FROM e WHERE up_node = 'c7' AND up_col = 'k1'")
def edges_downstream_of(spark, sf_dir):
    return C.edges_downstream_of(_column_edges(spark, sf_dir), "c7", "k1")


@register("dependents_of", f"WITH {_COLUMN_EDGES_SQL} SELECT DISTINCT down_node AS node FROM e WHERE up_node = 'c7' AND up_col IN ('k1')")
def dependents_of(spark, sf_dir):
    edges = _column_edges(spark, sf_dir)
    return C.dependents_of(edges.where("kind = 'direct'"), edges.where("kind <> 'direct'"), "c7", "k1")


@register("uses_only_star", f"WITH {_COLUMN_EDGES_SQL}, s AS (SELECT 'c' || c_custkey AS node_id, 'k1' AS col FROM customer) SELECT s.node_id, coalesce(bool_and(kind = 'star_expanded'), FALSE) AS star_only FROM s LEFT JOIN e ON e.up_node = s.node_id AND e.up_col = s.col GROUP BY s.node_id")
def uses_only_star(spark, sf_dir):
    seeds = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"), F.lit("k1").alias("column"))
    return I.uses_only_star(_column_edges(spark, sf_dir), seeds).select("node_id", "star_only")


@register(
    "data_blast_radius",
    "WITH RECURSIVE " + _EDGES_SQL + ", seeds AS (SELECT 'r' || r_regionkey AS seed FROM region), walk(seed, node) AS (SELECT s.seed, e.child FROM seeds s JOIN edges e ON e.parent = s.seed UNION SELECT w.seed, e.child FROM walk w JOIN edges e ON e.parent = w.node) "
    "SELECT s.seed AS node_id, count(w.node) AS n_columns, CAST(coalesce(min(CASE WHEN left(w.node, 1) = 'o' THEN 1 WHEN w.node IS NULL THEN 0 ELSE 2 END), 0) AS INT) AS confidence FROM seeds s LEFT JOIN walk w ON w.seed = s.seed GROUP BY s.seed",
)
def data_blast_radius(spark, sf_dir):
    """What each region reaches through the tables' keys, with the least confidence on the way: an order's edge is likely, others are confirmed."""
    edges = _edges(spark, sf_dir).select(F.col("child").alias("down_node"), F.lit("k").alias("down_col"), F.col("parent").alias("up_node"), F.lit("k").alias("up_col"), F.lit("direct").alias("kind"), F.when(F.col("child").startswith("o"), 1).otherwise(2).alias("confidence"))
    seeds = _table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"), F.lit("k").alias("column"))
    base, _ = sides(spark)
    found = I.blast_radius(seeds, edges, base.required.limit(0), base.snapshot.tests.limit(0), base.snapshot.exposures.limit(0))
    return found.select("node_id", F.size("columns").cast("long").alias("n_columns"), "confidence")


@register(
    "project_rollup",
    "WITH p AS (SELECT source, lang, count(*) AS n, count(*) FILTER (WHERE n_chars > 1000) AS good FROM documents GROUP BY source, lang) SELECT lang AS kind, CAST(sum(n) AS BIGINT) AS models, round(100.0 * sum(good) / sum(n), 6) AS weighted_pct, round(avg(100.0 * good / n), 6) AS mean_pct FROM p GROUP BY lang",
)
def project_rollup(spark, sf_dir):
    """Shares by kind, weighted by models and as the mean of projects: documents as models, sources as projects."""
    found = V.summarise(_table(spark, sf_dir, "documents"), "source", "lang", F.col("n_chars") > 1000)
    return found.select(F.col("lang").alias("kind"), "models", F.round("weighted_pct", 6).alias("weighted_pct"), F.round("mean_pct", 6).alias("mean_pct"))


# ------------------------------------------------- findings made from the data's rows

_FINDINGS_SQL = """f AS (
  SELECT 'R' || lpad(CAST(o_orderkey % 3 AS VARCHAR), 3, '0') AS rule, CASE o_orderstatus WHEN 'F' THEN 'safe' WHEN 'O' THEN 'possibly_breaking' ELSE 'breaking' END AS severity,
         CAST(o_orderkey % 3 AS INT) AS confidence, 'm' || o_custkey AS node_name, CASE WHEN o_orderkey % 2 = 0 THEN 'c' || o_orderkey END AS col FROM orders)"""
_RANK = "CASE severity WHEN 'info' THEN 0 WHEN 'safe' THEN 1 WHEN 'possibly_breaking' THEN 2 ELSE 3 END"
_BY = f"{_RANK} DESC, confidence DESC, rule, node_name, coalesce(col, '')"


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    severity = F.when(F.col("o_orderstatus") == "F", "safe").when(F.col("o_orderstatus") == "O", "possibly_breaking").otherwise("breaking")
    return _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("R"), F.lpad((k % 3).cast("string"), 3, "0")).alias("rule"), severity.alias("severity"), (k % 3).cast("int").alias("confidence"),
        F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("node_name"), F.when(k % 2 == 0, F.concat(F.lit("c"), k.cast("string"))).alias("column"),
    )


@register("failing_findings", f"WITH {_FINDINGS_SQL} SELECT rule, severity, confidence, node_name, col FROM f WHERE {_RANK} >= 2")
def failing_findings(spark, sf_dir):
    return R.failing(_findings(spark, sf_dir), "possibly-breaking").withColumnRenamed("column", "col")


@register("findings_by_severity", f"WITH {_FINDINGS_SQL} SELECT severity, count(*) AS n FROM f GROUP BY severity")
def findings_by_severity(spark, sf_dir):
    return _findings(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))


@register("findings_ordered", f"WITH {_FINDINGS_SQL} SELECT rule, severity, confidence, node_name, col FROM f ORDER BY {_BY}")
def findings_ordered(spark, sf_dir):
    return R.ordered(_findings(spark, sf_dir)).withColumnRenamed("column", "col")


@register("top_k_findings", f"WITH {_FINDINGS_SQL} SELECT rule, severity, confidence, node_name, col FROM f ORDER BY {_BY} LIMIT 50")
def top_k_findings(spark, sf_dir):
    """The report's limit of 50."""
    return R.top_k(_findings(spark, sf_dir), 50).withColumnRenamed("column", "col")


@register("impact_summary", "SELECT i, CASE WHEN c + q + t + x = 0 THEN 'nothing' ELSE concat_ws(', ', CASE c WHEN 0 THEN NULL WHEN 1 THEN '1 downstream column' ELSE c || ' downstream columns' END, CASE q WHEN 0 THEN NULL WHEN 1 THEN '1 query' ELSE q || ' queries' END, CASE t WHEN 0 THEN NULL WHEN 1 THEN '1 test' ELSE t || ' tests' END, CASE x WHEN 0 THEN NULL WHEN 1 THEN '1 exposure' ELSE x || ' exposures' END) END AS summary FROM (SELECT n_nationkey AS i, n_nationkey % 3 AS c, n_nationkey // 3 % 3 AS q, n_nationkey // 9 % 2 AS t, n_nationkey // 18 % 2 AS x FROM nation)")
def impact_summary(spark, sf_dir):
    i = F.col("n_nationkey")
    made = {"columns": i % 3, "query_breaks": F.floor(i / 3) % 3, "tests": F.floor(i / 9) % 2, "exposures": F.floor(i / 18) % 2}
    rows = _table(spark, sf_dir, "nation").select(i.alias("i"), *[F.array_repeat(F.lit("x"), n.cast("int")).alias(c) for c, n in made.items()])
    return rows.select("i", I.impact_summary().alias("summary"))


_STATES_SQL = "s AS (SELECT 'd' || doc_id AS name, CASE lang WHEN 'en' THEN 'exact' WHEN 'fr' THEN 'partial' ELSE 'unknown' END AS resolution, CASE lang WHEN 'en' THEN '' WHEN 'fr' THEN 'surviving_star' WHEN 'de' THEN 'no_sql' ELSE 'upstream_unknown' END AS reason FROM documents)"


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lang, id_ = F.col("lang"), F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    docs = _table(spark, sf_dir, "documents")
    nodes = docs.select(id_.alias("unique_id"), id_.alias("name"), F.lit("model").alias("resource_type"))
    resolution = F.when(lang == "en", "exact").when(lang == "fr", "partial").otherwise("unknown")
    reason = F.when(lang == "en", "").when(lang == "fr", "surviving_star").when(lang == "de", "no_sql").otherwise("upstream_unknown")
    return nodes, docs.select(id_.alias("node_id"), resolution.alias("resolution"), reason.alias("reason"))


@register("coverage_counts", f"WITH {_STATES_SQL} SELECT count(*) AS total_models, count(*) FILTER (WHERE resolution = 'exact') AS exact, count(*) FILTER (WHERE resolution = 'partial') AS partial, count(*) FILTER (WHERE resolution = 'unknown') AS unknown FROM s")
def coverage_counts(spark, sf_dir):
    return V.coverage(*_states(spark, sf_dir)).select("total_models", "exact", "partial", "unknown")


@register("coverage_pct", f"WITH {_STATES_SQL} SELECT round_even(100.0 * count(*) FILTER (WHERE resolution <> 'unknown') / count(*), 1) AS analysed_pct FROM s")
def coverage_pct(spark, sf_dir):
    return V.coverage(*_states(spark, sf_dir)).select(F.col("analysed_pct").cast("double").alias("analysed_pct"))


@register("catalog_would_help", f"WITH {_STATES_SQL} SELECT count(*) FILTER (WHERE reason IN ('surviving_star', 'upstream_unknown')) AS models FROM s")
def catalog_would_help(spark, sf_dir):
    return V.coverage(*_states(spark, sf_dir)).select(F.col("catalog_would_help").alias("models"))


@register("coverage_reasons", f"WITH {_STATES_SQL} SELECT reason, count(*) AS models FROM s WHERE reason <> '' GROUP BY reason")
def coverage_reasons(spark, sf_dir):
    return V.reasons(*_states(spark, sf_dir))


@register("coverage_headline", f"WITH {_STATES_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE resolution = 'exact') AS e, count(*) FILTER (WHERE resolution = 'partial') AS p, count(*) FILTER (WHERE resolution = 'unknown') AS u FROM s) SELECT 'analysed ' || (e + p) || '/' || n || ' models (' || printf('%.1f', round_even(100.0 * (e + p) / n, 1)) || '%): ' || e || ' exact, ' || p || ' partial, ' || u || ' not analysed' AS headline FROM c")
def coverage_headline(spark, sf_dir):
    counts = V.coverage(*_states(spark, sf_dir))
    return counts.select(V.headline().alias("headline"))


# ----------------------------------------------------------------- bundled project

_BASE_MODELS = [n for n, x in bundled.MODELS.items() if x[0]]
_HEAD_MODELS = [n for n, x in bundled.MODELS.items() if (x[0] if x[1] is None else x[1])]
_M, _S = "model.freight.", "source.freight.tpc."


def _snapshot(spark: SparkSession, side: str = "base") -> manifest.Snapshot:
    return manifest.from_text(spark, bundled.manifest(side), side)


@register("manifest_nodes", "SELECT * FROM " + values([(_M + n, n, "model", "rk_model_" + n) for n in _BASE_MODELS] + [(_S + t, t, "source", "rk_source_tpc_" + t) for t in _TABLES], "unique_id, name, resource_type, relation_key"))
def manifest_nodes(spark, sf_dir):
    return _snapshot(spark).nodes.select("unique_id", "name", "resource_type", "relation_key")


@register("route_resources", "SELECT * FROM " + values([("model", len(_BASE_MODELS)), ("source", len(_TABLES)), ("test", len(bundled.TESTS)), ("exposure", len(bundled.EXPOSURES)), ("macro", len(bundled.MACROS))], "kind, n"))
def route_resources(spark, sf_dir):
    s = _snapshot(spark)
    kinds = s.nodes.select(F.col("resource_type").alias("kind"))
    for df, kind in ((s.tests, "test"), (s.exposures, "exposure"), (s.macros, "macro")):
        kinds = kinds.union(df.select(F.lit(kind)))
    return kinds.groupBy("kind").agg(F.count("*").cast("int").alias("n"))


@register("models_only", "SELECT * FROM " + values([(n,) for n in _BASE_MODELS], "name"))
def models_only(spark, sf_dir):
    return C.models_only(_snapshot(spark).nodes).select("name")


@register("macro_stats", "SELECT * FROM " + values([(5, 4, 1)], "total, plain, skipped"))
def macro_stats(spark, sf_dir):
    return V.macro_stats(_snapshot(spark).macros).select(*[F.col(a).cast("int").alias(b) for a, b in (("total", "total"), ("plain", "plain"), ("skipped_non_macro", "skipped"))])


@register("vars_flatten", "SELECT * FROM " + values([("limit", "7"), ("freight", '{"limit": 3, "zone": "eu"}'), ("zone", '"eu"')], "name, value"))
def vars_flatten(spark, sf_dir):
    import json

    from ripple.sources.project import flat_vars

    found = flat_vars({"limit": 7, "freight": {"limit": 3, "zone": "eu"}})
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in found.items()], "name string, value string")


_CONTRACTS = {
    "parcels": "order_key,line_no,part_key,vendor_key,units,gross,rebate,shipped_on",
    "vendors": "vendor_key,vendor,country,credit",
    "net_lines": "order_key,vendor_key,net,units",
    "vendor_sales": "country,vendor,revenue,n_lines",
    "country_rank": "country,place",
    "late_parcels": "order_key,line_no",
    "every_vendor": "vendor_key,vendor,country,credit",
    "part_sizes": "part_key,size,brand",
    "brand_index": "part_key,label",
    "sandbox_lines": "order_key",
}


@register("contracts_inferred", "SELECT * FROM " + values([(_M + k, v, "exact") for k, v in _CONTRACTS.items()], "node_id, columns, resolution"))
def contracts_inferred(spark, sf_dir):
    base, _ = sides(spark)
    listed = base.contracts_df.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column"))), lambda x: x["column"]), ",").alias("columns"))
    return listed.join(base.states.select("node_id", "resolution"), "node_id").where(F.col("node_id").startswith("model."))


_OFFERED = [
    ("parcels", "rk_source_tpc_lineitem", 11), ("vendors", "rk_source_tpc_supplier", 4), ("vendors", "rk_source_tpc_nation", 3), ("net_lines", "rk_model_parcels", 8), ("vendor_sales", "rk_model_net_lines", 4),
    ("vendor_sales", "rk_model_vendors", 4), ("country_rank", "rk_model_vendor_sales", 4), ("late_parcels", "rk_model_parcels", 8), ("every_vendor", "rk_model_vendors", 4), ("part_sizes", "rk_source_tpc_part", 6),
    ("brand_index", "rk_model_part_sizes", 3), ("sandbox_lines", "rk_model_parcels", 8),
]


@register("parent_contracts", "SELECT * FROM " + values([(_M + a, b, n) for a, b, n in _OFFERED], "child, relation_key, n_columns"))
def parent_contracts(spark, sf_dir):
    base, _ = sides(spark)
    return C.parent_contracts(base.snapshot.nodes, base.contracts_df).select("child", "relation_key", F.size("columns").alias("n_columns"))


#: Every column that a model of the base takes: (model, its columns, where from, the columns there, how).
_TAKES = [
    ("parcels", "order_key line_no part_key vendor_key units gross rebate shipped_on", _S + "lineitem", "l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_shipdate", "direct"),
    ("vendors", "vendor_key vendor credit", _S + "supplier", "s_suppkey s_name s_acctbal", "direct"),
    ("vendors", "country", _S + "nation", "n_name", "direct"),
    ("net_lines", "order_key vendor_key units", _M + "parcels", "order_key vendor_key units", "direct"),
    ("net_lines", "net net", _M + "parcels", "gross rebate", "expression"),
    ("vendor_sales", "country vendor", _M + "vendors", "country vendor", "direct"),
    ("vendor_sales", "revenue", _M + "net_lines", "net", "aggregate"),
    ("country_rank", "country", _M + "vendor_sales", "country", "direct"),
    ("country_rank", "place", _M + "vendor_sales", "revenue", "expression"),
    ("late_parcels", "order_key line_no", _M + "parcels", "order_key line_no", "direct"),
    ("every_vendor", "vendor_key vendor country credit", _M + "vendors", "vendor_key vendor country credit", "star_expanded"),
    ("part_sizes", "part_key brand", _S + "part", "p_partkey p_brand", "direct"),
    ("part_sizes", "size", _S + "part", "p_size", "expression"),
    ("brand_index", "part_key label", _M + "part_sizes", "part_key brand", "direct"),
    ("sandbox_lines", "order_key", _M + "parcels", "order_key", "direct"),
]
_LINEAGE = [(_M + m, c, up, u, kind, 1) for m, cs, up, us, kind in _TAKES for c, u in zip(cs.split(), us.split(), strict=True)]


@register("column_edges", "SELECT * FROM " + values(_LINEAGE, "down_node, down_col, up_node, up_col, kind, confidence"))
def column_edges(spark, sf_dir):
    return sides(spark)[0].edges.drop("side")


_NEEDS = [("late_parcels", _M + "parcels", "shipped_on"), ("vendor_sales", _M + "net_lines", "vendor_key"), ("vendor_sales", _M + "vendors", "vendor_key"), ("vendors", _S + "nation", "n_nationkey"), ("vendors", _S + "supplier", "s_nationkey")]


@register("required_columns", "SELECT * FROM " + values([(_M + a, b, c, "predicate", 1) for a, b, c in _NEEDS], "down_node, up_node, up_col, kind, confidence"))
def required_columns(spark, sf_dir):
    return sides(spark)[0].required.drop("side")


_RADIUS = [
    ("parcels", "rebate", ["country_rank.place", "net_lines.net", "vendor_sales.revenue"], ["country_rank", "net_lines", "vendor_sales"], [], ["rebate_is_a_share", "revenue_is_positive"], ["sales_board"], 1),
    ("parcels", "shipped_on", [], ["late_parcels"], ["late_parcels"], [], [], 1),
    ("vendors", "credit", ["every_vendor.credit"], ["every_vendor"], [], [], ["vendor_sheet"], 1),
    ("every_vendor", "credit", [], [], [], [], ["vendor_sheet"], 0),
    ("part_sizes", "brand", ["brand_index.label"], ["brand_index"], [], [], [], 1),
]


def _of(names: list[str]) -> list[str]:
    return [_M + x for x in names]


@register(
    "blast_radius",
    "SELECT * FROM " + values([(_M + a, b, *[",".join(x) for x in (_of(c), _of(m), _of(q), t, e)], k) for a, b, c, m, q, t, e, k in _RADIUS], "node_id, col, columns, models, query_breaks, tests, exposures, confidence"),
)
def blast_radius(spark, sf_dir):
    base, head = sides(spark)
    removed = C.columns_removed(R.Sides(base, head).common, base.contracts_df, head.contracts_df)
    found = I.blast_radius(removed, base.edges, base.required, base.snapshot.tests, base.snapshot.exposures)
    return found.select("node_id", F.col("column").alias("col"), *[F.array_join(c, ",").alias(c) for c in ("columns", "models", "query_breaks", "tests", "exposures")], "confidence")


@register("affected_exposures", "SELECT * FROM " + values([("a", "sales_board"), ("b", "vendor_sheet"), ("b", "sales_board")], "seed, name"))
def affected_exposures(spark, sf_dir):
    affected = spark.createDataFrame([("a", _M + "country_rank"), ("b", _M + "country_rank"), ("b", _M + "every_vendor"), ("c", _M + "none")], "seed string, node string")
    return I.affected_exposures(_snapshot(spark).exposures, affected)


@register("affected_tests", "SELECT * FROM " + values([("rebate", "rebate_is_a_share"), ("rebate", "revenue_is_positive"), ("line_no", "line_no_is_there"), ("line_no", "revenue_is_positive")], "col, name"))
def affected_tests(spark, sf_dir):
    rows = [(c, n) for c in ("rebate", "line_no", "units") for n in ("parcels", "vendor_sales") if c != "units" or n == "parcels"]
    affected = spark.createDataFrame([((_M + "parcels", c), _M + n) for c, n in rows], "seed struct<node:string,col:string>, node string")
    return I.affected_tests(_snapshot(spark).tests, affected).select(F.col("seed.col").alias("col"), "name")


@register("head_mentions", "SELECT * FROM " + values([("rebate", _M + "net_lines"), ("shipped_on", _M + "late_parcels")], "col, models"))
def head_mentions(spark, sf_dir):
    base, head = sides(spark)
    removed = C.columns_removed(R.Sides(base, head).common, base.contracts_df, head.contracts_df)
    return C.head_mentions(head.references, removed).select(F.col("column").alias("col"), F.array_join("models", ",").alias("models"))


@register("dangling_refs", "SELECT * FROM " + values([("parcels", x) for x in ("net_lines", "late_parcels", "heavy_parcels")], "removed, dependent"))
def dangling_refs(spark, sf_dir):
    """What the head would still refer to, had parcels gone."""
    gone = spark.createDataFrame([(_M + "parcels", "parcels"), (_M + "sandbox_lines", "sandbox_lines")], "unique_id string, name string")
    return C.dangling_refs(gone, _snapshot(spark, "head").nodes)


#: (rule, severity, confidence, model, column, detail).
_FOUND = [
    ("R001", "breaking", "likely", "parcels", "rebate", "still named by net_lines; it breaks 3 downstream columns, 2 tests, 1 exposure"),
    ("R001", "breaking", "likely", "parcels", "shipped_on", "still named by late_parcels; it breaks 1 query"),
    ("R001", "possibly_breaking", "likely", "vendors", "credit", "consumers take it through a star only: they go on without it, with fewer columns"),
    ("R001", "safe", "likely", "every_vendor", "credit", "its consumers no longer refer to it"),
    ("R001", "safe", "likely", "part_sizes", "brand", "its consumers no longer refer to it"),
    ("R002", "possibly_breaking", "likely", "sandbox_lines", None, "nothing was found to refer to it, but not all models could be analysed"),
    ("R003", "safe", "likely", "every_vendor", "initials", ""),
    ("R003", "safe", "likely", "vendors", "initials", ""),
    ("R900", "info", "unknown", "late_parcels", None, "the head contract is unknown"),
    ("R900", "info", "unknown", "net_lines", None, "the head contract is unknown"),
]
_FOUND_SQL = "SELECT rule, severity, confidence, node_name, CAST(col AS VARCHAR) AS col, detail FROM " + values(_FOUND, "rule, severity, confidence, node_name, col, detail")

for _query, _rule in (("classify_columns_removed", "R001"), ("classify_models_removed", "R002"), ("classify_columns_added", "R003"), ("classify_incomparable", "R900")):

    @register(_query, f"SELECT * FROM ({_FOUND_SQL}) WHERE rule = '{_rule}'")
    def _classified(spark, sf_dir, rule=_rule):
        found = R.findings(*sides(spark)).where(F.col("rule") == rule)
        return found.select("rule", "severity", E.confidence_name(F.col("confidence")).alias("confidence"), "node_name", F.col("column").alias("col"), "detail")


def _payload(rule: str, severity: str, confidence: str, name: str, column: str | None, detail: str) -> str:
    """A finding as JSON, keys in order, from what is said of it above."""
    import json

    hit = next(({"columns": _of(c), "exposures": e, "models": _of(m), "query_breaks": _of(q), "tests": t} for a, b, c, m, q, t, e, _ in _RADIUS if rule == "R001" and (a, b) == (name, column)), None)
    subject = f"column {name}.{column}" if column else f"model {name}" if rule == "R002" else name
    summary = subject + {"R001": " was removed", "R002": " was removed", "R003": " was added", "R900": " could not be compared"}[rule]
    said = {
        "column": column, "confidence": confidence, "detail": detail, "impact": hit or dict.fromkeys(("columns", "exposures", "models", "query_breaks", "tests"), []), "node_id": _M + name if column else None, "node_name": name,
        "rule": rule, "severity": severity, "summary": summary,
    }
    return json.dumps(said, separators=(",", ":"))


@register("findings_json", "SELECT * FROM " + values([(_payload(*x),) for x in _FOUND], "json"))
def findings_json(spark, sf_dir):
    return report.findings_json(R.findings(*sides(spark))).select("json")


_MARKDOWN = [
    "- **BREAKS** column `parcels.rebate` was removed (R001, likely)\n  - why: still named by net\\_lines; it breaks 3 downstream columns, 2 tests, 1 exposure\n"
    "  - columns: `country_rank.place`, `net_lines.net`, `vendor_sales.revenue`\n  - tests: `rebate_is_a_share`, `revenue_is_positive`\n  - exposures: `sales_board`",
    "- **BREAKS** column `parcels.shipped_on` was removed (R001, likely)\n  - why: still named by late\\_parcels; it breaks 1 query\n  - queries that need it to run: `model.freight.late_parcels`",
    "- **MAY BREAK** column `vendors.credit` was removed (R001, likely)\n  - why: consumers take it through a star only: they go on without it, with fewer columns\n  - columns: `every_vendor.credit`\n  - exposures: `vendor_sheet`",
    "- **MAY BREAK** model `sandbox_lines` was removed (R002, likely)\n  - why: nothing was found to refer to it, but not all models could be analysed",
    "| R001 | safe | column `every_vendor.credit` was removed | its consumers no longer refer to it |",
    "| R001 | safe | column `part_sizes.brand` was removed | its consumers no longer refer to it |",
    "| R003 | safe | column `every_vendor.initials` was added |  |",
    "| R003 | safe | column `vendors.initials` was added |  |",
    "| R900 | note | model `late_parcels` could not be compared | the head contract is unknown |",
    "| R900 | note | model `net_lines` could not be compared | the head contract is unknown |",
]


@register("findings_markdown_rows", "SELECT * FROM " + values([(x,) for x in _MARKDOWN], "markdown"))
def findings_markdown_rows(spark, sf_dir):
    return report.markdown_rows(R.findings(*sides(spark))).select("markdown")


@register("star_profile", "SELECT * FROM " + values([(n, n in ("net_lines", "every_vendor"), n == "every_vendor") for n in _BASE_MODELS], "model, any_star, top_star"))
def star_profile(spark, sf_dir):
    base, _ = sides(spark)
    with FrontEnd(spark, "duckdb") as front:
        rows = [(u.split(".")[-1], *front.parsed(r.sql).stars) for u, r in base.recovered.items() if r.sql]
    return spark.createDataFrame(rows, "model string, any_star boolean, top_star boolean")


@register("edges_by_kind", f"WITH {_COLUMN_EDGES_SQL} SELECT kind, CASE confidence WHEN 2 THEN 'confirmed' WHEN 1 THEN 'likely' ELSE 'unknown' END AS confidence, count(*) AS edges FROM e GROUP BY ALL")
def edges_by_kind(spark, sf_dir):
    return V.edges_by_kind(_column_edges(spark, sf_dir))


@register("top_reasons", f"WITH {_STATES_SQL} SELECT reason, count(*) AS models FROM s WHERE reason <> '' GROUP BY reason ORDER BY models DESC, reason LIMIT 25")
def top_reasons(spark, sf_dir):
    """The 25 most frequent reasons, the report's limit."""
    return V.top_reasons(_states(spark, sf_dir)[1], "reason")


@register(
    "unearned_edges",
    f"WITH {_COLUMN_EDGES_SQL}, s AS (SELECT 'o' || o_orderkey AS down_node, o_orderstatus = 'F' AND o_orderkey % 5 IN (0, 1) AS earned FROM orders) "
    "SELECT down_node, down_col, up_node, up_col FROM e JOIN s USING (down_node) WHERE confidence = 2 AND NOT earned",
)
def unearned_edges(spark, sf_dir):
    """Edges said to be confirmed of models that are not exact or not compiled: orders as models, of which those of status F are exact and two of five compiled."""
    orders, k = _table(spark, sf_dir, "orders"), F.col("o_orderkey")
    node, side = F.concat(F.lit("o"), k.cast("string")).alias("node_id"), F.lit("head").alias("side")
    states = orders.select(side, node, F.when(F.col("o_orderstatus") == "F", "exact").when(F.col("o_orderstatus") == "O", "partial").otherwise("unknown").alias("resolution"))
    recovered = orders.select(side, node, F.when(k % 5 == 0, "manifest_compiled").when(k % 5 == 1, "disk_compiled").otherwise("rendered").alias("sql_source"))
    found = V.unearned(_column_edges(spark, sf_dir).withColumn("side", side), states, recovered)
    return found.select("down_node", "down_col", "up_node", "up_col")


@register("recovered_sql", "SELECT * FROM " + values([(n, "rendered", bundled.RENDERED[n]) for n in _BASE_MODELS], "model, sql_source, sql"))
def recovered_sql(spark, sf_dir):
    base, _ = sides(spark)
    return base.recovered_df.select(F.element_at(F.split("node_id", r"\."), -1).alias("model"), "sql_source", "sql")


# ------------------------------------------------------- the front end, text by text

#: (what it is, adapter, text, outputs with their sources and kinds, what it reads) over rk_up (alpha, beta, gamma).
_TEXTS = [
    ("qualify", "snowflake", "select alpha, upper(beta) as b from rk_up qualify row_number() over (partition by beta order by gamma) = 1", "alpha<alpha:direct b<beta:expression", "alpha beta gamma"),
    ("qualify in a query", "bigquery", "with x as (select * from rk_up qualify rank() over (order by gamma) < 3) select alpha from x", "alpha<alpha:direct", "alpha gamma"),
    ("qualify in a union", "snowflake", "select alpha from rk_up qualify row_number() over (order by gamma) = 1 union all select beta from rk_up order by 1", "alpha<alpha,beta:direct", "alpha beta gamma"),
    ("qualify and order", "snowflake", "select alpha from rk_up qualify count(*) over (partition by gamma) > 1 order by beta limit 5", "alpha<alpha:direct", "alpha beta gamma"),
    ("short casts", "postgres", "select alpha::varchar as x, beta::numeric(10,2) as y, gamma :: timestamptz z from rk_up", "x<alpha:expression y<beta:expression z<gamma:expression", "alpha beta gamma"),
    ("types of others", "bigquery", "select cast(alpha as text) as x, safe_cast(beta as int64) as y, cast(gamma as double precision) as z from rk_up", "x<alpha:expression y<beta:expression z<gamma:expression", "alpha beta gamma"),
    ("functions of others", "snowflake", "select iff(alpha = 'x', beta, gamma) as k, to_varchar(sysdate()) as t from rk_up", "k<alpha,beta,gamma:expression t<:expression", "alpha beta gamma"),
    ("exclude", "duckdb", "select * exclude (beta) from rk_up", "alpha<alpha:direct gamma<gamma:direct", ""),
    ("exclude one", "snowflake", "select * exclude beta from rk_up", "alpha<alpha:direct gamma<gamma:direct", ""),
    ("except", "bigquery", "select * except (beta) from rk_up", "alpha<alpha:direct gamma<gamma:direct", ""),
    ("placed relation", "duckdb", "select u.alpha from ripple.ripple.rk_up u", "alpha<alpha:direct", "alpha"),
    ("quoted names", "snowflake", "select \"ALPHA\" as \"We ird\" from \"RK_UP\" -- beta", "we ird<alpha:direct", "alpha"),
    ("backticks", "bigquery", "select `alpha` from `rk_up` where \"beta\" = gamma", "alpha<alpha:direct", "alpha gamma"),
    ("words in strings", "duckdb", "select alpha || ' ::text qualify exclude beta' as x from rk_up", "x<alpha:expression", "alpha"),
    ("recursive", "duckdb", "with recursive r as (select alpha from rk_up union all select r.alpha from r where r.alpha < 'x') select alpha from r", "alpha<alpha:direct", "alpha"),
    ("using", "duckdb", "select alpha, v.gamma as g from rk_up join (select beta, gamma from rk_up) v using (beta)", "alpha<alpha:direct g<gamma:direct", "alpha beta gamma"),
    ("pivot", "duckdb", "select * from (select alpha, beta, gamma from rk_up) pivot (max(gamma) for beta in ('x' as x, 'y' as y))", "alpha<alpha:direct x<beta,gamma:direct y<beta,gamma:direct", "alpha beta gamma"),
    ("unnest", "spark", "select alpha, item from rk_up lateral view explode(split(beta, ',')) t as item", "alpha<alpha:direct item<beta:direct", "alpha beta"),
]


@register("query_lineage", "SELECT * FROM " + values([(a, c, d) for a, _, _, c, d in _TEXTS], "what, outputs, reads"))
def query_lineage(spark, sf_dir):
    """Texts of several vendors against one known relation: outputs with their sources and kinds, and all that the text reads by name."""
    rows = []
    for what, adapter, text, *_ in _TEXTS:
        with FrontEnd(spark, adapter) as front:
            found = front.query(text, {"rk_up": ("alpha", "beta", "gamma")})
        outputs = " ".join(f"{n}<{','.join(sorted(s.column for s in of))}:{kind}" for n, of, kind in found.outputs)
        rows.append((what, outputs if found.resolved else "unresolved", " ".join(sorted({s.column for s in found.references}))))
    return spark.createDataFrame(rows, "what string, outputs string, reads string")


_PLACES = {
    "ok": ("select alpha from {{ source('s', 'up') }}", {}, "alpha", "exact", "", "inferred"),
    "python": ("def model(): ...", {"language": "python", "columns": {"a": {"name": "a"}}}, "a", "partial", "python_model", "declared"),
    "unparsed": ("select (", {"columns": {"d": {"name": "d"}}}, "d", "partial", "sql_parse_error", "declared"),
    "unparsed_bare": ("select (", {}, "", "unknown", "sql_parse_error", "none"),
    "missing": ("select gone from {{ source('s', 'up') }}", {}, "", "unknown", "qualify_error", "none"),
    "live": ("{{ run_query('x') }}", {}, "", "unknown", "needs_warehouse", "none"),
    "unrendered": ("select {{ nowhere() }} as x", {}, "", "unknown", "unparseable_jinja", "none"),
    "empty": ("  ", {}, "", "unknown", "no_sql", "none"),
    "wild": ("select * from outside", {}, "", "unknown", "no_output_columns", "none"),
    "mixed": ("select *, 1 as x from outside", {}, "x", "partial", "surviving_star", "inferred"),
    "above": ("select *, 1 as x from {{ ref('live') }}", {"depends_on": {"nodes": ["model.p.live"]}}, "x", "partial", "upstream_unknown", "inferred"),
    "compiled": ("{{ nowhere() }}", {"compiled_code": "select beta from rk_source_s_up"}, "beta", "exact", "", "inferred"),
}


@register("contract_states", "SELECT * FROM " + values([(n, c, r, why, o) for n, (_, _, c, r, why, o) in _PLACES.items()], "model, columns, resolution, reason, origin"))
def contract_states(spark, sf_dir):
    """What becomes of models that can be analysed in full, in part or not at all."""
    import json

    from ripple.plans.analysis import analyse

    nodes = {
        f"model.p.{n}": {"name": n, "resource_type": "model", "package_name": "p", "raw_code": text, "depends_on": {"nodes": ["source.p.s.up"]}, **more} for n, (text, more, *_) in _PLACES.items()
    }
    sources = {"source.p.s.up": {"name": "up", "source_name": "s", "resource_type": "source", "columns": {c: {"name": c} for c in ("alpha", "beta")}}}
    text = json.dumps({"metadata": {"dbt_schema_version": "x/manifest/v12.json", "adapter_type": "duckdb"}, "nodes": nodes, "sources": sources, "exposures": {}, "macros": {}})
    found = analyse(spark, manifest.from_text(spark, text))
    columns = found.contracts_df.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column"))), lambda x: x["column"]), ",").alias("columns"))
    rows = found.states.join(columns, "node_id", "left").where(F.col("node_id").startswith("model."))
    return rows.select(F.element_at(F.split("node_id", r"\."), -1).alias("model"), F.coalesce("columns", F.lit("")).alias("columns"), "resolution", "reason", "origin")


_DRAWN = {
    "loop": ("{% for c in ['a', 'b'] %}{{ c }}{{ ', ' if not loop.last }}{% endfor %}", "a, b", None),
    "set": ("{% set n = 2 %}{{ n * 3 ~ 'x' }}", "6x", None),
    "macro": ("{{ twice('c') }}", "c + c", None),
    "package": ("{{ tools.twice('d') }}", "d + d", None),
    "dispatch": ("{{ pick('e') }}", "duck e", None),
    "newline macro": ("{{ late() }}", "late", None),
    "relations": ("{{ ref('m', v=2) }} {{ source('a', 'b') }} {{ this }}", "rk_model_m rk_source_a_b rk_model_t", None),
    "settings": ("{{ config(tags=['x']) }}{{ var('day', '1') }} {{ env_var('NONE', 'd') }} {{ target.type }} {{ execute }}", "1 d duckdb False", None),
    "unknown name": ("{{ nope }}", None, "undefined_macro"),
    "unknown macro": ("{{ tools.nope() }}", None, "undefined_macro"),
    "no default": ("{{ var('v') }}", None, "undefined_macro"),
    "warehouse": ("{{ adapter.get_columns_in_relation(this) }}", None, "introspective"),
    "malformed": ("{% if x %}", None, "jinja_syntax"),
    "too large": ("{{ range(1000000) | length }}", None, "too_large"),
    "without end": ("{{ round_and_round() }}", None, "recursion"),
    "own names win": ("{{ ref('x') }}", "rk_model_x", None),
}
_DRAWN_MACROS = {
    "twice": ("tools", "{% macro twice(x) %}{{ x }} + {{ x }}{% endmacro %}"), "pick": ("p", "{% macro pick(x) %}{{ return(adapter.dispatch('pick')(x)) }}{% endmacro %}"), "duckdb__pick": ("p", "{% macro duckdb__pick(x) %}duck {{ x }}{% endmacro %}"),
    "late": ("p", "\n{% macro late() %}late{% endmacro %}"), "round_and_round": ("p", "{% macro round_and_round() %}{{ round_and_round() }}{% endmacro %}"), "ref": ("p", "{% macro ref(x) %}shadow{% endmacro %}"),
    "bad": ("p", "{% macro bad( %}{% endmacro %}"),
}


@register("rendered_templates", "SELECT what, CAST(sql AS VARCHAR) AS sql, CAST(failure AS VARCHAR) AS failure FROM " + values([(n, sql, failure) for n, (_, sql, failure) in _DRAWN.items()], "what, sql, failure"))
def rendered_templates(spark, sf_dir):
    """Templates with a registry of macros, one of which does not parse: what they render to, or why not."""
    from ripple.plans.recovery import Recovery

    macros = [{"name": n, "package_name": package, "macro_sql": sql, "is_plain": True} for n, (package, sql) in _DRAWN_MACROS.items()]
    recovery = Recovery(macros, "duckdb", "p", None, {})
    node = {"name": "t", "compiled_code": None, "package_name": "p", "original_file_path": "", "materialized": None, "unique_key": None}
    found = [(n, recovery.recover({**node, "raw_code": text})) for n, (text, *_) in _DRAWN.items()]
    return spark.createDataFrame([(n, r.sql, r.failure) for n, r in found], "what string, sql string, failure string")


_REFUSED = {
    "short": ("x" * 99, "read"), "long": ("x" * (manifest.MAX_SQL + 1), "ManifestTooLarge"), "at the limit": ("x" * manifest.MAX_SQL, "read"),
}


@register("sql_length_limit", "SELECT * FROM " + values([(n, x) for n, (_, x) in _REFUSED.items()], "what, result"))
def sql_length_limit(spark, sf_dir):
    """Manifests whose one model has a text of so many characters."""
    import json

    rows = []
    for name, (text, _) in _REFUSED.items():
        made = {"metadata": {"dbt_schema_version": "x/manifest/v12.json"}, "nodes": {"model.p.m": {"name": "m", "resource_type": "model", "raw_code": text}}, "sources": {}, "exposures": {}, "macros": {}}
        try:
            manifest.from_text(spark, "\n\t " + json.dumps(made))
            rows.append((name, "read"))
        except manifest.ManifestTooLarge as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "what string, result string")
