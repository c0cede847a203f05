"""A small model project over the test tables, before and after a change.

It follows what vendors ship: lines of orders become parcels, their net value is
summed by vendor and country, and countries are ranked.  The change drops ``rebate``
and ``shipped_on`` from parcels, while net_lines still computes with the one and
late_parcels still filters on the other; drops ``credit`` from vendors, which
every_vendor reaches through a star only, and adds ``initials``; drops ``brand`` from
part_sizes, whose one consumer is updated along; removes sandbox_lines and adds
heavy_parcels.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ripple.plans.recovery import Recovery, key

SOURCES = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
}

PARCELS = """{{{{ config(materialized='view') }}}}
select
    l_orderkey as order_key, l_linenumber as line_no, l_partkey as part_key, l_suppkey as vendor_key,
    l_quantity as units, l_extendedprice as gross{dropped}
from {{{{ source('tpc', 'lineitem') }}}}  -- one row a line"""

VENDORS = "select s.s_suppkey as vendor_key, s.s_name as vendor, n.n_name as country{more} from {{{{ source('tpc', 'supplier') }}}} s join {{{{ source('tpc', 'nation') }}}} n on n.n_nationkey = s.s_nationkey"
PART_SIZES = "select p_partkey as part_key, {{{{ whole('p_size') }}}} as size{brand} from {{{{ source('tpc', 'part') }}}}"

#: Models by name: (template of the base, template of the head or None for the same, parents).
MODELS: dict[str, tuple[str | None, str | None, list[str]]] = {
    "parcels": (PARCELS.format(dropped=", l_discount as rebate, l_shipdate as shipped_on"), PARCELS.format(dropped=""), ["source.freight.tpc.lineitem"]),
    "vendors": (VENDORS.format(more=", s.s_acctbal as credit"), VENDORS.format(more=", substr(s.s_name, 1, 2) as initials"), ["source.freight.tpc.supplier", "source.freight.tpc.nation"]),
    "net_lines": (
        "with p as (select * from {{ ref('parcels') }}) select p.order_key, p.vendor_key, {{ after_rebate('p.gross', 'p.rebate') }} as net, p.units from p",
        None,
        ["model.freight.parcels"],
    ),
    "vendor_sales": (
        "select v.country, v.vendor, sum(l.net) as revenue, count(*) as n_lines from {{ ref('net_lines') }} l join {{ ref('vendors') }} v on v.vendor_key = l.vendor_key group by v.country, v.vendor",
        None,
        ["model.freight.net_lines", "model.freight.vendors"],
    ),
    "country_rank": ("select country, rank() over (order by revenue desc) as place from {{ ref('vendor_sales') }}", None, ["model.freight.vendor_sales"]),
    "late_parcels": ("select order_key, line_no from {{ ref('parcels') }} where shipped_on > '1998-01-01'", None, ["model.freight.parcels"]),
    "every_vendor": ("select * from {{ ref('vendors') }}", None, ["model.freight.vendors"]),
    "part_sizes": (PART_SIZES.format(brand=", p_brand as brand"), PART_SIZES.format(brand=""), ["source.freight.tpc.part"]),
    "brand_index": (
        "select part_key, {% if target.type == 'duckdb' %}brand{% else %}null{% endif %} as label from {{ ref('part_sizes') }}",
        "select part_key, 'none' as label from {{ ref('part_sizes') }}",
        ["model.freight.part_sizes"],
    ),
    "sandbox_lines": ("select order_key from {{ ref('parcels') }}", "", ["model.freight.parcels"]),
    "heavy_parcels": (None, "select order_key, sum(units) as units from {{ ref('parcels') }} group by order_key", ["model.freight.parcels"]),
}

MACROS = {
    "after_rebate": "{% macro after_rebate(amount, share) %}{{ return(adapter.dispatch('after_rebate')(amount, share)) }}{% endmacro %}",
    "default__after_rebate": "{%- macro default__after_rebate(amount, share) -%}round({{ amount }} * (1 - {{ share }}), 2){%- endmacro -%}",
    "whole": "\n\t{% macro whole(column) %}cast({{ column }} as int){% endmacro %}\n",
    "test_between": "{% test between(model) %}select 1{% endtest %}",
    "broken": "{% macro broken( %}{% endmacro %}",
}

TESTS = {
    "rebate_is_a_share": {"column_name": "rebate", "attached_node": "model.freight.parcels", "depends_on": {"nodes": ["model.freight.parcels"]}, "test_metadata": {"name": "between"}},
    "line_no_is_there": {"column_name": "line_no", "attached_node": "model.freight.parcels", "depends_on": {"nodes": ["model.freight.parcels"]}, "test_metadata": {"name": "not_null"}},
    "revenue_is_positive": {"depends_on": {"nodes": ["model.freight.vendor_sales"]}},
}

EXPOSURES = {
    "sales_board": {"type": "dashboard", "url": "https://boards.example/sales", "owner": {"name": "Sales", "email": "sales@example.com"}, "depends_on": {"nodes": ["model.freight.country_rank"]}},
    "vendor_sheet": {"type": "notebook", "owner": {"name": "Buying"}, "depends_on": {"nodes": ["model.freight.every_vendor"]}},
}

#: What the base's models render to.
RENDERED = {
    "parcels": """
select
    l_orderkey as order_key, l_linenumber as line_no, l_partkey as part_key, l_suppkey as vendor_key,
    l_quantity as units, l_extendedprice as gross, l_discount as rebate, l_shipdate as shipped_on
from rk_source_tpc_lineitem  -- one row a line""",
    "vendors": "select s.s_suppkey as vendor_key, s.s_name as vendor, n.n_name as country, s.s_acctbal as credit from rk_source_tpc_supplier s join rk_source_tpc_nation n on n.n_nationkey = s.s_nationkey",
    "net_lines": "with p as (select * from rk_model_parcels) select p.order_key, p.vendor_key, round(p.gross * (1 - p.rebate), 2) as net, p.units from p",
    "vendor_sales": "select v.country, v.vendor, sum(l.net) as revenue, count(*) as n_lines from rk_model_net_lines l join rk_model_vendors v on v.vendor_key = l.vendor_key group by v.country, v.vendor",
    "country_rank": "select country, rank() over (order by revenue desc) as place from rk_model_vendor_sales",
    "late_parcels": "select order_key, line_no from rk_model_parcels where shipped_on > '1998-01-01'",
    "every_vendor": "select * from rk_model_vendors",
    "part_sizes": "select p_partkey as part_key, cast(p_size as int) as size, p_brand as brand from rk_source_tpc_part",
    "brand_index": "select part_key, brand as label from rk_model_part_sizes",
    "sandbox_lines": "select order_key from rk_model_parcels",
}


def manifest(side: str, extra: dict[str, Any] | None = None) -> str:
    """The manifest of one side, as JSON; ``extra`` adds nodes."""
    nodes: dict[str, Any] = {}
    for name, (base, head, parents) in MODELS.items():
        raw = base if side == "base" else base if head is None else head
        if raw:
            nodes[f"model.freight.{name}"] = {
                "name": name, "resource_type": "model", "package_name": "freight", "original_file_path": f"models/{name}.sql", "raw_code": raw, "language": "sql",
                "depends_on": {"nodes": parents, "macros": []}, "columns": {}, "config": {"materialized": "view" if name in ("parcels", "vendors") else "table"},
            }
    nodes["model.freight.parcels"]["columns"] = {c: {"name": c} for c in ("order_key", "line_no", "rebate")}
    for name, x in TESTS.items():
        nodes[f"test.freight.{name}"] = {"name": name, "resource_type": "test", "package_name": "freight", **x}
    nodes["junk"] = "not an object"
    nodes |= extra or {}
    sources = {
        f"source.freight.tpc.{t}": {"name": t, "source_name": "tpc", "resource_type": "source", "package_name": "freight", "columns": {c: {"name": c, "data_type": None} for c in columns}}
        for t, columns in SOURCES.items()
    }
    return json.dumps({
        "metadata": {"dbt_schema_version": "https://schemas.example/dbt/manifest/v12.json", "dbt_version": "1.9.0", "adapter_type": "duckdb", "project_name": "freight"},
        "nodes": nodes, "sources": sources,
        "exposures": {f"exposure.freight.{k}": {"name": k, **v} for k, v in EXPOSURES.items()},
        "macros": {f"macro.freight.{k}": {"name": k, "package_name": "freight", "macro_sql": v} for k, v in MACROS.items()},
    })


# ------------------------------------------------------- models that are run

#: Models of every SQL construct the engine analyses: (template, parents), with the SQL that an independent engine runs.
SHAPES: dict[str, tuple[str, str]] = {
    "projection": ("select c_custkey, c_name as name from {{ source('tpc', 'customer') }}", "SELECT c_custkey, c_name AS name FROM customer"),
    "expression": (
        "select c_custkey, upper(c_name) || '-' || c_mktsegment as tag, round(coalesce(c_acctbal, 0) * 2 + 1, 2) as twice from {{ source('tpc', 'customer') }}",
        "SELECT c_custkey, upper(c_name) || '-' || c_mktsegment AS tag, round(coalesce(c_acctbal, 0) * 2 + 1, 2) AS twice FROM customer",
    ),
    "aggregate": (
        "select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from {{ source('tpc', 'orders') }} group by o_orderstatus",
        "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus",
    ),
    "having": (
        "select o_custkey, count(*) as n from {{ source('tpc', 'orders') }} group by o_custkey having count(*) > {{ var('least', 12) }}",
        "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    ),
    "cte_chain": (
        "with a as (select * from {{ source('tpc', 'orders') }}), b as (select o_orderkey as k, o_totalprice as p from a), c as (select b.k, b.p from b where b.p > 1000) select * from c",
        "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 1000",
    ),
    "case": (
        "select o_orderkey, case when o_totalprice > 100000 then 'large' when o_totalprice > 10000 then 'medium' else 'small' end as size from {{ source('tpc', 'orders') }}",
        "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'large' WHEN o_totalprice > 10000 THEN 'medium' ELSE 'small' END AS size FROM orders",
    ),
    "filter": ("select l_orderkey, l_linenumber from {{ source('tpc', 'lineitem') }} where l_quantity < 10 and l_returnflag = 'R'", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10 AND l_returnflag = 'R'"),
    "subquery": (
        "select s.nation, s.n from (select n_name as nation, n_regionkey as n from {{ source('tpc', 'nation') }}) s where s.n in (select r_regionkey from {{ source('tpc', 'region') }} where r_name > 'AS')",
        "SELECT n_name AS nation, n_regionkey AS n FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name > 'AS')",
    ),
    "distinct": ("select distinct o_orderstatus, o_orderpriority from {{ source('tpc', 'orders') }}", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "window": (
        "select o_orderkey, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as bigint) as nth from {{ source('tpc', 'orders') }}",
        "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders",
    ),
    "join": (
        "select o.o_orderkey, c.c_name from {{ source('tpc', 'orders') }} o join {{ source('tpc', 'customer') }} c on c.c_custkey = o.o_custkey",
        "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey",
    ),
    "left_join": (
        "select c.c_custkey, coalesce(o.o_orderkey, -1) as order_key from {{ source('tpc', 'customer') }} c left join {{ source('tpc', 'orders') }} o on o.o_custkey = c.c_custkey and o.o_orderstatus = 'P'",
        "SELECT c.c_custkey, coalesce(o.o_orderkey, -1) AS order_key FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'",
    ),
    "cross_join": ("select n.n_name, r.r_name from {{ source('tpc', 'nation') }} n, {{ source('tpc', 'region') }} r", "SELECT n.n_name, r.r_name FROM nation n, region r"),
    "union_all": (
        "select c_name as name, c_nationkey as nation from {{ source('tpc', 'customer') }} union all select s_name, s_nationkey from {{ source('tpc', 'supplier') }}",
        "SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier",
    ),
    "star": ("select *, r_regionkey + 1 as next_key from {{ source('tpc', 'region') }}", "SELECT *, r_regionkey + 1 AS next_key FROM region"),
    "literal": ("select 1 as one, 'x' as letter{% for i in range(2) %}, {{ i }} as n{{ i }}{% endfor %}", "SELECT 1 AS one, 'x' AS letter, 0 AS n0, 1 AS n1"),
    "exists": (
        "select c_custkey from {{ source('tpc', 'customer') }} c where exists (select 1 from {{ source('tpc', 'orders') }} o where o.o_custkey = c.c_custkey and o.o_totalprice > 300000)",
        "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    ),
    "except": ("select n_regionkey as k from {{ source('tpc', 'nation') }} except select r_regionkey from {{ source('tpc', 'region') }} where r_regionkey < 2", "SELECT n_regionkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region WHERE r_regionkey < 2"),
}


def rendered(template: str) -> str:
    node = {"name": "shape", "raw_code": template, "compiled_code": None, "package_name": "", "original_file_path": "", "materialized": None, "unique_key": None}
    found = Recovery([], "duckdb", "freight", None, {}).recover(node)
    if found.sql is None:
        raise ValueError(found.detail)
    return found.sql


def run_shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Render a model and run it over the tables; only those it reads are registered, under their surrogate names."""
    sql = rendered(SHAPES[name][0])
    for t in SOURCES:
        if key("source", "tpc", t) in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(key("source", "tpc", t))
    return spark.sql(sql)
