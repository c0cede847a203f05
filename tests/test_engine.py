"""Snapshots to findings, on projects made for one point each."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ripple import cli
from ripple.operators import contracts as C
from ripple.operators import graph as G
from ripple.operators import rules as R
from ripple.plans import analysis, bundled
from ripple.plans.catalyst import FrontEnd, Source, SqlError, prepare
from ripple.sources import manifest, project
from ripple.sources.errors import CycleError, ManifestNotFound, ManifestUnreadable, UnsafePath, UnsupportedVersion

UP = ("alpha", "beta")


def made(models, sources=None, tests=None, exposures=None, version=12, **extra):
    nodes = {}
    for name, spec in models.items():
        spec = {"raw_code": spec} if isinstance(spec, str) else dict(spec)
        deps = spec.pop("deps", ["source.p.s.up"])
        nodes[f"model.p.{name}"] = {"name": name, "resource_type": "model", "package_name": "p", "depends_on": {"nodes": deps}, "columns": {}, **spec}
    for name, spec in (tests or {}).items():
        nodes[f"test.p.{name}"] = {"name": name, "resource_type": "test", **spec}
    srcs = {f"source.p.s.{t}": {"name": t, "source_name": "s", "resource_type": "source", "columns": {c: {"name": c} for c in cs}} for t, cs in (sources or {"up": UP}).items()}
    return json.dumps({"metadata": {"dbt_schema_version": f"x/manifest/v{version}.json", "adapter_type": "duckdb", "project_name": "p"}, "nodes": nodes | extra, "sources": srcs, "exposures": exposures or {}, "macros": {}})


@pytest.fixture(scope="module")
def front(spark):
    return FrontEnd(spark, "duckdb")


@pytest.fixture(scope="module")
def judged(spark, front):
    def run(base, head):
        a, b = (analysis.analyse(spark, manifest.from_text(spark, x, s), None, front) for x, s in ((base, "base"), (head, "head")))
        rows = R.ordered(R.findings(a, b)).collect()
        return {(r["rule"], r["node_name"], r["column"]): r for r in rows}, a, b

    return run


SHAPES = {
    "direct": "select alpha from {t}",
    "aliased": "select alpha as x from {t}",
    "expression": "select alpha || 'a' as x from {t}",
    "function": "select upper(alpha) as x from {t}",
    "aggregate": "select count(alpha) as n from {t}",
    "cte_chain": "with a as (select * from {t}), b as (select alpha as z from a) select z from b",
    "nested_cte": "with a as (with i as (select alpha from {t}) select * from i) select * from a",
    "case": "select case when alpha = 'x' then 1 else 0 end as k from {t}",
    "where_only": "select beta from {t} where alpha > 'a'",
    "subquery": "select q.x from (select alpha as x from {t}) q",
    "distinct": "select distinct alpha from {t}",
    "window": "select row_number() over (partition by alpha order by beta) as n from {t}",
    "having": "select beta from {t} group by beta having count(alpha) > 1",
    "order": "select beta from {t} order by alpha",
    "exists": "select beta from {t} u where exists (select 1 from {t} v where v.alpha = u.beta)",
    "in": "select beta from {t} where beta in (select alpha from {t})",
}


@pytest.mark.parametrize("label", SHAPES)
def test_claims_hold_against_the_analyser(front, label):
    """What a query is said to need, it cannot do without; what it is not said to need, it can."""
    sql = SHAPES[label].format(t="rk_up")
    with front:
        whole = front.query(sql, {"rk_up": UP})
        assert whole.resolved
        needs = {s.column for s in whole.references} | {s.column for _, ss, _ in whole.outputs for s in ss}
        assert "alpha" in needs
        for column in UP:
            rest = tuple(c for c in UP if c != column)
            assert front.query(sql, {"rk_up": rest}).resolved == (column not in needs), column


def test_kinds_and_stars(front):
    with front:
        q = front.query("with a as (select * from rk_up) select *, upper(beta) as u from a", {"rk_up": UP})
        assert [(n, sorted(s.column for s in ss)) for n, ss, _ in q.outputs] == [("alpha", ["alpha"]), ("beta", ["beta"]), ("u", ["beta"])]
        assert q.named == {"beta"}
        q = front.query("select beta, sum(alpha) as s, alpha || beta as e from rk_up group by beta, alpha", {"rk_up": UP})
        assert [k for _, _, k in q.outputs] == ["direct", "aggregate", "expression"]
        q = front.query("select a.alpha, b.beta as x from rk_up a join rk_two b using (beta)", {"rk_up": UP, "rk_two": UP})
        assert q.outputs[1][1] == frozenset({Source("rk_two", "beta")}) and Source("rk_up", "beta") in q.references


def test_unknown_relations(front):
    with front:
        q = front.query("with s as (select * from raw.tbl), f as (select id, s.name as nm from s) select * from f", {})
        assert [n for n, _, _ in q.outputs] == ["id", "nm"] and not q.star_left
        q = front.query("select *, 1 as extra from tbl where id > 0", {})
        assert [n for n, _, _ in q.outputs] == ["extra"] and q.star_left
        q = front.query("select * from tbl", {})
        assert q.outputs == [] and q.star_left
        q = front.query("select * from t1, t2", {})
        assert q.outputs == [] and q.star_left


def test_text_that_could_blur_plans(front):
    with front:
        q = front.query("select alpha as \"We ird\", 'a#1, b AS c#2 [(' as lit from rk_up -- alpha, ghost\n where beta <> '''x#9'';' ;", {"rk_up": UP})
        assert [n for n, _, _ in q.outputs] == ["we ird", "lit"] and {s.column for s in q.references} == {"alpha", "beta"}
        with pytest.raises(SqlError):
            front.query("drop table x", {})
        with pytest.raises(SqlError):
            front.query("select (", {})
        assert not front.query("select gone from rk_up", {"rk_up": UP}).resolved
        assert Source("rk_up", "gone") in front.query("with c as (select * from rk_up) select z.gone from c z", {"rk_up": UP}).references
    assert prepare("select 1 from a.b.c where x", "")[0] == "select 1 from a_b_c AS c where x"


def test_contracts(spark, front):
    text = made(
        {
            "ok": "select alpha, beta as b from {{ source('s', 'up') }}",
            "star": {"raw_code": "select *, 1 as one from {{ ref('blank') }}", "deps": ["model.p.blank"]},
            "blank": {"raw_code": "{{ run_query('x') }}", "deps": []},
            "py": {"raw_code": "def model(): ...", "language": "python", "deps": [], "columns": {"a": {"name": "a"}}},
            "bad": {"raw_code": "select (", "deps": []},
            "missing": {"raw_code": "select gone from {{ source('s', 'up') }}", "columns": {"gone": {}}},
            "drift": {"raw_code": "select alpha, beta from {{ source('s', 'up') }}", "columns": {"alpha": {}, "gamma": {}}},
            "wild": {"raw_code": "select * from outside", "deps": []},
            "mixed": {"raw_code": "select *, 1 as x from outside", "deps": []},
        },
        junk="text",
    )
    found = analysis.analyse(spark, manifest.from_text(spark, text), None, front)
    c = {k.removeprefix("model.p."): (list(x.columns), x.resolution, x.reason) for k, x in found.contracts.items() if k.startswith("model")}
    assert c["ok"] == (["alpha", "b"], "exact", "")
    assert c["star"] == (["one"], "partial", "upstream_unknown")
    assert c["blank"] == ([], "unknown", "needs_warehouse")
    assert c["py"] == (["a"], "partial", "python_model")
    assert c["bad"] == ([], "unknown", "sql_parse_error")
    assert c["missing"] == (["gone"], "partial", "qualify_error")
    assert c["wild"] == ([], "unknown", "no_output_columns")
    assert c["mixed"] == (["x"], "partial", "surviving_star")
    drift = found.contracts["model.p.drift"]
    assert (drift.undocumented, drift.absent) == (("beta",), ("gamma",))


ONE = "select alpha, beta from {{ source('s', 'up') }}"


def child(sql):
    return {"raw_code": sql, "deps": ["model.p.one"]}


def test_column_rules(judged):
    base = made({"one": ONE, "two": child("select alpha, beta from {{ ref('one') }}")})
    found, *_ = judged(base, made({"one": "select alpha from {{ source('s', 'up') }}", "two": child("select alpha, beta from {{ ref('one') }}")}))
    assert found["R001", "one", "beta"]["severity"] == "breaking" and found["R001", "one", "beta"]["impact"]["columns"] == ["model.p.two.beta"]
    assert found["R900", "two", None]["severity"] == "info"
    found, *_ = judged(base, made({"one": "select alpha from {{ source('s', 'up') }}", "two": child("select alpha from {{ ref('one') }}")}))
    assert found["R001", "one", "beta"]["severity"] == "safe" and "no longer" in found["R001", "one", "beta"]["detail"]
    found, *_ = judged(made({"one": ONE, "two": child("select * from {{ ref('one') }}")}), made({"one": "select alpha from {{ source('s', 'up') }}", "two": child("select * from {{ ref('one') }}")}))
    assert found["R001", "one", "beta"]["severity"] == "possibly_breaking" and "star" in found["R001", "one", "beta"]["detail"]
    found, *_ = judged(made({"one": ONE}), made({"one": "select alpha, beta as b from {{ source('s', 'up') }}"}))
    assert found["R001", "one", "beta"]["severity"] == "safe" and found["R003", "one", "b"]["severity"] == "safe"
    gap = {"gap": {"raw_code": "{{ run_query('x') }}", "deps": []}}
    found, *_ = judged(made({"one": ONE, **gap}), made({"one": "select alpha from {{ source('s', 'up') }}", **gap}))
    assert found["R001", "one", "beta"]["severity"] == "possibly_breaking" and "50.0%" in found["R001", "one", "beta"]["detail"]
    assert found["R900", "gap", None]["confidence"] == 0


def test_predicates_end_the_walk(judged):
    models = {"one": ONE, "two": child("select alpha from {{ ref('one') }} where beta > 'x'"), "three": {"raw_code": "select alpha from {{ ref('two') }}", "deps": ["model.p.two"]}}
    head = dict(models, one="select alpha from {{ source('s', 'up') }}")
    tests = {"on_one": {"column_name": "beta", "attached_node": "model.p.one", "depends_on": {"nodes": ["model.p.one"]}}, "other": {"column_name": "alpha", "depends_on": {"nodes": ["model.p.one"]}}, "whole": {"depends_on": {"nodes": ["model.p.two"]}}, "far": {"depends_on": {"nodes": ["model.p.three"]}}}
    board = {"exposure.p.b": {"name": "b", "depends_on": {"nodes": ["model.p.two"]}}}
    found, *_ = judged(made(models, tests=tests, exposures=board), made(head, tests=tests, exposures=board))
    hit = found["R001", "one", "beta"]
    assert hit["severity"] == "breaking" and hit["confidence"] == 1
    assert (hit["impact"]["columns"], hit["impact"]["query_breaks"], hit["impact"]["tests"], hit["impact"]["exposures"]) == ([], ["model.p.two"], ["on_one", "whole"], ["b"])


def test_model_rules(judged):
    two = child("select alpha from {{ ref('one') }}")
    found, *_ = judged(made({"one": ONE, "two": two}), made({"two": child("select alpha from {{ ref('one') }}")}))
    assert (found["R002", "one", None]["severity"], found["R002", "one", None]["confidence"]) == ("breaking", 2)
    found, *_ = judged(made({"one": ONE, "x": ONE}), made({"one": ONE}))
    assert found["R002", "x", None]["severity"] == "safe"
    found, *_ = judged(made({"one": ONE}), made({"one": ONE, "new": ONE}))
    assert found == {}


def test_compiled_sql_earns_confidence(judged):
    spec = {"one": {"compiled_code": "select alpha, beta from rk_source_s_up"}, "two": {"compiled_code": "select beta from rk_model_one", "deps": ["model.p.one"]}}
    head = {"one": {"compiled_code": "select alpha from rk_source_s_up"}, "two": dict(spec["two"])}
    found, a, _ = judged(made({k: dict(v) for k, v in spec.items()}), made(head))
    assert {r["confidence"] for r in a.edges.collect()} == {2} and found["R001", "one", "beta"]["confidence"] == 2


NO_OPS = {
    "layout": ("select a, b from tbl", "select\n  a,\n  b\nfrom tbl"),
    "column order": ("select a, b from tbl", "select b, a from tbl"),
    "name of an inner query": ("with x as (select a from tbl) select a from x", "with y as (select a from tbl) select a from y"),
    "wrapper": ("select a from tbl", "with w as (select a from tbl) select * from w"),
    "order of inner queries": ("with p as (select a from t1), q as (select b from t2) select p.a, q.b from p, q", "with q as (select b from t2), p as (select a from t1) select p.a, q.b from p, q"),
    "alias": ("select t.a from tbl t", "select u.a from tbl as u"),
    "filter": ("select a from tbl", "select a from tbl where a > 1"),
    "comment": ("with x as (select a from tbl) select a from x", "with x as (select a /* b */ from tbl) -- c\n select a from x"),
    "quotes": ("select a from tbl", 'select "a" from "tbl"'),
    "join": ("select t.a from tbl t", "select t.a from tbl t left join other o on o.id = t.a"),
    "expression": ("select a + b as c from tbl", "select (a+b) as c from tbl"),
    "case of keywords": ("select a from tbl", "SELECT A FROM tbl"),
    "appended": ("select a from tbl", "select a, b from tbl"),
    "semicolon": ("select a from tbl", "select a from tbl;"),
}


@pytest.mark.parametrize("label", NO_OPS)
def test_changes_that_break_nothing(judged, label):
    taken = "c" if " as c" in NO_OPS[label][0] else "a"
    base, head = ({"one": {"raw_code": sql, "deps": []}, "two": child(f"select {taken} from {{{{ ref('one') }}}}")} for sql in NO_OPS[label])
    found, _, b = judged(made(base), made(head))
    assert {c.resolution for k, c in b.contracts.items() if k.startswith("model")} == {"exact"}
    assert [k for k, r in found.items() if r["severity"] in ("breaking", "possibly_breaking")] == []


def test_config_change_breaks_nothing(judged):
    base, head = (made({"one": {"raw_code": "{{ config(materialized='" + m + "') }} select alpha from {{ source('s', 'up') }}", "config": {"materialized": m}}}) for m in ("view", "table"))
    assert base != head and judged(base, head)[0] == {}


def test_the_corpus_can_fail(judged):
    found, *_ = judged(made({"one": ONE, "two": child("select beta from {{ ref('one') }}")}), made({"one": "select alpha from {{ source('s', 'up') }}", "two": child("select beta from {{ ref('one') }}")}))
    assert any(r["severity"] == "breaking" for r in found.values())


def test_loader(spark, tmp_path):
    with pytest.raises(ManifestNotFound):
        manifest.load(spark, str(tmp_path / "none.json"))
    for bad in ("", "[]", "{}", '{"metadata": 3}', '{"metadata": {"dbt_schema_version": "x"}}'):
        with pytest.raises(ManifestUnreadable):
            manifest.from_text(spark, bad)
    with pytest.raises(UnsupportedVersion):
        manifest.from_text(spark, made({}, version=7))
    s = manifest.from_text(spark, made({"one": {"raw_code": "x", "depends_on": "junk"}}, a=[1], b=None, c={"resource_type": "analysis", "name": "z"}))
    assert [r["depends_on"] for r in s.nodes.where("name = 'one'").collect()] == [[]]
    assert s.nodes.count() == 2 and s.tests.count() == 0
    path = tmp_path / "m.json"
    path.write_text(bundled.manifest("base"))
    owner = {r["name"]: r["owner"] for r in manifest.load(spark, str(path)).exposures.collect()}
    assert owner == {"sales_board": "sales@example.com", "vendor_sheet": "Buying"}
    assert manifest.from_text(spark, "\n\t\r " + made({"one": "x"})).nodes.count() == 2


def test_project_folder(tmp_path):
    (tmp_path / "seeds").mkdir()
    (tmp_path / "seeds/a.csv").write_text('id, "na,me",,x\n1,2,3,4\n')
    assert project.seed_header(tmp_path, "seeds/a.csv") == ("id", "na,me", "x")
    assert project.seed_header(tmp_path, "../x.csv") == () and project.seed_header(None, "a") == ()
    with pytest.raises(UnsafePath):
        manifest.within("../../etc/passwd", tmp_path)
    (tmp_path / "dbt_project.yml").write_text("vars:\n  n: 1\n  shop:\n    n: 2\n    z: 3\n")
    assert project.project_vars(tmp_path) == {"n": 1, "z": 3, "shop": {"n": 2, "z": 3}}
    (tmp_path / "dbt_project.yml").write_text("vars: [broken")
    assert project.project_vars(tmp_path) == {}
    (tmp_path / "target/compiled/p").mkdir(parents=True)
    (tmp_path / "target/compiled/p/m.sql").write_text("select 1")
    assert project.compiled(tmp_path, "p", "m.sql") == "select 1" and project.compiled(tmp_path, "..", "../m.sql") is None
    (tmp_path / "target/manifest.json").write_text("{}")
    assert project.root_of(str(tmp_path / "target/manifest.json")) == tmp_path.resolve()


def test_graph(spark):
    def edges(pairs):
        return spark.createDataFrame(pairs or [("x", "y")], "child string, parent string").where("true" if pairs else "false")

    diamond = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d")]
    assert {r["node"]: r["level"] for r in G.topo_levels(edges(diamond)).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert G.topo_levels(edges([])).count() == 0
    assert {r["node"] for r in G.descendants(edges(diamond), spark.createDataFrame([("b",), ("zz",)], "seed string")).collect()} == {"d", "e"}
    loop = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")]
    with pytest.raises(CycleError):
        G.topo_levels(edges(loop))
    assert {r["node"] for r in G.cycle_nodes(edges(loop + [("s", "s")])).collect()} == {"a", "b", "c", "s"}
    with pytest.raises(CycleError) as e:
        G.levels({"a": ["b"], "b": ["a"]})
    assert set(e.value.members) == {"a", "b"}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), min_size=1, max_size=40))
def test_reach_against_a_plain_walk(spark, pairs):
    ahead = {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)

    def walk(s):
        seen, todo = set(), list(ahead.get(s, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += ahead.get(x, ())
        return seen

    edges, seeds = spark.createDataFrame(pairs, "a long, b long"), spark.range(15).withColumnRenamed("id", "seed")
    want = {(s, n) for s in range(15) for n in walk(s)}
    assert {tuple(r) for r in G.reach(edges, seeds, True).collect()} == want
    assert {tuple(r) for r in G._hops(edges.distinct(), seeds).collect()} == want


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11)), min_size=1, max_size=24))
def test_large_graphs_go_by_rounds(spark, pairs):
    """Levels and cycles as beyond what memory holds, against plain ones."""
    ahead = {}
    for child, parent in pairs:
        ahead.setdefault(parent, set()).add(child)

    def walk(s):
        seen, todo = set(), list(ahead.get(s, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += ahead.get(x, ())
        return seen

    edges, on = spark.createDataFrame(pairs, "child long, parent long"), {n for n in range(12) if n in walk(n)}
    held = G.SMALL_EDGES
    assert {r["node"] for r in G.cycle_nodes(edges).collect()} == on
    try:
        G.SMALL_EDGES = 0
        assert {r["node"] for r in G.cycle_nodes(edges).collect()} == on
        if on:
            with pytest.raises(CycleError):
                G.topo_levels(edges)
        else:
            parents = {}
            for child, parent in pairs:
                parents.setdefault(child, []).append(parent)
            assert {r["node"]: r["level"] for r in G.topo_levels(edges).collect()} == G.levels(parents)
    finally:
        G.SMALL_EDGES = held


def test_deep_and_wide_graphs(spark):
    chain = spark.range(5000).select((F.col("id") + 1).alias("child"), F.col("id").alias("parent"))
    assert G.topo_levels(chain).agg(F.max("level"), F.count("*")).first()[:] == (5000, 5001)
    assert G.descendants(chain, spark.createDataFrame([(4000,)], "seed long")).count() == 1000
    # A million edges: eleven layers, each node on five of the layer before; node n of a layer leans on n, n + 1, .. there.
    wide = spark.range(200_000).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    layer, place = F.floor(F.col("i") / 20_000), F.col("i") % 20_000
    edges = wide.select(((layer + 1) * 20_000 + place).alias("child"), (layer * 20_000 + (place + F.col("k")) % 20_000).alias("parent"))
    got = {r["level"]: r["n"] for r in G.topo_levels(edges).groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert got == dict.fromkeys(range(11), 20_000)
    # What node 50 of the first layer bears: in layer l the nodes 50 - 4 l to 50.
    assert G.descendants(edges, spark.createDataFrame([(50,)], "seed long")).count() == sum(4 * n + 1 for n in range(1, 11))


def test_dangling(spark):
    gone = spark.createDataFrame([("model.p.one", "one")], "unique_id string, name string")
    nodes = spark.createDataFrame([("a", ["model.p.one"]), ("b", ["source.q.one"]), ("c", ["model.p.someone"]), ("d", [])], "name string, depends_on array<string>")
    assert {r["dependent"] for r in C.dangling_refs(gone, nodes).collect()} == {"a", "b"}
    assert {r["dependent"] for r in C.dangling_refs(gone, nodes, exact=True).collect()} == {"a"}


def test_command_line(spark, tmp_path, capsys):
    for side in ("base", "head"):
        (tmp_path / f"{side}.json").write_text(bundled.manifest(side))
    args = ["check", "--base", str(tmp_path / "base.json"), "--head", str(tmp_path / "head.json")]
    assert cli.main([*args, "--format", "json"], spark) == 1
    first = capsys.readouterr().out
    assert cli.main([*args, "--format", "json"], spark) == 1
    assert capsys.readouterr().out == first
    said = json.loads(first)
    assert said["failed"] and said["findings"][0]["rule"] == "R001" and said["findings"][1]["impact"]["query_breaks"] == ["model.freight.late_parcels"]
    assert cli.main([*args, "--fail-on", "never", "--format", "markdown"], spark) == 0
    text = capsys.readouterr().out
    assert "2 breaks, 2 may break" in text.split("\n")[0] and "<details>" in text and "Not all models were analysed" in text.split("<details>")[0]
    assert cli.main(["check", "--base", "/none", "--head", "/none"], spark) == 2
    head = str(tmp_path / "head.json")
    assert cli.main(["debug", "schema", head, "--model", "zz"], spark) == 0
    assert cli.main(["debug", "graph", head, "--model", "zz"], spark) == 2
    assert cli.main(["debug", "sql", head, "--model", "zz"], spark) == 2
    assert cli.main(["debug", "coverage", head, "--json"], spark) == 0
    assert "qualify_error" in capsys.readouterr().out


def test_reports_name_what_they_leave_out(spark, monkeypatch):
    from ripple.plans import report

    rows = [("R001", "breaking", 1, f"m{i:03}", None, f"c{i}", "", "gone") for i in range(60)] + [("R003", "safe", 1, f"n{i:03}", None, "c", "", "new") for i in range(55)]
    found = spark.createDataFrame(rows, "rule string, severity string, confidence int, node_name string, node_id string, column string, detail string, summary string").withColumn("impact", F.lit(None).cast(R.IMPACT))
    nodes = spark.createDataFrame([(f"u{i}", f"u{i:05}", "model") for i in range(10_050)], "unique_id string, name string, resource_type string")
    states = nodes.select(F.col("unique_id").alias("node_id"), F.lit("unknown").alias("resolution"), F.lit("no_sql").alias("reason"))
    head = type("Head", (), {"snapshot": type("Snapshot", (), {"nodes": nodes}), "states": states, "macro_stats": {}})
    made_ = report.Report(found, head)
    text = made_.markdown()
    assert "60 breaks" in text and "… and 10 more of **BREAKS**" in text and "… and 5 more" in text and "- … and 10030 more" in text
    assert len(json.loads(made_.json("never"))["coverage"]["unanalysable"]) == 10_050


def test_models_of_many_columns(spark, front):
    columns = [f"c{i}" for i in range(2600)]
    text = made({"wide": "select " + ", ".join(columns) + " from {{ source('s', 'up') }}"}, sources={"up": columns})
    found = analysis.analyse(spark, manifest.from_text(spark, text), None, front)
    assert found.edges.count() == 2600


def test_escaping(spark):
    from ripple.functions import text as T
    from ripple.plans.report import coded, escaped

    nasty = ["", "a@b <img src=x> `q` [l](u) *b* _i_ |t| ~s~ #h 1.2!", "x" * 200, "&lt;", "\\`@", "é🙂" * 90]
    df = spark.createDataFrame([(x,) for x in nasty] + [(None,)], "t string").select("t", T.markdown_escape(F.col("t")).alias("e"), T.markdown_code(F.col("t")).alias("c"))
    for r in df.collect():
        assert r["e"] == escaped(r["t"] or "") and r["c"] == coded(r["t"] or "")
        assert "<" not in r["e"] and "@" not in r["e"] and "`" not in r["c"][1:-1]


def test_stream(spark, tmp_path):
    from ripple.streaming import manifests

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(bundled.manifest("base"))
    q = manifests.nodes(spark, str(tmp_path / "in")).where("resource_type = 'model'").writeStream.format("memory").queryName("landed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert spark.table("landed").count() == 10
