import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mendline.functions.scale import global_rank
from mendline.operators import artifacts, lineage, trees

MANIFEST = {
    "nodes": {
        "model.shop.stg_sales": {"name": "stg_sales", "resource_type": "model", "depends_on": {"nodes": ["source.shop.raw.sales"]}},
        "model.shop.fct_sales": {"name": "fct_sales", "resource_type": "model", "depends_on": {"nodes": ["model.shop.stg_sales", "model.shop.stg_stores"]}},
        "model.shop.stg_stores": {"name": "stg_stores", "resource_type": "model", "depends_on": {"nodes": []}},
        "test.shop.t1": {"name": "t1", "resource_type": "test", "depends_on": {"nodes": ["model.shop.fct_sales", "model.other.gone"]}},
    },
    "sources": {"source.shop.raw.sales": {"source_name": "raw", "name": "sales"}},
    "exposures": {"exposure.shop.board": {"name": "board", "depends_on": {"nodes": ["model.shop.fct_sales"]}}},
}


@pytest.fixture(scope="module")
def entries(spark):
    files = spark.createDataFrame([("target/manifest.json", json.dumps(MANIFEST))], "path string, content string")
    return artifacts.manifest_nodes(files).cache()


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


def roots(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "root string")


def test_manifest_summary(entries, rows):
    assert rows(artifacts.manifest_summary(entries), "n_models", "n_tests", "n_sources", "n_exposures") == [(3, 1, 1, 1)]
    assert rows(artifacts.model_dependencies(entries), "model", "depends_on") == [
        ("fct_sales", "stg_sales, stg_stores"),
        ("stg_sales", "sales"),
        ("stg_stores", "none"),
    ]


def test_manifest_edges(entries, rows):
    assert rows(lineage.manifest_edges(entries), "child", "parent") == [
        ("board", "fct_sales"),
        ("fct_sales", "stg_sales"),
        ("fct_sales", "stg_stores"),
        ("stg_sales", "raw.sales"),
        ("t1", "fct_sales"),
        ("t1", "gone"),
    ]


@pytest.mark.parametrize("large", [False, True])
def test_edges_within_the_rows_of_manifests(spark, rows, large):
    odd = {"nodes": {"model.a.x": {"name": "x", "depends_on": {"nodes": ["model.a.y", "model.a.y", "source.a.s"]}}, "model.a.y": {"depends_on": None}}, "sources": {"source.a.s": {"name": "s"}}}
    texts = [json.dumps(MANIFEST), json.dumps(odd), "no json", json.dumps({"nodes": {}}), json.dumps({"results": [], "nodes": odd["nodes"]}), None]
    if large:  # no variant holds a key twice, as none holds more than 16 MB
        texts = [t and t.replace("{", '{"nodes": {}, ', 1) if t and t.startswith("{") else t for t in texts]
    files = spark.createDataFrame([(f"t{i}/manifest.json", t) for i, t in enumerate(texts)], "path string, content string")
    want = rows(lineage.manifest_edges(artifacts.manifest_nodes(files)))
    found = lineage.manifest_file_edges(files)
    assert rows(found.select("path", "child_uid", "child", "parent_uid", "parent")) == want and len(want) == 8
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    kinds = dict(rows(artifacts.classify_artifacts(files), "path", "kind"))
    assert [kinds[f"t{i}/manifest.json"] for i in range(6)] == ["manifest", "manifest", "invalid", "manifest", "run_results", "invalid"]
    edges = found.cache()
    assert rows(lineage.manifest_impact(edges)) == rows(lineage.named(lineage.impact(lineage.keyed_edges(edges)), edges).select(lineage.manifest_impact(edges).columns))


def test_a_mistyped_entry_loses_itself_only(spark, rows):
    nodes = {"model.a.x": 5, "model.a.y": {"name": 7, "depends_on": {"nodes": "z"}}, "model.a.z": {"name": "z", "depends_on": {"nodes": ["model.a.y"]}}}
    files = spark.createDataFrame([("manifest.json", json.dumps({"nodes": nodes, "sources": [1]}))], "path string, content string")
    assert rows(artifacts.manifest_nodes(files), "uid", "name", "deps") == [
        ("model.a.x", None, []), ("model.a.y", "7", []), ("model.a.z", "z", ["model.a.y"]),
    ]
    assert rows(lineage.manifest_file_edges(files), "child", "parent") == [("z", "7")]


def test_node_types(entries, rows):
    edges = lineage.manifest_edges(entries)
    labels = dict(rows(lineage.node_types(lineage.manifest_names(entries), edges), "name", "label"))
    assert labels["raw.sales"] == "raw.sales [source]" and labels["board"] == "board [exposure]" and labels["gone"] == "gone"


def test_sql_edges(spark, rows):
    sql = "select * from {{ ref('a') }} join {{ref(\"b\")}} join {{ source('raw', 't') }} join {{ ref('a') }} join {{ ref('two', 'args') }}"
    models = spark.createDataFrame([("m", sql), ("n", "select 1")], "name string, sql string")
    assert rows(lineage.sql_edges(models)) == [("m", "a", "model"), ("m", "b", "model"), ("m", "raw.t", "source")]


CHAIN = [("fct", "stg"), ("stg", "raw"), ("mart", "fct"), ("report", "fct"), ("fct", "dim")]


def test_depth_limits_reach_but_not_counts(spark, rows):
    edges = graph(spark, CHAIN)
    assert rows(lineage.reach(edges, roots(spark, "fct"), max_depth=1), "node") == [("dim",), ("stg",)]
    assert rows(lineage.reach(edges, roots(spark, "fct")), "node", "depth") == [("dim", 1), ("raw", 2), ("stg", 1)]
    assert lineage.reach(edges, roots(spark, "fct"), max_depth=0).count() == 0
    nodes = edges.select(F.explode(F.array("child", "parent")).alias("name"))
    counts = lineage.reach_counts(lineage.reach(edges), nodes, max_depth=1)
    assert ("mart", 1, 4) in rows(counts) and ("raw", 0, 0) in rows(counts)


def test_directions(spark, rows):
    edges = graph(spark, CHAIN)
    both = rows(lineage.lineage(edges, roots(spark, "fct")), "direction", "node")
    assert both == [("downstream", "mart"), ("downstream", "report"), ("upstream", "dim"), ("upstream", "raw"), ("upstream", "stg")]
    assert rows(lineage.lineage(edges, roots(spark, "fct"), "downstream"), "node") == [("mart",), ("report",)]
    with pytest.raises(ValueError):
        lineage.lineage(edges, roots(spark, "fct"), "sideways")


def test_missing_roots(spark, rows):
    known = spark.createDataFrame([("alone",)], "name string")
    asked = roots(spark, "fct", "nowhere", "alone")
    assert rows(lineage.missing_roots(asked, graph(spark, CHAIN), known)) == [("nowhere",)]


def test_impact(spark, rows):
    edges = graph(spark, CHAIN)
    assert ("fct", 2, 3, 2, 2) in rows(lineage.impact(edges))
    assert rows(lineage.impact_of(edges, ["fct", "raw"])) == [("fct", 2, 3, 2, 2), ("raw", 0, 0, 1, 4)]


def test_cycle(spark, rows):
    edges = graph(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    assert rows(lineage.reach(edges, roots(spark, "a")), "node", "depth") == [("a", 3), ("b", 1), ("c", 2)]
    shown = rows(lineage.tree(edges, roots(spark, "a")), "depth", "node")
    assert shown == [(0, "a"), (1, "b"), (2, "c"), (3, "a")]


def test_tree_repeats_nodes_per_path(spark):
    edges = graph(spark, [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a")])
    found = [r.path for r in lineage.tree(edges, roots(spark, "d")).orderBy("path").collect()]
    assert found == [["d"], ["d", "b"], ["d", "b", "a"], ["d", "c"], ["d", "c", "a"]]
    assert lineage.tree(edges, roots(spark, "d"), max_depth=1).count() == 3


def closure(pairs):
    step = {}
    for c, p in pairs:
        step.setdefault(c, set()).add(p)
    out = set()
    for root in step:
        todo, depth = set(step[root]), 1
        seen = {}
        while todo:
            seen.update({n: depth for n in todo})
            todo = {m for n in todo for m in step.get(n, ()) if m not in seen}
            depth += 1
        out |= {(root, n, d) for n, d in seen.items()}
    return sorted(out, key=repr)


def test_reach_of_random_graphs(spark, rows):
    rng = random.Random(3)
    for _ in range(3):
        pairs = [(f"n{rng.randint(0, 25)}", f"n{rng.randint(0, 25)}") for _ in range(45)]
        want = closure(pairs)
        assert rows(lineage.reach(graph(spark, pairs))) == want
        assert rows(lineage.reach(graph(spark, pairs), max_depth=3)) == [w for w in want if w[2] <= 3]
        some = roots(spark, "n1", "n2", "n9")
        assert rows(lineage.reach(graph(spark, pairs), some)) == [w for w in want if w[0] in ("n1", "n2", "n9")]


def pairs_of(pairs):
    found = closure(pairs)
    ups, downs, near = Counter(), Counter(), Counter()
    for root, node, depth in found:
        ups[root] += 1
        downs[node] += 1
        near[root] += depth <= 2
    return ups, downs, near


@pytest.mark.parametrize("how", [{}, {"most_bits": 64}, {"most_edges": 3}])
def test_counts_without_pairs(spark, rows, how):
    rng = random.Random(11)
    pairs = [(f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 40)}") for _ in range(60)]  # cycles and loops among them
    pairs += [(f"c{i}", f"c{i + 1}") for i in range(100)] + [("x", "x"), ("y", "z"), ("y", "z")]
    ups, downs, near = pairs_of(pairs)
    parents, children = Counter(c for c, _ in set(pairs)), Counter(p for _, p in set(pairs))
    want = sorted((n, ups[n], near[n], downs[n], parents[n], children[n]) for n in {x for p in pairs for x in p})
    edges = graph(spark, [*pairs, (None, "n1"), ("n1", None)])
    assert rows(lineage.closure.counts(edges, lineage.reach, 2, **how)) == sorted(want, key=repr)


def test_a_long_chain_takes_a_handful_of_jobs(spark):
    n = 2000
    edges = spark.range(n - 1).selectExpr("concat('n', id) AS child", "concat('n', id + 1) AS parent")
    context = spark.sparkContext
    context.setJobGroup("chain", "impact of a chain")
    found = {r.node: r for r in lineage.impact(edges).collect()}
    jobs = len(context.statusTracker().getJobIdsForGroup("chain"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert all(found[f"n{i}"].total_ancestors == n - 1 - i and found[f"n{i}"].total_dependents == i for i in range(n))
    assert jobs < 150  # rounds of the components, none per level
    assert lineage.impact(edges.filter("false")).collect() == []


def unfolded(pairs, root):
    below = {}
    for c, p in set(pairs):
        below.setdefault(c, []).append(p)

    def walk(node, path):
        yield path
        for p in sorted(below.get(node, ())):
            yield from walk(p, [*path, p])

    return list(walk(root, [root]))


@pytest.mark.parametrize("most_edges", [trees.MOST_EDGES, 2])
def test_pages_of_trees(spark, most_edges):
    rng = random.Random(5)
    pairs = [(f"n{a}", f"n{rng.randint(a + 1, 30)}") for a in range(25) for _ in range(2)]
    placed = trees.layout(graph(spark, pairs), most_edges=most_edges).cache()
    names = ["n0", "n3", "n9", "n30", "absent"]
    want = {n: unfolded(pairs, n) for n in names[:4]}
    assert {r.node: r["size"] for r in trees.sizes(placed).collect() if r.node in want} == {n: len(t) for n, t in want.items()}
    for first, count in ((1, 4), (5, 20), (10**6, 5)):
        got = trees.page(placed, roots(spark, *names), first, count).collect()
        assert sorted((r.root, int(r["rank"]), r.path, r.depth, r.node) for r in got) == sorted(
            (n, i, p, len(p) - 1, p[-1]) for n, t in want.items() for i, p in enumerate(t, 1) if first <= i < first + count
        )


def test_page_of_a_ladder_of_diamonds(spark):
    pairs = [(f"s{i:02d}", f"{x}{i:02d}") for i in range(30) for x in "ab"] + [(f"{x}{i:02d}", f"s{i + 1:02d}") for i in range(30) for x in "ab"]
    placed = trees.layout(graph(spark, pairs)).cache()
    total = 2**30 + 3 * (2**30 - 1)
    assert {r.node: int(r["size"]) for r in trees.sizes(placed).collect()}["s00"] == total
    last = trees.page(placed, roots(spark, "s00"), total - 1, 10).orderBy("rank").collect()
    assert [r.node for r in last] == ["b29", "s30"] and last[0].path[:4] == ["s00", "b00", "s01", "b01"]
    middle = trees.page(placed, roots(spark, "s00"), total // 2 + 1, 2).orderBy("rank").collect()
    assert [r.path[:2] for r in middle] == [["s00", "a00"], ["s00", "b00"]]


def test_layout_leaves_cycles_to_the_full_tree(spark):
    placed = trees.layout(graph(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("d", "e"), ("f", "f")]))
    assert {r.node: r["size"] for r in trees.sizes(placed).collect()} == {"a": None, "b": None, "c": None, "d": 2, "e": 1, "f": None}
    assert [r.root for r in trees.page(placed, roots(spark, "a", "d", "f"), 1, 1).collect()] == ["d"]


def test_rounds_grow_with_the_logarithm_of_the_depth(spark, rows, monkeypatch):
    calls = []
    counted = lineage.cut_counted
    monkeypatch.setattr(lineage, "cut_counted", lambda df: calls.append(1) or counted(df))
    pairs = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)]
    assert rows(lineage.reach(graph(spark, pairs))) == closure(pairs) and len(calls) <= 8


def test_global_rank(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") % 3).alias("score"), F.col("id").cast("string").alias("path"))
    ranked = global_rank(df, [F.desc("score"), F.asc("path")]).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 5001))
    assert [(r.score, r.path) for r in ranked] == sorted([(r.score, r.path) for r in ranked], key=lambda t: (-t[0], t[1]))
