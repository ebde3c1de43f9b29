"""Lineage over ``edges(child, parent)`` tables: edges, node types, reachability, impact, paths.

The closure of all nodes doubles the known depth in every round; traversals from given roots go breadth first. Each round's pairs are
written to the checkpoint folder, so a lost executor costs one round and plans stay short.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendline.functions import rules as R
from mendline.functions.scale import cut, cut_counted, grows
from mendline.functions.text import FLAGS, hits
from mendline.operators import artifacts, closure

# --- graph construction -----------------------------------------------------------------------


def _with_names(entries: DataFrame) -> DataFrame:
    """Sources are called ``source.name``, other entries by their name or the last part of the uid."""
    own = F.coalesce("name", F.element_at(F.split("uid", "\\."), -1))
    source = F.concat(F.coalesce("source_name", F.lit("")), F.lit("."), F.coalesce("name", F.lit("")))
    return entries.withColumn("name", F.when(F.col("part") == "sources", source).otherwise(own))


def manifest_names(entries: DataFrame) -> DataFrame:
    """``(path, uid, name, type)`` of all entries of manifests."""
    kind = (
        F.when(F.col("part") == "sources", "source")
        .when(F.col("part") == "exposures", "exposure")
        .otherwise(F.coalesce("resource_type", F.lit("model")))
    )
    return _with_names(entries).select("path", "uid", "name", kind.alias("type"))


def manifest_edges(entries: DataFrame) -> DataFrame:
    """Distinct ``(path, child_uid, child, parent_uid, parent)`` edges of manifests.

    A dependency takes the name of its source or node, or the last part of its uid when the manifest
    does not hold it. Sources win over nodes of the same uid. Edges stay keyed by uid, so equal short names
    do not merge. The lookup stays within a manifest, which was one row when it was read.
    """
    none = F.lit(None).cast("string")
    part, uid, name = F.col("part"), F.col("uid"), F.col("name")

    def row(key: Column, known: Column, child_uid: Column, child: Column) -> Column:
        return F.struct(key.alias("parent_uid"), known.alias("known"), child_uid.alias("child_uid"), child.alias("child"))

    # A manifest is parsed once: each entry gives a row for itself, as a possible parent, and one per dependency.
    # Dependencies are looked up among sources and nodes, never among exposures.
    itself = F.struct(part.alias("part"), name.alias("name"))
    unknown = F.lit(None).cast("struct<part: string, name: string>")
    own = F.array_compact(F.array(F.when(part != "exposures", row(uid, itself, none, none))))
    needed = F.when(part == "sources", F.array().cast("array<string>")).otherwise(F.array_distinct("deps"))
    uses = F.transform(needed, lambda d: row(d, unknown, uid, name))
    rows = _with_names(entries).select("path", F.explode(F.concat(own, uses)).alias("r")).select("path", "r.*")
    best = F.max("known").over(Window.partitionBy("path", "parent_uid"))
    return (
        rows.withColumn("parent", F.coalesce(best["name"], F.element_at(F.split("parent_uid", "\\."), -1)))
        .filter(F.col("child_uid").isNotNull())
        .select("path", "child_uid", "child", "parent_uid", "parent")
    )


def manifest_file_edges(files: DataFrame) -> DataFrame:
    """``manifest_edges`` of the manifests among ``files(path, content)``, looked up inside their rows: nothing is shuffled.

    Entries and dependencies of a manifest are sorted by uid, so that a dependency follows the entry it names.
    """
    none = F.lit(None).cast("string")
    last = lambda uid: F.element_at(F.split(uid, "\\."), -1)
    shown = lambda e: F.when(
        e["part"] == "sources", F.concat(F.coalesce(e["source_name"], F.lit("")), F.lit("."), F.coalesce(e["name"], F.lit("")))
    ).otherwise(F.coalesce(e["name"], last(e["uid"])))

    def row(uid: Column, rank: Column, name: Column, child_uid: Column) -> Column:
        return F.struct(uid.alias("uid"), rank.alias("rank"), name.alias("name"), child_uid.alias("child_uid"))

    own = F.transform(
        F.filter("entries", lambda e: e["part"] != "exposures"), lambda e: row(e["uid"], F.when(e["part"] == "sources", 0).otherwise(1), shown(e), none)
    )
    uses = F.transform(
        F.filter("entries", lambda e: e["part"] != "sources"),
        lambda e: F.transform(F.array_distinct(e["deps"]), lambda d: row(d, F.lit(2), shown(e), e["uid"])),
    )
    listed = artifacts.manifest_entries(files).select("path", F.array_sort(F.concat(own, F.flatten(uses))).alias("rows"))
    rows = listed.filter(F.size("rows") > 0)
    at = lambda i: F.get("rows", i)
    starts = F.filter(F.sequence(F.lit(0), F.size("rows") - 1), lambda i: (i == 0) | ~at(i)["uid"].eqNullSafe(at(i - 1)["uid"]))
    begun = rows.select("path", "rows", starts.alias("starts"))

    def run(start: Column, j: Column) -> Column:
        whole = F.slice("rows", start + 1, F.coalesce(F.get("starts", j + 1), F.size("rows")) - start)
        known = F.when(at(start)["rank"] < 2, at(start)["name"])
        return F.transform(
            F.filter(whole, lambda r: r["rank"] == 2),
            lambda r: F.struct(
                r["child_uid"].alias("child_uid"), r["name"].alias("child"), r["uid"].alias("parent_uid"), F.coalesce(known, last(r["uid"])).alias("parent")
            ),
        )

    return begun.select("path", F.explode(F.flatten(F.transform("starts", run))).alias("e")).select("path", "e.*")


def manifest_impact(edges: DataFrame) -> DataFrame:
    """``(path, uid, name, direct_parents, total_ancestors, direct_children, total_dependents)`` of the nodes of manifests.

    A manifest's graph is taken as it is, without looking for its components, unless it is too large for a task.
    """
    keyed = edges.select(F.xxhash64("path").alias("part"), node_key("path", "child_uid").alias("child"), node_key("path", "parent_uid").alias("parent"))
    found = closure.counts_in_parts(keyed, reach)
    names = ("direct_parents", "total_ancestors", "direct_children", "total_dependents")
    return named(found.select("node", *[F.col(c).alias(n) for c, n in zip(("direct_up", "up", "direct_down", "down"), names)]), edges)


def keyed_edges(edges: DataFrame) -> DataFrame:
    """``(child, parent)`` of manifest edges with nodes keyed by manifest and uid, so that graphs of different manifests stay apart."""
    return edges.select(node_key("path", "child_uid").alias("child"), node_key("path", "parent_uid").alias("parent")).distinct()


def node_key(path: str, uid: str) -> Column:
    return F.concat(F.col(path), F.lit("#"), F.col(uid))


def named(nodes: DataFrame, edges: DataFrame, key: str = "node") -> DataFrame:
    """``nodes`` with ``path``, ``uid`` and ``name`` in place of the key; ``edges`` are the manifest edges."""
    ends = F.array(
        F.struct("path", F.col("child_uid").alias("uid"), F.col("child").alias("name")),
        F.struct("path", F.col("parent_uid").alias("uid"), F.col("parent").alias("name")),
    )
    known = edges.select(F.explode(ends).alias("e")).select("e.*").groupBy("path", "uid").agg(F.min("name").alias("name"))
    return nodes.join(known.withColumn(key, node_key("path", "uid")), key).drop(key)


def sql_edges(models: DataFrame) -> DataFrame:
    """Distinct edges from ``ref`` and ``source`` calls in ``models(name, sql)``; sources are ``source.table``."""
    sql = F.col("sql")
    refs = hits(sql, R.REF_BLOCK, 1)
    part = lambda m, group: F.regexp_extract(m, FLAGS + R.SOURCE_BLOCK, group)
    sources = F.transform(hits(sql, R.SOURCE_BLOCK), lambda m: F.concat(part(m, 1), F.lit("."), part(m, 2)))
    tagged = F.concat(
        F.transform(refs, lambda r: F.struct(r.alias("parent"), F.lit("model").alias("parent_type"))),
        F.transform(sources, lambda s: F.struct(s.alias("parent"), F.lit("source").alias("parent_type"))),
    )
    return models.select(F.col("name").alias("child"), F.explode(F.array_distinct(tagged)).alias("p")).select(
        "child", "p.parent", "p.parent_type"
    ).distinct()


def node_types(known: DataFrame, edges: DataFrame) -> DataFrame:
    """``(name, type, label)`` of every node: the given type, ``model`` where none is known.

    Of several types the source wins, then the exposure.
    """
    ends = edges.select(F.explode(F.array("child", "parent")).alias("name"), F.lit(None).cast("string").alias("type"))
    rank = F.when(F.col("type") == "source", 3).when(F.col("type") == "exposure", 2).when(F.col("type").isNotNull(), 1).otherwise(0)
    typed = (
        known.select("name", "type")
        .unionByName(ends)
        .groupBy("name")
        .agg(F.coalesce(F.max(F.struct(rank.alias("r"), "type"))["type"], F.lit("model")).alias("type"))
    )
    label = F.when(
        F.col("type").isin("source", "exposure"), F.concat("name", F.lit(" ["), "type", F.lit("]"))
    ).otherwise(F.col("name"))
    return typed.withColumn("label", label)


#: Rows of a frontier that go to all tasks; larger ones meet the steps by a shuffle. A broadcast of strings counts as a page of 64 MB at least.
MOST_BROADCAST = 100

# --- traversal --------------------------------------------------------------------------------


def _steps(edges: DataFrame, upstream: bool) -> DataFrame:
    here, there = ("child", "parent") if upstream else ("parent", "child")
    return edges.select(F.col(here).alias("node"), F.col(there).alias("next")).distinct()


def _least(found: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of ``found`` that ``known`` does not hold, with their least depth; one aggregation removes repeats and known ones."""
    both = found.select("root", "node", "depth").unionByName(known.select("root", "node", F.lit(0).alias("depth")))
    return both.groupBy("root", "node").agg(F.min("depth").alias("depth")).filter("depth > 0")


def reach(
    edges: DataFrame, roots: DataFrame | None = None, upstream: bool = True, max_depth: int = -1
) -> DataFrame:
    """``(root, node, depth)``: every node reachable from each root with its least depth.

    ``roots(root)`` names the start nodes; ``None`` is the explicit wish for the closure of all nodes, whose size is that of all pairs. ``max_depth``
    -1 is unlimited. A root on a cycle reaches itself.
    """
    if max_depth == 0:
        return _steps(edges, upstream).select(F.col("node").alias("root"), F.col("next").alias("node"), F.lit(1).alias("depth")).limit(0)
    return _all_pairs(edges, upstream, max_depth) if roots is None else _from_roots(edges, roots, upstream, max_depth)


def _all_pairs(edges: DataFrame, upstream: bool, max_depth: int) -> DataFrame:
    """The closure by doubling: rounds grow with the logarithm of the depth.

    After a round all pairs up to depth k are known. A shortest way of k + 1 to 2k steps begins with one of k steps exactly, so only the
    pairs of depth k are extended, by all known ones.
    """
    steps = _steps(edges, upstream)
    known, size = cut_counted(steps.select(F.col("node").alias("root"), F.col("next").alias("node"), F.lit(1).alias("depth")))
    k = 1
    while size and (max_depth == -1 or k < max_depth):
        onward = known.select(F.col("root").alias("node"), F.col("node").alias("next"), F.col("depth").alias("more"))
        if max_depth != -1:
            onward = onward.filter(F.col("more") <= max_depth - k)
        last = known.filter(F.col("depth") == k).select("root", "node")
        found = last.join(grows(onward), "node").select("root", F.col("next").alias("node"), (F.lit(k) + F.col("more")).alias("depth"))
        fresh, size = cut_counted(_least(found, known))
        known = cut(known.unionByName(fresh)) if size else known
        k *= 2
    return known


def _from_roots(edges: DataFrame, roots: DataFrame, upstream: bool, max_depth: int) -> DataFrame:
    """Breadth first from given roots: what moves is the pairs of these roots only."""
    steps = cut(_steps(edges, upstream))
    start = steps.withColumnRenamed("node", "root").join(grows(roots.select("root").distinct()), "root", "left_semi")
    depth = 1
    frontier, size = cut_counted(start.select("root", F.col("next").alias("node"), F.lit(depth).alias("depth")))
    known = frontier
    while size and depth != max_depth:
        depth += 1
        ends = frontier.select("root", "node")
        ends = F.broadcast(ends) if size <= MOST_BROADCAST else grows(ends)
        found = steps.join(ends, "node").select("root", F.col("next").alias("node"), F.lit(depth).alias("depth"))
        frontier, size = cut_counted(_least(found, known))
        known = cut(known.unionByName(frontier)) if size else known
    return known


def reach_counts(pairs: DataFrame, all_nodes: DataFrame, max_depth: int = -1) -> DataFrame:
    """Nodes within ``max_depth`` and in total for each root; roots that reach nothing count 0."""
    inside = F.lit(True) if max_depth == -1 else F.col("depth") <= max_depth
    counts = pairs.groupBy("root").agg(F.count("*").alias("n_total"), F.count_if(inside).alias("n_within_depth"))
    return (
        all_nodes.select(F.col("name").alias("root"))
        .distinct()
        .join(counts, "root", "left")
        .select(
            "root",
            F.coalesce("n_within_depth", F.lit(0)).alias("n_within_depth"),
            F.coalesce("n_total", F.lit(0)).alias("n_total"),
        )
    )


def reach_counts_of(edges: DataFrame, all_nodes: DataFrame, max_depth: int = -1) -> DataFrame:
    """``reach_counts`` of a whole graph, without its pairs."""
    found = closure.counts(edges, reach, max_depth).select(
        F.col("node").alias("root"), F.col("up_within").alias("n_within_depth"), F.col("up").alias("n_total")
    )
    roots = all_nodes.select(F.col("name").alias("root")).distinct()
    return roots.join(grows(found), "root", "left").na.fill(0, ["n_within_depth", "n_total"])


def impact(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Direct parents, all ancestors, direct children and all dependents of every node.

    Counted without the pairs, unless they are given: then they are grouped by either end, and a pair at depth 1 is a direct edge.
    """
    names = ("direct_parents", "total_ancestors", "direct_children", "total_dependents")
    if pairs is None:
        found = closure.counts(edges, reach)
        return found.select("node", *[F.col(c).alias(n) for c, n in zip(("direct_up", "up", "direct_down", "down"), names)])
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("root").alias("node"), F.lit(True).alias("up"), F.col("depth").alias("depth")),
                F.struct(F.col("node").alias("node"), F.lit(False).alias("up"), F.col("depth").alias("depth")),
            )
        ).alias("s")
    ).select("s.*")
    up, direct = F.col("up"), F.col("depth") == 1
    counted = (F.count_if(up & direct), F.count_if(up), F.count_if(~up & direct), F.count_if(~up))
    return sides.groupBy("node").agg(*[c.alias(n) for c, n in zip(counted, names)])


def impact_of(edges: DataFrame, roots: Iterable[str]) -> DataFrame:
    """``impact`` for a few named nodes: two traversals from them instead of the whole closure."""
    spark = edges.sparkSession
    wanted = spark.createDataFrame([(r,) for r in roots], "root string")
    out = wanted
    for upstream, near, total in (
        (True, "direct_parents", "total_ancestors"),
        (False, "direct_children", "total_dependents"),
    ):
        counts = (
            reach(edges, wanted, upstream)
            .groupBy("root")
            .agg(F.count_if(F.col("depth") == 1).alias(near), F.count("*").alias(total))
        )
        out = out.join(counts, "root", "left")
    return out.na.fill(0).withColumnRenamed("root", "node")


def missing_roots(roots: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Requested roots that are no node of the graph."""
    nodes = edges.select(F.explode(F.array("child", "parent")).alias("root"))
    if known is not None:
        nodes = nodes.unionByName(known.select(F.col("name").alias("root")))
    return roots.select("root").distinct().join(nodes.distinct(), "root", "left_anti")


def lineage(
    edges: DataFrame, roots: DataFrame, direction: str = "both", max_depth: int = -1
) -> DataFrame:
    """``(direction, root, node, depth)`` for the roots, upstream, downstream or both."""
    if direction not in ("upstream", "downstream", "both"):
        raise ValueError("direction must be upstream, downstream or both")
    sides = ["upstream", "downstream"] if direction == "both" else [direction]
    return reduce(
        DataFrame.unionByName,
        [
            reach(edges, roots, side == "upstream", max_depth).select(F.lit(side).alias("direction"), "root", "node", "depth")
            for side in sides
        ],
    )


def tree(edges: DataFrame, roots: DataFrame, upstream: bool = True, max_depth: int = -1) -> DataFrame:
    """The lineage tree of each root, one row per tree node: ``(root, node, depth, path)``.

    A node appears once per path that leads to it; sorting by ``path`` gives pre-order with siblings by name.
    A node already on its own path is shown but not expanded, so cycles end.
    """
    steps = cut(_steps(edges, upstream))
    root = F.col("root")
    frontier, size = cut_counted(
        roots.select("root")
        .distinct()
        .select("root", root.alias("node"), F.lit(0).alias("depth"), F.array("root").alias("path"), F.lit(True).alias("open"))
    )
    depth, shown = 0, frontier
    while size > 0 and depth != max_depth:
        depth += 1
        reached = frontier.filter("open").join(steps, "node")
        frontier, size = cut_counted(
            reached.select(
                "root",
                F.col("next").alias("node"),
                F.lit(depth).alias("depth"),
                F.concat("path", F.array("next")).alias("path"),
                (~F.array_contains("path", F.col("next"))).alias("open"),
            )
        )
        shown = shown.unionByName(frontier)
    return shown.drop("open")
