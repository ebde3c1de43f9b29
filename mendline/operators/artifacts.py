"""Run results and manifests: nested JSON artifacts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendline.functions import rules as R
from mendline.functions.text import let, plain_decimal

_ANY = "map<string, variant>"
# The same for documents that no variant can hold: those above 16 MB, or with a key twice.
_RESULTS_TYPE = "results array<struct<unique_id: string, status: string, message: string, execution_time: double>>"
_NODE = "struct<name: string, resource_type: string, source_name: string, depends_on: struct<nodes: array<string>>>"
_MANIFEST_TYPE = f"nodes map<string, {_NODE}>, sources map<string, {_NODE}>, exposures map<string, {_NODE}>"
_ENTRY = "struct<part: string, uid: string, name: string, resource_type: string, source_name: string, deps: array<string>>"
_RESULT = "struct<unique_id: string, status: string, message: string, execution_time: double>"


def _document(content: Column) -> Column:
    """The parsed document; null where it is no JSON, or none that a variant can hold. What does not have the expected type later loses itself only."""
    return F.try_parse_json(content)


def _kind(path: Column, document: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))

    def of(keys: Column) -> Column:
        return (
            F.when(keys.isNull(), "invalid")
            .when(F.contains(name, F.lit("run_results")) | F.array_contains(keys, "results"), "run_results")
            .when(F.array_contains(keys, "nodes") | F.array_contains(keys, "sources"), "manifest")
            .otherwise("unrecognized")
        )

    keys = F.when(document.isNull(), F.json_object_keys("content")).otherwise(F.map_keys(F.try_variant_get(document, "$", _ANY)))
    return let(keys, of)


def classify_artifacts(files: DataFrame) -> DataFrame:
    """Adds ``kind``: run_results (by file name or ``results`` key), manifest, unrecognized or invalid (no JSON object)."""
    return files.withColumn("kind", let(_document(F.col("content")), lambda d: _kind(F.col("path"), d)))


def run_results(files: DataFrame) -> DataFrame:
    """One row per executed node of each run-results artifact of ``files(path, content)``; ``run_id`` is the path.

    Other artifacts have no rows. A document is parsed once; a field of another type is null.
    """

    def rows(document: Column) -> Column:
        field = lambda r, name, kind: F.try_variant_get(r, f"$.{name}", kind).alias(name)
        listed = F.transform(
            F.try_variant_get(document, "$.results", "array<variant>"),
            lambda r: F.struct(*[field(r, n, "string") for n in ("unique_id", "status", "message")], field(r, "execution_time", "double")),
        )
        typed = F.from_json("content", _RESULTS_TYPE)["results"]
        return F.when(_kind(F.col("path"), document) == "run_results", F.when(document.isNull(), typed).otherwise(listed)).otherwise(F.array().cast(f"array<{_RESULT}>"))

    found = files.select(F.col("path").alias("run_id"), F.explode(let(_document(F.col("content")), rows)).alias("r"))
    return found.select("run_id", "r.*")


def run_summary(results: DataFrame) -> DataFrame:
    """Executed, succeeded, warned and failed nodes per run. A missing status counts as failed."""
    status = F.coalesce("status", F.lit(""))
    return results.groupBy("run_id").agg(
        F.count("*").alias("n_executed"),
        F.count_if(status.isin(R.PASSED)).alias("n_succeeded"),
        F.count_if(status.isin(R.WARNED)).alias("n_warned"),
        F.count_if(~status.isin(R.PASSED + R.WARNED)).alias("n_failed"),
    )


def failed_nodes(results: DataFrame, message_chars: int | None = None) -> DataFrame:
    """Nodes that neither passed nor warned; the time is null where it is zero or absent.

    ``message_chars`` cuts the messages, ``rules.MESSAGE_CHARS`` by custom.
    """
    message = F.col("message") if message_chars is None else F.left("message", F.lit(message_chars))
    status = F.coalesce("status", F.lit(""))
    return results.filter(~status.isin(R.PASSED + R.WARNED)).select(
        "run_id",
        F.coalesce("unique_id", F.lit("unknown")).alias("node"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.when(F.col("execution_time") != 0, plain_decimal(F.col("execution_time"))).alias("seconds"),
        message.alias("message"),
    )


def run_findings(results: DataFrame) -> DataFrame:
    """Failed nodes and warnings of each run as findings."""
    status = F.coalesce("status", F.lit(""))
    return (
        results.filter(~status.isin(R.PASSED))
        .groupBy("run_id", status.isin(R.WARNED).alias("warned"))
        .agg(F.count("*").alias("n"), F.min("unique_id").alias("evidence"))
        .select(
            F.lit("run").alias("family"),
            F.col("run_id").alias("artifact"),
            F.when(F.col("warned"), "node_warned").otherwise("node_failed").alias("rule_id"),
            F.when(F.col("warned"), "WARN").otherwise("ERROR").alias("severity"),
            "n",
            "evidence",
        )
    )


def _entries(path: Column, document: Column) -> Column:
    """The entries of a manifest as an array; none for other documents."""
    text = lambda v, name: F.try_variant_get(v, f"$.{name}", "string").alias(name)

    def part(name: str) -> Column:
        members = F.map_entries(F.coalesce(F.try_variant_get(document, f"$.{name}", _ANY), F.create_map().cast(_ANY)))
        return F.transform(
            members,
            lambda e: F.struct(
                F.lit(name).alias("part"),
                e["key"].alias("uid"),
                text(e["value"], "name"),
                text(e["value"], "resource_type"),
                text(e["value"], "source_name"),
                F.coalesce(F.try_variant_get(e["value"], "$.depends_on.nodes", "array<string>"), F.array().cast("array<string>")).alias("deps"),
            ),
        )

    def typed_part(typed: Column, name: str) -> Column:
        return F.transform(
            F.map_entries(F.coalesce(typed[name], F.create_map().cast(f"map<string, {_NODE}>"))),
            lambda e: F.struct(
                F.lit(name).alias("part"),
                e["key"].alias("uid"),
                *[e["value"][c].alias(c) for c in ("name", "resource_type", "source_name")],
                F.coalesce(e["value"]["depends_on"]["nodes"], F.array().cast("array<string>")).alias("deps"),
            ),
        )

    parts = ("nodes", "sources", "exposures")
    typed = let(F.from_json("content", _MANIFEST_TYPE), lambda t: F.concat(*[typed_part(t, p) for p in parts]))
    found = F.when(document.isNull(), typed).otherwise(F.concat(*[part(p) for p in parts]))
    return F.when(_kind(path, document) == "manifest", found).otherwise(F.array().cast(f"array<{_ENTRY}>"))


def manifest_entries(files: DataFrame) -> DataFrame:
    """``(path, entries)`` of the manifests among ``files(path, content)``: an array of structs. A document is parsed once."""
    entries = let(_document(F.col("content")), lambda d: _entries(F.col("path"), d))
    return files.select("path", entries.alias("entries")).filter(F.size("entries") > 0)


def manifest_nodes(files: DataFrame) -> DataFrame:
    """All entries of nodes, sources and exposures with their dependency uids, one row per entry.

    An entry of another type than an object keeps its uid and loses the rest; a part of another type has no entries.
    """
    entries = let(_document(F.col("content")), lambda d: _entries(F.col("path"), d))
    return files.select("path", F.explode(entries).alias("e")).select("path", "e.*")


def manifest_summary(entries: DataFrame) -> DataFrame:
    """Models, tests, sources and exposures per manifest."""
    node = F.col("part") == "nodes"
    return entries.groupBy("path").agg(
        F.count_if(node & (F.col("resource_type") == "model")).alias("n_models"),
        F.count_if(node & (F.col("resource_type") == "test")).alias("n_tests"),
        F.count_if(F.col("part") == "sources").alias("n_sources"),
        F.count_if(F.col("part") == "exposures").alias("n_exposures"),
    )


def model_dependencies(entries: DataFrame) -> DataFrame:
    """Each model with the short names of its dependencies, ``none`` where it has none."""
    short = lambda uid: F.element_at(F.split(uid, "\\."), -1)
    deps = F.array_join(F.transform("deps", short), ", ")
    return entries.filter((F.col("part") == "nodes") & (F.col("resource_type") == "model")).select(
        "path",
        short(F.col("uid")).alias("model"),
        F.when(F.size("deps") == 0, "none").otherwise(deps).alias("depends_on"),
    )
