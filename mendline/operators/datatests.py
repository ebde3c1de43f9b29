"""Data tests: inferred from column names, evaluated on tables of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendline.functions import rules as R
from mendline.functions.scale import grows

TEST_COLUMNS = ["model", "column", "test", "ref_model", "ref_field", "accepted"]


# --- inference --------------------------------------------------------------------------------


def _ends_with_any(name: Column, endings: Sequence[str]) -> Column:
    test = F.lit(False)
    for e in endings:
        test = test | F.endswith(name, F.lit(e))
    return test


def _starts_with_any(name: Column, starts: Sequence[str]) -> Column:
    test = F.lit(False)
    for s in starts:
        test = test | F.startswith(name, F.lit(s))
    return test


def column_role(model: Column, column: Column) -> Column:
    """The first naming rule a column meets: key, reference, category, time, measure, email, count or other."""
    name = F.lower(column)
    measure = F.lit(False)
    for word in R.MEASURE_WORDS:
        measure = measure | F.contains(name, F.lit(word))
    return (
        F.when(
            (name == "id") | (name == F.concat(model, F.lit("_id"))) | _starts_with_any(name, ["surrogate_", "pk_"]), "key"
        )
        .when(F.endswith(name, F.lit("_id")), "reference")
        .when(name.isin(R.CATEGORY_WORDS) | _ends_with_any(name, ["_" + w for w in R.CATEGORY_WORDS]), "category")
        .when(_ends_with_any(name, R.TIME_ENDINGS), "time")
        .when(measure, "measure")
        .when((name == "email") | F.endswith(name, F.lit("_email")), "email")
        .when(_starts_with_any(name, R.COUNT_STARTS) | F.endswith(name, F.lit("_count")), "count")
        .otherwise("other")
    )


def _candidates(column: Column) -> Column:
    """Model names a reference column may point to, best first."""
    base = F.regexp_replace(F.lower(column), F.lit("_id$"), F.lit(""))
    plural = F.concat(base, F.lit("s"))
    names = [base, plural, F.regexp_replace(base, F.lit("s+$"), F.lit(""))]
    for prefix in R.MODEL_PREFIXES:
        names += [F.concat(F.lit(prefix), base), F.concat(F.lit(prefix), plural)]
    return F.array(*names)


def _ref_field(column: Column, ref: Column) -> Column:
    name = F.lower(column)
    return F.when(F.concat(ref, F.lit("_id")) == name, "id").otherwise(
        F.replace(name, F.concat(ref, F.lit("_")), F.lit(""))
    )


def infer_references(columns: DataFrame, shared: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Target model and field of each ``…_id`` column of ``columns(model, column)``.

    ``shared(name)`` holds the models known to all, ``own(model, name)`` those a model's SQL refers to. The
    answer from the shared models depends on the column name alone, so it is looked up once per distinct name;
    the own references are matched within their model. The better-placed candidate of the two wins.
    """
    refs = columns.filter(column_role(F.col("model"), F.col("column")) == "reference").select("model", "column")
    name = F.lower("column").alias("name_lower")
    per_name = (
        refs.select(name)
        .distinct()
        .select("name_lower", F.posexplode(_candidates(F.col("name_lower"))).alias("pos", "name"))
        .join(grows(shared.select("name").distinct()), "name")
        .groupBy("name_lower")
        .agg(F.min(F.struct("pos", "name")).alias("shared_hit"))
    )
    # One name may stand for much of the columns; adaptive execution splits that side of the join.
    found = refs.withColumn("name_lower", F.lower("column")).join(grows(per_name), "name_lower", "left")
    best = F.col("shared_hit")
    if own is not None:
        per_model = (
            refs.select("model", "column", F.posexplode(_candidates(F.col("column"))).alias("pos", "name"))
            .join(grows(own.select("model", "name").distinct()), ["model", "name"])
            .groupBy("model", "column")
            .agg(F.min(F.struct("pos", "name")).alias("own_hit"))
        )
        found = found.join(grows(per_model), ["model", "column"], "left")
        best = F.least("shared_hit", "own_hit")
    return found.select("model", "column", best["name"].alias("ref_model")).select(
        "model", "column", "ref_model", _ref_field(F.col("column"), F.col("ref_model")).alias("ref_field")
    )


def infer_tests(
    columns: DataFrame,
    shared_models: DataFrame | None = None,
    own_models: DataFrame | None = None,
    hints: DataFrame | None = None,
) -> DataFrame:
    """Tests for ``columns(model, column)`` by naming rules, one row per test.

    ``hints(model, column, accepted)`` gives the accepted values of category columns, lower-cased names.
    """
    role = column_role(F.col("model"), F.col("column"))
    base = columns.select("model", "column", role.alias("role"))
    if shared_models is not None:
        targets = infer_references(columns, shared_models, own_models)
        base = base.join(grows(targets), ["model", "column"], "left")
    else:
        base = base.withColumns({"ref_model": F.lit(None).cast("string"), "ref_field": F.lit(None).cast("string")})
    if hints is not None:
        base = base.withColumn("hint_key", F.lower("column")).join(
            grows(hints.select("model", F.col("column").alias("hint_key"), "accepted")), ["model", "hint_key"], "left"
        )
    else:
        base = base.withColumn("accepted", F.lit(None).cast("array<string>"))
    role = F.col("role")
    tests = F.array_compact(
        F.array(
            F.when(role.isin("key", "email"), "unique"),
            F.when(role != "other", "not_null"),
            F.when((role == "reference") & F.col("ref_model").isNotNull(), "relationships"),
            F.when((role == "category") & (F.size("accepted") > 0), "accepted_values"),
        )
    )
    test = F.col("test")
    return base.select("*", F.explode(tests).alias("test")).select(
        "model",
        "column",
        "test",
        F.when(test == "relationships", F.col("ref_model")).alias("ref_model"),
        F.when(test == "relationships", F.col("ref_field")).alias("ref_field"),
        F.when(test == "accepted_values", F.col("accepted")).alias("accepted"),
    )


def table_columns(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(model, column)`` of analysed tables: schema only, no data is read."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(
        [(m, c) for m, df in tables.items() for c in df.columns], "model string, column string"
    )


# --- evaluation -------------------------------------------------------------------------------


def check_not_null(table: DataFrame, model: str, columns: Sequence[str]) -> DataFrame:
    """Null counts of all ``columns`` in one pass over the table."""
    counts = table.agg(
        F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)]
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_failed")) for i, c in enumerate(columns)])
    return counts.select("n_rows", F.explode(pairs).alias("p")).select(
        F.lit(model).alias("model"), F.col("p.column").alias("column"), F.lit("not_null").alias("test"), "n_rows", "p.n_failed"
    )


def duplicate_keys(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys occurring more than once, with their count. Rows with a null in the key are left out."""
    return (
        table.select(*columns).na.drop(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
    )


def check_unique(table: DataFrame, model: str, columns: Sequence[str]) -> DataFrame:
    """Number of duplicated keys and of the rows that hold them."""
    return duplicate_keys(table, columns).agg(
        F.count("*").alias("n_keys"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_failed")
    ).select(F.lit(model).alias("model"), F.lit(",".join(columns)).alias("column"), F.lit("unique").alias("test"), "n_keys", "n_failed")


def unaccepted_values(table: DataFrame, column: str, accepted: Sequence | DataFrame) -> DataFrame:
    """Values outside ``accepted`` with their row counts; nulls pass.

    Rows are counted per value first, so only distinct values meet the accepted ones.
    """
    counts = table.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows"))
    if isinstance(accepted, DataFrame):
        return counts.join(accepted.select(F.col(accepted.columns[0]).alias("value")).distinct(), "value", "left_anti")
    return counts.filter(~F.col("value").isin(list(accepted)))


def observed_values(table: DataFrame, columns: Sequence[str], at_most: int) -> DataFrame:
    """Accepted values read off the data: sorted distinct values of columns with no more than ``at_most``.

    One row per column; ``accepted`` is null for a column with more values, and empty for one with none.

    A sketch of each column, one row for the whole table, first rules out the columns with many values, so that keys are
    never shuffled. A sketch of 4k registers or more reads at most 1.2k for k values, so no column within the
    limit is ruled out. The others are counted exactly.
    """
    error = min(0.05, 1.1 / (4 * at_most) ** 0.5)
    sketch = table.agg(*[F.approx_count_distinct(c, error).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    few = [c for i, c in enumerate(columns) if sketch[i] <= 2 * at_most]
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in few]
    pairs = pairs or [F.struct(F.lit("").alias("column"), F.lit(None).cast("string").alias("value"))]
    long = table.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").filter(F.col("value").isNotNull())
    values = long.groupBy("column", "value").agg(F.count("*").alias("n_rows"))
    sizes = values.groupBy("column").agg(F.count("*").alias("n_values"))
    small = sizes.filter(F.col("n_values") <= at_most)
    kept = values.join(small, "column", "left_semi").groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("accepted"))
    listed = table.sparkSession.createDataFrame([(c, c in few) for c in columns], "column string, few boolean")
    empty = F.col("few") & F.col("n_values").isNull()
    return (
        listed.join(sizes, "column", "left")
        .join(kept, "column", "left")
        .select("column", F.when(empty, F.array().cast("array<string>")).otherwise(F.col("accepted")).alias("accepted"))
    )


def orphan_keys(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child keys without a parent, with their row counts; null keys pass.

    Child rows are counted per key before the anti join, so a key holding much of the table is one row there.
    """
    keys = child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("key")).agg(F.count("*").alias("n_rows"))
    return keys.join(parent.select(F.col(parent_key).alias("key")).distinct(), "key", "left_anti")


def check_total(failing: DataFrame, model: str, column: str, test: str) -> DataFrame:
    """Failing keys or values of one test as a single result row."""
    return failing.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_failed")).select(
        F.lit(model).alias("model"), F.lit(column).alias("column"), F.lit(test).alias("test"), "n_keys", "n_failed"
    )


def _row_tests(table: DataFrame, tests: Sequence[tuple[int, Mapping]]) -> DataFrame:
    """``(id, n_keys, n_failed)`` of the not-null and accepted-value tests of one table, in one pass over it.

    Only failing rows leave the scan, counted per value before anything is shuffled. Tests without one give no row.
    """
    failing, fails = [], F.lit(False)
    for no, t in tests:
        value = F.col(t["column"])
        bad = value.isNull() if t["test"] == "not_null" else value.isNotNull() & ~value.isin(list(t["accepted"]))
        failing.append(F.when(bad, F.struct(F.lit(no).alias("id"), value.cast("string").alias("value"))))
        fails = fails | bad
    found = table.filter(fails).select(F.explode(F.array_compact(F.array(*failing))).alias("f")).groupBy("f.id", "f.value").agg(F.count("*").alias("n"))
    keys = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(1))
    return found.groupBy("id").agg(keys.alias("n_keys"), F.sum("n").alias("n_failed"))


def _key_tests(tables: Mapping[str, DataFrame], model: str, column: str, tests: Sequence[tuple[int, Mapping]]) -> list[DataFrame]:
    """``(id, n_keys, n_failed)`` of the uniqueness and relationship tests of one column, all from one count per key."""
    keys = tables[model].filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n_rows"))
    out = []
    for no, t in tests:
        if t["test"] == "unique":
            failing = keys.filter("n_rows > 1")
        else:
            parents = tables[t["ref_model"]].select(F.col(t["ref_field"]).alias("key")).distinct()
            failing = keys.join(parents, "key", "left_anti")
        out.append(failing.agg(F.lit(no).alias("id"), F.count("*").alias("n_keys"), F.sum("n_rows").alias("n_failed")))
    return out


def _missing(tables: Mapping[str, DataFrame], t: Mapping) -> bool:
    ends = [(t["model"], t["column"])] + ([(t["ref_model"], t["ref_field"])] if t["test"] == "relationships" else [])
    return any(m not in tables or c not in tables[m].columns for m, c in ends)


def run_tests(tables: Mapping[str, DataFrame], tests: Sequence[Mapping]) -> DataFrame:
    """Evaluate a test list on ``tables``: one row per test with its failing keys and rows and its ``status``.

    ``tests`` is the (small) test definition table as rows. A table is read once for all its not-null and accepted-value tests, and
    once for each column with uniqueness or relationship tests. A test whose table or column is absent is ``not_evaluable``
    with null counts; the others are ``passed`` or ``failed``.
    """
    spark = next(iter(tables.values())).sparkSession
    by_row: dict[str, list] = {}
    by_key: dict[tuple[str, str], list] = {}
    absent = set()
    for no, t in enumerate(tests):
        if t["test"] not in ("not_null", "unique", "accepted_values", "relationships"):
            raise ValueError(f"unknown test {t['test']!r}")
        if _missing(tables, t):
            absent.add(no)
        elif t["test"] in ("not_null", "accepted_values"):
            by_row.setdefault(t["model"], []).append((no, t))
        else:
            by_key.setdefault((t["model"], t["column"]), []).append((no, t))
    parts = [_row_tests(tables[m], some) for m, some in by_row.items()]
    parts += [p for (m, c), some in by_key.items() for p in _key_tests(tables, m, c, some)]
    listed = spark.createDataFrame(
        [(no, t["model"], t["column"], t["test"], no in absent) for no, t in enumerate(tests)],
        "id int, model string, column string, test string, absent boolean",
    )
    none = spark.createDataFrame([], "id int, n_keys long, n_failed long")
    counts = reduce(DataFrame.unionByName, parts, none)
    known = lambda c: F.when(~F.col("absent"), F.coalesce(c, F.lit(0)).cast("bigint")).alias(c)
    status = F.when(F.col("absent"), "not_evaluable").when(F.coalesce("n_failed", F.lit(0)) > 0, "failed").otherwise("passed")
    return listed.join(counts, "id", "left").select("model", "column", "test", known("n_keys"), known("n_failed"), status.alias("status"))


def run_inferred(tables: Mapping[str, DataFrame], hints: DataFrame | None = None) -> DataFrame:
    """Infer tests from the columns of ``tables`` and evaluate them.

    The definitions taken to the driver come from schemas alone: a few per column. A relationship to a column that its table does
    not have is reported as not evaluable.
    """
    spark = next(iter(tables.values())).sparkSession
    models = spark.createDataFrame([(m,) for m in tables], "name string")
    return run_tests(tables, [r.asDict() for r in infer_tests(table_columns(tables), models, hints=hints).collect()])


def check_findings(results: DataFrame) -> DataFrame:
    """Failed tests as findings."""
    return results.filter("n_failed > 0").select(
        F.lit("test").alias("family"),
        F.concat_ws(".", "model", "column").alias("artifact"),
        F.col("test").alias("rule_id"),
        F.lit("ERROR").alias("severity"),
        F.col("n_failed").alias("n"),
        F.concat(F.col("n_keys").cast("string"), F.lit(" failing keys")).alias("evidence"),
    )
