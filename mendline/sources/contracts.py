"""Reader of schema contracts in YAML."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendline.sources.files import read_whole

COLUMNS = "path STRING, entry INT, model STRING, column STRING, data_type STRING, tests ARRAY<STRING>"

# File names that hold contracts.
GLOBS = ["schema*.yml", "schema*.yaml", "models.yml", "_schema*.yml"]


def _test_name(test) -> str:
    """A test is a name, or a mapping from its name to its settings."""
    return str(next(iter(test))) if isinstance(test, dict) and test else str(test)


def _entries(path: str, text: str) -> Iterator[tuple]:
    """Rows of one contract file; nothing for a file that cannot be read as a mapping of models."""
    try:
        data = yaml.safe_load(text)
    except Exception:  # besides YAML errors, a bad date raises ValueError and deep nesting RecursionError
        return
    models = data.get("models") if isinstance(data, dict) else None
    for entry, model in enumerate(models if isinstance(models, list) else []):
        if not isinstance(model, dict) or not model.get("name"):
            continue
        columns = [c for c in model.get("columns") or [] if isinstance(c, dict) and c.get("name")]
        if not columns:
            yield path, entry, str(model["name"]), None, None, None
        for c in columns:
            listed = c.get("tests") or []
            tests = [_test_name(t) for t in (listed if isinstance(listed, list) else [listed])]
            declared = c.get("data_type")
            yield path, entry, str(model["name"]), str(c["name"]), None if declared is None else str(declared), tests


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "entry", "model", "column", "data_type", "tests"]
    for batch in batches:
        rows = [r for path, text in zip(batch["path"], batch["content"]) for r in _entries(path, text)]
        yield pd.DataFrame(rows, columns=names).astype({"entry": "int32"})


def parse_contracts(files: DataFrame) -> DataFrame:
    """Contract rows of ``files(path, content)``; of several entries for a model the last by path and place wins."""
    rows = files.select("path", "content").mapInPandas(_parse, COLUMNS)
    last = rows.groupBy("model").agg(F.max(F.struct("path", "entry")).alias("l")).select("model", "l.path", "l.entry")
    # One key is one entry of one file, which was read as one row.
    return rows.join(last, ["model", "path", "entry"], "left_semi").select("model", "column", "data_type", "tests")


def read_contracts(spark: SparkSession, project: str, schema_path: str | None = None) -> DataFrame:
    """``(model, column, data_type, tests)`` of one contract file, or of all below ``models/``."""
    if schema_path:
        return parse_contracts(read_whole(spark, schema_path))
    return parse_contracts(read_whole(spark, f"{project.rstrip('/')}/models", "{" + ",".join(GLOBS) + "}"))
