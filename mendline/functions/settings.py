"""Session settings that fit the data and the cluster."""

from __future__ import annotations

_SHUFFLE_PART = 128 * 1024 * 1024


def settings(cores: int, shuffle_bytes: int = 0) -> dict[str, str]:
    """Settings for ``cores`` executor cores and the largest expected shuffle.

    Shuffles start with parts of about 128 MB, at least one per core; adaptive execution merges what turns out
    small and splits skewed join parts.
    """
    parts = max(cores, -(-shuffle_bytes // _SHUFFLE_PART))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.session.timeZone": "UTC",
    }
