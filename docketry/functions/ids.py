"""Content-addressed identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separator of the parts that an identifier is hashed from (a fixed value).
SEPARATOR = "\x1f"


def stable_id(namespace: str, *parts: Column | str) -> Column:
    """``namespace:`` and the SHA-256 of the parts; a null part counts as empty, so it still keeps its place."""
    if not namespace or ":" in namespace:
        raise ValueError("namespace must be non-empty and hold no colon")
    columns = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit(f"{namespace}:"), F.sha2(F.concat_ws(SEPARATOR, *columns), 256))


def source_id(uri: Column | str) -> Column:
    return stable_id("source", uri)


def evidence_id(artifact: Column | str, unit_type: Column | str, locator: Column | str) -> Column:
    return stable_id("evidence", artifact, unit_type, locator)


def snapshot_id(source: Column | str, artifact: Column | str) -> Column:
    return stable_id("snapshot", source, artifact)


def set_signature(values: Column) -> Column:
    """SHA-256 over the sorted members of an array, each ended by a newline."""
    return F.sha2(F.concat(F.array_join(F.array_sort(values), "\n"), F.lit("\n")), 256)
