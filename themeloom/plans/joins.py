"""Look-ups of a table that is unique on its key, safe for hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.plans.lineage import cut

# What a broadcast may hold in an executor. Hot keys are those above 1/HOT_KEYS
# of the rows, so no more than HOT_KEYS can be hot, whatever the data, and fewer
# if their entries are large: BROADCAST_BYTES bounds them as well.
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_KEYS = 1000


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    how: str = "inner",
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_keys: int = HOT_KEYS,
    table_rows: int | None = None,
) -> DataFrame:
    """Join ``rows`` to ``table`` (one row per key, NULL is a key of its own).

    ``table`` should be cut already: it is measured first. While it fits in
    ``broadcast_bytes`` it is broadcast, and no row of ``rows`` moves. Beyond
    that the keys of ``rows`` are counted; the hot ones, as many as their entries
    fit in the same bound, are served by a broadcast of just those entries, and
    the others by an ordinary shuffle join, of which Spark splits what is still
    uneven. Every row takes exactly one way, and ``rows`` is computed once.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"lookup_join supports inner and left, not {how!r}")
    measured = measured_size(table, table_rows)
    if measured[1] <= broadcast_bytes:
        return _joined(rows, F.broadcast(table), keys, how)

    largest = measured[2]
    allowed = min(hot_keys, broadcast_bytes // max(largest, 1))
    if allowed < 1:
        return _joined(rows, table, keys, how)
    rows = cut(rows)
    total = rows.count()
    hot = cut(
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > F.lit(total / allowed))
        .select(*keys, F.lit(True).alias("_hot"))
    )
    if hot.isEmpty():
        return _joined(rows, table, keys, how)
    marked = _joined(rows, F.broadcast(hot), keys, "left")
    hot_table = _joined(table, F.broadcast(hot), keys, "inner").drop("_hot")
    hot_rows = marked.where(F.col("_hot")).drop("_hot")
    cold_rows = marked.where(F.col("_hot").isNull()).drop("_hot")
    return _joined(hot_rows, F.broadcast(hot_table), keys, how).unionByName(
        _joined(cold_rows, table, keys, how)
    )


def measured_size(table: DataFrame, rows: int | None = None) -> tuple[int, int, int]:
    """``(rows, bytes, bytes of the largest row)``, in memory.

    Rows of a fixed width whose number is known need no job.
    """
    width = [_bytes_of(F.col(f.name), f.dataType) for f in table.schema.fields]
    fixed = 16 + sum(w for w in width if isinstance(w, int))
    moving = [w for w in width if not isinstance(w, int)]
    if rows is not None and not moving:
        return rows, rows * fixed, fixed
    size = reduce(lambda a, b: a + b, moving, F.lit(fixed).cast("long"))
    found = table.agg(F.count(F.lit(1)), F.sum(size), F.max(size)).first()
    return found[0], found[1] or 0, found[2] or 0


def _bytes_of(column: Column, kind: T.DataType) -> Column | int:
    """Bytes of a value: a number if the type has a fixed width."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        each = _bytes_of(F.lit(None).cast(kind.elementType), kind.elementType)
        if isinstance(each, int):
            return F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)) * each + 16
        sizes = F.transform(column, lambda e: _bytes_of(e, kind.elementType))
        return F.coalesce(F.aggregate(sizes, F.lit(16), lambda a, b: a + b), F.lit(16))
    if isinstance(kind, T.StructType):
        parts = [_bytes_of(column[f.name], f.dataType) for f in kind.fields]
        return reduce(lambda a, b: a + b, parts, 8)
    if isinstance(kind, T.MapType):
        return _bytes_of(F.map_keys(column), T.ArrayType(kind.keyType)) + _bytes_of(
            F.map_values(column), T.ArrayType(kind.valueType)
        )
    return 8


def _joined(rows: DataFrame, table: DataFrame, keys: list[str], how: str) -> DataFrame:
    renamed = table.select(
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)],
        *[F.col(c) for c in table.columns if c not in keys],
    )
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    )
    return rows.join(renamed, condition, how).drop(*[f"_key_{i}" for i in range(len(keys))])
