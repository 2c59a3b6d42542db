"""Joins to a table with one row per key, whatever the keys look like on the other side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from paceline.operators.ordered import MAX_BROADCAST_ROWS
from paceline.sources.scratch import pin

#: Keys that are joined apart: at most so many, each with at least so many rows.
MOST_HOT, HOT_ROWS = 1000, 100_000


def free_names(taken: list[str], wanted: list[str]) -> list[str]:
    """The wanted names, with underscores in front until none clashes with a taken one (in any case)."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys (null is one) with more than a thousandth of all rows and at least ``hot_rows``.

    One count, combined before its shuffle; at most ``MOST_HOT`` rows come out.
    """
    (rows,) = free_names(keys, ["rows"])
    seen = Observation()
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(rows)).observe(seen, F.sum(rows).alias("total"))
    large = pin(sizes.where(F.col(rows) >= hot_rows))
    total = seen.get["total"] or 0
    return large.where(F.col(rows) > total // MOST_HOT).select(*keys)


def join_lookup(
    df: DataFrame,
    table: DataFrame,
    on: dict[str, str],
    how: str = "left",
    null_safe: bool = False,
    broadcast_rows: int = MAX_BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``df`` with the other columns of ``table``, which has at most one row per key.

    ``on`` maps columns of ``df`` to key columns of ``table``; ``how`` is ``left`` or
    ``inner``.  Null keys match only with ``null_safe``.  A table of at most
    ``broadcast_rows`` rows (counted; it should be a written one) is broadcast.  Beyond
    that, the hot keys of ``df`` are counted first: their rows stay where they are and meet
    the few table rows they need by broadcast, all other rows are shuffled.  The result has
    one schema and the same rows either way; the order of rows is free.  A stream can't be
    counted, so its join is Spark's own.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unknown join {how!r}")
    values = [c for c in table.columns if c not in on.values()]
    names = free_names([*df.columns, *values], [f"_key_{i}" for i in range(len(on))])
    table = table.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, on.values())], *[f"`{c}`" for c in values])

    def match(left: DataFrame, right: DataFrame, kind: str, nulls: bool) -> DataFrame:
        same: list[Column] = [
            F.col(f"`{c}`").eqNullSafe(F.col(n)) if nulls else F.col(f"`{c}`") == F.col(n) for c, n in zip(on, names)
        ]
        return left.join(right, reduce(Column.__and__, same), kind)

    out = [*[f"`{c}`" for c in df.columns], *[f"`{c}`" for c in values]]
    if df.isStreaming:
        return match(df, table, how, null_safe).select(*out)
    if table.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return match(df, F.broadcast(table), how, null_safe).select(*out)
    hot = hot_keys(df, list(on), hot_rows).select(*[F.col(f"`{c}`").alias(n) for c, n in zip(on, names)])
    hot = pin(hot)
    if hot.isEmpty():
        return match(df, table, how, null_safe).select(*out)
    # One table row per key, so these are as few as the hot keys.
    lone = hot.select(*[F.col(n).alias(f"{n}_hot") for n in names])
    same = [F.col(f"{n}_hot").eqNullSafe(F.col(n)) if null_safe else F.col(f"{n}_hot") == F.col(n) for n in names]
    found = pin(table.join(F.broadcast(lone), reduce(Column.__and__, same), "inner").drop(*lone.columns))
    few = hot.join(F.broadcast(found), names, how) if not null_safe else _null_safe(hot, found, names, how)
    apart = match(df, F.broadcast(few), "inner", True).select(*out)
    rest = match(match(df, F.broadcast(hot), "left_anti", True), table, how, null_safe).select(*out)
    return apart.unionByName(rest)


def _null_safe(hot: DataFrame, found: DataFrame, names: list[str], how: str) -> DataFrame:
    """Hot keys with their table rows, where null meets null."""
    right = found.withColumnsRenamed({n: f"{n}_found" for n in names})
    same = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"{n}_found")) for n in names])
    return hot.join(F.broadcast(right), same, how).drop(*[f"{n}_found" for n in names])
