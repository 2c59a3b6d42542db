"""Ordered computations that never put one large group into one task.

Two building blocks:

* ``range_blocks`` range-partitions a table on its sort key and pins the result.
  A block is one sorted partition; its rows carry the block number and their
  place in it.  Blocks are balanced whatever the keys look like, as long as the
  sort key ends in a unique column.
* ``prior_aggregates`` computes "everything before this row" per entity.  Entities
  of ordinary size go through one Spark window.  Entities with more rows than
  ``max_group_rows`` are cut into blocks: a window inside each block, plus the
  totals of the entity's earlier blocks.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.sources.scratch import pin

BLOCK = "_block"
PLACE = "_place"
MAX_GROUP_ROWS = 2_000_000
MAX_BROADCAST_ROWS = 200_000


def range_blocks(
    df: DataFrame, keys: list[str], blocks: int | None = None, unique: bool = True
) -> DataFrame:
    """Sort globally by ``keys`` into range partitions; add block and 0-based place.

    Rows with equal keys share a partition.  When ``keys`` are not ``unique``, rows are
    numbered and written first, and the number breaks ties, so that any count of equal
    rows can be cut; their order among themselves is free.

    ``monotonically_increasing_id`` is partition number * 2^33 + row number, so it
    yields both without another shuffle.  The result is written to the shared
    folder: the sampled range bounds, and with them the blocks, must not change
    between two uses of the table or after the loss of an executor.
    """
    if not unique:
        df = pin(df.withColumn("_tie", F.monotonically_increasing_id()))
        keys = [*keys, "_tie"]
    ranged = df.repartitionByRange(blocks, *keys) if blocks else df.repartitionByRange(*keys)
    ordered = ranged.sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id())
    return pin(
        ordered.withColumn(BLOCK, F.shiftright("_mid", 33))
        .withColumn(PLACE, F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid", "_tie")
    )


def block_offsets(blocks: DataFrame, weight: Column, name: str) -> DataFrame:
    """Per block, the total weight of all earlier blocks.

    One row per range partition, so the window without a partition key and the
    broadcast of the result are bounded by the partition count.
    """
    totals = blocks.groupBy(BLOCK).agg(F.sum(weight).alias("_total"))
    before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(BLOCK, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias(name))


def global_index(
    df: DataFrame,
    order: list[str],
    name: str = "row_index",
    blocks: int | None = None,
    unique: bool = True,
) -> DataFrame:
    """0-based position of every row in the global order of ``order`` (nulls first).

    Costs one range shuffle and one write of the table; no task ever holds more than one
    range partition.  Say ``unique=False`` when ``order`` does not tell all rows apart.
    """
    placed = range_blocks(df, order, blocks, unique)
    offsets = block_offsets(placed, F.lit(1).cast("bigint"), "_offset")
    return (
        placed.join(F.broadcast(offsets), BLOCK)
        .withColumn(name, F.col("_offset") + F.col(PLACE))
        .drop(BLOCK, PLACE, "_offset")
    )


@dataclass(frozen=True)
class Prior:
    """One "before this row" aggregate.

    ``kind`` is ``count``, ``sum``, ``min``, ``max``, ``mean`` or ``recent_mean``
    (mean of the last ``size`` rows); ``column`` is the input, unused by ``count``.
    """

    name: str
    kind: str
    column: str | None = None
    size: int = 3


def _sizes(df: DataFrame, entity: str) -> DataFrame:
    return df.groupBy(entity).agg(F.count(F.lit(1)).alias("_rows"))


@dataclass(frozen=True)
class GroupSizes:
    """Rows of the largest entity; number and rows of the entities above the limit."""

    largest: int
    large: int
    large_rows: int


def group_sizes(df: DataFrame, entity: str, limit: int) -> GroupSizes:
    """Measure the groups of ``entity`` with one map-side combined count."""
    above = F.when(F.col("_rows") > limit, F.col("_rows"))
    found = _sizes(df, entity).agg(F.max("_rows"), F.count(above), F.sum(above)).first()
    return GroupSizes(*[v or 0 for v in found])


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side known to have few rows; leave a larger one to adaptive execution."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def prior_aggregates(
    df: DataFrame,
    entity: str,
    order: list[str],
    specs: list[Prior],
    max_group_rows: int = MAX_GROUP_ROWS,
    size_source: DataFrame | None = None,
    unique: bool = True,
) -> DataFrame:
    """Add per-entity aggregates over the rows strictly before each row in ``order``.

    The value is null where no earlier row has an input (0 for ``count``).
    A null entity is a group like any other.  ``size_source`` is a cheaper table to
    measure group sizes on first, whose groups are at least as large.  Say
    ``unique=False`` when ``order`` does not tell all rows of an entity apart.

    Both ways of computing give one schema: the input columns that keep their names, then
    the aggregates.  Sums and means of decimals are doubles, the others keep the input type.
    """
    names = [s.name for s in specs]
    kinds = dict(df.dtypes)
    summed = {s.column for s in specs if s.kind in ("sum", "mean", "recent_mean")}
    as_double = {c: f"_double_{c}" for c in summed if kinds[c].startswith("decimal")}
    wide = df.withColumns({new: F.col(c).cast("double") for c, new in as_double.items()})
    wide_specs = [
        replace(s, column=as_double[s.column]) if s.kind in ("sum", "mean", "recent_mean") and s.column in as_double else s
        for s in specs
    ]
    out = _prior_aggregates(wide, entity, order, wide_specs, max_group_rows, size_source, unique)
    return out.select(*[c for c in df.columns if c not in names], *names)


def _prior_aggregates(
    df: DataFrame,
    entity: str,
    order: list[str],
    specs: list[Prior],
    max_group_rows: int,
    size_source: DataFrame | None,
    unique: bool,
) -> DataFrame:
    for source in ([df] if size_source is None else [size_source, df]):
        sizes = group_sizes(source, entity, max_group_rows)
        if sizes.largest <= max_group_rows:
            return _prior_by_window(df, entity, order, specs)

    hot = _sizes(df, entity).filter(F.col("_rows") > max_group_rows)
    large = broadcast_if(pin(hot.select(F.col(entity).alias("_large"))), sizes.large)
    same = df[entity].eqNullSafe(F.col("_large"))
    small_part = _prior_by_window(df.join(large, same, "left_anti"), entity, order, specs)
    large_rows = df.join(large, same, "left_semi")
    large_part = _prior_by_blocks(large_rows, entity, order, specs, sizes, max_group_rows, unique)
    return small_part.unionByName(large_part)  # by name: a replaced column may stand elsewhere


def _prior_by_window(df: DataFrame, entity: str, order: list[str], specs: list[Prior]) -> DataFrame:
    w = Window.partitionBy(entity).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for s in specs:
        if s.kind == "count":
            out[s.name] = (F.row_number().over(w) - 1).cast("bigint")
        elif s.kind == "recent_mean":
            out[s.name] = F.avg(s.column).over(w.rowsBetween(-s.size, -1))
        else:
            plain = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg}[s.kind]
            out[s.name] = plain(s.column).over(before)
    return df.withColumns(out)


def _plus(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


# How two partial values of one state merge.
_MERGE = {"rows": _plus, "n": _plus, "sum": _plus, "min": F.least, "max": F.greatest}
_STATE = {
    "rows": lambda c: F.count(F.lit(1)),
    "n": F.count,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
}
_STATE_OVER_BLOCKS = {"rows": F.sum, "n": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def _states(specs: list[Prior]) -> dict[str, tuple[str, str | None]]:
    """The distinct partial states the specs need: name -> (state kind, column)."""
    states: dict[str, tuple[str, str | None]] = {"_rows": ("rows", None)}
    for s in specs:
        for kind in {"mean": ["sum", "n"], "sum": ["sum"], "min": ["min"], "max": ["max"]}.get(s.kind, []):
            states[f"_{kind}_{s.column}"] = (kind, s.column)
    return states


def _prior_by_blocks(
    df: DataFrame,
    entity: str,
    order: list[str],
    specs: list[Prior],
    sizes: GroupSizes,
    max_group_rows: int,
    unique: bool,
) -> DataFrame:
    cut = 2 * -(-sizes.large_rows // max_group_rows)
    # Neighbouring blocks meet in one entity at most, which bounds the pairs of both.
    pairs = cut + sizes.large
    placed = range_blocks(df, [entity, *order], cut, unique)
    states = _states(specs)
    recent = {s.column: max(r.size for r in specs if r.column == s.column and r.kind == "recent_mean")
              for s in specs if s.kind == "recent_mean"}

    # One row per (entity, block).
    totals = placed.groupBy(entity, BLOCK).agg(
        F.max(PLACE).alias("_last"),
        *[_STATE[kind](c).alias(n) for n, (kind, c) in states.items()],
    )
    if recent:
        totals = _with_block_tails(placed, totals, entity, recent, pairs)
    by_block = Window.partitionBy(entity).orderBy(BLOCK)
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"_c{n}": _STATE_OVER_BLOCKS[kind](n).over(earlier) for n, (kind, _) in states.items()}
    for c, size in recent.items():
        # Every block holds at least one row, so `size` blocks reach back far enough.
        near = by_block.rowsBetween(-size, -1)
        tails = F.flatten(F.reverse(F.collect_list(f"_tail_{c}").over(near)))
        carried[f"_ctail_{c}"] = F.slice(tails, 1, size)
    carry = totals.withColumns(carried).select(
        F.col(entity).alias("_entity"), F.col(BLOCK).alias("_at"), *carried
    )

    w = Window.partitionBy(entity, BLOCK).orderBy(PLACE)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    inside = {f"_i{n}": _STATE[kind](c).over(before) for n, (kind, c) in states.items()}
    for c, size in recent.items():
        for k in range(1, size + 1):
            inside[f"_lag{k}_{c}"] = F.lag(F.struct(F.col(c).alias("v")), k).over(w)
    rows = placed.withColumns(inside).join(
        broadcast_if(carry, pairs),
        F.col(entity).eqNullSafe(F.col("_entity")) & (F.col(BLOCK) == F.col("_at")),
        "left",
    )

    def state(name: str) -> Column:
        return _MERGE[states[name][0]](F.col(f"_c{name}"), F.col(f"_i{name}"))

    out = {}
    for s in specs:
        if s.kind == "count":
            out[s.name] = F.coalesce(state("_rows"), F.lit(0)).cast("bigint")
        elif s.kind == "mean":
            out[s.name] = F.try_divide(state(f"_sum_{s.column}"), state(f"_n_{s.column}"))
        elif s.kind == "recent_mean":
            out[s.name] = _mean_of_latest(s, recent[s.column])
        else:
            out[s.name] = state(f"_{s.kind}_{s.column}")
    return rows.withColumns(out).select(*[c for c in df.columns if c not in out], *out)


def _with_block_tails(
    placed: DataFrame, totals: DataFrame, entity: str, recent: dict[str, int], pairs: int
) -> DataFrame:
    """Add, per (entity, block), its last few values, newest first.

    Places are consecutive inside a block, so the last rows follow from the last place.
    """
    ends = totals.select(
        F.col(entity).alias("_entity"), F.col(BLOCK).alias("_at"), F.col("_last").alias("_end")
    )
    depth = max(recent.values())
    tail_rows = placed.join(
        broadcast_if(ends, pairs),
        F.col(entity).eqNullSafe(F.col("_entity"))
        & (F.col(BLOCK) == F.col("_at"))
        & (F.col(PLACE) > F.col("_end") - depth),
    )
    # At most `depth` rows reach each list.
    tails = tail_rows.groupBy("_entity", "_at").agg(
        *[
            F.sort_array(F.collect_list(F.struct(F.col(PLACE), F.col(c).alias("v"))), asc=False).alias(f"_t_{c}")
            for c in recent
        ]
    )
    tails = tails.select(
        "_entity",
        "_at",
        *[F.transform(f"_t_{c}", lambda x: F.struct(x["v"].alias("v"))).alias(f"_tail_{c}") for c in recent],
    )
    return totals.join(
        tails, totals[entity].eqNullSafe(F.col("_entity")) & (totals[BLOCK] == F.col("_at"))
    ).drop("_entity", "_at")


def _mean_of_latest(s: Prior, lags: int) -> Column:
    inside = F.array_compact(F.array(*[F.col(f"_lag{k}_{s.column}") for k in range(1, lags + 1)]))
    carried = F.coalesce(F.col(f"_ctail_{s.column}"), F.slice(inside, 1, 0))
    latest = F.slice(F.concat(inside, carried), 1, s.size)
    values = F.filter(F.transform(latest, lambda x: x["v"]), lambda v: v.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(values) > 0, total / F.size(values))


def weighted_ranks(placed: DataFrame, by: list[str], weight: str) -> DataFrame:
    """Add ``_rank`` (total weight before the row in its group) and ``_size`` (group total).

    ``placed`` comes from ``range_blocks`` with keys that start with ``by``.  Meant for
    tables already reduced to distinct keys with counts, which turns any number of equal
    values into one row.  A group may span many blocks: each block adds up its own rows,
    and the block totals of a group (one row per block it touches) give the rest.
    """
    inside = Window.partitionBy(BLOCK, *by).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))

    totals = placed.groupBy(*by, BLOCK).agg(F.sum(weight).alias("_total"))
    blocks = Window.partitionBy(*by)
    earlier = blocks.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"_by{i}" for i, c in enumerate(by)}
    carry = totals.select(
        *[F.col(c).alias(n) for c, n in names.items()],
        F.col(BLOCK).alias("_at"),
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_earlier"),
        F.sum("_total").over(blocks).alias("_size"),
    )
    same = F.col(BLOCK) == F.col("_at")
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    return (
        rows.join(carry, same)
        .withColumn("_rank", F.col("_earlier") + F.col("_inside"))
        .drop("_earlier", "_inside", "_at", *names.values())
    )
