"""Ordered computations over groups of any size.

A plain ``Window.partitionBy(key).orderBy(v)`` sends a whole key to one task.
That is right while the largest key is small, and the size is checked first.
Beyond it the order column is cut into ranges by quantiles of a random
sample, so a key that holds a third of all rows is spread over a third of
the ranges.  Each range is worked on its own, and the effect of the lower
ranges arrives as one small row per (key, range).  Results do not depend on
where the cuts fall.

NULL keys are a key of their own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renderscope.session import split_bits, split_rows, staged

RANGE = "_range"
#: Sampled values per range.
SAMPLED = 64
#: Rows of a rank table that the planner may broadcast.  Its file is far smaller than what every task would hold.
BROADCAST_ROWS = 100_000


def split_ranges(df: DataFrame, order: str, bits: int | None = None) -> DataFrame:
    """Add the monotone integer range of ``order``, by binary search in the cuts.

    Cuts are taken from a bounded random sample, so ``order`` may have any type
    that can be ordered.  NULL sorts first and is in the first range.
    """
    bits = split_bits(df.sparkSession) if bits is None else bits
    parts = 1 << bits
    sample = df.select(F.col(order).alias("v")).where("v is not null").orderBy(F.rand(7)).limit(SAMPLED * parts)
    drawn = F.sort_array(F.collect_list("v"))
    at = F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.floor(F.size("_s") * i / parts).cast("int"))
    cuts = sample.agg(drawn.alias("_s")).select(F.transform(at, lambda i: F.get("_s", i)).alias("cuts")).scalar()
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    at_range = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get("_cuts", at + step - 1) < F.col(order), at + step).otherwise(at),
    )
    return df.withColumn("_cuts", cuts).withColumn(RANGE, at_range).drop("_cuts")


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL being equal to NULL; the keys stay once."""
    names = {k: f"_same_{i}" for i, k in enumerate(keys)}
    other = right.withColumnsRenamed(names)
    same = F.lit(True)
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return left.join(other, same, how).drop(*names.values())


def fits_one_task(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether the largest key of a staged table may be ordered by one task."""
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (largest or 0) <= split_rows(df.sparkSession)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: Mapping[str, Column],
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add, per row, the sum of each measure over the earlier rows of its key.

    ``order`` is unique within a key.  ``totals`` adds whole-key sums.  The
    input is staged, since the cuts, the ranges and the rows each read it.
    """
    keys = list(keys)
    totals = totals or {}
    rows = staged(df)
    if fits_one_task(rows, keys):
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(
            *df.columns,
            *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(n) for n, m in measures.items()],
            *[F.sum(m).over(Window.partitionBy(*keys)).alias(n) for n, m in totals.items()],
        )
    ranged = split_ranges(rows, order)
    earlier = Window.partitionBy(*keys, RANGE).orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    inside = ranged.select(
        "*",
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_in_{n}") for n, m in measures.items()],
    )
    per_range = ranged.groupBy(*keys, RANGE).agg(
        *[F.sum(m).alias(f"_sum_{n}") for n, m in measures.items()],
        *[F.sum(m).alias(f"_all_{n}") for n, m in totals.items()],
    )
    lower = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_range.select(
        *keys,
        RANGE,
        *[F.coalesce(F.sum(f"_sum_{n}").over(lower), F.lit(0)).alias(f"_off_{n}") for n in measures],
        *[F.sum(f"_all_{n}").over(whole).alias(n) for n in totals],
    )
    return join_same(inside, offsets, [*keys, RANGE]).select(
        *df.columns,
        *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(n) for n in measures],
        *totals,
    )


def row_numbers(df: DataFrame, keys: Sequence[str], order: str, out: str = "position") -> DataFrame:
    """1-based position within a key; ``order`` is unique within a key."""
    numbered = running_totals(df, keys, order, {out: F.lit(1).cast("long")})
    return numbered.withColumn(out, F.col(out) + 1)


def previous_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Mapping[str, str],
    *,
    following: bool = False,
    on_disk: bool = False,
) -> DataFrame:
    """Add columns of the row just before (or after) in the key's order.

    ``columns`` maps new names to source columns.  The input is staged, unless
    it is ``on_disk`` already.
    """
    keys = list(keys)
    rows = df if on_disk else staged(df)
    beside = F.lead if following else F.lag
    if fits_one_task(rows, keys):
        w = Window.partitionBy(*keys).orderBy(order)
        return rows.select(*df.columns, *[beside(src).over(w).alias(new) for new, src in columns.items()])
    ranged = split_ranges(rows, order)
    edge = F.min_by if following else F.max_by
    within = Window.partitionBy(*keys, RANGE).orderBy(order)
    carried = F.struct(*[F.col(src).alias(new) for new, src in columns.items()])
    inside = ranged.select("*", beside(carried).over(within).alias("_near"))
    across = Window.partitionBy(*keys).orderBy(RANGE)
    edges = (
        ranged.groupBy(*keys, RANGE)
        .agg(edge(carried, F.col(order)).alias("_edge"))
        .select(*keys, RANGE, beside("_edge").over(across).alias("_far"))
    )
    near = F.coalesce(F.col("_near"), F.col("_far"))
    return join_same(inside, edges, [*keys, RANGE]).select(
        *df.columns, *[near[new].alias(new) for new in columns]
    )


def rank_table(
    df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None
) -> DataFrame:
    """Distinct values of each key with their tie-averaged rank.

    Columns: keys, value, ``cnt`` (tied rows), ``below`` (rows with a lower
    value), ``level`` (0-based distinct position), ``n``, ``n_levels`` and
    ``avg_rank``.  With ``weight`` the rows of ``df`` are counted cells.
    """
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    tied = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(count.alias("cnt"))
    one = F.lit(1).cast("long")
    ranked = running_totals(
        tied,
        keys,
        value,
        {"below": F.col("cnt"), "level": one},
        {"n": F.col("cnt"), "n_levels": one},
    )
    return ranked.withColumn("avg_rank", F.col("below") + (F.col("cnt") + 1) / F.lit(2.0))


def side_ranks(cells: DataFrame, keys: Sequence[str], sides: Sequence[str], weight: str) -> DataFrame:
    """Rank tables of several columns at once: ``side`` names the column, ``value`` its value."""
    long = cells.select(*keys, weight, *[F.col(s).cast("double").alias(s) for s in sides]).unpivot(
        [*keys, weight], list(sides), "side", "value"
    )
    return staged(rank_table(long, [*keys, "side"], "value", weight))


def join_side(df: DataFrame, table: DataFrame, keys: Sequence[str], side: str, *columns: Column) -> DataFrame:
    """Attach columns of one side's rank table, which is on disk, to the rows with that value."""
    own = table.where(F.col("side") == side).select(*keys, F.col("value").alias(side), *columns)
    return df.join(own if table.count() <= BROADCAST_ROWS else own.hint("merge"), [*keys, side])


def top_rows(df: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    """First k rows of each key.

    ``row_number() <= k`` lets Spark prune each map task to k rows per key
    before the shuffle, so a hot key never arrives whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
