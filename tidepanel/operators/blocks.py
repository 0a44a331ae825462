"""Splitting one series over several tasks.

``ts`` is a date and (panel, series, ts) is unique, so a stretch of ``block_days``
calendar days of a series never holds more than ``block_days`` rows. That bound
is what the block form uses: rows are grouped by (key, block), every block gets
copies of the few neighbouring rows its window frames reach into (the halo), the
windows run per block, and the copies are dropped afterwards. Results equal the
unsplit windows exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidepanel.functions.scalar import day_number
from tidepanel.keys import SERIES_KEY, TS
from tidepanel.session import cut_lineage

BLOCK = "_block"
HALO = "_halo"

Step = Callable[[WindowSpec], dict[str, Column]]


def series_window(keys: Sequence[str] = SERIES_KEY) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(TS)


def with_block(df: DataFrame, block_days: int) -> DataFrame:
    if block_days < 1:
        raise ValueError("block_days must be at least 1")
    return df.withColumn(BLOCK, F.floor(day_number(F.col(TS)) / F.lit(block_days)).cast("int"))


def add_halo(
    df: DataFrame,
    *,
    block_days: int,
    before: int = 0,
    after: int = 0,
    anchor: Column | None = None,
    keys: Sequence[str] = SERIES_KEY,
) -> DataFrame:
    """Add BLOCK and, flagged by HALO, the ``before`` rows preceding and ``after``
    rows following each block. With ``anchor`` only rows meeting it count and are
    copied (such as the known values around a gap)."""
    keys = list(keys)
    payload = [TS] + [c for c in df.columns if c not in keys and c != TS]
    blocked = with_block(df, block_days)
    own = blocked.withColumn(HALO, F.lit(False))
    if before == 0 and after == 0:
        return own

    row = F.struct(*payload)
    kept = row if anchor is None else F.when(anchor, row)
    summary = blocked.groupBy(*keys, BLOCK).agg(F.sort_array(F.collect_list(kept)).alias("_rows"))
    size = F.size("_rows")
    summary = summary.select(
        *keys,
        BLOCK,
        (size > 0).alias("_any"),
        F.slice("_rows", F.lit(1), F.lit(max(after, 1))).alias("_head"),
        F.slice("_rows", F.greatest(size - F.lit(max(before, 1) - 1), F.lit(1)), F.lit(max(before, 1))).alias("_tail"),
    )
    # Blocks holding no anchor row must not use up frame positions: the bounded
    # merge below runs among the blocks that hold one.
    filled = Window.partitionBy(*keys, "_any").orderBy(BLOCK)
    every = Window.partitionBy(*keys).orderBy(BLOCK)
    pieces = []
    if before:
        merged = F.flatten(F.collect_list("_tail").over(filled.rowsBetween(-(before - 1), 0)))
        n = F.size("_upto")
        tails = summary.withColumn("_upto", merged).withColumn(
            "_upto", F.slice("_upto", F.greatest(n - F.lit(before - 1), F.lit(1)), F.lit(before))
        )
        carried = F.last(F.when(F.col("_any"), F.col("_upto")), ignorenulls=True).over(
            every.rowsBetween(Window.unboundedPreceding, -1)
        )
        pieces.append(tails.select(*keys, BLOCK, carried.alias("_copies")))
    if after:
        merged = F.flatten(F.collect_list("_head").over(filled.rowsBetween(0, after - 1)))
        heads = summary.withColumn("_from", F.slice(merged, 1, after))
        carried = F.first(F.when(F.col("_any"), F.col("_from")), ignorenulls=True).over(
            every.rowsBetween(1, Window.unboundedFollowing)
        )
        pieces.append(heads.select(*keys, BLOCK, carried.alias("_copies")))
    out = own
    for piece in pieces:
        copies = piece.select(*keys, BLOCK, F.explode("_copies").alias("_r")).select(
            *keys, *[F.col(f"_r.{c}").alias(c) for c in payload], BLOCK, F.lit(True).alias(HALO)
        )
        out = out.unionByName(copies)
    return out


def settled(df: DataFrame, block_days: int | None) -> DataFrame:
    """In block form, ``df`` written to the checkpoint folder; else unchanged.

    A halo reads its input twice, so a chain of block steps without this would
    read the source twice per step to the power of their number.
    """
    return df if block_days is None else cut_lineage(df)


def over_series(
    df: DataFrame,
    steps: Iterable[Step],
    *,
    before: int = 0,
    after: int = 0,
    anchor: Column | None = None,
    keys: Sequence[str] = SERIES_KEY,
    block_days: int | None = None,
) -> DataFrame:
    """Run window steps per series, or per block of a series with ``block_days``.

    Each step maps a window ordered by date to new columns; later steps may use
    the columns of earlier ones. ``before``/``after`` say how many rows (anchor
    rows, when given) the frames reach back and forth in total.
    """
    if block_days is None:
        w = series_window(keys)
        for step in steps:
            df = df.withColumns(step(w))
        return df
    split = add_halo(df, block_days=block_days, before=before, after=after, anchor=anchor, keys=keys)
    w = series_window([*keys, BLOCK])
    for step in steps:
        split = split.withColumns(step(w))
    return split.where(~F.col(HALO)).drop(BLOCK, HALO)


def row_position(
    df: DataFrame, *, keys: Sequence[str] = SERIES_KEY, block_days: int | None = None, name: str = "rn"
) -> DataFrame:
    """1-based row number in date order; blocks add the counts of those before."""
    if block_days is None:
        return df.withColumn(name, F.row_number().over(series_window(keys)).cast("bigint"))
    blocked = with_block(df, block_days)
    counts = blocked.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    offset = F.coalesce(
        F.sum("_n").over(Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    counts = counts.select(*keys, BLOCK, offset.alias("_offset"))
    w = series_window([*keys, BLOCK])
    return (
        blocked.withColumn("_in_block", F.row_number().over(w))
        .join(counts, [*keys, BLOCK])
        .withColumn(name, (F.col("_in_block") + F.col("_offset")).cast("bigint"))
        .drop(BLOCK, "_in_block", "_offset")
    )
