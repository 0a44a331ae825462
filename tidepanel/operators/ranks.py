"""Order statistics of expanding and rolling frames by a tree of ranks.

Every row of a series gets the rank of its value in the whole series. The k-th smallest value of a frame is
the row whose rank a descent finds: the ranks of a node fall into ``FAN`` children, running counts say how many
rows of the frame lie in the first c of them, and a probe goes to the child in which its count passes k, with
k less the rows of the children before. A level is one window over the rows of each node beside the probes
that came to it, so a series is split further with every level, no frame is held as an array, and the work is
rows x levels, with levels the logarithm of the longest series to the base ``FAN``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.keys import TS, VALUE

FAN = 16
#: Rows of the longest series that the default number of levels serves: 179 years of days.
MAX_ROWS = FAN**4


def _levels(max_rows: int) -> int:
    levels = 1
    while FAN**levels < max_rows:
        levels += 1
    return levels


def _counts(node: Sequence[str], child: str, max_shift: int | None) -> list[str]:
    """For each c but the last: how many rows of the frame lie in the children up to c. Probes have no child.

    A rolling frame is the difference of two expanding ones, so no frame is read again for each row."""
    over = f"over (partition by {', '.join(node)} order by _rn range between unbounded preceding and"
    out = []
    for c in range(FAN - 1):
        held = f"sum(case when {child} <= {c} then 1 else 0 end) {over}"
        gone = "" if max_shift is None else f" - coalesce({held} {max_shift + 1} preceding), 0)"
        out.append(f"{held} current row){gone} as _c{c}")
    return out


def _step(node: str) -> list[str]:
    """The child that holds the k-th row, numbered after those of the nodes before, and k among its rows."""
    passed = " + ".join(f"case when _c{c} <= _k then 1 else 0 end" for c in range(FAN - 1))
    before = ", ".join(f"case when _c{c} <= _k then _c{c} else 0 end" for c in range(FAN - 1))
    return [f"cast({node} * {FAN} + {passed} as int) as _node", f"_k - greatest({before}) as _k"]


def order_statistics(
    rows: DataFrame,
    keys: Sequence[str],
    places: Column,
    *,
    value: str = VALUE,
    max_shift: int | None = None,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """(keys, ts, places: map of k to the k-th smallest ``value``, k from 0) of the frame each row ends.

    ``rows`` are unique in (keys, ts) and have no NULL value. ``places`` is an array of numbers given
    ``_len``, the rows of the frame; places outside the frame are left out. A series longer than
    ``max_rows`` is an error, not a wrong number.
    """
    keys = list(keys)
    levels = _levels(max_rows)
    w = Window.partitionBy(*keys)
    ranked = rows.select(
        *keys,
        TS,
        F.col(value).alias("_v"),
        (F.row_number().over(w.orderBy(TS)) - 1).alias("_rn"),
        (F.row_number().over(w.orderBy(value, TS)) - 1).alias("_r"),
    )
    too_long = F.raise_error(F.lit(f"a series has more than {FAN**levels} rows; pass max_rows"))
    ranked = ranked.withColumn("_r", F.when(F.col("_rn") < FAN**levels, F.col("_r")).otherwise(too_long.cast("int")))

    def child(level: int) -> str:
        return f"(_r div {FAN ** (levels - 1 - level)}) % {FAN}"

    length = "_rn + 1" if max_shift is None else f"least(_rn + 1, {max_shift + 1})"
    top = ranked.selectExpr("*", *_counts(keys, child(0), max_shift), f"{length} as _len")
    inside = F.filter(F.array_distinct(places), lambda p: (p >= 0) & (p < F.col("_len")))
    probes = top.withColumn("_k0", F.explode(F.transform(inside, lambda p: p.cast("int")))).withColumn("_k", F.col("_k0"))
    probes = probes.selectExpr(*keys, TS, "_rn", "_k0", *_step("0"))
    points = ranked.select(*keys, "_rn", "_r")
    for level in range(1, levels):
        here = points.selectExpr(*keys, "_rn", f"cast(_r div {FAN ** (levels - level)} as int) as _node", f"{child(level)} as _child")
        both = probes.withColumn("_child", F.lit(None).cast("int")).unionByName(here, allowMissingColumns=True)
        counted = both.selectExpr("*", *_counts([*keys, "_node"], "_child", max_shift)).where("_k is not null")
        probes = counted.selectExpr(*keys, TS, "_rn", "_k0", *_step("_node"))
    found = probes.withColumnRenamed("_node", "_r").join(ranked.select(*keys, "_r", "_v"), [*keys, "_r"])
    entry = F.collect_list(F.struct("_k0", "_v"))  # one entry for each place asked for
    return found.groupBy(*keys, TS).agg(F.map_from_entries(entry).alias("places"))


def quantile_places(quantiles: Sequence[float]) -> Column:
    """The places on either side of each quantile of a frame with ``_len`` rows."""
    sides = []
    for q in quantiles:
        at = F.lit(float(q)) * (F.col("_len") - 1)
        sides += [F.floor(at).cast("int"), F.ceil(at).cast("int")]
    return F.array(*sides)


def quantiles_sql(quantiles: Sequence[float], length: str, places: str = "places") -> str:
    """SQL for the array of quantiles, linear between neighbouring places, from the map of places."""
    out = []
    for q in quantiles:
        at = f"({float(q)!r}D * ({length} - 1))"
        low, high = (f"try_element_at({places}, cast({how}({at}) as int))" for how in ("floor", "ceil"))
        out.append(f"case when floor({at}) = ceil({at}) then {low} else {low} * (ceil({at}) - {at}) + {high} * ({at} - floor({at})) end")
    return f"array({', '.join(out)})"


def frame_quantiles(
    rows: DataFrame, keys: Sequence[str], quantiles: Sequence[float], *, max_shift: int | None = None, max_rows: int = MAX_ROWS
) -> DataFrame:
    """(keys, ts, quantiles) of the frame each row ends."""
    found = order_statistics(rows, keys, quantile_places(quantiles), max_shift=max_shift, max_rows=max_rows)
    w = Window.partitionBy(*keys).orderBy(TS)
    length = F.row_number().over(w) if max_shift is None else F.least(F.row_number().over(w), F.lit(max_shift + 1))
    sized = found.withColumn("_len", length)
    return sized.select(*keys, TS, F.expr(quantiles_sql(quantiles, "_len")).alias("quantiles"))


def largest(rows: DataFrame, keys: Sequence[str], k: int, *, max_shift: int | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """(keys, ts, tops): the ``k`` largest absolute values of the frame each row ends, largest first."""
    sized = rows.select(*keys, TS, F.abs(VALUE).alias("_abs"))
    places = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.col("_len") - i)
    found = order_statistics(sized, keys, places, value="_abs", max_shift=max_shift, max_rows=max_rows)
    return found.select(*keys, TS, F.reverse(F.array_sort(F.map_values("places"))).alias("tops"))
