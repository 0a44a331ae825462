"""The augmented Dickey-Fuller statistic as Spark SQL over arrays.

The regression is dy(t) on a constant, y(t-1) and dy(t-1) .. dy(t-p). Products of two lags depend on their
distance but for a few rows at either end, so a series (or each block of one) gives ``lags + 1`` sums of
products with the change itself and with the level, and the matrix of all products is filled along its
diagonals from the first and last values. With the level first and the lags in order, every lag choice is a
leading part of that matrix, and one elimination gives the squared residuals of all. The chosen lag is solved
again with the rows that fewer lags leave.

Each function gives layers of columns (name -> SQL), a layer over those before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidepanel.functions import adf
from tidepanel.functions.calculators import eliminated, let, total

Layer = dict[str, str]
#: Pivots and residuals below this share of what they started from count as nothing.
NOTHING = "1e-14D"


def apply(df: DataFrame, layers: Sequence[Layer]) -> DataFrame:
    for layer in layers:
        df = df.selectExpr("*", *[f"{sql} as {name}" for name, sql in layer.items()])
    return df


def lag_limit(n: str) -> str:
    """Largest lag tried for ``n`` points; negative when the series is too short."""
    return f"least(cast(ceil(12D * pow({n} / 100D, 0.25D)) as int), cast({n} div 2 as int) - 2)"


def dot(a: str, b: str) -> str:
    return total(f"zip_with({a}, {b}, (x, z) -> x * z)")


def differences(values: str) -> str:
    size = f"greatest(size({values}) - 1, 0)"
    return f"zip_with(slice({values}, 2, {size}), slice({values}, 1, {size}), (b, a) -> b - a)"


def sums(p: str, values: str, n: str, front: str = "0") -> list[Layer]:
    """``{p}sums`` of the rows of a block: ``values`` are centred, the first ``front`` of them stand before
    the block, ``n`` is the length of the whole series. NULL for a series that is too short."""
    lags, first, m = f"{p}lags", f"{p}first", f"{p}m"
    lagged = lambda j: f"slice({p}d, {first} - {j}, {m})"
    over = lambda sql: f"transform(sequence(0, {lags}), j -> {sql})"
    parts = {
        "m": f"cast({m} as bigint)",
        "change": over(dot(lagged("0"), lagged("j"))),
        "level": over(dot(f"{p}level", lagged("j"))),
        "each": over(total(lagged("j"))),
        "levels": total(f"{p}level"),
        "squares": dot(f"{p}level", f"{p}level"),
        "head": f"slice({values}, {front} + 1, {lags} + 1)",
        "tail": f"slice({values}, greatest(size({values}) - {lags}, 1), {lags} + 1)",
    }
    struct = ", ".join(f"'{k}', {v}" for k, v in parts.items())
    return [
        {lags: f"case when {n} >= 4 and {lag_limit(n)} >= 0 then {lag_limit(n)} end", f"{p}d": differences(values)},
        {first: f"case when {lags} is not null then greatest({front}, {lags} + 1) end"},
        {m: f"case when {first} is not null then greatest(size({values}) - {first}, 0) end"},
        {f"{p}level": f"slice({values}, {first}, {m})"},
        {f"{p}sums": f"case when {lags} is not null then named_struct({struct}) end"},
    ]


def merged(p: str, blocks: str) -> list[Layer]:
    """``{p}sums`` of a series from those of its blocks, in order."""
    add = lambda f: f"aggregate({blocks}, transform(get({blocks}, 0).{f}, x -> 0D), (s, b) -> zip_with(s, b.{f}, (x, z) -> x + z))"
    one = lambda f, zero: f"aggregate({blocks}, {zero}, (s, b) -> s + b.{f})"
    lags = f"size(get({blocks}, 0).change) - 1"
    parts = {
        "m": one("m", "0L"),
        "change": add("change"),
        "level": add("level"),
        "each": add("each"),
        "levels": one("levels", "0D"),
        "squares": one("squares", "0D"),
        "head": f"slice(flatten(transform({blocks}, b -> b.head)), 1, {lags} + 1)",
        "tail": f"element_at({blocks}, -1).tail",
    }
    struct = ", ".join(f"'{k}', {v}" for k, v in parts.items())
    return [{f"{p}sums": f"case when size({blocks}) > 0 and get({blocks}, 0) is not null then named_struct({struct}) end"}]


def _products(p: str, s: str) -> str:
    """All products of level, lags 1 .. L and the change, over the rows that every lag has."""
    edge = f"get({p}dh, L - q - 1) * get({p}dh, L - q - 1 - j + i) - get({p}dt, L - 1 - q) * get({p}dt, L - 1 - q - j + i)"
    ends = f"case when i = 0 then 0D else {total(f'transform(sequence(0, i - 1), q -> {edge})')} end"
    both = f"get({s}.change, j - i) + {ends}"
    lag = lambda a: f"case when {a} = L + 1 then 0 else {a} end"
    pair = let(f"least({lag('a')}, {lag('b')})", "i", let(f"greatest({lag('a')}, {lag('b')})", "j", both))
    cell = f"case when a = 0 and b = 0 then {s}.squares when a = 0 then get({s}.level, {lag('b')}) when b = 0 then get({s}.level, {lag('a')}) else {pair} end"
    return let(f"size({s}.change) - 1", "L", f"transform(sequence(0, L + 1), a -> transform(sequence(0, L + 1), b -> {cell}))")


def _centre(products: str, sums_: str, n: str) -> str:
    return f"transform({products}, (row, a) -> transform(row, (x, b) -> x - get({sums_}, a) * get({sums_}, b) / {n}))"


def solved(p: str) -> list[Layer]:
    """``{p}stat``, ``{p}lag`` and ``{p}nobs`` from ``{p}sums``; NULL where undefined."""
    s, lags, lag = f"{p}sums", f"{p}tried", f"{p}best"
    at = lambda m, i, j: f"get(get({m}, {i}), {j})"
    # Squared residuals of every lag, by eliminating level and lags in turn.
    pivot = f"case when {at('st.m', 'k', 'k')} > {NOTHING} * {at(f'{p}gram', 'k', 'k')} then {at('st.m', 'k', 'k')} end"
    cleared = f"transform(st.m, (row, i) -> case when i <= k then row else zip_with(row, get(st.m, k), (x, z) -> x - get(row, k) * z / pivot) end)"
    step = let(pivot, "pivot", let(cleared, "m", f"named_struct('m', m, 'ssr', concat(st.ssr, array({at('m', f'{lags} + 1', f'{lags} + 1')})))"))
    start = f"named_struct('m', {p}gram, 'ssr', cast(array() as array<double>))"
    whole = at(f"{p}gram", f"{lags} + 1", f"{lags} + 1")
    fine = f"not exists({p}ssr, x -> x is null or isnan(x) or x <= {whole} * {NOTHING})"
    aic = f"transform({p}ssr, (x, i) -> {s}.m * ln(x / {s}.m) + 2D * (i + 2))"
    # The chosen lag again: rows t = lag + 1 .. lags come back in from the head.
    z = lambda a: f"case when {a} = 0 then get({s}.head, t - 1) when {a} = {lag} + 1 then get({p}dh, t - 1) else get({p}dh, t - {a} - 1) end"
    more = f"case when {lag} < {lags} then sequence({lag} + 1, {lags}) else cast(array() as array<int>) end"
    full = f"case when {{0}} = {lag} + 1 then {lags} + 1 else {{0}} end"
    cell = f"{at(f'{p}products', full.format('a'), full.format('b'))} + {total(f'transform({more}, t -> ({z('a')}) * ({z('b')}))')}"
    sum_of = f"get({p}total, {full.format('a')}) + {total(f'transform({more}, t -> {z('a')})')}"
    wide = f"concat(slice(row, 1, {lag} + 1), array(get(row, {lag} + 1), case when i = 0 then 1D else 0D end))"
    g, n, target = f"{p}again", f"{p}n", f"{lag} + 1"
    betas = f"transform({p}solution, (row, i) -> get(row, {target}) / get(row, i))"
    rest = f"{at(g, target, target)} - {total(f'transform({betas}, (x, i) -> x * {at(g, 'i', target)})')}"
    unit = f"{at(f'{p}solution', '0', f'{lag} + 2')} / {at(f'{p}solution', '0', '0')}"
    return [
        {f"{p}dh": differences(f"{s}.head"), f"{p}dt": differences(f"{s}.tail"), lags: f"size({s}.change) - 1"},
        {
            f"{p}products": f"case when {s}.m > 0 then {_products(p, s)} end",
            f"{p}total": f"concat(array({s}.levels), slice({s}.each, 2, {lags}), array(get({s}.each, 0)))",
        },
        {f"{p}gram": _centre(f"{p}products", f"{p}total", f"{s}.m")},
        {f"{p}ssr": f"aggregate(sequence(0, {lags}), {start}, (st, k) -> {step}, st -> st.ssr)"},
        {f"{p}aic": f"case when {fine} then {aic} end"},
        {lag: f"cast(array_position({p}aic, array_min({p}aic)) as int) - 1"},
        {
            f"{p}more": f"transform(sequence(0, {target}), a -> transform(sequence(0, {target}), b -> {cell}))",
            f"{p}sum": f"transform(sequence(0, {target}), a -> {sum_of})",
            n: f"cast({s}.m + {lags} - {lag} as int)",
        },
        {g: _centre(f"{p}more", f"{p}sum", n)},
        {f"{p}size": f"transform(sequence(0, {lag}), i -> {at(g, 'i', 'i')})"},
        {f"{p}solution": eliminated(f"transform(slice({g}, 1, {lag} + 1), (row, i) -> {wide})", f"{p}size", NOTHING)},
        {f"{p}rest": rest, f"{p}beta": f"get({betas}, 0)", f"{p}unit": unit},
        {
            f"{p}stat": f"case when {n} > {lag} + 2 and {p}rest > {at(g, target, target)} * {NOTHING} "
            f"then {p}beta / sqrt({p}rest / ({n} - {lag} - 2) * {p}unit) end"
        },
        {f"{p}lag": f"case when {p}stat is not null then {lag} end", f"{p}nobs": f"case when {p}stat is not null then {n} end"},
    ]


def of_values(p: str, values: str) -> list[Layer]:
    """The same from the array of a whole series; a constant one has no statistic."""
    return [
        {f"{p}mean": f"{total(values)} / size({values})"},
        {f"{p}y": f"case when array_max({values}) > array_min({values}) then transform({values}, x -> x - {p}mean) end"},
        *sums(p, f"{p}y", f"size({p}y)"),
        *solved(p),
    ]


def normal_below(z: str) -> str:
    """The normal distribution function: its series near 0, the continued fraction of its tail far out."""
    density = f"exp(-{z} * {z} / 2) / 2.5066282746310002D"
    step = f"named_struct('term', s.term * {z} * {z} / (2 * k + 1), 'sum', s.sum + s.term * {z} * {z} / (2 * k + 1))"
    near = f"0.5D + {density} * aggregate(sequence(1, 60), named_struct('term', {z}, 'sum', {z}), (s, k) -> {step}, s -> s.sum)"
    tail = f"{density} / aggregate(sequence(150, 1, -1), abs({z}), (a, k) -> abs({z}) + k / a)"
    return f"case when abs({z}) <= 2.5 then {near} when {z} < 0 then {tail} else 1 - {tail} end"


def p_value(stat: str) -> str:
    def power_sum(coefficients: Sequence[float]) -> str:
        return " + ".join(f"{c!r}D * pow({stat}, {k})" for k, c in enumerate(coefficients))

    z = f"case when {stat} <= {adf.P_TAU_STAR!r}D then {power_sum(adf.P_SMALL)} else {power_sum(adf.P_LARGE)} end"
    inside = let(z, "z", normal_below("z"))
    return f"case when {stat} > {adf.P_TAU_MAX!r}D then 1D when {stat} < {adf.P_TAU_MIN!r}D then 0D when {stat} is not null then {inside} end"


def critical_value(percent: int, nobs: str) -> str:
    return " + ".join(f"{c!r}D / pow({nobs}, {k})" for k, c in enumerate(adf.CRITICAL[percent]))
