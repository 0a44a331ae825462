"""Time-series calculators as Spark SQL expressions over a row frame.

Every row of a series gets the calculators of the frame that ends at it. Three
layers keep each expression a single pass: row columns (lags), window aggregates
over the frame, and scalar expressions over those, among them higher-order
functions over the frame as an array. Expressions are SQL text: a set has some
three hundred numbers, and text reaches the JVM in a handful of calls.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from tidepanel.keys import TS, VALUE

V = VALUE
#: Rolling frames and series up to so many rows (50 years of months) are looked through frame by frame, which
#: costs them less than another shuffle; the order statistics of all others come from the tree of ranks.
SHORT = 600
#: Columns that the tree of ranks adds.
QUANTILES_COLUMN, TOPS_COLUMN = "_quantiles", "_tops"
#: Rows of the whole series.
ROWS_COLUMN = "_series_rows"


def label(name: str, **params) -> str:
    """Feature name of a calculator: name__key_value, keys in order, text quoted."""
    shown = (f'{k}_"{v}"' if isinstance(v, str) else f"{k}_{v}" for k, v in sorted(params.items()))
    return "__".join([name, *shown])


@dataclass
class Frame:
    """What the calculators ask for: row columns, frame aggregates, derived columns.

    Every method registers an expression once and returns its column name.
    """

    keys: Sequence[str]
    max_shift: int | None = None
    rows: dict[str, str] = field(default_factory=dict)
    marks: dict[str, str] = field(default_factory=dict)
    chunks: dict[str, str] = field(default_factory=dict)
    counts: dict[str, str] = field(default_factory=dict)
    aggregates: dict[str, str] = field(default_factory=dict)
    derived: dict[str, str] = field(default_factory=dict)
    quantiles_asked: list[float] = field(default_factory=list)
    tops_asked: int = 0

    @property
    def order(self) -> str:
        return f"partition by {', '.join(self.keys)} order by {TS}"

    def lag(self, k: int) -> str:
        return self._put(self.rows, f"_lag{k}", f"lag({V}, {k}) over ({self.order})")

    @property
    def short(self) -> bool:
        """Whether every frame is short."""
        return self.max_shift is not None and self.max_shift < SHORT

    @property
    def of_short(self) -> str:
        """The value in a short series, else NULL."""
        return f"case when {self._put(self.rows, ROWS_COLUMN, f'count(*) over (partition by {", ".join(self.keys)})')} <= {SHORT} then {V} end"

    def mark(self, name: str, sql: str) -> str:
        """A row column over other row columns."""
        return self._put(self.marks, f"_m_{name}", sql)

    def occurrence(self, name: str, of: str) -> str:
        """How often, this time included, ``of`` has had the row's value; rows without one have none."""
        nth = f"row_number() over (partition by {', '.join(self.keys)}, {of} order by {TS})"
        return self.mark(name, f"case when {of} is not null then {nth} end")

    def occurrence_of_mark(self, name: str, of: str) -> str:
        """The same for a mark."""
        nth = f"row_number() over (partition by {', '.join(self.keys)}, {of} order by {TS})"
        return self._put(self.counts, f"_n_{name}", f"case when {of} is not null then {nth} end")

    def quantiles(self, qs: Sequence[float]) -> str:
        """Array of quantiles of the frame."""
        name = "q_" + "_".join(str(q).replace(".", "p") for q in qs)
        if self.short:
            return self.agg(name, f"percentile({V}, {doubles(qs)})")
        self.quantiles_asked += [q for q in qs if q not in self.quantiles_asked]
        places = ", ".join(f"get({QUANTILES_COLUMN}, {self.quantiles_asked.index(q)})" for q in qs)
        return self.derive(name, f"coalesce({self.agg(name, f'percentile({self.of_short}, {doubles(qs)})')}, array({places}))")

    def largest(self, k: int) -> str:
        """Array of the ``k`` largest absolute values, largest first; fewer in a shorter frame."""
        values = self.values if self.short else self.agg("short_values", f"collect_list({self.of_short})")
        by_size = self.derive("by_size", f"reverse(array_sort(transform({values}, v -> abs(v))))")
        if self.short:
            return f"slice({by_size}, 1, {k})"
        self.tops_asked = max(self.tops_asked, k)
        return f"slice(coalesce({TOPS_COLUMN}, {by_size}), 1, {k})"

    def agg(self, name: str, sql: str, shift: int = 0) -> str:
        """Aggregate over the frame; ``shift`` leaves out its first rows, whose
        lags lie in front of it."""
        if self.max_shift is None:
            over = f"{sql} over ({self.order} rows between unbounded preceding and current row)"
        elif shift > self.max_shift:
            over = "cast(null as double)"
        else:
            over = f"{sql} over ({self.order} rows between {self.max_shift - shift} preceding and current row)"
        return self._put(self.aggregates, f"_a_{name}", over)

    def sliding(self, name: str, sql: str) -> str:
        """Sum over a rolling frame as the difference of two running sums, so that no frame is summed again."""
        over = f"sum({sql}) over ({self.order} rows between unbounded preceding and"
        return self._put(self.aggregates, f"_s_{name}", f"{over} current row) - coalesce({over} {self.max_shift + 1} preceding), 0D)")

    def derive(self, name: str, sql: str) -> str:
        return self._put(self.derived, f"_d_{name}", sql)

    def derived_layers(self) -> list[dict[str, str]]:
        """Derived columns in layers, each over those before it."""
        depth: dict[str, int] = {}
        for name, sql in self.derived.items():
            depth[name] = 1 + max((depth[n] for n in re.findall(r"\b_d_\w+", sql)), default=-1)
        layers = range(max(depth.values(), default=-1) + 1)
        return [{n: sql for n, sql in self.derived.items() if depth[n] == i} for i in layers]

    @staticmethod
    def _put(where: dict[str, str], name: str, sql: str) -> str:
        where.setdefault(name, sql)
        return name

    # Common pieces.
    @property
    def n(self) -> str:
        return f"cast({self.size} as double)"

    @property
    def size(self) -> str:
        return self.agg("n", f"count({V})")

    @property
    def mean(self) -> str:
        return self.agg("mean", f"avg({V})")

    @property
    def sd(self) -> str:
        return self.agg("sd", f"stddev_pop({V})")

    @property
    def var(self) -> str:
        return self.agg("var", f"var_pop({V})")

    @property
    def low(self) -> str:
        return self.agg("min", f"min({V})")

    @property
    def high(self) -> str:
        return self.agg("max", f"max({V})")

    @property
    def span(self) -> str:
        return f"({self.high} - {self.low})"

    @property
    def median(self) -> str:
        return f"get({self.quantiles((0.5,))}, 0)"

    @property
    def energy(self) -> str:
        return self.agg("energy", f"sum({V} * {V})")

    @property
    def position(self) -> str:
        """0-based place of the row in its series."""
        return self._put(self.rows, "_pos", f"cast(row_number() over ({self.order}) - 1 as double)")

    @property
    def start(self) -> str:
        """Place in the series of the frame's first row."""
        return self.agg("start", f"min({self.position})")

    @property
    def values(self) -> str:
        return self.agg("values", f"collect_list({V})")

    @property
    def length(self) -> str:
        """Row count as an integer, for places in arrays."""
        return self.derive("length", f"cast({self.size} as int)")

    @property
    def ordered(self) -> str:
        return self.derive("ordered", f"array_sort({self.values})")


# One calculator gives feature names and an array expression with their numbers.
Piece = tuple[Sequence[str], str]
Calculator = Callable[[Frame], list[Piece]]
MINIMAL: dict[str, Calculator] = {}
RUNNING: dict[str, Calculator] = {}
LAGGED: dict[str, Calculator] = {}
ORDER: dict[str, Calculator] = {}
ARRAY: dict[str, Calculator] = {}
RECURSIVE: dict[str, Calculator] = {}
#: For rolling frames only.
SPECTRAL: dict[str, Calculator] = {}


def _into(registry: dict[str, Calculator]):
    def add(fn: Calculator) -> Calculator:
        registry[fn.__name__] = fn
        return fn

    return add


def one(name: str, sql: str) -> Piece:
    return [name], f"array(cast({sql} as double))"


def many(names: Sequence[str], sql: str) -> Piece:
    return list(names), sql


def _simple(registry: dict, name: str, make: Callable[[Frame], str]) -> None:
    registry[name] = lambda f: [one(name, make(f))]


def flag(condition: str) -> str:
    return f"cast(({condition}) as double)"


def ratio(a: str, b: str) -> str:
    return f"try_divide(cast({a} as double), cast({b} as double))"


def total(array: str) -> str:
    return f"aggregate({array}, 0D, (acc, x) -> acc + x)"


def doubles(values: Sequence[float]) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


# --- minimal set ----------------------------------------------------------------------

_simple(MINIMAL, "sum_values", lambda f: f.agg("sum", f"sum({V})"))
_simple(MINIMAL, "median", lambda f: f.median)
_simple(MINIMAL, "mean", lambda f: f.mean)
_simple(MINIMAL, "length", lambda f: f.size)
_simple(MINIMAL, "standard_deviation", lambda f: f.sd)
_simple(MINIMAL, "variance", lambda f: f.var)
_simple(MINIMAL, "root_mean_square", lambda f: f"sqrt({f.agg('mean_square', f'avg({V} * {V})')})")
_simple(MINIMAL, "maximum", lambda f: f.high)
_simple(MINIMAL, "absolute_maximum", lambda f: f.agg("absmax", f"max(abs({V}))"))
_simple(MINIMAL, "minimum", lambda f: f.low)

# --- running aggregates ------------------------------------------------------------------

# The parameter grids of the published calculator sets.
LARGE_SD_R = [r * 0.05 for r in range(1, 20)]
SYMMETRY_R = [r * 0.05 for r in range(20)]
QUANTILES = (0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9)
SIGMAS = (0.5, 1, 1.5, 2, 2.5, 3, 5, 6, 7, 10)
CORRIDOR = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
PEAK_SUPPORT = (1, 3, 5, 10, 50)
RANGES = ((-1, 1), (-1e12, 0), (0, 1e12))
COUNTED = (0, 1, -1)
LAGS = (1, 2, 3)
CROSSED = (0, -1, 1)
LARGEST = (3, 5, 7)
ACF_LAGS = 10
ACF_MAXLAG = 40
CHUNKS = 10
BINS = 10

_simple(RUNNING, "abs_energy", lambda f: f.energy)
_simple(RUNNING, "variance_larger_than_standard_deviation", lambda f: flag(f"{f.var} > {f.sd}"))
_simple(RUNNING, "variation_coefficient", lambda f: ratio(f.sd, f.mean))


@_into(RUNNING)
def skewness(f: Frame) -> list[Piece]:
    plain = f.agg("skewness", f"skewness({V})")
    adjusted = f"{plain} * sqrt({f.n} * ({f.n} - 1)) / ({f.n} - 2)"
    return [one("skewness", f"case when {f.size} > 2 then case when {f.var} > 0 then {adjusted} else 0D end end")]


@_into(RUNNING)
def kurtosis(f: Frame) -> list[Piece]:
    n, plain = f.n, f.agg("kurtosis", f"kurtosis({V})")
    adjusted = f"({n} - 1) / (({n} - 2) * ({n} - 3)) * (({n} + 1) * {plain} + 6)"
    return [one("kurtosis", f"case when {f.size} > 3 then case when {f.var} > 0 then {adjusted} else 0D end end")]


@_into(RUNNING)
def count_above(f: Frame) -> list[Piece]:
    return [one(label("count_above", t=0), ratio(f.agg("above0", f"count_if({V} >= 0)"), f.n))]


@_into(RUNNING)
def count_below(f: Frame) -> list[Piece]:
    return [one(label("count_below", t=0), ratio(f.agg("below0", f"count_if({V} <= 0)"), f.n))]


@_into(RUNNING)
def range_count(f: Frame) -> list[Piece]:
    return [
        one(
            label("range_count", min=lo, max=hi),
            f.agg(f"range{i}", f"count_if({V} >= {float(lo)!r}D and {V} < {float(hi)!r}D)"),
        )
        for i, (lo, hi) in enumerate(RANGES)
    ]


@_into(RUNNING)
def value_count(f: Frame) -> list[Piece]:
    return [
        one(label("value_count", value=c), f.agg(f"equal{i}", f"count_if({V} = {float(c)!r}D)"))
        for i, c in enumerate(COUNTED)
    ]


@_into(RUNNING)
def large_standard_deviation(f: Frame) -> list[Piece]:
    # Two points have a deviation of exactly half their span: a tie is not larger.
    names = [label("large_standard_deviation", r=r) for r in LARGE_SD_R]
    test = flag(f"{f.sd} * {1 - 1e-12!r}D > r * {f.span}")
    return [many(names, f"transform({doubles(LARGE_SD_R)}, r -> {test})")]


@_into(RUNNING)
def symmetry_looking(f: Frame) -> list[Piece]:
    names = [label("symmetry_looking", r=r) for r in SYMMETRY_R]
    test = flag(f"abs({f.mean} - {f.median}) < r * {f.span}")
    return [many(names, f"transform({doubles(SYMMETRY_R)}, r -> {test})")]


@_into(RUNNING)
def linear_trend(f: Frame) -> list[Piece]:
    """Least squares of the value on its place 0, 1, 2, ... in the frame."""
    n, slope = f.n, f.agg("slope", f"regr_slope({V}, {f.position})")
    sxx, syy = f"({n} * ({n} * {n} - 1) / 12)", f"({f.var} * {n})"
    left = f"greatest({syy} - {slope} * {slope} * {sxx}, 0D)"
    parts = {
        "intercept": f"{f.mean} - {slope} * ({n} - 1) / 2",
        "rvalue": f"case when {syy} > 0 then {slope} * sqrt({sxx} / {syy}) else 0D end",
        "slope": slope,
        "stderr": f"case when {f.size} > 2 then sqrt({left} / {sxx} / ({n} - 2)) else 0D end",
    }
    return [one(label("linear_trend", attr=k), f"case when {f.size} > 1 then {sql} end") for k, sql in parts.items()]


# --- lag, then aggregate -----------------------------------------------------------------------


def _change(f: Frame) -> str:
    return f"({V} - {f.lag(1)})"


_simple(LAGGED, "absolute_sum_of_changes", lambda f: f"coalesce({f.agg('abs_changes', f'sum(abs{_change(f)})', 1)}, 0D)")
_simple(LAGGED, "mean_abs_change", lambda f: f.agg("mean_abs_change", f"avg(abs{_change(f)})", 1))
_simple(LAGGED, "mean_change", lambda f: f.agg("mean_change", f"avg({_change(f)})", 1))
_simple(
    LAGGED,
    "mean_second_derivative_central",
    lambda f: f.agg("curvature", f"avg(0.5D * ({V} - 2 * {f.lag(1)} + {f.lag(2)}))", 2),
)


@_into(LAGGED)
def c3(f: Frame) -> list[Piece]:
    product = lambda k: f"avg({f.lag(2 * k)} * {f.lag(k)} * {V})"
    return [one(label("c3", lag=k), f"coalesce({f.agg(f'c3_{k}', product(k), 2 * k)}, 0D)") for k in LAGS]


@_into(LAGGED)
def time_reversal_asymmetry_statistic(f: Frame) -> list[Piece]:
    out = []
    for k in LAGS:
        a, b = f.lag(2 * k), f.lag(k)
        value = f.agg(f"reversal_{k}", f"avg({V} * {V} * {b} - {b} * {a} * {a})", 2 * k)
        out.append(one(label("time_reversal_asymmetry_statistic", lag=k), f"coalesce({value}, 0D)"))
    return out


@_into(LAGGED)
def cid_ce(f: Frame) -> list[Piece]:
    length = f"sqrt(coalesce({f.agg('sq_changes', f'sum({_change(f)} * {_change(f)})', 1)}, 0D))"
    scaled = f"case when {f.sd} > 0 then {length} / {f.sd} else 0D end"
    return [one(label("cid_ce", normalize=True), scaled), one(label("cid_ce", normalize=False), length)]


@_into(LAGGED)
def number_crossing_m(f: Frame) -> list[Piece]:
    out = []
    for i, m in enumerate(CROSSED):
        crossed = f"count_if(({V} > {float(m)!r}D) <> ({f.lag(1)} > {float(m)!r}D))"
        out.append(one(label("number_crossing_m", m=m), f"coalesce({f.agg(f'cross_{i}', crossed, 1)}, 0)"))
    return out


# --- order and multiplicity ------------------------------------------------------------------------


@_into(ORDER)
def quantile(f: Frame) -> list[Piece]:
    names = [label("quantile", q=q) for q in QUANTILES]
    return [many(names, f.quantiles(QUANTILES))]


def _place(f: Frame, name: str, pick: str, sign: str) -> str:
    """Place in the frame of an extreme value. max_by/min_by compare (value,
    signed place), so ties go to the wanted end."""
    at = f.position
    return f"({f.agg(name, f'{pick}({at}, struct({V}, {sign}{at}))')} - {f.start})"


_simple(ORDER, "first_location_of_maximum", lambda f: ratio(_place(f, "first_max", "max_by", "-"), f.n))
_simple(ORDER, "last_location_of_maximum", lambda f: ratio(_place(f, "last_max", "max_by", "") + " + 1", f.n))
_simple(ORDER, "first_location_of_minimum", lambda f: ratio(_place(f, "first_min", "min_by", ""), f.n))
_simple(ORDER, "last_location_of_minimum", lambda f: ratio(_place(f, "last_min", "min_by", "-") + " + 1", f.n))


def _nth(f: Frame) -> str:
    return f.occurrence("nth", V)


def _distinct(f: Frame) -> str:
    """How many different values there are: those that came for the first time."""
    if f.max_shift is None:
        return f"cast({f.agg('firsts', f'count_if({_nth(f)} = 1)')} as double)"
    return f.derive("distinct", f"cast(size(array_distinct({f.values})) as double)")


def _repeated(f: Frame) -> str:
    """In a rolling frame, the values whose sorted neighbour is equal, once per occurrence."""
    s = f.ordered
    left = f"(i > 0 and get({s}, i - 1) = v)"
    right = f"(i < size({s}) - 1 and get({s}, i + 1) = v)"
    return f.derive("repeated", f"filter({s}, (v, i) -> {left} or {right})")


def _reoccurring(f: Frame) -> dict[str, str]:
    """Number and sum of the values that occur again, and of all their rows. In an expanding frame a value
    counts from its second occurrence on, and brings its first row with it."""
    if f.max_shift is None:
        nth = _nth(f)
        weight = f"case when {nth} = 2 then 2 when {nth} > 2 then 1 else 0 end"
        return {
            "values": f.agg("seconds", f"count_if({nth} = 2)"),
            "rows": f.agg("again_rows", f"sum({weight})"),
            "value_sum": f.agg("again_sum", f"sum(case when {nth} = 2 then {V} else 0D end)"),
            "row_sum": f.agg("again_row_sum", f"sum({weight} * {V})"),
        }
    again = _repeated(f)
    return {
        "values": f"size(array_distinct({again}))",
        "rows": f"size({again})",
        "value_sum": total(f"array_distinct({again})"),
        "row_sum": total(again),
    }


def _extreme_again(f: Frame, extreme: str, sign: str) -> str:
    """Whether the largest (smallest) value is there twice: its last occurrence so far has a number above 1."""
    if f.max_shift is None:
        last = f.agg(f"{extreme}_nth", f"{extreme}(named_struct('v', {V}, 'nth', {sign}{_nth(f)}))")
        return flag(f"abs({last}.nth) > 1")
    return flag(f"size(filter({f.values}, v -> v = {f.high if extreme == 'max' else f.low})) > 1")


_simple(ORDER, "has_duplicate", lambda f: flag(f"{_distinct(f)} < {f.n}"))
_simple(ORDER, "has_duplicate_max", lambda f: _extreme_again(f, "max", ""))
_simple(ORDER, "has_duplicate_min", lambda f: _extreme_again(f, "min", "-"))
_simple(
    ORDER,
    "percentage_of_reoccurring_values_to_all_values",
    lambda f: ratio(_reoccurring(f)["values"], _distinct(f)),
)
_simple(
    ORDER, "percentage_of_reoccurring_datapoints_to_all_datapoints", lambda f: ratio(_reoccurring(f)["rows"], f.n)
)
_simple(ORDER, "sum_of_reoccurring_values", lambda f: _reoccurring(f)["value_sum"])
_simple(ORDER, "sum_of_reoccurring_data_points", lambda f: _reoccurring(f)["row_sum"])
_simple(ORDER, "ratio_value_number_to_time_series_length", lambda f: ratio(_distinct(f), f.n))


@_into(ORDER)
def mean_n_absolute_max(f: Frame) -> list[Piece]:
    return [
        one(label("mean_n_absolute_max", number_of_maxima=k), f"case when {f.size} > {k} then {total(f.largest(k))} / {k} end")
        for k in LARGEST
    ]


# --- the frame as an array ----------------------------------------------------------------------------

_simple(ARRAY, "count_above_mean", lambda f: f"size(filter({f.values}, v -> v > {f.mean}))")
_simple(ARRAY, "count_below_mean", lambda f: f"size(filter({f.values}, v -> v < {f.mean}))")


def _strike(f: Frame, test: str) -> str:
    """Longest run of consecutive values meeting the test."""
    run = f"case when v {test} {f.mean} then acc.run + 1 else 0 end"
    step = f"named_struct('run', {run}, 'best', greatest(acc.best, {run}))"
    return f"aggregate({f.values}, named_struct('run', 0, 'best', 0), (acc, v) -> {step}, acc -> acc.best)"


_simple(ARRAY, "longest_strike_above_mean", lambda f: _strike(f, ">"))
_simple(ARRAY, "longest_strike_below_mean", lambda f: _strike(f, "<"))


@_into(ARRAY)
def ratio_beyond_r_sigma(f: Frame) -> list[Piece]:
    beyond = f"cast(size(filter({f.values}, v -> abs(v - {f.mean}) > r * {f.sd})) as double) / {f.n}"
    names = [label("ratio_beyond_r_sigma", r=r) for r in SIGMAS]
    return [many(names, f"transform({doubles(SIGMAS)}, r -> {beyond})")]


@_into(ARRAY)
def energy_ratio_by_chunks(f: Frame) -> list[Piece]:
    squares = f.derive("squares", f"transform({f.values}, v -> v * v)")
    quot, rest = f"({f.length} div {CHUNKS})", f"({f.length} % {CHUNKS})"
    begin = f"cast(i * {quot} + least(i, {rest}) + 1 as int)"
    taken = f"cast({quot} + case when i < {rest} then 1 else 0 end as int)"
    share = f"case when {f.energy} > 0 then {total(f'slice({squares}, {begin}, {taken})')} / {f.energy} end"
    names = [label("energy_ratio_by_chunks", num_segments=CHUNKS, segment_focus=i) for i in range(CHUNKS)]
    return [many(names, f"transform(sequence(0, {CHUNKS - 1}), i -> {share})")]


@_into(ARRAY)
def index_mass_quantile(f: Frame) -> list[Piece]:
    mass = f.agg("abs_sum", f"sum(abs({V}))")
    run = "(acc.sum + abs(v))"
    step = f"named_struct('sum', {run}, 'before', acc.before + {flag(f'{run} / {mass} < q')})"
    before = (
        f"aggregate({f.values}, named_struct('sum', 0D, 'before', 0D), (acc, v) -> {step}, acc -> acc.before)"
    )
    place = f"case when {mass} > 0 then ({before} + 1) / {f.n} end"
    names = [label("index_mass_quantile", q=q) for q in QUANTILES]
    return [many(names, f"transform({doubles(QUANTILES)}, q -> {place})")]


@_into(ARRAY)
def number_peaks(f: Frame) -> list[Piece]:
    x, size = f.values, f.length
    out = []
    for k in PEAK_SUPPORT:
        inner = f"case when {size} > {2 * k} then sequence({k}, {size} - {k + 1}) else cast(array() as array<int>) end"
        tops = (
            f"get({x}, i) > array_max(slice({x}, i - {k - 1}, {k})) "
            f"and get({x}, i) > array_max(slice({x}, i + 2, {k}))"
        )
        out.append(one(label("number_peaks", n=k), f"size(filter({inner}, i -> {tops}))"))
    return out


@_into(ARRAY)
def binned_entropy(f: Frame) -> list[Piece]:
    bin_of = f"least(cast(floor({ratio(f'v - {f.low}', f.span)} * {BINS}) as int), {BINS - 1})"
    bins = f.derive("bins", f"transform({f.values}, v -> {bin_of})")
    share = f"cast(size(filter({bins}, x -> x = b)) as double) / {f.n}"
    shares = f"filter(transform(sequence(0, {BINS - 1}), b -> {share}), p -> p > 0)"
    entropy = total(f"transform({shares}, p -> -p * ln(p))")
    return [one(label("binned_entropy", max_bins=BINS), f"case when {f.span} > 0 then {entropy} else 0D end")]


@_into(ARRAY)
def change_quantiles(f: Frame) -> list[Piece]:
    """Mean and variance of the steps that stay inside a corridor of quantiles."""
    edges = f.quantiles(CORRIDOR)
    x, m = f.values, f"greatest({f.length} - 1, 0)"
    steps = f.derive(
        "steps",
        f"zip_with(slice({x}, 1, {m}), slice({x}, 2, {m}), (a, b) -> named_struct('a', a, 'b', b))",
    )
    names, grid = [], []
    for i, lo in enumerate(CORRIDOR[:-1]):
        for j, hi in list(enumerate(CORRIDOR))[i + 1 :]:
            for absolute in (False, True):
                grid.append(f"named_struct('lo', get({edges}, {i}), 'hi', get({edges}, {j}), 'abs', {str(absolute).lower()})")
                names += [label("change_quantiles", ql=lo, qh=hi, isabs=absolute, f_agg=how) for how in ("mean", "var")]
    inside = f"filter({steps}, s -> s.a between g.lo and g.hi and s.b between g.lo and g.hi)"
    moves = f"transform({inside}, s -> case when g.abs then abs(s.b - s.a) else s.b - s.a end)"
    add = "named_struct('s', acc.s + v, 'ss', acc.ss + v * v, 'n', acc.n + 1)"
    spread = "greatest(acc.ss / acc.n - (acc.s / acc.n) * (acc.s / acc.n), 0D)"
    close = (
        f"case when acc.n = 0 or g.lo = g.hi then array(0D, 0D) else array(acc.s / acc.n, {spread}) end"
    )
    zero = "named_struct('s', 0D, 'ss', 0D, 'n', 0D)"
    both = f"aggregate({moves}, {zero}, (acc, v) -> {add}, acc -> {close})"
    return [many(names, f"flatten(transform(array({', '.join(grid)}), g -> {both}))")]


def centred(f: Frame) -> str:
    """The value less the first of its series, which keeps running sums of products small; statistics about the
    mean do not see the difference."""
    return f._put(f.rows, "_centred", f"{V} - first_value({V}) over ({f.order})")


def lag_of_centred(f: Frame, k: int) -> str:
    at = centred(f)
    return at if k == 0 else f.mark(f"lagged{k}", f"lag({at}, {k}) over ({f.order})")


def autocovariance_sum(f: Frame, k: int) -> str:
    """Sum over the frame of (x(t) - mean) (x(t-k) - mean), from running sums; NULL where k is too long."""
    now, then = centred(f), lag_of_centred(f, k)
    mean = f.agg("centred_mean", f"avg({now})")
    product = f.agg(f"lag_product{k}", f"sum({now} * {then})", k)
    later, earlier = f.agg(f"later{k}", f"sum(case when {then} is not null then {now} end)", k), f.agg(f"earlier{k}", f"sum({then})", k)
    rows = f"({f.n} - {k})"
    return f.derive(f"autocov{k}", f"case when {f.size} > {k} then {product} - {mean} * ({later} + {earlier}) + {rows} * {mean} * {mean} end")


def _autocorrelation(f: Frame, lag: int) -> str:
    """Autocorrelation at a lag, NULL for a constant frame or too long a lag."""
    return f"case when {lag} < {f.size} and {f.var} > 1e-15 then {autocovariance_sum(f, lag)} / (({f.n} - {lag}) * {f.var}) end"


@_into(ARRAY)
def autocorrelation(f: Frame) -> list[Piece]:
    return [one(label("autocorrelation", lag=k), _autocorrelation(f, k)) for k in range(ACF_LAGS)]


@_into(ARRAY)
def agg_autocorrelation(f: Frame) -> list[Piece]:
    defined = f"({f.size} > 1 and {f.var} >= 1e-10)"
    lags = ", ".join(_autocorrelation(f, k) for k in range(1, ACF_MAXLAG + 1))
    acf = f.derive("acf", f"case when {defined} then slice(array({lags}), 1, least({ACF_MAXLAG}, {f.length} - 1)) end")
    ordered = f.derive("acf_sorted", f"array_sort({acf})")
    m = f"size({acf})"
    mean = f.derive("acf_mean", f"{total(acf)} / {m}")
    half = f"({m} div 2)"
    at = lambda i: f"get({ordered}, cast({i} as int))"
    median = f"case when {m} % 2 = 1 then {at(half)} else ({at(half + ' - 1')} + {at(half)}) / 2 end"
    var = f"{total(f'transform({acf}, a -> (a - {mean}) * (a - {mean}))')} / {m}"
    return [
        one(label("agg_autocorrelation", f_agg=k, maxlag=ACF_MAXLAG), f"coalesce(case when {defined} then {sql} end, 0D)")
        for k, sql in (("mean", mean), ("median", median), ("var", var))
    ]


@_into(ARRAY)
def benford_correlation(f: Frame) -> list[Piece]:
    """Correlation of the first digits with the shares log10(1 + 1/d)."""
    # The shortest decimal text of a double starts with its first digit.
    digit = "cast(regexp_extract(cast(abs(v) as string), '[1-9]', 0) as int)"
    digits = f.derive("digits", f"transform(filter({f.values}, v -> v <> 0), v -> {digit})")
    share = f"size(filter({digits}, x -> x = d)) / {f.n}"
    shares = f.derive("digit_shares", f"transform(sequence(1, 9), d -> {share})")
    mean = f.derive("digit_mean", f"{total(shares)} / 9")
    law = "transform(sequence(1, 9), d -> log10(1D + 1D / d) - 1D / 9)"
    off = f"transform({shares}, s -> s - {mean})"
    cross = total(f"zip_with({off}, {law}, (s, p) -> s * p)")
    squares = lambda a: total(f"transform({a}, z -> z * z)")
    ss = f.derive("digit_spread", squares(off))
    return [one("benford_correlation", f"case when {ss} > 0 then {cross} / sqrt({ss} * {squares(law)}) end")]


# --- recursions over running sums -----------------------------------------------------------------------------

AR_ORDER = 10
PACF_LAGS = 10
PERMUTATION_DIMS = (3, 4, 5, 6, 7)


def let(value: str, name: str, sql: str) -> str:
    """``sql`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {sql}), 1)"


@_into(RECURSIVE)
def partial_autocorrelation(f: Frame) -> list[Piece]:
    """Durbin-Levinson recursion on adjusted autocovariances of lags up to half the frame less one. A frame
    without variance has none."""
    adjusted = ", ".join(f"{autocovariance_sum(f, k)} / ({f.n} - {k})" for k in range(PACF_LAGS))
    c = f.derive("acvf", f"array({adjusted})")
    known = total(f"zip_with(s.phi, reverse(slice({c}, 2, k - 1)), (p, x) -> p * x)")
    step = """named_struct('phi', concat(zip_with(s.phi, reverse(s.phi), (p, q) -> p - r * q), array(r)),
                           'error', s.error * (1D - r * r), 'out', concat(s.out, array(r)))"""
    start = f"named_struct('phi', cast(array() as array<double>), 'error', get({c}, 0), 'out', array(1D))"
    each = let(f"try_divide(get({c}, k) - {known}, s.error)", "r", step)
    lags = f"sequence(1, least({PACF_LAGS - 1}, {f.length} div 2 - 1))"
    out = f.derive("pacf", f"case when {f.size} > 3 and {f.var} > 0 then aggregate({lags}, {start}, (s, k) -> {each}, s -> s.out) end")
    return [one(label("partial_autocorrelation", lag=k), f"get({out}, {k})") for k in range(PACF_LAGS)]


def eliminated(matrix: str, sizes: str, nothing: str = "1e-10D") -> str:
    """The rows of an array of rows (a square beside its right sides), cleared by elimination of all but the
    diagonal and the right sides; NULL from the first pivot on that is nothing beside its entry of ``sizes``."""
    pivot = f"case when get(get(m, p), p) > {nothing} * get({sizes}, p) then get(get(m, p), p) end"
    cleared = "case when i = p then row else zip_with(row, get(m, p), (a, b) -> a - get(row, p) * b / pivot) end"
    step = let(pivot, "pivot", f"transform(m, (row, i) -> {cleared})")
    return f"aggregate(sequence(0, size({sizes}) - 1), {matrix}, (m, p) -> {step})"


@_into(RECURSIVE)
def ar_coefficient(f: Frame) -> list[Piece]:
    """Constant and lag coefficients of an order-10 autoregression, by elimination in the matrix of centred
    running product sums. Undefined where the lags explain each other."""
    k, n = AR_ORDER, f"({f.n} - {AR_ORDER})"
    x = [lag_of_centred(f, i) for i in range(k + 1)]  # x[0] is to be explained
    whole = lambda sql: f"sum(case when {x[k]} is not null then {sql} end)"
    means = [f.derive(f"ar_mean{i}", f.agg(f"ar_sum{i}", whole(x[i]), k) + f" / {n}") for i in range(k + 1)]

    def cell(i: int, j: int) -> str:
        i, j = min(i, j), max(i, j)
        product = f.agg(f"ar_product{i}_{j}", whole(f"{x[i]} * {x[j]}"), k)
        return f.derive(f"ar_cell{i}_{j}", f"{product} - {n} * {means[i]} * {means[j]}")

    rows = ", ".join("array(" + ", ".join(cell(i, j) for j in [*range(1, k + 1), 0]) + ")" for i in range(1, k + 1))
    sizes = f.derive("ar_sizes", "array(" + ", ".join(cell(i, i) for i in range(1, k + 1)) + ")")
    matrix = f.derive("ar_matrix", f"case when {f.size} >= {2 * k + 1} then array({rows}) end")
    solved = f.derive("ar_solved", eliminated(matrix, sizes))
    betas = [f.derive(f"ar_beta{i}", f"get(get({solved}, {i - 1}), {k}) / get(get({solved}, {i - 1}), {i - 1})") for i in range(1, k + 1)]
    # Back from centred values: the constant takes in the first value.
    own = f._put(f.rows, "_origin", f"first_value({V}) over ({f.order})")
    explained = " + ".join(f"{b} * ({m} + {own})" for b, m in zip(betas, means[1:]))
    names = [label("ar_coefficient", coeff=i, k=k) for i in range(k + 1)]
    return [one(name, sql) for name, sql in zip(names, [f"{means[0]} + {own} - ({explained})", *betas])]


CHUNK_LENGTHS = (5, 10, 50)
CHUNK_AGGS = {"max": "max({0})", "min": "min({0})", "mean": "avg({0})", "var": "var_pop({0})"}
LINE = ("rvalue", "intercept", "slope", "stderr")


def _line_parts(m: str, y: str, yy: str, ty: str) -> dict[str, str]:
    """A line through ``m`` points 0, 1, 2, ... from the sums of y, y * y and t * y; NULL below two points."""
    sxx, syy, sxy = f"({m} * ({m} * {m} - 1) / 12)", f"greatest({yy} - {y} * {y} / {m}, 0D)", f"({ty} - {y} * ({m} - 1) / 2)"
    flat = f"{syy} <= 1e-12D * ({yy})"
    slope = f"(case when {flat} then 0D else {sxy} / {sxx} end)"
    return {
        "rvalue": f"case when {flat} then 0D else greatest(least({sxy} / sqrt({sxx} * {syy}), 1D), -1D) end",
        "intercept": f"{y} / {m} - {slope} * ({m} - 1) / 2",
        "slope": slope,
        "stderr": f"case when {m} > 2 then sqrt(greatest({syy} - {slope} * {sxy}, 0D) / {sxx} / ({m} - 2)) else 0D end",
    }


def _chunk_sums(f: Frame, size: int, how: str) -> tuple[str, str, str, str]:
    """(points, sums of y, y * y and t * y) of the aggregates of a frame's chunks, the last one maybe part of one.

    In an expanding frame chunks begin where the series does: those that are full have their aggregate at
    their last row, and running sums over such rows are completed by the chunk that the row is in."""
    name = f"{how}{size}"
    shown = "" if how == "var" else f" + {f._put(f.rows, '_origin', f'first_value({V}) over ({f.order})')}"
    if f.max_shift is None:
        place = f.mark(f"chunk{size}", f"floor({f.position} / {size}) * 1D")
        here = f._put(f.chunks, f"_k_{name}", f"{CHUNK_AGGS[how].format(centred(f))} over (partition by {', '.join(f.keys)}, {place} order by {TS} rows between unbounded preceding and current row)")
        full = f"{f.position} % {size} = {size - 1}"
        before = lambda tag, sql: f"({f.agg(f'chunk_{tag}_{name}', f'sum(case when {full} then {sql} else 0D end)')} - case when {full} then {sql} else 0D end)"
        parts = [f"({place} + 1)", *[f"({before(tag, sql)} + {sql})" for tag, sql in (("y", here), ("yy", f"{here} * {here}"), ("ty", f"{place} * {here}"))]]
    else:
        origin = f._put(f.rows, "_origin", f"first_value({V}) over ({f.order})")
        mean = total("c") + " / size(c)"
        one = {"max": "array_max(c)", "min": "array_min(c)", "mean": mean, "var": let(mean, "u", total("transform(c, x -> (x - u) * (x - u))") + " / size(c)")}[how]
        values = f.derive("from_origin", f"transform({f.values}, v -> v - {origin})")
        chunks = f"transform(sequence(0, ({f.length} - 1) div {size}), i -> slice({values}, i * {size} + 1, {size}))"
        y = f.derive(f"chunks_{name}", f"transform({chunks}, c -> {one})")
        parts = [f"cast(size({y}) as double)", total(y), total(f"transform({y}, x -> x * x)"), total(f"transform({y}, (x, i) -> x * i)")]
    m, *rest = [f.derive(f"line_{tag}_{name}", sql) for tag, sql in zip(("m", "y", "yy", "ty"), parts)]
    return m, *rest, shown


@_into(RECURSIVE)
def agg_linear_trend(f: Frame) -> list[Piece]:
    """A line through the aggregates of chunks, for frames longer than a chunk."""
    out = []
    for size in CHUNK_LENGTHS:
        for how in CHUNK_AGGS:
            m, y, yy, ty, shown = _chunk_sums(f, size, how)
            parts = _line_parts(m, y, yy, ty)
            parts["intercept"] += shown  # chunks are measured from the first value of the series
            for attr in LINE:
                name = label("agg_linear_trend", attr=attr, chunk_len=size, f_agg=how)
                out.append(one(name, f"case when {f.size} > {size} and {m} > 1 then {parts[attr]} end"))
    return out


def student_two_sided(t: str, dof: str) -> str:
    """Two-sided tail of Student's t: the incomplete beta function at dof / (dof + t * t), by its continued
    fraction on the side where that converges fast."""

    def fraction(a: str, b: str, x: str) -> str:
        """1 + d1 / (1 + d2 / (1 + ...)), two terms a step, from the inside out."""
        odd = f"-({a} + k) * ({a} + {b} + k) * {x} / (({a} + 2 * k) * ({a} + 2 * k + 1))"
        even = f"(k + 1) * ({b} - k - 1) * {x} / (({a} + 2 * k + 1) * ({a} + 2 * k + 2))"
        return f"aggregate(sequence(200, 0, -1), 1D, (z, k) -> 1D + ({odd}) / (1D + ({even}) / z))"

    def side(a: str, b: str, x: str, y: str) -> str:
        front = f"exp(lbeta + {a} * ln({x}) + {b} * ln({y})) / {a}"
        return f"{front} / {fraction(a, b, x)}"

    # ln(1 / B(dof / 2, 1 / 2)); gamma functions by their recurrence and Stirling's series.
    stirling = lambda z: f"(({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1 / (12 * {z}) - 1 / (360 * pow({z}, 3)) + 1 / (1260 * pow({z}, 5)) - 1 / (1680 * pow({z}, 7)))"
    lgamma = lambda z: let(f"{z} + 10", "g", f"{stirling('g')} - {total(f'transform(sequence(0, 9), i -> ln({z} + i))')}")
    whole = let(
        lgamma("(h + 0.5D)") + " - " + lgamma("h") + " - 0.5723649429247001D",
        "lbeta",
        f"case when x < (h + 1) / (h + 2.5D) then {side('h', '0.5D', 'x', 'y')} else 1 - {side('0.5D', 'h', 'y', 'x')} end",
    )
    shares = let(f"{t} * {t}", "tt", let(f"{dof} / ({dof} + tt)", "x", let(f"tt / ({dof} + tt)", "y", let(f"{dof} / 2D", "h", whole))))
    return f"case when {t} = 0 then 1D else greatest(least({shares}, 1D), 0D) end"


@_into(RECURSIVE)
def linear_trend_pvalue(f: Frame) -> list[Piece]:
    """Two-sided p-value of the slope of :func:`linear_trend`; two points lie on a line."""
    parts = {name: sql for (name,), sql in linear_trend(f)}
    slope, stderr = (parts[label("linear_trend", attr=k)].removeprefix("array(").removesuffix(")") for k in ("slope", "stderr"))
    s, e = f.derive("trend_slope", slope), f.derive("trend_stderr", stderr)
    tail = student_two_sided("t", f"({f.n} - 2)")
    value = f"case when {f.size} < 2 then null when {f.size} = 2 then {flag(f'{s} = 0')} when {e} > 0 then {let(f'{s} / {e}', 't', tail)} else {flag(f'{s} = 0')} end"
    return [one(label("linear_trend", attr="pvalue"), value)]


def _pattern(f: Frame, size: int) -> str:
    """A number for the order of the last ``size`` values, equal ones in the order of time: for each, how many
    later ones are smaller."""
    x = [f.lag(size - 1 - i) if i < size - 1 else V for i in range(size)]
    digits = [" + ".join(f"case when {b} < {a} then 1 else 0 end" for b in x[i + 1 :]) for i, a in enumerate(x[:-1])]
    code = " + ".join(f"({d}) * {size**i}" for i, d in enumerate(digits))
    return f.mark(f"pattern{size}", f"case when {x[0]} is not null then {code} end")


@_into(RECURSIVE)
def permutation_entropy(f: Frame) -> list[Piece]:
    """Entropy of the order patterns. In an expanding frame the sum of c ln c over the counts c grows by the
    difference that the pattern's next occurrence makes; a rolling frame counts its patterns."""
    out = []
    for k in PERMUTATION_DIMS:
        code, m = _pattern(f, k), f"({f.n} - {k - 1})"
        if f.max_shift is None:
            nth = f.occurrence_of_mark(f"nth_pattern{k}", code)
            grown = f"case when {nth} > 1 then {nth} * ln({nth}) - ({nth} - 1) * ln({nth} - 1) else 0D end"
            summed = f.agg(f"pattern_sum{k}", f"sum({grown})")
        else:
            if k - 1 > f.max_shift:
                out.append(one(label("permutation_entropy", dimension=k, tau=1), "cast(null as double)"))
                continue
            seen = f.agg(f"patterns{k}", f"collect_list({code})", k - 1)
            each = f"transform(array_distinct({seen}), c -> cast(size(filter({seen}, x -> x = c)) as double))"
            summed = f.derive(f"pattern_sum{k}", total(f"transform({each}, c -> c * ln(c))"))
        out.append(one(label("permutation_entropy", dimension=k, tau=1), f"case when {f.size} >= {k} then greatest(ln({m}) - {summed} / {m}, 0D) end"))
    return out


# --- Fourier coefficients of rolling frames ----------------------------------------------------------------------

FFT_COEFFS = range(100)
FFT_ATTRS = ("real", "imag", "abs", "angle")
MOMENTS = ("centroid", "variance", "skew", "kurtosis")


def _turn(share: str, whole: str) -> tuple[str, str]:
    """Cosine and sine of ``share`` parts of a turn of ``whole``; a half turn has a sine of exactly 0."""
    at = f"2 * pi() * ({share}) / {whole}"
    return f"cos({at})", f"case when 2 * ({share}) = {whole} then 0D else sin({at}) end"


def spectrum(f: Frame) -> str:
    """Array of the coefficients (re, im) up to half the frame's length.

    In a full rolling frame they slide: sums of x(t) times a wave that runs on over the series, the rows
    that left the frame taken off, turned back by the phase at the frame's first row. The frames at the
    series' begin, which are shorter, are summed up one by one."""
    size = f.max_shift + 1
    now = centred(f)
    parts = []
    for k in range(size // 2 + 1):
        cos, sin = _turn(f"pmod({f.position} * {k}, {size})", f"{size}D")
        a, b = f.sliding(f"cos{k}", f"{now} * {cos}"), f.sliding(f"sin{k}", f"{now} * {sin}")
        c, s = _turn(f"pmod(({f.position} + 1) * {k}, {size})", f"{size}D")  # a frame back, a row on
        shown = f" + {size} * {f._put(f.rows, '_origin', f'first_value({V}) over ({f.order})')}" if k == 0 else ""
        parts.append(f"named_struct('re', {a} * {c} + {b} * ({s}){shown}, 'im', {a} * ({s}) - {b} * {c})")
    cos, sin = _turn(f"pmod(k * i, {f.length})", f.length)
    waves = f"transform({f.values}, (v, i) -> named_struct('re', v * {cos}, 'im', -v * ({sin})))"
    added = "named_struct('re', z.re + w.re, 'im', z.im + w.im)"
    short = f"transform(sequence(0, {f.length} div 2), k -> aggregate({waves}, named_struct('re', 0D, 'im', 0D), (z, w) -> {added}))"
    return f.derive("spectrum", f"case when {f.size} = {size} then array({', '.join(parts)}) else {short} end")


@_into(SPECTRAL)
def fft_coefficient(f: Frame) -> list[Piece]:
    shown = {"real": "z.re", "imag": "z.im", "abs": "hypot(z.re, z.im)", "angle": "degrees(atan2(z.im, z.re))"}
    out = []
    for attr in FFT_ATTRS:
        names = [label("fft_coefficient", attr=attr, coeff=k) for k in FFT_COEFFS]
        whole = f"transform({spectrum(f)}, z -> {shown[attr]})"
        padded = let(whole, "w", f"transform(sequence(0, {len(FFT_COEFFS) - 1}), k -> get(w, k))")
        out.append(many(names, padded))
    return out


@_into(SPECTRAL)
def fft_aggregated(f: Frame) -> list[Piece]:
    """Moments of the absolute spectrum over the coefficient's number."""
    y = f.derive("magnitudes", f"transform({spectrum(f)}, z -> hypot(z.re, z.im))")
    mass = f.derive("magnitude", total(y))
    m1, m2, m3, m4 = (f.derive(f"spectral{k}", f"case when {mass} > 0 then {total(f'transform({y}, (x, i) -> x * pow(i, {k}))')} / {mass} end") for k in (1, 2, 3, 4))
    var = f.derive("spectral_var", f"{m2} - {m1} * {m1}")
    # The last term of the kurtosis is the first moment itself, as published.
    parts = {
        "centroid": m1,
        "variance": var,
        "skew": f"case when {var} >= 0.5 then ({m3} - 3 * {m1} * {var} - pow({m1}, 3)) / pow({var}, 1.5) end",
        "kurtosis": f"case when {var} >= 0.5 then ({m4} - 4 * {m1} * {m3} + 6 * {m2} * {m1} * {m1} - 3 * {m1}) / ({var} * {var}) end",
    }
    return [one(label("fft_aggregated", aggtype=m), parts[m]) for m in MOMENTS]


COLUMN_SETS = {"minimal": (MINIMAL,), "efficient": (MINIMAL, RUNNING, LAGGED, ORDER, ARRAY, RECURSIVE)}
