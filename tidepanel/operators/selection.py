"""Errors, candidate evaluation, greedy addition, dropping and threshold sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalar import unit_hash
from tidepanel.keys import PANEL
from tidepanel.operators.gram import score_sets
from tidepanel.operators.joins import attach
from tidepanel.session import cut_lineage

TOP = 3
DROP_THRESHOLD = 0.002
# The relative thresholds of the sweep.
SWEEP_LOW, SWEEP_HIGH, SWEEP_STEPS = 0.0001, 0.01, 100


# --- errors ---------------------------------------------------------------------------


def mse(predictions: DataFrame, keys: Sequence[str] = (PANEL, "model")) -> DataFrame:
    """Mean squared error of (y, prediction) per key."""
    gap = F.col("y") - F.col("prediction")
    return predictions.groupBy(*keys).agg(F.avg(gap * gap).alias("mse"))


def aggregate_mse(scores: DataFrame, keys: Sequence[str] = (PANEL,)) -> DataFrame:
    """Sum over the models of each model's mean error."""
    means = scores.groupBy(*keys, "model").agg(F.avg("mse").alias("mse"))
    return means.groupBy(*keys).agg(F.sum("mse").alias("agg_mse"))


def summed(scores: Column) -> Column:
    """Sum of the errors of a map model -> error."""
    return F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, v: a + v)


# --- candidates ------------------------------------------------------------------------


def evaluate(scores: DataFrame, baseline: DataFrame) -> DataFrame:
    """A score table against the baseline of its panel: improvement and status."""
    base = baseline.select(PANEL, F.col("agg_mse").alias("baseline"))
    return with_gain(attach(scores, base, [PANEL], salt_by=["feature"]))


def top_improving(evaluated: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` smallest errors per panel, then those of them that improve.

    A first round ranks within slices of a panel, so only ``top`` rows per slice
    meet in the panel's own window.
    """
    order = [F.col("agg_mse").asc_nulls_last(), F.col("feature").asc()]
    sliced = evaluated.withColumn("_slice", F.pmod(F.xxhash64("feature"), F.lit(64)))
    local = Window.partitionBy(PANEL, "_slice").orderBy(*order)
    whole = Window.partitionBy(PANEL).orderBy(*order)
    return (
        sliced.withColumn("_r", F.row_number().over(local))
        .where(F.col("_r") <= top)
        .withColumn("rank", F.row_number().over(whole))
        .where((F.col("rank") <= top) & (F.col("improvement") > 0))
        .drop("_r", "_slice")
    )


def features_to_drop(dropped: DataFrame, relative_threshold: float = DROP_THRESHOLD) -> DataFrame:
    """Label evaluated single-drop scores: 'improved' means the feature goes, as
    its removal gains more than the share ``relative_threshold`` of the baseline."""
    return dropped.withColumn("threshold", F.lit(float(relative_threshold)) * F.col("baseline")).withColumn(
        "status", F.when(F.col("improvement") > F.col("threshold"), "improved").otherwise("worsened")
    )


def improvement_summary(initial: DataFrame, final: DataFrame) -> DataFrame:
    """Per panel and model, and for 'all' models together: before, after, gain."""
    first = initial.select(PANEL, "model", F.col("mse").alias("initial_mse"))
    last = final.select(PANEL, "model", F.col("mse").alias("final_mse"))
    both = first.join(last, [PANEL, "model"])
    overall = both.groupBy(PANEL).agg(
        F.lit("all").alias("model"), F.sum("initial_mse").alias("initial_mse"), F.sum("final_mse").alias("final_mse")
    )
    return both.unionByName(overall.select(both.columns)).withColumn(
        "improvement", F.col("initial_mse") - F.col("final_mse")
    )


# --- from product sums ----------------------------------------------------------------------


def listed(names: Sequence[str] | Column) -> Column:
    """Names as an array column; they may differ by panel."""
    return names if isinstance(names, Column) else F.array(*[F.lit(n) for n in names])


def _scored_against_base(sums: DataFrame, base: Column, sets: Column, names: Sequence[str] | Column, penalties) -> DataFrame:
    """One row per feature in ``_c`` with its set's error and its gain over the
    base; the base is scored in the same call, so nothing is joined."""
    scored = score_sets(sums, F.concat(F.array(base), sets), penalties)
    zipped = F.arrays_zip(F.col("_c").alias("place"), F.slice("mse", F.lit(2), F.size("_c")).alias("mse"))
    named = scored.select(
        PANEL, summed(F.get("mse", F.lit(0))).alias("baseline"), listed(names).alias("_names"), F.explode(zipped).alias("_z")
    )
    rows = named.select(
        PANEL,
        F.get("_names", F.col("_z.place")).alias("feature"),
        summed(F.col("_z.mse")).alias("agg_mse"),
        F.col("_z.mse").alias("mse"),
        "baseline",
    )
    return with_gain(rows)


def with_gain(rows: DataFrame) -> DataFrame:
    return rows.withColumn("improvement", F.col("baseline") - F.col("agg_mse")).withColumn(
        "status", F.when(F.col("improvement") > 0, "improved").otherwise("worsened")
    )


def places_of(features: Sequence[str], names: Sequence[str]) -> Column:
    where = {n: i for i, n in enumerate(names)}
    return F.array(*[F.lit(where[f]) for f in features]).cast("array<int>")


def baseline_scores(sums: DataFrame, base: Column, penalties: dict[str, float] | Column) -> DataFrame:
    scored = score_sets(sums, F.array(base), penalties)
    first = F.get("mse", F.lit(0))
    return scored.select(PANEL, summed(first).alias("agg_mse"), first.alias("mse"))


def add_one_scores(
    sums: DataFrame, base: Column, candidates: Column, names: Sequence[str], penalties: dict[str, float]
) -> DataFrame:
    """Base plus each candidate: error, baseline, improvement and status, all from
    one pass of the rows."""
    chosen = sums.withColumn("_c", F.array_except(candidates, base))
    sets = F.transform("_c", lambda c: F.concat(base, F.array(c)))
    return _scored_against_base(chosen, base, sets, names, penalties)


def drop_one_scores(
    sums: DataFrame, base: Column, names: Sequence[str] | Column, penalties: dict[str, float] | Column
) -> DataFrame:
    """Base without each of its features: error, baseline, improvement, status."""
    chosen = sums.withColumn("_c", base)
    sets = F.transform("_c", lambda c: F.array_remove(F.col("_c"), c))
    return _scored_against_base(chosen, base, sets, names, penalties)


def greedy_add(
    sums: DataFrame,
    base: Sequence[str],
    names: Sequence[str],
    penalties: dict[str, float],
    *,
    rounds: int = 2,
    top: int = TOP,
    usable: DataFrame | None = None,
) -> DataFrame:
    """Forward addition per panel: (panel_id, base, added, agg_mse).

    A round scores every unused candidate, adds up to ``top`` improving ones and
    re-scores the base. A round without a winner leaves the panel as it is. The
    state is one row per panel; its lineage is cut every round.
    """
    if rounds < 0:
        raise ValueError("rounds must be at least 0")
    every = F.array(*[F.lit(i) for i in range(len(names))]).cast("array<int>")
    state = sums if usable is None else sums.join(usable, PANEL)
    state = state.withColumns({"_base": places_of(base, names), "_first": F.size(places_of(base, names))})
    if usable is None:
        state = state.withColumn("usable", every)
    state = cut_lineage(state)
    for _ in range(rounds):
        evaluated = add_one_scores(state, F.col("_base"), F.col("usable"), names, penalties)
        place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("feature")).cast("int") - 1
        won = top_improving(evaluated, top).groupBy(PANEL).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", place.alias("place")))), lambda w: w["place"]).alias("_won")
        )
        nothing = F.array().cast("array<int>")
        state = cut_lineage(
            state.join(won, PANEL, "left")
            .withColumn("_base", F.concat("_base", F.coalesce("_won", nothing)))
            .drop("_won")
        )
    every_name = listed(names)
    named = lambda places: F.transform(places, lambda i: F.get(every_name, i))
    scores = baseline_scores(state, F.col("_base"), penalties)
    chosen = state.select(
        PANEL,
        named(F.col("_base")).alias("features"),
        named(F.slice("_base", F.col("_first") + 1, F.lit(len(names)))).alias("added"),
    )
    return chosen.join(scores.select(PANEL, "agg_mse", "mse"), PANEL)


# --- thresholds -----------------------------------------------------------------------------------


def threshold_list(
    baseline: Column, low: float = SWEEP_LOW, high: float = SWEEP_HIGH, steps: int = SWEEP_STEPS
) -> Column:
    """Evenly spaced relative thresholds with their absolute values."""
    at = lambda i: F.lit(low) + i * F.lit((high - low) / (steps - 1))
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)),
        lambda i: F.struct(at(i).alias("relative_threshold"), (at(i) * baseline).alias("threshold")),
    )


def sweep_kept(dropped: DataFrame, **grid) -> DataFrame:
    """Per panel and threshold the features kept by the drop pass, in name order.

    A feature is kept while its improvement does not exceed the threshold. Each
    evaluated drop score carries its panel's baseline, so its thresholds are made
    in place.
    """
    cell = dropped.select(
        PANEL, "feature", "agg_mse", "improvement", F.explode(threshold_list(F.col("baseline"), **grid)).alias("_t")
    )
    kept = F.when(F.col("improvement") <= F.col("_t.threshold"), F.struct("feature", "agg_mse"))
    return cell.groupBy(PANEL, F.col("_t.relative_threshold").alias("relative_threshold"), F.col("_t.threshold").alias("threshold")).agg(
        F.sort_array(F.collect_list(kept)).alias("kept"), F.count_if(F.col("improvement") > F.col("_t.threshold")).alias("n_dropped")
    )


def best_threshold(sweep: DataFrame, score: str = "aggregated_final_mse") -> DataFrame:
    """The row of the smallest score per panel, the first on ties."""
    row = F.struct(*sweep.columns)
    order = F.when(F.col(score).isNotNull(), F.struct(score, "relative_threshold"))
    return sweep.groupBy(PANEL).agg(F.min_by(row, order).alias("_r")).select("_r.*")


def n_smallest(table: DataFrame, n: int, score: str, tie: str) -> DataFrame:
    return table.orderBy(F.col(score).asc_nulls_last(), tie).limit(n)


# --- probes ---------------------------------------------------------------------------------------


def noise_probe(rows: DataFrame, names: Sequence[str], seed: int = 42, keys: Sequence[str] = (PANEL, "ts")) -> DataFrame:
    """Uniform [0, 1) features drawn from the row key."""
    return rows.withColumns({n: unit_hash(str(seed), repr(n), *keys) for n in names})
