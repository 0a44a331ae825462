"""Feature extraction, selection and the threshold sweep on a prepared panel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.keys import PANEL, SERIES, SPLIT, TS, VALUE
from tidepanel.operators import features, forward, gram, search, selection, split
from tidepanel.operators.boosted import DEFAULT_PARAMS
from tidepanel.plans.config import EngineerConfig
from tidepanel.session import cut_lineage


UNSCORED = "no date has the target and all predictors in both splits"


def default_penalties() -> dict[str, float]:
    return {m: p["reg_lambda"] for m, p in DEFAULT_PARAMS.items()}


@dataclass(frozen=True)
class Prepared:
    """Long features of all panels; per panel the base (features) and its candidates."""

    target: str
    base: DataFrame
    candidates: DataFrame
    features: DataFrame
    scaled: DataFrame


@dataclass(frozen=True)
class Engineered:
    """``search`` and ``search_after``: trials summed up on the base and on the final
    selection. ``summary`` has every panel of the input; one that cannot be scored
    has a reason in place of errors."""

    search: DataFrame
    search_after: DataFrame
    penalties: DataFrame
    selected: DataFrame
    drop_scores: DataFrame
    summary: DataFrame
    prepared: Prepared


def prepare_features(panel: DataFrame, cfg: EngineerConfig) -> Prepared:
    """Extract features once and standardise them with the base series."""
    rows = cut_lineage(panel.select(PANEL, SPLIT, SERIES, TS, VALUE))
    parts = gram.as_features(rows)
    known = F.col(VALUE).isNotNull() & (F.col("feature") != cfg.target)
    base = parts.groupBy(PANEL).agg(F.sort_array(F.collect_set(F.when(known, F.col("feature")))).alias("features"))
    base = cut_lineage(base)
    candidates = base.select(PANEL, F.lit(None).cast("string").alias("feature")).limit(0)
    if cfg.rounds > 0:
        extracted = cut_lineage(
            features.extract(
                rows,
                cfg.parameters,
                max_shift=cfg.max_shift,
                target=cfg.target,
                include_target=cfg.include_target,
            )
        )
        # A candidate needs a value on the dates that the base keeps, and on no others.
        dates = forward.base_matrix(forward.scaled_features(parts), base, cfg.target).select(*gram.ROW)
        full = split.complete_features(extracted.join(cut_lineage(dates), list(gram.ROW), "left_semi"), (PANEL, SPLIT))
        both = split.candidate_features(full.where(F.col(SPLIT) == "train"), full.where(F.col(SPLIT) == "test"))
        candidates = cut_lineage(both)
        parts = parts.unionByName(extracted.select(parts.columns))
    return Prepared(cfg.target, base, candidates, parts, cut_lineage(forward.scaled_features(parts)))


def _sums(prep: Prepared, base: DataFrame) -> DataFrame:
    """Product sums over a panel's own features, with its row of ``base``."""
    matrix = forward.base_matrix(prep.scaled, base, prep.target)
    return cut_lineage(gram.product_sums(matrix).join(base, PANEL))


def _places(names: str = "features") -> Column:
    return F.transform(names, lambda f, i: i)


def found_penalties(found: DataFrame) -> DataFrame:
    """(panel, penalties): the penalty of each model's best trial."""
    entry = F.struct("model", F.col("best_params")["reg_lambda"].alias("v"))
    return found.groupBy(PANEL).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("penalties"))


def engineer(
    panel: DataFrame,
    cfg: EngineerConfig,
    *,
    penalties: dict[str, float] | DataFrame | None = None,
    trials: int = search.TRIALS,
) -> Engineered:
    """Search, greedy addition, one drop pass and the final scores, per panel.

    The scores use the penalties that the search finds for the panel, unless
    ``penalties`` gives them for all panels, or by panel as ``found_penalties`` does.
    The rows are read for the extraction, and once a round.
    """
    prep = prepare_features(panel, cfg)
    sums = _sums(prep, prep.base)
    found = cut_lineage(search.search_summary(search.ridge_search(sums, _places(), trials=trials)))
    if isinstance(penalties, DataFrame):
        own = penalties
    elif penalties:
        own = prep.base.select(PANEL, F.create_map(*[F.lit(x) for m, v in penalties.items() for x in (m, float(v))]).alias("penalties"))
    else:
        own = found_penalties(found)
    own = cut_lineage(own)
    grown = forward.grow(prep.scaled, prep.base, cfg.target, own, rounds=cfg.rounds, candidates=prep.candidates)
    final_sums = _sums(prep, grown).join(own, PANEL)
    dropped = cut_lineage(
        selection.features_to_drop(
            selection.drop_one_scores(final_sums, _places(), F.col("features"), F.col("penalties")), cfg.drop_threshold
        )
    )
    gone = dropped.where(F.col("status") == "improved").groupBy(PANEL).agg(F.collect_list("feature").alias("dropped"))
    none = F.array().cast("array<string>")
    selected = grown.join(gone, PANEL, "left").withColumn("dropped", F.array_sort(F.coalesce("dropped", none)))
    selected = cut_lineage(selected.withColumn("features", F.array_except("features", "dropped")).select(PANEL, "features", "added", "dropped"))
    kept = final_sums.join(selected.select(PANEL, F.col("features").alias("_kept")), PANEL)
    places = F.transform("_kept", lambda f: F.array_position(F.col("features"), f).cast("int") - 1)
    kept = cut_lineage(kept.withColumn("_places", places))
    after = cut_lineage(search.search_summary(search.ridge_search(kept, F.col("_places"), trials=trials)))
    initial = _per_model(selection.baseline_scores(sums.join(own, PANEL), _places(), F.col("penalties")))
    final = _per_model(selection.baseline_scores(kept, F.col("_places"), F.col("penalties")))
    summary = selection.improvement_summary(initial, final)
    means = found.select(PANEL, "model", F.col("mean_mse").alias("initial_mean_mse")).join(
        after.select(PANEL, "model", F.col("mean_mse").alias("final_mean_mse")), [PANEL, "model"], "left"
    )
    # Read twice below: rows, and which panels have none.
    summary = cut_lineage(summary.join(means, [PANEL, "model"], "left").withColumn("reason", F.lit(None).cast("string")))
    missing = prep.base.select(PANEL).join(summary.select(PANEL).distinct(), PANEL, "left_anti")
    nothing = {c: F.lit(None).cast("double") for c in summary.columns if c.endswith("mse") or c == "improvement"}
    missing = missing.withColumns({"model": F.lit("all"), **nothing, "reason": F.lit(UNSCORED)})
    return Engineered(
        search=found,
        search_after=after,
        penalties=own,
        selected=selected,
        drop_scores=dropped,
        summary=summary.unionByName(missing.select(summary.columns)),
        prepared=prep,
    )


def _per_model(scores: DataFrame) -> DataFrame:
    return scores.select(PANEL, F.explode("mse").alias("model", "mse"))


def write_penalties(result: Engineered, path: str) -> None:
    """Keep what the search found, one row per panel, for later scoring."""
    result.penalties.select(PANEL, F.explode("penalties").alias("model", "value")).write.mode("overwrite").json(path)


def read_penalties(spark: SparkSession, path: str) -> DataFrame:
    """(panel, penalties) as ``engineer`` takes them, in place of those of its own search."""
    rows = spark.read.schema(f"{PANEL} string, model string, value double").json(path)
    return rows.groupBy(PANEL).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "value")))).alias("penalties"))


def with_noise(parts: DataFrame, probes: int, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """Long features and as many random ones, drawn from panel and date, with their names. A sweep over both shows
    from which threshold on features that know nothing are dropped."""
    names = [f"noise_{i}" for i in range(probes)]
    dates = parts.select(PANEL, SPLIT, TS).distinct()
    drawn = selection.noise_probe(dates, names, seed=seed, keys=(PANEL, TS)).unpivot([PANEL, SPLIT, TS], names, "feature", VALUE)
    return parts.select(PANEL, SPLIT, TS, "feature", VALUE).unionByName(drawn), names


def engineered_matrix(result: Engineered) -> DataFrame:
    """Long features of the final selection of each panel, with the split."""
    chosen = result.selected.select(PANEL, F.explode("features").alias("feature"))
    return result.prepared.features.join(chosen, [PANEL, "feature"], "left_semi")


def engineered_target(result: Engineered) -> DataFrame:
    """(panel, split, ts, y): the target that belongs to ``engineered_matrix``."""
    rows = result.prepared.features.where(F.col("feature") == result.prepared.target)
    return rows.select(PANEL, SPLIT, TS, F.col(VALUE).alias("y"))


# The columns of the sweep table, in order.
SWEEP_COLUMNS = (
    "relative_threshold",
    "threshold",
    "initial_mse_xgboost",
    "final_mse_xgboost",
    "improvement_xgboost",
    "initial_mse_lightgbm",
    "final_mse_lightgbm",
    "improvement_lightgbm",
    "aggregated_initial_mse",
    "aggregated_final_mse",
)


def sweep(
    sums: DataFrame, base: Sequence[str], names: Sequence[str], penalties: dict[str, float] | None = None, **grid
) -> DataFrame:
    """One row per panel and relative threshold: scores before and after the drop
    pass at that threshold. Each distinct kept set is scored once."""
    penalties = penalties or default_penalties()
    places = selection.places_of(base, names)
    initial = selection.baseline_scores(sums, places, penalties)
    dropped = selection.drop_one_scores(sums, places, names, penalties)
    kept = selection.sweep_kept(dropped, **grid).withColumn(
        "features", F.transform("kept", lambda k: k["feature"])
    )
    sets = kept.groupBy(PANEL).agg(F.array_sort(F.collect_set("features")).alias("_sets"))
    listed = F.array(*[F.lit(n) for n in names])
    numbered = F.transform("_sets", lambda s: F.transform(s, lambda f: F.array_position(listed, f).cast("int") - 1))
    scored = gram.score_sets(sums.join(sets, PANEL), numbered, penalties)
    finals = scored.select(PANEL, F.explode(F.arrays_zip("_sets", "mse")).alias("_z")).select(
        PANEL, F.col("_z._sets").alias("features"), F.col("_z.mse").alias("_final")
    )
    rows = kept.join(finals, [PANEL, "features"]).join(initial.select(PANEL, F.col("mse").alias("_first")), PANEL)
    columns = {"relative_threshold": F.col("relative_threshold"), "threshold": F.col("threshold")}
    for model in penalties:
        first, last = F.col("_first")[model], F.col("_final")[model]
        columns |= {f"initial_mse_{model}": first, f"final_mse_{model}": last, f"improvement_{model}": first - last}
    columns["aggregated_initial_mse"] = selection.summed(F.col("_first"))
    columns["aggregated_final_mse"] = selection.summed(F.col("_final"))
    return rows.select(PANEL, *[c.alias(n) for n, c in columns.items()])
