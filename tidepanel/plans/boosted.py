"""Greedy addition and the drop pass with boosted trees, for one panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidepanel.keys import PANEL
from tidepanel.operators import boosted, selection


@dataclass(frozen=True)
class Selected:
    features: list[str]
    added: list[str]
    dropped: list[str]
    drop_scores: DataFrame
    summary: DataFrame


def select(
    matrix: DataFrame,
    panel: str,
    base: Sequence[str],
    names: Sequence[str],
    params: Mapping[str, Mapping[str, float]] | None = None,
    *,
    rounds: int = 2,
    top: int = selection.TOP,
    drop_threshold: float = selection.DROP_THRESHOLD,
    parallelism: int = 4,
) -> Selected:
    """The selection of ``plans.engineer`` with every score a tree fit.

    ``matrix`` holds the columns ``names`` in order. What reaches the driver is
    one error per fit and the names of the winners.
    """
    if rounds < 0:
        raise ValueError("rounds must be at least 0")
    place = {n: i for i, n in enumerate(names)}

    def per_model(sets: Mapping[str, Sequence[str]]) -> DataFrame:
        numbered = {k: [place[n] for n in columns] for k, columns in sets.items()}
        scores = boosted.score_sets(matrix, panel, numbered, params, parallelism=parallelism)
        return scores.withColumnRenamed("feature_set", "feature")

    def evaluated(sets: Mapping[str, Sequence[str]], now: Sequence[str]) -> DataFrame:
        scores = selection.aggregate_mse(per_model(sets), (PANEL, "feature"))
        return selection.evaluate(scores, selection.aggregate_mse(per_model({"": now})))

    initial = per_model({"": base}).drop("feature")
    chosen, added = list(base), []
    for _ in range(rounds):
        unused = [n for n in names if n not in chosen]
        if not unused:
            break
        scores = evaluated({n: [*chosen, n] for n in unused}, chosen)
        won = [r["feature"] for r in selection.top_improving(scores, top).orderBy("rank").collect()]
        chosen += won
        added += won
    single = {n: [c for c in chosen if c != n] for n in chosen} if len(chosen) > 1 else {}
    if single:
        drops = selection.features_to_drop(evaluated(single, chosen), drop_threshold)
        gone = sorted(r["feature"] for r in drops.where("status = 'improved'").collect())
    else:
        drops, gone = selection.features_to_drop(evaluated({n: chosen for n in chosen}, chosen), drop_threshold), []
    kept = [n for n in chosen if n not in gone]
    # Every feature may be worth dropping alone; a fit needs at least one.
    final = per_model({"": kept}).drop("feature") if kept else initial
    return Selected(kept, added, gone, drops, selection.improvement_summary(initial, final))
