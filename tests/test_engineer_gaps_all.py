"""The whole plan on months with gaps in any series, against ridge fits one by one."""

import numpy as np
import pytest

from tidepanel.operators import forward, search, split
from tidepanel.plans import engineer as plan
from tidepanel.plans.config import EngineerConfig
from tidepanel.queries import registry
from tidepanel.sources import warehouse

SF_DIR = "/root/testdata/sf0.001"
TARGET = "BUILDING"


def best_errors(rows, penalties):
    """Least and mean hold-out error over the penalties on the panel's own series, or None without dates."""
    names = sorted(set(rows[rows.value.notna()].series_id) - {TARGET})
    wide = rows.pivot(index=["split", "ts"], columns="series_id", values="value").reindex(columns=[TARGET, *names])
    train = wide.loc["train"]
    z = (wide[names] - train[names].mean()) / train[names].std(ddof=0)
    whole = z.assign(y=wide[TARGET]).dropna()
    if {*whole.index.get_level_values(0)} != {"train", "test"}:
        return None
    x, y, xt, yt = (whole.loc[s][c].to_numpy() for s in ("train", "test") for c in (names, "y"))
    mean, centre = y.mean(), x.mean(0)
    errors = []
    for penalty in penalties:
        beta = np.linalg.solve((x - centre).T @ (x - centre) + penalty * np.eye(len(names)), (x - centre).T @ (y - mean))
        errors.append(float(((yt - mean - (xt - centre) @ beta) ** 2).mean()))
    return min(errors), float(np.mean(errors))


def test_every_series_takes_part(spark):
    panel = split.chrono_split(warehouse.scaled_nations(spark, SF_DIR)).cache()
    rows = panel.toPandas()
    assert {"HOUSEHOLD", "MACHINERY"} <= set(rows.series_id)
    trials = search.param_trials(panel).select("panel_id", "model", "params").collect()
    got = {(r["panel_id"], r["model"]): r for r in registry.queries()["engineer_gaps_all"](spark, SF_DIR).collect()}
    none = plan.engineer(panel, EngineerConfig(target=TARGET, rounds=0)).summary.collect()
    assert {p for p, _ in got} == set(rows.panel_id)
    for name, part in rows.groupby("panel_id"):
        for model in search.MODELS:
            want = best_errors(part, [t["params"]["reg_lambda"] for t in trials if (t["panel_id"], t["model"]) == (name, model)])
            if want is None:
                assert got[name, "all"]["reason"] == plan.UNSCORED
                continue
            assert got[name, model]["initial_mse"] == pytest.approx(want[0], rel=1e-5, abs=2e-6)
            assert got[name, model]["initial_mean_mse"] == pytest.approx(want[1], rel=1e-5, abs=2e-6)
    # The base is the same for any number of rounds.
    for r in none:
        if r["reason"] is None:
            assert got[r["panel_id"], r["model"]]["initial_mse"] == pytest.approx(r["initial_mse"], rel=1e-5, abs=2e-6)


def test_trials_are_not_a_filter(spark):
    """The draws of the trials stay out of row filters, whatever is joined to them."""
    panel = split.chrono_split(warehouse.scaled_nations(spark, SF_DIR))
    joined = panel.join(search.param_trials(panel), "panel_id")
    plan_text = joined._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan_text.splitlines() if "Filter" in line and "md5" in line]


def test_candidate_with_a_gap_on_a_dropped_date(spark):
    """A candidate that lacks only dates which the base drops as well is scored."""
    import datetime as dt

    days = [dt.date(2001, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    rng = np.random.default_rng(2)
    x = rng.normal(size=40)
    rows = []
    for i, ts in enumerate(days):
        part = "train" if i < 32 else "test"
        rows.append(("p", part, "y", ts, float(np.cumsum(x)[i])))
        rows.append(("p", part, "x", ts, None if i in (5, 35) else float(x[i])))
    panel = spark.createDataFrame(rows, "panel_id string, split string, series_id string, ts date, value double")
    prepared = plan.prepare_features(panel, EngineerConfig(target="y"))
    names = {r["feature"] for r in prepared.candidates.collect()}
    assert {"x__sum_values", "x__median"} <= names
    penalties = spark.createDataFrame([("p", {"m": 1.0})], "panel_id string, penalties map<string, double>")
    scored = forward.add_one(prepared.scaled, prepared.base, "y", penalties, candidates=prepared.candidates, slice_size=3)
    assert {r["feature"] for r in scored.collect()} == names
