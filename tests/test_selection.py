import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import boosted, gram, search, selection, split
from tidepanel.plans import boosted as boosted_plan
from tidepanel.plans import engineer as plan
from tidepanel.plans.config import EngineerConfig, PrepareConfig, parameter_set

NAMES = ["a", "b", "c", "d", "e"]
PENALTIES = {"xgboost": 0.1, "lightgbm": 3.0}


@pytest.fixture(scope="module")
def data():
    out = {}
    for i, panel in enumerate(("p", "q")):
        rng = np.random.default_rng(5 + i)
        x = {n: rng.normal(size=60) * (j + 1) + j for j, n in enumerate(NAMES)}
        out[panel] = x | {"y": 2 * x["b"] - x["d"] + 0.3 * x["e"] + rng.normal(size=60)}
    return out


@pytest.fixture(scope="module")
def parted(data, make_panel):
    return split.chrono_split(make_panel({(p, n): v for p, x in data.items() for n, v in x.items()})).cache()


@pytest.fixture(scope="module")
def matrix(parted):
    return gram.design_matrix(gram.as_features(parted), NAMES, "y").cache()


@pytest.fixture(scope="module")
def sums(matrix):
    return gram.product_sums(matrix).cache()


def direct(x, columns):
    """Error of each model by ridge fits on the rows themselves."""
    z = np.column_stack([(x[c] - x[c][:48].mean()) / x[c][:48].std() for c in columns])
    total = 0.0
    for penalty in PENALTIES.values():
        a, y = z[:48], x["y"][:48]
        ac, yc = a - a.mean(0), y - y.mean()
        beta = np.linalg.solve(ac.T @ ac + penalty * np.eye(len(columns)), ac.T @ yc)
        guess = y.mean() + (z[48:] - a.mean(0)) @ beta
        total += float(((x["y"][48:] - guess) ** 2).mean())
    return total


def by_feature(df):
    return {(r["panel_id"], r["feature"]): r for r in df.collect()}


def test_scores_equal_row_fits(data, sums):
    base = selection.places_of(["a", "b"], NAMES)
    added = by_feature(selection.add_one_scores(sums, base, selection.places_of(NAMES, NAMES), NAMES, PENALTIES))
    assert {k[1] for k in added} == {"c", "d", "e"}
    for (p, f), r in added.items():
        assert r["agg_mse"] == pytest.approx(direct(data[p], ["a", "b", f]))
        assert r["improvement"] == pytest.approx(direct(data[p], ["a", "b"]) - direct(data[p], ["a", "b", f]))
        assert r["status"] == ("improved" if r["improvement"] > 0 else "worsened")
    dropped = by_feature(selection.drop_one_scores(sums, selection.places_of(NAMES, NAMES), NAMES, PENALTIES))
    for (p, f), r in dropped.items():
        assert r["agg_mse"] == pytest.approx(direct(data[p], [n for n in NAMES if n != f]))


def test_sums_do_not_depend_on_partitions(matrix, sums):
    want = {r["panel_id"]: r["train"] for r in sums.collect()}
    for parts in (1, 7):
        for r in gram.product_sums(matrix.repartition(parts)).collect():
            np.testing.assert_allclose(r["train"], want[r["panel_id"]], rtol=1e-9, atol=1e-9)


def greedy_by_hand(x, base, rounds):
    base = list(base)
    for _ in range(rounds):
        start = direct(x, base)
        ranked = sorted((direct(x, base + [f]), f) for f in NAMES if f not in base)
        base += [f for score, f in ranked[:3] if start - score > 0]
    return base


def test_greedy_equals_brute_force(data, sums):
    for rounds in (0, 1, 2):
        grown = selection.greedy_add(sums, ["a"], NAMES, PENALTIES, rounds=rounds)
        for r in grown.collect():
            want = greedy_by_hand(data[r["panel_id"]], ["a"], rounds)
            assert r["features"] == want and r["added"] == want[1:]
            assert len(set(r["features"])) == len(r["features"])
            assert r["agg_mse"] == pytest.approx(direct(data[r["panel_id"]], want))
    with pytest.raises(ValueError):
        selection.greedy_add(sums, ["a"], NAMES, PENALTIES, rounds=-1)


def test_top_three_then_filter(spark):
    rows = [("p", f"f{i:03d}", float(s), 5.0) for i, s in enumerate([4, 4, 9, 3, 6, 4] + [8] * 200)]
    scores = spark.createDataFrame(rows, "panel_id string, feature string, agg_mse double, baseline double")
    top = selection.top_improving(scores.withColumn("improvement", F.col("baseline") - F.col("agg_mse")))
    assert [r["feature"] for r in top.orderBy("rank").collect()] == ["f003", "f000", "f001"]
    worse = scores.withColumn("improvement", F.lit(3.5) - F.col("agg_mse"))
    assert [r["feature"] for r in selection.top_improving(worse).collect()] == ["f003"]


def test_drop_set_shrinks_with_the_threshold(sums):
    dropped = selection.drop_one_scores(sums, selection.places_of(NAMES, NAMES), NAMES, PENALTIES)
    gone = []
    for rel in (0.0, 0.001, 0.05, 1.0):
        labelled = selection.features_to_drop(dropped, rel).where("status = 'improved'")
        gone.append({(r["panel_id"], r["feature"]) for r in labelled.collect()})
    assert all(later <= earlier for earlier, later in itertools.pairwise(gone)) and not gone[-1]


def test_sweep_rows(data, sums):
    table = plan.sweep(sums, NAMES, NAMES, PENALTIES, steps=5)
    assert table.columns == ["panel_id", *plan.SWEEP_COLUMNS]
    rows = table.collect()
    assert len(rows) == 10
    for r in rows:
        x = data[r["panel_id"]]
        start = direct(x, NAMES)
        gains = {f: start - direct(x, [n for n in NAMES if n != f]) for f in NAMES}
        kept = [f for f in NAMES if gains[f] <= r["relative_threshold"] * start]
        assert r["threshold"] == pytest.approx(r["relative_threshold"] * start)
        assert r["aggregated_initial_mse"] == pytest.approx(start)
        assert r["aggregated_final_mse"] == pytest.approx(direct(x, kept))
        assert r["improvement_xgboost"] == pytest.approx(r["initial_mse_xgboost"] - r["final_mse_xgboost"])
    best = selection.best_threshold(table).collect()
    assert {r["panel_id"]: r["aggregated_final_mse"] for r in best} == {
        p: min(r["aggregated_final_mse"] for r in rows if r["panel_id"] == p) for p in data
    }


def test_trials_are_fixed_and_in_range(spark, sums):
    a, b = (search.param_trials(sums.repartition(k), trials=20).collect() for k in (1, 5))
    key = lambda r: (r["panel_id"], r["model"], r["trial"], tuple(sorted(r["params"].items())))
    assert sorted(map(key, a)) == sorted(map(key, b)) and len(a) == 80
    for r in a:
        for dim in search.space_of(r["model"]):
            v = r["params"][dim.name]
            assert dim.low * (1 - 1e-12) <= v <= dim.high * (1 + 1e-12)
            assert dim.kind != "int" or v == int(v)
    with pytest.raises(ValueError, match="unknown model"):
        search.space_of("forest")


def test_search_summary(sums):
    trials = search.ridge_search(sums, selection.places_of(NAMES, NAMES), trials=12)
    rows = trials.collect()
    for r in search.search_summary(trials).collect():
        mine = [t for t in rows if (t["panel_id"], t["model"]) == (r["panel_id"], r["model"])]
        assert len(mine) == 12
        best = min(mine, key=lambda t: (t["mse"], t["trial"]))
        assert (r["best_mse"], r["best_params"]) == (best["mse"], best["params"])
        assert r["mean_mse"] == pytest.approx(np.mean([t["mse"] for t in mine]))


def test_boosted_profiles(matrix):
    one, two = (boosted.regressor(m, p) for m, p in boosted.DEFAULT_PARAMS.items())
    assert (one.getMaxDepth(), one.getMaxIter(), one.getMinInstancesPerNode()) == (6, 223, 8)
    assert (two.getMaxDepth(), two.getMinInstancesPerNode()) == (9, 17)
    small = {"xgboost": boosted.DEFAULT_PARAMS["xgboost"] | {"n_estimators": 5, "max_depth": 2, "learning_rate": 0.3}}
    scores = boosted.score_sets(matrix, "p", {"good": [1, 3], "noise": [0]}, small).collect()
    got = {r["feature_set"]: r["mse"] for r in scores}
    assert got["good"] < got["noise"]


def test_noise_probe_is_uniform_and_fixed(spark, parted):
    rows = parted.select("panel_id", "ts").distinct()
    got = selection.noise_probe(rows, ["n0", "n1"]).collect()
    again = {(r["panel_id"], r["ts"]): r["n0"] for r in selection.noise_probe(rows.repartition(9), ["n0"]).collect()}
    assert all(again[r["panel_id"], r["ts"]] == r["n0"] and 0 <= r["n0"] < 1 for r in got)
    assert 0.35 < np.mean([r["n0"] for r in got]) < 0.65 and got[0]["n0"] != got[0]["n1"]


def test_config_checks():
    assert EngineerConfig(target="y").rounds == 2 and EngineerConfig(target="y", rounds="3").rounds == 3
    for bad in ({"rounds": "x"}, {"rounds": -1}, {"rounds": 1.5}, {"parameters": "Huge"}, {"target": ""}):
        with pytest.raises(ValueError):
            EngineerConfig(**({"target": "y"} | bad))
    assert parameter_set("EfficientFCParameters") == "efficient"
    for bad in ({"target": ""}, {"test_fraction": 1.2}, {"statistic": "z"}, {"choose_on": "test"}):
        with pytest.raises(ValueError):
            PrepareConfig(**({"target": "y"} | bad))


def test_boosted_selection(matrix):
    small = {"xgboost": boosted.DEFAULT_PARAMS["xgboost"] | {"n_estimators": 4, "max_depth": 2, "learning_rate": 0.3}}
    got = boosted_plan.select(matrix, "p", ["a"], NAMES, small, rounds=1)
    assert set(got.added) <= {"b", "c", "d", "e"} and got.added
    assert set(got.features) == ({"a"} | set(got.added)) - set(got.dropped)
    assert {r["model"] for r in got.summary.collect()} == {"xgboost", "all"}
    with pytest.raises(ValueError):
        boosted_plan.select(matrix, "p", ["a"], NAMES, small, rounds=-1)
