import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import adf, spline
from tidepanel.operators import align, forward, gram, selection, split, transform
from tidepanel.plans import engineer as plan
from tidepanel.plans import prepare
from tidepanel.plans.config import EngineerConfig, PrepareConfig
from tidepanel.sources.catalog import make_catalog

METHODS = ("None", "Simple Differencing", "Rolling Mean Subtraction", "Rolling Mean Subtraction + Differencing")


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(2)
    n = 90
    steps = lambda s: np.exp(rng.normal(0.004, s, n).cumsum())
    frame = pd.DataFrame(
        {
            "nominal": 500 * steps(0.02),
            "index": 100 * steps(0.004),
            "rate": 5 + rng.normal(0, 0.2, n).cumsum(),
            "goal": 900 * steps(0.03),
        },
        index=pd.date_range("2000-01-01", periods=n, freq="MS"),
    )
    # Quarterly values leave two months in three open, the last ones too.
    frame.loc[frame.index.month % 3 != 1, "goal"] = np.nan
    return frame


@pytest.fixture(scope="module")
def panel(wide, make_panel):
    return make_panel({c: [None if np.isnan(v) else v for v in wide[c]] for c in wide}).cache()


ROLES = {"spline": ["goal"], "nominal": ["goal", "nominal"], "logged": ["goal", "nominal"]}


def variants(s):
    rest = s - s.rolling(7).mean()
    return [s, s.diff(), rest, rest.diff()]


def by_hand(wide):
    """The preparation, frame by frame, in pandas."""
    cut = len(wide) - math.ceil(0.2 * len(wide))
    parts = {"train": wide.iloc[:cut].copy(), "test": wide.iloc[cut:].copy()}
    for df in parts.values():
        days = np.array([d.toordinal() for d in df.index], dtype=float)
        df["goal"] = spline.fill_gaps(days, df["goal"].to_numpy())
        for c in ("goal", "nominal"):
            df[c] = 100 * np.log(df[c] / df["index"] * 100)
    mean, sd = parts["train"].mean(), parts["train"].std(ddof=0)
    out, methods = {}, {}
    for name, df in parts.items():
        z = (df - mean) / sd
        change = (z / z.shift() - 1).iloc[1:]
        for c in change:
            options = variants(change[c])
            stats = [adf.adf(v.dropna().to_numpy())[0] for v in options]
            methods[name, c] = METHODS[int(np.argmin(stats))]
            v = options[int(np.argmin(stats))].bfill()
            if name == "train":
                q1, q3 = v.quantile(0.25), v.quantile(0.75)
                v = v.clip(q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1))
            out[name, c] = v
    return out, methods


@pytest.mark.parametrize("block_days", [None, 1500])
def test_preprocess_equals_pandas(wide, panel, block_days):
    want, methods = by_hand(wide)
    cfg = PrepareConfig(target="goal", deflator="index", block_days=block_days)
    got = prepare.preprocess(panel, cfg, **ROLES).toPandas()
    assert len(got) == sum(len(v) for v in want.values())
    for (name, series), values in want.items():
        part = got[(got.split == name) & (got.series_id == series)].sort_values("ts")
        assert set(part.method) == {methods[name, series]}
        np.testing.assert_allclose(part.value, values, rtol=1e-6, atol=1e-8)


def test_catalog_gives_roles_choices_and_skipped_series(wide, panel, spark):
    want, methods = by_hand(wide)
    catalog = make_catalog(spark, [*wide.columns, "absent"], nominal=["goal", "nominal", "absent"], log=["goal", "nominal"], spline=["goal"])
    done = prepare.prepare(panel, catalog, PrepareConfig(target="goal", deflator="index"))
    assert [r["series_id"] for r in done.skipped.collect()] == ["absent"]
    named = prepare.preprocess(panel, PrepareConfig(target="goal", deflator="index"), **ROLES)
    assert done.rows.columns == named.columns and done.rows.exceptAll(named).count() == 0 == named.exceptAll(done.rows).count()
    chosen = {(r["split"], r["series_id"]): r for r in done.choices.collect()}
    assert {k: r["method"] for k, r in chosen.items()} == methods
    assert all(r["adf_stat"] is not None for r in chosen.values())


def test_long_tables_of_names(spark, make_panel):
    panel = make_panel({"a": [1.0, 2.0], "b": [4.0, None]})
    table = spark.range(5000).selectExpr("concat('n', id) as series_id").unionByName(spark.createDataFrame([("a",), ("a",)], "series_id string"))
    got = {(r["series_id"], r["value"] and round(r["value"], 9)) for r in transform.log_transform(panel, table).collect()}
    assert got == {("a", 0.0), ("a", round(100 * math.log(2), 9)), ("b", 4.0), ("b", None)}
    assert transform.log_transform(panel, table.limit(0)).exceptAll(panel).count() == 0


def test_saved_penalties_score_the_same(spark, make_panel, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3, 60))
    panel = split.chrono_split(make_panel({"y": x[0] + x[1], "a": x[0], "b": x[2]}))
    cfg = EngineerConfig(target="y", rounds=0)
    first = plan.engineer(panel, cfg, trials=5)
    plan.write_penalties(first, str(tmp_path / "penalties"))
    again = plan.engineer(panel, cfg, penalties=plan.read_penalties(spark, str(tmp_path / "penalties")), trials=1)
    errors = lambda r: sorted((x["model"], x["initial_mse"], x["final_mse"]) for x in r.summary.collect())
    assert errors(first) == errors(again)


def test_noise_is_dropped_by_the_sweep(make_panel):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2, 120))
    parts = gram.as_features(split.chrono_split(make_panel({"y": 2 * x[0] - x[1], "a": x[0], "b": x[1]})))
    both, probes = plan.with_noise(parts, 2)
    assert both.where("feature like 'noise%' and (value < 0 or value >= 1)").count() == 0
    names = ["a", "b", *probes]
    sums = gram.product_sums(gram.design_matrix(both, names, "y"))
    rows = plan.sweep(sums, names, names).orderBy("relative_threshold").collect()
    assert rows[-1]["aggregated_final_mse"] <= rows[0]["aggregated_initial_mse"] * 1.5 and len(probes) == 2


def test_train_choice_used_for_both(panel):
    cfg = PrepareConfig(target="goal", deflator="index", choose_on="train")
    got = prepare.preprocess(panel, cfg, **ROLES)
    assert got.groupBy("series_id").agg(F.countDistinct("method").alias("n")).where("n > 1").count() == 0


def test_absent_series_are_skipped_and_absent_deflator_fails(panel):
    roles = {k: [*v, "absent"] for k, v in ROLES.items()}
    assert prepare.preprocess(panel, PrepareConfig(target="goal", deflator="index"), **roles).count() > 0
    with pytest.raises(ValueError, match="deflator"):
        prepare.preprocess(panel, PrepareConfig(target="goal", deflator="gone"), **ROLES)


def test_load_aligns_mixed_frequencies(spark, make_panel):
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(100)]
    raw = make_panel({"d": range(100)}, days).union(make_panel({"m": [1, 2, 3, 4]})).union(make_panel({"extra": [1]}))
    catalog = make_catalog(spark, ["d", "m", "none"], daily=["d"])
    grid = prepare.load(raw, catalog, "m", start="2000-01-01", end="2000-03-31")
    assert {(r["series_id"], r["ts"].month): r["value"] for r in grid.collect()} == {
        ("d", 1): 0.0,
        ("d", 2): 31.0,
        ("d", 3): 60.0,
        ("m", 1): 1.0,
        ("m", 2): 2.0,
        ("m", 3): 3.0,
    }
    with pytest.raises(ValueError, match="valid names: d, m"):
        prepare.load(raw, catalog, "extra")
    assert [r[0] for r in align.keep_present(raw, catalog)[1].collect()] == ["none"]


def test_engineer_end_to_end(panel):
    prepared = prepare.preprocess(panel, PrepareConfig(target="goal", deflator="index"), **ROLES)
    result = plan.engineer(prepared, EngineerConfig(target="goal", rounds=2), trials=10)
    chosen = result.selected.first()
    base, candidates = result.prepared.base.first()["features"], {r["feature"] for r in result.prepared.candidates.collect()}
    assert not set(chosen["added"]) - candidates
    assert not any(n.startswith("goal__") for n in candidates)
    assert set(chosen["features"]) == (set(base) | set(chosen["added"])) - set(chosen["dropped"])
    summary = {r["model"]: r for r in result.summary.collect()}
    assert set(summary) == {"xgboost", "lightgbm", "all"}
    # The scores use the penalties that the search found.
    best = {r["model"]: r["best_mse"] for r in result.search.collect()}
    for model, value in best.items():
        assert summary[model]["initial_mse"] == pytest.approx(value)
        assert summary[model]["initial_mean_mse"] >= value and summary[model]["final_mean_mse"] is not None
    matrix = plan.engineered_matrix(result)
    assert {r[0] for r in matrix.select("feature").distinct().collect()} == set(chosen["features"])
    assert plan.engineered_target(result).groupBy("split").count().count() == 2
    none = plan.engineer(prepared, EngineerConfig(target="goal", rounds=0), trials=3)
    assert none.selected.first()["added"] == [] and none.prepared.candidates.count() == 0


@pytest.fixture(scope="module")
def mixed(make_panel):
    """Two panels of different series; p has gaps in both predictors, q none, r no target."""
    rng = np.random.default_rng(4)
    n = 50
    series = {}
    for name, columns in (("p", "ab"), ("q", "cd"), ("r", "e")):
        for c in columns:
            values = list(rng.normal(size=n).cumsum())
            if name == "p":
                for i in rng.choice(n, 8, replace=False):
                    values[i] = None
            series[name, c] = values
        if name != "r":
            series[name, "y"] = list(rng.normal(size=n))
    return split.chrono_split(make_panel(series)).cache()


def test_gaps_and_mixed_panels(mixed):
    penalties = {"xgboost": 0.5, "lightgbm": 2.0}
    wide = mixed.where("panel_id = 'p'").toPandas().pivot(index=["split", "ts"], columns="series_id", values="value").dropna()
    train, test = wide.loc["train"], wide.loc["test"]
    known = mixed.where("panel_id = 'p' and split = 'train'").toPandas().groupby("series_id").value
    want = 0.0
    for penalty in penalties.values():
        z = lambda d: ((d[["a", "b"]] - known.mean()[["a", "b"]]) / known.std(ddof=0)[["a", "b"]]).to_numpy()
        x, y = z(train), train["y"].to_numpy()
        beta = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + penalty * np.eye(2), (x - x.mean(0)).T @ (y - y.mean()))
        want += float(((test["y"] - y.mean() - (z(test) - x.mean(0)) @ beta) ** 2).mean())
    for rounds in (0, 1):
        result = plan.engineer(mixed, EngineerConfig(target="y", rounds=rounds), penalties=penalties, trials=2)
        rows = {(r["panel_id"], r["model"]): r for r in result.summary.collect()}
        assert {p for p, _ in rows} == {"p", "q", "r"}
        assert rows["p", "all"]["initial_mse"] == pytest.approx(want)
        assert rows["q", "all"]["reason"] is None
        assert rows["r", "all"]["initial_mse"] is None and rows["r", "all"]["reason"] == plan.UNSCORED


def test_many_candidates(spark, mixed):
    """5,000 candidates of one panel, one of them telling; scores equal fits one by one."""
    base = forward.scaled_features(gram.as_features(mixed.where("panel_id = 'q'")))
    dates = mixed.where("panel_id = 'q' and series_id = 'y'").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4999))))
    noise = F.xxhash64("k", "ts") / F.lit(float(2**63))
    value = F.when(F.col("k") == 77, F.col("value") + 0.1 * noise).otherwise(noise)
    parts = dates.select("panel_id", "split", "ts", F.concat(F.lit("k"), F.col("k").cast("string")).alias("feature"), value.alias("value"))
    scaled = base.unionByName(forward.scaled_features(parts)).cache()
    state = spark.createDataFrame([("q", ["c", "d"])], "panel_id string, features array<string>")
    own = spark.createDataFrame([("q", {"m": 0.5})], "panel_id string, penalties map<string,double>")
    scored = forward.add_one(scaled, state, "y", own).cache()
    assert scored.count() == 5000
    assert selection.top_improving(scored).orderBy("rank").first()["feature"] == "k77"
    for name in ("k77", "k5"):
        one = spark.createDataFrame([("q", ["c", "d", name])], "panel_id string, features array<string>")
        sums = gram.product_sums(forward.base_matrix(scaled, one, "y"))
        every = F.array(*[F.lit(i) for i in range(3)])
        want = selection.baseline_scores(sums, every, {"m": 0.5}).first()["agg_mse"]
        assert scored.where(F.col("feature") == name).first()["agg_mse"] == pytest.approx(want)
