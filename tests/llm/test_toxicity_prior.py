"""Scores mean the same when the labels outgrow the sample."""

import numpy as np
import pyarrow as pa

from tidepanel.llm import toxicity


def test_repeated_rows_beyond_the_bounds_are_predicted_alike(spark, monkeypatch):
    def predicted(times):
        rows = []
        for k in range(400 * times):
            n = k % 400
            words = ["we", "met", f"{'abcdefgh'[n % 8]}word", f"{'klmnopq'[n % 7]}thing", f"{'rstuv'[n % 5]}place"]
            toxic = int(n % 9 == 0)
            rows.append((k, " ".join(words + (["awful"] if toxic and n % 2 else [])), toxic))
        table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        found = toxicity.score(table, table.select("doc_id", "toxic")).where("doc_id < 400")
        return {r["doc_id"]: r["predicted"] for r in found.collect()}, toxicity.class_counts(table)

    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 200)
    monkeypatch.setattr(toxicity, "SAMPLE_OTHER", 400)
    once, (other, toxic) = predicted(1)
    assert other < 400 and toxic < 200 and 0 < sum(once.values()) < 100
    many, (other, toxic) = predicted(12)
    assert other > 400 and toxic > 200
    assert many == once


def trained(spark, sf="/root/testdata/sf0.01"):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.sample(docs, labels).mapInArrow(toxicity._bags, "toxic int, bag binary").collect()
    bags = [np.frombuffer(r["bag"], toxicity.U64) for r in rows]
    return bags, [r["toxic"] for r in rows], pa.array([r["text"] for r in docs.collect()])


def test_fit_has_converged(spark, monkeypatch):
    """Twice as many steps, or a stricter end, change no score."""
    bags, toxic, texts = trained(spark)
    first = toxicity.fit(bags, toxic, toxicity.swaps(), None, toxicity.template_pairs())
    monkeypatch.setattr(toxicity, "STEPS", 2 * toxicity.STEPS)
    monkeypatch.setattr(toxicity, "SETTLED", toxicity.SETTLED / 100)
    more = toxicity.fit(bags, toxic, toxicity.swaps(), None, toxicity.template_pairs())
    assert np.abs(first.scores(texts) - more.scores(texts)).max() < 1e-3 and len(first.keys) > 3


def test_weights_solve_the_loss(spark):
    """The picked words' weights are where the derivative of the loss, by differences, is nothing."""
    bags, toxic, _ = trained(spark)
    model = toxicity.fit(bags, toxic, {}, None, ())
    kept = sorted({(b.tobytes(), t) for b, t in zip(bags, toxic)}, key=lambda x: (x[1], x[0]))
    x = np.array([np.isin(model.keys, np.frombuffer(b, toxicity.U64)) for b, _ in kept], float)
    y = np.array([t for _, t in kept], float)

    def loss(w):
        z = x @ w[:-1] + w[-1]
        return (np.logaddexp(0, z) - y * z).mean() + toxicity.L2 / 2 * (w[:-1] ** 2).sum()

    w = np.append(model.weights, model.offset)
    for i in range(len(w)):
        e = np.zeros(len(w))
        e[i] = 1e-4
        assert abs(loss(w + e) - loss(w - e)) / 2e-4 < 1e-6


def test_templates_act_on_rare_terms():
    """A term that only toxic texts have carries weight without the templates and next to none with them, in
    every language of the terms; words of no group keep theirs."""
    rng = np.random.default_rng(1)
    texts, toxic = [], []
    for i in range(400):
        bad = i % 4 == 0
        plain = ["w" + "".join(rng.choice(list("abcdefgh"), 2)) for _ in range(6)]
        term = [["muslim"], ["musulmans"], ["flüchtlinge"], []][i // 4 % 4] if bad else []
        texts.append(" ".join(plain + term + (["vile"] if bad and i % 3 else [])))
        toxic.append(int(bad))
    bags = list(toxicity.distinct_features(pa.array(texts)))
    ask = pa.array(["muslim", "jewish", "musulmans", "juifs", "flüchtlinge", "ausländer", "vile", ""])
    odds = lambda m: np.log(m.scores(ask) / (1 - m.scores(ask)))
    free = odds(toxicity.fit(bags, toxic, toxicity.swaps(), None, toxicity.template_pairs(), strength=0.0))
    fair = odds(toxicity.fit(bags, toxic, toxicity.swaps(), None, toxicity.template_pairs(), strength=30.0))
    for a, b in ((0, 1), (2, 3), (4, 5)):
        assert free[a] - free[b] > 1.5 and fair[a] - fair[b] < 0.5 * (free[a] - free[b])
    assert fair[6] - fair[7] > 1.0
