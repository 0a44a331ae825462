"""The pipeline against a plain one, and the registered queries' names."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
from llm_plain import plain_budgets, plain_components, plain_counts
from tidepanel.llm import piece_codec, quality, queries_native, registry

SF = "/root/testdata/sf0.001"


def ratio(rule_sql, counts):
    return eval(rule_sql, {}, dict(counts))  # noqa: S307


def test_pipeline(spark):
    from sentencepiece import SentencePieceProcessor

    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    counts = {i: plain_counts(r["text"]) for i, r in rows.items()}
    votes = {i: tuple(0 if ratio(x.bad, c) else 1 if ratio(x.good, c) else 2 for x in quality.RULES) for i, c in counts.items()}
    model = quality.estimate(Counter(votes.values()))
    base = lambda c: c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
    kept = [i for i in rows if not base(counts[i]) and model.log_odds(votes[i]) >= 0]
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]["text"] or ""), i)
    kept = sorted(first.values())
    near = plain_components([(i, rows[i]["text"]) for i in kept])
    kept = [i for i in kept if near[i][1] == i]

    def leaf(i):
        digits = re.fullmatch(r"src([0-9]+)", rows[i]["source"] or "")
        return (f"d{int(digits[1]) % 3}" if digits else "other", rows[i]["lang"] or "other", rows[i]["source"] or "other")

    n = {i: counts[i]["n_words"] for i in kept}
    supply = Counter()
    for i in kept:
        supply[leaf(i)] += n[i]
    names = list(queries_native.LEVELS)
    budgets = plain_budgets(dict(supply), queries_native.WEIGHTS, names, queries_native.FRACTION * sum(n.values()))
    taken = set()
    for key, budget in budgets.items():
        start = 0
        for _, i in sorted((hashlib.md5(f"{queries_native.SEED}:0:{i}".encode()).hexdigest(), i) for i in kept if leaf(i) == key):
            if start + n[i] > int(budget + 1e-6):
                break
            start += n[i]
            taken.add(i)
    library = SentencePieceProcessor(model_file=piece_codec.MODEL)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == taken
    for i, r in got.items():
        assert list(r["pieces"]) == library.encode(rows[i]["text"] or "") and r["round_trip"]


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in registry.queries()) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(corpus_pipeline.STAGES) == 5
