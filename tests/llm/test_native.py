"""Exact dedup, quality rules, mixing and sharding against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from llm_plain import plain_budgets, plain_counts
from pyspark.sql import functions as F

from tidepanel.llm import exact_dedup, mixing, quality, shard

SF = "/root/testdata/sf0.001"


def test_chunks_join_again(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aeioudhnrs \né😀") for _ in range(n)) for n in (0, 1, 511, 512, 513, 5000, 40_000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for text, pieces in df.select("text", exact_dedup.chunks(F.col("text"))).collect():
        assert "".join(pieces) == text
        assert all(len(p) <= exact_dedup.MAX_CHUNK for p in pieces)


@pytest.mark.parametrize("clash", [False, True])
def test_exact_duplicates(spark, monkeypatch, clash):
    if clash:  # as if every chunk's hash were shared with another chunk
        monkeypatch.setattr(exact_dedup, "_clashes", lambda cut: cut.select(F.explode("pieces").alias("c")).select(F.xxhash64("c").alias("h")).distinct())
    rng = random.Random(2)
    base = [" ".join(rng.choice(("these", "words", "and", "aard", "x")) for _ in range(rng.choice((0, 3, 400)))) for _ in range(30)]
    rows = [(i, rng.choice(base).replace(" ", rng.choice((" ", "\t\n", "  ")))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "a\x0bb"), (403, "a b"), (404, "a b")]
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    assert len(got) == len(rows)
    for body, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (min(ids), len(ids), i == min(ids))
            assert r["text_sha256"] == hashlib.sha256(body.encode()).hexdigest()


def quality_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice(("a", "b", "a b c d e f ", " ", "\n", "#", "é|", "\t")) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return [*texts, None, "", " ", "w " * 3000, "😀 " * 20]


def test_quality_counts_make_each_window_once(spark):
    """Windows are one column of one regex: no slice, look-up or translation per word, and none made again."""
    long, run = "x" * 200_000, "a\vb\fc\rd  e "
    texts = [run * 3 + long, f"{long} {long} " + run, "one two", " \x0b\n", None, "\n".join(["é à ü ö ß."] * 4)]
    counted = quality.counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "translate(" not in plan
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"], r["n_ends"]) for r in counted.collect()}
    assert got == {
        0: (16, 15 + len(long), 15, 0, 0), 1: (7, 5 + 2 * len(long), 0, 0, 0), 2: (2, 6, 0, 0, 0), 3: (0, 0, 0, 0, 0),
        4: (0, 0, 0, 0, 0), 5: (20, 24, 20, 3, 4),
    }


def test_quality_counts(spark):
    texts = quality_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.judge(df).collect():
        plain = plain_counts(texts[r["doc_id"]])
        assert {k: r[k] for k in plain} == plain, texts[r["doc_id"]]
        failed = plain["n_words"] < 10 or 100 * plain["n_repeat_words"] > 20 * plain["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["p_good"] >= 0.5)
    kept = {r["doc_id"] for r in quality.judge(df).where("kept").collect()}
    assert {r["doc_id"] for r in quality.keep_good(df).collect()} == kept


def test_estimation_finds_accuracies():
    rng = random.Random(4)
    right = (0.9, 0.8, 0.7, 0.85)
    cast = Counter()
    truth = []
    for _ in range(20_000):
        good = rng.random() < 0.7
        votes = tuple(2 if rng.random() < 0.2 else int(good == (rng.random() < r)) for r in right)
        cast[votes] += 1
        truth.append((good, votes))
    model = quality.estimate(cast, rounds=100)
    assert abs(model.good - 0.7) < 0.05
    for (g, _), r in zip(model.votes, right):
        assert abs(g[1] / (g[0] + g[1]) - r) < 0.06
    agree = sum((model.log_odds(v) > 0) == g for g, v in truth) / len(truth)
    majority = sum((v.count(1) > v.count(0)) == g for g, v in truth) / len(truth)
    assert agree >= majority


def cast_by(counts):
    """The votes over plain counts."""
    held = lambda sql: eval(sql, {}, dict(counts))  # noqa: E731, S307
    return tuple(0 if held(r.bad) else 1 if held(r.good) else 2 for r in quality.RULES)


def test_posterior_decides_not_the_rules(spark):
    """Some texts with a bad vote stay and some without one go; the labels, which nothing is fitted on, agree with
    that at least as often as with a filter that every rule has to pass."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    judged = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    votes = {i: cast_by(r.asDict()) for i, r in judged.items()}
    model = quality.estimate(Counter(votes.values()))
    for i, r in judged.items():
        assert r["p_good"] == pytest.approx(1 / (1 + math.exp(-model.log_odds(votes[i]))), rel=1e-9)
        assert r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.5)
    open_ = [i for i, r in judged.items() if not r["base_failed"]]
    stay = [i for i in open_ if 0 in votes[i] and judged[i]["kept"]]
    go = [i for i in open_ if 0 not in votes[i] and not judged[i]["kept"]]
    assert len(stay) >= 10 and len(go) >= 10
    all_pass = lambda i: not judged[i]["base_failed"] and 0 not in votes[i]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    right = sum(judged[i]["kept"] == (q == 1) for i, q in labels.items())
    assert right >= sum(all_pass(i) == (q == 1) for i, q in labels.items())
    bad = [i for i, q in labels.items() if q == 0]
    good = [i for i, q in labels.items() if q == 1 and not judged[i]["base_failed"]]
    assert sum(judged[i]["kept"] for i in bad) <= 0.05 * len(bad) and sum(judged[i]["kept"] for i in good) >= 0.98 * len(good)


@pytest.mark.parametrize("epochs,fraction", [(1, 0.5), (3, 1.4), (1, 5.0)])
def test_mixing(spark, epochs, fraction):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.choice((0, 1, 5, 40))), rng.choice(["en", "en", "en", "de", None]), f"s{rng.choice((0, 0, 0, 1, 2))}") for i in range(600)]
    levels, weights = {"language": "lang", "origin": "source"}, {"language": {"de": 3.0}, "origin": {"s1": 2.0, "s2": 0.5}}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.choose(df, levels, weights, fraction, epochs, seed=9).collect()
    n = {i: len(t.split()) for i, t, _, _ in rows}
    leaf = {i: (a or "other", b) for i, _, a, b in rows}
    supply = Counter()
    for i in n:
        supply[leaf[i]] += n[i]
    wanted = plain_budgets({k: v * epochs for k, v in supply.items()}, weights, list(levels), fraction * sum(n.values()))
    expected = []
    for key, budget in wanted.items():
        order = sorted((e, hashlib.md5(f"9:{e}:{i}".encode()).hexdigest(), i) for e in range(epochs) for i in n if leaf[i] == key)
        start = 0
        for e, _, i in order:
            if start + n[i] > int(budget + 1e-6):
                break
            expected.append((i, e, start))
            start += n[i]
    assert sorted((r["doc_id"], r["epoch"], r["start"]) for r in got) == sorted(expected)
    if epochs == 1:
        assert sorted(r["doc_id"] for r in mixing.mix(df, levels, weights, fraction, seed=9).collect()) == sorted(i for i, _, _ in expected)


def test_sharding(spark):
    rng = random.Random(6)
    rows = [(i, "hot " * 50 if i % 3 == 0 else ("pair %d" % (i // 4)) * rng.randint(1, 80)) for i in range(6000)]
    got = shard.assign(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    texts = dict(rows)
    load, slots, places = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        body = texts[r["doc_id"]].encode()
        assert r["size"] == len(body) + 8 and r["text_crc32"] == zlib.crc32(body)
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        places[texts[r["doc_id"]]].add(r["shard"])
    assert len(got) == len(rows) and set(load) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(load.values()) / 24
    assert max(load.values()) < 1.03 * mean and min(load.values()) > 0.97 * mean
    split = [t for t, s in places.items() if len(s) > 1]
    assert split == ["hot " * 50]


def test_write_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shard.write_shards(docs, str(tmp_path / "out"), 6)
    back = spark.read.parquet(str(tmp_path / "out"))
    placed = {r["doc_id"]: r["shard"] for r in shard.assign(docs, 6).collect()}
    assert {r["doc_id"]: r["shard"] for r in back.select("doc_id", "shard").collect()} == placed
    assert set(back.columns) == {*docs.columns, "shard"}
