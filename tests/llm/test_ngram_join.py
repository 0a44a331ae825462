"""The Jaccard join against brute force."""

import random
import re
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from llm_plain import plain_components

from tidepanel.llm import graph, ngram_join, words


def family(rng, size, n_words, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(n_words)]
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(n_words)] = f"e{rng.randrange(10**6)}"
        yield " ".join(copy)


def corpus(seed):
    rng = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [*family(rng, 60, 200, 4), *family(rng, 40, 150, 9), *family(rng, 5, 30, 1), *family(rng, 30, 100, 3)]
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(5, 80))) for _ in range(60)]
    chain = [f"c{k}" for k in range(160)]  # each overlaps the next enough, the ends do not
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 60, 10)]
    texts += ["A b C", "a B c", "a b", None, "", " \n", "one", "ONE"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("star", [512, 7])
def test_components(spark, monkeypatch, star):
    monkeypatch.setattr(ngram_join, "STAR", star)
    rows = corpus(star)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows)


def test_tasks_hold_few_bytes_of_sets(spark, monkeypatch):
    """Sets of long texts are dealt by their bytes, not only by how many they are."""
    most = 100_000
    monkeypatch.setattr(ngram_join, "SET_BYTES", most, raising=False)
    compared = spark.sparkContext.accumulator(0)

    def bounded(step):
        def run(table):
            assert sum(len(g) for g in table.column("grams").to_pylist()) < 3 * most  # two blocks, dealt by hash
            compared.add(1)
            return step(table)

        return run

    for name in ("_verify", "_across"):
        monkeypatch.setattr(ngram_join, name, bounded(getattr(ngram_join, name)))
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(900))
    texts = [*family(rng, 60, 1000, 12), *family(rng, 60, 1000, 45)]
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(100, 330))) for _ in range(90)]
    rows = list(enumerate(texts))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert compared.value > 6
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows)


def test_shares_and_blocks_follow_sets(spark):
    """48 MB of sets are cut in three though they are few, 2,000 partners of small groups in four, and no row is lost."""
    pairs = [(1, b, 0, 20_000) for b in range(300)] + [(2, b, 0, 10) for b in range(2000)] + [(3, 7, 0, 90), (3, 8, 1, 90)]
    dealt = ngram_join._dealt(spark.createDataFrame(pairs, "a long, b long, salt int, m long")).collect()
    assert sorted((r["a"], r["b"], r["salt"], r["m"]) for r in dealt) == sorted(pairs)
    assert {a: {r["share"] for r in dealt if r["a"] == a} for a in (1, 2, 3)} == {1: {0, 1, 2}, 2: {0, 1, 2, 3}, 3: {0}}
    members = [(1, 0, s, 20_000, s % 2) for s in range(300)] + [(2, 0, s, 10, s) for s in range(2000)]
    members += [(3, 0, s, 90, s) for s in range(5)] + [(4, 0, s, 90, 1) for s in range(5)]
    cut = ngram_join._cut(spark.createDataFrame(members, "hub long, kind int, sig long, n long, root long")).collect()
    assert {(r["hub"], r["blocks"]) for r in cut} == {(1, 3), (2, 2), (3, 1)} and len(cut) == 2305


def test_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wanted = plain_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = ngram_join.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == wanted


def test_hubs_are_the_same_in_any_number_of_buckets():
    """A family whose n-grams are dealt over more buckets must not get more hubs: what is fetched grows with them."""
    rng = random.Random(3)
    texts = [t for _ in range(5) for t in family(rng, 30, 200, 4)]
    ranks = SimpleNamespace(value=np.arange(1 << ngram_join.COUNT_BITS, dtype=np.uint32))

    def groups(buckets):
        batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
        out, pairs = defaultdict(set), set()
        for dealt in pa.Table.from_batches(ngram_join._prefixes(ranks, buckets)([batch])).to_pylist():
            found = ngram_join._candidates(pa.table({"records": pa.array([dealt["records"]], pa.binary())}))
            for r in found.to_pylist():
                if r["members"] is None:
                    pairs.add((r["a"], r["b"]))
                else:
                    out[r["a"]].update(np.frombuffer(r["members"], ngram_join.MEMBER)["sig"].tolist())
        return out, pairs

    assert groups(1) == groups(64)
    assert ngram_join.RECORD.itemsize <= 16


def test_trie_links_equal_plain_overlaps():
    rng = np.random.default_rng(1)
    for _ in range(50):
        base = rng.integers(0, 10_000, 300).astype(np.uint64)
        members = {}
        for name in range(20):
            keep = base[rng.random(len(base)) < rng.choice([0.5, 0.8, 0.9, 0.97])]
            members[name] = np.unique(np.concatenate([keep, rng.integers(0, 10_000, rng.integers(0, 40)).astype(np.uint64)]))
        own = np.unique(base)
        spell = lambda s: s.astype(">u8").tobytes()
        found = ngram_join.trie_links(spell(own), [(k, spell(s)) for k, s in members.items()])
        for k, s in members.items():
            n = len(np.intersect1d(own, s))
            assert (k in found) == (100 * n >= 75 * (len(own) + len(s) - n))
            assert ngram_join.overlap_bound(ngram_join.profile(own), ngram_join.profile(s)) >= n


def test_bounds():
    for n in range(1, 200):
        for m in range(-(-3 * n // 4), n + 1):
            k = ngram_join.needed(n, m)
            assert 100 * k >= 75 * (n + m - k) and 100 * (k - 1) < 75 * (n + m - k + 1)
            # Two sets that share k: even if what differs comes first, the prefixes meet.
            assert n - k < ngram_join.prefix_lengths(n)[0] and m - k < ngram_join.prefix_lengths(m)[1]


def test_word_hashes_at_any_segment(monkeypatch):
    rng = random.Random(7)
    for _ in range(100):
        monkeypatch.setattr(words, "SEGMENT", rng.choice([4, 7, 16, 1 << 16]))
        words._powers.clear()
        texts = [rng.choice([None, "", "".join(rng.choice("aAb \t\nzé") for _ in range(rng.randint(0, 60)))]) for _ in range(5)]
        hashes, counts = words.words(pa.array(texts, pa.string()), words.LOWER)
        plain = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
        assert counts.tolist() == [len(p) for p in plain]
        seen = {}
        for w, h in zip([w for p in plain for w in p], hashes.tolist()):
            assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)
    words._powers.clear()


def test_connected_components(spark):
    rng = random.Random(8)
    nodes = [rng.getrandbits(60) for _ in range(300)]
    edges = [(nodes[k], nodes[k + 1]) for k in range(120)] + [(rng.choice(nodes[150:]), rng.choice(nodes[150:])) for _ in range(100)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for e in edges for n in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[top(a)] = top(b)
    groups = defaultdict(set)
    for n in got:
        groups[got[n]].add(n)
    wanted = defaultdict(set)
    for n in parent:
        if any(n in e and e[0] != e[1] for e in edges):
            wanted[top(n)].add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))
