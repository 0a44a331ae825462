"""The filter audit, the license scan and the clustering against plain versions, and their odd rows."""

import hashlib
import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidepanel.llm import centroids, filter_audit, license_scan, queries_audit

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, digest string, part string, cell int, word int, n int, _t int"
LABELS = "doc_id long, quality int, toxic int, id int"
LONG = "the MIT License and the " * 30_000 + "x" * 50_000


# --- audit ----------------------------------------------------------------------------------------------------


def plain_failures(docs):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, lang in docs:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and i > first[text],
        }
        yield i, lang or "", {k for k, v in fails.items() if v}


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows, shapley = {}, Counter()
    judged = list(plain_failures(docs))
    for part in {p for _, p, _ in judged}:
        mine = [(i, f) for i, p, f in judged if p == part]
        for order in permutations("ABCDE"):
            alive = mine
            for k, x in enumerate(order):
                gone = [(i, f) for i, f in alive if x in f]
                earlier = [f for _, f in mine if x in f and f & set(order[:k])]
                alive = [(i, f) for i, f in alive if x not in f]
                rows[part, "".join(order), k + 1] = (
                    len(alive), len(gone), len(earlier), sum(f == {x} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), x,
                )
                shapley[part, x] += len(gone)
    return {(*k, *v[:-1], shapley[k[0], v[-1]]) for k, v in rows.items()}


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", "  \n", "MIT License", "a b # C", LONG, LONG, "MIT License", " ".join(f"w{i}" for i in range(120))]
    rows = [(i, t, [None, "", "en", "de"][i % 4], None, 1, 2, "d", "p", 3, 4, 5, 6) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "MIT License", "en", *[None] * 9), (2, "another of id two", "en", *[None] * 9)]
    return rows, spark.createDataFrame(rows, DOCS)


def test_audit_of_odd_rows(spark, odd):
    labels = [(3, 1, 1, 0), (3, 0, 1, 0), (4, None, 1, 0), (None, 1, 1, 0), (5, 1, None, 0), (99, 1, 1, 0)]
    got = filter_audit.audit(odd[1], spark.createDataFrame(labels, LABELS)).collect()
    want = plain_audit([r[:3] for r in odd[0]], [r[:3] for r in labels])
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(spark.createDataFrame([], DOCS), none).collect() == []
    assert all(r["good_lost"] == r["toxic_lost"] == 0 for r in filter_audit.audit(odd[1], none).collect())


def test_audit_of_other_filters(spark, odd):
    got = filter_audit.audit(odd[1], spark.createDataFrame([], LABELS), {"X": "size(_w) = 0", "Y": "_t = ''"}, copies=None)
    rows = {(r["part"], r["filter_order"], r["step"]): r for r in got.collect()}
    assert {o for _, o, _ in rows} == {"XY", "YX"}
    assert sum(r["redundant"] for (_, o, k), r in rows.items() if o == "XY" and k == 2) == 2
    assert sum(r["unique_fails"] for (_, o, k), r in rows.items() if o == "XY" and k == 1) == 1


def test_hot_copies(spark):
    """One text is most of the table, others are shared by a few; ids come in no order."""
    docs = [(i * 7919 % 4001, "same text" if i % 3 else f"t{i % 50}", "en") for i in range(4001)]
    rows = spark.createDataFrame([(i, t, p, *[None] * 9) for i, t, p in docs], DOCS)
    _, tables = filter_audit.failing(rows)
    got = sorted(r["id"] for r in tables["E"].collect())
    assert got == sorted(i for i, _, f in plain_failures(docs) if "E" in f)


# --- licenses ---------------------------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_scan(texts):
    """Every place of every template, without an index."""
    listed = [plain_words(t) for t in texts]
    vocab = {w for t in license_scan.TEMPLATES for w in t.text.split()}
    held = Counter(w for words in listed for w in set(words) & vocab)
    idf = {w: max(1e-3, math.log((len(texts) + 1) / (held[w] + 0.5))) for w in vocab}
    hash_order = {w: int(license_scan.hashes_of(w)[0]) for w in vocab}
    assert len(set(hash_order.values())) == len(vocab)
    out = []
    for words in listed:
        found = []
        for t in license_scan.TEMPLATES:
            parts = t.text.split()
            inside = [p for a, n in t.phrases for p in range(a, a + n)]
            p = min(inside, key=lambda i: (-idf[parts[i]], i))
            room = lambda d: 0 if t.base else int(license_scan.slack(d))  # noqa: B023, E731
            for at in [i for i, w in enumerate(words) if w == parts[p]]:
                begin, starts = at - p, []
                for a, n in t.phrases:
                    r = 0 if a <= p < a + n else room(a - p)
                    near = sorted(range(-r, r + 1), key=abs)
                    places = [begin + a + s for s in near if begin + a + s >= 0 and words[begin + a + s :][:n] == parts[a : a + n]]
                    starts.append(places[0] if places else None)
                if None in starts:
                    continue
                there = sum(
                    idf[w] for i, w in enumerate(parts)
                    if any(0 <= begin + i + s < len(words) and words[begin + i + s] == w for s in range(-room(i - p), room(i - p) + 1))
                )
                found.append((starts[0], t.label, there / sum(idf[w] for w in parts) * there / (there + license_scan.HALF), t.base))
        base = [(a, n) for a, n, _, b in found if b]
        out.append(
            (len(words), len(base), min((a for a, _ in base), default=None), max((a for a, _ in base), default=None),
             sorted({n for _, n in base}), sorted({n for _, n, _, _ in found}), max((s for *_, s, _ in found), default=0.0))
        )
    return out


def check_scan(rows, want):
    for r, w in zip(rows, want):
        got = tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels"))
        assert got == w[:-1]
        assert r["score"] == pytest.approx(w[-1], rel=1e-9) and 0 <= r["score"] <= 1


def test_licenses_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    texts = [r["text"] for r in docs.collect()]
    got = sorted(license_scan.scan(docs).collect(), key=lambda r: r["doc_id"])
    check_scan(got, plain_scan(texts))
    assert sum(len(r["base_labels"]) > 0 for r in got) > 0
    by_query = {r["doc_id"]: r for r in queries_audit.op12_license_scan(spark, SF).collect()}
    assert all(by_query[r["doc_id"]]["labels"] == ",".join(r["labels"]) for r in got)


PIECES = st.sampled_from(
    ["mit", "License", "LICENSE", "general", "public", "GNU", "version", "2", "0", "3", "apache", "cc", "by", "nc", "4", "the", "Licensed",
     "under", "permission is hereby granted, free of charge", "to deal in the Software without restriction", "é", "any person", "\n", "-"]
)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=40).map(" ".join), min_size=1, max_size=6))
def test_licenses_of_any_words(texts):
    vocab = license_scan.vocabulary(license_scan.TEMPLATES)
    held = [sum(int(h) in {int(x) for x in license_scan.hashes_of(t)} for t in texts) for h in vocab]
    index = license_scan.Index(license_scan.TEMPLATES, vocab, license_scan.weights(len(texts), np.array(held)))
    check_scan(license_scan._rows(pa.array(texts), index), plain_scan(texts))


def test_whole_notices(spark):
    """A notice with a name filled in and lines broken is found with its place; a lone phrase scores less."""
    mit = next(t.text for t in license_scan.TEMPLATES if t.label == "mit" and not t.base)
    texts = ["/* Copyright 2020 A. Person\n * " + mit.replace("to deal", "(the\n * Software)\n * to deal") + " */", "some MIT license", "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole, lone, none = sorted(license_scan.scan(docs).collect(), key=lambda r: r["doc_id"])
    assert whole["labels"] == ["mit"] and whole["base_labels"] == [] and whole["notices"][0]["start"] == 4
    assert lone["labels"] == ["mit"] and (lone["n_base"], lone["first_word"]) == (1, 1)
    assert whole["score"] > lone["score"] > none["score"] == 0


def test_licenses_of_odd_rows(spark, odd):
    got = license_scan.scan(odd[1]).collect()
    assert sorted((r["doc_id"], r["n_words"]) for r in got if r["doc_id"] is not None) == sorted(
        (r[0], len(plain_words(r[1]))) for r in odd[0] if r[0] is not None
    )
    assert {r["n_base"] for r in got if r["doc_id"] in (5, 6)} == {30_000}
    assert license_scan.scan(spark.createDataFrame([], DOCS)).collect() == []


# --- clusters --------------------------------------------------------------------------------------------------------


def plain_clusters(vecs, k, rounds):
    """{row: (cluster, distance)} and the last centroids, of a list of (id, whole components)."""
    order = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), list(v)) for i, v in vecs)
    centres, x = np.array([v for _, v in order[:k]], object), np.array([v for _, v in vecs], object)
    for turn in range(rounds + 1):
        d = np.array([[sum((a - c) ** 2) for c in centres] for a in x], object)
        mine = [min(range(len(centres)), key=lambda c: (row[c], c)) for row in d]
        if turn == rounds:
            return [(m, row[m]) for m, row in zip(mine, d)], centres
        for c in set(mine):
            members = [a for a, m in zip(x, mine) if m == c]
            centres[c] = sum(members[1:], members[0]) // len(members)


@pytest.mark.parametrize("spread", [0.05, 0.4])
def test_clusters(spark, spread):
    rng = np.random.default_rng(5)
    heart = rng.normal(size=(6, 64))
    rows = [(i, [float(x) for x in heart[i % 6] * 3 + rng.normal(size=64) * spread], 1, "h") for i in range(240)]
    rows += [(i + 300, rows[i][1], 1, "h") for i in range(20)] + [rows[7], rows[7], (None, rows[8][1], 0, None)]
    odd_rows = [(900, None, 1, ""), (901, [1.0] * 63, 1, ""), (902, [1.0] * 63 + [None], 1, ""), (903, [math.nan] * 64, 1, ""), (904, [math.inf] * 64, 1, ""), (905, [], 1, "")]
    kind = "vec_id long, embedding array<double>, cluster int, id string"
    got = centroids.cluster(spark.createDataFrame(rows + odd_rows, kind), k=12, rounds=4).collect()
    vecs = [(r[0], [math.floor(256 * x) for x in r[1]]) for r in rows]
    want, centres = plain_clusters(vecs, 12, 4)
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == Counter((i, c, d) for (i, _), (c, d) in zip(vecs, want))
    assert {r["inertia"] for r in got} == {sum(d for _, d in want)}
    for r in got:
        assert r["cluster_inertia"] == sum(d for c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()
    scans = sum(r["scans"] for r in got) / len(got)
    assert scans < (3 if spread == 0.05 else 5)  # of five turns: the bounds leave vectors out


def test_few_and_huge_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    assert centroids.cluster(spark.createDataFrame([], kind)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, [0.0])], kind)).collect() == []
    few = centroids.cluster(spark.createDataFrame([(1, [0.5] * 64), (2, [-1e30] * 64), (3, [2e5] * 64)], kind)).collect()
    assert sorted(r["distance"] for r in few) == [0, 0, 0]
    same = centroids.cluster(spark.createDataFrame([(i, [0.25] * 64) for i in range(50)], kind)).collect()
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in same} == {(0, 0, 0)}


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 5), st.floats(0.01, 30), st.floats(0.01, 30))
def test_shrink_is_a_bound(seed, dims, far, radius):
    """No point of a sphere comes closer to a moved centroid than the bound says, and it is never above the drift."""
    rng = np.random.default_rng(seed)
    before = rng.normal(size=(4, dims)) * far
    now = before + rng.normal(size=(4, dims)) * rng.random((4, 1)) * far
    radii = rng.random(4) * radius
    bound = centroids.shrink(before, now, radii)
    points = rng.normal(size=(4, 200, dims))
    points *= (radii[:, None] * rng.random((4, 200)) ** 0.2 / np.linalg.norm(points, axis=2))[:, :, None]
    points += before[:, None]
    drift = np.linalg.norm(now - before, axis=1)
    for i in range(4):
        closer = np.linalg.norm(points[i][:, None] - before, axis=2) - np.linalg.norm(points[i][:, None] - now, axis=2)
        others = [j for j in range(4) if j != i]
        assert closer[:, others].max() <= bound[i] + 1e-9
        assert bound[i] <= drift[others].max() * (1 + 1e-6)


def test_shrink_is_less_than_the_drift():
    """A centroid that moves across the line of sight, or away, costs a far sphere little or nothing."""
    before = np.array([[0.0, 0.0], [100.0, 0.0]])
    across = centroids.shrink(before, before + [[0.0, 0.0], [0.0, 10.0]], np.array([5.0, 0.0]))[0]
    away = centroids.shrink(before, before + [[0.0, 0.0], [10.0, 0.0]], np.array([5.0, 0.0]))[0]
    towards = centroids.shrink(before, before - [[0.0, 0.0], [10.0, 0.0]], np.array([5.0, 0.0]))[0]
    assert 0 <= away < 0.001 and across < 1.1 and towards == pytest.approx(10.0, rel=1e-6)
