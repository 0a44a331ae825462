"""Toxicity by a linear classifier with counterfactual regularisation.

The features of a text are its distinct words, the beginnings of longer words (many languages build words
from a stem), and two signs of shouting. The loss is the logistic loss on labelled texts, a penalty
on absolute weights, and the squared change of the score when identity terms are swapped for others of their
group: in the labelled texts that have any, and in a template sentence for each term, so that the penalty acts
on every term that becomes a feature, however rare it is in labelled texts. The swap leaves the label as it
is, so what a group is called cannot carry weight in either direction, and neutral mentions are not flagged.

The model is fitted on the driver, on a sample whose size is a parameter; every text is scored where it is.
The classes of the sample are weighted to their shares of all labels for fitting, so that a score means the same
whether or not the sample takes all of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import words
from tidepanel.llm.common import settle

#: Labelled texts used for fitting, at most, of each class.
SAMPLE_TOXIC, SAMPLE_OTHER = 2_000, 4_000
#: A word is a feature when it stands in so many texts of the sample; the most telling ones are kept.
MIN_TEXTS, MAX_FEATURES = 3, 20_000
#: And when its log odds between the classes are this many times what chance in that many texts gives.
TELLING = 4.0
L1, L2, COUNTERFACTUAL = 0.0005, 0.0003, 1.0
#: The share of the counterfactual penalty that the template sentences have; the labelled texts have as much.
TEMPLATES = 1.0
#: Steps end when no weight would gain more than this by another, at the latest after so many.
SETTLED, STEPS, NEWTON_STEPS = 1e-7, 20_000, 100
THRESHOLD = 0.3
#: Beginnings of words, in bytes, that are features, and the shares of a text's bytes that count as shouting.
HEADS = (4, 6)
CAPITALS, EXCLAMATIONS = 1, 2
LOUD = {CAPITALS: 0.3, EXCLAMATIONS: 0.05}
#: The score of all texts while no label of one of the classes is known.
UNKNOWN = 0.1

#: Terms for groups of people; a swap takes the next term of the same row.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("african", "european", "american", "chinese", "indian", "mexican"),
    ("old", "young"),
    ("disabled", "deaf", "blind"),
    ("frauen", "männer"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwule", "lesben", "bisexuelle", "heterosexuelle"),
    ("schwarze", "weiße", "asiaten", "araber"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("homosexuels", "lesbiennes", "bisexuels", "hétérosexuels"),
    ("noirs", "blancs", "asiatiques", "arabes"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("mujeres", "hombres"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("homosexuales", "lesbianas", "bisexuales", "heterosexuales"),
    ("negros", "blancos", "asiáticos", "árabes"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
)

U64 = np.uint64


def word_key(word: str) -> int:
    """The hash under which :func:`features` lists a word of ASCII letters."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(words.word_hashes(data, words.LOWER, words.NO_LETTER)[0])


def swaps(groups: Sequence[Sequence[str]] = IDENTITY_TERMS) -> dict[int, int]:
    keyed = [[word_key(w) for w in group] for group in groups]
    return {a: b for group in keyed for a, b in zip(group, group[1:] + group[:1])}


def template_pairs(groups: Sequence[Sequence[str]] = IDENTITY_TERMS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features that go and come when a term of a group takes the place of another in a sentence, beginnings of the
    words included; each pair of a group once."""
    of = lambda w: next(distinct_features(pa.array([w])))
    out = []
    for group in groups:
        found = [of(w) for w in group]
        out += [(np.setdiff1d(a, b), np.setdiff1d(b, a)) for i, a in enumerate(found) for b in found[i + 1 :]]
    return out


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text number) of each feature that a text has, as often as it has it: runs of letters, A-Z as
    a-z, their first bytes, and what shouting looks like."""
    hashes, counts = words.words(column, words.LOWER, words.NO_LETTER, HEADS)
    text = np.repeat(np.arange(len(counts)), counts)
    found = [(row[row != 0], text[row != 0]) for row in hashes]
    data, ends = words.text_bytes(column)
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    for key, mark in ((CAPITALS, (data >= 65) & (data <= 90)), (EXCLAMATIONS, data == 33)):
        upto = np.append(0, np.cumsum(mark))
        share = (upto[ends] - upto[starts]) / np.maximum(ends - starts, 1)
        loud = np.flatnonzero(share > LOUD[key])
        found.append((np.full(len(loud), key, U64), loud))
    return np.concatenate([k for k, _ in found]), np.concatenate([t for _, t in found])


def distinct_features(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its features."""
    for part in words.slices(column):
        yield from _distinct(part)


def _distinct(column: pa.Array) -> Iterator[np.ndarray]:
    keys, text = features(column)
    order = np.argsort(text, kind="stable")
    keys, cuts = keys[order], np.searchsorted(text[order], np.arange(len(column) + 1))
    for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield np.unique(keys[start:end])


@dataclass(frozen=True)
class Model:
    """Sorted word hashes, their weights, and the score's offset."""

    keys: np.ndarray
    weights: np.ndarray
    offset: float

    def scores(self, column: pa.Array) -> np.ndarray:
        return np.concatenate([self._scores(part) for part in words.slices(column)] or [np.empty(0)])

    def _scores(self, column: pa.Array) -> np.ndarray:
        keys, text = features(column)
        total = np.full(len(column), self.offset)
        if len(self.keys) and len(keys):
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[place] == keys
            pairs = np.unique(text[hit] * len(self.keys) + place[hit])  # a feature counts once
            total += np.bincount(pairs // len(self.keys), self.weights[pairs % len(self.keys)], len(column))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [x.tobytes() for x in distinct_features(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary())], names=["toxic", "bag"])


def held_out(row_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(row_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, toxic) of the labels for fitting, none held out.

    Rows of ``labels`` with a null id or label are no labels; an id labelled twice is toxic if either says so.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(id_col))
    return known.groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic"))


def class_counts(labels: DataFrame, id_col: str = "doc_id") -> tuple[int, int]:
    """How many labels for fitting say other and toxic."""
    ones = [F.count(F.when(F.col("toxic") == k, 1)) for k in (0, 1)]
    return tuple(training_labels(labels, id_col).agg(*ones).first())


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(toxic, text) of labelled rows for fitting: those of the smallest id hashes of each class."""
    known = training_labels(labels, id_col)
    order = F.xxhash64("id")
    some = known.where("toxic = 1").orderBy(order, "id").limit(SAMPLE_TOXIC)
    rest = known.where("toxic = 0").orderBy(order, "id").limit(SAMPLE_OTHER)
    chosen = F.broadcast(settle(some.unionByName(rest), "toxic-sample"))  # SAMPLE_TOXIC + SAMPLE_OTHER rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(chosen, "id").select(F.col("toxic").cast("int"), "text")


def fit(
    bags: Sequence[np.ndarray],
    toxic: Sequence[int],
    pairs: dict[int, int],
    counts: tuple[int, int] | None = None,
    templates: Sequence[tuple[np.ndarray, np.ndarray]] = (),
    strength: float | None = None,
) -> Model:
    """Proximal gradient steps with momentum pick the words, Newton steps fit those picked. Texts of equal words
    count once.

    ``counts``: how many texts of class 0 and 1 the given ones stand for, where they are a sample of each class.
    """
    strength = COUNTERFACTUAL if strength is None else strength
    seen = {(b.tobytes(), t) for b, t in zip(bags, toxic)}
    kept = [(np.frombuffer(b, U64), t) for b, t in sorted(seen, key=lambda x: (x[1], x[0]))]
    y = np.array([t for _, t in kept], float)
    if not len(y) or y.min() == y.max():
        return Model(np.empty(0, U64), np.empty(0), float(np.log(UNKNOWN / (1 - UNKNOWN))))
    share = np.bincount(y.astype(int), minlength=2)
    meant = share if counts is None else np.array(counts, float)
    side = (meant / meant.sum() / share)[y.astype(int)]
    rows = np.repeat(np.arange(len(kept)), [len(b) for b, _ in kept])
    names, columns = np.unique(np.concatenate([b for b, _ in kept]), return_inverse=True)
    inside = np.bincount(columns, minlength=len(names))
    with_toxic = np.bincount(columns, y[rows], len(names))
    told = np.abs(np.log((with_toxic + 0.5) / (y.sum() + 1)) - np.log((inside - with_toxic + 0.5) / (len(y) - y.sum() + 1)))
    told = np.where(inside >= MIN_TEXTS, told * np.sqrt(inside), 0.0)
    keys = np.sort(names[np.argsort(-told, kind="stable")[: min(MAX_FEATURES, int((told >= TELLING).sum()))]])
    changed_to = np.array([pairs.get(int(k), 0) for k in names], U64)
    x = _matrix(keys, names[columns], rows, len(kept))
    # The difference that swapping makes: a term goes, the next of its group comes.
    hit = changed_to[columns] != 0
    gone = _matrix(keys, names[columns][hit], rows[hit], len(kept))
    come = _matrix(keys, changed_to[columns][hit], rows[hit], len(kept))
    swapped = [_difference(gone, come, side, strength)]
    if templates:
        lists = [np.concatenate([t[k] for t in templates]) for k in (0, 1)]
        of = [np.repeat(np.arange(len(templates)), [len(t[k]) for t in templates]) for k in (0, 1)]
        one = [_matrix(keys, v, o, len(templates)) for v, o in zip(lists, of)]
        swapped.append(_difference(*one, np.full(len(templates), TEMPLATES / len(templates)), strength))
    weights = _pick(x, swapped, y, side, len(keys))
    # The penalty on absolute weights picks the words but also shrinks them: fit those picked once more.
    used = weights != 0
    place = np.cumsum(used) - 1

    def narrow(m):
        some = used[m[1]]
        return (m[0][some], place[m[1][some]], m[2], *[v[some] for v in m[3:]])

    weights, offset = _fit_picked(narrow(x), [narrow(d) for d in swapped], y, side, int(used.sum()))
    return Model(keys[used], weights, offset)


def _matrix(keys: np.ndarray, values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64), n
    place = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    hit = keys[place] == values
    return rows[hit], place[hit], n


def _difference(gone, come, weight: np.ndarray, strength: float):
    """(rows, columns, number of rows, values) of what swapping changes, scaled so that half the sum of squares is
    the penalty."""
    rows = np.concatenate([gone[0], come[0]])
    size = np.sqrt(2 * strength * weight)
    values = np.concatenate([-size[gone[0]], size[come[0]]])
    return rows, np.concatenate([gone[1], come[1]]), len(weight), values


def _times(m, w: np.ndarray) -> np.ndarray:
    values = w[m[1]] if len(m) == 3 else w[m[1]] * m[3]
    return np.bincount(m[0], values, m[2]) if len(m[0]) else np.zeros(m[2])


def _back(m, r: np.ndarray, width: int) -> np.ndarray:
    values = r[m[0]] if len(m) == 3 else r[m[0]] * m[3]
    return np.bincount(m[1], values, width) if len(m[0]) else np.zeros(width)


def _slope(x, swapped, y, side, weights, offset) -> tuple[np.ndarray, float, np.ndarray]:
    """Gradient by weights and offset of the smooth loss, and the scores."""
    p = 1 / (1 + np.exp(-np.clip(_times(x, weights) + offset, -40, 40)))
    error = side * (p - y)
    gradient = _back(x, error, len(weights))
    for d in swapped:
        gradient = gradient + _back(d, _times(d, weights), len(weights))
    return gradient, float(error.sum()), p


def _pick(x, swapped, y, side, width: int) -> np.ndarray:
    """Weights under the penalty on absolute weights, by proximal steps whose momentum starts anew when it points
    uphill, until no weight would change."""
    weights, offset = np.zeros(width), 0.0
    ahead, ahead_offset, t = weights, offset, 1.0
    step = 1 / max(0.25 * _top(x, side, width) + sum(_top_of(d, width) for d in swapped), 1e-9)
    for _ in range(STEPS):
        gradient, by_offset, _ = _slope(x, swapped, y, side, ahead, ahead_offset)
        new = ahead - step * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
        new_offset = ahead_offset - step * by_offset
        moved = max(np.abs(new - ahead).max(initial=0.0), abs(new_offset - ahead_offset))
        if ((ahead - new) * (new - weights)).sum() + (ahead_offset - new_offset) * (new_offset - offset) > 0:
            t = 1.0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        push = (t - 1) / t_new
        ahead, ahead_offset = new + push * (new - weights), new_offset + push * (new_offset - offset)
        weights, offset, t = new, new_offset, t_new
        if moved <= SETTLED * step:
            break
    return weights


def _fit_picked(x, swapped, y, side, width: int) -> tuple[np.ndarray, float]:
    """Weights and offset of the smooth loss with a penalty on squares, by Newton steps on the few words picked,
    halved while they do not lower it."""
    dense = np.zeros((len(y), width + 1))
    dense[x[0], x[1]] = 1
    dense[:, width] = 1
    fixed = np.diag(np.append(np.full(width, L2), 1e-12))
    for d in swapped:
        m = np.zeros((d[2], width + 1))
        np.add.at(m, (d[0], d[1]), d[3])
        fixed += m.T @ m

    def loss(w: np.ndarray) -> float:
        z = dense @ w
        return float((side * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * w @ fixed @ w)

    w, now = np.zeros(width + 1), np.inf
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-np.clip(dense @ w, -40, 40)))
        gradient = dense.T @ (side * (p - y)) + fixed @ w
        if np.abs(gradient).max() <= SETTLED * 1e-3:
            break
        hessian = dense.T @ (dense * (side * p * (1 - p))[:, None]) + fixed
        move = np.linalg.solve(hessian + 1e-12 * np.eye(width + 1), gradient)
        now, size = loss(w), 1.0
        while loss(w - size * move) > now and size > 1e-6:
            size /= 2
        w = w - size * move
    return w[:width], float(w[width])


def _top(x, side, width: int) -> float:
    """The largest eigenvalue of the weighted Gram matrix with the offset, by power steps."""
    v, c, value = np.full(width, 1.0), 1.0, 1.0
    for _ in range(20):
        r = side * (_times(x, v) + c)
        v, c = _back(x, r, width), float(r.sum())
        value = float(np.sqrt((v * v).sum() + c * c))
        if value == 0:
            return 1.0
        v, c = v / value, c / value
    return 1.1 * value


def _top_of(d, width: int) -> float:
    """A bound of the largest eigenvalue of a sparse matrix' Gram matrix: row sum times column sum."""
    if not len(d[0]):
        return 0.0
    size = np.abs(d[3])
    return float(np.bincount(d[0], size, d[2]).max() * np.bincount(d[1], size, width).max())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = sample(docs, labels, id_col, text_col).mapInArrow(_bags, "toxic int, bag binary").collect()
    counts = class_counts(labels, id_col)
    bags = [np.frombuffer(r["bag"], U64) for r in rows]
    return fit(bags, [r["toxic"] for r in rows], swaps(), counts, template_pairs())


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id_col, held_out, score, predicted.

    Labels come from rows whose crc32 of the id modulo 4 is not 2, and only the text is an input. A null text
    scores as an empty one, which has the score of a text without telling words. Rows that repeat an id get a
    score each; a null id is not held out. While one of the classes has no label all scores are UNKNOWN. An
    empty table gives an empty table. Other columns are not looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(model.value.scores(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
