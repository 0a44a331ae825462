"""Secrets by a linear-chain conditional random field.

Fixed forms (assignments to telling names, access keys, long hex) are found everywhere in a text. Beyond them a
conditional random field tags tokens as beginning, inside or outside of a secret from their shape, their
neighbours and features of the whole file, and Viterbi decoding gives the best tag sequence. The field is
fitted on windows of a bounded sample of rows in which the fixed forms are the secrets.

A secret can begin only at a token of eight or more characters with both letters and digits, and goes on only
through tokens glued to it; all others are outside under these constraints. So the decoding of a text is that
of the windows around such tokens, and only they are decoded.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import settle

KINDS = ("assign", "access", "hex", "tagged")
ASSIGN, ACCESS, HEX, TAGGED = range(4)
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
# A run that is too short fails from all its positions, so only runs of the length needed are matched.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]+|[^\sA-Za-z0-9+/_-]")
_CHUNK = re.compile(r"\S+")
_NOT_WHITE_CHUNK = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
MIN_TOKEN = 8
#: Chunks between white space on either side of a suspicious token that give its window, and the characters
#: looked through for them.
SIDE, REACH = 3, 160
#: Rows looked through for fitting, and windows used of them.
SAMPLE_ROWS, SAMPLE_WINDOWS = 12_000, 4_000
FEATURE_BITS, L2, STEPS, RATE = 15, 1e-3, 120, 0.1
#: Tokens of a window used for fitting; decoding takes whole windows.
FIT_TOKENS = 48
O, B, I = range(3)
FORBIDDEN = -1e4


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed forms, by start and kind."""
    low = text.lower()
    spans = []
    if any(n in low for n in _NAMES):
        spans += [(ASSIGN, *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(ACCESS, *m.span()) for m in _ACCESS.finditer(text)]
    spans += [(HEX, *m.span()) for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], s[0]))


def suspicious(token: str) -> bool:
    return len(token) >= MIN_TOKEN and any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def windows(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches around suspicious tokens, apart from each other."""
    open_ = None
    done = 0
    for m in _DIGIT.finditer(text):
        if m.start() < done:
            continue
        start, end = m.span()
        while start > done and text[start - 1] in _NOT_WHITE_CHUNK:
            start -= 1
        while end < len(text) and text[end] in _NOT_WHITE_CHUNK:
            end += 1
        done = end
        if not suspicious(text[start:end]):
            continue
        before = [c.start() for c in _CHUNK.finditer(text, max(0, start - REACH), start)][-SIDE:]
        after = [c.end() for _, c in zip(range(SIDE), _CHUNK.finditer(text, end, min(len(text), end + REACH)))]
        low, high = (before or [start])[0], (after or [end])[-1]
        if open_ and low <= open_[1]:
            open_ = (open_[0], max(open_[1], high))
        else:
            if open_:
                yield open_
            open_ = (low, high)
    if open_:
        yield open_


def _bucket(x: float) -> int:
    return int(math.log2(1 + x))


def file_features(text: str) -> list[str]:
    """What the whole file looks like: how dense signs of code are, and how long lines are."""
    n = max(1, len(text))
    return [
        f"file.code={_bucket(1000 * sum(text.count(c) for c in '={};') / n)}",
        f"file.lines={_bucket(1000 * text.count(chr(10)) / n)}",
    ]


def _shape(token: str) -> str:
    """Runs of upper case, lower case, digits and other signs, short."""
    out = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", token))
    return re.sub(r"[0-9]+", "0", out)[:12]


def _class(token: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", token):
        return "hex"
    kinds = (any(c.islower() for c in token), any(c.isupper() for c in token), any(c.isdigit() for c in token), any(c in "+/_-" for c in token))
    return "".join(c if k else "" for c, k in zip("aA0+", kinds))


def tokens(text: str, start: int, end: int) -> list[tuple[int, int, str, bool]]:
    """(start, end, token, glued to the one before) of a window."""
    out, last = [], -1
    for m in _TOKEN.finditer(text, start, end):
        out.append((m.start(), m.end(), m[0], m.start() == last))
        last = m.end()
    return out


def features(items: Sequence[tuple[int, int, str, bool]], file: Sequence[str]) -> list[list[int]]:
    """Hashed features of each token."""
    low = [t[2].lower() for t in items]
    out = []
    for i, (_, _, token, glued) in enumerate(items):
        at = lambda k, i=i: low[i + k] if 0 <= i + k < len(low) else ""
        names = [
            "bias",
            f"class={_class(token)}",
            f"length={_bucket(len(token))}",
            f"variety={min(8, len(set(token)) * 8 // max(1, len(token)))}/{_bucket(len(token))}",
            f"shape={_shape(token)}",
            f"start={token[:4]}",
            f"before={at(-1)}",
            f"before2={at(-2)} {at(-1)}",
            f"after={at(1)}",
            f"glued={glued}",
            "named=" + next((n for k in (-1, -2, -3, -4, -5) for n in ("pass", "secret", "token", "key", "auth") if n in at(k)), ""),
            f"assigned={any(at(k) in (':', '=') for k in (-1, -2))}",
            *(f"{f}/{_class(token)}" for f in file),
        ]
        out.append([zlib.crc32(n.encode("utf-8", "surrogatepass")) & ((1 << FEATURE_BITS) - 1) for n in names])
    return out


N_FEATURES = 14


@dataclass(frozen=True)
class Field:
    """Weights of features by tag, and of tag pairs."""

    weights: np.ndarray
    pairs: np.ndarray

    def tags(self, items, file) -> list[int]:
        """The best tags of a window, by Viterbi."""
        allowed = permitted(items)
        scores = self.weights[np.array(features(items, file))].sum(1) + allowed
        best, back = scores[0], []
        for row in scores[1:]:
            reach = best[:, None] + self.pairs
            back.append(reach.argmax(0))
            best = reach.max(0) + row
        tag = int(best.argmax())
        out = [tag]
        for choice in reversed(back):
            tag = int(choice[tag])
            out.append(tag)
        return out[::-1]

    def secrets(self, text: str) -> list[tuple[int, int]]:
        """Spans tagged as secrets in a text."""
        found, file = [], None
        for start, end in windows(text):
            file = file or file_features(text)
            items = tokens(text, start, end)
            for (s, e, _, _), tag in zip(items, self.tags(items, file)):
                if tag == B:
                    found.append([s, e])
                elif tag == I:
                    found[-1][1] = e
        return [(s, e) for s, e in found]


def permitted(items) -> np.ndarray:
    """0 for tags that a token may have, else a large loss."""
    out = np.zeros((len(items), 3))
    for i, (_, _, token, glued) in enumerate(items):
        if not suspicious(token):
            out[i, B] = FORBIDDEN
        if not glued:
            out[i, I] = FORBIDDEN
    return out


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with their features, constraints and tags by the fixed forms."""
    for batch in batches:
        keys, rows = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            spans, file = None, None
            for start, end in windows(text):
                spans = base_spans(text) if spans is None else spans
                file = file or file_features(text)
                items = tokens(text, start, end)[:FIT_TOKENS]
                tags = _tags(items, spans)
                if _unclear(items, tags):
                    continue
                record = np.zeros((len(items), N_FEATURES + 3), np.int32)
                record[:, :N_FEATURES] = features(items, file)
                record[:, N_FEATURES] = tags
                record[:, N_FEATURES + 1] = [suspicious(t[2]) for t in items]
                record[:, N_FEATURES + 2] = [t[3] for t in items]
                keys.append(key)
                rows.append(record.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows, pa.binary())], names=["id", "window"])


def _tags(items, spans) -> list[int]:
    """Tags by the spans: a secret is the suspicious token in one and what is glued to it there."""
    out = [O] * len(items)
    inside = False
    for i, (s, e, token, glued) in enumerate(items):
        covered = any(a <= s and e <= b for _, a, b in spans)
        if covered and inside and glued:
            out[i] = I
        elif covered and suspicious(token):
            out[i], inside = B, True
        else:
            inside = False
    return out


def _unclear(items, tags) -> bool:
    """Whether a window assigns a suspicious token that no fixed form covers: it may be a secret of a kind not
    known yet, so it is no example of what is none."""
    return any(
        t == O and suspicious(items[i][2]) and any(items[k][2] in (":", "=") for k in range(max(0, i - 2), i))
        for i, t in enumerate(tags)
    )


def fit(records: Sequence[np.ndarray]) -> Field:
    """Maximum likelihood with a penalty on squared weights, by adaptive gradient steps."""
    size = 1 << FEATURE_BITS
    weights, pairs = np.zeros((size, 3)), np.zeros((3, 3))
    barred = np.zeros((3, 3))
    barred[O, I] = FORBIDDEN
    weights[zlib.crc32(b"bias") & (size - 1)] = (1.0, -1.0, 0.0)
    if not records:
        return Field(weights, pairs + barred)
    n, length = len(records), max(len(r) for r in records)
    index = np.zeros((n, length, N_FEATURES), np.int64)
    tags, real = np.zeros((n, length), np.int64), np.zeros((n, length), bool)
    allowed = np.zeros((n, length, 3))
    for i, r in enumerate(records):
        k = len(r)
        index[i, :k], tags[i, :k], real[i, :k] = r[:, :N_FEATURES], r[:, N_FEATURES], True
        allowed[i, :k, B] = np.where(r[:, N_FEATURES + 1], 0, FORBIDDEN)
        allowed[i, :k, I] = np.where(r[:, N_FEATURES + 2], 0, FORBIDDEN)
    allowed[~real] = (0, FORBIDDEN, FORBIDDEN)
    flat = index[real].ravel()
    observed = np.stack([np.bincount(flat, np.repeat(tags[real] == t, N_FEATURES), size) for t in range(3)], 1)
    both = real[:, 1:]
    pair_of = tags[:, :-1] * 3 + tags[:, 1:]
    observed_pairs = np.bincount(pair_of[both], minlength=9).reshape(3, 3)
    squares, pair_squares = np.full((size, 3), 1e-6), np.full((3, 3), 1e-6)
    start = weights.copy()
    for _ in range(STEPS):
        scores = weights[index].sum(2) + allowed
        one, two = _marginals(scores, pairs + barred, real)
        expected = np.stack([np.bincount(flat, np.repeat(one[real][:, t], N_FEATURES), size) for t in range(3)], 1)
        gradient = (expected - observed) / n + L2 * (weights - start)
        pair_gradient = (two - observed_pairs) / n + L2 * pairs
        squares += gradient**2
        pair_squares += pair_gradient**2
        weights -= RATE * gradient / np.sqrt(squares)
        pairs -= RATE * pair_gradient / np.sqrt(pair_squares)
    return Field(weights, pairs + barred)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _marginals(scores: np.ndarray, pairs: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of tags at each token, and expected tag pairs, forward and backward."""
    n, length, _ = scores.shape
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0]
    for t in range(1, length):
        forward[:, t] = scores[:, t] + _log_sum(forward[:, t - 1, :, None] + pairs, 1)
    for t in range(length - 2, -1, -1):
        backward[:, t] = _log_sum(pairs + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
    whole = _log_sum(forward[:, -1], 1)
    one = np.exp(forward + backward - whole[:, None, None])
    two = np.zeros((3, 3))
    for t in range(length - 1):
        edge = forward[:, t, :, None] + pairs + (scores[:, t + 1] + backward[:, t + 1])[:, None, :] - whole[:, None, None]
        two += (np.exp(edge) * real[:, t + 1, None, None]).sum(0)
    return one, two


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """The field from at most SAMPLE_WINDOWS windows of the SAMPLE_ROWS rows of the smallest id hashes."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = F.xxhash64("id")
    chosen = settle(rows.select("id").where("id is not null").distinct().orderBy(order, "id").limit(SAMPLE_ROWS), "secret-sample")
    found = rows.join(F.broadcast(chosen), "id").mapInArrow(_examples, "id long, window binary")
    taken = found.orderBy(F.xxhash64("id", "window"), "window").limit(SAMPLE_WINDOWS).collect()
    return fit([np.frombuffer(r["window"], np.int32).reshape(-1, N_FEATURES + 3) for r in taken])


SPANS = "array<struct<start:int,kind:int,end:int>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id_col, base and spans, arrays of (start, kind, end) by start and kind, in code
    points, end exclusive; ``spans`` holds also what the field adds, which overlaps no fixed form.

    A null text has no span. Rows that repeat an id each get their spans. An empty table gives an empty table,
    and a table without fixed forms a field that tags nothing. Other columns are not looked at.
    """
    field = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans = [], []
            for text in batch.column(1).to_pylist():
                fixed = base_spans(text) if text else []
                more = [] if not text else [
                    (TAGGED, s, e) for s, e in field.value.secrets(text) if not any(a < e and s < b for _, a, b in fixed)
                ]
                base.append([{"start": s, "kind": k, "end": e} for k, s, e in fixed])
                both = sorted([*fixed, *more], key=lambda x: (x[1], x[0]))
                spans.append([{"start": s, "kind": k, "end": e} for k, s, e in both])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, kind), pa.array(spans, kind)], names=["id", "base", "spans"]
            )

    id_kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_kind}, base {SPANS}, spans {SPANS}").withColumnRenamed("id", id_col)


def spelled(spans: str):
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
