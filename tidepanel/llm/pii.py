"""Personal data by bootstrapped contextual extraction.

Fixed forms (mail and IP addresses, cards, phones) are found everywhere in a text and are the seeds. The words
beside a seed make lexical patterns: one word before, two words before, one word after. Other tokens shaped
like identifiers are instances of the patterns beside them. Spark scores this graph of patterns and
instances in rounds: a pattern is as sure as the share of all its occurrences in the corpus that stand
beside known instances, an instance as sure as its patterns together make it. Instances that end above the
threshold are added; seeds always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import words
from tidepanel.llm.common import how_many, settle

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its first digit only: a later start would fail the same way.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]{3,}")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._/@+-")

#: An identifier has at least so many characters and digits.
MIN_LENGTH, MIN_DIGITS = 6, 4
#: Characters of context read on either side; a word longer than that makes no pattern.
REACH = 120
#: A pattern counts from so many documents with known instances on; SMOOTH occurrences speak against each.
MIN_DOCUMENTS, SMOOTH = 3, 2.0
#: Patterns and instances are taken as sure from here on.
SURE = 0.6
ROUNDS = 3
#: Bits of the table of context hashes that are counted over the corpus; a full table only sends counts
#: that no pattern asks for.
COUNT_BITS = 24

#: What parts words of contexts: white space and punctuation that stands between a label and its value.
BETWEEN = words.WHITE.copy()
BETWEEN[[ord(c) for c in ":=#()[]<>\"'"]] = True
U64 = np.uint64
_SALTS = [U64(x) for x in (0x1B873593CC9E2D51, 0x38B34AE5A1E38B93, 0x52DCE729E6546B64)]
BEFORE, BEFORE_TWO, AFTER = range(3)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each @ with the longest run of local characters before it."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed forms, by kind and start."""
    spans = [(EMAIL, s, e) for s, e in emails(text)]
    spans += [(IP, *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append((CARD, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                spans.append((PHONE, *m.span()))
    return spans


def identifiers(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens shaped like identifiers that touch no span of ``taken``."""
    done = 0
    spans = sorted((s, e) for _, s, e in taken)
    k = 0
    for m in _DIGITS.finditer(text):
        if m.start() < done:
            continue
        start, end = m.span()
        while start > done and text[start - 1] in _TOKEN:
            start -= 1
        while end < len(text) and text[end] in _TOKEN:
            end += 1
        done = end
        while start < end and not text[start].isalnum():
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        if k < len(spans) and spans[k][0] < end:
            continue
        if end - start >= MIN_LENGTH and sum(c.isdigit() for c in text[start:end]) >= MIN_DIGITS:
            yield start, end


def _hashes(piece: str) -> list[int]:
    data = np.frombuffer(piece.encode("utf-8", "surrogatepass"), np.uint8)
    return words.word_hashes(data, words.LOWER, BETWEEN).tolist()


def _pattern(kind: int, *hashes: np.ndarray) -> np.ndarray:
    total = hashes[0]
    for h in hashes[1:]:
        total = words.mix(total) + h
    return words.mix(total ^ _SALTS[kind])


def context(text: str, start: int, end: int) -> list[int]:
    """The patterns beside a span, as signed hashes."""
    low, high = max(0, start - REACH), min(len(text), end + REACH)
    before, after = _hashes(text[low:start]), _hashes(text[end:high])
    if low > 0:
        before = before[1:]  # the first word may be cut
    if high < len(text):
        after = after[:-1]
    found = []
    as_array = lambda x: np.array([x], U64)
    if before:
        found.append(_pattern(BEFORE, as_array(before[-1])))
    if len(before) > 1:
        found.append(_pattern(BEFORE_TWO, as_array(before[-2]), as_array(before[-1])))
    if after:
        found.append(_pattern(AFTER, as_array(after[0])))
    return [int(x.astype(np.int64)[0]) for x in found]


SPAN = "struct<kind:int,start:int,end:int>"
FOUND = "struct<kind:int,start:int,end:int,form:string,patterns:array<bigint>>"
ROW = f"id long, spans array<{SPAN}>, found array<{FOUND}>"
_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("form", pa.string()), ("patterns", pa.list_(pa.int64()))]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, found = [], []
        for text in batch.column(1).to_pylist():
            base = base_spans(text) if text else []
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
            more = [(-1, s, e) for s, e in identifiers(text, base)] if text else []
            found.append([
                {"kind": k, "start": s, "end": e, "form": text[s:e].lower(), "patterns": context(text, s, e)}
                for k, s, e in [*base, *more]
            ])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(spans, _SPAN), pa.array(found, _FOUND)], names=["id", "spans", "found"]
        )


def _count_contexts(bits):
    """(pattern, n) for the contexts of all words of a batch whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8)
        for part in (p for batch in batches for p in words.slices(batch.column(0))):
            hashes, counts = words.words(part, words.LOWER, BETWEEN)
            first = np.zeros(len(hashes), bool)
            starts = np.cumsum(counts) - counts
            first[starts[counts > 0]] = True
            seen = [_pattern(BEFORE, hashes), _pattern(AFTER, hashes)]
            if len(hashes) > 1:
                seen.append(_pattern(BEFORE_TWO, hashes[:-1], hashes[1:])[~first[1:]])
            keys = np.concatenate(seen)
            slot = (keys & U64((1 << COUNT_BITS) - 1)).astype(np.int64)
            keys = keys[(table[slot >> 3] >> (slot & 7) & 1).astype(bool)]
            names, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(n)], names=["pattern", "n"])

    return run


def _totals(spark: SparkSession, texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often each of ``patterns`` stands in the corpus, beside anything."""
    slot = (F.col("pattern").bitwiseAND(F.lit((1 << COUNT_BITS) - 1)) + 1).alias("slot")
    marks = patterns.select(slot).groupBy(F.bitmap_bucket_number("slot").alias("k"))
    table = bytearray(1 << (COUNT_BITS - 3))
    for row in marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect():
        table[(row["k"] - 1) * 4096 : row["k"] * 4096] = row["bits"]  # COUNT_BITS bits in all
    bits = spark.sparkContext.broadcast(bytes(table))
    counted = texts.mapInArrow(_count_contexts(bits), "pattern long, n long")
    counted = counted.groupBy("pattern").agg(F.sum("n").alias("total"))
    return patterns.join(counted, "pattern", "left").select("pattern", F.coalesce("total", F.lit(0)).alias("total"))


def _added(spark: SparkSession, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(row, kind, start, end) of the instances that the rounds find."""
    each = rows.select("row", F.explode("found").alias("f")).select("row", "f.*")
    form = F.xxhash64("form").alias("form")
    edges = each.select("row", "kind", form, F.explode("patterns").alias("pattern"))
    edges = edges.groupBy("pattern", "kind", "form").agg(F.count("*").alias("n"), F.countDistinct("row").alias("docs"))
    edges = settle(edges, "pii-edges")
    seeds = edges.where("kind >= 0").groupBy("form", "kind").agg(F.lit(1.0).alias("score"))
    shared = edges.groupBy("pattern").agg(F.sum("docs").alias("docs"), F.max("kind").alias("any"))
    # Only patterns beside a seed and in enough documents can become sure, or ones reached through them.
    shared = shared.where(F.col("docs") >= MIN_DOCUMENTS)
    totals = settle(_totals(spark, texts, shared.select("pattern")), "pii-totals")
    known = settle(seeds, "pii-known")
    for _ in range(ROUNDS):
        beside = edges.select("pattern", "form", "n", "docs").join(known, "form")
        scored = beside.groupBy("pattern", "kind").agg(
            F.sum(F.col("n") * F.col("score")).alias("hits"), F.sum("docs").alias("docs")
        )
        scored = scored.where(F.col("docs") >= MIN_DOCUMENTS).join(totals, "pattern")
        sure = F.least(F.lit(0.999), F.col("hits") / (F.greatest("total", "hits") + SMOOTH))
        patterns = settle(scored.select("pattern", "kind", sure.alias("sure")).where(F.col("sure") >= SURE), "pii-patterns")
        reached = edges.where("kind < 0").select("pattern", "form").join(patterns, "pattern")
        reached = reached.groupBy("form", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("sure"))))).alias("score"))
        # An instance has one kind, the surest (the first listed of equals).
        best = reached.groupBy("form").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
        best = best.select("form", (-F.col("b.k")).alias("kind"), F.col("b.score").alias("score"))
        known = settle(seeds.select("form", "kind", "score").unionByName(best), "pii-known")
    new = known.where(F.col("score") < 1.0).select(F.col("form"), F.col("kind").alias("as_kind"))
    candidates = each.where("kind < 0").select("row", "start", "end", form)
    return candidates.join(new, "form").select("row", F.col("as_kind").alias("kind"), "start", "end")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id_col, n_email, n_ip, n_card, n_phone, base (the fixed forms' spans) and spans
    (with the added ones), arrays of (kind, start, end) by kind and start, in code points, end exclusive.

    The counts are of fixed forms. Added spans touch none of them. A null text has no span. Rows that repeat an
    id each get their spans, and count as documents of their own. An empty table gives an empty table. Other columns are
    not looked at.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = texts.mapInArrow(_scan, ROW).withColumn("row", F.monotonically_increasing_id())
    rows = settle(rows, "pii-rows")
    added = _added(docs.sparkSession, rows, texts.select("text"))
    added = added.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    out = rows.select("row", "id", "spans").join(settle(added, "pii-added"), "row", "left")
    more = F.coalesce("more", F.expr(f"cast(array() as array<{SPAN}>)"))
    counts = [how_many("spans", k).alias(f"n_{n}") for k, n in enumerate(KINDS)]
    return out.select(
        F.col("id").alias(id_col), *counts, F.col("spans").alias("base"), F.array_sort(F.concat("spans", more)).alias("spans")
    )


def spelled(spans: str):
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the text with every span replaced by its kind in brackets, spans that overlap as one.
    Ids must tell rows apart."""
    found = find(docs, id_col, text_col).select(id_col, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts, at = [], 0
                for s in sorted(spans or [], key=lambda x: x["start"]):
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"[{KINDS[s['kind']]}]"]
                    at = max(at, s["end"])
                out.append(None if text is None else "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "text"])

    joined = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text")).join(found, id_col)
    return joined.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
