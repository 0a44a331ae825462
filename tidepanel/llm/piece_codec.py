"""SentencePiece encoding and decoding by Viterbi over shared prefixes.

A text with its spaces marked falls apart into marked words that no piece spans. The distinct new words of a
run of texts are sorted, which lays them out as a trie, and the trie is walked depth-first: the forward table
over a common prefix is kept on a stack and used by every word below it.

The lattice of a merge model allows a piece after another only when merging their joined text by the
model's scores gives these two pieces again. Under that transition rule exactly one path reaches each
position (an encoding by merges is one whose neighbours all pass that test), so the forward table holds
one piece a position, and following it back from a word's end gives the pieces that merging would give.
Scores enter in the test of neighbours; adding them along paths would pick other pieces than the model.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of texts whose words are looked up together, and whose pieces are spelled out together. A longer text
#: is taken alone.
CHUNK_BYTES, SPELL_BYTES = 3 << 20, 1 << 19
#: Bytes of words and pieces that a task remembers, and neighbours of pieces that a worker does.
REMEMBERED_BYTES, NEIGHBOURS = 8 << 20, 400_000

_CHUNKS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


@dataclass
class Vocabulary:
    """Pieces by text with their ids and scores, the ids of single bytes, and each id's bytes."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    unknown: int
    spelled: list[bytes]
    _alone: dict[str, bool] = field(default_factory=dict)
    _beside: dict[str, dict[str, bool]] = field(default_factory=dict)
    _neighbours: int = 0
    _lengths: dict[str, tuple[int, ...]] = field(default_factory=dict)
    _own: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        lengths: dict[str, set[int]] = {}
        for piece in self.ids:
            lengths.setdefault(piece[-1], {1}).add(len(piece))
        self._lengths = {c: tuple(sorted(x, reverse=True)) for c, x in lengths.items()}
        self._own = {piece: piece for piece in self.ids}
        self.line_alone = not any("\n" in p and len(p) > 1 for p in self.ids)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best pair, the leftmost of equals, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def alone(self, piece: str) -> bool:
        """Whether merging can make the piece."""
        known = self._alone.get(piece)
        if known is None:
            known = self._alone[piece] = self.merged(piece) == [piece]
        return known

    def beside(self, left: str) -> dict[str, bool]:
        return self._beside.setdefault(left, {})

    def follows(self, left: str, right: str) -> bool:
        """Whether merging leaves the two pieces side by side; asked once, then found in ``beside(left)``."""
        if self._neighbours >= NEIGHBOURS:
            self._beside.clear()
            self._neighbours = 0
        self._neighbours += 1
        fits = self.beside(left)[right] = self.merged(left + right) == [left, right]
        return fits

    def piece_ids(self, piece: str) -> list[int]:
        known = self.ids.get(piece)
        if known is not None:
            return [known]
        if self.byte_ids:
            return [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unknown]


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a SentencePiece merge model without text normalisation."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids, scores, byte_ids, spelled = {}, {}, {}, []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            spelled.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            spelled.append(b"")
        else:
            ids[piece], scores[piece] = i, model.get_score(i)
            spelled.append(piece.replace(MARK, " ").encode())
    return Vocabulary(ids, scores, [byte_ids[b] for b in range(256)] if byte_ids else [], model.unk_id(), spelled)


def encoded(vocabulary: Vocabulary, distinct: Sequence[str]) -> Iterator[tuple[str, list[int]]]:
    """Each word with its ids, in the words' order; ``distinct`` words need not be in order."""
    before, last = "", [""]  # last[i]: the piece that ends the encoding of the first i characters
    lengths, own, beside, ids = vocabulary._lengths, vocabulary._own, vocabulary.beside, vocabulary.ids
    for word in sorted(distinct):
        n = min(len(word), len(before))
        shared = n if word[:n] == before[:n] else _common(word, before)
        del last[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            for k in lengths.get(word[end - 1], (1,)):
                if k > end:
                    continue
                piece = own.get(word[end - k : end])
                if piece is None:
                    if k > 1:
                        continue
                    piece = word[end - 1]
                left = last[end - k]
                if left:
                    fits = beside(left).get(piece)
                    if fits is None:
                        fits = vocabulary.follows(left, piece)
                else:
                    fits = vocabulary.alone(piece)
                if fits:
                    break
            else:
                raise ValueError(f"no path to position {end} of {word!r}")
            last.append(piece)
        pieces, at = [], len(word)
        while at:
            pieces.append(last[at])
            at -= len(last[at])
        pieces.reverse()
        try:
            yield word, [ids[p] for p in pieces]
        except KeyError:
            yield word, [i for p in pieces for i in vocabulary.piece_ids(p)]
        before = word


def _common(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Encoder:
    """Encodes columns of texts, and remembers the words it has met last: as one Arrow array, with the ids
    of all of them one after another and where each word's ids end."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat, self.ends = pa.array([], pa.string()), np.empty(0, np.int32), np.zeros(1, np.int64)

    def _places(self, distinct: pa.Array) -> np.ndarray:
        """Where the words are among the known ones, to which the new ones are added."""
        places = pc.index_in(distinct, value_set=self.known)
        if places.null_count:
            words, flat, sizes = [], array("i"), array("q")
            for word, ids in encoded(self.vocabulary, distinct.filter(pc.is_null(places)).to_pylist()):
                words.append(word)
                flat.fromlist(ids)
                sizes.append(len(ids))
            self.known = pa.concat_arrays([self.known, pa.array(words, pa.string())])
            self.flat = np.concatenate([self.flat, np.frombuffer(flat, np.int32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.frombuffer(sizes, np.int64))])
            places = pc.index_in(distinct, value_set=self.known)
        return places.to_numpy(zero_copy_only=False)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words of all texts one after another, how many each text has), until the next call."""
        if self.known.nbytes + self.flat.nbytes + self.ends.nbytes > REMEMBERED_BYTES:
            self._forget()
        texts = texts.fill_null("") if texts.null_count else texts
        odd = pc.or_(pc.match_substring_regex(texts, f"^ |  |\x01|{MARK}"), pc.equal(texts, ""))
        if not self.vocabulary.line_alone:
            odd = pa.array([True] * len(texts))
        odd = odd.to_numpy(zero_copy_only=False)
        # Texts in which every space ends a word: cut by Arrow; a line feed is a word's first character.
        lists = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \x01"), " ")
        counts = np.zeros(len(texts), np.int64)
        counts[~odd] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        cut = pc.list_flatten(lists).dictionary_encode()
        del lists
        marked = pc.binary_join_element_wise(pa.scalar(MARK), cut.dictionary, pa.scalar(""))
        plain = self._places(pc.replace_substring_regex(marked, f"^{MARK}\x01", "\n"))[cut.indices.to_numpy(zero_copy_only=False)]
        if not odd.any():
            return plain, counts
        lists = [_CHUNKS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
        counts[odd] = [len(x) for x in lists]
        cut = pa.array([w for x in lists for w in x], pa.string()).dictionary_encode()
        del lists
        out, mine = np.empty(int(counts.sum()), plain.dtype), np.repeat(odd, counts)
        out[~mine], out[mine] = plain, self._places(cut.dictionary)[cut.indices.to_numpy(zero_copy_only=False)]
        return out, counts

    def spell(self, places: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by their places, and how many of them each text has."""
        starts = self.ends[places]
        each = self.ends[places + 1] - starts
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(starts - (ends - each), each) + np.arange(total)
        bounds = np.append(0, ends)[np.append(0, np.cumsum(per_text))]
        return self.flat[at], np.diff(bounds)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each text has)."""
        return self.spell(*self.words(texts))


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Start and end of runs of rows whose sizes add up to ``most`` at most, or that are one row."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, end
        start = end


def decode_column(spelled: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The texts of ids, as bytes: pieces spelled out and joined, without the first mark's space."""
    offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int64())
    lists = pa.LargeListArray.from_arrays(offsets, spelled.take(pa.array(ids)).cast(pa.large_binary()))
    joined = pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))
    return pc.if_else(pc.equal(pa.array(counts), 0), pa.scalar(b"", pa.large_binary()), joined)


def _without_first(joined: pa.Array) -> list[bytes]:
    return [b[1:] if b[:1] == b" " else b for b in joined.to_pylist()]


def _spelled_out(rows: pa.RecordBatch, ids: np.ndarray, counts: np.ndarray, spelled: pa.Array) -> pa.RecordBatch:
    given = pc.fill_null(rows.column(1), "").cast(pa.large_binary())
    again = decode_column(spelled, ids, counts)
    wanted = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), given, pa.scalar(b"", pa.large_binary()))
    same = pc.if_else(pc.equal(pa.array(counts), 0), pc.equal(given, pa.scalar(b"", pa.large_binary())), pc.equal(again, wanted))
    pieces = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids))
    return pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts), pieces, same], names=["id", "n_pieces", "pieces", "round_trip"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Per row of ``docs``: id_col, n_pieces, pieces, round_trip.

    ``pieces`` are the ids that the model's own library gives, ``round_trip`` whether they decode to the
    text again: true for every text without the mark character U+2581, which stands for a space. A null
    text has no pieces, like an empty one. Rows that repeat an id are encoded each; an empty table gives an
    empty table. Other columns are not looked at.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        spelled = pa.array(vocabulary.value.spelled, pa.binary())
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            for start, end in runs(sizes, CHUNK_BYTES):
                places, counts = encoder.words(batch.column(1).slice(start, end - start))
                ends = np.append(0, np.cumsum(counts))
                for a, b in runs(sizes[start:end], SPELL_BYTES):
                    part = batch.slice(start + a, b - a)
                    yield _spelled_out(part, *encoder.spell(places[ends[a] : ends[b]], counts[a:b]), spelled)
                places = part = None
                pa.default_memory_pool().release_unused()
            batch = None  # before the next one comes

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_pieces long, pieces array<int>, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode(docs: DataFrame, id_col: str = "doc_id", pieces_col: str = "pieces", model: str = MODEL) -> DataFrame:
    """Per row: id_col and ``text``, the inverse of :func:`encode`. Null pieces give the empty text; bytes
    that are no UTF-8 are replaced as Python's decoder does."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = pa.array(vocabulary.value.spelled, pa.binary())
        for batch in batches:
            counts = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            ids = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False)
            texts = [b.decode("utf-8", "replace") for b in _without_first(decode_column(spelled, ids, counts.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(pieces_col).alias("pieces"))
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
