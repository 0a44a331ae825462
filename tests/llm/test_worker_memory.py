"""What the Python steps of the pipeline hold at once does not follow the rows that Spark puts into a batch."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from tidepanel.llm import ngram_join, piece_codec


@pytest.fixture(scope="module")
def batch():
    """5,000 texts of about 3,000 characters, as Spark hands them over, from 200,000 words."""
    rng = random.Random(3)
    known = ["".join(rng.choice("aeioustnrlé") for _ in range(rng.randint(2, 9))) for _ in range(200_000)]
    texts = [" ".join(rng.choices(known, k=450)) for _ in range(5000)]
    return pa.RecordBatch.from_arrays([pa.array(range(5000), pa.int64()), pa.array(texts)], names=["id", "text"])


def most_held(step, batch) -> tuple[float, int]:
    """(MB that Python and numpy held at once, rows given out)."""
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in step(iter([batch])))
        return tracemalloc.get_traced_memory()[1] / 1e6, rows
    finally:
        tracemalloc.stop()


def steps_of(monkeypatch, work, docs):
    """The functions that ``work`` gives to mapInArrow."""
    taken = []
    with monkeypatch.context() as m:
        m.setattr(type(docs), "mapInArrow", lambda self, f, schema: taken.append(f) or self)
        work(docs.selectExpr("id", "text"))
    return taken


def test_encoding_holds_little(spark, monkeypatch, batch):
    docs = spark.createDataFrame([(1, "a")], "id long, text string")
    [step] = steps_of(monkeypatch, lambda d: piece_codec.encode(d, "id"), docs)
    held, rows = most_held(step, batch.slice(0, 2500))
    assert rows == 2500 and held < 80


def test_prefixes_hold_little(batch):
    class ranks:
        value = np.arange(1 << ngram_join.COUNT_BITS, dtype=np.uint32)

    held, rows = most_held(ngram_join._prefixes(ranks, 8), batch.select(["text"]))
    assert rows and held < 40


def test_runs_and_what_is_forgotten_change_no_pieces(spark, monkeypatch):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=piece_codec.MODEL)
    rng = random.Random(7)
    texts = ["", None, " ", "\n\n a\n", "x\x01y", "▁", "b  c ", "a" * 300]
    texts += ["".join(rng.choice("aabcdeth \n.é執😀1") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    docs = spark.createDataFrame([(1, "a")], "id long, text string")
    [step] = steps_of(monkeypatch, lambda d: piece_codec.encode(d, "id"), docs)
    for name, value in {"CHUNK_BYTES": 700, "SPELL_BYTES": 90, "REMEMBERED_BYTES": 2000, "NEIGHBOURS": 9}.items():
        monkeypatch.setattr(piece_codec, name, value)
    got = [r for out in step(iter([batch.slice(0, 0), batch, batch.slice(5)])) for r in out.to_pylist()]
    assert [r["id"] for r in got] == [*range(len(texts)), *range(5, len(texts))]
    for r in got:
        text = texts[r["id"]] or ""
        assert r["pieces"] == library.encode(text) and r["n_pieces"] == len(r["pieces"]) and r["round_trip"] == ("▁" not in text)
