"""Sharding by histogram sort.

Rows are ordered by (hash of the text, hash of the id), so equal texts stand together. Splitters between
shards are found without sorting: every round counts the exact bytes below candidate boundaries over all
rows, and lays new probes between the two boundaries that enclose a target, until a boundary is close
enough. Then rows are dealt to their shards in one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidepanel.llm.common import free_name, settle, whole_text

#: Bytes that a record has besides its text.
RECORD_BYTES = 8
#: Candidate boundaries laid into one interval in a round; a round halves an interval ten times.
PROBES = 1024
#: A boundary is good when the bytes below it are this near to the target, as a share of a mean shard.
TOLERANCE = 0.005
#: Both parts of a key are 62 bits, so that differences and sums of them fit a long.
KEY_BITS = 62
#: Rows that one task puts in order for their slots, on average.
SLOT_ROWS = 50_000


@dataclass(frozen=True)
class Interval:
    """Keys that may hold a boundary: hashes of texts, or of ids within the one text hash ``text``."""

    low: int
    high: int
    below: int
    text: int | None = None

    @property
    def step(self) -> int:
        return -(-(self.high - self.low + 1) // PROBES)

    @property
    def single(self) -> bool:
        return self.high == self.low


@dataclass(frozen=True)
class Splitter:
    """The first key of the next shard, and the bytes below it."""

    text: int
    row: int
    below: int


def text_key(text: str | Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(whole_text(text)), 64 - KEY_BITS)


def row_key(row_id: str | Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit("row"), row_id), 64 - KEY_BITS)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, h, d) per row, settled: all that the rounds read."""
    body = F.encode(whole_text(text_col), "UTF-8")
    out = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(whole_text(text_col)).cast("long") + RECORD_BYTES).alias("size"),
        F.crc32(body).alias("text_crc32"),
        text_key(text_col).alias("h"),
        row_key(id_col).alias("d"),
    )
    return settle(out, "shard-sizes")


def _histogram(keys: DataFrame, intervals: Sequence[Interval]) -> dict[tuple[int, int], int]:
    """Bytes in each step of each interval, over all rows: at most PROBES numbers an interval."""
    place = F.lit(None).cast("struct<i:int,k:long>")
    for i, iv in enumerate(intervals):
        key = F.col("h") if iv.text is None else F.col("d")
        here = key.between(F.lit(iv.low), F.lit(iv.high))
        if iv.text is not None:
            here = here & (F.col("h") == iv.text)
        step = F.floor((key - F.lit(iv.low)).cast("decimal(20,0)") / F.lit(iv.step).cast("decimal(20,0)"))
        if iv.step == 1:
            step = key - F.lit(iv.low)
        place = F.when(here, F.struct(F.lit(i).alias("i"), step.cast("long").alias("k"))).otherwise(place)
    counted = keys.select(place.alias("p"), "size").where("p is not null")
    rows = counted.groupBy("p.i", "p.k").agg(F.sum("size").alias("bytes")).collect()
    return {(r["i"], r["k"]): r["bytes"] for r in rows}


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[Splitter]:
    """``shards - 1`` boundaries that part the bytes of ``keys`` evenly.

    A boundary falls between two texts unless one text's rows weigh more than the tolerance and a target
    lies within them; these are then parted by the ids. What cannot be parted (one large row, or rows of one
    id and text) goes whole to the nearer side.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    allowed = tolerance * total / shards
    open_, found = {i: Interval(0, (1 << KEY_BITS) - 1, 0) for i in range(1, shards)}, {}
    while open_:
        intervals = list(dict.fromkeys(open_.values()))
        bytes_in = _histogram(keys, intervals)
        still = {}
        for i, iv in open_.items():
            k = intervals.index(iv)
            target = total * i / shards
            below, steps = iv.below, sorted(s for j, s in bytes_in if j == k)
            after, step = below, steps[-1] if steps else 0
            for step in steps:
                after = below + bytes_in[k, step]
                if after >= target:
                    break
                below = after
            low = iv.low + step * iv.step
            inner = Interval(low, min(iv.high, low + iv.step - 1), below, iv.text)
            near, far = target - below, after - target
            if min(near, far) <= allowed or (inner.single and inner.text is not None) or not steps:
                found[i] = _boundary(inner, below if near <= far else after, low_side=near <= far)
            elif inner.single:
                still[i] = Interval(0, (1 << KEY_BITS) - 1, below, inner.low)
            else:
                still[i] = inner
        open_ = still
    return [found[i] for i in sorted(found)]


def _boundary(iv: Interval, below: int, low_side: bool) -> Splitter:
    first = iv.low if low_side else iv.high + 1
    return Splitter(first, 0, below) if iv.text is None else Splitter(iv.text, first, below)


def shard_of(found: Sequence[Splitter]) -> Column:
    """How many splitters stand at or below a row's key."""
    past = [
        F.when((F.col("h") > s.text) | ((F.col("h") == s.text) & (F.col("d") >= s.row)), 1).otherwise(0)
        for s in found
    ]
    return reduce(lambda a, b: a + b, past, F.lit(0)).cast("int")


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id_col, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes plus RECORD_BYTES, null counting as empty. Shards are near equal in
    bytes: each boundary is within TOLERANCE of a mean shard, or at the row nearest to its target. ``slot``
    counts the rows of a shard from 0 without gaps, in an order that the id and the text fix; of rows that
    repeat both any may come first. Rows with a null id are dealt like others. Shards beyond the last
    row of a small table are empty; an empty table gives an empty table. Other columns are not looked at.
    """
    keys = sizes(docs, id_col, text_col)
    n = keys.count()
    dealt = keys.withColumn("shard", shard_of(splitters(keys, shards))) if n else keys.withColumn("shard", F.lit(0))
    runs = max(1, -(-n // (shards * SLOT_ROWS)))
    dealt = dealt.withColumn("run", F.pmod(F.col("d"), F.lit(runs)).cast("int"))
    counts = dealt.groupBy("shard", "run").count()
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "run").orderBy("d", "h", "id", "size")).cast("long")
    placed = dealt.withColumn("within", within - 1).join(settle(counts, "shard-runs"), ["shard", "run"])
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("before") + F.col("within")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The rows of ``docs`` as Parquet, a folder ``shard=i`` for each shard; whole rows move once."""
    shard, h, d = (free_name(docs, x) for x in ("shard", "h", "d"))
    found = splitters(sizes(docs, id_col, text_col), shards)
    keyed = docs.withColumn("h", text_key(text_col)).withColumn("d", row_key(id_col)) if (h, d) == ("h", "d") else None
    if keyed is None or shard != "shard":
        raise ValueError("columns named shard, h or d would be overwritten; rename them first")
    files = F.pmod(F.col("d"), F.lit(max(1, docs.sparkSession.sparkContext.defaultParallelism // shards + 1)))
    keyed = keyed.withColumn("shard", shard_of(found)).withColumn("h", files)
    keyed.repartition("shard", "h").drop("h", "d").write.partitionBy("shard").parquet(path)
