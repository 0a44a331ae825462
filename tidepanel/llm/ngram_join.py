"""Jaccard join of n-gram sets by a prefix tree.

1. Every text becomes the set of its distinct word n-grams; texts of equal sets are one class. One pass
   counts, in a table of fixed size, how many sets hold the n-grams of each hash range, which fixes one global
   order of all n-grams from rare to frequent.
2. Two sets of the wanted similarity share an n-gram among the first quarter of each in that order. Those
   prefixes are dealt by n-gram to buckets of bounded size; classes that share one become candidates. In a
   group of many, one class (the hub, of the smallest number) stands for all at first.
3. Candidates are verified on their whole sets. The sets to compare with one hub are kept in a trie
   under the same global order, frequent n-grams first, so that near copies share long paths; the tree is
   walked depth-first, an overlap counted on a shared path is counted once, and a branch is left as soon
   as what remains of it cannot reach the overlap needed.
4. In groups whose classes are not all linked yet, classes of different components are compared with each
   other, block by block, so no link between different texts is lost; within a component further links would
   change nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import words
from tidepanel.llm.common import by_mark, free_name, release, settle
from tidepanel.llm.graph import components

GRAM = 5
#: Two sets link when DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: The table of counts has a counter for each value of the first bits of a hash, sent in slices.
COUNT_BITS, SLICES = 21, 64
LOW_BITS = 64 - COUNT_BITS
#: Prefix n-grams in a bucket, on average.
BUCKET_GRAMS = 400_000
#: Partners of one hub that a task compares, about.
STAR = 512
#: Members of a group that one task compares with each other; larger groups are compared block by block.
BLOCK = 1024
#: Bytes of sets, 8 an n-gram, of a hub's partners in a task or of a block, about: long texts are dealt more thinly.
SET_BYTES = 16 << 20
#: Counts of profiles that are compared at once.
CELLS = 1 << 20
#: Bits of the table that tells which rows' sets are needed for verification; more needed rows than bits only
#: send sets that the join then drops.
NEED_BITS = 26

U64 = np.uint64
#: An n-gram of a prefix within its bucket: half of its hash (what two n-grams of one half suggest, the verification
#: finds out), its set, and twice the set's size plus whether a partner that is not smaller may share it first.
RECORD = np.dtype([("gram", "<u4"), ("sig", "<i8"), ("size", "<u4")])
DOC = "id long, sig long, n long, profile binary, slice int, counts binary"


def signature(grams: np.ndarray) -> int:
    """One signed 64-bit number for a set."""
    total = int(words.mix(grams ^ U64(0xA5A5A5A55A5A5A5A)).sum(dtype=U64)) + len(grams)
    return int(words.mix(np.array([total % 2**64], U64)).astype(np.int64)[0])


def profile(grams: np.ndarray) -> bytes:
    """How many n-grams of a set fall into each of about a third as many ranges: a 32nd of the set's size."""
    ranges = 1 << max(4, (len(grams) // 3).bit_length())
    counts = np.bincount((grams & U64(ranges - 1)).astype(np.int64), minlength=ranges)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def overlap_bound(a: bytes, b: bytes) -> int:
    """The most n-grams that sets of these profiles can share."""
    x, y = (np.frombuffer(p, np.uint8).astype(np.int64) for p in (a, b))
    if (x == 255).any() or (y == 255).any():
        return 1 << 62
    while len(x) > len(y):
        x = x[: len(x) // 2] + x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] + y[len(y) // 2 :]
    return int(np.minimum(x, y).sum())


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("id", pa.int64()), ("sig", pa.int64()), ("n", pa.int64()), ("profile", pa.binary()),
        ("slice", pa.int32()), ("counts", pa.binary()),
    ])
    counts = np.zeros(1 << COUNT_BITS, np.int32)
    for batch in (p for b in batches for p in words.parts(b, 1)):
        sigs, sizes, profiles = [], [], []
        for grams in words.shingle_sets(batch.column(1), GRAM):
            sizes.append(len(grams))
            sigs.append(signature(grams) if len(grams) else None)
            profiles.append(profile(grams) if len(grams) else None)
            np.add.at(counts, (grams >> U64(LOW_BITS)).astype(np.int64), 1)
        none = pa.nulls(len(sizes))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(profiles, pa.binary()),
             none.cast(pa.int32()), none.cast(pa.binary())],
            schema=schema,
        )
    if counts.any():
        blobs = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(SLICES, -1)]
        none = pa.nulls(SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())],
            schema=schema,
        )


def _sum_slices(table: pa.Table) -> pa.Table:
    total = None
    for blob in table.column("counts").to_pylist():
        one = np.frombuffer(zlib.decompress(blob), np.int32).astype(np.int64)
        total = one if total is None else total + one
    total = np.minimum(total, 2**31 - 1).astype(np.int32)  # only the order of counts is used
    return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _ranks(summaries: DataFrame) -> np.ndarray:
    """Rank of each counter, from rare to frequent: SLICES rows come to the driver, whatever the input."""
    slices = summaries.where("slice is not null").select("slice", "counts")
    part = F.pmod(F.xxhash64("counts"), F.lit(32)).alias("part")
    schema = "slice int, counts binary"
    some = slices.groupBy("slice", part).applyInArrow(_sum_slices, schema)
    total = np.zeros((SLICES, (1 << COUNT_BITS) // SLICES), np.int32)
    for row in some.groupBy("slice").applyInArrow(_sum_slices, schema).collect():
        total[row["slice"]] = np.frombuffer(zlib.decompress(row["counts"]), np.int32)
    ranks = np.empty(1 << COUNT_BITS, np.uint32)
    ranks[np.argsort(total.ravel(), kind="stable")] = np.arange(1 << COUNT_BITS, dtype=np.uint32)
    return ranks


def ordered(grams: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The n-grams renumbered, one to one, so that their numbers ascend from rare to frequent."""
    low = U64((1 << LOW_BITS) - 1)
    rank = ranks[(grams >> U64(LOW_BITS)).astype(np.int64)].astype(U64)
    return np.sort((rank << U64(LOW_BITS)) | (grams & low))


def prefix_lengths(n: int) -> tuple[int, int]:
    """How many of a set's first n-grams can be the first shared one, with a partner of any size and
    with one that is not smaller."""
    probe = n - -(-NUM * n // DEN) + 1
    index = n - -(-2 * NUM * n // (NUM + DEN)) + 1
    return probe, index


def needed(n: int, m: int) -> int:
    """Smallest intersection with which sets of n and m link."""
    return -(-NUM * (n + m) // (NUM + DEN))


def _prefixes(ranks, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (p for b in batches for p in words.parts(b, 0)):
            parts, hashes = [], []
            for grams in words.shingle_sets(batch.column(0), GRAM):
                if not len(grams) or (sig := signature(grams)) in seen:
                    continue
                seen.add(sig)
                probe, index = prefix_lengths(len(grams))
                hashes.append(words.mix(ordered(grams, ranks.value)[:probe]))
                records = np.empty(probe, RECORD)
                records["gram"] = hashes[-1] >> U64(32)
                records["sig"] = sig
                records["size"] = 2 * min(len(grams), 2**31 - 1) + (np.arange(probe) < index)
                parts.append(records)
            if not parts:
                continue
            records = np.concatenate(parts)
            bucket = (np.concatenate(hashes) % U64(buckets)).astype(np.int32)
            order = np.lexsort((records["gram"], bucket))
            records, bucket = records[order], bucket[order]
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(starts[1:], len(bucket))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[starts]), pa.array([records[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary())],
                names=["bucket", "records"],
            )

    return run


FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("salt", pa.int32()), ("members", pa.binary())])
FOUND_SQL = "a long, b long, salt int, members binary"
MEMBER = np.dtype([("sig", "<i8"), ("n", "<i8")])


def _close(n, m, early_n, early_m):
    """Whether sizes allow a link and the shared n-gram may be the first one shared."""
    small, large = np.minimum(n, m), np.maximum(n, m)
    first = np.where(n < m, early_n, np.where(m < n, early_m, early_n | early_m))
    return (DEN * small >= NUM * large) & (first > 0)


def _candidates(table: pa.Table) -> pa.Table:
    """Candidate pairs (hub, partner, salt) of one bucket, and for groups of three or more their members, with
    the size class of the group in the place of the salt."""
    records = np.concatenate([np.frombuffer(x, RECORD) for x in table.column("records").to_pylist()])
    order = np.lexsort((records["sig"], records["gram"]))  # stable: of n-grams of one set and half, the first stays
    gram, sig = records["gram"][order], records["sig"][order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (sig[1:] != sig[:-1])
    records, gram = records[order][new], gram[new]
    starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    sizes = np.diff(np.append(starts, len(gram)))
    two = starts[sizes == 2]
    x, y = records[two], records[two + 1]
    n, m = (x["size"] >> 1).astype(np.int64), (y["size"] >> 1).astype(np.int64)
    ok = _close(n, m, x["size"] & 1, y["size"] & 1)
    pairs = np.unique(np.stack([x["sig"][ok], y["sig"][ok]], 1), axis=0) if ok.any() else np.empty((0, 2), np.int64)
    groups: dict[int, dict[int, int]] = {}
    for s, k in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        # The smallest number: other n-grams of a family name the same class, whichever bucket they are in.
        member, size = records["sig"][s : s + k], records["size"][s : s + k] >> 1
        groups.setdefault((int(member[0]), _coarse(size)), {}).update(zip(member.tolist(), size.tolist()))
    a, b, salt = [pairs[:, 0]], [pairs[:, 1]], [np.zeros(len(pairs), np.int32)]
    hubs, kinds, lists = [], [], []
    for (hub, kind), members in groups.items():
        names = np.fromiter(members, np.int64, len(members))
        sizes = np.fromiter(members.values(), np.int64, len(members))
        at = int(np.flatnonzero(names == hub)[0])
        near = (DEN * np.minimum(sizes, sizes[at]) >= NUM * np.maximum(sizes, sizes[at])) & (names != hub)
        a.append(np.full(int(near.sum()), hub))
        b.append(names[near])
        salt.append(((names[near] & 0x7FFFFFFF) % (1 + len(names) // STAR)).astype(np.int32))
        blob = np.empty(len(names), MEMBER)
        blob["sig"], blob["n"] = names, sizes
        hubs.append(hub)
        kinds.append(kind)
        lists.append(np.sort(blob, order="sig").tobytes())
    a, b, salt = np.concatenate(a), np.concatenate(b), np.concatenate(salt)
    none = len(a)
    return pa.table(
        [
            pa.array(np.concatenate([a, np.array(hubs, np.int64)])),
            pa.chunked_array([pa.array(b.astype(np.int64)), pa.nulls(len(hubs), pa.int64())]).combine_chunks(),
            pa.chunked_array([pa.array(salt), pa.array(kinds, pa.int32())]).combine_chunks(),
            pa.chunked_array([pa.nulls(none, pa.binary()), pa.array(lists, pa.binary())]).combine_chunks(),
        ],
        schema=FOUND,
    )


def _coarse(sizes: np.ndarray) -> int:
    """Groups of one hub are merged when they have about as many members."""
    return int(np.log2(len(sizes)) * 2)


def _sets(ranks, bits):
    """(sig, id, grams) of the rows whose sets may be needed; numbers ascend from frequent to rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in words.parts(b, 1)):
            ids, sigs, blobs = [], [], []
            for row, grams in zip(batch.column(0).to_pylist(), words.shingle_sets(batch.column(1), GRAM)):
                if not len(grams):
                    continue
                sig = signature(grams)
                bit = (sig ^ (row or 0)) & ((1 << NEED_BITS) - 1)
                if bits.value[bit >> 3] >> (bit & 7) & 1:
                    ids.append(row)
                    sigs.append(sig)
                    blobs.append((~ordered(grams, ranks.value)[::-1]).astype(">u8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(sigs, pa.int64()), pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())],
                names=["sig", "id", "grams"],
            )

    return run


def trie_links(hub: bytes, members: list[tuple[int, bytes]]) -> list[int]:
    """Names of the members whose sets link with the hub's.

    Sorted, the members are the trie's leaves from left to right; what a leaf shares with the one before is
    the path that both have in common, and ``run`` holds the overlaps counted along it.
    """
    own = np.frombuffer(hub, ">u8").astype(U64)
    linked = []
    before, run = np.empty(0, U64), np.zeros(1, np.int64)
    dead, missed = -1, 0  # the depth at which a branch was left, and the n-grams missed up to it
    for name, blob in sorted(members, key=lambda m: m[1]):
        path = np.frombuffer(blob, ">u8").astype(U64)
        k = min(len(path), len(before), len(run) - 1)
        differs = path[:k] != before[:k]
        shared = int(np.argmax(differs)) if differs.any() else k
        want = needed(len(own), len(path))
        if shared < dead:
            dead = -1
        if dead >= 0 and missed > len(path) - want:
            continue  # below a branch that was left
        before, run = path, run[: shared + 1]
        at, left = shared, False
        while at < len(path):
            stop = min(len(path), at + 64)
            place = np.searchsorted(own, path[at:stop])
            hit = own[np.minimum(place, len(own) - 1)] == path[at:stop]
            run = np.append(run, run[-1] + np.cumsum(hit))
            at = stop
            if run[-1] + len(path) - at < want:
                left, dead, missed = True, at, at - int(run[-1])
                break
        if not left and run[len(path)] >= want:
            linked.append(name)
    return linked


def _verify(table: pa.Table) -> pa.Table:
    hub = table.column("a")[0].as_py()
    rows = dict(zip(table.column("sig").to_pylist(), table.column("grams").to_pylist()))
    own = rows.pop(hub, None)
    found = trie_links(own, list(rows.items())) if own is not None else []
    return pa.table({"a": pa.array([hub] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose profiles allow the overlap they need."""
    for batch in batches:
        n, m, p, q = (batch.column(c).to_pylist() for c in ("n", "m", "p", "q"))
        keep = [overlap_bound(x, y) >= needed(i, j) for i, j, x, y in zip(n, m, p, q)]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b", "salt", "ida", "idb", "m"])


def _shares(size, grams, most: int):
    """Into how many parts to cut ``size`` sets of ``grams`` n-grams in all."""
    return F.ceil(F.greatest(size / F.lit(most), grams * 8 / F.lit(SET_BYTES))).cast("int")


def _dealt(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b, salt, m: n-grams of b) with partners dealt over more salts where those of one (a, salt), of
    whichever groups they come, are too many or too large for a task."""
    heavy = pairs.groupBy("a", "salt").agg(_shares(F.count("*"), F.sum("m"), STAR).alias("shares")).where("shares > 1")
    share = F.coalesce(F.pmod(F.xxhash64("b"), F.col("shares")), F.lit(0)).cast("int")
    return pairs.join(heavy, ["a", "salt"], "left").withColumn("share", share).drop("shares")


def _links(rows: DataFrame, classes: DataFrame, pairs: DataFrame, ranks) -> DataFrame:
    """The ``pairs`` (a, b, salt) that link, settled. What profiles rule out needs no sets."""
    _, classes = by_mark(classes, "sig", pairs.select(F.explode(F.array("a", "b")).alias("id")))
    pairs = pairs.groupBy("a", "b").agg(F.max("salt").alias("salt"))
    pairs = pairs.join(classes.select(F.col("sig").alias("a"), F.col("id").alias("ida"), "n", F.col("profile").alias("p")), "a")
    pairs = pairs.join(
        classes.select(F.col("sig").alias("b"), F.col("id").alias("idb"), F.col("n").alias("m"), F.col("profile").alias("q")), "b"
    )
    pairs = settle(pairs.mapInArrow(_possible, "a long, b long, salt int, ida long, idb long, m long"), "gram-pairs")
    if pairs.isEmpty():
        return pairs.select("a", "b")
    pairs = _dealt(pairs)
    partner = pairs.select("a", "salt", "share", F.col("b").alias("sig"), F.col("idb").alias("id"))
    hubs = pairs.select("a", "salt", "share", F.col("a").alias("sig"), F.col("ida").alias("id")).distinct()
    requests = settle(hubs.unionByName(partner), "gram-requests")
    fetched = _fetched(rows, requests, ranks).select("a", "salt", "share", "sig", "grams")
    return settle(fetched.groupBy("a", "salt", "share").applyInArrow(_verify, "a long, b long"), "gram-links")


def _fetched(rows: DataFrame, wanted: DataFrame, ranks) -> DataFrame:
    """The rows of ``wanted`` (sig, id and others) with grams: the sets of those rows, made from the texts again."""
    bit = F.col("sig").bitwiseXOR(F.coalesce("id", F.lit(0))).bitwiseAND(F.lit((1 << NEED_BITS) - 1)) + 1
    marks = wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("k"))
    table = bytearray(1 << (NEED_BITS - 3))
    for row in marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect():
        table[(row["k"] - 1) * 4096 : row["k"] * 4096] = row["bits"]  # at most 2^NEED_BITS bits in all
    bits = rows.sparkSession.sparkContext.broadcast(bytes(table))
    sets = rows.mapInArrow(_sets(ranks, bits), "sig long, id long, grams binary")
    sets = sets.withColumn("id", F.coalesce("id", F.lit(0)))
    return wanted.withColumn("id", F.coalesce("id", F.lit(0))).join(sets, ["sig", "id"])


def _hopeful(table: pa.Table) -> pa.Table:
    """The members of a group that some member of another component may link with, by sizes and profiles."""
    hub, first, second = (table.column(c)[0].as_py() for c in ("hub", "p", "q"))
    sig, root, n, block = (table.column(c).to_numpy() for c in ("sig", "root", "n", "block"))
    profiles = table.column("profile").to_pylist()
    length = np.array([len(p) for p in profiles])
    full = np.array([255 in p for p in profiles])  # counts that reached the largest number say nothing
    folded = {}
    for common in np.unique(length).tolist():
        wide = length >= common
        # The smallest numbers that hold a sum of that many counts up to 255.
        kind = np.uint16 if length.max() // common * 255 < 1 << 16 else np.int32
        rows = np.empty((int(wide.sum()), common), kind)
        for at, i in enumerate(np.flatnonzero(wide).tolist()):
            rows[at] = np.frombuffer(profiles[i], np.uint8).reshape(-1, common).sum(0, dtype=kind)
        folded[common] = rows, np.cumsum(wide) - 1
    keep = np.zeros(len(sig), bool)
    for i in range(len(sig)):
        if sig[i] == hub:
            continue  # compared with all before
        other = (sig > sig[i]) & (root != root[i]) & (sig != hub)
        if first != second:
            other &= block != block[i]
        other &= DEN * np.minimum(n, n[i]) >= NUM * np.maximum(n, n[i])
        for common, (rows, place) in folded.items():
            near = np.flatnonzero(other & (np.minimum(length, length[i]) == common))
            step = max(1, CELLS // common)
            for mine in (near[k : k + step] for k in range(0, len(near), step)):
                most = np.minimum(rows[place[mine]], rows[place[i]]).sum(1, dtype=np.int64)
                mine = mine[(most >= -(-NUM * (n[i] + n[mine]) // (NUM + DEN))) | full[mine] | full[i]]
                keep[mine] = True
                keep[i] |= len(mine) > 0
    return table.filter(pa.array(keep)).drop_columns(["profile"])


def _across(table: pa.Table) -> pa.Table:
    """Links between members of a group that are in different components, within a block or between two.

    Counts over about twice as many ranges as a set has n-grams bound the overlaps; what they leave open is
    looked up in the trie. Once a link joins two components, no more is looked for between them.
    """
    hub, first, second = (table.column(c)[0].as_py() for c in ("hub", "p", "q"))
    sig, root, n, block = (table.column(c).to_numpy() for c in ("sig", "root", "n", "block"))
    blobs = table.column("grams").to_pylist()
    ranges = min(4096, 1 << max(4, int(2 * n.max()).bit_length() - 1))
    counts = np.empty((len(sig), ranges), np.uint8)
    for i, blob in enumerate(blobs):
        low = (np.frombuffer(blob, ">u8").astype(U64) & U64(ranges - 1)).astype(np.int64)
        counts[i] = np.minimum(np.bincount(low, minlength=ranges), 255)
    full = (counts == 255).any(1)
    parent = {r: r for r in set(root.tolist())}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    for i in range(len(sig)):
        if sig[i] == hub:
            continue  # compared with all before
        other = (sig > sig[i]) & (root != root[i]) & (sig != hub)
        if first != second:
            other &= block != block[i]
        other &= DEN * np.minimum(n, n[i]) >= NUM * np.maximum(n, n[i])
        mine = np.flatnonzero(other)
        most = np.minimum(counts[mine], counts[i]).sum(1, dtype=np.int64)
        want = -(-NUM * (n[i] + n[mine]) // (NUM + DEN))
        mine = mine[(most >= want) | full[mine] | full[i]]
        own = top(root[i])
        mine = [k for k in mine.tolist() if top(root[k]) != own]
        for k in trie_links(blobs[i], [(k, blobs[k]) for k in mine]) if mine else ():
            x, y = top(root[i]), top(root[k])
            if x != y:
                parent[x] = y
                a.append(int(sig[i]))
                b.append(int(sig[k]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id_col, n_shingles, component_id, class_id.

    Rows link when the sets of their 5-word shingles (A-Z as a-z) have a Jaccard similarity of 0.75 or
    more; ``component_id`` is the smallest id that links reach. ``class_id`` names the set. A text of fewer
    than five words is one shingle; a null text, or one without words, has none, is linked with nothing and
    is its own component. Rows that repeat an id each get a row. A null id is never the smallest unless all
    of its component are null. An empty table gives an empty table. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    summaries = settle(rows.mapInArrow(_summaries, DOC), "gram-summaries")
    per_row = summaries.where("slice is null").select("id", "sig", "n", "profile")
    firsts = per_row.where("n > 0").groupBy("sig", "n", "profile").agg(F.min("id").alias("id"))
    classes = settle(firsts, "gram-classes")
    roots = _roots(spark, rows, summaries, classes)
    named = classes.select("sig", "id").join(roots.withColumnRenamed("node", "sig"), "sig", "left")
    named = named.withColumn("root", F.coalesce("root", "sig"))
    firsts = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = settle(named.join(firsts, "root").select("sig", "component_id"), "gram-named")
    out = per_row.withColumn("sig", F.coalesce("sig", F.xxhash64(F.lit("empty"), "id")))
    out = out.join(named, "sig", "left")
    single = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), single.alias("component_id"),
        F.when(F.col("n") > 0, F.col("sig")).alias("class_id"),
    )


def _roots(spark, rows: DataFrame, summaries: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, root) of the classes that have a link."""
    ranks = spark.sparkContext.broadcast(_ranks(summaries))
    grams = summaries.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, -(-grams // 4 // BUCKET_GRAMS))
    dealt = rows.select("text").mapInArrow(_prefixes(ranks, buckets), "bucket int, records binary")
    found = settle(dealt.groupBy("bucket").applyInArrow(_candidates, FOUND_SQL), "gram-candidates")
    release(spark)  # all prefixes were dealt: the largest shuffle
    links = _links(rows, classes, found.where("members is null").select("a", "b", "salt"), ranks)
    release(spark)
    roots = components(links)
    groups = found.where("members is not null").select(F.col("a").alias("hub"), F.col("salt").alias("kind"), "members")
    member = groups.mapInArrow(_unpack, "hub long, kind int, sig long, n long").distinct()
    member = member.join(roots.withColumnRenamed("node", "sig"), "sig", "left")
    member = settle(member.withColumn("root", F.coalesce("root", "sig")), "gram-members")
    left = settle(_cut(member), "gram-left")
    _, asked = by_mark(classes, "sig", left.select(F.col("sig").alias("id")))
    left = left.join(asked.select("sig", "id", "profile"), "sig")
    block = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    pairs = left.withColumn("block", block).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumns({"p": F.least("block", "k"), "q": F.greatest("block", "k")})
    pairs = pairs.select("hub", "kind", "p", "q", "block", "sig", "id", "root", "n", "profile")
    kept = "hub long, kind int, p int, q int, block int, sig long, id long, root long, n long"
    pairs = settle(pairs.groupBy("hub", "kind", "p", "q").applyInArrow(_hopeful, kept), "gram-open")
    release(spark)
    if pairs.isEmpty():
        return roots
    pairs = _fetched(rows, pairs, ranks)
    more = settle(pairs.groupBy("hub", "kind", "p", "q").applyInArrow(_across, "a long, b long"), "gram-across")
    return roots if more.isEmpty() else components(links.unionByName(more))


def _cut(member: DataFrame) -> DataFrame:
    """The members (hub, kind, sig, n, root) of groups of several components, and in how many blocks the group is cut."""
    shares = _shares(F.count("*"), F.sum("n"), BLOCK).alias("blocks")
    open_ = member.groupBy("hub", "kind").agg(F.min("root").alias("x"), F.max("root").alias("y"), shares)
    return member.join(open_.where("x < y").select("hub", "kind", "blocks"), ["hub", "kind"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for hub, kind, blob in zip(*(batch.column(c).to_pylist() for c in range(3))):
            members = np.frombuffer(blob, MEMBER)
            k = len(members)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, hub)), pa.array(np.full(k, kind, np.int32)), pa.array(members["sig"].copy()), pa.array(members["n"].copy())],
                names=["hub", "kind", "sig", "n"],
            )


def _with_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigs = [signature(g) if len(g) else None for g in words.shingle_sets(batch.column(0), GRAM)]
        yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), batch.column(1)], names=["sig", "whole"])


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component (its smallest id), with all their columns.

    Rows are passed on where they are unless a bit table of fixed size marks their id as one that goes or is
    repeated; those are told apart by a join.
    Of rows that repeat an id and a set of shingles, the one with the smallest values in the columns stays.
    """
    found = settle(near_duplicates(docs, id_col, text_col), "gram-found")
    name = free_name(docs, "named")
    stays = F.col(id_col).eqNullSafe(F.col("component_id"))
    verdicts = found.groupBy(F.col(id_col).alias(name)).agg(F.max(stays).alias("some"), F.min(stays).alias("all"), F.count("*").alias("n"))
    verdicts = settle(verdicts, "gram-verdicts")
    mine = F.col(id_col).cast("long").eqNullSafe(F.col(name))
    # An id that one row has: the id decides. Rows of an id that several have are told apart by their sets.
    marked = verdicts.where("not some or n > 1").select(name)
    stay, open_ = by_mark(docs, id_col, marked.select(F.col(name).alias("id")))
    rest = stay.unionByName(open_.join(marked, mine, "left_anti"))
    again = verdicts.where("some and n > 1").select(name)
    if again.isEmpty():
        return rest
    whole = open_.join(again, mine, "left_semi").select(F.col(text_col).alias("text"), F.struct(*docs.columns).alias("whole"))
    kind = whole.schema["whole"].dataType.simpleString()
    classed = whole.mapInArrow(_with_class, f"sig long, whole {kind}")
    empty = found.where("class_id is null").select(F.col(id_col).alias(name), F.lit(None).cast("long").alias("class"))
    good = found.where(stays & F.col("class_id").isNotNull()).select(F.col(id_col).alias(name), F.col("class_id").alias("class"))
    good = good.unionByName(empty).distinct()
    match = F.col(f"whole.{id_col}").cast("long").eqNullSafe(F.col(name)) & F.col("sig").eqNullSafe(F.col("class"))
    kept = classed.join(good, match, "left_semi").groupBy(F.col(f"whole.{id_col}"), "sig").agg(F.min("whole").alias("whole"))
    return rest.unionByName(kept.select("whole.*"))
