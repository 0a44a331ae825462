"""Centroid clustering of vectors, exact, with bounds that follow each cluster's own geometry.

Vectors become integers, so every distance and every new centroid is exact. A vector carries its cluster,
an upper bound on the distance to its centroid and a lower bound on the distance to any other. When the
centroids have moved, the upper bound grows by the drift of its own one. The lower bound would have to
shrink by the largest drift of all; here it shrinks by less: the vectors of a cluster lie in a sphere
around its old centroid, and in the plane through that centre and the line along which another centroid
moved, only vectors within the angle of the sphere see it come closer, by no more than its drift times the
cosine of that angle. Vectors whose bounds overlap get the exact distance to their own centroid, and those
that are still ambiguous are compared with all centroids.

The centroids (``k`` of them) are all that the driver holds. Each round reads the vectors once where they
are and writes them beside their bounds; sums are corrected by the vectors that changed their cluster only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import discard, settle

#: Integer components are held within this bound, so that squared distances of 64 components fit 64 bits.
LIMIT = 1 << 27
#: Relative room for rounding in bounds, which are the only inexact numbers.
ROOM = 1e-9
_STATE = "id long, v array<int>, cluster int, was int, upper double, lower double, scans int"
_LAST = "id long, cluster int, distance long, scans int"


def integers(vec: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of each component; null where a vector has not ``dims`` finite components."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    held = lambda x: F.least(F.greatest(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(-LIMIT)), F.lit(LIMIT))
    whole = F.transform(vec, lambda x: held(x).cast("int"))
    return F.when((F.size(vec) == dims) & F.coalesce(fine, F.lit(False)), whole)


def cluster(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    dims: int = 64,
    scale: int = 256,
    seed: str = "2",
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """Per usable row of ``vectors``: ``id_col``, cluster, distance, cluster_inertia, inertia,
    centroid_sha256 and scans (in how many rounds it was compared with all centroids).

    Rows whose vector is null, has another number of components or one that is null or not finite are left
    out. The first centroids are the ``k`` usable rows whose id has the smallest SHA-256 of ``seed:id``
    (a null id is written as nothing; rows of one id by their components); with fewer rows there are fewer
    centroids. Ties in distance go to the smaller number. Repeated rows count each. Components beyond
    2^27 after scaling are held at that bound. Other columns are not looked at; an empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vec_col), dims, scale).alias("v"))
    rows = settle(rows.where("v is not null"), "cluster-vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    now = np.array([r["v"] for r in first], np.int64).reshape(len(first), dims)
    state, moved = rows, None
    sums = np.zeros((len(now), dims + 1), object)
    for turn in range(rounds if len(now) else 0):
        newer = settle(state.mapInArrow(assigner(now, moved), _STATE), f"cluster-{turn}")
        discard(state)
        state, before = newer, now
        now = _centroids(state, before, sums)
        moved = Moves(before, now, _radii(state, len(now)))
    out = settle(state.mapInArrow(assigner(now, moved, last=True), _LAST), "cluster-last")
    discard(state)
    return _result(out, now, id_col)


def _result(out: DataFrame, now: np.ndarray, id_col: str) -> DataFrame:
    """The assigned rows beside the figures of their cluster, one row for each of at most ``k``."""
    totals = {r["cluster"]: int(r["t"]) for r in out.groupBy("cluster").agg(F.sum("distance").alias("t")).collect()}
    rows = [
        (i, totals.get(i, 0), sum(totals.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
        for i, c in enumerate(now)
    ]
    kind = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    figures = F.broadcast(out.sparkSession.createDataFrame(rows, kind))
    return out.join(figures, "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans"
    )


def _radii(state: DataFrame, k: int) -> np.ndarray:
    """How far the vectors of each cluster lie from its old centroid at most."""
    found = {r["cluster"]: r["r"] for r in state.groupBy("cluster").agg(F.max("upper").alias("r")).collect()}
    return np.array([found.get(i, 0.0) for i in range(k)])


def _centroids(state: DataFrame, now: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The next centroids; ``sums`` (with the number of vectors last) is corrected by those that came and went."""
    moved = state.where("cluster <> was").select("v", "cluster", "was")
    parts = moved.mapInArrow(_comings(now.shape), "c int, s array<long>").select("c", F.posexplode("s").alias("i", "x"))
    for r in parts.groupBy("c", "i").agg(F.sum("x").alias("x")).collect():  # k * (dims + 1) rows
        sums[r["c"], r["i"]] += r["x"]
    fresh = now.copy()
    for i in np.flatnonzero(sums[:, -1]):
        fresh[i] = [x // sums[i, -1] for x in sums[i, :-1]]
    return fresh


def _comings(shape: tuple[int, int]):
    """Per task and cluster: vectors that came less those that went, in sum and, last, in number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((shape[0], shape[1] + 1), np.int64)
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, shape[1])
            x = np.hstack([x, np.ones((len(x), 1), np.int64)])
            for column, sign in (("cluster", 1), ("was", -1)):
                where = batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64)
                np.add.at(total, where[where >= 0], sign * x[where >= 0])
        some = np.flatnonzero(total.any(1))
        columns = [pa.array(some, pa.int32()), pa.array(list(total[some]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["c", "s"])

    return work


class Moves:
    """What a round of moves does to the bounds: ``drift`` per centroid for upper ones, ``shrink`` per
    cluster for lower ones, and ``apart``, half the distance to the nearest other centroid."""

    def __init__(self, before: np.ndarray, now: np.ndarray, radii: np.ndarray):
        self.drift = np.sqrt(((now - before) ** 2).sum(1).astype(float)) * (1 + ROOM)
        self.shrink = shrink(before, now, radii)
        gap = ((now[:, None] - now[None]) ** 2).sum(2).astype(float)
        np.fill_diagonal(gap, np.inf)
        self.apart = np.sqrt(gap.min(1)) / 2 * (1 - ROOM) if len(now) > 1 else np.full(len(now), np.inf)


def shrink(before: np.ndarray, now: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each cluster, by how much any other centroid can have come closer to a vector of its sphere.

    With p and q the old and new place of a centroid, m the middle between them and d their distance,
    |x - p| - |x - q| = 2 d t / (|x - p| + |x - q|), where t is the reach of x - m along the move; the
    sum below the line is at least 2 |x - m|, so the decrease is at most d cos(angle of x - m to the move).
    In the plane of m, the move and the sphere's centre, the sphere spans arcsin(radius / distance) on
    either side of its centre: the smallest angle of any of its vectors is the centre's less that.
    """
    p, q = before.astype(float), now.astype(float)
    step = q - p
    d = np.sqrt((step**2).sum(1))
    middle = (p + q) / 2
    rest = p[:, None, :] - middle[None]  # sphere's centre (rows) seen from the middle of a move (columns)
    away = np.sqrt((rest**2).sum(2))
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arccos(np.clip((rest * step[None]).sum(2) / (away * d[None]), -1, 1))
        span = np.arcsin(np.clip(radii[:, None] * (1 + ROOM) / away, 0, 1))
        part = np.cos(np.clip(angle - span, 0, np.pi / 2))
    inside = (radii[:, None] * (1 + ROOM) >= away) | ~np.isfinite(part)
    most = np.where(inside, 1.0, np.minimum(1.0, part + 1e-6)) * d[None]
    np.fill_diagonal(most, 0.0)
    return most.max(1, initial=0.0) * (1 + ROOM)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centres."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centres).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:  # every intermediate number is a whole double
        a, c = x.astype(float), centres.astype(float)
        return ((a**2).sum(1)[:, None] - 2 * (a @ c.T) + (c**2).sum(1)[None]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centres], 1)


def assigner(now: np.ndarray, moved: Moves | None, last: bool = False):
    """A function over Arrow batches that brings clusters and bounds up to the centroids ``now``. The ``last``
    turn gives exact squared distances in place of bounds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _assign(batch, now, moved, last)

    return work


def _assign(batch: pa.RecordBatch, now: np.ndarray, moved: Moves | None, last: bool) -> pa.RecordBatch:
    n, dims = batch.num_rows, now.shape[1]
    lists = batch.column("v")
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dims)
    if moved is None:
        mine, scans = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        upper, lower = np.zeros(n), np.full(n, -1.0)
        unsure = np.ones(n, bool)
    else:
        mine, scans = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cluster", "scans"))
        upper = batch.column("upper").to_numpy(zero_copy_only=False) + moved.drift[mine]
        lower = np.maximum(batch.column("lower").to_numpy(zero_copy_only=False) - moved.shrink[mine], moved.apart[mine] * 2 - upper)
        unsure = ~(upper < lower)
    was = mine.copy()
    check = np.flatnonzero(unsure | last) if moved is not None else np.empty(0, np.int64)
    if len(check):
        own = ((x[check] - now[mine[check]]) ** 2).sum(1)
        upper[check] = np.sqrt(own.astype(float)) * (1 + ROOM)
        lower[check] = np.maximum(lower[check], moved.apart[mine[check]] * 2 - upper[check])
        unsure[check] &= ~(upper[check] < lower[check])
    scan = np.flatnonzero(unsure)
    exact = np.zeros(n, np.int64)
    if len(check):
        exact[check] = own
    if len(scan):
        d = distances(x[scan], now)
        best = d.argmin(1)  # the first of equal ones
        at = np.arange(len(scan))
        exact[scan] = d[at, best]
        far = d.astype(float)
        far[at, best] = np.inf
        mine[scan], scans[scan] = best, scans[scan] + 1
        upper[scan] = np.sqrt(exact[scan].astype(float)) * (1 + ROOM)
        lower[scan] = np.sqrt(far.min(1)) * (1 - ROOM)
    ids, cluster, scans = batch.column("id"), pa.array(mine, pa.int32()), pa.array(scans, pa.int32())
    if last:
        return pa.RecordBatch.from_arrays([ids, cluster, pa.array(exact), scans], ["id", "cluster", "distance", "scans"])
    return pa.RecordBatch.from_arrays(
        [ids, lists, cluster, pa.array(was, pa.int32()), pa.array(upper), pa.array(lower), scans],
        ["id", "v", "cluster", "was", "upper", "lower", "scans"],
    )
