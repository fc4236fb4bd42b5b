"""Embedding near-dedup by product quantisation: inverted lists, residual codes, table-lookup distances, exact cosines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .minhash import components
from .shared import Scratch

PARTS, CODES = 8, 256
#: The most lists: their centres are sent to every task. Beyond 2 sqrt(n) = LISTS lists grow longer instead, and are searched in blocks.
LISTS, FIT_ROWS = 65_536, 16_384
MEMBERS, QUERIES = 16_384, 65_536


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors of a column of bytes, without a loop over rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray) or not len(column):
        return np.zeros((0, dim), np.float32)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.float32).reshape(-1, dim)


def nearest(x: np.ndarray, centres: np.ndarray, k: int = 1, rows: int = 4096) -> np.ndarray:
    """Indexes of each row's k nearest centres, the nearest first."""
    out = np.empty((len(x), k), np.int32)
    norms = (centres**2).sum(1)
    for lo in range(0, len(x), rows):
        d = norms - 2 * (x[lo : lo + rows] @ centres.T)
        if k == 1:
            out[lo : lo + rows, 0] = d.argmin(1)
            continue
        best = np.argpartition(d, k - 1, 1)[:, :k] if k < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
        order = np.take_along_axis(d, best, 1).argsort(1, kind="stable")
        out[lo : lo + rows] = np.take_along_axis(best, order, 1)[:, :k]
    return out


def encode(residual: np.ndarray, books: np.ndarray) -> np.ndarray:
    width = residual.shape[1] // len(books)
    return np.stack([nearest(residual[:, m * width : (m + 1) * width], books[m])[:, 0] for m in range(len(books))], 1).astype(np.uint8)


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.concatenate([books[m][codes[:, m]] for m in range(len(books))], 1)


def table_distances(query_residual: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances between exact queries and coded members, as sums of one table entry for each subspace."""
    width = query_residual.shape[1] // len(books)
    total = np.zeros((len(query_residual), len(codes)), np.float32)
    for m, book in enumerate(books):
        q = query_residual[:, m * width : (m + 1) * width]
        table = (q**2).sum(1)[:, None] - 2 * q @ book.T + (book**2).sum(1)
        total += table[:, codes[:, m]]
    return total


def _lloyd(vectors: DataFrame, centres: np.ndarray, assign: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], dim: int, rounds: int) -> np.ndarray:
    """Lloyd rounds over the vectors: each task sums its members of each centre, the sums are added by key, and the driver gets one row for each centre and coordinate. A centre without members stays."""
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], now=centres) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(now.shape), np.zeros(len(now))
            for batch in batches:
                if batch.num_rows:
                    at, value = assign(_matrix(batch.column(1), dim), now)
                    np.add.at(total, at, value)
                    count += np.bincount(at, minlength=len(now))
            full = np.flatnonzero(count)
            width = now.shape[1]
            yield pa.record_batch(
                [pa.array(np.repeat(full, width + 1)), pa.array(np.tile(np.arange(width + 1), len(full)).astype(np.int32)), pa.array(np.concatenate([total[full], count[full, None]], 1).ravel())],
                names=["centre", "j", "value"],
            )

        sums = vectors.mapInArrow(run, "centre long, j int, value double").groupBy("centre", "j").agg(F.sum("value").alias("value")).toArrow()
        wide = np.zeros((len(centres), centres.shape[1] + 1))
        wide[sums["centre"].to_numpy(), sums["j"].to_numpy()] = sums["value"].to_numpy()
        full = wide[:, -1] > 0
        centres = centres.copy()
        centres[full] = wide[full, :-1] / wide[full, -1:]
    return centres


def _unit(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            at = column.offsets.to_numpy()
            fit = np.flatnonzero((np.diff(at) == dim) & column.is_valid().to_numpy(zero_copy_only=False))
            # A null among the values is read as NaN.
            values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            x = values[at[fit][:, None] + np.arange(dim)]
            norm = np.sqrt((x**2).sum(1))
            good = np.isfinite(norm) & (norm > 0)
            unit = np.ascontiguousarray((x[good] / norm[good, None]).astype(np.float32))
            offsets = np.arange(len(unit) + 1, dtype=np.int32) * (4 * dim)
            vec = pa.Array.from_buffers(pa.binary(), len(unit), [None, pa.py_buffer(offsets), pa.py_buffer(unit.tobytes())])
            yield pa.record_batch([batch.column(0).take(pa.array(fit[good])).cast(pa.int64()), vec], names=["id", "vec"])

    return run


def united(label: np.ndarray, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Labels after the items i and k have been connected: every item has the least item of its component."""
    while True:
        a, b = label[i], label[k]
        apart = a != b
        if not apart.any():
            return label
        i, k, a, b = i[apart], k[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def near_pairs(vectors: DataFrame, scratch: Scratch, threshold: float, probes: int, dim: int, rounds: int = 4, whole: bool = True, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(a, b, cosine), a < b: pairs of (id, vec) at or above the threshold; every row is a query of its `probes` nearest lists.

    Without `whole` only as many pairs are given out as connect the same vectors, so that a dense group of n vectors costs n
    rows and not n squared. Centres and codebooks are fitted to a sample of about fit_rows rows, or of 8 for each list if
    that is more, those of least id hash; every row is indexed.
    """
    n = vectors.count()
    lists = max(1, min(round(2 * n**0.5), LISTS))
    share = min(1.0, max(fit_rows, 8 * lists) / max(n, 1))
    sample = scratch.save(vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else vectors, "sample")
    centres = _lloyd(sample, _first(sample, lists, dim), lambda x, c: (nearest(x, c.astype(np.float32))[:, 0], x), dim, rounds).astype(np.float32)
    parts = next(p for p in range(min(PARTS, dim), 0, -1) if dim % p == 0)
    width = dim // parts
    seeds = _first(sample, min(CODES, max(1, n)), dim)
    seeds = seeds - centres[nearest(seeds, centres)[:, 0]]
    books = np.stack([seeds[:, m * width : (m + 1) * width] for m in range(parts)])
    codes_n = books.shape[1]

    def assign(x, flat):
        own = flat.reshape(parts, codes_n, width).astype(np.float32)
        r = x - centres[nearest(x, centres)[:, 0]]
        at = encode(r, own).astype(np.int64) + np.arange(parts) * codes_n
        return at.ravel(), r.reshape(len(r) * parts, width)

    books = _lloyd(sample, books.reshape(parts * codes_n, width), assign, dim, rounds).astype(np.float32).reshape(parts, codes_n, width)
    probes = min(probes, len(centres))
    member_blocks, query_blocks = _blocks(sample, centres, probes, dim, max(share, 1e-12))
    scratch.drop("sample")

    def blocked(near: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, list, member block, query block, is a member) of every copy of a row: a member goes to all query blocks of its list, a query to all member blocks of each list it probes."""
        rows, at = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
        spread = tb.mix(ids.view(np.uint64) + np.uint64(1))
        out = []
        for member, rows_, lists_ in ((True, np.arange(len(near)), near[:, 0]), (False, rows, at)):
            times = (query_blocks if member else member_blocks)[lists_]
            copy = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            rows_, lists_ = np.repeat(rows_, times), np.repeat(lists_, times)
            own = (spread[rows_] % (member_blocks if member else query_blocks)[lists_].astype(np.uint64)).astype(np.int64)
            out.append((rows_, lists_, own if member else copy, copy if member else own, np.full(len(rows_), member)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x = _matrix(part.column(1), dim)
                near = nearest(x, centres, probes)
                r = x - centres[near[:, 0]]
                code = encode(r, books)
                error = np.sqrt(((r - decode(code, books)) ** 2).sum(1)).astype(np.float64)
                rows, lists_, mb, qb, member = blocked(near, part.column(0).to_numpy())
                offsets = np.concatenate([[0], np.cumsum(np.where(member, parts, 0))]).astype(np.int32)
                codes = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(code[rows[member]].tobytes())])
                at = pa.array(rows)
                yield pa.record_batch(
                    [pa.array(lists_.astype(np.int32)), pa.array(mb.astype(np.int32)), pa.array(qb.astype(np.int32)), part.column(0).take(at), part.column(1).take(at), codes, pa.array(np.where(member, error[rows], -1.0))],
                    names=["list", "mb", "qb", "id", "vec", "code", "error"],
                )

    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def search(table: pa.Table) -> pa.Table:
        ids, x, error = table.column("id").to_numpy(), _matrix(table.column("vec"), dim), table.column("error").to_numpy()
        home = error >= 0
        out: list[tuple[np.ndarray, ...]] = []
        known, place_of = np.unique(ids, return_inverse=True)
        label = np.arange(len(known))
        if home.any() and not home.all():
            mine, theirs = np.flatnonzero(home), np.flatnonzero(~home)
            codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            # No member within the radius is lost to its code: it can seem farther by its own coding error at most.
            reach = (radius + error[mine] + 1e-3) ** 2
            centre = centres[table.column("list")[0].as_py()]
            block = max(1, 4_000_000 // len(mine))
            for lo in range(0, len(theirs), block):
                q = theirs[lo : lo + block]
                i, k = np.nonzero(table_distances(x[q] - centre, codes, books) <= reach)
                for at in range(0, len(i), 200_000):  # the exact cosines of a part of the candidates at a time
                    a, b = q[i[at : at + 200_000]], mine[k[at : at + 200_000]]
                    cosine = np.einsum("ij,ij->i", x[a].astype(np.float64), x[b].astype(np.float64))
                    good = (cosine >= threshold) & (ids[a] != ids[b])
                    a, b = a[good], b[good]
                    if whole:
                        out.append((np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), cosine[good]))
                    else:
                        label = united(label, place_of[a], place_of[b])
        if not whole:
            other = np.flatnonzero(label != np.arange(len(label)))
            out = [(known[label[other]], known[other], np.full(len(other), np.nan))]
        a, b, c = (np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": a, "b": b, "cosine": c})

    placed = vectors.mapInArrow(place, "list int, mb int, qb int, id long, vec binary, code binary, error double")
    found = placed.groupBy("list", "mb", "qb").applyInArrow(search, "a long, b long, cosine double")
    return found.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def _blocks(sample: DataFrame, centres: np.ndarray, probes: int, dim: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of members and of queries of each list, of about MEMBERS and QUERIES rows, by the sample's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, all_ = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
        for batch in batches:
            if batch.num_rows:
                near = nearest(_matrix(batch.column(1), dim), centres, probes)
                own += np.bincount(near[:, 0], minlength=len(centres))
                all_ += np.bincount(near.ravel(), minlength=len(centres))
        full = np.flatnonzero(all_)
        yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array(own[full]), pa.array(all_[full])], names=["list", "own", "all_"])

    counts = sample.mapInArrow(run, "list int, own long, all_ long").groupBy("list").agg(F.sum("own").alias("own"), F.sum("all_").alias("all_")).toArrow()
    blocks = np.ones((2, len(centres)), np.int64)
    at = counts["list"].to_numpy()
    blocks[0, at] = np.maximum(1, np.ceil(counts["own"].to_numpy() / share / MEMBERS)).astype(np.int64)
    blocks[1, at] = np.maximum(1, np.ceil(counts["all_"].to_numpy() / share / QUERIES)).astype(np.int64)
    return blocks[0], blocks[1]


def _first(vectors: DataFrame, n: int, dim: int) -> np.ndarray:
    """The n vectors of least id hash, as many as there are: starting centres."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(n).toArrow()
    return _matrix(rows.column("vec"), dim).astype(np.float64)


def near_groups(embeddings: DataFrame, threshold: float = 0.9, probes: int = 8, dim: int = 64, rounds: int = 4) -> DataFrame:
    """(vec_id, kept_id): every vector that has near copies of a lower id, with the least id of its group.

    A group is a component of the graph of pairs with a cosine of at least `threshold`. Equal unit vectors are one node
    from the start, so many copies cost no more than one. Of the rest, every vector is a query: it looks through
    the lists of its `probes` nearest of 2 sqrt(n) centres, by table-lookup distances to residual codes, and what may lie
    within the threshold has its exact cosine taken. Centres and codebooks are fitted to a bounded sample (near_pairs), all
    vectors are in the lists, and a long list is searched in blocks, so none has to fit into one task.

    Null, zero, infinite or NaN vectors, those of another dimension than `dim` and null ids are in no group. Rows that
    repeat an id are one node, whose vectors all count; of equal vectors the one of least id is kept, and an empty table
    has no row. Other columns aren't read.
    """
    scratch = Scratch(embeddings.sparkSession, "vectors")
    unit = scratch.save(embeddings.select(F.col("vec_id").cast("long").alias("id"), "embedding").where("id is not null").mapInArrow(_unit(dim), "id long, vec binary"), "unit")
    reps = scratch.save(unit.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec"), "reps")
    same = unit.join(reps.withColumnRenamed("id", "rep"), "vec").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    pairs = near_pairs(reps, scratch, threshold, probes, dim, rounds, whole=False).select("a", "b")
    edges = scratch.save(pairs.unionByName(same), "pairs")
    if not edges.limit(1).count():
        return edges.select(F.col("a").alias("vec_id"), F.col("b").alias("kept_id"))
    labels = components(edges, scratch, "groups")
    return labels.where("node <> label").select(F.col("node").alias("vec_id"), F.col("label").alias("kept_id"))
