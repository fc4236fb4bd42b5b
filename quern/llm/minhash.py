"""MinHash near-dedup: circulant signatures, banding, exact Jaccard verification, groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textbytes as tb
from .shared import Scratch, sent_whole_if_small

UNIVERSE_BITS = 20


def permutations(seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The two permutations of the universe: the first scatters the shingles, the second is the one that is shifted; it's given twice over so that each shift is a slice."""
    rng, size = np.random.default_rng(seed), 1 << UNIVERSE_BITS
    scatter, turned = rng.permutation(size).astype(np.int32), rng.permutation(size).astype(np.int32)
    return scatter, np.concatenate([turned, turned])


def signatures(keys: np.ndarray, first: np.ndarray, size: int, perms: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Coordinate k of a text: the least value of the second permutation, shifted k places round, over its scattered shingles. Texts without shingles aren't in the result."""
    scatter, turned = perms
    place = scatter[(keys & np.uint64((1 << UNIVERSE_BITS) - 1)).astype(np.int64)]
    begins = first[:-1][np.diff(first) > 0]
    out = np.empty((len(begins), size), np.int32)
    for k in range(size):
        shift = (1 << UNIVERSE_BITS) - k if k else 0
        out[:, k] = np.minimum.reduceat(np.take(turned[shift:], place), begins)
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    n, size = signature.shape
    rows = signature.reshape(n, bands, size // bands).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for r in range(rows.shape[2]):
        key = tb.mix(key * np.uint64(0x2545F4914F6CDD1D) + rows[:, :, r])
    return key.view(np.int64)


def _sketch(bands: int, rows: int, shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perms = permutations(seed)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for w in tb.words(texts):
                keys, first = tb.shingles(w, shingle)
                counts = np.diff(first)
                full = counts > 0
                if not full.any():
                    continue
                begins = first[:-1][full]
                spread = tb.mix(keys ^ np.uint64(0xD6E8FEB86659FD93))
                one, two = np.add.reduceat(keys, begins), np.add.reduceat(spread, begins)
                found = band_keys(signatures(keys, first, bands * rows, perms), bands)
                yield pa.record_batch(
                    [
                        ids.take(pa.array(w.rows[full])),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        pa.array(counts[full].astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, bands, dtype=np.int32)), pa.array(found.ravel())),
                    ],
                    names=["id", "set1", "set2", "n", "bands"],
                )

    return run


def word_runs(text: str, n: int) -> set[bytes]:
    parts = text.encode().lower().split()
    return {b" ".join(parts[i : i + n]) for i in range(max(1, len(parts) - n + 1))} if parts else set()


def _slices(batch: pa.RecordBatch, columns: list[int], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about `most` bytes; a longer text has a part of its own."""
    total = np.concatenate([[0], np.cumsum(sum(np.diff(tb.raw(batch.column(c))[0]) for c in columns))])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def shared_runs(a: pa.Array, b: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of texts the numbers of their different word runs, and of those that both have."""
    (ka, fa), (kb, fb) = tb.all_shingles(a, shingle), tb.all_shingles(b, shingle)
    na, nb = np.diff(fa), np.diff(fb)
    row = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
    key = np.concatenate([ka, kb])
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    # A text has a run once, so one that follows itself is in both.
    twice = (row[1:] == row[:-1]) & (key[1:] == key[:-1])
    return na, nb, np.bincount(row[1:][twice], minlength=len(na))


def _verify(threshold: float, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, [2, 3]):
                na, nb, both = shared_runs(part.column(2), part.column(3), shingle)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(both >= threshold * (na + nb - both))], names=["a", "b", "same"])

    return run


CELLS = 1 << 18


def _cells(keys: np.ndarray) -> np.ndarray:
    return (tb.mix(keys ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(CELLS - 1)).astype(np.int64)


def _cell_counts(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in _slices(batch, [0]):
                total += np.bincount(_cells(tb.all_shingles(part.column(0), shingle)[0]), minlength=CELLS)
        full = np.flatnonzero(total)
        yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array(total[full])], names=["cell", "n"])

    return run


def _prefixes(threshold: float, shingle: int, commonness: np.ndarray):
    """For each text the beginning of its runs in order of rarity, in which any text at least as similar as the threshold and no longer must have one of its first `n_index`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, [1]):
                keys, first = tb.all_shingles(part.column(1), shingle)
                n = np.diff(first)
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((keys, commonness[_cells(keys)], row))
                keys = keys[order].view(np.int64)
                # A pair of similarity t has t * (the longer) runs in common, and 2t / (1 + t) * (the shorter).
                probe = np.where(n > 0, n - np.ceil(threshold * n - 1e-9) + 1, 0).astype(np.int64)
                index = np.where(n > 0, n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9) + 1, 0).astype(np.int32)
                place = np.arange(len(keys)) - np.repeat(first[:-1], n)
                kept = keys[place < probe[row]]
                runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(probe)]).astype(np.int32)), pa.array(kept))
                yield pa.record_batch([part.column(0), runs, pa.array(index), pa.array(n.astype(np.int32))], names=["rep", "runs", "n_index", "n"])

    return run


def _apart_pairs(apart: DataFrame, texts: DataFrame, scratch: Scratch, threshold: float, shingle: int) -> DataFrame:
    """(a, b) of every two members of a band, in different components, that can reach the threshold.

    Instead of all pairs of a band those are joined that share one of their rarest runs (prefix filter), at a place
    from which as many can follow as they need (positional filter), and whose sizes allow it. All three leave out
    only pairs below the threshold. How common a run is comes from counts of CELLS hashed cells, a bounded table; any
    order would do, rare runs first leave the fewest pairs.
    """
    apart = scratch.save(apart.select("band", "rep", "label"), "apart")
    own = texts.join(sent_whole_if_small(scratch.save(apart.select(F.col("rep").alias("id")).distinct(), "apart-ids"), F.lit(24)), "id", "left_semi")
    counts = own.select("text").mapInArrow(_cell_counts(shingle), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    commonness = np.zeros(CELLS, np.int64)
    commonness[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    runs = own.select(F.col("id").alias("rep"), "text").mapInArrow(_prefixes(threshold, shingle, commonness), "rep long, runs array<long>, n_index int, n int")
    cells = apart.join(scratch.save(runs, "runs"), "rep").select("band", "rep", "label", "n_index", "n", F.posexplode("runs").alias("at", "run"))
    cells = cells.select(F.xxhash64("band", "run").alias("cell"), "rep", "label", "n_index", "n", "at")
    long = cells.select("cell", F.col("rep").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("at").alias("ax"))
    short = cells.where("at < n_index").select("cell", F.col("rep").alias("y"), F.col("label").alias("ly"), F.col("n").alias("ny"), F.col("at").alias("ay"))
    need = threshold / (1 + threshold) * (F.col("nx") + F.col("ny")) - 1e-9
    able = (F.col("ny") <= F.col("nx")) & (F.col("ny") >= threshold * F.col("nx") - 1e-9) & (F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay")) >= need)
    return long.join(short, "cell").where((F.col("lx") != F.col("ly")) & able).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label): every node of the edges (a, b) with the least node that it's connected to. Each round points nodes at the least label among their neighbours', then at their label's label; the table is written each round, so lineage stays short."""
    both = scratch.save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    step = 0
    labels = scratch.save(labels, f"{name}-{step}")
    while True:
        step += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = scratch.save(lower.join(up, "label", "left").select("node", "old", F.coalesce("top", "label").alias("label")), f"{name}-{step}")
        changed = new.where("label <> old").limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        labels = new.select("node", "label")
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels


def near_groups(docs: DataFrame, threshold: float = 0.5, bands: int = 40, rows: int = 4, shingle: int = 3, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept_id): every document that has near copies of a lower id, with the least id of its group.

    A group is a component of the graph that joins two documents when they share a band of their circulant MinHash
    signatures and the exact Jaccard similarity of their sets of word runs (`shingle` words, ASCII letters in lower
    case) is at least `threshold`. Texts with the same set (equal in two sums of 64-bit hashes and in size) are one
    node from the start. Of the other candidates, three rounds verify one pair for each component that a band holds; pairs whose
    ends are already connected can't change a component and aren't verified. The last round takes every pair of a shared
    band whose ends are still apart and that sizes and rare runs don't rule out, so groups are those of the whole
    candidate graph; no band is capped, and none is put into one task or paired with itself in full.

    Null or empty texts and null ids belong to no group. Rows that repeat an id are one document: it has the union of
    their candidates. A text of fewer than `shingle` words has one run. Of equal texts the one of least id is kept. Other columns aren't read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    schema = "id long, set1 long, set2 long, n int, bands array<long>"
    sketch = scratch.save(text.mapInArrow(_sketch(bands, rows, shingle, seed), schema), "sketch")
    same = ["set1", "set2", "n"]
    groups = scratch.save(sketch.groupBy(*same).agg(F.min(F.struct("id", "bands")).alias("top")).select(*same, F.col("top.id").alias("rep"), F.col("top.bands").alias("bands")), "groups")
    members = scratch.save(sketch.join(groups.select(*same, "rep"), same).where("id <> rep").select("id", "rep").distinct(), "members")
    scratch.drop("sketch")

    # Counts with sums before the shuffle, and a join that may split a hot band, in place of a window over it.
    placed = groups.select("rep", F.explode("bands").alias("band"))
    full = placed.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band")
    shared = scratch.save(placed.join(full, "band").select("band", "rep"), "shared")
    nodes = scratch.save(shared.select(F.col("rep").alias("id")).distinct(), "nodes")
    texts = scratch.save(text.join(sent_whole_if_small(nodes, F.lit(24)), "id", "left_semi"), "texts")

    labels = tested = verified = None
    for step in range(4):
        placed = shared.withColumn("label", F.col("rep")) if labels is None else shared.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        placed = scratch.save(placed, f"placed-{step}")
        several = placed.groupBy("band").agg(F.min(F.struct("label", "rep")).alias("lead"), F.max("label").alias("most")).where("lead.label < most").select("band", "lead")
        if step < 3:
            # One pair for each component that a band holds beside its least: as many as there are members at most.
            heads = placed.groupBy("band", "label").agg(F.min("rep").alias("rep"))
            pairs = heads.join(several, "band").where("label <> lead.label").select(F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b"))
            if step == 0:
                # A member's least neighbour over all its bands is enough to begin with.
                pairs = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        else:
            pairs = _apart_pairs(placed.join(several.select("band"), "band"), texts, scratch, threshold, shingle)
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, f"pairs-{step}")
        scratch.drop(f"placed-{step}")
        if pairs.limit(1).count() == 0:
            continue
        rows_ = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        checked = rows_.select("a", "b", "text_a", "text_b").mapInArrow(_verify(threshold, shingle), "a long, b long, same boolean")
        checked = scratch.save(checked, f"checked-{step}")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = checked.where("same").select("a", "b")
        verified = found if verified is None else verified.unionByName(found)
        labels = components(verified, scratch, f"labels-{step}")
    for name in ("texts", "shared", "nodes", "groups", "apart", "apart-ids", "runs", *(f"{what}-{k}" for what in ("pairs", "checked") for k in range(4))):
        scratch.drop(name)
    if labels is None:
        return members.select(F.col("id").alias("doc_id"), F.col("rep").alias("kept_id"))
    twins = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("label", "rep").alias("kept_id"))
    return twins.unionByName(labels.where("node <> label").select(F.col("node").alias("id"), F.col("label").alias("kept_id"))).groupBy(F.col("id").alias("doc_id")).agg(F.min("kept_id").alias("kept_id")).where("doc_id <> kept_id")


#: Keys of rows that have no id of their own lie from here on, above all ids.
NO_ID = 1 << 62


def drop_near_copies(docs: DataFrame, **params) -> DataFrame:
    """docs without the rows that near_groups finds a near copy of with a lower id, all columns as they were.

    Rows that repeat an id with the same text are one document, and the one of least hash over all columns stays. Rows
    that share an id but not a text, and rows without an id, are documents of their own: each goes only if its own text
    has a kept near copy, and comes after those with an id. Null and empty texts are no copies of others; rows with neither id nor text all stay. An empty
    table stays empty. Ids lie below NO_ID.

    Decisions are made on ids and hashes; texts are moved only for candidates, unless there are too many ids to send to them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-copies")
    own = docs.withColumns({"__q_id": F.col("doc_id").cast("long"), "__q_hash": F.xxhash64("doc_id", "text")})
    again = own.groupBy("__q_id").agg(F.count("*").alias("n"), (F.min("__q_hash") < F.max("__q_hash")).alias("__q_unlike"))
    again = again.where("n > 1 or __q_id is null").select(F.col("__q_id").alias("__q_again"), (F.col("__q_unlike") | F.col("__q_id").isNull()).alias("__q_unlike"))
    again = scratch.save(again, "again")
    if again.limit(1).count():
        sent, same = sent_whole_if_small(again, F.lit(24)), F.col("__q_id").eqNullSafe(F.col("__q_again"))
        marked = own.join(sent, same).withColumn("__q_key", F.when(F.col("__q_unlike"), F.lit(NO_ID) + F.expr(f"__q_hash & {NO_ID - 1}L")).otherwise(F.col("__q_id"))).drop("__q_again", "__q_unlike")
        # Only rows that share an id are put in order.
        unlike = F.when(F.col("__q_id").isNull() & (F.coalesce("text", F.lit("")) == ""), F.monotonically_increasing_id())
        whole = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
        marked = marked.withColumn("__q_turn", F.row_number().over(Window.partitionBy("__q_key", unlike).orderBy(whole))).where("__q_turn = 1").drop("__q_turn")
        own = own.join(sent, same, "left_anti").withColumn("__q_key", F.col("__q_id")).unionByName(marked)
    else:
        own = own.withColumn("__q_key", F.col("__q_id"))
    copies = near_groups(own, **{"id_col": "__q_key", **params}).select(F.col("doc_id").alias("__q_copy"))
    copies = sent_whole_if_small(scratch.save(copies, "copies"), F.lit(24))
    kept = own.join(copies, F.col("__q_key") == F.col("__q_copy"), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
