"""Vector bin packing of examples under limits on tokens, segments and loss-bearing tokens, by the dot-product heuristic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch
from .tokens import TOKENIZER, counted, encode

LIMITS = (4096, 32, 2048)
GROUP = 4096
#: A conversation's turns are parted at each multiple of 2**TURN_BITS of their number.
TURN_BITS = 12


def pack(demand: np.ndarray, limits=LIMITS) -> np.ndarray:
    """The bin of each item. While items are left, a bin is opened, and as long as one fits it takes the item whose demand has the greatest dot product with the bin's room, both as shares of the limits and weighted by the items' total demand; of equals the first. Items of equal demand are one kind, so a step looks at each kind once."""
    limit = np.asarray(limits, float)
    out = np.full(len(demand), -1, np.int64)
    if not len(demand):
        return out
    kinds, inverse = np.unique(demand, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    order = np.argsort(inverse, kind="stable")
    left = np.bincount(inverse, minlength=len(kinds))
    taken = np.concatenate([[0], np.cumsum(left)[:-1]])
    share = kinds / limit
    weight = share.T @ left
    share_w = share * (weight / max(weight.sum(), 1e-12))
    total, current = int(left.sum()), -1
    live = np.arange(len(kinds))
    while total:
        current += 1
        room = limit.copy()
        fits = live
        while True:
            fits = fits[(left[fits] > 0) & (kinds[fits] <= room).all(1)]
            if not len(fits):
                break
            k = fits[int(np.argmax(share_w[fits] @ (room / limit)))]
            out[order[taken[k]]] = current
            taken[k] += 1
            left[k] -= 1
            total -= 1
            room -= kinds[k]
        live = live[left[live] > 0]
    return out


def cut(turns: list[tuple[int, bool]], limits=LIMITS) -> list[tuple[int, int]]:
    """(tokens, loss) of the pieces of an example, which is a list of (tokens, bears loss): each piece is as long as both limits let it be, so an example within them is one piece."""
    pieces, tokens, loss = [], 0, 0
    for n, scored in turns:
        while n > 0:
            room = limits[0] - tokens
            if scored:
                room = min(room, limits[2] - loss)
            if room <= 0:
                pieces.append((tokens, loss))
                tokens = loss = 0
                continue
            step = min(n, room)
            n, tokens, loss = n - step, tokens + step, loss + step * scored
    return [*pieces, (tokens, loss)] if tokens else pieces


def _after_earlier_parts(pieces: DataFrame) -> DataFrame:
    """pieces with piece and start counted on from the earlier parts of their example. A part is a row here, so an example's order isn't that of its pieces."""
    sums = pieces.groupBy("example_id", "part").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))
    before = Window.partitionBy("example_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = sums.where("example_id is not null").select("example_id", "part", F.sum("n").over(before).alias("__n"), F.sum("tokens").over(before).alias("__tokens")).where("__n > 0")
    both = pieces.join(later, ["example_id", "part"], "left")
    piece, start = F.col("piece") + F.coalesce("__n", F.lit(0)), F.col("start") + F.coalesce("__tokens", F.lit(0))
    return both.select("grp", "example_id", "part", piece.cast("int").alias("piece"), start.alias("start"), "n_tokens", "n_loss")


def packed(examples: DataFrame, limits=LIMITS, group: int = GROUP) -> DataFrame:
    """(example_id, piece, start, n_tokens, n_loss, bin_id, slot): every example placed.

    examples has example_id and turns, an array of structs (n, scored), and may have part: the rows of an example with
    different parts follow each other in order of part, and no piece spans two, so an example of any length is never
    one row or one task. An example beyond a limit is cut into pieces that follow each other; each piece is a segment, the
    n_tokens tokens from `start` on of its example. Groups of about `group` rows, by the hash of their id, part and turns,
    are packed on their own, as many groups as there is data for; bin_id is text 'group-bin'. slot is the place
    in the bin, in order of example and piece. An example without tokens has no row; rows that repeat an id (and part)
    are each placed, counting from 0 each; a null id is an id of its own kind, and its rows have no later parts.
    """
    spark = examples.sparkSession
    scratch = Scratch(spark, "packing")
    parted = "part" in examples.columns
    part = F.col("part").cast("long") if parted else F.lit(0).cast("long")
    rows = scratch.save(examples.select(F.col("example_id").cast("long").alias("example_id"), part.alias("part"), "turns"), "examples")
    groups = max(1, -(-rows.count() // group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts_, turns = (batch.column(k).to_pylist() for k in (1, 2, 3))
            out = []
            for i, (e, part_, t) in enumerate(zip(ids, parts_, turns)):
                start = 0
                for k, (n, loss) in enumerate(cut([(x["n"] or 0, bool(x["scored"])) for x in t or [] if x], limits)):
                    out.append((batch.column(0)[i].as_py(), e, part_, k, start, n, loss))
                    start += n
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], names=["grp", "example_id", "part", "piece", "start", "n_tokens", "n_loss"])

    spread = F.pmod(F.xxhash64("example_id", "part", "turns"), F.lit(groups)).cast("long")
    pieces_ = rows.select(spread.alias("grp"), "example_id", "part", "turns").mapInArrow(run, "grp long, example_id long, part long, piece int, start long, n_tokens long, n_loss long")
    if parted:
        pieces_ = _after_earlier_parts(scratch.save(pieces_, "pieces"))
    pieces_ = pieces_.drop("part")

    def place(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["example_id", "piece", "n_tokens", "n_loss"], kind="stable", na_position="last").reset_index(drop=True)
        at = pack(np.stack([table.n_tokens, np.ones(len(table), np.int64), table.n_loss], 1), limits)
        slot = pd.Series(at).groupby(at).cumcount().astype("int32")
        return pd.DataFrame({"example_id": table.example_id.astype("Int64"), "piece": table.piece, "start": table.start, "n_tokens": table.n_tokens, "n_loss": table.n_loss, "bin_id": [f"{table.grp[0]}-{b}" for b in at], "slot": slot})

    # A number of partitions of its own: rows are few bytes but much work, so merging small partitions would leave it to one task.
    parts = min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups // 16))
    return pieces_.repartition(parts, "grp").groupBy("grp").applyInPandas(place, "example_id long, piece int, start long, n_tokens long, n_loss long, bin_id string, slot int")


def sequences(placed: DataFrame, examples: DataFrame) -> DataFrame:
    """(bin_id, tokens, segments, loss): what a trainer reads, a row for each bin.

    examples has example_id, tokens and loss, an array of as many booleans, and must have a row for each id; the pieces of
    `placed` are cut out of it. segments has the slot of each token, so attention can be kept within a segment. Bins are
    bounded by their limits, so a row is never large. Pieces of ids that examples lacks or of a null id are left out.
    """
    piece = placed.join(examples, "example_id")
    part = lambda c: F.slice(c, F.col("start") + 1, F.col("n_tokens"))
    cells = piece.groupBy("bin_id").agg(F.array_sort(F.collect_list(F.struct("slot", part("tokens").alias("tokens"), part("loss").alias("loss")))).alias("p"))
    flat = lambda name: F.flatten(F.transform("p", lambda x: x[name]))
    return cells.select("bin_id", flat("tokens").alias("tokens"), F.flatten(F.transform("p", lambda x: F.array_repeat(x["slot"], F.size(x["tokens"])))).alias("segments"), flat("loss").alias("loss"))


def tokens_of_conversations(conversations: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(example_id, tokens, loss) of each conversation: its turns in order, as examples_of_conversations counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x.tolist() for x in encode([t or "" for t in batch.column(3).to_pylist()], path)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.list_(pa.int32()))], names=["conv_id", "turn", "role", "ids"])

    slim = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    coded = slim.mapInArrow(run, "conv_id long, turn long, role string, ids array<int>")
    scored = F.coalesce(F.col("role") == "assistant", F.lit(False))
    # In the order of examples_of_conversations: equal turns by their number of tokens, then scored ones last.
    turns = F.array_sort(F.collect_list(F.struct("turn", F.size("ids").alias("n"), scored.alias("scored"), "ids")))
    held = coded.groupBy(F.col("conv_id").alias("example_id")).agg(turns.alias("t"))
    return held.select("example_id", F.flatten(F.transform("t", lambda x: x["ids"])).alias("tokens"), F.flatten(F.transform("t", lambda x: F.array_repeat(x["scored"], F.size(x["ids"])))).alias("loss"))


def examples_of_conversations(conversations: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(example_id, part, turns): the conversations' turns in order with their token counts; those of the assistant bear loss.

    Turns are parted at each multiple of 4,096 of their number, so a conversation of any number of turns is rows of bounded
    length. Turns of one number are ordered by their count; a null or empty text has no tokens, a null role bears no loss, a
    null turn is the first of part 0, and a row without an id is a conversation of its own.
    """
    slim = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    scored = F.coalesce(F.col("role") == "assistant", F.lit(False))
    own = counted(slim.where("conv_id is not null"), path).withColumn("part", F.shiftright(F.coalesce("turn", F.lit(0)), TURN_BITS))
    held = own.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "n", scored.alias("scored")))).alias("t"))
    held = held.select(F.col("conv_id").alias("example_id"), "part", F.transform("t", lambda x: F.struct(x["n"].alias("n"), x["scored"].alias("scored"))).alias("turns"))
    # Rows without an id have no order among them: their parts only spread them over groups.
    lone = counted(slim.where("conv_id is null").withColumn("part", F.xxhash64("turn", "role", "text")), path)
    return held.unionByName(lone.select(F.col("conv_id").alias("example_id"), "part", F.array(F.struct("n", scored.alias("scored"))).alias("turns")))


def examples_of_documents(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """An example for each row of docs: one turn, all of whose tokens bear loss. A null or empty text has no tokens; rows that repeat are an example each."""
    slim = docs.select(F.col("doc_id").cast("long").alias("example_id"), "text")
    return counted(slim, path).select("example_id", F.array(F.struct("n", F.lit(True).alias("scored"))).alias("turns"))
