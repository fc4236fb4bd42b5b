"""A token stream in blocks: positions, blocks, shifted labels, masks, replay budgets, and a loader's assignments."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

IGNORED = -100


def offsets(docs: DataFrame, order: str, size: str, rows_per_range: int = 100_000, bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """Adds start: the sum of the sizes of all documents before, by an order that is a number and unique.

    Two steps instead of one window over everything: sizes are summed for each range of the order; ranges, a row each,
    are summed up in turn; then a document needs only its own range. The ranges follow the spread of the order, which
    for ids that are given out in turn is even. bounds, the order's least and greatest value and about how many rows
    there are, saves a look at docs; they only say where ranges are cut.
    """
    low, high, n = bounds or docs.agg(F.min(order), F.max(order), F.count("*")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) * rows_per_range // max(1, n)))
    cut = docs.withColumn("__range", F.floor((F.col(order) - F.lit(low or 0)) / width))
    sums = cut.groupBy("__range").agg(F.sum(size).alias("__sum"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("__in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return local.join(sums, "__range").withColumn("start", F.col("__base") + F.col("__in")).select(*docs.columns, "start")


def ranked(rows: DataFrame, at: str, tie: str, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Adds rank: a row's place from 0 in order of (at, tie), `at` being hexadecimal digits spread evenly, as a hash's are.

    Rows are counted for each of the 16**digits beginnings of `at`, the counts are summed up, and a row needs only those of
    its own beginning, so no order is put into one task. `by` ranks each of its values alone.
    """
    by = by or []
    cut = rows.withColumn("__cell", F.substring(at, 1, digits))
    counts = cut.groupBy(*by, "__cell").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy(*by, "__cell").orderBy(at, tie)) - 1
    return cut.withColumn("__in", inside).join(counts, [*by, "__cell"]).withColumn("rank", F.col("__base") + F.col("__in")).drop("__cell", "__in", "__base")


def placed(docs: DataFrame, order: str, tokens: str, n: str | None = None, bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """docs that have tokens, with start, the position of their first one in the stream of all, and end, that behind their last. `n` names a column with their number, where that is cheaper to get than the tokens themselves: sizes are summed in a pass of their own."""
    sized = docs.withColumn("__size", F.coalesce(F.col(n) if n else F.size(tokens), F.lit(0)).cast("long"))
    # Documents without tokens go last: a filter before would make the tokens of all once more.
    return offsets(sized, order, "__size", bounds=bounds).where("__size > 0").withColumn("end", F.col("start") + F.col("__size")).drop("__size")


def stream(docs: DataFrame, order: str, tokens: str, mask: str | None = None, n: str | None = None) -> DataFrame:
    """(pos, token[, scored]): the documents' tokens in order, each at its position in the whole stream: a row for each token, for sinks and readers that want them so. What works on blocks takes the documents themselves."""
    own = placed(docs, order, tokens, n)
    cells = F.arrays_zip(tokens, mask) if mask else F.col(tokens)
    long = own.select("start", F.posexplode(cells).alias("i", "cell"))
    if mask:
        return long.select((F.col("start") + F.col("i")).alias("pos"), F.col(f"cell.{tokens}").alias("token"), (F.col(f"cell.{mask}") == 1).alias("scored"))
    return long.select((F.col("start") + F.col("i")).alias("pos"), F.col("cell").alias("token"))


def blocks(docs: DataFrame, order: str, tokens: str, size: int, mask: str | None = None, n: str | None = None, bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """(block_id, inputs, labels): block k has the tokens from k * size on of the documents' stream, its labels are those one further; what is left over goes.

    A document's array is cut at the borders of blocks, so a block moves as a few slices and not as a row for each token.
    Its last label is the first token of the next block, so a slice that begins at a border reaches one further back. With a
    mask the labels that aren't scored are IGNORED.
    """
    own = placed(docs, order, tokens, n, bounds)
    label = F.zip_with(tokens, mask, lambda t, m: F.when(m == 1, t).otherwise(F.lit(IGNORED))) if mask else F.lit(None)
    first, last = F.greatest(F.ceil(F.col("start") / size) - 1, F.lit(0)), F.floor((F.col("end") - 1) / size)

    def piece(k: Column) -> Column:
        low, high = F.greatest(F.col("start"), k * size), F.least(F.col("end"), (k + 1) * size + 1)
        part = lambda c: F.slice(c, (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
        cells = [part(F.col(tokens)).alias("t")] + ([part(F.col("__label")).alias("l")] if mask else [])
        return F.struct(k.alias("k"), low.alias("low"), *cells)

    # The slices are made before they become rows, so that no row carries its whole document.
    cut = own.withColumn("__label", label).select(F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    held = cut.groupBy(F.col("p.k").alias("block_id")).agg(F.array_sort(F.collect_list(F.struct("p.low", "p.t", *(["p.l"] if mask else [])))).alias("c"))
    flat = lambda name: F.flatten(F.transform("c", lambda x: x[name]))
    whole = held.select("block_id", flat("t").alias("t"), flat("l" if mask else "t").alias("l")).where(F.size("t") == size + 1)
    return whole.select("block_id", F.slice("t", 1, size).alias("inputs"), F.slice("l", 2, size).alias("labels"))


def shifted_labels(docs: DataFrame, order: str, tokens: str, n_tokens: str | None = None, bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """(pos, token, label): each token of the stream with the one after it; the very last has none and goes. Only a document's last token looks beyond its own array, to the document that starts where it ends."""
    own = placed(docs, order, tokens, n_tokens, bounds)
    n = F.size(tokens)
    inner = own.select("start", F.posexplode(F.arrays_zip(F.slice(tokens, F.lit(1), n - 1).alias("t"), F.slice(tokens, F.lit(2), n - 1).alias("l"))).alias("i", "c"))
    inner = inner.select((F.col("start") + F.col("i")).alias("pos"), F.col("c.t").alias("token"), F.col("c.l").alias("label"))
    last = own.select(F.col("end"), F.element_at(tokens, -1).alias("token"))
    first = own.select(F.col("start").alias("end"), F.element_at(tokens, 1).alias("label"))
    return inner.unionByName(last.join(first, "end").select((F.col("end") - 1).alias("pos"), "token", "label"))


def count_blocks(n_tokens: int, size: int) -> int:
    if n_tokens < size + 1:
        raise ValueError(f"{n_tokens} tokens don't fill one block of {size}")
    return (n_tokens - 1) // size


def replay(docs: DataFrame, key: str, size: str, target: int, batch: int = 64, seed: int = 67) -> DataFrame:
    """Whole batches of documents in shuffled order until the sum of sizes reaches the target: a batch stays if those before it fall short."""
    at = ranked(docs.withColumn("__at", tx.shuffle_order(F.col(key), seed)), "__at", key).withColumn("batch_no", F.floor(F.col("rank") / batch))
    totals = at.groupBy("batch_no").agg(F.sum(size).alias("__sum"))
    last = docs.count() // batch
    kept = offsets(totals, "batch_no", "__sum", bounds=(0, last, last + 1)).where(F.col("start") < target).select("batch_no")
    return at.join(kept, "batch_no").select(*docs.columns, "batch_no")


def replay_target(primary: int, fraction: float) -> int:
    return int(primary * fraction / max(1 - fraction, 1e-9))


def slice_start(n_tokens: int, n: int, seed: int = 67) -> int:
    """Where a slice of n tokens begins, drawn evenly by the seed from all places at which it fits."""
    return int(md5(f"{seed}:slice".encode()).hexdigest()[:8], 16) * max(n_tokens - n - 1, 1) >> 32


def contiguous_slice(docs: DataFrame, order: str, tokens: str, start: int, n: int, n_tokens: str | None = None) -> DataFrame:
    """(pos, tokens): the parts of documents that lie in the n tokens of the stream from start on; pos is a part's position. A document's array is cut, and only those that overlap the slice are."""
    own = placed(docs, order, tokens, n_tokens).where((F.col("start") < start + n) & (F.col("end") > start))
    low, high = F.greatest(F.col("start"), F.lit(start)), F.least(F.col("end"), F.lit(start + n))
    # Expressions above a filter may be looked at before it, so they hold for all rows.
    part = F.slice(tokens, F.greatest(low - F.col("start") + 1, F.lit(1)).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    return own.where(high > low).select(low.alias("pos"), part.alias("tokens"))


def epoch_order(block_ids: DataFrame, epochs: Column, seed: int = 67) -> DataFrame:
    """(epoch, block_id, place): every block once an epoch, in an order that depends on seed + epoch."""
    both = block_ids.select("block_id").withColumn("epoch", F.explode(epochs))
    key = F.md5(F.concat((F.col("epoch") + seed).cast("string"), F.lit(":"), F.col("block_id").cast("string")))
    return ranked(both.withColumn("__at", key), "__at", "block_id", ["epoch"]).select("epoch", "block_id", F.col("rank").cast("long").alias("place"))


def cursor_after(steps: int, n_blocks: int, each: int, position: int = 0) -> int:
    """A loader's position after some steps of `each` blocks: what is left of an epoch when a step doesn't fit is passed over. With another batch or number of ranks it goes on from where it stands."""
    left = (n_blocks - position % n_blocks) // each
    if steps <= left:
        return position + steps * each
    per_epoch, epoch, more = n_blocks // each, position // n_blocks + 1, steps - left
    if not per_epoch:
        raise ValueError(f"{n_blocks} blocks are fewer than one step's {each}")
    over = (more - 1) // per_epoch
    return (epoch + over) * n_blocks + (more - over * per_epoch) * each


def assignments(order: DataFrame, n_blocks: int, batch: int, world: int, first_step: int = 0, position: int = 0) -> DataFrame:
    """(epoch, step, rank, slot, block_id) from a step on: each step takes batch * world blocks, rank r those at r, r + world, ...; what is left at an epoch's end is passed over, so every batch has the same size. Steps count from a cursor's position, which may lie within an epoch and come from another number of ranks."""
    each = batch * world
    per_epoch = n_blocks // each
    if not per_epoch:
        raise ValueError(f"{n_blocks} blocks are fewer than one step's {each}")
    e0, o0 = divmod(position, n_blocks)
    left = (n_blocks - o0) // each
    here = F.col("epoch") == e0
    at = F.col("place") - F.when(here, F.lit(o0)).otherwise(F.lit(0))
    used = order.where(((F.col("epoch") > e0) & (F.col("place") < per_epoch * each)) | (here & (F.col("place") >= o0) & (F.col("place") < o0 + left * each)))
    step = F.when(here, F.floor(at / each)).otherwise(left + (F.col("epoch") - e0 - 1) * per_epoch + F.floor(at / each))
    inside = at % each
    return used.select("epoch", step.alias("step"), (inside % world).alias("rank"), F.floor(inside / world).alias("slot"), "block_id").where(F.col("step") >= first_step)
