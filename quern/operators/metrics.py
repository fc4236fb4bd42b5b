"""Scores as queries: accuracy against chance, option scores, perplexity, truncation of distributions, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

CAP = 20.0


def perplexity(total: Column, n: Column) -> Column:
    """exp of the mean over all tokens, not of the means of parts; 1 without tokens; the exponent is capped."""
    return F.exp(F.least(F.coalesce(total, F.lit(0.0)) / F.greatest(n, F.lit(1)), F.lit(CAP)))


def argmax(values: Column) -> Column:
    """Place of the greatest value, from 0; of equals the first."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def gathered(values: Column, ids: list[int], n: Column | None = None) -> Column:
    """The values at the ids, in their order; with n only the first n of them, so that slots that a question lacks can't win."""
    picked = F.transform(F.array(*[F.lit(i) for i in ids]), lambda i: F.get(values, i))
    return picked if n is None else F.slice(picked, F.lit(1), n)


def log_softmax(values: Column) -> Column:
    top = F.array_max(values)
    norm = F.log(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top))) + top
    return F.transform(values, lambda x: x - norm)


def top_k(scores: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """All values that reach the k-th greatest of their group: ties stay."""
    return scores.withColumn("__r", F.rank().over(Window.partitionBy(group).orderBy(F.desc(value)))).where(F.col("__r") <= k).drop("__r")


def top_p(scores: DataFrame, group: str, probability: str, tie: str, p: float) -> DataFrame:
    """Values in falling order as long as the sum before them is at most p."""
    w = Window.partitionBy(group).orderBy(F.desc(probability), tie).rowsBetween(Window.unboundedPreceding, 0)
    return scores.withColumn("mass_before", F.sum(probability).over(w) - F.col(probability)).where(F.col("mass_before") <= p)


def gumbel_draw(values: Column, key: Column, temperature: float = 1.0, seed: int = 67) -> Column:
    """A draw from softmax(values / temperature): the greatest of values plus keyed Gumbel noise."""
    noisy = F.transform(values, lambda x, i: x / temperature - F.log(-F.log((tx.uniform(F.concat(key.cast("string"), F.lit("/"), i.cast("string")), seed) + 0.5) / 2**32)))
    return argmax(noisy)


def improved(series: DataFrame, step: str, value: str) -> DataFrame:
    """Adds best_before and improved: whether a value is below all before it. A series is a row for each step of one run."""
    w = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(value).over(w)
    return series.withColumn("best_before", best).withColumn("improved", F.col(value).isNotNull() & (best.isNull() | (F.col(value) < best)))


def option_order(n: Column, key: Column, seed: int = 67) -> Column:
    """The options' places in an order that is fixed for each question."""
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(":"), i.cast("string"))).alias("h"), i.alias("i")))
    return F.transform(F.array_sort(at), lambda x: x["i"])


def learning_rate(step: Column, max_steps: int, peak: float, warmup: int, floor: float = 0.1) -> Column:
    """Linear to the peak, then a cosine down to floor * peak, and that from max_steps on."""
    low = peak * floor
    part = F.least(F.lit(1.0), (step - warmup) / max(1, max_steps - warmup))
    return F.when(step < warmup, peak * (step + 1) / warmup).otherwise(low + 0.5 * (peak - low) * (1 + F.cos(F.pi() * part)))


def due(step: Column, every: int, at_zero: bool) -> Column:
    return F.when(step == 0, F.lit(at_zero)).otherwise(F.lit(every > 0) & (step % max(1, every) == 0))


def throughput(tokens: Column, seconds: Column, flops: Column | float, peak: float) -> tuple[Column, Column]:
    """Tokens a second, and the share of the machine's peak that they use."""
    rate = tokens / F.greatest(seconds, F.lit(1e-9))
    return rate, rate * flops / F.lit(float(peak))


def flops_per_token(params: Column, layers: Column, width: Column, block: Column) -> Column:
    return 6 * params + 12 * layers * width * block


def gated_width(width: Column) -> Column:
    """8/3 of the width, rounded up to a multiple of 64."""
    return (64 * F.ceil(F.floor(8 * width / 3) / 64)).cast("long")
