"""Metrics as named, scheduled queries whose failure doesn't stop the others."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import Registry
from .blocks import IGNORED
from .metrics import argmax, gathered, perplexity

LOG = logging.getLogger(__name__)
#: Name -> what it computes of its table of scores; built_evaluators makes Evaluators of a run's settings.
EVALUATORS = Registry("evaluator")


@dataclass(frozen=True)
class Evaluator:
    """compute makes one row of numbers from the scores; every and at_zero say at which steps."""

    name: str
    compute: Callable[[DataFrame], DataFrame]
    every: int = 0
    at_zero: bool = False

    def due(self, step: int) -> bool:
        return self.at_zero if step == 0 else self.every > 0 and step % self.every == 0


def built_evaluators(settings: dict[str, dict] | None) -> list[Evaluator]:
    """The evaluators that a run's settings name, {name: {freq, run_at_0, other options}}; every 500 steps and at step 0 unless told otherwise. An unknown name is an error, no settings are no evaluators."""
    out = []
    for name, given in (settings or {}).items():
        options = dict(given or {})
        every, at_zero = options.pop("freq", 500), options.pop("run_at_0", True)
        compute = EVALUATORS[name]
        out.append(Evaluator(name, lambda scores, f=compute, o=options: f(scores, **o), every, at_zero))
    return out


@EVALUATORS.add("mmlu_letter")
def letter_accuracy(scores: DataFrame, ids: list[int] | None = None, slots: int = 5) -> DataFrame:
    """Of (logits, gold, n_options): the greatest of the options' letters' logits, against the gold place and chance, and how often each place is chosen. ids are the letters' tokens; without, logits has one for each slot."""
    best = argmax(gathered(F.col("logits"), ids or list(range(slots)), F.col("n_options")))
    own = scores.select("gold", "n_options", best.alias("pred"))
    return own.agg((F.count_if(F.col("pred") == F.col("gold")) / F.greatest(F.count("*"), F.lit(1))).alias("letter_acc"), F.coalesce(F.avg(1.0 / F.col("n_options")), F.lit(0.0)).alias("chance"), *[(F.count_if(F.col("pred") == k) / F.greatest(F.count("*"), F.lit(1))).alias(f"letter_pred_frac_{k}") for k in range(slots)])


@EVALUATORS.add("mmlu_loglikelihood")
def option_accuracy(scores: DataFrame) -> DataFrame:
    """Of (idx, option_ord, gold, logp), a row for each token of each option's text: the option of the greatest mean, of equals the first, against the gold one and chance, the mean of one over the number of options."""
    each = scores.groupBy("idx", "option_ord").agg(F.max("gold").alias("gold"), F.avg("logp").alias("score"))
    best = each.groupBy("idx").agg(F.max_by("option_ord", F.struct("score", -F.col("option_ord"))).alias("pred"), F.max("gold").alias("gold"), F.count("*").alias("n"))
    return best.agg((F.count_if(F.col("pred") == F.col("gold")) / F.greatest(F.count("*"), F.lit(1))).alias("acc"), F.coalesce(F.avg(1.0 / F.col("n")), F.lit(0.0)).alias("chance"))


@EVALUATORS.add("flores")
def parallel_perplexity(scores: DataFrame, dialect: str = "dialect", standard: str = "standard") -> DataFrame:
    """Of (side, nll): the perplexities of two sides of a parallel text, and how far apart they are."""
    side = lambda name: perplexity(F.sum(F.when(F.col("side") == name, F.col("nll"))), F.count_if(F.col("side") == name))
    return scores.agg(side(dialect).alias("ppl_dialect"), side(standard).alias("ppl_standard")).withColumn("gap", F.col("ppl_dialect") - F.col("ppl_standard"))


@EVALUATORS.add("chat_holdout")
def holdout_perplexity(scores: DataFrame) -> DataFrame:
    """Of (nll, label): perplexity over all tokens whose label isn't IGNORED."""
    own = scores.where(F.col("label") != IGNORED)
    return own.agg(perplexity(F.sum("nll"), F.count("nll")).alias("ppl"), F.count("*").alias("tokens"))


@EVALUATORS.add("owner_reply")
def reply_perplexity(scores: DataFrame) -> DataFrame:
    """Of (nll, mask), arrays of each conversation: perplexity over the owner's tokens of conversations that can be scored, and how many these are."""
    own = scores.where(scorable(F.col("nll"), F.col("mask")))
    # The score at a place is of the token there, so the first has none.
    kept = own.select(F.explode(F.filter(F.zip_with("nll", "mask", lambda x, m: F.when(m == 1, x)), lambda x, i: (i > 0) & x.isNotNull())).alias("x"))
    return kept.agg(perplexity(F.sum("x"), F.count("x")).alias("ppl"), F.count("x").alias("tokens"))


@EVALUATORS.add("generation")
def generated_lengths(samples: DataFrame) -> DataFrame:
    """Of (prompt, temperature, text): how many samples there are and how long they are; the texts themselves go to a table (sinks.append_samples)."""
    return samples.agg(F.count("*").alias("samples"), F.avg(F.length("text")).alias("mean_chars"))


def scorable(ids: Column, mask: Column) -> Column:
    """At least two tokens, one of which counts; looked at before anything is cut off."""
    return (F.size(ids) > 1) & F.exists(mask, lambda m: m == 1)


def both_real(values: Column, real: Column) -> Column:
    """The scores of places whose token is real and has one before it: of padded rows neither padding nor the first token is scored."""
    return F.filter(F.zip_with(values, real, lambda v, r: F.when(r == 1, v)), lambda v, i: (i > 0) & v.isNotNull())


def run_due(evaluators: list[Evaluator], scores: DataFrame, step: int) -> DataFrame | None:
    """(step, metric, value) of all evaluators that are due; one that fails is logged and left out. None if there is none."""
    out = None
    for e in evaluators:
        if not e.due(step):
            continue
        try:
            row = e.compute(scores)
            names = ", ".join(f"'{e.name}/{c}', cast(`{c}` as double)" for c in row.columns)
            part = row.selectExpr(f"stack({len(row.columns)}, {names}) as (metric, value)").select(F.lit(step).cast("long").alias("step"), "metric", "value")
            values = part.collect()  # one row for each metric
        except Exception:
            LOG.warning("evaluator %s failed at step %d", e.name, step, exc_info=True)
            continue
        made = scores.sparkSession.createDataFrame(values, "step long, metric string, value double")
        out = made if out is None else out.unionByName(made)
    return out


def last_real(rows: DataFrame, group: str, position: str, value: str, real: str) -> DataFrame:
    """The value at each group's last position that isn't padding."""
    return rows.where(real).groupBy(group).agg(F.max_by(value, position).alias(value))


def ignore_padding(labels: Column, pad: int) -> Column:
    return F.transform(labels, lambda x: F.when(x == pad, F.lit(IGNORED)).otherwise(x))


def has_owner_turn(text: Column) -> Column:
    return F.contains(text, F.lit("<|turn|>ME:"))


def at_index(rows: DataFrame, k: int, index: str = "idx") -> DataFrame:
    """The example of one index."""
    return rows.where(F.col(index) == k)


def first_examples(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by an order: a prefix that is the same every time."""
    return rows.orderBy(order).limit(n)


def running_tokens(steps: DataFrame, step: str, per_step: int) -> DataFrame:
    return steps.withColumn("tokens_seen", F.col(step) * F.lit(per_step).cast("long"))


def loss_of_ranks(parts: DataFrame) -> DataFrame:
    """Validation loss by step of (step, rank, loss_sum, n): the sum over all ranks' tokens, not the mean of their means, and whether it is the lowest so far."""
    total = parts.groupBy("step").agg((F.sum("loss_sum") / F.greatest(F.sum("n"), F.lit(1))).alias("val_loss"))
    best = F.min("val_loss").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    return total.withColumn("improved", best.isNull() | (F.col("val_loss") < best))
