"""Benchmark, metric and schedule queries; embeddings stand in for logits, parts for questions, events for losses."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import evaluate as ev
from ..operators import instructions as ins
from ..operators import metrics as mt
from .base import register, table, words_sql

Q = """q AS (
  SELECT p_partkey AS idx, 'Which is ' || p_name || '?' AS question, CASE WHEN p_size >= 5 THEN 'Of type ' || p_type WHEN p_size = 3 THEN '' END AS context,
    list_filter([p_brand, p_type, CASE WHEN p_size > 10 THEN 'size ' || p_size END, CASE WHEN p_size > 25 THEN 'big' ELSE '' END], lambda x: x IS NOT NULL AND x <> '') AS options,
    CASE WHEN p_size > 20 THEN ' B' ELSE 'a' END AS answer
  FROM part
)"""


def _questions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    options = F.array("p_brand", "p_type", F.when(F.col("p_size") > 10, F.concat(F.lit("size "), F.col("p_size").cast("string"))), F.when(F.col("p_size") > 25, "big").otherwise(""))
    return p.select(
        F.col("p_partkey").alias("idx"),
        F.concat(F.lit("Which is "), "p_name", F.lit("?")).alias("question"),
        F.when(F.col("p_size") >= 5, F.concat(F.lit("Of type "), "p_type")).when(F.col("p_size") == 3, "").alias("context"),
        F.filter(options, lambda x: x.isNotNull() & (x != "")).alias("options"),
        F.when(F.col("p_size") > 20, " B").otherwise("a").alias("answer"),
    )


LETTERS_SQL = "[" + ", ".join(f"'{x}'" for x in ins.LETTERS) + "]"
ORDERED = f"""{Q}, i AS (SELECT idx, unnest(generate_series(0, len(options) - 1)) AS i FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY md5('67:' || idx::VARCHAR || ':' || i::VARCHAR), i) - 1 AS place FROM i),
g AS (SELECT q.idx, question, context, ascii(lower(trim(answer))) - 97 AS want, string_agg({LETTERS_SQL}[place + 1] || ' ' || options[i + 1], chr(10) ORDER BY place) AS lines, string_agg(options[i + 1], '|' ORDER BY place) AS shuffled, count(*) AS n_options, coalesce(max(place) FILTER (i = ascii(lower(trim(answer))) - 97), -1) AS gold FROM q JOIN r USING (idx) GROUP BY ALL)"""


@register("mc_render", f"WITH {ORDERED} SELECT idx, '[inst] ' || coalesce(nullif(context, '') || chr(10), '') || question || ' [/inst]' || chr(10) || lines || '{ins.CUE}' AS prompt, n_options, gold FROM g")
def mc_render(spark, sf_dir):
    q = _questions(spark, sf_dir).withColumn("order", mt.option_order(F.size("options"), F.col("idx")))
    prompt = ins.choice_prompt(F.col("question"), F.col("context"), F.col("options"), F.col("order"))
    return q.select("idx", prompt.alias("prompt"), F.size("options").cast("long").alias("n_options"), ins.gold_place(F.col("answer"), F.col("order")).alias("gold"))


@register("mc_option_shuffle", f"WITH {ORDERED} SELECT idx, shuffled, gold FROM g")
def mc_option_shuffle(spark, sf_dir):
    q = _questions(spark, sf_dir).withColumn("order", mt.option_order(F.size("options"), F.col("idx")))
    shuffled = F.array_join(F.transform("order", lambda i: F.get("options", i)), "|")
    return q.select("idx", shuffled.alias("shuffled"), ins.gold_place(F.col("answer"), F.col("order")).alias("gold"))


def _logits(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("logits"))


L = "l AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS logits FROM embeddings)"


IDS = [3, 11, 7, 29, 40]
SHARES = ", ".join(f"count(*) FILTER (pred = {k}) / count(*) AS letter_pred_frac_{k}" for k in range(5))


@register("mc_letter_accuracy", f"WITH {L}, o AS (SELECT 2 + label % 4 AS n, label % 2 AS gold, [{', '.join(f'logits[{i + 1}]' for i in IDS)}][1:2 + label % 4] AS x FROM l), p AS (SELECT n, gold, list_position(x, list_max(x)) - 1 AS pred FROM o) SELECT count(*) FILTER (pred = gold) / count(*) AS letter_acc, round(avg(1.0::DOUBLE / n), 8) AS chance, {SHARES} FROM p")
def mc_letter_accuracy(spark, sf_dir):
    """The letters' logits are gathered by their ids; slots beyond a question's options can't win."""
    own = _logits(spark, sf_dir).select("logits", (F.col("label") % 2).alias("gold"), (2 + F.col("label") % 4).cast("int").alias("n_options"))
    return ev.letter_accuracy(own, IDS).withColumn("chance", F.round("chance", 8))


@register("mc_loglik_accuracy", f"WITH {L}, x AS (SELECT vec_id, label % (2 + vec_id % 3) AS gold, 2 + vec_id % 3 AS n, unnest(logits) AS v, generate_subscripts(logits, 1) - 1 AS i FROM l), t AS (SELECT *, CASE WHEN i < 8 THEN 0 WHEN i < 24 THEN 1 WHEN i < 40 THEN 2 ELSE 3 END AS option_ord FROM x), o AS (SELECT vec_id, gold, option_ord, round(avg(v), 9) AS score FROM t WHERE option_ord < n GROUP BY ALL), b AS (SELECT vec_id, any_value(gold) AS gold, count(*) AS n, arg_min(option_ord, {{'s': -score, 'o': option_ord}}) AS pred FROM o GROUP BY vec_id) SELECT count(*) FILTER (pred = gold) / count(*) AS acc, round(avg(1.0::DOUBLE / n), 8) AS chance FROM b")
def mc_loglik_accuracy(spark, sf_dir):
    """Options of unequal length and number by their mean score; of equals the first wins, and chance is the mean of one over the number."""
    n = 2 + F.col("vec_id") % 3
    x = _logits(spark, sf_dir).select("vec_id", (F.col("label") % n).alias("gold"), n.alias("n"), F.posexplode("logits").alias("i", "v"))
    i = F.col("i")
    x = x.withColumn("option_ord", F.when(i < 8, 0).when(i < 24, 1).when(i < 40, 2).otherwise(3)).where(F.col("option_ord") < F.col("n"))
    x = x.groupBy("vec_id", "option_ord").agg(F.max("gold").alias("gold"), F.round(F.avg("v"), 9).alias("logp"))
    return ev.option_accuracy(x.withColumnRenamed("vec_id", "idx")).withColumn("chance", F.round("chance", 8))


PPL = "round(exp(least(coalesce(sum({v}), 0) / greatest(count({v}), 1), 20.0::DOUBLE)), 6)"


def _ppl(value):
    return F.round(mt.perplexity(F.sum(value), F.count(value)), 6)


@register("ppl_weighted", f"SELECT event_type, count(*) AS n_tokens, {PPL.format(v='value / 10')} AS perplexity FROM events GROUP BY event_type")
def ppl_weighted(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n_tokens"), _ppl(F.col("value") / 10).alias("perplexity"))


@register("ppl_masked", f"SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n_scored, {PPL.format(v=chr(39).join(['CASE WHEN event_type = ', 'purchase', ' THEN value / 10 END']))} AS perplexity FROM events GROUP BY user_id HAVING count(*) > 1")
def ppl_masked(spark, sf_dir):
    scored = F.when(F.col("event_type") == "purchase", F.col("value") / 10)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count(scored).alias("n_scored"), _ppl(scored).alias("perplexity")).where("n > 1").drop("n")


@register("ppl_gap", f"SELECT *, round(ppl_dialect - ppl_standard, 5) AS gap FROM (SELECT {PPL.format(v=chr(39).join(['CASE WHEN event_type = ', 'click', ' THEN value / 10 END']))} AS ppl_dialect, {PPL.format(v=chr(39).join(['CASE WHEN event_type = ', 'view', ' THEN value / 10 END']))} AS ppl_standard FROM events)")
def ppl_gap(spark, sf_dir):
    side = lambda t: _ppl(F.when(F.col("event_type") == t, F.col("value") / 10))
    return table(spark, sf_dir, "events").agg(side("click").alias("ppl_dialect"), side("view").alias("ppl_standard")).withColumn("gap", F.round(F.col("ppl_dialect") - F.col("ppl_standard"), 5))


@register("ppl_both_real", f"WITH d AS (SELECT lang, {words_sql('text')} AS w FROM documents), p AS (SELECT lang, list_sum(list_transform(generate_series(2, least(len(w), 40)), lambda i: length(w[i]) / 8)) AS total, greatest(least(len(w), 40) - 1, 0) AS n FROM d) SELECT lang, sum(n)::BIGINT AS n_scored, round(exp(least(coalesce(sum(total), 0) / greatest(sum(n), 1), 20.0::DOUBLE)), 6) AS perplexity FROM p GROUP BY lang")
def ppl_both_real(spark, sf_dir):
    """Texts padded to 40 words: only real words with a real one before them are scored."""
    w = F.slice(tx.word_array(F.coalesce("text", F.lit(""))), 1, 40)
    padded = table(spark, sf_dir, "documents").select("lang", w.alias("w")).select("lang", F.concat(F.transform("w", lambda x: F.length(x) / 8), F.array_repeat(F.lit(9.0), 40 - F.size("w"))).alias("nll"), F.concat(F.transform("w", lambda x: F.lit(1)), F.array_repeat(F.lit(0), 40 - F.size("w"))).alias("real"))
    kept = padded.select("lang", ev.both_real(F.col("nll"), F.col("real")).alias("s"))
    sums = kept.groupBy("lang").agg(F.sum(F.size("s")).alias("n_scored"), F.sum(F.aggregate("s", F.lit(0.0), lambda a, x: a + x)).alias("total"))
    return sums.select("lang", "n_scored", F.round(mt.perplexity(F.col("total"), F.col("n_scored")), 6).alias("perplexity"))


@register("ppl_ignored_labels", f"WITH e AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN event_id % 1000 ELSE -100 END AS label, value / 10 AS nll FROM events) SELECT count(*) FILTER (label <> -100) AS tokens, round(exp(least(coalesce(sum(nll) FILTER (label <> -100), 0) / greatest(count(*) FILTER (label <> -100), 1), 20.0::DOUBLE)), 6) AS ppl FROM e")
def ppl_ignored_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("value") / 10).alias("nll"), F.when(F.col("event_type") == "purchase", F.col("event_id") % 1000).otherwise(F.lit(-100)).alias("label"))
    return ev.holdout_perplexity(e).withColumn("ppl", F.round("ppl", 6))


@register("ppl_owner_reply", "WITH e AS (SELECT user_id, event_type = 'purchase' AS own, value / 10 AS nll, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), u AS (SELECT user_id FROM e GROUP BY user_id HAVING count(*) > 1 AND bool_or(own)) SELECT count(nll) AS tokens, round(exp(least(coalesce(sum(nll), 0) / greatest(count(nll), 1), 20.0::DOUBLE)), 6) AS ppl FROM e WHERE own AND i > 1 AND user_id IN (SELECT user_id FROM u)")
def ppl_owner_reply(spark, sf_dir):
    """Conversations of two tokens or more, one of which counts."""
    parts = F.array_sort(F.collect_list(F.struct("event_id", (F.col("value") / 10).alias("x"), (F.col("event_type") == "purchase").cast("int").alias("m"))))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(parts.alias("p")).select(F.transform("p", lambda c: c["x"]).alias("nll"), F.transform("p", lambda c: c["m"]).alias("mask"))
    return ev.reply_perplexity(e).withColumn("ppl", F.round("ppl", 6))


@register("tok_compression", f"SELECT lang, sum(length(text))::BIGINT AS n_chars, round(sum(length(text)) / greatest(sum(len(regexp_split_to_array(text, ' '))), 1), 8) AS chars_per_token FROM documents GROUP BY lang")
def tok_compression(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.length("text")).alias("n_chars"), F.sum(F.size(F.split("text", " "))).alias("n"))
    return d.select("lang", "n_chars", F.round(F.col("n_chars") / F.greatest("n", F.lit(1)), 8).alias("chars_per_token"))


@register("logit_argmax", f"WITH {L} SELECT vec_id, list_position(logits, list_max(logits)) - 1 AS pred FROM l".replace("list_position(logits, list_max(logits)) - 1", "(list_position(logits, list_max(logits)) - 1)::BIGINT"))
def logit_argmax(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", mt.argmax(F.col("logits")).alias("pred"))


X = f"{L}, x AS (SELECT vec_id, unnest(logits) AS logit, generate_subscripts(logits, 1) - 1 AS pos FROM l)"


def _long(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", F.posexplode("logits").alias("pos", "logit")).withColumn("pos", F.col("pos").cast("long"))


@register("logit_topk", f"WITH {X} SELECT vec_id, pos, logit FROM (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY logit DESC) AS r FROM x) WHERE r <= 5")
def logit_topk(spark, sf_dir):
    return mt.top_k(_long(spark, sf_dir), "vec_id", "logit", 5)


@register("logit_topp", f"WITH {X}, p AS (SELECT *, round(exp(10 * logit) / sum(exp(10 * logit)) OVER (PARTITION BY vec_id), 9) AS prob FROM x), m AS (SELECT *, sum(prob) OVER (PARTITION BY vec_id ORDER BY prob DESC, pos ROWS UNBOUNDED PRECEDING) - prob AS before FROM p) SELECT vec_id, count(*) AS n_kept FROM m WHERE before <= 0.9::DOUBLE GROUP BY vec_id")
def logit_topp(spark, sf_dir):
    e = F.exp(10 * F.col("logit"))
    p = _long(spark, sf_dir).withColumn("prob", F.round(e / F.sum(e).over(Window.partitionBy("vec_id")), 9))
    return mt.top_p(p, "vec_id", "prob", "pos", 0.9).groupBy("vec_id").agg(F.count("*").alias("n_kept"))


@register("logit_logsoftmax", f"WITH {L}, m AS (SELECT vec_id, label, logits, list_max(logits) AS top FROM l) SELECT vec_id, label, round(logits[label + 1] - top - ln(list_sum(list_transform(logits, lambda x: exp(x - top)))), 8) AS logp FROM m")
def logit_logsoftmax(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", "label", F.round(F.get(mt.log_softmax(F.col("logits")), F.col("label")), 8).alias("logp"))


@register("logit_sample", f"""WITH {L}, x AS (SELECT vec_id, temperature, unnest(logits) / temperature AS v, generate_subscripts(logits, 1) - 1 AS i FROM l, (VALUES (0.5::DOUBLE), (1.0::DOUBLE)) t(temperature)),
n AS (SELECT vec_id, temperature, i, v - ln(-ln(({tx.uniform_sql("vec_id::VARCHAR || '@' || temperature::VARCHAR || '/' || i::VARCHAR")} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)) AS s FROM x)
SELECT vec_id, temperature, arg_min(i, {{'s': -s, 'i': i}}) AS token FROM n GROUP BY vec_id, temperature""")
def logit_sample(spark, sf_dir):
    """A keyed draw for each vector at two temperatures: prompts crossed with temperatures."""
    t = spark.createDataFrame([(0.5,), (1.0,)], "temperature double")
    both = _logits(spark, sf_dir).crossJoin(F.broadcast(t))
    return both.select("vec_id", "temperature", mt.gumbel_draw(F.transform("logits", lambda x: x / F.col("temperature")), F.concat_ws("@", "vec_id", "temperature")).alias("token"))


DAYS = "d AS (SELECT date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS step, round(avg(value), 6) AS val_loss FROM events GROUP BY 1)"


@register("metric_best_so_far", f"WITH {DAYS}, b AS (SELECT *, min(val_loss) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM d) SELECT step, val_loss, best_before, best_before IS NULL OR val_loss < best_before AS improved FROM b")
def metric_best_so_far(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy(F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("step")).agg(F.round(F.avg("value"), 6).alias("val_loss"))
    return mt.improved(d, "step", "val_loss")


@register("metric_log_window", "WITH w AS (SELECT event_id // 100 AS window_no, count(*) AS n, round(avg(value), 6) AS loss, count(*) * 131072 / greatest(sum(value), 1e-9) AS rate, (max(event_id) + 1) * 131072 AS tokens_seen FROM events GROUP BY 1) SELECT window_no, n, loss, round(rate, 4) AS tokens_per_sec, round(rate * 252000000::DOUBLE / 2.39e14, 10) AS mfu, tokens_seen FROM w")
def metric_log_window(spark, sf_dir):
    """Means of 100 steps with their throughput; an event's value stands in for a step's seconds."""
    from ..streaming import log_windows

    e = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("step"), F.col("value").alias("loss"), F.col("value").alias("seconds"))
    w = log_windows(e, 100, 131072, 252e6, 2.39e14)
    return w.withColumns({"loss": F.round("loss", 6), "tokens_per_sec": F.round("tokens_per_sec", 4), "mfu": F.round("mfu", 10)})


@register("lr_schedule", "SELECT step, round(CASE WHEN step < 200 THEN 0.0006::DOUBLE * (step + 1) / 200 ELSE 0.00006::DOUBLE + 0.5 * (0.0006::DOUBLE - 0.00006::DOUBLE) * (1 + cos(pi() * least(1.0::DOUBLE, (step - 200) / 9300))) END, 12) AS lr FROM generate_series(0, 9600) g(step)")
def lr_schedule(spark, sf_dir):
    return spark.range(9601).select(F.col("id").alias("step"), F.round(mt.learning_rate(F.col("id"), 9500, 0.0006, 200), 12).alias("lr"))


@register("eval_cadence", "SELECT step, every, at_zero, CASE WHEN step = 0 THEN at_zero ELSE every > 0 AND step % greatest(every, 1) = 0 END AS due FROM generate_series(0, 300) g(step), (VALUES (100, true), (100, false), (0, true), (7, false)) v(every, at_zero)")
def eval_cadence(spark, sf_dir):
    s = spark.range(301).select(F.col("id").alias("step"))
    parts = [s.select("step", F.lit(e).alias("every"), F.lit(z).alias("at_zero"), mt.due(F.col("step"), e, z).alias("due")) for e, z in ((100, True), (100, False), (0, True), (7, False))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("flops_budget", "SELECT width, layers, (6 * params + 12 * layers * width * 1024)::BIGINT AS flops_per_token, (64 * ceil(floor(8 * width / 3) / 64))::BIGINT AS gated, (131072 * steps)::BIGINT AS tokens_seen FROM (VALUES (512, 8, 42000000::BIGINT, 5700), (768, 12, 110000000::BIGINT, 9500)) v(width, layers, params, steps)")
def flops_budget(spark, sf_dir):
    v = spark.createDataFrame([(512, 8, 42_000_000, 5700), (768, 12, 110_000_000, 9500)], "width int, layers int, params long, steps int")
    return v.select("width", "layers", mt.flops_per_token(F.col("params"), F.col("layers"), F.col("width"), F.lit(1024).cast("long")).alias("flops_per_token"), mt.gated_width(F.col("width")).alias("gated"), (F.lit(131072).cast("long") * F.col("steps")).alias("tokens_seen"))


@register("logit_last_real", f"WITH {X}, r AS (SELECT vec_id, pos, logit FROM x WHERE logit > 0) SELECT vec_id, arg_max(logit, pos) AS logit FROM r GROUP BY vec_id")
def logit_last_real(spark, sf_dir):
    from ..operators.evaluate import last_real

    return last_real(_long(spark, sf_dir), "vec_id", "pos", "logit", "logit > 0")


@register("metric_rank_loss", "WITH t AS (SELECT event_id // 500 AS step, round(sum(value) / greatest(count(*), 1), 6) AS val_loss FROM events GROUP BY 1), b AS (SELECT *, min(val_loss) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM t) SELECT step, val_loss, best IS NULL OR val_loss < best AS improved FROM b")
def metric_rank_loss(spark, sf_dir):
    """Sums of each rank first, then over ranks."""
    from ..operators.evaluate import loss_of_ranks

    e = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 500).alias("step"), F.col("event_type").alias("rank"))
    return loss_of_ranks(e.agg(F.sum("value").alias("loss_sum"), F.count("*").alias("n"))).withColumn("val_loss", F.round("val_loss", 6))
