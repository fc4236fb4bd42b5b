"""Token-stream queries: positions, blocks, masks, mixtures, loader assignments."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import blocks as bl
from ..operators import instructions as ins
from .base import TOKEN_SQL, register, table, token_id, words_sql
from .messages import V

B = 256
T = f"""d AS (SELECT doc_id, {words_sql('text')} AS w FROM documents), l AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
t AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, {TOKEN_SQL.format(w='word')} AS token FROM l)"""


def _docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", tx.word_array(F.coalesce("text", F.lit(""))).alias("words"), tx.word_count(F.col("text")).alias("n"))


def _ids(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.transform("words", token_id).alias("tokens"), "n")


def _join(c):
    return F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))


@register("pack_positions", f"WITH d AS (SELECT doc_id, len({words_sql('text')})::BIGINT AS n FROM documents) SELECT doc_id, n, (sum(n) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS start FROM d")
def pack_positions(spark, sf_dir):
    return bl.offsets(_docs(spark, sf_dir).select("doc_id", "n"), "doc_id", "n")


BLOCKS = f"""{T}, x AS (SELECT pos // {B} AS block_id, pos, token, lead(token) OVER (ORDER BY pos) AS label FROM t),
g AS (SELECT block_id, md5(string_agg(token::VARCHAR, ',' ORDER BY pos)) AS inputs, md5(string_agg(label::VARCHAR, ',' ORDER BY pos)) AS labels, count(label) AS n FROM x GROUP BY block_id)"""


@register("pack_blocks", f"WITH {BLOCKS} SELECT block_id, inputs, labels FROM g WHERE n = {B}")
def pack_blocks(spark, sf_dir):
    return bl.blocks(_ids(spark, sf_dir), "doc_id", "tokens", B, n="n").select("block_id", _join("inputs").alias("inputs"), _join("labels").alias("labels"))


@register("pack_meta", f"WITH {T}, n AS (SELECT count(*) AS n_tokens FROM t) SELECT n_tokens, (n_tokens - 1) // {B} AS n_blocks, {B} AS block_size, 65536 AS vocabulary, round(((n_tokens - 1) // {B}) * {B} / greatest(n_tokens, 1), 4) AS used FROM n")
def pack_meta(spark, sf_dir):
    n = _docs(spark, sf_dir).agg(F.sum("n").alias("n_tokens"))
    k = F.floor((F.col("n_tokens") - 1) / B)
    return n.select("n_tokens", k.alias("n_blocks"), F.lit(B).alias("block_size"), F.lit(65536).alias("vocabulary"), F.round(k * B / F.greatest("n_tokens", F.lit(1)), 4).alias("used"))


MASKED = f"""{V}, cells AS (
  SELECT conv_id, turn, list_concat(['<|turn|>', speaker || ':'], {words_sql('content')}, ['<|end|>']) AS w, speaker = 'ASSISTANT' AS s FROM v
), long AS (
  SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) AS i, s FROM cells
  UNION ALL SELECT DISTINCT conv_id, -2, '<s>', 1, false FROM v UNION ALL SELECT DISTINCT conv_id, -1, '<|conv|>', 1, false FROM v UNION ALL SELECT DISTINCT conv_id, 1000000, '</s>', 1, false FROM v
), st AS (
  SELECT row_number() OVER (ORDER BY conv_id, turn, i) - 1 AS pos, conv_id, {TOKEN_SQL.format(w='word')} AS token, s AND i > 2 AS scored FROM long
)"""


def _masked(spark, sf_dir):
    m = ins.masked_tokens(ins.usable_turns(table(spark, sf_dir, "conversations")))
    return m.select("conv_id", F.transform("tokens", token_id).alias("tokens"), "mask")


def _bounds(spark, sf_dir):
    """Of the conversations' ids, with the number of turns for that of conversations: close enough for ranges, and no conversation has to be built for it."""
    return tuple(table(spark, sf_dir, "conversations").agg(F.min("conv_id"), F.max("conv_id"), F.count("*")).first())


@register("pack_label_shift", f"WITH {MASKED} SELECT pos, token, lead(token) OVER (ORDER BY pos) AS label FROM st QUALIFY label IS NOT NULL")
def pack_label_shift(spark, sf_dir):
    return bl.shifted_labels(_masked(spark, sf_dir), "conv_id", "tokens", bounds=_bounds(spark, sf_dir))


@register("pack_mask_labels", f"WITH {MASKED}, x AS (SELECT pos // 64 AS block_id, pos, token, lead(CASE WHEN scored THEN token ELSE -100 END) OVER (ORDER BY pos) AS label FROM st) SELECT block_id, md5(string_agg(token::VARCHAR, ',' ORDER BY pos)) AS inputs, md5(string_agg(label::VARCHAR, ',' ORDER BY pos)) AS labels, count(*) FILTER (label <> -100) AS n_scored FROM x GROUP BY block_id HAVING count(label) = 64")
def pack_mask_labels(spark, sf_dir):
    b = bl.blocks(_masked(spark, sf_dir), "conv_id", "tokens", 64, "mask", bounds=_bounds(spark, sf_dir))
    return b.select("block_id", _join("inputs").alias("inputs"), _join("labels").alias("labels"), F.size(F.filter("labels", lambda x: x != bl.IGNORED)).cast("long").alias("n_scored"))


REPLAY = f"""pr AS (SELECT sum(len({words_sql('text')})) AS p FROM conversations), tg AS (SELECT floor(p * 0.25::DOUBLE / greatest(0.75::DOUBLE, 1e-9))::BIGINT AS target FROM pr),
r AS (SELECT doc_id, len({words_sql('text')})::BIGINT AS n, (row_number() OVER (ORDER BY md5('67:' || doc_id::VARCHAR), doc_id) - 1) // 64 AS batch_no FROM documents),
bt AS (SELECT batch_no, coalesce(sum(sum(n)) OVER (ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM r GROUP BY batch_no),
kept AS (SELECT doc_id, n, batch_no FROM r JOIN bt USING (batch_no), tg WHERE spent < target)"""


def _replayed(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").agg(F.sum(tx.word_count(F.col("text")))).first()[0] or 0
    docs = _docs(spark, sf_dir).select("doc_id", "n")
    return bl.replay(docs, "doc_id", "n", bl.replay_target(p, 0.25))


@register("pack_replay_budget", f"WITH {REPLAY} SELECT doc_id, n, batch_no FROM kept")
def pack_replay_budget(spark, sf_dir):
    return _replayed(spark, sf_dir)


@register("pack_mixture", f"WITH {REPLAY}, m AS (SELECT 'primary' AS part, count(*) AS n_docs, sum(len({words_sql('text')}))::BIGINT AS n_tokens FROM conversations UNION ALL SELECT 'replay', count(*), sum(n)::BIGINT FROM kept) SELECT *, round(n_tokens / greatest(sum(n_tokens) OVER (), 1), 4) AS fraction FROM m")
def pack_mixture(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.lit("primary").alias("part"), tx.word_count(F.col("text")).alias("n"))
    both = c.unionByName(_replayed(spark, sf_dir).select(F.lit("replay").alias("part"), "n"))
    m = both.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))
    # Two rows.
    return m.withColumn("fraction", F.round(F.col("n_tokens") / F.greatest(F.sum("n_tokens").over(Window.partitionBy()), F.lit(1)), 4))


@register("pack_slice", f"WITH {T}, n AS (SELECT (('0x' || substr(md5('67:slice'), 1, 8))::BIGINT * greatest(count(*) - 5001, 1)) >> 32 AS start FROM t) SELECT pos, token FROM t, n WHERE pos BETWEEN start AND start + 4999")
def pack_slice(spark, sf_dir):
    """5,000 tokens from a seeded place on: replay text as the stream has it."""
    docs = _ids(spark, sf_dir)
    n = _docs(spark, sf_dir).agg(F.sum("n")).first()[0] or 0
    parts = bl.contiguous_slice(docs, "doc_id", "tokens", bl.slice_start(n, 5000), 5000, "n")
    return parts.select("pos", F.posexplode("tokens").alias("i", "token")).select((F.col("pos") + F.col("i")).alias("pos"), "token")


@register("pack_separators", f"WITH d AS (SELECT doc_id, {words_sql('text')} AS w FROM documents) SELECT doc_id, len(w) + 1 AS n, md5(array_to_string(list_concat(list_transform(w, lambda x: {TOKEN_SQL.format(w='x')}::VARCHAR), ['2']), ',')) AS ids FROM d")
def pack_separators(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.concat(F.transform("words", token_id), F.array(F.lit(2))).alias("ids"))
    return d.select("doc_id", F.size("ids").cast("long").alias("n"), _join("ids").alias("ids"))


@register("pack_prompt_labels", f"WITH p AS (SELECT q.conv_id, q.turn, len({words_sql('q.text')}) AS np, list_transform({words_sql('a.text')}, lambda x: {TOKEN_SQL.format(w='x')}::VARCHAR) AS aw FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant') SELECT conv_id, turn, md5(array_to_string((list_concat(list_transform(generate_series(1, np), lambda x: '-100'), aw, ['2']))[1:1024], ',')) AS labels FROM p")
def pack_prompt_labels(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    ids = F.transform(tx.word_array(F.col("text")), token_id)
    q = c.where("role = 'user'").select("conv_id", "turn", ids.alias("q"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), ids.alias("a"))
    return q.join(a, ["conv_id", "turn"]).select("conv_id", "turn", _join(ins.prompt_labels(F.col("q"), F.col("a"), 2)).alias("labels"))


@register("tok_padded", f"WITH d AS (SELECT doc_id, list_transform({words_sql('text')}, lambda x: {TOKEN_SQL.format(w='x')}::VARCHAR) AS w FROM documents) SELECT doc_id, least(len(w), 1024) AS n_real, md5(array_to_string(list_concat(w[1:1024], list_transform(generate_series(1, greatest(0, 1024 - len(w))), lambda x: '0')), ',')) AS ids FROM d")
def tok_padded(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.transform("words", token_id).alias("ids"))
    return d.select("doc_id", F.least(F.size("ids"), F.lit(1024)).cast("long").alias("n_real"), _join(ins.padded(F.col("ids"), 0)).alias("ids"))


E_SQL = "e AS (SELECT epoch, p_partkey AS block_id, row_number() OVER (PARTITION BY epoch ORDER BY md5((epoch + 67)::VARCHAR || ':' || p_partkey::VARCHAR), p_partkey) - 1 AS place FROM part, generate_series(0, 2) g(epoch)), n AS (SELECT count(*) // 8 AS per FROM part)"
A_SQL = f"WITH {E_SQL} SELECT epoch, epoch * per + place // 8 AS step, (place % 8) % 2 AS rank, (place % 8) // 2 AS slot, block_id FROM e, n WHERE place < per * 8"


def _order(spark, sf_dir):
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("block_id"))
    return bl.epoch_order(ids, F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))


@register("load_epoch_permutation", f"WITH {E_SQL} SELECT epoch, block_id, place FROM e")
def load_epoch_permutation(spark, sf_dir):
    return _order(spark, sf_dir)


@register("load_rank_stripes", A_SQL)
def load_rank_stripes(spark, sf_dir):
    return bl.assignments(_order(spark, sf_dir), table(spark, sf_dir, "part").count(), 4, 2)


@register("load_resume", f"SELECT * FROM ({A_SQL}) WHERE step >= 5")
def load_resume(spark, sf_dir):
    return bl.assignments(_order(spark, sf_dir), table(spark, sf_dir, "part").count(), 4, 2, 5)


#: Five steps of 4 blocks on 2 ranks, then 3 ranks.
RESIZED = f"""WITH {E_SQL.replace("count(*) // 8 AS per", "count(*) AS nb, count(*) // 12 AS per")},
c AS (SELECT nb, per, nb // 8 AS was, CASE WHEN 5 <= nb // 8 THEN 40 ELSE (1 + (5 - nb // 8 - 1) // (nb // 8)) * nb + (5 - nb // 8 - (5 - nb // 8 - 1) // (nb // 8) * (nb // 8)) * 8 END AS pos FROM n),
p AS (SELECT *, pos // nb AS e0, pos % nb AS o0, (nb - pos % nb) // 12 AS left_ FROM c)
SELECT epoch, CASE WHEN epoch = e0 THEN (place - o0) // 12 ELSE left_ + (epoch - e0 - 1) * per + place // 12 END AS step,
  CASE WHEN epoch = e0 THEN (place - o0) % 12 ELSE place % 12 END % 3 AS rank, CASE WHEN epoch = e0 THEN (place - o0) % 12 ELSE place % 12 END // 3 AS slot, block_id
FROM e, p WHERE (epoch > e0 AND place < per * 12) OR (epoch = e0 AND place >= o0 AND place < o0 + left_ * 12)"""


@register("load_resume_resized", RESIZED)
def load_resume_resized(spark, sf_dir):
    n = table(spark, sf_dir, "part").count()
    return bl.assignments(_order(spark, sf_dir), n, 4, 3, position=bl.cursor_after(5, n, 8))


@register("tok_piece_encode")
def tok_piece_encode(spark, sf_dir):
    """Ids by a vocabulary of pieces with byte fallback."""
    from ..functions.tokenize import encode_pieces

    return table(spark, sf_dir, "documents").select("doc_id", encode_pieces(F.col("text")).alias("ids"))


@register("tok_piece_compression")
def tok_piece_compression(spark, sf_dir):
    """Characters for each token, of every language."""
    from ..functions.tokenize import count_pieces

    # A condition on the count would be pushed down, and every text encoded twice.
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("lang", F.length("text").alias("c"), count_pieces(F.col("text")).alias("n"))
    return d.groupBy("lang").agg(F.sum("c").cast("long").alias("n_chars"), (F.sum("c") / F.greatest(F.sum("n"), F.lit(1))).alias("chars_per_token"))


@register("tok_bpe_encode")
def tok_bpe_encode(spark, sf_dir):
    """Sub-word ids of each document; encoded in batches, so there is no SQL for it."""
    from ..functions.tokenize import encode

    return table(spark, sf_dir, "documents").select("doc_id", encode(F.col("text")).alias("ids"))


@register("tok_owner_mask")
def tok_owner_mask(spark, sf_dir):
    """Tokens of rendered conversations that lie in a purchase run's text: spans found in the text, tokens by their offsets; a mark of the template is one token."""
    from ..functions import tokenize as tk
    from ..operators import messages as msg
    from .messages import log

    runs = msg.runs(msg.sessions(log(spark, sf_dir))).withColumn("speaker", F.when(F.col("speaker") == "purchase", "ME").otherwise(F.col("speaker")))
    text = msg.conversations(msg.chunks(runs)).select("chat", "session_no", "chunk_no", tk.encode_with_offsets(F.col("text"), marks=tk.MARKS).alias("e"), tk.owner_spans(F.col("text")).alias("spans"))
    return text.select("chat", "session_no", "chunk_no", F.col("e.ids").alias("ids"), tk.within(F.col("spans"), F.col("e")).alias("mask"))


@register("pack_text_shift", f"WITH d AS (SELECT doc_id, list_transform({words_sql('text')}, lambda x: {TOKEN_SQL.format(w='x')}::VARCHAR) AS w FROM documents) SELECT doc_id, md5(array_to_string(list_concat(['1'], w), ',')) AS inputs, md5(array_to_string(list_concat(w, ['2']), ',')) AS labels FROM d")
def pack_text_shift(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.transform("words", token_id).alias("ids"))
    inputs, labels = ins.shifted(F.col("ids"), 1, 2)
    return d.select("doc_id", _join(inputs).alias("inputs"), _join(labels).alias("labels"))
