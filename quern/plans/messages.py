"""Message-log and conversation queries; events stand in for a log: a chat is a user, a speaker an event type."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import instructions as ins
from ..operators import messages as msg
from .base import register, table, words_sql

M = "m AS (SELECT user_id AS chat, ts, event_type AS speaker, props AS text, event_id AS row_ord FROM events)"
S = f"""{M}, s AS (
  SELECT chat, ts, speaker, text, row_ord, (sum(CASE WHEN ts > before + INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY chat ORDER BY ts, row_ord))::BIGINT AS session_no
  FROM (SELECT *, lag(ts) OVER (PARTITION BY chat ORDER BY ts, row_ord) AS before FROM m)
)"""
R = f"""{S}, marked AS (
  SELECT *, (sum(CASE WHEN speaker <> before THEN 1 ELSE 0 END) OVER (PARTITION BY chat, session_no ORDER BY ts, row_ord))::BIGINT AS run_no
  FROM (SELECT *, lag(speaker) OVER (PARTITION BY chat, session_no ORDER BY ts, row_ord) AS before FROM s)
), r AS (
  SELECT chat, session_no, run_no, first(speaker) AS speaker, string_agg(coalesce(text, ''), ' ' ORDER BY ts, row_ord) AS text FROM marked GROUP BY ALL
)""".replace("first(speaker) AS speaker, string_agg", "min(speaker) AS speaker, string_agg")
C = f"""{R}, f AS (
  SELECT chat, session_no, run_no, speaker, text, 0::BIGINT AS chunk_no, 1 AS turns, length(text) AS chars FROM r WHERE run_no = 0
  UNION ALL
  SELECT r.chat, r.session_no, r.run_no, r.speaker, r.text,
    CASE WHEN f.turns >= 30 OR f.chars + length(r.text) > 2000 THEN f.chunk_no + 1 ELSE f.chunk_no END,
    CASE WHEN f.turns >= 30 OR f.chars + length(r.text) > 2000 THEN 1 ELSE f.turns + 1 END,
    CASE WHEN f.turns >= 30 OR f.chars + length(r.text) > 2000 THEN length(r.text) ELSE f.chars + length(r.text) END
  FROM f JOIN r ON r.chat = f.chat AND r.session_no = f.session_no AND r.run_no = f.run_no + 1
), c AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY chat, session_no, chunk_no) AS n FROM f) WHERE n >= 2)"""


def log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("chat"), "ts", F.col("event_type").alias("speaker"), F.col("props").alias("text"), F.col("event_id").alias("row_ord"))


@register("msg_sessions", f"WITH {S} SELECT chat, row_ord, session_no FROM s")
def msg_sessions(spark, sf_dir):
    return msg.sessions(log(spark, sf_dir)).select("chat", "row_ord", "session_no")


@register("msg_session_stats", f"WITH {R}, t AS (SELECT chat, session_no, count(*) AS n_turns FROM r GROUP BY ALL) SELECT s.chat, s.session_no, count(*) AS n_messages, any_value(t.n_turns) AS n_turns, min(ts) AS started, max(ts) AS ended FROM s JOIN t USING (chat, session_no) GROUP BY s.chat, s.session_no")
def msg_session_stats(spark, sf_dir):
    s = msg.sessions(log(spark, sf_dir))
    # The turns of a session are its changes of speaker and one, so nothing has to be joined.
    w = msg.Window.partitionBy("chat", "session_no").orderBy(*msg.ORDER)
    s = s.withColumn("turn", F.coalesce(F.col("speaker") != F.lag("speaker").over(w), F.lit(True)).cast("long"))
    return s.groupBy("chat", "session_no").agg(F.count("*").alias("n_messages"), F.sum("turn").alias("n_turns"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


@register("msg_runs", f"WITH {R} SELECT chat, session_no, run_no, speaker, text FROM r")
def msg_runs(spark, sf_dir):
    return msg.runs(msg.sessions(log(spark, sf_dir)))


@register("msg_chunks", f"WITH RECURSIVE {C} SELECT chat, session_no, chunk_no, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars FROM c GROUP BY ALL")
def msg_chunks(spark, sf_dir):
    return msg.chunks(msg.runs(msg.sessions(log(spark, sf_dir)))).groupBy("chat", "session_no", "chunk_no").agg(F.count("*").alias("n_turns"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@register("msg_render", f"WITH RECURSIVE {C} SELECT chat, session_no, chunk_no, count(*) AS n_turns, '<s><|conv|>' || string_agg('<|turn|>' || speaker || ': ' || text || '<|end|>', '' ORDER BY run_no) || '</s>' AS text FROM c GROUP BY chat, session_no, chunk_no")
def msg_render(spark, sf_dir):
    return msg.conversations(msg.chunks(msg.runs(msg.sessions(log(spark, sf_dir)))))


KIND = "CASE event_type WHEN 'purchase' THEN 'Outgoing' WHEN 'error' THEN 'Notification' ELSE 'Incoming' END"


@register("msg_speaker_label", f"SELECT event_id, CASE WHEN kind = 'Outgoing' THEN 'ME' ELSE coalesce(nullif({tx.strip_sql('sender')}, ''), nullif(chat, ''), 'UNKNOWN') END AS speaker FROM (SELECT event_id, {KIND} AS kind, CASE WHEN event_type = 'click' THEN '  ' WHEN event_type = 'view' THEN props END AS sender, CASE WHEN event_type = 'signup' THEN '' ELSE user_id::VARCHAR END AS chat FROM events) WHERE kind <> 'Notification'")
def msg_speaker_label(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    kind = F.when(t == "purchase", "Outgoing").when(t == "error", "Notification").otherwise("Incoming")
    sender = F.when(t == "click", "  ").when(t == "view", F.col("props"))
    chat = F.when(t == "signup", "").otherwise(F.col("user_id").cast("string"))
    return e.where(kind.isin("Incoming", "Outgoing")).select("event_id", tx.speaker(kind, sender, chat).alias("speaker"))


_CLEAN = rf"regexp_replace(regexp_replace({tx.strip_sql('text')}, '[{tx.BLANK}]*\n[{tx.BLANK}]*', ' ', 'g'), '[ \t]{{2,}}', ' ', 'g')"


@register("msg_clean_phone", f"SELECT doc_id, {tx.strip_sql(rf'''regexp_replace({_CLEAN}, '{tx.PHONE}', '<phone>', 'g')''')} AS text FROM documents")
def msg_clean_phone(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean_message(F.col("text"), True).alias("text"))


H = f"""{S}, sizes AS (SELECT chat, count(DISTINCT session_no) AS n FROM s GROUP BY chat),
ranked AS (SELECT chat, n, row_number() OVER (ORDER BY md5('67:' || chat::VARCHAR), chat) AS k, sum(n) OVER () * 0.1::DOUBLE AS target FROM sizes), h AS (
  SELECT chat, n, k, target, 0 < target AS held, CASE WHEN 0 < target THEN n ELSE 0 END AS running FROM ranked WHERE k = 1
  UNION ALL
  SELECT r.chat, r.n, r.k, r.target, h.running < r.target AND NOT (h.running > 0 AND r.n > 1.5 * r.target),
    CASE WHEN h.running < r.target AND NOT (h.running > 0 AND r.n > 1.5 * r.target) THEN h.running + r.n ELSE h.running END
  FROM h JOIN ranked r ON r.k = h.k + 1
)"""


def _held(spark, sf_dir):
    return msg.hold_out(msg.sessions(log(spark, sf_dir)).groupBy("chat").agg(F.countDistinct("session_no").alias("n")), 0.1)


@register("chat_holdout_split", f"WITH RECURSIVE {H} SELECT chat, n, held FROM h")
def chat_holdout_split(spark, sf_dir):
    return _held(spark, sf_dir)


@register("chat_holdout_check", f"WITH RECURSIVE {H}, k AS (SELECT count(*) AS n_chats, count(*) FILTER (held) AS n_held, (SELECT count(*) FROM s) AS n_train_and_val, (SELECT count(*) FROM s WHERE chat IN (SELECT chat FROM h WHERE held)) AS n_val, 0::BIGINT AS n_in_both FROM h) SELECT *, round(n_val / greatest(n_train_and_val, 1), 4) AS val_share FROM k")
def chat_holdout_check(spark, sf_dir):
    held = _held(spark, sf_dir)
    rows = msg.sessions(log(spark, sf_dir))
    val = rows.join(held.where("held").select("chat"), "chat", "left_semi")
    train = rows.join(held.where("held").select("chat"), "chat", "left_anti")
    both = train.select("chat").intersect(val.select("chat")).agg(F.count("*").alias("n_in_both"))
    sizes = train.select(F.lit(0).alias("v")).unionAll(val.select(F.lit(1).alias("v"))).agg(F.count("*").alias("n_train_and_val"), F.count_if(F.col("v") == 1).alias("n_val"))
    # One row each.
    found = {**held.agg(F.count("*").alias("n_chats"), F.count_if("held").alias("n_held")).first().asDict(), **sizes.first().asDict(), **both.first().asDict()}
    share = F.round(F.lit(found["n_val"]) / F.lit(max(found["n_train_and_val"], 1)), 4)
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in found.items()], share.alias("val_share"))


OWN = f"""o AS (SELECT chat, session_no, chunk_no, len({words_sql('text')}) AS w, speaker = 'purchase' AS own, run_no = min(run_no) OVER (PARTITION BY chat, session_no, chunk_no) AS first FROM c),
a AS (SELECT chat, sum(w + 3 + CASE WHEN first THEN 3 ELSE 0 END)::BIGINT AS n_tokens, sum(CASE WHEN own THEN w + 1 ELSE 0 END)::BIGINT AS n_owner FROM o GROUP BY chat),
sh AS (SELECT *, n_owner / greatest(n_tokens, 1) AS share, CASE WHEN n_owner / greatest(n_tokens, 1) < 0.2::DOUBLE THEN 'low' ELSE 'high' END AS pool FROM a)"""


@register("chat_share_split", f"WITH RECURSIVE {C}, {OWN} SELECT * FROM sh")
def chat_share_split(spark, sf_dir):
    return msg.owner_share(msg.chunks(msg.runs(msg.sessions(log(spark, sf_dir)))), F.col("speaker") == "purchase")


@register("chat_pool_rows", f"WITH RECURSIVE {C}, {OWN} SELECT DISTINCT c.chat, c.session_no, c.chunk_no, pool FROM c JOIN sh USING (chat)")
def chat_pool_rows(spark, sf_dir):
    """Conversations with the pool of their chat."""
    chunked = msg.chunks(msg.runs(msg.sessions(log(spark, sf_dir))))
    rows = msg.conversations(chunked).select("chat", "session_no", "chunk_no")
    return msg.pools(rows, msg.owner_share(chunked, F.col("speaker") == "purchase"))


V = rf"""u AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 'USER' ELSE 'ASSISTANT' END AS speaker,
    replace({tx.strip_sql("regexp_replace(text, '(?s)<think>.*?</think>', '', 'g')")}, chr(10), ' ') AS content
  FROM conversations WHERE role IN ('user', 'assistant')
), v AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM u WHERE coalesce(content, '') <> '') WHERE n >= 2)"""


@register("conv_min_turns", f"WITH {V} SELECT conv_id, count(*) AS n_turns, sum(length(content))::BIGINT AS n_chars FROM v GROUP BY conv_id")
def conv_min_turns(spark, sf_dir):
    u = ins.usable_turns(table(spark, sf_dir, "conversations"))
    return u.select("conv_id", F.size("messages").cast("long").alias("n_turns"), F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"])).alias("n_chars"))


@register("conv_render_roles", f"WITH {V} SELECT conv_id, count(*) AS n_turns, '<s><|conv|>' || string_agg('<|turn|>' || speaker || ': ' || content || '<|end|>', '' ORDER BY turn) || '</s>' AS text FROM v GROUP BY conv_id")
def conv_render_roles(spark, sf_dir):
    return ins.render(ins.usable_turns(table(spark, sf_dir, "conversations")))


@register("conv_loss_mask", f"WITH {V}, p AS (SELECT *, len({words_sql('content')}) AS w, CASE speaker WHEN 'ASSISTANT' THEN '1' ELSE '0' END AS f FROM v) SELECT conv_id, (3 + sum(w + 3))::BIGINT AS n_tokens, sum(CASE f WHEN '1' THEN w + 1 ELSE 0 END)::BIGINT AS n_scored, '00' || string_agg('00' || repeat(f, w + 1), '' ORDER BY turn) || '0' AS mask FROM p GROUP BY conv_id")
def conv_loss_mask(spark, sf_dir):
    t = ins.masked_tokens(ins.usable_turns(table(spark, sf_dir, "conversations")))
    return t.select("conv_id", F.size("tokens").cast("long").alias("n_tokens"), F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_scored"), F.array_join(F.transform("mask", lambda x: x.cast("string")), "").alias("mask"))


@register("conv_owner_filter", f"WITH RECURSIVE {C}, t AS (SELECT chat, session_no, chunk_no, string_agg('<|turn|>' || CASE speaker WHEN 'purchase' THEN 'ME' ELSE speaker END || ': ' || text || '<|end|>', '' ORDER BY run_no) AS body FROM c GROUP BY chat, session_no, chunk_no) SELECT chat, session_no, chunk_no FROM t WHERE contains(body, '<|turn|>ME:')")
def conv_owner_filter(spark, sf_dir):
    from ..operators.evaluate import has_owner_turn

    runs = msg.runs(msg.sessions(log(spark, sf_dir))).withColumn("speaker", F.when(F.col("speaker") == "purchase", "ME").otherwise(F.col("speaker")))
    return msg.conversations(msg.chunks(runs)).where(has_owner_turn(F.col("text"))).select("chat", "session_no", "chunk_no")
