"""Queries over the given tables, one or more for each operator, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions import tokens as N
from colloquy.operators import chunks as C
from colloquy.operators import clean as L
from colloquy.operators import detections as D
from colloquy.operators import encode as E
from colloquy.operators import evaluate as V
from colloquy.operators import gold as G
from colloquy.operators import intervals as I
from colloquy.operators import retrieve as R
from colloquy.operators import sessions as S
from colloquy.operators import translate as X
from colloquy.plans import jobs as J
from colloquy.sources import tables as Q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


# --- cleaning ---------------------------------------------------------------------------------------------------------

_DECODE = "replace(replace(replace(regexp_replace({}, '&amp;?', chr(1), 'g'), '&copy;', '©'), '&quot;', '\"'), '&middot;', '·')"
_ONCE = f"replace({_DECODE.format('html')}, chr(1), '&')"


@query(f"SELECT page_id, replace({_DECODE.format(_ONCE)}, chr(1), '&') AS html FROM pages")
def unescaped_pages(spark, d):
    return table(spark, d, "pages").select("page_id", T.unescaped(F.col("html")).alias("html"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM documents")
def one_line_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", T.one_line(T.without_notices(F.col("text"))).alias("body"))


def raw_messages(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as a raw message log: a message a minute, its parties by role. Copy 0 is the message; every turn 3 is mirrored (copy 1),
    some first turns go to six receivers (copies 2 to 7), some messages go to a room, some are a transport's notice, some hold entities."""
    turn, conv = F.col("turn"), F.col("conv_id")
    copies = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: (k == 0) | ((k == 1) & (turn == 3)) | ((k > 1) & (turn == 0) & (conv % 20 == 7)))
    rows = table(spark, d, "conversations").withColumn("k", F.explode(copies)).withColumn("m", conv * 100 + turn)
    k, mass, mine = F.col("k"), F.col("k") > 1, F.col("role") == "user"
    who = lambda role, n: F.concat(F.lit(f"{role}-"), n, F.lit("@host.example"))
    user, bot = who("user", conv % 50), who("bot", conv % 50)
    sender = F.when(mass, who("boss", conv % 50)).when(mine, user).otherwise(bot)
    receiver = F.when(mass, who("user", k - 2)).when((conv % 5 == 2) & (turn == 2), F.lit("all@conference.host.example")).when(mine, bot).otherwise(user)
    body = F.when((conv % 4 == 1) & (turn == 1), F.lit("*** message was not sent")).when(turn % 3 == 1, F.concat(F.lit("&amp;amp; "), "text")).otherwise(F.col("text"))
    body = F.when(mass, F.concat(F.lit("all hands "), conv)).otherwise(body)
    late = F.when(mass, 20 * (k - 2)).when(k == 1, 1).otherwise(0)
    return rows.select((F.col("m") * 20 + k).alias("src_row"), F.timestamp_seconds(1577836800 + F.col("m") * 60 + late).alias("ts"), sender.alias("from"), receiver.alias("to"), body.alias("body"), F.lower(body).alias("body_en"))


_RAW = r"""raw AS (SELECT (conv_id * 100 + turn) * 20 + k AS src_row, make_timestamp((1577836800 + (conv_id * 100 + turn) * 60 + CASE WHEN k > 1 THEN 20 * (k - 2) ELSE k END) * 1000000) AS ts,
  CASE WHEN k > 1 THEN 'boss-' WHEN role = 'user' THEN 'user-' ELSE 'bot-' END || conv_id % 50 AS nick_from,
  CASE WHEN k > 1 THEN 'user-' || k - 2 WHEN role = 'user' THEN 'bot-' || conv_id % 50 ELSE 'user-' || conv_id % 50 END AS nick_to,
  k <= 1 AND conv_id % 5 = 2 AND turn = 2 AS room,
  trim(regexp_replace(CASE WHEN k > 1 THEN 'all hands ' || conv_id WHEN conv_id % 4 = 1 AND turn = 1 THEN '' WHEN turn % 3 = 1 THEN '& ' || text ELSE text END, '\s+', ' ', 'g')) AS body
  FROM conversations, range(8) AS copies(k) WHERE k = 0 OR k = 1 AND turn = 3 OR k > 1 AND turn = 0 AND conv_id % 20 = 7),
  live AS (SELECT *, lower(body) AS body_en, least(nick_from, nick_to) || ' | ' || greatest(nick_from, nick_to) AS dyad FROM raw WHERE body <> '' AND NOT room),
  once AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY dyad, body, floor(epoch_us(ts) / 1e7) ORDER BY src_row) = 1),
  gaps AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY nick_from, body ORDER BY ts, src_row) > 600e6, true)::INT AS b FROM once),
  runs AS (SELECT *, sum(b) OVER (PARTITION BY nick_from, body ORDER BY ts, src_row) AS run FROM gaps),
  mass AS (SELECT nick_from, body, run, list_sort(list(DISTINCT nick_to)) AS recipients, count(*) AS merged FROM runs GROUP BY ALL HAVING count(DISTINCT nick_to) >= 5),
  marked AS (SELECT runs.*, recipients, merged, row_number() OVER (PARTITION BY nick_from, body, run ORDER BY ts, src_row) AS nth FROM runs LEFT JOIN mass USING (nick_from, body, run)),
  kept AS (SELECT *, CASE WHEN recipients IS NULL THEN 'conversation' ELSE 'broadcast' END AS kind FROM marked WHERE recipients IS NULL OR nth = 1)"""


@query(f"WITH {_RAW} SELECT src_row, ts, nick_from, nick_to, dyad, body, body_en, kind, coalesce(len(recipients), 0)::INT AS n_recipients FROM kept")
def clean_messages(spark, d):
    rows = L.clean(raw_messages(spark, d))
    return rows.select("src_row", "ts", "nick_from", "nick_to", "dyad", "body", "body_en", "kind", F.size("recipients").alias("n_recipients"))


@query(f"""WITH {_RAW} SELECT (SELECT count(*) FROM raw) AS n_input, (SELECT count(*) FROM raw WHERE room) AS n_room, (SELECT count(*) FROM raw WHERE body = '' AND NOT room) AS n_empty,
 (SELECT count(*) FROM live) - (SELECT count(*) FROM once) AS n_mirrored, (SELECT count(*) FROM marked WHERE recipients IS NOT NULL AND nth > 1) AS n_folded,
 (SELECT count(*) FROM kept WHERE kind = 'conversation') AS n_conversation, (SELECT count(*) FROM kept WHERE kind = 'broadcast') AS n_broadcast""")
def row_accounting(spark, d):
    return J.clean_job(raw_messages(spark, d))[1]


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id % 10, floor(epoch_us(ts) / 3.6e9) ORDER BY event_id) > 1 AS mirrored FROM events")
def mirrored_events(spark, d):
    rows = table(spark, d, "events").withColumn("who", F.col("user_id") % 10)
    return L.first_of_mirrored(rows, ["event_type", "who"], "ts", "event_id", 3600).select("event_id", "mirrored")


_FOLD = """WITH g AS (SELECT *, user_id % 50 AS sender, 'r' || event_id % 17 AS receiver FROM events),
 f AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY sender, event_type ORDER BY ts, event_id) > 86400e6, true)::INT AS b FROM g),
 r AS (SELECT *, sum(b) OVER (PARTITION BY sender, event_type ORDER BY ts, event_id) AS run FROM f),
 m AS (SELECT sender, event_type, run, list_sort(list(DISTINCT receiver)) AS recipients, list_sort(list(event_id)) AS merged_rows FROM r GROUP BY ALL HAVING count(DISTINCT receiver) >= 5),
 j AS (SELECT r.event_id, m.recipients, m.merged_rows, m.run IS NOT NULL AS mass, row_number() OVER (PARTITION BY r.sender, r.event_type, r.run ORDER BY r.ts, r.event_id) AS n FROM r LEFT JOIN m USING (sender, event_type, run))"""


@query(_FOLD + " SELECT event_id, CASE WHEN mass THEN 'broadcast' ELSE 'conversation' END AS kind, coalesce(array_to_string(recipients, ';'), '') AS recipients, coalesce(array_to_string(merged_rows, ';'), '') AS merged_rows, mass AND n > 1 AS folded FROM j")
def folded_events(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", "event_type", (F.col("user_id") % 50).alias("sender"), F.concat(F.lit("r"), F.col("event_id") % 17).alias("receiver"))
    got = L.folded_notices(rows, ["sender", "event_type"], "receiver", "ts", "event_id", 86400, shown=lambda c: F.array_join(c.cast("array<string>"), ";"))
    return got.select("event_id", "kind", "recipients", "merged_rows", "folded")


@query("SELECT count(*) AS n_messages, count(DISTINCT least(user_id::VARCHAR, event_type) || ' | ' || greatest(user_id::VARCHAR, event_type)) AS n_pairs, (SELECT count(*) FROM (SELECT user_id::VARCHAR FROM events UNION SELECT event_type FROM events)) AS n_accounts FROM events")
def message_profile(spark, d):
    return L.profile(table(spark, d, "events").select(F.col("user_id").cast("string").alias("from"), F.col("event_type").alias("to")))


# --- sessions and chunks ----------------------------------------------------------------------------------------------

_SESS = """WITH g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600e6, true)::INT AS b FROM events),
 s AS (SELECT *, sum(b) OVER (ORDER BY user_id, ts, event_id)::BIGINT AS sid FROM g)"""


def event_sessions(spark, d):
    return S.sessions(table(spark, d, "events"), "user_id", "ts", "event_id", 6 * 3600)


@query(_SESS + " SELECT event_id, user_id, sid FROM s")
def sessions(spark, d):
    return event_sessions(spark, d).select("event_id", "user_id", "sid")


@query(_SESS + ", p AS (SELECT sid, count(*) AS m, sum(event_id % 7) AS t FROM s GROUP BY sid) SELECT count(*) AS n_sessions, floor(quantile_cont(m, 0.5))::BIGINT AS median_messages, max(m) AS max_messages, floor(quantile_cont(t, 0.5))::BIGINT AS median_tokens, floor(quantile_cont(t, 0.99))::BIGINT AS p99_tokens, max(t)::BIGINT AS max_tokens, count(*) FILTER (t > 9) AS n_over FROM p")
def session_report(spark, d):
    return S.session_report(event_sessions(spark, d).withColumn("tokens", F.col("event_id") % 7), "tokens", 9)


@query(_SESS + " SELECT sid, count(DISTINCT event_type) AS n_keys FROM s GROUP BY sid HAVING count(DISTINCT event_type) > 1")
def mixed_sessions(spark, d):
    """By the type of event, which users' sessions do mix; by user there are none."""
    return S.mixed_sessions(event_sessions(spark, d), "event_type")


_WORDS = r"len(list_filter(string_split_regex({}, '\s+'), lambda x: x <> ''))"


@query(rf"""WITH RECURSIVE t AS (SELECT conv_id, turn, {_WORDS.format("text")} AS n FROM conversations),
 c AS (SELECT conv_id, list_prepend(0, list(cum ORDER BY turn)) AS sums, count(*) AS n FROM (SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS cum FROM t) GROUP BY conv_id),
 e AS (SELECT conv_id, sums, n, 1 AS part, 0::BIGINT AS a, greatest(1, len(list_filter(sums, lambda x: x <= 120)) - 1)::BIGINT AS b FROM c
   UNION ALL
   SELECT conv_id, sums, n, part + 1, s, greatest(s + 1, len(list_filter(sums, lambda x: x <= sums[s + 1] + 120)) - 1)::BIGINT FROM
     (SELECT *, greatest(a + 1, least(b, len(list_filter(sums, lambda x: x <= sums[b + 1] - 30)) - 1))::BIGINT AS s FROM e WHERE b < n))
 SELECT conv_id, part, max(part) OVER (PARTITION BY conv_id) AS n_parts, a AS first, b - 1 AS last FROM e""")
def packed_conversations(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", T.word_count(F.col("text")).alias("tokens"))
    return C.planned(rows, "conv_id", "turn", "tokens", 120, 30)


def conversation_chunk_rows(spark, d):
    return J.chunk_job(J.clean_job(raw_messages(spark, d))[0], gap_seconds=1800, size=152, overlap=30)


#: Chunks by SQL: sessions of kept messages, bodies in pieces, spans over the English counts (120 words, 30 shared), notices behind.
_CHUNKS = rf"""{_RAW},
 g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY dyad ORDER BY ts, src_row) > 1800e6, true)::INT AS begins FROM kept WHERE kind = 'conversation'),
 sess AS (SELECT *, sum(begins) OVER (ORDER BY dyad, ts, src_row)::BIGINT AS sid FROM g),
 said AS (SELECT *, strftime(ts, '%H:%M') || ' ' || nick_from || ': ' AS prefix, row_number() OVER (PARTITION BY sid ORDER BY ts, src_row) AS no FROM sess),
 sized AS (SELECT *, greatest(1, ceil({_WORDS.format("prefix || body_en")} / 120.0))::BIGINT AS cuts FROM said),
 worded AS (SELECT * EXCLUDE (body, body_en), corpus, said_body, list_filter(string_split_regex(said_body, '\s+'), lambda x: x <> '') AS words FROM
   (SELECT *, unnest(['ru', 'en']) AS corpus, unnest([body, body_en]) AS said_body FROM sized)),
 cut AS (SELECT *, CASE WHEN cuts <= 1 OR len(words) = 0 THEN [prefix || said_body] ELSE list_transform(range(cuts), lambda i:
   prefix || coalesce(nullif(array_to_string(words[i * ceil(len(words) / cuts)::BIGINT + 1:(i + 1) * ceil(len(words) / cuts)::BIGINT], ' '), ''), '…')) END AS said_lines FROM worded),
 wide AS (SELECT *, max(len(said_lines)) OVER (PARTITION BY sid, no) AS width FROM cut),
 placed AS (SELECT *, coalesce(said_lines[piece + 1], '…') AS line FROM (SELECT *, unnest(range(width)) AS piece FROM wide)),
 lines AS (SELECT *, {_WORDS.format("line")} AS tokens, row_number() OVER (PARTITION BY corpus, sid ORDER BY no, piece) AS pos FROM placed),
 sums AS (SELECT sid, list_prepend(0, list(upto ORDER BY pos)) AS sums, count(*) AS n FROM (SELECT sid, pos, sum(tokens) OVER (PARTITION BY sid ORDER BY pos)::BIGINT AS upto FROM lines WHERE corpus = 'en') GROUP BY sid),
 spans AS (SELECT sid, sums, n, 1 AS part, 0::BIGINT AS a, greatest(1, len(list_filter(sums, lambda x: x <= 120)) - 1)::BIGINT AS b FROM sums
   UNION ALL
   SELECT sid, sums, n, part + 1, s, greatest(s + 1, len(list_filter(sums, lambda x: x <= sums[s + 1] + 120)) - 1)::BIGINT FROM
     (SELECT *, greatest(a + 1, least(b, len(list_filter(sums, lambda x: x <= sums[b + 1] - 30)) - 1))::BIGINT AS s FROM spans WHERE b < n)),
 parts AS (SELECT *, max(part) OVER (PARTITION BY sid) AS n_parts FROM spans),
 conv AS (SELECT corpus, sid, dyad, part, n_parts, min(ts) AS t0, max(ts) AS t1, count(DISTINCT no)::INT AS n_messages, (sum(tokens) + 32)::INT AS n_tokens, string_agg(line, chr(10) ORDER BY pos) AS body
   FROM lines JOIN parts USING (sid) WHERE pos > parts.a AND pos <= parts.b GROUP BY corpus, sid, dyad, part, n_parts),
 notes AS (SELECT *, unnest(['ru', 'en']) AS corpus, unnest([body, body_en]) AS note FROM (SELECT *, row_number() OVER (ORDER BY src_row) AS no FROM kept WHERE kind = 'broadcast')),
 told AS (SELECT corpus, no, merged, '[공지] ' || nick_from || ' -> ' || len(recipients) || '명 | ' || strftime(ts, '%Y-%m-%d %H:%M') || chr(10) || '수신: ' || array_to_string(recipients, ', ') || chr(10) || nick_from || ': ' || note AS text FROM notes),
 chunk AS (SELECT corpus, (row_number() OVER (PARTITION BY corpus ORDER BY dyad, sid, part) - 1)::INT AS chunk_index, sid AS session_id, 'conversation' AS kind, n_messages, part::INT AS part, n_parts::INT AS n_parts, n_tokens,
     '[대화] ' || dyad || ' | ' || strftime(t0, '%Y-%m-%d') || CASE WHEN t0::DATE = t1::DATE THEN '' ELSE '~' || strftime(t1, '%m-%d') END || ' ' || strftime(t0, '%H:%M') || '~' || strftime(t1, '%H:%M')
     || CASE WHEN n_parts > 1 THEN ' (' || part || '/' || n_parts || ')' ELSE '' END || chr(10) || body AS text FROM conv
   UNION ALL
   SELECT corpus, (no - 1 + (SELECT count(*) FROM conv WHERE conv.corpus = told.corpus))::INT, -no, 'broadcast', merged::INT, 1, 1, {_WORDS.format("text")}::INT, text FROM told)"""


@query(f"WITH RECURSIVE {_CHUNKS} SELECT * FROM chunk")
def conversation_chunks(spark, d):
    return conversation_chunk_rows(spark, d).select("corpus", "chunk_index", "session_id", "kind", "n_messages", "part", "n_parts", "n_tokens", "text")


@query(f"""WITH RECURSIVE {_CHUNKS} SELECT corpus, count(*) AS n_chunks, count(*) FILTER (kind = 'conversation') AS n_conversation, count(*) FILTER (kind = 'broadcast') AS n_broadcast,
 floor(quantile_cont(n_tokens, 0.5) FILTER (kind = 'conversation'))::BIGINT AS median_tokens, max(n_tokens) FILTER (kind = 'conversation')::BIGINT AS max_tokens, count(*) FILTER (kind = 'conversation' AND n_tokens > 152) AS n_over FROM chunk GROUP BY corpus""")
def chunk_report(spark, d):
    return C.chunk_report(conversation_chunk_rows(spark, d), 152)


_WINDOWS = r"""w AS (SELECT doc_id, lang, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS words FROM documents),
 v AS (SELECT doc_id, lang, words, unnest(range(0, greatest(0, ceil((len(words) - 256) / 192.0)::BIGINT) + 1))::INT AS chunk_index FROM w WHERE len(words) > 0),
 win AS (SELECT doc_id, lang, chunk_index, chunk_index * 192 AS token_start, least(chunk_index * 192 + 256, len(words))::INT AS token_end, array_to_string(words[chunk_index * 192 + 1:chunk_index * 192 + 256], ' ') AS chunk FROM v)"""


def windows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    return C.sliding_windows(docs, F.array_remove(F.split("text", T.WHITE), ""), 256, 64)


@query(f"WITH {_WINDOWS} SELECT doc_id, chunk_index, token_start, token_end, token_end - token_start AS token_count, chunk FROM win")
def sliding_windows(spark, d):
    return windows(spark, d).select("doc_id", "chunk_index", "token_start", "token_end", "token_count", "chunk")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def token_chunks(spark, d):
    """Conversations in chunks of a tokenizer's ids: sizes are counts of ids, long bodies are cut by ids."""
    path = tokenizer_file()
    kept, _ = J.clean_job(raw_messages(spark, d))
    rows = J.chunk_job(kept, gap_seconds=1800, size=512, overlap=128, count=N.count(path), cut=N.cut(path))
    return rows.select("corpus", "chunk_index", "session_id", "kind", "n_messages", "part", "n_parts", "n_tokens", "src_rows", "text")


@query()
def token_windows(spark, d):
    """Windows over the ids of whole documents, with the text of each window's ids."""
    path = tokenizer_file()
    docs = Q.spread(table(spark, d, "documents").select("doc_id", "text"))
    return C.sliding_windows(docs, N.ids(path)("text"), 512, 128, N.text_of(path)).select("doc_id", "chunk_index", "token_start", "token_end", "token_count", "chunk")


@query(f"WITH {_WINDOWS} SELECT lang, count(*) AS n_chunks, (sum(token_end - token_start) // count(*))::BIGINT AS mean_tokens, max(token_end - token_start)::BIGINT AS max_tokens, count(*) FILTER (token_end - token_start > 200) AS n_oversize FROM win GROUP BY lang")
def input_report(spark, d):
    return E.input_report(windows(spark, d).withColumn("n_tokens", F.col("token_count")), ["lang"], 200)


@query(f"WITH {_WINDOWS}, c AS (SELECT lang AS corpus, count(*) AS n FROM win GROUP BY lang) SELECT corpus, n, (SELECT max(n) FROM c) AS most FROM c WHERE n < (SELECT max(n) FROM c)")
def uneven_corpora(spark, d):
    """Windows of the documents' languages, which do differ in number."""
    return C.uneven_corpora(windows(spark, d).withColumn("corpus", F.col("lang")))


@query(f"WITH t AS (SELECT conv_id, turn, {_WORDS.format('text')} AS n FROM conversations) SELECT conv_id, turn, (sum(n) OVER w - n)::BIGINT AS token_start, (sum(n) OVER w)::BIGINT AS token_end FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def token_offsets(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", T.word_count(F.col("text")).alias("n_tokens"))
    return E.token_offsets(rows, "conv_id", "turn").select("conv_id", "turn", "token_start", "token_end")


# --- retrieval and evaluation -----------------------------------------------------------------------------------------

#: Questions are all vectors whose id divides by 100, candidates all vectors; a label is a document, its ids the chunks.
_TOP = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
 s AS (SELECT q.vec_id AS qid, c.label::VARCHAR AS tag, c.vec_id AS chunk_index, round(list_dot_product(q.e, c.e), 12) AS score FROM v q, v c WHERE q.vec_id % 100 = 0),
 top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, tag, chunk_index) AS rank, (SELECT count(*) FROM v) AS n_candidates FROM s QUALIFY rank <= 10)"""


def vectors(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("tag"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.select(F.col("vec_id").alias("qid"), "tag", F.col("vec_id").alias("chunk_index"), F.lit("all").alias("pool_key"), "embedding")


def top_rows(spark, d, mode: str = "dense"):
    rows = vectors(spark, d)
    if mode == "dense":
        return R.top_k(rows.filter("qid % 100 = 0"), rows, 10, mode)
    # Every document and every vector is a candidate, whatever it lacks.
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_index"), "text")
    rows = rows.join(texts, "chunk_index", "full").withColumns({"qid": F.col("chunk_index"), "tag": F.coalesce("tag", F.lit("none")), "pool_key": F.lit("all")})
    return R.top_k(E.all_words(rows.filter("qid % 100 = 0")), E.all_words(rows), 10, mode, weigh=E.weighed)


@query(f"WITH {_TOP} SELECT qid, tag, chunk_index, rank::INT AS rank, round(score, 6) AS score, n_candidates FROM top")
def dense_top10(spark, d):
    return top_rows(spark, d).withColumn("score", F.round("score", 6))


@query("""WITH v AS (SELECT vec_id, label::VARCHAR AS tag, CASE WHEN label < 5 THEN 'evidence' ELSE 'answer' END AS task, embedding::DOUBLE[] AS e FROM embeddings),
 s AS (SELECT q.vec_id AS qid, c.tag, c.vec_id AS chunk_index, round(list_dot_product(q.e, c.e), 12) AS score FROM v q JOIN v c ON q.task = 'answer' AND c.task = 'answer' OR q.task = 'evidence' AND c.task = 'evidence' AND q.tag = c.tag WHERE q.vec_id % 100 = 0)
 SELECT qid, tag, chunk_index, row_number() OVER w::INT AS rank, round(score, 6) AS score, count(*) OVER (PARTITION BY qid) AS n_candidates FROM s WINDOW w AS (PARTITION BY qid ORDER BY score DESC, tag, chunk_index) QUALIFY row_number() OVER w <= 10""")
def auto_pool_top10(spark, d):
    """Questions of answer documents look in all of these, others in their own document."""
    rows = vectors(spark, d).withColumn("task", F.when(F.col("tag") < "5", "evidence").otherwise("answer")).drop("pool_key")
    got = R.top_k(R.question_pools(rows.filter("qid % 100 = 0"), "auto"), R.pools(rows, "auto"))
    return got.withColumn("score", F.round("score", 6))


_HYBRID = r"""WITH tok AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents)),
 sp AS (SELECT doc_id, token, max(1 / (1 + pos)::DOUBLE) AS weight FROM tok GROUP BY ALL),
 x AS (SELECT q.doc_id AS qid, c.doc_id AS chunk_index, sum(q.weight * c.weight) AS sparse FROM sp q JOIN sp c USING (token) WHERE q.doc_id % 100 = 0 GROUP BY ALL),
 v AS MATERIALIZED (SELECT coalesce(vec_id, doc_id) AS id, coalesce(label::VARCHAR, 'none') AS tag, embedding::DOUBLE[] AS e FROM embeddings FULL JOIN documents ON vec_id = doc_id),
 s AS (SELECT q.id AS qid, c.tag, c.id AS chunk_index, round({dense} + {w} * coalesce(x.sparse, 0), 12) AS score FROM v q CROSS JOIN v c LEFT JOIN x ON x.qid = q.id AND x.chunk_index = c.id WHERE q.id % 100 = 0)
 SELECT qid, tag, chunk_index, row_number() OVER (PARTITION BY qid ORDER BY score DESC, tag, chunk_index)::INT AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 10"""


@query(_HYBRID.format(dense="coalesce(list_dot_product(q.e, c.e), 0)", w=0.3))
def hybrid_top10(spark, d):
    return top_rows(spark, d, "hybrid").withColumn("score", F.round("score", 6)).drop("n_candidates")


@query(_HYBRID.format(dense="0.0", w=1))
def sparse_only_top10(spark, d):
    return top_rows(spark, d, "sparse").withColumn("score", F.round("score", 6)).drop("n_candidates")


_SPARSE = r"""tok AS (SELECT doc_id, lang, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)),
 sp AS (SELECT doc_id, lang, token, max(1 / (1 + pos)::DOUBLE) AS weight FROM tok GROUP BY ALL)"""


def sparse_rows(spark, d):
    return E.sparse_texts(Q.spread(table(spark, d, "documents").select("doc_id", "lang", "text")), ["doc_id", "lang"])


@query(f"WITH {_SPARSE} SELECT doc_id, lang, token, weight FROM sp")
def sparse_vectors(spark, d):
    return sparse_rows(spark, d)


@query(f"WITH {_SPARSE} SELECT lang, avg(n) AS mean_sparse_tokens FROM (SELECT doc_id, lang, count(*) AS n FROM sp GROUP BY ALL) GROUP BY lang")
def mean_sparse_tokens(spark, d):
    return E.mean_sparse_tokens(sparse_rows(spark, d), ["doc_id", "lang"], ["lang"])


@query(f"""WITH {_SPARSE}, x AS (SELECT q.doc_id AS qid, c.doc_id AS chunk_index, round(sum(q.weight * c.weight), 9) AS sparse FROM sp q JOIN sp c USING (lang, token) WHERE q.doc_id % 100 = 0 GROUP BY ALL)
 SELECT qid, chunk_index, round(sparse, 6) AS sparse, row_number() OVER (PARTITION BY qid ORDER BY sparse DESC, chunk_index)::INT AS rank FROM x QUALIFY rank <= 10""")
def sparse_top10(spark, d):
    docs = Q.spread(table(spark, d, "documents").select(F.col("lang").alias("pool_key"), F.col("lang").alias("tag"), F.col("doc_id").alias("chunk_index"), "text"))
    questions = E.all_words(docs.filter("chunk_index % 100 = 0").withColumnRenamed("chunk_index", "qid"))
    got = R.top_k(questions, E.all_words(docs), 10, "sparse", digits=9, weigh=E.weighed).filter("score > 0")
    return got.select("qid", "chunk_index", F.round("score", 6).alias("sparse"), "rank")


_UNIT = "SELECT vec_id, round(list_sum(u), 6) AS total FROM (SELECT vec_id, list_transform(e, lambda x: x / greatest(n, 1e-12)) AS u FROM (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: 3 * x::DOUBLE) AS e FROM embeddings)))"


@query(_UNIT)
def unit_vectors(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", E.unit(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("u"))
    return rows.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_NEXT = """gold AS (SELECT vec_id AS qid, label::VARCHAR AS tag, list_filter([lead(vec_id, 1) OVER w, lead(vec_id, 2) OVER w, lead(vec_id, 3) OVER w], lambda x: x IS NOT NULL) AS gold FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
 conf AS (SELECT unnest(['tight', 'loose']) AS config, unnest([5, 40]) AS tol),
 hit AS (SELECT config, qid, g.tag, gold, rank, g FROM (SELECT *, unnest(gold) AS g FROM gold WHERE qid % 100 = 0 AND len(gold) > 0) g JOIN top USING (qid), conf WHERE top.tag = g.tag AND abs(chunk_index - g) <= tol),
 per AS (SELECT config, qid, tag, len(gold) AS n_gold, gold FROM gold, conf WHERE qid % 100 = 0 AND len(gold) > 0),
 m AS (SELECT per.config, per.qid, per.tag, CASE WHEN per.qid % 300 = 0 THEN 'a' WHEN per.qid % 300 = 100 THEN 'b' ELSE '' END AS qtype, coalesce(min(rank), 0) AS rank, count(DISTINCT g) FILTER (rank <= 5) / least(any_value(n_gold), 5) AS r5, count(DISTINCT g) FILTER (rank <= 10) / least(any_value(n_gold), 10) AS r10
   FROM per LEFT JOIN hit ON per.config = hit.config AND per.qid = hit.qid GROUP BY ALL),
 met AS (SELECT config, qid, tag, qtype, rank, (rank BETWEEN 1 AND 5)::INT::DOUBLE AS "hit@5", (rank BETWEEN 1 AND 10)::INT::DOUBLE AS "hit@10", r5 AS "recall@5", r10 AS "recall@10", CASE WHEN rank > 0 THEN 1 / rank ELSE 0 END AS "mrr@10", CASE WHEN rank > 0 THEN 1 / log2(rank + 1) ELSE 0 END AS "ndcg@10" FROM m)"""
_SIX = ", ".join(f'"{m}"' for m in V.METRICS)
_AVG = ", ".join(f'round(avg("{m}"), 4) AS "{m}"' for m in V.METRICS)


def gold_of(spark, d):
    w = Window.partitionBy("tag").orderBy("qid")
    rows = vectors(spark, d).select("qid", "tag")
    ahead = F.filter(F.array(*[F.lead("qid", k).over(w) for k in (1, 2, 3)]), lambda x: x.isNotNull())
    return rows.withColumn("gold", ahead).filter("qid % 100 = 0 and size(gold) > 0")


def metric_rows(spark, d, coverage: bool = True):
    """Two configurations: neighbours within 5 and within 40 ids count."""
    rows = gold_of(spark, d).join(V.ranked(top_rows(spark, d), ["qid"]), "qid")
    rows = rows.withColumn("qtype", F.when(F.col("qid") % 300 == 0, "a").when(F.col("qid") % 300 == 100, "b").otherwise("")).withColumn("corpus", F.when(F.col("tag") < "5", "ko").otherwise("en"))
    both = [V.query_metrics(rows, tol, coverage).withColumn("config", F.lit(name)) for name, tol in (("tight", 5), ("loose", 40))]
    return both[0].unionByName(both[1])


@query(f"WITH {_TOP}, {_NEXT} SELECT config, qid, tag, rank::INT AS rank, {_SIX} FROM met")
def retrieval_metrics(spark, d):
    return metric_rows(spark, d).select("config", "qid", "tag", "rank", *[F.col(f"`{m}`") for m in V.METRICS])


@query(f"""WITH {_TOP}, {_NEXT} SELECT config, qid, tag, rank::INT AS rank, "hit@5", "hit@10", "hit@5" AS "recall@5", "hit@10" AS "recall@10", "mrr@10", "ndcg@10" FROM met""")
def metrics_without_coverage(spark, d):
    """Recall as the older runs have it: one hit is all."""
    return metric_rows(spark, d, coverage=False).select("config", "qid", "tag", "rank", *[F.col(f"`{m}`") for m in V.METRICS])


_AXES = f"""ax AS (SELECT *, CASE WHEN tag < '5' THEN 'ko' ELSE 'en' END AS language, CASE WHEN tag < '5' THEN 'evidence' ELSE 'answer' END AS task, CASE WHEN qid % 200 = 0 THEN 'doc' ELSE 'auto' END AS scope FROM met),
 axes AS (
 SELECT config, 'language' AS group_kind, language, NULL AS evidence, NULL AS task, count(*) AS n_queries, {_AVG}, CASE WHEN min(scope) = max(scope) THEN min(scope) ELSE 'mixed' END AS scope FROM ax GROUP BY config, language
 UNION ALL SELECT config, 'evidence_type', NULL, qtype, NULL, count(*), {_AVG}, CASE WHEN min(scope) = max(scope) THEN min(scope) ELSE 'mixed' END FROM ax WHERE qtype <> '' GROUP BY config, qtype
 UNION ALL SELECT config, 'task_evidence', NULL, qtype, task, count(*), {_AVG}, CASE WHEN min(scope) = max(scope) THEN min(scope) ELSE 'mixed' END FROM ax WHERE qtype <> '' GROUP BY config, qtype, task)"""


@query(f"WITH {_TOP}, {_NEXT}, {_AXES} SELECT * FROM axes")
def means_by_axes(spark, d):
    """Means by language, by type of evidence, and by that and task."""
    early = F.col("tag") < "5"
    rows = metric_rows(spark, d).withColumns({"language": F.when(early, "ko").otherwise("en"), "task": F.when(early, "evidence").otherwise("answer"), "evidence": F.col("qtype"), "scope": F.when(F.col("qid") % 200 == 0, "doc").otherwise("auto")})
    return V.means(rows, {"language": ["language"], "evidence_type": ["evidence"], "task_evidence": ["task", "evidence"]})


_ROLL = f"""roll AS (
 SELECT config, 'document' AS group_kind, tag AS document, count(*) AS n_queries, {_AVG} FROM met GROUP BY config, tag
 UNION ALL SELECT config, 'q_type', 'QTYPE(' || qtype || ')', count(*), {_AVG} FROM met WHERE qtype <> '' GROUP BY config, qtype
 UNION ALL SELECT config, 'document_q_type', tag || ' / ' || qtype, count(*), {_AVG} FROM met WHERE qtype <> '' GROUP BY config, tag, qtype
 UNION ALL SELECT config, 'overall', CASE WHEN tag < '5' THEN 'ALL(한국어)' ELSE 'ALL(다국어)' END AS document, count(*), {_AVG} FROM met GROUP BY ALL
 UNION ALL SELECT config, 'overall', 'ALL', count(*), {_AVG} FROM met GROUP BY config)"""


def summary(spark, d):
    return V.roll_up(metric_rows(spark, d))


@query(f"WITH {_TOP}, {_NEXT}, {_ROLL} SELECT * FROM roll")
def retrieval_rollup(spark, d):
    return summary(spark, d)


@query(f"WITH {_TOP}, {_NEXT}, {_ROLL}, u AS (UNPIVOT (SELECT config, {_SIX} FROM roll WHERE document = 'ALL') ON {_SIX} INTO NAME metric VALUE v) SELECT metric, max(v) FILTER (config = 'tight') AS tight, max(v) FILTER (config = 'loose') AS loose FROM u GROUP BY metric")
def config_comparison(spark, d):
    return V.compare(summary(spark, d), ["tight", "loose"])


@query(f"WITH {_TOP}, {_NEXT}, {_ROLL} SELECT document, max(n_queries) AS n_queries, max(\"ndcg@10\") FILTER (config = 'tight') AS tight, max(\"ndcg@10\") FILTER (config = 'loose') AS loose FROM roll WHERE group_kind = 'q_type' GROUP BY document")
def config_matrix(spark, d):
    return V.matrix(summary(spark, d), ["tight", "loose"], "q_type")


@query(f"WITH {_TOP}, {_NEXT}, {_ROLL}, u AS (UNPIVOT (SELECT config, {_SIX} FROM roll WHERE document = 'ALL') ON {_SIX} INTO NAME metric VALUE v) SELECT metric, arg_max(config, v + CASE config WHEN 'tight' THEN 1e-9 ELSE 0 END) AS config, max(v) AS value FROM u GROUP BY metric")
def best_config(spark, d):
    return V.best_config(summary(spark, d), ["tight", "loose"])


@query(f"WITH {_TOP}, {_NEXT} SELECT qid, tag, rank::INT AS rank FROM met WHERE config = 'tight' AND (rank = 0 OR rank > 3) ORDER BY (rank = 0) DESC, rank, qid LIMIT 20")
def worst_questions(spark, d):
    return V.misses(metric_rows(spark, d).filter("config = 'tight'"), 20).select("qid", "tag", "rank")


@query(f"WITH {_TOP}, {_NEXT}, t AS (SELECT config, round(avg(\"ndcg@10\") FILTER (tag < '5'), 4) AS evidence, round(avg(\"ndcg@10\") FILTER (tag >= '5'), 4) AS answer FROM met GROUP BY config) SELECT *, round(answer - evidence, 4) AS difference FROM t WHERE evidence IS NOT NULL AND answer IS NOT NULL")
def task_difference(spark, d):
    rows = metric_rows(spark, d).withColumn("task", F.when(F.col("tag") < "5", "evidence").otherwise("answer"))
    return V.task_difference(rows, "evidence", "answer")


@query(f"WITH {_TOP}, {_NEXT}, {_ROLL} SELECT document, n_queries, \"ndcg@10\" FROM roll WHERE config = 'loose' AND group_kind = 'document'")
def documents_by_quality(spark, d):
    return V.documents_of(summary(spark, d), "loose").select("document", "n_queries", F.col("`ndcg@10`"))


@query("SELECT vec_id AS qid FROM embeddings WHERE vec_id >= 400")
def gold_out_of_range(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.lit("t").alias("tag"), F.array("vec_id").alias("gold"))
    return V.bad_gold(rows, spark.createDataFrame([("t", 400)], "tag string, n_chunks int")).select("qid")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, max((role = 'user' AND contains(text, 'the'))::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS h FROM conversations) WHERE h = 1")
def keyword_neighbours(spark, d):
    rows = table(spark, d, "conversations").withColumn("participants", F.array("role")).withColumn("recipients", F.lit(None).cast("array<string>"))
    return R.with_neighbours(rows, R.chunk_filter(speaker="user", keyword="the"), 1, "conv_id", "turn").select("conv_id", "turn")


_CONFIGS = ", ".join(f"('{name}', {q}, {d}, '{mode}')" for name, (q, d, mode) in {k: (*({"hash-a": 0, "hash-b": 7}[m] for m in c[:2]), c[2]) for k, c in J.CONFIGS.items()}.items())
_ENCODERS = rf"""m AS (SELECT conv_id * 100 + turn AS id, role, conv_id, text FROM conversations),
 conf(config, qs, ds, mode) AS (VALUES {_CONFIGS}),
 wd AS (SELECT id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS word FROM m),
 hs AS (SELECT seed, id, ('0x' || substr(md5(seed || ':' || word), 1, 8))::BIGINT AS h FROM wd, (VALUES (0), (7)) AS seeds(seed)),
 cn AS (SELECT seed, id, h % 64 AS i, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::FLOAT AS c FROM hs GROUP BY ALL),
 un AS MATERIALIZED (SELECT seed, id, i, (c / greatest(sqrt(sum(c * c) OVER (PARTITION BY seed, id))::FLOAT, 1e-12::FLOAT))::FLOAT AS x FROM cn),
 ask AS MATERIALIZED (SELECT id AS qid, CASE WHEN length(text) > 200 THEN '1 long' ELSE '2 short' END AS qtype FROM m WHERE role = 'user'),
 cand AS MATERIALIZED (SELECT id AS cid FROM m WHERE role = 'assistant'),
 dn AS (SELECT a.seed AS qs, b.seed AS ds, a.id AS qid, b.id AS cid, sum(a.x::DOUBLE * b.x::DOUBLE) AS dense FROM un a JOIN un b USING (i) WHERE a.id IN (SELECT qid FROM ask) AND b.id IN (SELECT cid FROM cand) GROUP BY ALL),
 tk AS (SELECT id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (SELECT id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM m)),
 wt AS MATERIALIZED (SELECT id, token, max(1 / (1 + pos)::DOUBLE) AS weight FROM tk GROUP BY ALL),
 sx AS (SELECT a.id AS qid, b.id AS cid, sum(a.weight * b.weight) AS sparse FROM wt a JOIN wt b USING (token) WHERE a.id IN (SELECT qid FROM ask) AND b.id IN (SELECT cid FROM cand) GROUP BY ALL),
 sc AS (SELECT config, qid, qtype, cid, round(CASE WHEN mode <> 'sparse' THEN coalesce(dense, 0) ELSE 0 END + CASE mode WHEN 'sparse' THEN 1 WHEN 'hybrid' THEN 0.3 ELSE 0 END * coalesce(sparse, 0), 12) AS score
   FROM conf CROSS JOIN ask CROSS JOIN cand LEFT JOIN dn USING (qs, ds, qid, cid) LEFT JOIN sx USING (qid, cid)),
 rk AS (SELECT *, row_number() OVER (PARTITION BY config, qid ORDER BY score DESC, cid) AS r FROM sc QUALIFY r <= 10),
 met AS (SELECT config, qid, 'turns_assistant' AS tag, qtype, coalesce(max(r) FILTER (cid = qid + 1), 0) AS rank FROM rk GROUP BY config, qid, qtype),
 mt AS (SELECT config, tag, qtype, (rank BETWEEN 1 AND 5)::INT::DOUBLE AS "hit@5", (rank BETWEEN 1 AND 10)::INT::DOUBLE AS "hit@10", (rank BETWEEN 1 AND 5)::INT::DOUBLE AS "recall@5", (rank BETWEEN 1 AND 10)::INT::DOUBLE AS "recall@10",
   CASE WHEN rank > 0 THEN 1 / rank ELSE 0 END AS "mrr@10", CASE WHEN rank > 0 THEN 1 / log2(rank + 1) ELSE 0 END AS "ndcg@10" FROM met)"""


@query(f"""WITH {_ENCODERS} SELECT config, 'document' AS group_kind, tag AS document, count(*) AS n_queries, {_AVG} FROM mt GROUP BY config, tag
 UNION ALL SELECT config, 'q_type', 'QTYPE(' || qtype || ')', count(*), {_AVG} FROM mt GROUP BY config, qtype
 UNION ALL SELECT config, 'document_q_type', tag || ' / ' || qtype, count(*), {_AVG} FROM mt GROUP BY config, tag, qtype
 UNION ALL SELECT config, 'overall', unnest(['ALL(다국어)', 'ALL']), count(*), {_AVG} FROM mt GROUP BY config""")
def encoder_comparison(spark, d):
    """Each turn of a user looks for the turn after it, in all turns of the other side."""
    rows = table(spark, d, "conversations").withColumn("chunk_index", F.col("conv_id") * 100 + F.col("turn")).withColumn("tag", F.concat(F.lit("turns_"), "role"))
    chunks = rows.select("tag", "chunk_index", "text")
    asked = rows.select(F.concat(F.lit("q"), "chunk_index").alias("qid"), F.lit("turns_assistant").alias("tag"), T.corpus_of(F.lit("turns_assistant")).alias("corpus"), F.col("text").alias("question"), F.when(F.length("text") > 200, "1 long").otherwise("2 short").alias("qtype"), F.array((F.col("chunk_index") + 1).cast("int")).alias("gold"), "role").filter("role = 'user'").drop("role")
    return V.roll_up(J.evaluate_job(asked, chunks, list(J.CONFIGS)))


# --- translation ------------------------------------------------------------------------------------------------------

def chat_chunks(spark, d):
    """Conversations as chunk texts, a line for each line said."""
    rows = table(spark, d, "conversations")
    said = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("10:46 "), F.col("role"), F.lit(": "), x)), "\n")
    return rows.select("conv_id", "turn", F.concat(F.lit("[대화] a | b\n"), said).alias("text"))


_LINES = r"""ch AS (SELECT conv_id, turn, list_prepend('[대화] a | b', list_transform(string_split(text, chr(10)), lambda x: '10:46 ' || role || ': ' || x)) AS l FROM conversations),
 lines AS (SELECT conv_id, turn, unnest(range(len(l)))::INT AS line_no, unnest(l) AS line FROM ch),
 p AS (SELECT conv_id, turn, line_no, CASE WHEN line_no = 0 THEN 'raw' ELSE 'msg' END AS kind, CASE WHEN line_no > 0 THEN '10:46' END AS ts, CASE WHEN line_no > 0 THEN regexp_extract(line, '^10:46 ([^:]+): ', 1) END AS who, CASE WHEN line_no = 0 THEN line ELSE regexp_extract(line, '(?s)^10:46 [^:]+: (.*)$', 1) END AS body FROM lines),
 b AS (SELECT DISTINCT body FROM p WHERE kind = 'msg' AND trim(body) <> '')"""


def chat_lines(spark, d):
    return X.lines_of(chat_chunks(spark, d), ["conv_id", "turn"])


@query(f"WITH {_LINES} SELECT * FROM p")
def message_lines(spark, d):
    return chat_lines(spark, d)


_NOISE = r"""(trim(body) = '' OR NOT regexp_matches(body, '[A-Za-zЀ-ӿ가-힣]') OR (length(trim(body)) > 400 AND len(regexp_extract_all(trim(body), 'https?://|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[\w.+-]+@[\w-]+\.[\w.]+\b')) >= 3))"""


@query(f"WITH b AS (SELECT doc_id, text AS body FROM documents) SELECT doc_id, {_NOISE} AS noise FROM b")
def noise(spark, d):
    return table(spark, d, "documents").select("doc_id", X.is_noise(F.col("text")).alias("noise"))


@query(f"WITH {_LINES}, n AS (SELECT body, {_NOISE} AS noise FROM b) SELECT (SELECT count(*) FROM p WHERE kind = 'msg') AS n_lines, count(*) AS n_bodies, sum(length(body))::BIGINT AS n_chars, count(*) FILTER (noise) AS n_noise, coalesce(sum(length(body)) FILTER (noise), 0)::BIGINT AS noise_chars FROM n")
def body_report(spark, d):
    return X.body_report(chat_lines(spark, d))


def lower_cased():
    """A model that answers each line of a prompt in lower case."""
    return lambda prompts: [p.lower() for p in prompts]


@query(f"WITH {_LINES} SELECT body, coalesce(nullif(trim(regexp_replace(lower(body), '^\\s+|\\s+$', '', 'g')), ''), body) AS text FROM b WHERE NOT {_NOISE}")
def translated_bodies(spark, d):
    """Distinct bodies that aren't noise, by packs and prompts through a model and its parsed answers."""
    todo = X.work_list(X.bodies(chat_lines(spark, d)), spark.createDataFrame([], Q.CACHE))
    return X.translated(todo, lambda: lower_cased())


def chat_cache(spark, d):
    rows = X.bodies(chat_lines(spark, d)).filter("length(body) % 2 = 0").select(F.lit(1).alias("seq"), F.col("body").alias("en"), F.lower("body").alias("ko"))
    return X.latest(rows.unionByName(rows.withColumn("seq", F.lit(2)).withColumn("ko", F.concat(F.lit("<"), "ko", F.lit(">")))))


@query(f"WITH {_LINES} SELECT body FROM b WHERE length(body) % 2 = 1 AND NOT {_NOISE}")
def translation_work(spark, d):
    return X.work_list(X.bodies(chat_lines(spark, d)), chat_cache(spark, d))


@query(f"WITH {_LINES}, o AS (SELECT conv_id, turn, line_no, CASE WHEN kind = 'raw' THEN body ELSE ts || ' ' || who || ': ' || CASE WHEN length(body) % 2 = 0 AND trim(body) <> '' THEN '<' || lower(body) || '>' ELSE body END END AS x FROM p) SELECT conv_id, turn, string_agg(x, chr(10) ORDER BY line_no) AS text FROM o GROUP BY ALL")
def rebuilt_texts(spark, d):
    return X.rebuilt(chat_lines(spark, d), chat_cache(spark, d), ["conv_id", "turn"])


@query(f"""WITH RECURSIVE {_LINES}, todo AS (SELECT body FROM b WHERE length(body) % 2 = 1 AND NOT {_NOISE}),
 dealt AS (SELECT body, length(body) AS n, ('0x' || substr(md5(body), 1, 8))::BIGINT % (SELECT greatest(1, ceil(count(*) / 20000.0)::BIGINT) FROM todo) AS shard FROM todo),
 o AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY n, body) AS r, sum(n) OVER (PARTITION BY shard ORDER BY n, body)::BIGINT AS upto FROM dealt),
 l AS (SELECT shard, list_prepend(0, list(upto ORDER BY r)) AS sums, count(*) FILTER (n <= 300) AS together, count(*) AS total FROM o GROUP BY shard),
 pk AS (SELECT shard, sums, together, total, -1 AS pack, 0::BIGINT AS first, 1::BIGINT AS next FROM l
   UNION ALL
   SELECT shard, sums, together, total, pack + 1, next, CASE WHEN next > together THEN next + 1 ELSE greatest(next + 1, least(next + 8, together + 1, len(list_filter(sums, lambda x: x <= sums[next] + 1200)))) END FROM pk WHERE next <= total)
 SELECT body, shard::INT AS shard, pack, (r - first + 1)::INT AS no FROM o JOIN pk USING (shard) WHERE r >= first AND r < next AND pack >= 0""")
def translation_packs(spark, d):
    todo = X.work_list(X.bodies(chat_lines(spark, d)), chat_cache(spark, d))
    return X.packs(todo, X.shards_for(todo))


@query(r"""SELECT conv_id, turn, unnest(range(1, len(l) + 1))::BIGINT AS no, unnest(list_transform(l, lambda x: trim(x))) AS text FROM (SELECT conv_id, turn, string_split(regexp_replace(text, '\n+', chr(10), 'g'), chr(10)) AS l FROM conversations)""")
def parsed_answers(spark, d):
    """Numbered lines of what was said, as a model answers."""
    rows = table(spark, d, "conversations").withColumn("l", F.split(F.regexp_replace("text", "\n+", "\n"), "\n"))
    answer = F.concat(F.lit("<think>\n1. no\n</think>"), F.array_join(F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.when(i % 2 == 0, ". ").otherwise(") "), x)), "\n"), F.lit("\n999999. gone\nstill gone"))
    return X.parsed_answers(rows.select("conv_id", "turn", F.size("l").alias("n"), answer.alias("answer")), ["conv_id", "turn"])


# --- gold labels, intervals, detections -------------------------------------------------------------------------------

_BLOCKS = r"""t AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
 c AS (SELECT doc_id, no, len(list_filter(string_split_regex(line, '\s+'), lambda x: x <> '')) AS n FROM t),
 bl AS (SELECT doc_id, no AS block, (sum(n) OVER w - n)::BIGINT AS tok_start, (sum(n) OVER w)::BIGINT AS tok_end FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY no))"""


def line_blocks(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "line"))
    rows = rows.select("doc_id", (F.col("block") + 1).cast("long").alias("block"), T.word_count(F.col("line")).alias("n_tokens"))
    return E.token_offsets(rows, "doc_id", "block").select("doc_id", "block", F.col("token_start").alias("tok_start"), F.col("token_end").alias("tok_end"))


_OVER = f"{_WINDOWS}, {_BLOCKS}, o AS (SELECT bl.doc_id, block, chunk_index FROM bl JOIN win ON bl.doc_id = win.doc_id AND token_start < tok_end AND token_end > tok_start)"


@query(f"WITH {_OVER} SELECT * FROM o")
def overlapping_chunks(spark, d):
    return G.overlapping(line_blocks(spark, d), windows(spark, d), "doc_id", 512)


@query(f"WITH {_OVER} SELECT bl.doc_id, bl.block, array_to_string(list_sort(list(chunk_index) FILTER (chunk_index IS NOT NULL)), ',') AS gold, CASE WHEN count(chunk_index) = 0 THEN 'missing' WHEN count(chunk_index) > 2 THEN 'too_many' ELSE 'ok' END AS status FROM bl LEFT JOIN o USING (doc_id, block) GROUP BY ALL")
def gold_labels(spark, d):
    got = G.gold(line_blocks(spark, d), windows(spark, d), "doc_id", 2)
    return got.select("doc_id", "block", F.when(F.size("gold") > 0, F.array_join(F.col("gold").cast("array<string>"), ",")).alias("gold"), "status")


@query("WITH t AS (SELECT 'c' || conv_id % 20 AS tag, conv_id, turn, role || length(text) % 9 AS question, CASE WHEN conv_id % 3 > 0 THEN 'charge ' || conv_id % 5 ELSE '' END AS charge FROM conversations), u AS (SELECT *, count(*) OVER (PARTITION BY tag, question) > 1 AND charge <> '' AS dis FROM t) SELECT tag, conv_id, turn, CASE WHEN dis THEN charge || ' 혐의 사건의 ' || question ELSE question END AS question, dis AS disambiguated FROM u")
def questions_told_apart(spark, d):
    rows = table(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id") % 20).alias("tag"), "conv_id", "turn", F.concat("role", F.length("text") % 9).alias("question"), F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("charge "), F.col("conv_id") % 5)).otherwise("").alias("charge"))
    return G.told_apart(rows).select("tag", "conv_id", "turn", "question", "disambiguated")


@query("WITH r AS (SELECT 'd' || conv_id % 20 AS tag, conv_id AS case_no, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS made FROM conversations) SELECT tag, case_no, turn, tag || '-' || lpad((row_number() OVER (PARTITION BY tag ORDER BY case_no, made))::VARCHAR, greatest(3, len((row_number() OVER (PARTITION BY tag ORDER BY case_no, made))::VARCHAR))::INT, '0') AS qid FROM r WHERE made <= 3")
def first_accepted_questions(spark, d):
    rows = table(spark, d, "conversations").select(F.concat(F.lit("d"), F.col("conv_id") % 20).alias("tag"), F.col("conv_id").alias("case_no"), "turn")
    return G.first_accepted(rows, 3).select("tag", "case_no", "turn", "qid")


@query("""WITH t AS (SELECT doc_id, coalesce(lang, '') || '_' || coalesce(source, '') AS tag, 'A-' || lpad((doc_id % 12)::VARCHAR, 3, '0') AS evidence FROM documents)
 SELECT doc_id, CASE WHEN starts_with(tag, 'en') THEN 'en' WHEN starts_with(tag, 'e') THEN 'e' WHEN starts_with(tag, 'fr_') THEN 'fr_' ELSE '?' END AS language, CASE WHEN contains(tag, 'web') THEN 'web' ELSE 'other' END AS task, CASE doc_id % 12 WHEN 1 THEN 'meaning' WHEN 8 THEN 'accounts' ELSE '' END AS evidence_type FROM t""")
def document_labels(spark, d):
    tag = F.concat_ws("_", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")))
    evidence = F.format_string("A-%03d", F.col("doc_id") % 12)
    return table(spark, d, "documents").select("doc_id", T.language_of(tag, ("e", "en", "fr_")).alias("language"), T.task_of(tag, "web", "web", "other").alias("task"), T.evidence_type(evidence, {1: "meaning", 8: "accounts"}).alias("evidence_type"))


def marked_documents(spark, d):
    """Documents in which two evidence blocks stand, the first one's id again at the end."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("tag"), F.concat(F.lit("head of it A-001 "), text, F.lit(" B-002 "), text, F.lit(" A-001 end")).alias("text"))


@query(rf"""WITH t AS (SELECT doc_id::VARCHAR AS tag, 'head of it A-001 ' || coalesce(text, '') || ' B-002 ' || coalesce(text, '') || ' A-001 end' AS text FROM documents),
 i AS (SELECT tag, text, unnest(['A-001', 'B-002']) AS block FROM t), p AS (SELECT tag, text, block, position(' ' || block || ' ' IN text)::INT AS char_start FROM i),
 e AS (SELECT *, coalesce(lead(char_start) OVER (PARTITION BY tag ORDER BY char_start), length(text))::INT AS char_end FROM p)
 SELECT tag, block, char_start, char_end, {_WORDS.format("substr(text, 1, char_start)")} AS tok_start, {_WORDS.format("substr(text, 1, char_end)")} AS tok_end FROM e""")
def evidence_spans(spark, d):
    docs = marked_documents(spark, d)
    return G.token_spans(G.block_spans(docs), docs).select("tag", "block", "char_start", "char_end", "tok_start", "tok_end")


def case_documents(spark, d):
    who = F.concat(F.lit("People: "), F.coalesce("lang", F.lit("none")), F.lit(", s"), F.col("doc_id") % 7)
    text = F.concat(who, F.lit("\nCharge: c"), F.col("doc_id") % 4, F.lit("\nA-001 "), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("tag"), text.alias("text"))


def case_profiles_of(spark, d):
    docs = case_documents(spark, d)
    none = F.lit(None).cast("string")
    labels = docs.select("tag", F.lit("People").alias("people"), F.lit("Orgs").alias("orgs"), none.alias("places"), F.lit("Terms").alias("keywords"), F.lit("Charge").alias("charge"))
    return G.profiles(docs, G.block_spans(docs), labels)


@query("SELECT doc_id::VARCHAR AS tag, 1 AS case_no, coalesce(lang, 'none') || ';s' || doc_id % 7 AS people, coalesce(lang, 'none') || ';s' || doc_id % 7 AS orgs, coalesce(lang, 'none') || ';s' || doc_id % 7 AS places, 'c' || doc_id % 4 AS charge FROM documents")
def case_profiles(spark, d):
    return case_profiles_of(spark, d).select("tag", "case_no", *[F.array_join(c, ";").alias(c) for c in ("people", "orgs", "places")], "charge")


@query("""WITH t AS (SELECT doc_id::VARCHAR AS tag, coalesce(lang, 'none') AS a, 's' || doc_id % 7 AS b, 'c' || doc_id % 4 AS charge FROM documents)
 SELECT tag, 1 AS case_no, charge, no + 1 AS block_no, CASE no WHEN 0 THEN a || ' and ' || b || '?' WHEN 1 THEN b || ' at ' || a || '?' ELSE a || '?' END AS question, no AS turn FROM t, (VALUES (0), (1), (2)) AS n(no)""")
def case_questions(spark, d):
    """Questions from templates with the people, organisations and places of each document's case."""
    templates = spark.createDataFrame([(0, 1, "{people:0} and {people:1}"), (1, 2, "{people:3} at {places:0}"), (2, 3, "{orgs:2}")], "no int, block_no int, text string")
    return G.questions(case_profiles_of(spark, d), templates, {"people": "someone", "orgs": "a firm", "places": "a place"}, "?")


@query(f"WITH {_OVER}, g AS (SELECT bl.doc_id, bl.block, count(chunk_index) AS n FROM bl LEFT JOIN o USING (doc_id, block) GROUP BY ALL) SELECT doc_id AS tag, count(*) FILTER (n BETWEEN 1 AND 2) AS n_questions, count(*) FILTER (n = 1) AS n_one, count(*) FILTER (n = 2) AS n_more, coalesce(avg(n) FILTER (n BETWEEN 1 AND 2), 0) AS mean_gold, 0 AS n_disambiguated, count(*) FILTER (n = 0) AS n_missing, count(*) FILTER (n > 2) AS n_too_many FROM g GROUP BY doc_id")
def gold_report(spark, d):
    got = G.gold(line_blocks(spark, d), windows(spark, d), "doc_id", 2).withColumnRenamed("doc_id", "tag")
    return G.build_report(got.filter("status = 'ok'").withColumn("disambiguated", F.lit(False)), got)


_UNION = """iv AS (SELECT l_orderkey AS key, l_quantity AS s, l_quantity + 400 * l_tax - 8 AS e FROM lineitem),
 ok AS (SELECT * FROM iv WHERE e > s), r AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ok),
 isl AS (SELECT *, sum(coalesce((s > reach)::INT, 1)) OVER (PARTITION BY key ORDER BY s, e) AS i FROM r), un AS (SELECT key, min(s) AS s, max(e) AS e FROM isl GROUP BY key, i)"""


def order_intervals(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_quantity").cast("string").alias("start"), (F.col("l_quantity") + 400 * F.col("l_tax") - 8).cast("string").alias("end"))


@query(f'WITH {_UNION} SELECT key, s AS start, e AS "end" FROM un')
def interval_union(spark, d):
    return I.union(order_intervals(spark, d), "key")


@query(f"""WITH {_UNION}, sp AS (SELECT o_orderkey AS key, (o_orderkey % 60)::DOUBLE AS d FROM orders), en AS (SELECT key, min(s) AS a, max(e) AS z FROM un GROUP BY key),
 gp AS (SELECT key, e AS a, lead(s) OVER (PARTITION BY key ORDER BY s) AS b FROM un UNION ALL SELECT sp.key, 0, en.a FROM sp JOIN en USING (key) UNION ALL SELECT sp.key, z, d FROM sp JOIN en USING (key) WHERE d > 0)
 SELECT key, round(a, 2) AS start, round(b, 2) AS "end" FROM gp WHERE b - a >= 0.1 UNION ALL SELECT key, 0, round(d, 2) FROM sp LEFT JOIN en USING (key) WHERE en.a IS NULL AND d > 0""")
def interval_complement(spark, d):
    spans = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 60).cast("double").alias("duration"))
    return I.complement(spans, order_intervals(spark, d), "key", "duration")


def detection_json(spark, d):
    """Orders as detection results: their lines are what was found."""
    box = F.struct(F.col("l_quantity").alias("x1"), F.col("l_tax").alias("y1"), (F.col("l_quantity") + 1).alias("x2"), (F.col("l_tax") + 1).alias("y2"))
    found = F.struct("l_linenumber", F.col("l_returnflag").alias("name"), F.col("l_discount").alias("confidence"), box.alias("box"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(found)).alias("r"), F.sum("l_quantity").alias("q"))
    results = F.transform("r", lambda x: F.struct(x["name"].alias("name"), x["confidence"].alias("confidence"), x["box"].alias("box")))
    speed = F.struct((F.col("l_orderkey") % 5).cast("double").alias("preprocess"), F.col("q").alias("inference"))
    images = F.array(F.struct(F.array(F.lit(480), F.lit(640)).alias("shape"), speed.alias("speed"), results.alias("results")))
    return rows.select("l_orderkey", F.to_json(F.struct(images.alias("images"), F.struct((F.col("l_orderkey") % 100 / 1000).alias("functionTimeCall")).alias("metadata"))).alias("json"))


@query("SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_discount, l_quantity, l_tax) - 1)::INT AS no, l_returnflag AS name, round(l_discount * 100, 6) AS confidence, l_quantity AS x1, l_tax AS y1, l_quantity + 1 AS x2, l_tax + 1 AS y2 FROM lineitem")
def detection_rows(spark, d):
    return D.detections(detection_json(spark, d), ["l_orderkey"], "json").withColumn("confidence", F.round("confidence", 6))


@query("SELECT l_orderkey, count(*)::INT AS n_detections, round(l_orderkey % 5 + sum(l_quantity), 6) AS total, round(greatest(0, l_orderkey % 100 - (l_orderkey % 5 + sum(l_quantity))), 6) AS network FROM lineitem GROUP BY l_orderkey")
def detection_latencies(spark, d):
    return D.latencies(detection_json(spark, d), ["l_orderkey"], "json").select("l_orderkey", "n_detections", F.round("total", 6).alias("total"), F.round("network", 6).alias("network"))


@query("SELECT 'c_' || role AS tag, role AS corpus, conv_id || '-' || turn AS qid, text AS question, CASE WHEN turn % 3 = 0 THEN '' ELSE (turn % 3)::INT || ' ' || CASE turn % 3 WHEN 1 THEN 'one' ELSE 'two' END END AS qtype, conv_id AS gold FROM conversations")
def qa_questions(spark, d):
    """Conversations as QA records of one corpus each, in the older form for odd turns."""
    rows = table(spark, d, "conversations")
    index = F.col("conv_id").cast("int")
    pair = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("question"), (F.col("turn") % 3).cast("int").alias("q_type"), F.when(F.col("turn") % 3 == 1, "one").alias("q_type_name"), F.when(F.col("turn") % 2 == 0, F.array(index)).alias("answer_chunk_indices"), F.when(F.col("turn") % 2 == 1, index).alias("answer_chunk_index"), F.lit(None).cast("string").alias("evidence_id"))
    corpora = F.when(F.col("turn") % 2 == 0, F.array(F.struct(F.concat(F.lit("c_"), "role").alias("tag"), F.col("role").alias("corpus"), F.lit(None).cast("string").alias("embedding_file"))))
    files = rows.select(F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("embedding_file"), corpora.alias("corpora"), F.array(pair).alias("qa_pairs"), F.concat(F.lit("x/c_"), "role", F.lit("_qa.json")).alias("file"))
    got = Q.questions(files)
    return got.select("tag", "corpus", "qid", "question", T.question_type(F.col("q_type"), F.col("q_type_name"), {2: "two"}).alias("qtype"), F.col("gold")[0].cast("long").alias("gold"))
