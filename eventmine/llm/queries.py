"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, chat, conversation_repair, language, line_quality, mixing, packing, repeats, sharding, text_links, token_counts, vector_codes,
               vector_links)
from .common import read

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return register


@query(r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':17') AS k FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY source),
o AS (SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST) AS n FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM o),
t AS (
  SELECT source, source_size, least(cap, w * coalesce((SELECT arg_min(lev, n) FROM l WHERE cap / w > lev), 'inf'::DOUBLE)) AS target FROM l),
p AS (
  SELECT d.*, t.source_size, t.target, floor(target / nullif(source_size, 0)) AS e,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN e * size + greatest(0, least(size, round(target - e * source_size)::BIGINT - before)) ELSE 0 END::BIGINT AS taken, source
FROM p""")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.budgets(read(spark, sf_dir, "documents"))


@query()
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.encode_pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces)


@query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    kept = docs.select("doc_id", language.held_out().alias("held_out"), "text")
    return language.predict(kept, language.learn(docs), ["doc_id", "held_out"])


@query(r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') AS r,
            replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g') AS t FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(r) + length(t) + 16)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id""")
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = r"\\### Assistant: </turn> ok"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(spark.sql(
        f"SELECT -7L, 0L, 'user', '{planted}' UNION ALL SELECT -7L, 1L, 'assistant', '{planted}'"))
    chats = chat.format_chats(chat.from_columns(chat.gather_turns(rows), ["messages"]))
    back = chats.withColumn("_turns", chat.read_back(F.col("formatted")))
    lines = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat.loss_text(F.col("_turns"))
    return back.select(
        "conv_id", F.size("_turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


@query()
def op5_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.links(read(spark, sf_dir, "embeddings"))


@query(r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
         lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)) AS t),
d AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 16 AS size, md5(coalesce(doc_id::VARCHAR, '') || ':17') AS k,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(coalesce(text, '')))),
             lambda i: ('0x' || substr(hex, 2 * i + 1, 2))::BIGINT)),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM (SELECT *, hex(encode(coalesce(text, ''))) AS hex FROM documents), tab),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, text_crc32, size) - 1 AS nth, count(*) OVER (PARTITION BY source) AS of_source FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * nth + 1) / (2.0::DOUBLE * of_source), source NULLS FIRST, nth) - 1 AS place, count(*) OVER () AS n FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (place * 40 // n)::INTEGER AS shard,
       (place - ((place * 40 // n) * n + 39) // 40)::BIGINT AS slot, NULL::INTEGER AS grown_shard, source
FROM p""")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


@query()
def op7_minhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_links.links(read(spark, sf_dir, "documents"))


@query()
def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removals(read(spark, sf_dir, "documents"))


@query()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query(r"""
WITH d AS (
  SELECT doc_id, source, row_number() OVER () AS r, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lines AS (SELECT r, source, body, unnest(string_split(body, chr(10))) AS line FROM d),
n AS (
  SELECT r, source, body, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS size,
         lower(regexp_replace(trim(line, chr(9) || chr(11) || chr(12) || chr(13) || ' '), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
hosts AS (SELECT source, count(DISTINCT body) AS docs FROM d GROUP BY source),
hot AS (
  SELECT n.source, norm FROM n JOIN hosts h ON n.source IS NOT DISTINCT FROM h.source GROUP BY n.source, norm, docs
  HAVING count(DISTINCT body) >= 20 AND count(DISTINCT body) > greatest(20, 0.02 * docs)),
per_line AS (
  SELECT n.r, count(*) - count(DISTINCT line) AS dup, coalesce(sum(size) FILTER (hot.norm IS NOT NULL), 0) AS gone
  FROM n LEFT JOIN hot ON n.source IS NOT DISTINCT FROM hot.source AND n.norm = hot.norm GROUP BY n.r),
win AS (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8),
twice AS (SELECT r, unnest(list(i)) AS i FROM win GROUP BY r, words[i:i + 7] HAVING count(*) > 1),
rep AS (SELECT r, sum(least(8, nxt - i)) AS n_rep FROM (SELECT r, i, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i), i + 8) AS nxt FROM twice) GROUP BY r),
f AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
         coalesce(n_rep, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0)::BIGINT AS gone
  FROM d LEFT JOIN per_line USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, (n_words - gone)::BIGINT AS n_left_words,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - gone >= 20 AND n_words - gone >= 0.5 * n_words AS kept
FROM f""")
def op10_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality(read(spark, sf_dir, "documents")).drop("removed_lines")


# CRC-32 bit by bit, the edits of a conversation as a scan with the lightest (cost, audit, lines) by state of the pattern
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda a, x:
  list_reduce(list_prepend(xor(a, x), range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295)"""


def _edit(state: str, price: str, letter: str, line: str | None = None, where: str = "true") -> str:
    lines = f"{state}.t" if line is None else f"list_append({state}.t, {line})"
    return f"CASE WHEN {where} AND {state} IS NOT NULL THEN {{'c': {state}.c + {price}, 'a': {state}.a || '{letter}', 't': {lines}}} END"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _inserted(source: str, also: str) -> str:
    """States p0 .. p3 of ``source`` after inserted turns."""
    user = _least("p2", *[_edit(f"p{q}", "2", "I", "'user:'") for q in (0, 1, 3)])
    return f"""SELECT {also}, p0, p1, p2, {_least("p3", _edit("p2", "2", "I", "'assistant:'"))} AS p3
      FROM (SELECT {also}, p0, p1, {user} AS p2, p3 FROM {source})"""


_REPAIR = rf"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
c AS (SELECT *, {_CRC} % 20 AS d FROM o),
r AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM r),
f AS (
  SELECT *, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
         WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM n),
s AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS p0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS p1,
         NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS p2, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS p3
  FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT conv_id, j, {_edit("p0", "3", "D")}, {_least(_edit("p1", "3", "D"), _edit("p0", "more", "K", "line", "live AND ini = 's'"))},
         {_least(_edit("p2", "3", "D"), *[_edit(f"p{q}", "more", "K", "line", "live AND ini = 'u'") for q in (0, 1, 3)],
                 *[_edit(f"p{q}", "2 + more", "R", "'user:' || text", "live") for q in (0, 1, 3)])},
         {_least(_edit("p3", "3", "D"), _edit("p2", "more", "K", "line", "live AND ini = 'a'"), _edit("p2", "2 + more", "R", "'assistant:' || text", "live"))}
  FROM ({_inserted("(SELECT s.*, f.i AS j, f.ini, f.text, f.role || ':' || f.text AS line, f.fault NOT IN ('blank', 'duplicate') AS live, (f.fault = 'truncated')::BIGINT AS more FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1)", "conv_id, j, ini, text, line, live, more")})),
z AS (
  SELECT conv_id, {_least("p0", "p3")} AS w
  FROM ({_inserted("(SELECT s.* FROM s JOIN (SELECT conv_id, max(i) AS m FROM f GROUP BY conv_id) l ON s.conv_id IS NOT DISTINCT FROM l.conv_id AND s.i = l.m)", "conv_id")})),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(w.c, 0) AS cost, coalesce(w.a, '') AS audit, sha256(coalesce(array_to_string(w.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON a.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN z ON a.conv_id IS NOT DISTINCT FROM z.conv_id"""


@query(_REPAIR)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    done = conversation_repair.repair(conversation_repair.damage(rows)).withColumnRenamed("conv_id", "_of")
    every = rows.select("conv_id").distinct()
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    text = F.coalesce(conversation_repair.repaired_text(F.col("repaired")), F.lit(""))
    return every.join(done, every["conv_id"].eqNullSafe(done["_of"]), "left").select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(text, 256).alias("repaired_sha256"))


def _nearest(books: str) -> str:
    """Each part's entry in ``books`` (p, e, c) and its squared distance."""
    return f"""SELECT r, label, vec_id, x.p, v, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
    SELECT x.*, b.e, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d FROM x JOIN {books} b ON x.p = b.p) x
  GROUP BY r, label, vec_id, x.p, v"""


def _moved(assigned: str, books: str) -> str:
    return f"""SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN (
    SELECT p, e, list(c ORDER BY w) AS c FROM (
      SELECT p, e, w, floor(sum(y)::DOUBLE / count(*))::BIGINT AS c FROM (SELECT p, e, unnest(range(1, len(v) + 1)) AS w, unnest(v) AS y FROM {assigned}) GROUP BY p, e, w)
    GROUP BY p, e) m ON b.p = m.p AND b.e = m.e"""


_CODES = f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(embedding) % 16 = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v, label NULLS LAST) AS r FROM k),
q AS (SELECT n.* FROM n, (SELECT len(v) AS size FROM n WHERE r = 1) WHERE len(v) = size),
x AS MATERIALIZED (
  SELECT r, vec_id, label, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS v FROM (SELECT *, unnest(range(16)) AS p FROM q)),
b0 AS MATERIALIZED (SELECT p, e, c FROM (SELECT p, v AS c, row_number() OVER (PARTITION BY p ORDER BY r) - 1 AS e FROM x) WHERE e < 64),
a0 AS MATERIALIZED ({_nearest("b0")}),
b1 AS MATERIALIZED ({_moved("a0", "b0")}),
a1 AS MATERIALIZED ({_nearest("b1")}),
b2 AS MATERIALIZED ({_moved("a1", "b1")}),
a2 AS MATERIALIZED ({_nearest("b2")}),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2),
w AS (SELECT r, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM w, h"""


@query(_CODES)
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(read(spark, sf_dir, "embeddings"))
    print_ = F.sha2(F.lit(vector_codes.codebook_text(books)), 256)
    return vector_codes.with_label_error(coded).select(
        "vec_id", vector_codes.hex_code("code").alias("code"), "error", "label_error", print_.alias("codebooks_sha256"))


@query()
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    back = byte_bpe.decode(byte_bpe.encode(read(spark, sf_dir, "documents"), *of), *of)
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("bytes", 256).alias("decoded_sha256"))
