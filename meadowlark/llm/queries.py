"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audio, conversations, html_text, langid, licenses, minhash, mixing, packing, pii, spelling, substring_dedup, toxicity
from .common import is_held_out, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, weights, keep_text=False).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents")))


def op5_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), "base_sha256", pii.as_text(F.col("found")).alias("spans"))


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs)).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audio.media_features(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(spelling.damaged_runs(table(spark, sf_dir, "documents"))))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s["exact"]))
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform("base", lambda s: s["first"])
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels("base").alias("base_labels"), labels("spans").alias("labels"), score.alias("score"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))
    hashes = conversations.repaired_hashes(repaired.turns).withColumnRenamed("conv_id", "_conv")
    return repaired.summary.join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_mix_sources, op3_toxicity, op4_best_fit_packing, op5_contextual_pii, op6_permutation_index, op7_main_text, op8_language_id, op9_audio_features, op10_near_duplicates, op11_spelling_variants, op12_license_scan, op13_conversation_repair)}


OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')), 1, 15) AS BIGINT) AS hash
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         source_size * 3 AS cap FROM sizes),
rising AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM weighed),
level AS (
  SELECT (total - capped)::DOUBLE / open AS level FROM rising
  WHERE (total - capped)::DOUBLE / open * weight <= cap ORDER BY capped LIMIT 1),
targets AS (
  SELECT source, source_size, least(weight * level, cap::DOUBLE) AS target,
         CASE WHEN source_size > 0 THEN floor(least(weight * level, cap::DOUBLE) / source_size)::BIGINT ELSE 0 END AS whole
  FROM weighed, level),
running AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY hash, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM docs)
SELECT d.doc_id, d.size, t.source_size, t.target,
       (d.size * (t.whole + CASE WHEN upto * 2 - size <= (t.target - t.whole * t.source_size) * 2 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
"""


def _op12_sql() -> str:
    """Phrases by comparing words at every place; notices by runs of words that stand in both, and their offsets."""
    values = lambda rows: ", ".join(f"({i}, '{text}', '{label}')" for i, (text, label) in enumerate(rows))
    k = licenses.NOTICE_K
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
placed AS (SELECT r, w, unnest(range(len(w))) AS p FROM docs),
phrases AS (SELECT label, string_split(words, ' ') AS words FROM (VALUES {values(licenses.PHRASES)}) t(i, words, label)),
notices AS (SELECT i, label, string_split(words, ' ') AS words FROM (VALUES {values(licenses.NOTICES)}) t(i, words, label)),
base AS (SELECT r, label, p FROM placed JOIN phrases ON w[p + 1] = words[1] AND w[p + 1 : p + len(words)] = words),
grams AS (SELECT i, label, len(words) AS length, q, words[q + 1 : q + {k}] AS gram FROM (SELECT *, unnest(range(len(words) - {k} + 1)) AS q FROM notices)),
hits AS (SELECT r, i, label, length, p, q, p - q AS d FROM placed JOIN grams ON w[p + 1] = gram[1] AND w[p + 1 : p + {k}] = gram),
fresh AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY r, i ORDER BY d) <= {licenses.NEAR} THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT r, i, d FROM hits)),
parts AS (SELECT r, i, d, sum(fresh) OVER (PARTITION BY r, i ORDER BY d) AS part FROM fresh),
spans AS (
  SELECT r, i, label, length, part, min(p) AS first, max(p) + {k} - 1 AS last, list_distinct(flatten(list(range(q, q + {k})))) AS places
  FROM hits JOIN parts USING (r, i, d) GROUP BY r, i, label, length, part),
good AS (SELECT r, label, len(places) / length::DOUBLE AS score FROM spans WHERE len(places) / length::DOUBLE >= {licenses.COVERED} AND last - first + 1 <= length * {licenses.STRETCHED}),
every AS (SELECT r, label, 1.0::DOUBLE AS score FROM base UNION ALL SELECT * FROM good),
counts AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM every GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM docs LEFT JOIN counts USING (r) LEFT JOIN named USING (r)
"""


def _op13_sql() -> str:
    """The cheapest edits as a recursion over rows: for each state the least (cost, edits, lines) that reach it."""
    crc = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda ch: ascii(ch)::BIGINT)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

    def edited(state: str, cost: str, edit: str, line: str = "") -> str:
        lines = f"{state}.o || chr(10) || {line}" if line else f"{state}.o"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'o': {lines}}} END"

    least = lambda *states: f"list_sort(list_filter([{', '.join(states)}], lambda e: e IS NOT NULL))[1]"
    kept = lambda state, initial: f"CASE WHEN NOT goes AND left(role, 1) = '{initial}' THEN {edited(state, 'cut', 'K', chr(39) * 2 + ' || role || ' + chr(39) + ':' + chr(39) + ' || text')} END"
    put = lambda state, role: f"CASE WHEN NOT goes THEN {edited(state, '3 + cut', 'R', f'{chr(39)}{role}:{chr(39)} || text')} END"
    insert = lambda state, role: edited(state, "3", "I", f"'{role}:'")
    gone = lambda state: edited(state, "4", "D")
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hashed AS (SELECT *, ({crc}) % 20 AS how FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
  FROM numbered),
faults AS (
  SELECT *, last = '' AS blank, last <> '' AND nth > 1 AS duplicate, last <> '' AND nth = 1 AND last NOT IN ('.', '!', '?') AS truncated FROM ordered),
coded AS (SELECT conv_id, i, role, text, blank OR duplicate AS goes, CASE WHEN truncated THEN 3 ELSE 0 END AS cut FROM faults),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
closed AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS n, NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR) AS s, {{'c': 3::BIGINT, 'a': 'I', 'o': chr(10) || 'user:'}} AS u,
         {{'c': 6::BIGINT, 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, n, s, u, {least("a", insert("u", "assistant"))} AS a FROM (
    SELECT conv_id, i, n, s, {least("u", insert("n", "user"), insert("s", "user"), insert("a", "user"))} AS u, a FROM (
      SELECT d.conv_id, d.i + 1 AS i, {gone("n")} AS n, {least(gone("s"), kept("n", "s"))} AS s,
             {least(gone("u"), kept("n", "u"), kept("s", "u"), kept("a", "u"), put("n", "user"), put("s", "user"), put("a", "user"))} AS u,
             {least(gone("a"), kept("u", "a"), put("u", "assistant"))} AS a
      FROM closed d JOIN coded c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.i = d.i + 1)))
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       least(d.n, d.a).c AS cost, least(d.n, d.a).a AS audit, sha256(substr(least(d.n, d.a).o, 2)) AS repaired_sha256
FROM closed d LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM d.conv_id WHERE d.i = coalesce(k.n, 0)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": OP2_SQL, "op12_license_scan": _op12_sql(), "op13_conversation_repair": _op13_sql()}
