"""The registered queries of the operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    chat, fingerprints, jaccard, language, mixing, neighbours, packing, quality, repeats, resampling, simhash,
    tokens, vector_codes)
from plumbline.session import materialise

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@query(r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
totals AS (
  SELECT source, sum(size)::HUGEINT AS s, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::HUGEINT AS w
  FROM sized GROUP BY source),
judged AS (
  SELECT *, sum(s) OVER () - coalesce(sum(3 * s) OVER o, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS weights
  FROM totals WINDOW o AS (ORDER BY s::DOUBLE / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT *, rest * w > 3 * s * weights AS stops FROM judged),
targets AS (
  SELECT source, s::BIGINT AS source_size, CASE WHEN stops THEN (3 * s)::DOUBLE ELSE coalesce(
      ((max(rest) FILTER (NOT stops) OVER ()) * w)::DOUBLE / (max(weights) FILTER (NOT stops) OVER ())::DOUBLE, 0) END AS target
  FROM filled),
placed AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS epochs,
    coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - ahead)))::BIGINT AS taken
FROM placed
""")
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return fingerprints.edit_report(docs).drop("signature", "edited_signature")


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    blocks = materialise(tokens.write_blocks(docs), "token-blocks")
    return tokens.named_counts(blocks)


@query()
def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query()
def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents", "doc_id", "text"))
    return groups.withColumn("fingerprint", simhash.hex_digits(F.col("fingerprint")))


@query()
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return neighbours.nearest(rows, "vec_id", "embedding", F.col("vec_id") % 20 == 0)


@query(r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(nullif(trim(role, ' '), ''), 'unknown') AS who, coalesce(text, '') AS text FROM conversations),
speakers AS (SELECT DISTINCT conv_id, who AS speaker FROM said),
views AS (
  SELECT said.*, speaker, who = speaker AS own,
    CASE WHEN who = speaker THEN '<|assistant|>' || chr(10) ELSE '<|user|>' || who || ': ' END AS head
  FROM said JOIN speakers ON said.conv_id IS NOT DISTINCT FROM speakers.conv_id),
sized AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM views),
placed AS (
  SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, who, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "start"
  FROM sized)
SELECT conv_id, speaker, turn, CASE WHEN own THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN NOT own THEN who END AS name, segment, "start", "start" + length(head) AS mask_start,
  CASE WHEN own THEN length(segment) - length(head) ELSE 0 END AS mask_length
FROM placed
""")
def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


@query()
def op7_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = language.remainder(F.col("doc_id")) == 1
    model = language.fit(docs, ~held_out)
    found = language.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


@query()
def op6_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    model = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    judged = quality.judge(docs, model, F.col("source"), F.col("lang"), keep_text=False)
    return judged.select("doc_id", "good", "site_posterior", "posterior", "keep")


@query()
def op4_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return left.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


@query(r"""
WITH steps AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
words AS (
  SELECT 1 AS kind, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 2, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
hashed AS (
  SELECT word, xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM words), steps),
counts AS (
  SELECT bucket, count(*) FILTER (kind = 1) AS s, count(*) FILTER (kind = 2) AS t FROM words JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM counts),
gained AS (
  SELECT word, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
  FROM hashed JOIN counts USING (bucket), totals),
weighed AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM words JOIN gained USING (word) WHERE kind = 1 GROUP BY doc_id),
scored AS (
  SELECT documents.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || documents.doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296))))::BIGINT AS score
  FROM documents LEFT JOIN weighed USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank
FROM placed
""")
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return resampling.resample(docs, table(spark, sf_dir, "benchmark", "text"))


def _vector_codes_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """K-means of every part, round by round."""

    def assigned(r: int) -> str:
        return f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, part, p, entry, d FROM (
    SELECT vec_id, p.part, p, entry, list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - c[i]) * (p[i] - c[i])))::BIGINT AS d
    FROM parts p JOIN b{r} b ON p.part = b.part)
  QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)"""

    def means(r: int) -> str:
        return f"""
s{r} AS (
  SELECT part, entry, pos, sum(p[pos])::BIGINT AS s, count(*) AS n
  FROM (SELECT part, entry, p, unnest(range(1, len(p) + 1)) AS pos FROM a{r}) GROUP BY ALL),
m{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM s{r} GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (part, entry))"""

    return """
WITH kept AS (
  SELECT vec_id, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)), 'bool_and')),
comps AS (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM kept),
parts AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (len(e) // 8) AS part, list(floor(4096 * e[i]::DOUBLE)::BIGINT ORDER BY i) AS p FROM comps GROUP BY ALL),
b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, p AS c FROM parts
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 16),""" + ",".join(
        [assigned(r) + "," + means(r) for r in range(rounds)] + [assigned(rounds)]) + f""",
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN embeddings USING (vec_id)
"""


@query(_vector_codes_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")).drop("label")


@query()
def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents", "doc_id", "text"))
