"""The queries of this folder's operators: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import bpe, chat, codes, decontaminate, fingerprint, lm, neardup, pii, quality, rules, substrings, toxicity, whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bpe.encode_decode(documents(spark, sf_dir))
    return df.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded_text").cast("binary"), 256).alias("decoded_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pii.find_personal_data(documents(spark, sf_dir), keep_text=False)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return df.select("doc_id", *map(number, pii.KINDS), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


#: A conversation whose texts hold the template's control strings.
TRICKY = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    df = chat.read_back(chat.format_conversations(rows.union(spark.createDataFrame(TRICKY, rows.schema))))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return df.select("conv_id", "n_turns", sha("turns_text").alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), sha("loss_text").alias("loss_sha256"), "formatted_chars")


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || url_encode(role) || ': ') + length(text) + len(regexp_extract_all(text, '### [A-Za-z0-9_.~%-]*: |</turn>')) + length(' </turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(documents(spark, sf_dir))


def _judged(df: DataFrame, threshold: float) -> DataFrame:
    return df.select("doc_id", (C.crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return _judged(quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels"))), 0.7)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return _judged(toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))), 0.3)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(documents(spark, sf_dir), 85).select("doc_id", "n_shingles", "component_id", "kept")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its benchmark items: doc_id, item_id, similarity of the best window."""
    found = decontaminate.find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.round(F.max(F.col("common") / F.col("total")), 6).alias("similarity"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = substrings.remove_repeats(documents(spark, sf_dir))
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda: C.crc_mod(F.col("doc_id"), 7) == 2
    df = lm.score(documents(spark, sf_dir), ~held_out())
    return df.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", (F.col("score") / F.col("n_tokens")).alias("per_token"), ((F.col("score") - F.col("base_score")) / F.col("n_tokens")).alias("gain_per_token"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rules.judge(documents(spark, sf_dir), table(spark, sf_dir, "labels"), keep_text=False)
    return df.select("doc_id", *rules.BASE, "base_failed", "kept", "llr_sum", "n_grams")


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
each AS (SELECT rid, unnest(range(len(w))) AS p, unnest(w) AS a FROM w),
three AS (SELECT rid, p, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM each WINDOW o AS (PARTITION BY rid ORDER BY p)),
again AS (SELECT rid, unnest(list(p)) AS p FROM three WHERE c IS NOT NULL GROUP BY rid, a, b, c HAVING count(*) > 1),
covered AS (SELECT rid, count(DISTINCT p + k) AS n FROM again, (VALUES (0), (1), (2)) t(k) GROUP BY rid),
base AS (SELECT d.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d JOIN w USING (rid) LEFT JOIN covered USING (rid)),
tokens AS (SELECT rid, unnest(range(len(t))) AS p, unnest(t) AS t FROM (SELECT rid, regexp_extract_all(text, '{rules.TOKEN}') AS t FROM d)),
crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS r),
known AS (SELECT t, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen(t)), lambda i: ('0x' || substr(hex(t), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, r[(xor(c, b) & 255) + 1]))) AS h FROM (SELECT DISTINCT t FROM tokens), crc_table),
numbers AS (SELECT rid, p, h FROM tokens JOIN known USING (t)),
grams AS (SELECT rid, h % {rules.BUCKETS} AS bucket FROM numbers UNION ALL
  SELECT rid, (g * 1000003 + h) % {rules.BUCKETS} FROM (SELECT rid, h, lag(h) OVER (PARTITION BY rid ORDER BY p) AS g FROM numbers) WHERE g IS NOT NULL),
ids AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 7))::BIGINT % {rules.APART} = 0 AS apart FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)),
counts AS (SELECT bucket, count(*) AS n, count(*) FILTER (WHERE NOT apart) AS mine FROM grams JOIN d USING (rid) LEFT JOIN ids USING (doc_id) GROUP BY bucket),
weights AS (SELECT bucket, floor((ln((mine + 1)::DOUBLE / (sum(mine) OVER () + {rules.BUCKETS})::DOUBLE) - ln((n + 1)::DOUBLE / (sum(n) OVER () + {rules.BUCKETS})::DOUBLE)) * {rules.UNITS} + 0.5)::BIGINT AS weight FROM counts),
scored AS (SELECT base.*, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed, coalesce(s, 0)::BIGINT AS llr_sum, coalesce(g, 0)::BIGINT AS n_grams, coalesce(s::DOUBLE / ({rules.UNITS}.0::DOUBLE * g), 0) AS llr
  FROM base LEFT JOIN (SELECT rid, sum(weight) AS s, count(*) AS g FROM grams JOIN weights USING (bucket) GROUP BY rid) USING (rid)),
steps AS (SELECT floor(llr * {rules.STEPS}) AS step, count(*) AS n FROM scored JOIN ids USING (doc_id) WHERE apart AND NOT base_failed GROUP BY step),
chosen AS (SELECT (3 * max(step) FILTER (WHERE below * 1000 <= {rules.LOST} * total) - max(step) FILTER (WHERE below * 2 <= total))::DOUBLE / {2 * rules.STEPS} AS threshold FROM (SELECT step, sum(n) OVER (ORDER BY step) - n AS below, sum(n) OVER () AS total FROM steps))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(llr >= threshold, true) AS kept, llr_sum, n_grams FROM scored, chosen
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    df = codes.with_label_errors(coded)
    return df.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.books_sha256(books)).alias("codebooks_sha256"))


def _op12_sql() -> str:
    """Every distance of every part to every entry, in each round."""
    width = f"(len(v) // {codes.PARTS})"
    steps = f"""
k AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda e: floor({codes.SCALE} * e::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS (SELECT rid, p, v[p * {width} + 1 : (p + 1) * {width}] AS x FROM k, (SELECT unnest(range({codes.PARTS})) AS p)),
b0 AS (SELECT p, e, x AS b FROM x JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM k ORDER BY vec_id, v LIMIT {codes.ENTRIES}) USING (rid))"""
    nearest = lambda b: f"SELECT rid, p, arg_min(e, (d, e)) AS e, min(d) AS d, any_value(x) AS x FROM (SELECT rid, x.p, e, x, list_sum(list_transform(list_zip(x, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN {b} USING (p)) GROUP BY rid, p"
    for r in range(codes.ROUNDS):
        steps += f""",
a{r} AS ({nearest(f"b{r}")}),
m{r} AS (SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM x) + 1)) AS i) GROUP BY ALL),
b{r + 1} AS (SELECT p, e, coalesce(any_value(t.b), any_value(o.b)) AS b FROM b{r} o LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS b FROM m{r} GROUP BY p, e) t USING (p, e) GROUP BY p, e)"""
    return f"""WITH {steps},
f AS ({nearest(f"b{codes.ROUNDS}")}),
g AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM f GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, e)) FROM b{codes.ROUNDS}) AS codebooks_sha256 FROM g JOIN k USING (rid)"""


OP12_SQL = _op12_sql()


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = whiten.whiten(table(spark, sf_dir, "embeddings")).select("*", F.posexplode("whitened").alias("i", "value"))
    return df.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"), F.get("explained", "i").alias("explained"), "identity_error")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_pii, op3_quality, op4_toxicity, op5_near_dedup, op6_chat, op7_lm, op8_decontaminate, op9_substrings, op10_fingerprint, op11_quality_rules, op12_vector_codes, op13_whitening)}
ORACLE_SQL = {"op6_chat": OP6_SQL, "op11_quality_rules": OP11_SQL, "op12_vector_codes": OP12_SQL}
