"""The corpus pipeline: five stages over the documents, each a function of (spark, docs, sf_dir).

Every stage takes null and empty texts, null and repeated ids, repeated rows,
very long texts and further columns of any name, and gives an empty table for
one; all but the last return the rows that they keep with all their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import _common as C
from stepweave.llm import bpe, decontaminate, neardup, pii, quality
from stepweave.llm.queries import table

#: Hundredths of similarity from which near_dedup links; op5's 85 is its own query's.
LINKED = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more, by a model of this table's trusted rows; without labels all.

    Null texts score as empty ones.  Equal texts score alike, so repeated rows stay or go together.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = "_score" + "_" * max(map(len, docs.columns))  # longer than any column, so not one of docs
    return quality.score_quality(docs, model, score_col=score).where(F.col(score) >= 0.7).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-copies (LINKED hundredths): that of the least id, of two texts with that id the one of the lesser hash.

    Of repeated rows of it one stays; rows without words are in no class and stay all.
    """
    stays = neardup.link(docs, LINKED).where("stays").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count(F.when(F.col("n_shingles") > 0, 1)).alias("_rows"))
    stays = C.cut(stays)

    def of(chosen: DataFrame) -> DataFrame:
        return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["_id"]) & (F.xxhash64(docs["text"]) == chosen["_hash"]), "left_semi")

    once, repeated = of(stays.where("_rows < 2")), stays.where("_rows > 1")
    return once if repeated.isEmpty() else once.unionByName(of(repeated).dropDuplicates(["doc_id", "text"]))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands, of however few words; null and empty texts hold none, and of repeated rows all go or stay."""
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), short_within=True).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["_id"]) & (F.xxhash64(docs["text"]) == leaks["_hash"]), "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind in brackets; n_chars follows, and null texts stay null."""
    hidden = docs.toDF(*[c if c in ("text", "n_chars") else f"_{i}_" for i, c in enumerate(docs.columns)])  # no column of docs is taken for one of the operator's
    return pii.redact(pii.find_personal_data(hidden)).select(*hidden.columns).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source (those that are there), number of tokens, the packed ids, the SHA-256 of what they decode to, and whether that is the text.

    A row for each row; null and empty texts have no tokens and decode to the empty text.
    """
    done = bpe.encode_decode(docs)
    same = F.col("decoded_text") == F.coalesce("text", F.lit(""))
    kept = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return done.select(*kept, "n_tokens", "token_ids", F.sha2(F.col("decoded_text").cast("binary"), 256).alias("decoded_sha256"), same.alias("decoded_same"))


STAGES = [("quality", keep_quality), ("near_dedup", drop_near_copies), ("decontaminate", drop_leaks), ("pii", redact_personal_data), ("bpe", encode)]

#: No SQL: the quality score and the token ids aren't expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written to the shared folder and read again; what a stage has read goes when it is done."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, C.cut(stage(spark, docs, sf_dir))
        C.free(before)
    return docs
