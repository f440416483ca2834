"""Quality rules: counts of a text's own form, and the log-likelihood ratio of its hashed n-grams between trusted documents and all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Buckets of the two multinomials; one and two tokens in a row are hashed into them.
BUCKETS = 1 << 14
#: Fixed-point units of a weight: sums of whole numbers don't depend on their order.
UNITS = 1_000_000
#: Steps a unit of log-likelihood ratio in which the trusted documents' scores are counted.
STEPS = 1000
#: The share of the trusted documents apart, in thousandths, that the tail is cut at.
LOST = 5
#: One in so many trusted ids, by their hash, is set apart for the threshold.
APART = 5
#: Trusted ids up to which their list is sent to all executors (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Base rules: words that a text has at least, and hundredths of its words in repeated windows that it has at most.
LEAST_WORDS, MOST_REPEATED = 50, 50
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: A token of the model: a run of ASCII letters and digits and of all beyond ASCII, or a run of ASCII signs.
SIGNS = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|" + SIGNS
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*BASE, "base_failed", "llr_sum", "n_grams", "llr", "threshold", "kept")


def words(text: Column) -> Column:
    return F.filter(F.split(text, C.SPACE_RUN), lambda w: w != "")


def base_counts(rows: DataFrame) -> DataFrame:
    """Add BASE to rows (row, text), a row for a row; every count is made within its row, so nothing is shuffled.

    Windows of three words are told apart by their 64-bit hash.  They are
    sorted by (hash, place) in the row; a window whose neighbour has its hash
    is a repeat, and repeats at places p cover the words p to p + 2 once each.
    """
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    plain = reduce(lambda x, sign: F.replace(x, F.lit(sign), F.lit("")), SYMBOLS, text)
    counted = rows.select("*", words(text).alias("w"), (F.length(text) - F.length(plain)).cast("long").alias("n_symbols"), lines.alias("lines"))
    counted = counted.select(
        "row", "text", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.transform("w", lambda x: F.xxhash64(x)).alias("w"),
    )
    window = lambda z, p: F.struct(F.xxhash64(F.get("w", p), F.get("w", p + 1), z).alias("h"), p.alias("p"))
    windows = F.when(F.size("w") >= 3, F.transform(F.slice("w", F.lit(3), F.size("w") - 2), window))
    counted = counted.select("*", F.sort_array(windows).alias("s")).drop("w")
    same = lambda x, i: x["h"].eqNullSafe(F.get("s", i)["h"])
    repeated = F.filter("s", lambda x, i: same(x, i - 1) | same(x, i + 1))
    counted = counted.select("*", F.sort_array(F.transform(repeated, lambda x: x["p"])).alias("places")).drop("s")
    covered = F.aggregate("places", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return counted.select("row", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def grams(text: Column) -> tuple[Column, Column]:
    """Two steps to the numbers of a text's tokens and pairs of tokens, each occurrence, whose remainder by BUCKETS is their bucket.

    Tokens' numbers are the CRC-32 of their bytes (to be column t).  Signs get
    spaces around them, so that a split by spaces gives the tokens.
    """
    spaced = F.regexp_replace(text, f"({SIGNS})|[\\x00-\\x1F\\x7F]", " $1 ")
    numbers = F.transform(F.array_remove(F.split(spaced, " "), ""), lambda x: F.crc32(x.cast("binary")))
    double = F.transform(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda h, i: F.get("t", i) * 1_000_003 + h)
    return numbers, F.concat("t", double)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(id, apart) of the ids labelled quality = 1, each once: those apart aren't learned from, but set the threshold."""
    ids = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id")).distinct()
    number = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 7), 16, 10).cast("long")
    return ids.select("id", (number % APART == 0).alias("apart"))


def marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows with apart of their doc_id, null where ids (trusted_ids, as a table) hasn't it; the ids go to all executors if they are few enough."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return rows.join(ids, F.col("doc_id") == F.col("id"), "left").drop("id")


def multinomials(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(bucket, weight) of all BUCKETS: UNITS of log p(bucket | trusted) - log p(bucket | all), each with one added to every count.

    Counts are of every n-gram of every document (doc_id, text); the trusted
    ones are those of ids that aren't apart.  Each task sends a row a bucket.
    """
    numbers, buckets = grams(F.col("text"))
    every = marked(rows, ids).select(numbers.alias("t"), F.coalesce(~F.col("apart"), F.lit(False)).cast("long").alias("mine")).select("mine", F.explode(buckets).alias("gram"))
    counts = C.cut(every.groupBy((F.col("gram") % BUCKETS).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("mine").alias("mine")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("mine"), F.lit(0)).alias("mine")).first()
    filled = rows.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(F.broadcast(counts), "bucket", "left")  # a row a bucket
    share = lambda c, n: F.ln((F.coalesce(c, F.lit(0)) + F.lit(1)).cast("double") / F.lit(float(n + BUCKETS)))
    weight = C.cut(filled.select("bucket", F.floor((share("mine", total["mine"]) - share("n", total["n"])) * UNITS + 0.5).alias("weight")))
    C.free(counts)
    return weight


def judge(docs: DataFrame, labels: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ADDED to every row: BASE, the base rules' verdict, the log-likelihood ratio a gram (llr), the threshold and kept.

    kept: the base rules hold and llr is at least the threshold, by the trusted
    documents apart that pass the base rules (threshold_of); one in APART
    trusted ids is set apart by its hash, so that the threshold is of documents
    that the trusted counts don't hold.  Without such documents the threshold is null and the base rules alone
    decide; a text without grams scores 0.

    Rows are as many as before, repeated ones alike, with all their columns
    (those of ADDED's names are replaced; without keep_text less the text).
    Null texts count as empty and fail the base rules; null ids are trusted by
    no label.  Of an empty table, none.  Long texts stay in their row: a task
    holds one row's words and windows.
    """
    docs = C.without(docs, *ADDED)
    kept_columns = [c for c in docs.columns if keep_text or c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = C.cut(trusted_ids(labels))
    weight = multinomials(rows.select("doc_id", "text"), ids)
    table = weight.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "weight"))), lambda x: x["weight"]).alias("w")).scalar()  # BUCKETS numbers
    numbers, buckets = grams(F.col("text"))
    summed = F.aggregate("b", F.lit(0).cast("long"), lambda s, b: s + F.get("weights", (b % BUCKETS).cast("int")))
    scored = base_counts(rows.select("row", "text")).select("row", *BASE, numbers.alias("t")).select("row", *BASE, buckets.alias("b"), table.alias("weights"))
    scored = scored.select("row", *BASE, summed.alias("llr_sum"), F.size("b").cast("long").alias("n_grams"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    llr = F.when(F.col("n_grams") > 0, F.col("llr_sum").cast("double") / (F.lit(float(UNITS)) * F.col("n_grams"))).otherwise(F.lit(0.0))
    scored = C.cut(scored.select("row", *BASE, failed.alias("base_failed"), "llr_sum", "n_grams", llr.alias("llr")))
    threshold = threshold_of(scored.where("NOT base_failed").select(F.col("row.doc_id").cast("long").alias("doc_id"), "llr"), ids)
    C.free(weight, ids)
    kept = ~F.col("base_failed") & F.coalesce(F.col("llr") >= F.col("threshold"), F.lit(True))
    out = scored.withColumn("threshold", F.lit(threshold).cast("double")).withColumn("kept", kept)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept_columns], *ADDED)


def threshold_of(scores: DataFrame, ids: DataFrame) -> float | None:
    """From the numbers a step of the rows of scores (doc_id, llr) whose ids are apart; None without any.

    The highest step that all but LOST thousandths reach, less half of what the
    step that half of them reach lies above it: few rows apart say little about
    the tail, and what is to be found lies far below.
    """
    steps = marked(scores, ids).where("apart").groupBy(F.floor(F.col("llr") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    counted = sorted((r["step"], r["n"]) for r in steps.collect())  # at most STEPS for each unit of llr that occurs
    total, below, low, middle = sum(n for _, n in counted), 0, None, None
    for step, n in counted:  # below: rows under this step
        low = step if below * 1000 <= LOST * total else low
        middle = step if below * 2 <= total else middle
        below += n
    return None if low is None else (3 * low - middle) / (2 * STEPS)
