r"""Personal data: base patterns, and contextual extraction bootstrapped from what they find.

Base spans are seeds.  The words beside them, with their kind, are lexical
patterns, whatever the seeds look like; other runs with digits or an at sign,
spaced or punctuated in any way, are unseen instances of the patterns around
them.  Spark scores the graph of patterns and instances
iteratively, and the patterns that end with high confidence add spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Possessive, and only from the start of a run of digits: the same matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_RUN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789@+()._%/-")
_REST = re.compile(r"[A-Za-z0-9@+()._%/-]++")
#: What may stand between the parts of one spaced or punctuated run; a full stop, comma or colon before a space ends it.
_GAP = re.compile(r"[ \u00a0\u2007\u2009\u202f]?[-+()/\u00b7\u2010-\u2015~|][ \u00a0\u2007\u2009\u202f]?|[ \u00a0\u2007\u2009\u202f]|[.,:;_]")
_LETTERS = re.compile(r"[A-Za-z]{3}")
_WORD = re.compile(r"[^\W\d_]+")
#: A context is looked for in so many code points beside a span.
REACH = 48
#: The score from which a pattern speaks for its values while it isn't confident yet.
LIKELY = 0.5
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base spans (begin, end, kind) in order of begin, then kind."""
    found: list[tuple[int, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((begin, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    found.sort()
    return [(b, e, KINDS[k]) for b, k, e in found]


def contexts(text: str, begin: int, end: int) -> list[str]:
    """The lexical patterns around a span: the word before it, the two before, the word after, where they stand within REACH as wholes."""
    low, high = max(0, begin - REACH), end + REACH
    cut = lambda at: 0 < at < len(text) and _WORD.fullmatch(text, at - 1, at + 1)
    left = [m[0].lower() for m in _WORD.finditer(text, low, begin) if m.start() > low or not cut(low)][-2:]
    right = [m[0].lower() for m in _WORD.finditer(text, end, high) if m.end() < high or not cut(high)][:1]
    found = [f"L {left[-1]}"] if left else []
    if len(left) == 2:
        found.append(f"LL {' '.join(left)}")
    return [*found, f"R {right[0]}"] if right else found


def unseen(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Runs with five digits or an at sign, that no base span touches.

    Runs side by side with digits, without an at sign or three letters in a
    row, are one where only a _GAP is between them: so numbers in groups, but
    not two numbers of eight digits or more.
    """
    if not (_DIGIT.search(text) or "@" in text):
        return []
    digits = lambda b, e: sum("0" <= c <= "9" for c in text[b:e])
    parts: list[tuple[int, int, int]] = []  # begin, end, digits if it may go on (else -1)
    k, reach, done = 0, 0, 0
    spans = sorted(taken)
    m = _MARK.search(text)
    while m:
        b = m.start()
        while b > done and text[b - 1] in _RUN:
            b -= 1
        done = e = _REST.match(text, m.start()).end()
        while e > b and text[e - 1] in ".(+/%-_":
            e -= 1
        while k < len(spans) and spans[k][0] < e:
            reach = max(reach, spans[k][1])
            k += 1
        if reach <= b:
            more = -1 if "@" in text[b:e] or _LETTERS.search(text, b, e) else digits(b, e)
            if parts and min(more, parts[-1][2]) >= 0 and min(more, parts[-1][2]) < 8 and _GAP.fullmatch(text, parts[-1][1], b):
                parts[-1] = (parts[-1][0], e, parts[-1][2] + more)
            else:
                parts.append((b, e, more))
        m = _MARK.search(text, done)
    return [(b, e) for b, e, n in parts if n >= 5 or n < 0 and ("@" in text[b:e] or digits(b, e) >= 5)]


def observe(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Per row: its columns, base spans, and all occurrences with their patterns.

    Adds base (spans) and seen (spans, seed or not, value, patterns); a null
    text is empty.
    """
    span = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])
    seen = T.StructType([*span.fields, T.StructField("value", T.LongType()), T.StructField("patterns", T.ArrayType(T.StringType()))])
    df = C.without(docs, "base", "seen")
    schema = T.StructType([*df.schema.fields, T.StructField("base", T.ArrayType(span)), T.StructField("seen", T.ArrayType(seen))])
    a_span = [("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]
    a_seen = pa.list_(pa.struct([*a_span, ("value", pa.int64()), ("patterns", pa.list_(pa.string()))]))

    def value(text: str) -> int:
        return int.from_bytes(hashlib.blake2b(text.lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches, text_col, 4 * C.CHUNK_BYTES):
            bases, seens = [], []
            for text in batch.column(text_col).to_pylist():
                spans = base_spans(text) if text else []
                every = [(*s,) for s in spans] + [(b, e, None) for b, e in unseen(text, spans)] if text else []
                bases.append([{"begin": b, "end": e, "kind": k} for b, e, k in spans])
                seens.append([{"begin": b, "end": e, "kind": k, "value": value(text[b:e]), "patterns": p} for b, e, k in every if (p := contexts(text, b, e))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bases, pa.list_(pa.struct(a_span))), pa.array(seens, a_seen)], names=schema.names)

    out = df.mapInArrow(run, schema)
    return out if keep_text else out.drop(text_col)


def score_patterns(seen: DataFrame, rounds: int = 3, confidence: float = 0.9, support: int = 5) -> DataFrame:
    """Score the pattern-instance graph; return the confident patterns (kind, pattern, score).

    seen: kind (null: not a seed), value, pattern.  A node on one side is a
    pattern with a kind, so that a context adds what stands in it whatever its
    format.  On the other side are values.  A seed's score for its kind is 1,
    another value's starts at 0.  Each round a pattern's score is the mean of
    its values' scores, with half a value of score 0 more; it counts if support
    different values or more have scores of confidence.  Then an unseen
    value's score for a kind is 1 less the product of (1 - score) over the
    patterns that count and have a score of LIKELY.  So what a round finds
    induces patterns in the next, also where no seed stands.
    """
    edges = C.cut(seen.groupBy("pattern", "value", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("pattern", "value").agg(F.max("kind").alias("own")))
    seeds = edges.where("own is not null").select("value", F.col("own").alias("kind"), F.lit(1.0).alias("score")).distinct()
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size"))
    values, patterns = seeds, None
    for _ in range(rounds):
        sums = edges.join(values, "value").groupBy("kind", "pattern").agg(F.sum("score").alias("total"), F.sum((F.col("score") >= confidence).cast("int")).alias("sure")).where(F.col("sure") >= support)
        before = values, patterns
        patterns = C.cut(sums.join(size, "pattern").select("kind", "pattern", (F.col("total") / (F.col("size") + 0.5)).alias("score")).where(F.col("score") >= min(LIKELY, confidence)))
        found = edges.where("own is null").join(patterns, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("score"))
        values = C.cut(seeds.unionByName(found))
        C.free(*before)
    return patterns.where(F.col("score") >= confidence)


def find_personal_data(docs: DataFrame, text_col: str = "text", rounds: int = 3, confidence: float = 0.9, support: int = 5, keep_text: bool = True) -> DataFrame:
    """Base spans and bootstrapped spans of whole texts.

    Rows keep all their columns, whatever their names, and repeated rows stay;
    columns named base or spans are replaced.  Null and empty texts have no
    spans; an empty table gives none.  Adds base and spans: arrays of (begin,
    end, kind) in code points, by begin, then kind as in KINDS; base is a part
    of spans.  An added span overlaps no base span.  keep_text: whether the
    result has the texts.  The texts are read once; found occurrences, not
    texts, are shuffled, and a hot pattern is summed before the shuffle.
    """
    names = docs.columns
    text = names.index(text_col)
    stay = [i for i, c in enumerate(names) if c.lower() not in ("base", "spans") and (keep_text or i != text)]
    hidden = docs.toDF(*[f"c{i}" for i in range(len(names))]).select(*[f"c{i}" for i in sorted({*stay, text})])  # no column of docs is taken for one of these
    seen = C.cut(observe(hidden, f"c{text}", keep_text).withColumn("row", F.monotonically_increasing_id()))
    each = seen.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    at = each.select("row", "begin", "end", "kind", "value", F.explode("patterns").alias("pattern"))
    patterns = score_patterns(at.select("kind", "value", "pattern"), rounds, confidence, support)
    best = at.where("kind is null").drop("kind").join(patterns, "pattern").groupBy("row", "begin", "end").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    more = best.groupBy("row").agg(F.collect_list(F.struct("begin", "end", "kind")).alias("more"))
    order = lambda s: F.struct(s["begin"].alias("begin"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))
    spans = F.transform(F.array_sort(F.transform(F.concat("base", F.coalesce("more", F.array().cast("array<struct<begin:int,end:int,kind:string>>"))), order)), lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), s["kind"].alias("kind")))
    out = seen.drop("seen").join(more, "row", "left").withColumn("spans", spans)
    return out.select(*[f"c{i}" for i in stay], "base", "spans").toDF(*[names[i] for i in stay], "base", "spans")


def redact(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Put [KIND] in the place of each span of spans_col; overlapping spans count as one, of the first's kind.

    Rows and columns stay as they are but for text_col, and n_chars, which
    follows if it is there.  Null and empty texts, and texts with null or no
    spans, stay; so do repeated rows.  Of an empty table, none.
    """
    schema = docs.schema
    has_n = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches, text_col, 4 * C.CHUNK_BYTES):
            texts = []
            for text, spans in zip(batch.column(text_col).to_pylist(), batch.column(spans_col).to_pylist(), strict=True):
                if text is None or not spans:
                    texts.append(text)
                    continue
                out, done = [], 0
                for s in spans:
                    if s["begin"] >= done:
                        out += [text[done : s["begin"]], f"[{s['kind'].upper()}]"]
                    done = max(done, s["end"])
                texts.append("".join([*out, text[done:]]))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns[text_col] = pa.array(texts, columns[text_col].type)
            if has_n:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=batch.schema.names)

    return docs.mapInArrow(run, schema)
