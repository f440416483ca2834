"""Chat formatting by rendering successive prefixes of a conversation with a template that is a black box."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import quote, unquote

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


Turn = tuple[str, str]
#: The default template's control strings, with the backslashes in front of them.  One without a backslash is a control; one inside a text has one at least.
CONTROL = regex.compile(r"\\*(?:### [A-Za-z0-9_.~%-]*: |</turn>)")
#: Stands for a text while the place of a turn's text is looked for.
PROBE = "\ue000probe\ue000"
#: Rendered turns that a process remembers, of those under so many letters.
MEMORY, LETTERS = 1 << 14, 4096


class HistoryRewritten(ValueError):
    """A template changed what it had rendered of earlier turns."""


def escape(text: str) -> str:
    """Put one more backslash before each control string, however many stand there; unescape takes it away."""
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][1:] if m[0][0] == "\\" else m[0], text)


def _turn(role: str, text: str) -> str:
    return f"### {quote(role, safe='')}: {escape(text)} </turn>\n"


_known = lru_cache(MEMORY)(_turn)


def render(turns: list[Turn]) -> str:
    """The default template, a line each turn: `### role: text </turn>`.  The space keeps a text's last backslash from the control."""
    return "".join([_known(role, text) if len(text) < LETTERS else _turn(role, text) for role, text in turns])


def parse(output: str) -> list[Turn]:
    """Read turns back from what render gave."""
    turns, role, start = [], "", -1
    for m in CONTROL.finditer(output):
        if m[0][0] == "\\":
            continue
        if m[0] == "</turn>":
            turns.append((unquote(role), unescape(output[start : m.start() - 1])))
        else:
            role, start = m[0][4:-2], m.end()
    return turns


def locate(turns: list[Turn], template: Callable[[list[Turn]], str] = render) -> tuple[str, list[tuple[int, int, int, int]]]:
    """Render one turn, two turns and so on; return the whole output and, for each turn, its span and its text's span.

    A turn's span is what its prefix adds to the one before, which must begin
    it: else HistoryRewritten.  Its text is where a probe stands when it takes
    the text's place.  Every prefix is rendered, with its whole history, however
    long the conversation: a template may rewrite at any length.  So the work
    grows with the square of a conversation's turns.
    """
    found, before = [], template([])
    for k, (role, _) in enumerate(turns):
        now, probed = template(turns[: k + 1]), template([*turns[:k], (role, PROBE)])
        if not now.startswith(before) or not probed.startswith(before):
            raise HistoryRewritten(f"turn {k + 1} changes what was rendered before")
        at = probed.index(PROBE, len(before))
        found.append((len(before), len(now), at, len(now) - (len(probed) - at - len(PROBE))))
        before = now
    return before, found


def format_conversations(conversations: DataFrame, template: Callable[[list[Turn]], str] = render, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Format conversations and mark what a model is to learn.

    conversations: conv_id (long), turn, role, text; other columns are left
    out.  Turns are put in order of turn, then role, then text; a null turn
    comes first, a null role or text is empty, rows without conv_id make up
    one conversation, repeated rows are turns of their own.  Of an empty table,
    none.  Returns conv_id, turns (role, text), formatted, and loss: the spans
    (begin, end, in code points of formatted) of the texts whose role is in
    learned.  A conversation is one row, so it must fit in memory; partial
    lists are gathered before the shuffle.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    df = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*df.schema.fields, T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(span))])
    arrow_spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outs, masks = [], []
            for turns in batch.column("turns").to_pylist():
                pairs = [(t["role"], t["text"]) for t in turns]
                out, places = locate(pairs, template)
                outs.append(out)
                masks.append([{"begin": b, "end": e} for (role, _), (_, _, b, e) in zip(pairs, places, strict=True) if role in learned])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(outs, pa.string()), pa.array(masks, arrow_spans)], names=schema.names)

    return df.mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """What format_conversations' outputs say, read from them alone.

    Returns conv_id, n_turns, turns_text (role, newline, text, newline each
    turn), loss_text (all text under the loss mask, unescaped) and
    formatted_chars.
    """
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_text", T.StringType()), T.StructField("loss_text", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outs = batch.column("formatted").to_pylist()
            turns = [parse(x) for x in outs]
            loss = ["".join(unescape(x[s["begin"] : s["end"]]) for s in mask) for x, mask in zip(outs, batch.column("loss").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array([len(t) for t in turns], pa.int64()), pa.array(["".join(f"{r}\n{x}\n" for r, x in t) for t in turns], pa.string()), pa.array(loss, pa.string()), pa.array([len(x) for x in outs], pa.int64())],
                names=schema.names,
            )

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, schema)
