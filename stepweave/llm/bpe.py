"""BPE encoding and decoding by dynamic programming over prefixes.

An automaton finds the vocabulary entries that end at each byte.  A prefix has
exactly one last token: the entry whose merge history stays intact beside the
last token of the prefix that it extends.  These tokens are stored per prefix
and read backwards.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _common as C

#: The pattern that splits text for byte-level vocabularies, its white space as the Unicode property has it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{Z}\x09-\x0d\x85\p{L}\p{N}]+|[\p{Z}\x09-\x0d\x85]+(?![^\p{Z}\x09-\x0d\x85])|[\p{Z}\x09-\x0d\x85]+"
#: Split words of at most LETTERS letters, and pairs of tokens, that a process remembers at least, and twice as many at most: words that come again outlive the others.
MEMORY, LETTERS = 300_000, 32
_NEVER = 1 << 40


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies: a byte's own if it prints, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level vocabulary file with encode(text) and decode(ids)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = {bytes(map(letters.__getitem__, k)): v for k, v in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.whole = {k.decode("latin-1"): v for k, v in vocab.items()}
        self.pieces: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for k, v in [*vocab.items(), *((k.encode(), v) for k, v in self.special.items())]:
            self.pieces[v] = k
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = (bytes(map(letters.__getitem__, x)) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            left, right = vocab[a], vocab[b]
            self.rank.setdefault((left, right), r)
            made.setdefault(vocab[a + b], (r, left, right))
        self.made = made
        self.automaton = ahocorasick.Automaton()
        for k, v in self.whole.items():
            self.automaton.add_word(k, (len(k), v))
        self.automaton.make_automaton()
        self.split = regex.compile(SPLIT).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self._beside: dict[int, bool] = {}
        self._edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts that stood at one end of token while it grew (side 1: its left end, 2: its right end), each with the rank of the merge that took it up."""
        if (found := self._edges.get((token, side))) is None:
            found, until = [], _NEVER
            while True:
                found.append((token, until))
                if token not in self.made:
                    break
                until, token = self.made[token][0], self.made[token][side]
            self._edges[found[0][0], side] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether left and right both survive when their bytes are merged together.

        They don't if a part at left's right end and a part at right's left end
        merge before either is taken up by its own token.  At the same rank the
        leftmost merge comes first.
        """
        key = left << 20 | right
        if (found := self._beside.get(key)) is None:
            starts, rank = self._edge(right, 1), self.rank
            found = not any((r := rank.get((a, b))) is not None and r < a_until and r <= b_until for a, a_until in self._edge(left, 2) for b, b_until in starts)
            if len(self._beside) >= 2 * MEMORY:
                self._beside.clear()
            self._beside[key] = found
        return found

    def _word(self, word: str) -> bytes:
        """Ids of one split word as 32-bit integers, where it isn't remembered."""
        if (packed := self._older.get(word)) is not None:
            self._known[word] = packed
            return packed
        raw = word.encode().decode("latin-1")
        if (token := self.whole.get(raw)) is not None:
            ids = [token]
        else:
            last, back, done = [-1] * (len(raw) + 1), [0] * (len(raw) + 1), 0
            beside, known = self.compatible, self._beside
            for end, (size, token) in self.automaton.iter(raw):
                end += 1
                if end == done:
                    continue
                at = end - size
                if at:
                    before = last[at]
                    if before < 0 or not (ok if (ok := known.get(before << 20 | token)) is not None else beside(before, token)):
                        continue
                last[end], back[end], done = token, at, end
            ids, at = [], len(raw)
            while at:
                if last[at] < 0:
                    raise ValueError("the vocabulary lacks a byte")
                ids.append(last[at])
                at = back[at]
            ids.reverse()
        packed = np.array(ids, "<u4").tobytes()
        if len(word) <= LETTERS:
            if len(self._known) >= MEMORY:
                self._older, self._known = self._known, {}
            self._known[word] = packed
        return packed

    def _ordinary(self, text: str) -> bytes:
        known, word = self._known, self._word
        return b"".join([known.get(w) or word(w) for w in self.split(text)])  # a generation that ends meanwhile is still right

    def encode_packed(self, text: str) -> bytes:
        """The ids of text as little-endian 32-bit integers; special tokens' strings give their own ids."""
        if self.special and any(s in text for s in self.special):
            return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self._ordinary(x) for x in self.split_special(text) if x)
        return self._ordinary(text)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_packed(self, packed: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, memoryview(packed).cast("I"))).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.decode_packed(np.array(ids, "<u4").tobytes())


@cache
def codec(path: str) -> Codec:
    """One codec per process and file."""
    return Codec(path)


def encode_decode(docs: DataFrame, text_col: str = "text", path: str | None = None, decoded: bool = True) -> DataFrame:
    """Encode whole texts, and decode the ids again.

    docs: any columns; text_col is text (null and empty: no tokens, and the
    empty text decoded).  Rows keep all their columns, repeated rows and rows
    with a null id too; columns named like the new ones are replaced.  Adds
    n_tokens (long), token_ids (binary, little-endian 32-bit ids) and, if
    decoded, decoded_text.  path: a vocabulary file that each executor can
    read.  No row moves; memory is that of a batch and of short words remembered, under
    150 MB.
    """
    path = path or default_path()
    df = C.without(docs, "n_tokens", "token_ids", "decoded_text")
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())] + [T.StructField("decoded_text", T.StringType())] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in C.pieces(batches, text_col, 4 * C.CHUNK_BYTES):
            ids = [c.encode_packed(t or "") for t in batch.column(text_col).to_pylist()]
            more = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                more.append(pa.array([c.decode_packed(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *(f.name for f in new)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *new]))
