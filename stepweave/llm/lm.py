"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

A word's probability is its class's, given hashed features of the two words
before it, times its share of the class, times the factors of two word
features: the word with the one before that before it (a skip), and with the
word before it.  For the class the features take few values, so one pass over
the corpus gathers all counts of (context, class), and gradient updates over
those counts are the same as over every token.  The word features are of all
pairs of real words: a sparse table of hashed pairs, dealt over shards, that
grows with the training tokens.

The corpus is coded once into packets of texts.  A packet asks shards for the
counts of its different words and pairs, in sorted and packed batches, and is
scored where it lies; no vocabulary is sent to the driver or to every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

#: Words with their own class; then the end's, one for each power of two of a word's count, and that of words not learned.
OWN, CLASSES = 30, 64
_END_CLASS, _UNSEEN = OWN, CLASSES - 1
#: Values of a context word: those with their own class, the end, and hashes of the rest.  Buckets for both words together.
VALUES, BOTH = 64, 1024
#: Bytes of text in a packet, and shards of words and pairs of each partition.
PACKET_BYTES, SHARDS = 8 << 20, 4
#: Tokens that are scored at a time.
TOKENS = 1 << 16
#: Weights of what is known without a word feature, in tokens: for the skip and for the word before.  All texts are scored with each pair, and the pair is taken that foretells every learned token best from the others.
SKIP_WEIGHTS = (8.0, 128.0, 2048.0, 32768.0, 1048576.0)
WORD_WEIGHTS = (2.0, 16.0, 128.0, 2048.0, 1048576.0)
_END = np.uint64(0x1D)  # a word's hash is mixed, so it equals this with probability 2**-64


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' words, each row closed by the end, and each row's first token."""
    hashes, _, _, first = C.words(*C.buffers(column))
    rows = np.arange(len(first))
    out = np.full(len(hashes) + len(first) - 1, _END)
    ends = first[1:] + rows[:-1]
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = hashes
    return out, first + rows


def _features() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    context = np.arange(VALUES * VALUES)
    return context % VALUES, context // VALUES, (C.mix(context.astype(np.uint64) + np.uint64(77)) % np.uint64(BOTH)).astype(np.int64)


_ONE, _TWO, _PAIR = _features()


def log_softmax(weights: list[np.ndarray], context: np.ndarray) -> np.ndarray:
    bias, one, two, both = weights
    z = bias + one[_ONE[context]] + two[_TWO[context]] + both[_PAIR[context]]
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def fit(counts: DataFrame, rounds: int = 12, rate: float = 2.0) -> list[np.ndarray]:
    """Weights of class probabilities by context, from (context, n: CLASSES counts) rows.

    Each round the executors sum the gradient of their rows' likelihood, and
    the driver takes a step of its own length for each weight: a sum over the
    square root of past squares.  Weights: 64 + 2 * 64 * 64 + 1024 * 64.
    """
    shapes = [(CLASSES,), (VALUES, CLASSES), (VALUES, CLASSES), (BOTH, CLASSES)]
    weights = [np.zeros(s) for s in shapes]
    totals = counts.agg(*[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(CLASSES)]).first()
    number = np.array([x or 0 for x in totals], float)
    total = max(1.0, number.sum())
    weights[0] = np.log((number + 0.5) / (total + 0.5 * CLASSES))
    past = [np.full(s, 1e-8) for s in shapes]
    context = counts.sparkSession.sparkContext
    for _ in range(rounds):
        sent = context.broadcast(weights)

        def gradient(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            out = [np.zeros(s) for s in shapes]
            for batch in batches:
                at = batch.column("context").to_numpy().astype(np.int64)
                n = np.array(batch.column("n").to_pylist(), float).reshape(len(at), CLASSES)
                g = n - n.sum(1, keepdims=True) * np.exp(log_softmax(sent.value, at))
                out[0] += g.sum(0)
                for k, index in enumerate((_ONE, _TWO, _PAIR), 1):
                    np.add.at(out[k], index[at], g)
            flat = np.concatenate([x.reshape(-1, CLASSES) for x in out]).astype(np.float32)
            some = np.flatnonzero(np.abs(flat).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(flat[some]), pa.list_(pa.float32()))], names=["row", "g"])

        sums = counts.mapInArrow(gradient, "row int, g array<float>").groupBy("row").agg(F.array(*[F.sum(F.col("g")[k].cast("double")) for k in range(CLASSES)]).alias("g")).toArrow()
        flat = np.zeros((1 + 2 * VALUES + BOTH, CLASSES))
        if sums.num_rows:
            flat[sums.column("row").to_numpy()] = np.array(sums.column("g").to_pylist(), float)
        begin = 0
        for k, w in enumerate(weights):
            rows = 1 if k == 0 else len(w)
            g = flat[begin : begin + rows].reshape(w.shape) / total - 1e-7 * w * (k > 0)
            begin += rows
            past[k] += g * g
            weights[k] = w + rate * 0.25 * g / np.sqrt(past[k])
        rate *= 0.85
        sent.unpersist()
    return weights


# ---------------------------------------------------------------- packets

def _pair(a: np.ndarray, b: np.ndarray, order: int) -> np.ndarray:
    """Hash of two 64-bit values, in 48 bits."""
    return C.mix(C.mix(a + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93 + 2 * order) + b) >> np.uint64(16)


def _pack(a: np.ndarray) -> bytes:
    """The values' bytes, plane after plane, compressed: planes of like bytes and skewed ones get small."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).reshape(-1)


def _asked(packet: int, keys: np.ndarray, bits: int, shards: int, *numbers: np.ndarray) -> pa.RecordBatch:
    """Rows (shard, packet, packed keys, packed numbers) of a packet's different keys, which ascend and have so many bits."""
    shard = ((keys >> np.uint64(bits - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    bounds = np.searchsorted(shard, np.arange(shards + 1))
    some = np.flatnonzero(np.diff(bounds))
    parts = [(int(k), slice(bounds[k], bounds[k + 1])) for k in some]
    columns = [[_pack(np.diff(keys[x], prepend=np.uint64(0))) for _, x in parts], *([_pack(n[x]) for _, x in parts] for n in numbers)]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([packet] * len(parts), pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=["shard", "packet", "keys", *(f"n{i}" for i in range(len(numbers)))])


def _sums(table: pa.Table, numbers: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Different keys of a shard's rows, each record's place in them, the sums of their numbers, and the rows' first records."""
    keys = [np.cumsum(_unpack(b, np.uint64)) for b in table.column("keys").to_pylist()]
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([_unpack(b, np.int64) for b in table.column(f"n{i}").to_pylist()]), len(unique)).astype(np.int64) for i in range(numbers)]
    return unique, at, sums, np.concatenate([[0], np.cumsum([len(k) for k in keys])])


def _answers(table: pa.Table, at: np.ndarray, bounds: np.ndarray, *sums: np.ndarray) -> list[pa.Array]:
    return [table.column("packet").combine_chunks(), pa.array(table.column("shard").to_pylist(), pa.int32()), *(pa.array([_pack(n[at[i:j]]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()) for n in sums)]


class Packet:
    """Texts coded by their own words, most frequent first: doc ids, learn flags, tokens a text, words' hashes, and the tokens' words."""

    COLUMNS = {"ids": np.int64, "none": np.bool_, "learn": np.bool_, "sizes": np.int64, "words": np.uint64, "tokens": np.uint32}

    def __init__(self, **columns: np.ndarray):
        self.__dict__.update(columns)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])

    @staticmethod
    def coded(batch: pa.RecordBatch) -> Packet:
        x, first = tokens(batch.column("text"))
        words, at, number = np.unique(x, return_inverse=True, return_counts=True)
        order = np.argsort(-number, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        ids = batch.column("doc_id")
        return Packet(ids=ids.fill_null(0).to_numpy(), none=ids.is_null().to_numpy(zero_copy_only=False), learn=batch.column("learn").to_numpy(zero_copy_only=False), sizes=np.diff(first), words=words[order], tokens=rank[at])

    def packed(self) -> list[pa.Array]:
        return [pa.array([_pack(getattr(self, c))], pa.binary()) for c in self.COLUMNS]

    @staticmethod
    def read(row: dict) -> Packet:
        return Packet(**{c: _unpack(row[c], t) for c, t in Packet.COLUMNS.items()})

    def learned(self) -> np.ndarray:
        """For each token whether it is of a text to learn from."""
        return np.repeat(self.learn, self.sizes)

    def before(self, steps: int) -> np.ndarray:
        """For each token the word so many steps before it; the end stands before a text."""
        end = int(np.flatnonzero(self.words == _END)[0])
        out = np.full(len(self.tokens), end, np.uint32)
        out[steps:] = self.tokens[:-steps] if steps < len(out) else out[steps:]
        for k in range(steps):
            at = self.first[:-1] + k
            out[at[at < self.first[1:]]] = end
        return out

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word its learned tokens, and how many fewer learned tokens stand two places after it than these."""
        learned = self.learned()
        number = np.bincount(self.tokens[learned], minlength=len(self.words)).astype(np.int64)
        return number, number - np.bincount(self.before(2)[learned], minlength=len(self.words))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Different hashed pairs of words, and the places in them of each token's pair with the word before it, then of that with the one before."""
        word = self.words[self.tokens]
        keys, at = np.unique(np.concatenate([_pair(self.words[self.before(k)], word, k) for k in (1, 2)]), return_inverse=True)
        return keys, at.astype(np.uint32)


class Model:
    """What all packets need to know: words with a class of their own, and sums over all words."""

    def __init__(self, own: np.ndarray, types: np.ndarray, mass: np.ndarray, once: int, twice: int):
        self.own = np.sort(own)
        self.types, self.mass = types, mass
        #: tokens, different ones, and words that may not have been learned, as many as those learned once and twice tell
        self.n, self.v, self.unseen = int(mass.sum()), int(types.sum()), max(1.0, once * once / (2 * twice) if twice else once * (once - 1) / 2)

    def place(self, words: np.ndarray) -> np.ndarray:
        """Each word's own class, or -1."""
        if not len(self.own):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.own, words), len(self.own) - 1)
        return np.where(self.own[at] == words, at, -1)

    def classes(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        power = np.minimum(_END_CLASS + 1 + np.log2(np.maximum(counts, 1)).astype(np.int64), _UNSEEN - 1)
        own = self.place(words)
        return np.where(words == _END, _END_CLASS, np.where(own >= 0, own, np.where(counts > 0, power, _UNSEEN)))

    def shares(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Each word's part of its class, by counts; words not learned share theirs evenly."""
        of = np.where(classes == _UNSEEN, 1 / self.unseen, counts / np.maximum(self.mass[classes], 1))
        return np.where(classes <= _END_CLASS, 1.0, of)

    def values(self, words: np.ndarray) -> np.ndarray:
        """Each word's value in a context."""
        own = self.place(words)
        return np.where(words == _END, OWN, np.where(own >= 0, own, OWN + 1 + (words % np.uint64(VALUES - OWN - 1)).astype(np.int64))).astype(np.int32)

    def contexts(self, packet: Packet) -> np.ndarray:
        """Each token's context: VALUES * the value of the word before that before it + that of the word before it."""
        value = self.values(packet.words)
        return value[packet.before(2)] * VALUES + value[packet.before(1)]

    def logs(self, weights: list[np.ndarray]) -> np.ndarray:
        """Logarithms of class probabilities by context; classes without words have none, but for the end's and that of words not learned."""
        log = log_softmax(weights, np.arange(VALUES * VALUES))
        log[:, (self.mass == 0) & ~np.isin(np.arange(CLASSES), (_END_CLASS, _UNSEEN))] = -np.inf
        return log - np.log(np.exp(log).sum(1, keepdims=True))


def pack(texts: DataFrame, parts: int) -> DataFrame:
    """Packets of texts (doc_id, text, learn) with their words' learned counts: packet, Packet.COLUMNS, counts, fewer."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches, "text", PACKET_BYTES):
            yield pa.RecordBatch.from_arrays(Packet.coded(batch).packed(), names=list(Packet.COLUMNS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                packet = Packet.read(row)
                order = np.argsort(packet.words)
                yield _asked(row["packet"], packet.words[order], 64, parts * SHARDS, *(n[order] for n in packet.counts()))

    def answer(table: pa.Table) -> pa.Table:
        unique, at, (number, fewer), bounds = _sums(table, 2)
        shard = table.column("shard")[0].as_py()
        known = number > 0
        most = np.lexsort((unique, -number))[: OWN + 1]  # one may be the end
        most = most[known[most]]
        power = np.log2(np.maximum(number, 1)).astype(np.int64)[known]
        stats = np.concatenate([np.bincount(power, minlength=64), np.bincount(power, number[known], 64).astype(np.int64), [(number == 1).sum(), (number == 2).sum(), 0]])
        end = unique == _END
        if end.any() and known[end].any():  # of no power of two
            c = int(number[end][0])
            stats[[int(np.log2(c)), 64 + int(np.log2(c)), 128, 129, 130]] -= [1, c, c == 1, c == 2, -c]
        most = most[unique[most] != _END][:OWN]
        own = pa.Table.from_arrays([pa.array([-1 - shard], pa.int64()), pa.array([shard], pa.int32()), *(pa.array([_pack(x)], pa.binary()) for x in (stats.astype(np.int64), np.concatenate([unique[most].view(np.int64), number[most]])))], names=["packet", "shard", "n0", "n1"])
        return pa.concat_tables([pa.Table.from_arrays(_answers(table, at, bounds, number, fewer), names=own.column_names), own])

    schema = ", ".join(f"{c} binary" for c in Packet.COLUMNS)
    coded = texts.select("doc_id", "text", "learn").mapInArrow(code, schema).withColumn("packet", F.monotonically_increasing_id()).repartition(parts, "packet")

    def join(packets: pa.Table, answers: pa.Table) -> pa.Table:
        """A packet with its answers; a shard's sums by themselves."""
        rows = sorted(answers.to_pylist(), key=lambda r: r["shard"])
        names = [*Packet.COLUMNS, "packet", "counts", "fewer"]
        if not packets.num_rows:
            return pa.Table.from_pylist([{**dict.fromkeys(Packet.COLUMNS), "packet": r["packet"], "counts": r["n0"], "fewer": r["n1"]} for r in rows], arrow)
        row = packets.to_pylist()[0]
        back = np.argsort(np.argsort(_unpack(row["words"], np.uint64)))  # answers ascend with the hashes
        values = [np.concatenate([_unpack(r[c], np.int64) for r in rows])[back] for c in ("n0", "n1")]
        return pa.Table.from_pylist([{**{c: row[c] for c in names[:-2]}, "counts": _pack(values[0]), "fewer": _pack(values[1])}], arrow)

    arrow = pa.schema([*((c, pa.binary()) for c in Packet.COLUMNS), ("packet", pa.int64()), ("counts", pa.binary()), ("fewer", pa.binary())])
    answers = coded.mapInArrow(ask, "shard int, packet long, keys binary, n0 binary, n1 binary").groupBy("shard").applyInArrow(answer, "packet long, shard int, n0 binary, n1 binary")
    return coded.groupBy("packet").cogroup(answers.groupBy("packet")).applyInArrow(join, f"{schema}, packet long, counts binary, fewer binary")


def model(packets: DataFrame) -> Model:
    """The sums over all words, from pack's rows of shards, summed per task first; the words of the largest counts among the shards' own."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, most = np.zeros(131, np.int64), np.empty((0, 2), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                stats += _unpack(row["counts"], np.int64)
                most = np.concatenate([most, _unpack(row["fewer"], np.int64).reshape(2, -1).T])
                most = most[np.lexsort((most[:, 0].view(np.uint64), -most[:, 1]))[:OWN]]
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([stats.tolist()]), pa.array([most.tolist()], pa.list_(pa.list_(pa.int64())))], names=["one", "stats", "most"])

    rows = packets.where("packet < 0").select("counts", "fewer").mapInArrow(part, "one long, stats array<long>, most array<array<long>>")
    total = rows.agg(*[F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(131)]).first()
    top = rows.select(F.explode("most").alias("m")).select(F.col("m")[0].alias("h"), F.col("m")[1].alias("c")).orderBy(F.desc("c"), "h").limit(OWN).collect()
    stats = np.array([x or 0 for x in total], np.int64)
    types, mass = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for k in range(64):
        of = min(_END_CLASS + 1 + k, _UNSEEN - 1)
        types[of] += stats[k]
        mass[of] += stats[64 + k]
    types[_END_CLASS], mass[_END_CLASS] = stats[130] > 0, stats[130]
    words, numbers = (np.array([r[c] for r in top], np.int64) for c in ("h", "c"))
    out = Model(words.view(np.uint64), types, mass, int(stats[128]), int(stats[129]))
    for of, c in zip(out.place(words.view(np.uint64)), numbers, strict=True):
        k = min(_END_CLASS + 1 + int(np.log2(c)), _UNSEEN - 1)
        types[k], mass[k], types[of], mass[of] = types[k] - 1, mass[k] - c, 1, c
    return out


def count_contexts(packets: DataFrame, sent) -> DataFrame:
    """(context, n): counts of classes after each context, summed per task before the shuffle.

    A learned word's class is the one that it has without the token itself, so
    that a word learned once tells how often words not learned come.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VALUES * VALUES * CLASSES, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                packet, counts = Packet.read(row), _unpack(row["counts"], np.int64)
                classes = sent.value.classes(packet.words, counts - 1)[packet.tokens]
                total += np.bincount((sent.value.contexts(packet) * CLASSES + classes)[packet.learned()], minlength=len(total))
        total = total.reshape(-1, CLASSES)
        some = np.flatnonzero(total.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["context", "n"])

    rows = packets.where("packet >= 0").select(*Packet.COLUMNS, "counts")
    return rows.mapInArrow(run, "context int, n array<long>").groupBy("context").agg(F.array(*[F.sum(F.col("n")[k]) for k in range(CLASSES)]).alias("n"))


def probabilities(p: np.ndarray, pairs: list[np.ndarray], totals: list[np.ndarray]) -> np.ndarray:
    """log10 probabilities of tokens (columns) with each pair of weights (rows), from p, those without word features.

    A word feature's weight is log(1 + n / (m p)) where its pair was learned n
    times, else 0; its normaliser after a context learned N times is (N + m) /
    m.  So what is added up over all words stays 1.
    """
    out = np.empty((len(SKIP_WEIGHTS) * len(WORD_WEIGHTS), len(p)))
    for i, a in enumerate(SKIP_WEIGHTS):
        q = (pairs[1] + a * p) / (totals[1] + a)
        for j, b in enumerate(WORD_WEIGHTS):
            out[i * len(WORD_WEIGHTS) + j] = (pairs[0] + b * q) / (totals[0] + b)
    return np.log10(out, out=out)


def score_packet(packet: Packet, counts: np.ndarray, fewer: np.ndarray, number: np.ndarray, of: Model, logs: np.ndarray, keys: tuple[np.ndarray, np.ndarray]) -> tuple[pa.Table, np.ndarray]:
    """Rows (doc_id, n_tokens, known, base, scores with each pair of weights) of a packet, and the sums of its learned tokens' log10 probabilities, each foretold from the others."""
    x, one, two, value = packet.tokens, packet.before(1), packet.before(2), of.values(packet.words)
    places = keys[1].reshape(2, -1)
    after = counts - fewer  # learned tokens two places after each word
    known, foretold = ((c, of.shares(c, n)) for c, n in ((of.classes(packet.words, n), n) for n in (counts, counts - 1)))
    alone, learned = np.zeros(len(SKIP_WEIGHTS) * len(WORD_WEIGHTS)), packet.learned()
    totals = np.zeros((len(alone), len(packet.sizes)))
    row = np.repeat(np.arange(len(packet.sizes), dtype=np.int32), packet.sizes)
    for a in range(0, len(x), TOKENS):
        s = slice(a, a + TOKENS)
        context = value[two[s]] * VALUES + value[one[s]]
        n, t = [number[places[k, s]] for k in (0, 1)], [counts[one[s]], after[two[s]]]
        begin = np.flatnonzero(np.diff(row[s], prepend=-1))
        part = probabilities(np.exp(logs[context, known[0][x[s]]]) * known[1][x[s]], n, t)
        totals[:, row[s][begin]] += np.add.reduceat(part, begin, axis=1)
        k = np.flatnonzero(learned[s])
        if len(k):
            word = x[s][k]
            own = np.maximum(np.exp(logs[context[k], foretold[0][word]]) * foretold[1][word], 1e-15)
            alone += probabilities(own, [v[k] - 1 for v in n], [v[k] - 1 for v in t]).sum(1)
    seen = np.add.reduceat((counts[x] > 0).astype(np.int64), packet.first[:-1])
    base = np.add.reduceat(np.log10(counts[x] + 1.0), packet.first[:-1]) - packet.sizes * np.log10(of.n + of.v + 1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(packet.sizes) + 1, dtype=np.int32) * len(totals)), pa.array(np.ascontiguousarray(totals.T).reshape(-1)))
    return pa.Table.from_arrays([pa.array(packet.ids, mask=packet.none), pa.array(packet.sizes), pa.array(seen), pa.array(base), lists, pa.array(np.ones(len(packet.sizes), bool))], names=["doc_id", "n_tokens", "known", "base", "scores", "text"]), alone


def score_words(packets: DataFrame, sent, logs, parts: int) -> DataFrame:
    """score_packet's rows, and for each packet one (not text) with the sums of its learned tokens."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                packet = Packet.read(row)
                keys, at = packet.pairs()
                yield _asked(row["packet"], keys, 48, parts * SHARDS, np.bincount(at, np.tile(packet.learned(), 2), len(keys)).astype(np.int64))

    def answer(table: pa.Table) -> pa.Table:
        _, at, sums, bounds = _sums(table, 1)
        return pa.Table.from_arrays(_answers(table, at, bounds, *sums), names=["packet", "shard", "n0"])

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]
        packet, counts, fewer = Packet.read(row), _unpack(row["counts"], np.int64), _unpack(row["fewer"], np.int64)
        number = np.concatenate([_unpack(r["n0"], np.int64) for r in sorted(answers.to_pylist(), key=lambda r: r["shard"])])
        table, alone = score_packet(packet, counts, fewer, number, sent.value, logs.value, packet.pairs())
        sums = pa.Table.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([alone.tolist()]), pa.array([False])], names=table.column_names)
        return pa.concat_tables([table, sums])

    # every branch reads the same exchange
    dealt = packets.where("packet >= 0").repartition(parts, "packet")
    answers = dealt.mapInArrow(ask, "shard int, packet long, keys binary, n0 binary").groupBy("shard").applyInArrow(answer, "packet long, shard int, n0 binary")
    return dealt.groupBy("packet").cogroup(answers.groupBy("packet")).applyInArrow(run, "doc_id long, n_tokens long, known long, base double, scores array<double>, text boolean")


def score(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", rounds: int = 12) -> DataFrame:
    """Learn from the rows where training (a Column over doc_id) holds; score all.

    docs: id_col (long), text_col; null texts are empty, and a text's tokens
    are its words, A-Z as a-z, and one end.  Returns a row for each row:
    doc_id, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and
    score (the model's log10 probability).  Repeated rows and null ids are rows
    like others; training rows may be none.  Of an empty table, none.

    The model is proper: class probabilities sum to 1, so do the shares of a
    class, and the word features keep that.  Words that were not learned have
    one class, and share it evenly by an estimate of their number (of those
    learned once, squared, half as often as there are words learned twice).
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("learn", F.coalesce(training, F.lit(False)))
    packets = C.cut(pack(texts, parts))
    of = model(packets)
    context = spark.sparkContext
    sent = context.broadcast(of)
    counts = C.cut(count_contexts(packets, sent))
    logs = context.broadcast(of.logs(fit(counts, rounds)))
    rows = C.cut(score_words(packets, sent, logs, parts))
    C.free(counts, packets)
    number = len(SKIP_WEIGHTS) * len(WORD_WEIGHTS)
    alone = rows.where("NOT text").agg(*[F.sum(F.col("scores")[k]).alias(f"s{k}") for k in range(number)]).first()
    best = int(np.argmax([x or 0.0 for x in alone]))
    return rows.where("text").select("doc_id", "n_tokens", F.col("known").alias("n_known"), F.lit(of.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("scores")[best].alias("score"))
