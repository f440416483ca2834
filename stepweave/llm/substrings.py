"""Repeated passages by FM-indexes of shards.

Texts move once, to packets.  Windows of WINDOW words are routed by their least
GRAM-gram, so that equal windows meet in one shard; routes that no second window
takes stay at home.  A shard's different runs of windows are indexed (packed
wavelet matrix of the transform, counts, sampled places), its documents are
streamed through the index by backward search, and the matching statistics tell
which windows stand in it more than once: of those all but the earliest go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

WINDOW, GRAM = 20, 10
#: Windows of a run at most, so that 81 words hold a run and its end; words of a shard's index; runs of a least gram from which each window is a route of its own.
RUN, SHARD_WORDS, HOT = 60, 300_000, 256
#: Packets, and shards of least grams, of a partition: what is sent to and fro is summed in each packet, and takes a row for each packet and shard at most.
PACKETS, SHARDS = 4, 1
#: Words from one sampled place to the next.
SAMPLED = 8
_ONE, _ZERO = np.uint64(1), np.uint64(0)
_ODD = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, 2 * RUN + WINDOW, dtype=np.uint64) | _ONE


def _slide(x: np.ndarray, width: int, fold: np.ufunc) -> np.ndarray:
    """fold over every width successive values."""
    done = 1
    out = x
    while done * 2 <= width:
        out, done = fold(out[:-done], out[done:]), done * 2
    return fold(out[: len(x) - width + 1], out[width - done :][: len(x) - width + 1]) if width > done else out


def window_runs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut each row's windows into runs of one least gram: (least gram, first word, windows, weight) of each run.

    The weight is 2 if the least gram stands twice in the run, so that a run
    may repeat itself, else 1.
    """
    empty = np.empty(0, np.int64)
    if len(hashes) < WINDOW:
        return empty.astype(np.uint64), empty, empty, empty
    grams = C.runs(hashes, GRAM)
    least = _slide(grams, WINDOW - GRAM + 1, np.minimum)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(row[: len(least)] == row[WINDOW - 1 :])
    if not len(at):
        return empty.astype(np.uint64), empty, empty, empty
    low = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(at)))
    if (length > RUN).any():
        parts = (length + RUN - 1) // RUN
        begin = np.repeat(begin, parts) + (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN
        length = np.minimum(RUN, np.repeat(np.append(np.flatnonzero(new)[1:], len(at)), parts) - begin)
    near = np.arange(WINDOW - GRAM + 1)
    value = low[begin][:, None]
    leftmost = at[begin] + (grams[at[begin][:, None] + near] == value).argmax(1)
    rightmost = at[begin] + length - 1 + near[-1] - (grams[(at[begin] + length - 1)[:, None] + near[::-1]] == value).argmax(1)
    return low[begin], at[begin], length, 1 + (leftmost != rightmost)


# ---------------------------------------------------------------- the index

class Bits:
    """A packed vector of bits with a count for each 64 of them."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.uint32)[:-1]]).astype(np.uint32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at >> 6
        return self.ones[word] + np.bitwise_count(self.words[word] & ((_ONE << (at & 63).astype(np.uint64)) - _ONE)).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & _ONE).astype(np.int64)

    def last(self, at: np.ndarray) -> np.ndarray:
        """The last set bit at or before each place; there must be one."""
        word = at >> 6
        x = self.words[word] & (~_ZERO >> (63 - (at & 63)).astype(np.uint64))
        while len(none := np.flatnonzero(x == 0)):
            word[none] -= 1
            x[none] = self.words[word[none]]
        for k in (1, 2, 4, 8, 16, 32):
            x |= x >> np.uint64(k)
        return (word << 6) + np.bitwise_count(x) - 1

    def next(self, at: np.ndarray) -> np.ndarray:
        """The first set bit after each place; there must be one."""
        at = at + 1
        word = at >> 6
        x = self.words[word] & (~_ZERO << (at & 63).astype(np.uint64))
        while len(none := np.flatnonzero(x == 0)):
            word[none] += 1
            x[none] = self.words[word[none]]
        return (word << 6) + np.bitwise_count((x & (~x + _ONE)) - _ONE)


class FmIndex:
    """The FM-index of texts of words, at most 80 each and 2**21 in all: what is kept is packed bits, counts and every SAMPLED-th place.

    text: all texts, each closed by symbol 0; begin: their first places and
    the end.
    """

    def __init__(self, text: np.ndarray, begin: np.ndarray):
        n, ends = len(text), begin[1:] - 1
        self.n = n
        rank = text + len(ends)  # ends come first, each a symbol of its own
        rank[ends] = np.arange(len(ends))
        unlike = np.zeros(n, np.uint64)
        for k in range(WINDOW - 1):
            unlike[: n - k] += rank[k:].astype(np.uint64) * _ODD[k]
        depth, base = 1, n + len(ends) + 2
        while True:  # depth 3, 9, 27, 81
            key = rank * base
            key[: n - depth] += rank[depth:] + 1 if depth < n else 0
            key *= base
            key[: max(0, n - 2 * depth)] += rank[2 * depth :] + 1
            places = np.argsort(key)
            key = key[places]
            fresh = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            depth *= 3
            if fresh[-1] == n - 1:
                break
            rank[places] = fresh
        self.levels = max(1, int(text.max()).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.levels))])
        self._matrix(text[places - 1])
        unlike = unlike[places]
        #: where a row differs from the one above in its first WINDOW - 1 words
        self.groups = Bits(np.concatenate([[True], unlike[1:] != unlike[:-1], [True]]))
        sampled = np.zeros(n, bool)
        sampled[C._places(begin[:-1], np.diff(begin))[(np.arange(n) - np.repeat(begin[:-1], np.diff(begin))) % SAMPLED == 0]] = True
        self.marked = Bits(sampled[places])
        self.samples = places[sampled[places]].astype(np.int32)

    def _matrix(self, transform: np.ndarray) -> None:
        self.bits, self.zeros = [], []
        codes = np.arange(1 << self.levels)
        origin = np.zeros(len(codes), np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (transform >> level) & 1
            self.bits.append(Bits(bit.astype(bool)))
            self.zeros.append(int(self.n - bit.sum()))
            origin = self._down(len(self.bits) - 1, origin, (codes >> level) & 1)
            transform = np.concatenate([transform[bit == 0], transform[bit == 1]])
        self.origin = origin

    def _down(self, k: int, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        ones = self.bits[k].rank(at)
        return np.where(bit == 1, self.zeros[k] + ones, at - ones)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol before the strings of the intervals [low, high)."""
        at = np.concatenate([low, high])
        twice = np.concatenate([symbol, symbol])
        for k in range(self.levels):
            at = self._down(k, at, (twice >> (self.levels - 1 - k)) & 1)
        at += self.before[twice] - self.origin[twice]
        return at[: len(low)], at[len(low) :]

    def shorter(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first WINDOW - 1 words of the rows low."""
        return self.groups.last(low), self.groups.next(low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows, by steps back to a sampled one."""
        out, left, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows, 0
        while len(left):
            hit = self.marked.get(at) == 1
            out[left[hit]] = self.samples[self.marked.rank(at[hit])] + steps
            left, at, steps = left[~hit], at[~hit], steps + 1
            symbol = np.zeros(len(at), np.int64)
            for k in range(self.levels):
                bit = self.bits[k].get(at)
                symbol, at = symbol << 1 | bit, self._down(k, at, bit)
            at = at + self.before[symbol] - self.origin[symbol]
        return out


def matching_statistics(index: FmIndex, query: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Stream queries (query[begin:begin + lengths]) backwards through the index.

    Yields, again and again, some places in query, of each the length of the
    longest match that begins there, up to WINDOW, and its interval; each place
    comes once.  A match of WINDOW words gives up its last before the next; one
    that the next word ends is sought again without its last word.
    """
    stop, at = begin - 1, begin + lengths - 1
    end, lowest = at + 1, at + 1  # of the match; of the places that have come
    low, high = np.zeros(len(at), np.int64), np.full(len(at), index.n)
    while True:
        live = at > stop
        if not live.all():
            stop, at, end, lowest, low, high = (x[live] for x in (stop, at, end, lowest, low, high))
        if not len(at):
            return
        full = np.flatnonzero(end - 1 - at == WINDOW)
        low[full], high[full] = index.shorter(low[full])
        end[full] -= 1
        low, high = index.step(query[at], low, high)
        lost = high <= low
        if lost.any():
            end[lost] -= 1
            none = lost & (end <= at)  # no match at all begins there
            low[lost], high[lost] = 0, index.n
            come = (at < lowest) & (~lost | none)
        else:
            none, come = lost, at < lowest
        yield at[come], (end - at)[come], low[come], high[come]
        lowest = np.where(come, at, lowest)
        at = np.where(lost & ~none, end - 1, at - 1)
        end = np.where(none, at + 1, end)


def repeated(words: np.ndarray, offsets: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Whether each window of different runs also starts earlier, in a run before or before in its own.

    words: the runs' words, as offsets say; checks: a second hash of each
    window, in the order of the windows, which equal ones must share.  Runs
    whose windows' common words stand nowhere else are done after some steps
    back from these words' end; the others are streamed as wholes.
    """
    lengths = np.diff(offsets)
    number = lengths - WINDOW + 1
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    text = np.zeros(int(begin[-1]), np.int64)
    inside = np.ones(len(text), bool)
    inside[begin[1:] - 1] = False
    text[inside] = np.unique(words, return_inverse=True)[1] + 1
    index = FmIndex(text, begin)

    # the words from number - 1 to WINDOW are in every window of the run
    open_, left = [np.flatnonzero(number > WINDOW)], np.flatnonzero(number <= WINDOW)
    low, high = np.zeros(len(left), np.int64), np.full(len(left), index.n)
    for k in range(WINDOW - 1, -1, -1):
        ended = number[left] - 1 > k
        open_.append(left[ended])
        left, low, high = left[~ended], low[~ended], high[~ended]
        if not len(left):
            break
        low, high = index.step(text[begin[left] + k], low, high)
        more = high - low > 1
        left, low, high = left[more], low[more], high[more]
    open_.append(left)
    wanted = np.sort(np.concatenate(open_))

    found = [np.empty((0, 2), np.int64)]
    for _, size, low, high in matching_statistics(index, text, begin[wanted], lengths[wanted]):
        many = (size == WINDOW) & (high - low > 1)
        found.append(np.stack([low[many], high[many]], 1))
    low, high = np.unique(np.concatenate(found), axis=0).T
    flags = np.zeros(len(checks), bool)
    if len(low):
        places = index.locate(C._places(low, high - low))
        run = np.searchsorted(begin, places, side="right") - 1
        window = (np.cumsum(number) - number)[run] + places - begin[run]
        interval = np.repeat(np.arange(len(low)), high - low)
        order = np.lexsort((window, checks[window], interval))
        later = np.zeros(len(order), bool)
        later[1:] = (interval[order][1:] == interval[order][:-1]) & (checks[window[order][1:]] == checks[window[order][:-1]])
        flags[window[order[later]]] = True
    return flags


# ---------------------------------------------------------------- rows of runs

def _taken(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = offsets[rows + 1] - offsets[rows]
    return values[C._places(offsets[rows], size)], np.concatenate([[0], np.cumsum(size)])


def _heads(route: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row the first one of its route with the same values: hashes find it, the values confirm it."""
    size = np.diff(offsets)
    h = np.zeros(len(size), np.uint64)
    if len(size):
        h = C.mix(np.add.reduceat(values * _ODD[np.arange(len(values)) - np.repeat(offsets[:-1], size)], offsets[:-1]) + size.astype(np.uint64))
    order = np.lexsort((h, route))
    same = np.zeros(len(order), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (route[order][1:] == route[order][:-1]) & (size[order][1:] == size[order][:-1])
    head = np.empty(len(order), np.int64)
    head[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    copies = np.flatnonzero(head != np.arange(len(head)))
    if len(copies):
        a, ends = _taken(values, offsets, copies)
        equal = np.logical_and.reduceat(a == _taken(values, offsets, head[copies])[0], ends[:-1])
        head[copies[~equal]] = copies[~equal]
    return head


def _spans(d: np.ndarray, t: np.ndarray, b: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (d, t, b, e)], names=["d", "t", "b", "e"])


class _Rows:
    """Runs (route, d, t, p, n) and their values: n + WINDOW - 1 words, then n checks."""

    def __init__(self, columns: list[np.ndarray], values: np.ndarray, offsets: np.ndarray):
        self.columns, self.values, self.offsets = columns, values, offsets

    def __len__(self) -> int:
        return len(self.columns[0])

    def take(self, rows: np.ndarray) -> _Rows:
        return _Rows([c[rows] for c in self.columns], *_taken(self.values, self.offsets, rows))

    def part(self, i: int, j: int) -> _Rows:
        return _Rows([c[i:j] for c in self.columns], self.values[self.offsets[i] : self.offsets[j]], self.offsets[i : j + 1] - self.offsets[i])

    @staticmethod
    def joined(parts: list[_Rows]) -> _Rows:
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x.offsets) for x in parts]))])
        return _Rows([np.concatenate(c) for c in zip(*(x.columns for x in parts), strict=True)], np.concatenate([x.values for x in parts]), offsets)

    def once(self) -> _Rows:
        """Less rows of the same place as the row above: repeated rows of a document."""
        again = np.ones(len(self) - 1, bool)
        for c in self.columns[:4]:
            again &= c[1:] == c[:-1]
        return self.take(np.flatnonzero(np.concatenate([[True], ~again]))) if again.any() else self


def _copies(rows: _Rows) -> tuple[_Rows, pa.RecordBatch]:
    """The first row of each different run, and the spans of the others: all their windows start earlier."""
    route, d, t, p, n = rows.columns
    head = _heads(route, rows.values, rows.offsets)
    own = head == np.arange(len(head))
    return rows.take(np.flatnonzero(own)), _spans(d[~own], t[~own], p[~own], (p + n + WINDOW - 1)[~own])


def _indexed(rows: _Rows) -> Iterator[pa.RecordBatch]:
    """Spans of windows that also start earlier, of whole routes' rows in order."""
    rows, spans = _copies(rows.once())
    yield spans
    _, d, t, p, n = rows.columns
    size = n + WINDOW - 1
    words = rows.values[C._places(rows.offsets[:-1], size)]
    checks = rows.values[C._places(rows.offsets[:-1] + size, n)]
    flags = repeated(words, np.concatenate([[0], np.cumsum(size)]), checks)
    run = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(flags)) - np.repeat(np.cumsum(n) - n, n)
    apart = np.ones(len(flags) + 1, bool)
    apart[1:-1] = run[1:] != run[:-1]
    before, after = np.append(False, flags), np.append(flags, False)
    first, last = np.flatnonzero((after & (apart | ~before))[:-1]), np.flatnonzero((before & (apart | ~after))[1:])
    of = run[first]
    yield _spans(d[of], t[of], p[of] + place[first], p[of] + place[last] + WINDOW)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (route, d, t, p, n, words), sorted so: spans of words (d, t, b, e) of windows that also start earlier.

    An index holds whole routes.  Only a route of one window's content has
    more rows than an index holds; of them the first stays.
    """
    held: list[_Rows] = []
    size = 0
    for batch in batches:
        known = batch.column("words").is_null()
        if batch.column("words").null_count:
            done = batch.filter(known)
            d, t, p, n = (done.column(c).to_numpy() for c in ("d", "t", "p", "n"))
            yield _spans(d, t, p, p + n + WINDOW - 1)
            batch = batch.filter(pc.invert(known))
        if not batch.num_rows:
            continue
        raw, offsets = C.buffers(batch.column("words"))
        held.append(_Rows([batch.column(c).to_numpy() for c in ("route", "d", "t", "p", "n")], np.frombuffer(raw.tobytes(), np.uint32).astype(np.uint64), offsets // 4))
        size += int(offsets[-1]) // 4
        if size > SHARD_WORDS:
            rows = _Rows.joined(held)
            route = rows.columns[0]
            cut = int(np.searchsorted(route, route[-1]))  # the last route may go on
            rest, first = rows.part(cut, len(rows)), 0
            while first < cut:
                last = int(np.searchsorted(rows.offsets, rows.offsets[first] + SHARD_WORDS))
                last = min(cut, max(last, first + 1))
                last = int(np.searchsorted(route, route[last - 1], side="right"))
                yield from _indexed(rows.part(first, last))
                first = last
            if len(rest.values) > SHARD_WORDS:
                rest, spans = _copies(rest.once())
                yield spans
            held, size = [rest], len(rest.values)
    if held and len(held[0]):
        yield from _indexed(_Rows.joined(held))


def _short(low: np.ndarray) -> np.ndarray:
    """The upper 48 bits of hashes, as bytes: enough to tell which may be repeated."""
    return np.ascontiguousarray((low >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6])


def _long(column: pa.Array) -> np.ndarray:
    raw = C.buffers(column)[0].reshape(-1, 6)
    return np.hstack([raw, np.zeros((len(raw), 2), np.uint8)]).view(np.uint64).reshape(-1)


def _grouped(keys: list[np.ndarray], low: np.ndarray, number: np.ndarray) -> tuple[list[np.ndarray], pa.Array, pa.Array]:
    """Rows of sorted keys: the different keys, and packed hashes and numbers of each."""
    new = np.ones(len(low), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    begin = np.flatnonzero(new)
    offsets = np.append(begin, len(low))
    return [k[begin] for k in keys], C.binary_rows(_short(low).reshape(-1), offsets * 6), C.binary_rows(number.astype(np.uint8), offsets)


def _cut_runs(batch: pa.RecordBatch, wanted: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    """Rows of runs whose least grams are wanted; those of hot ones as single windows.  Of equal runs the earliest has the words, the others are known to be repeats."""
    hashes, _, _, first = C.words(*C.buffers(batch.column("text")), fold=False)
    low, at, n, _ = window_runs(hashes, first)
    short = low >> np.uint64(16)
    place = np.minimum(np.searchsorted(wanted, short), len(wanted) - 1)
    keep = wanted[place] == short
    low, at, n, single = low[keep], at[keep], n[keep], hot[place[keep]]
    if single.any():
        at = np.concatenate([at[~single], C._places(at[single], n[single])])
        whole = C.runs(hashes, WINDOW)[at[len(single) - int(single.sum()) :]]
        low, n = np.concatenate([low[~single], whole]), np.concatenate([n[~single], np.ones(len(whole), np.int64)])
    row = np.searchsorted(first, at, side="right") - 1
    d, t, p = batch.column("d").to_numpy()[row], batch.column("t").to_numpy()[row], at - first[row]
    order = np.lexsort((p, t, d, low))
    low, at, n, d, t, p = (x[order] for x in (low, at, n, d, t, p))
    checks = C.runs(hashes & np.uint64(0xFFFFFFFF), WINDOW) >> np.uint64(32)
    words = hashes >> np.uint64(32)
    size = 2 * n + WINDOW - 1
    offsets = np.concatenate([[0], np.cumsum(size)])
    values = np.empty(int(offsets[-1]), np.uint64)
    values[C._places(offsets[:-1], n + WINDOW - 1)] = words[C._places(at, n + WINDOW - 1)]
    values[C._places(offsets[:-1] + n + WINDOW - 1, n)] = checks[C._places(at, n)]
    head = _heads(low, values, offsets)
    known = (head != np.arange(len(head))) & ((d != d[head]) | (t != t[head]) | (p != p[head]))
    # known repeats need no index and no route
    route = np.where(known, C.mix(d.view(np.uint64) + (t + p).view(np.uint64)), low).view(np.int64)
    sent, ends = _taken(values, offsets, np.flatnonzero(~known))
    blobs = C.binary_rows(sent.astype(np.uint32), ends)
    place = np.where(known, 0, np.cumsum(~known) - 1)
    column = blobs.take(pa.array(place, mask=known)) if known.any() else blobs
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in (route, d, t, p, n)), column.cast(pa.binary())], names=["route", "d", "t", "p", "n", "words"])


def repeated_spans(packets: DataFrame, parts: int) -> DataFrame:
    """(d, t, b, e): spans of words to remove, of texts dealt to packets (packet, d, t, text); parts: partitions."""
    shards = np.array(C.even_keys(packets.sparkSession, parts, SHARDS), np.int64)
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To each shard of least grams, the packet's different ones with the weights of their runs."""
        for batch in C.pieces(batches, "text", 4 * C.CHUNK_BYTES):
            hashes, _, _, first = C.words(*C.buffers(batch.column("text")), fold=False)
            low, at, _, weight = window_runs(hashes, first)
            if not len(low):
                continue
            packet = batch.column("packet").to_numpy()[np.searchsorted(first, at, side="right") - 1]
            order = np.lexsort((low, packet))
            low, packet, weight = low[order], packet[order], weight[order]
            begin = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (packet[1:] != packet[:-1])]))
            low, packet, weight = low[begin], packet[begin], np.minimum(np.add.reduceat(weight, begin), 255)
            shard = ((low >> np.uint64(32)) * np.uint64(len(shards)) >> np.uint64(32)).astype(np.int64)
            (packet, shard), lows, weights = _grouped([packet, shard], low, weight)
            yield pa.RecordBatch.from_arrays([pa.array(shards[shard]), pa.array(packet), lows, weights], names=["shard", "packet", "low", "n"])

    def answer(table: pa.Table) -> pa.Table:
        """To each packet, those of its least grams that stand twice or more, and whether they are hot."""
        table = table.combine_chunks()
        column = lambda c: table.column(c).chunk(0) if table.column(c).num_chunks else table.column(c).combine_chunks()
        low, number = _long(column("low")), C.buffers(column("n"))[0].astype(np.int64)
        packet = np.repeat(column("packet").to_numpy(), np.diff(C.buffers(column("n"))[1]))
        _, at = np.unique(low, return_inverse=True)
        total = np.bincount(at, number)[at]
        some = np.flatnonzero(total > 1)
        some = some[np.lexsort((low[some], packet[some]))]
        (packet,), lows, hot = _grouped([packet[some]], low[some] << np.uint64(16), total[some] > HOT) if len(some) else ([packet[:0]], pa.array([], pa.binary()), pa.array([], pa.binary()))
        return pa.Table.from_arrays([pa.array(packet), lows, hot], names=["packet", "low", "hot"])

    def cut(texts: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if answers.num_rows and texts.num_rows:
            low, hot = (np.concatenate(x) for x in zip(*((_long(b.column("low")), C.buffers(b.column("hot"))[0]) for b in answers.to_batches()), strict=True))
            wanted, at = np.unique(low, return_index=True)
            out = [_cut_runs(piece, wanted, hot[at] > 0) for piece in C.pieces(iter(texts.to_batches()), "text", 4 * C.CHUNK_BYTES)]
        schema = pa.schema([*((c, pa.int64()) for c in ("route", "d", "t", "p", "n")), ("words", pa.binary())])
        return pa.Table.from_batches(out, schema)

    of = packets.mapInArrow(send, "shard long, packet long, low binary, n binary").groupBy("shard").applyInArrow(answer, "packet long, low binary, hot binary")
    runs = packets.groupBy("packet").cogroup(of.groupBy("packet")).applyInArrow(cut, "route long, d long, t long, p long, n long, words binary")
    return runs.repartition(parts, "route").sortWithinPartitions("route", "d", "t", "p").mapInArrow(_shards, "d long, t long, b long, e long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts without passages that also stand earlier.

    docs: id_col (long), text_col.  Words are runs of characters other than
    space and 9 to 13, unchanged.  A word goes if one of the windows of WINDOW
    words over it also starts earlier: in a document of smaller id, or earlier
    in its own.  Documents of one id follow each other by their texts' hashes;
    repeated rows count as one document, and each of them gives a row; null ids
    come first; null and empty texts have no words.  Returns doc_id, n_words,
    n_removed, kept_text (words joined by a space).  Of an empty table, none.

    Windows are equal if 32 bits of each word's hash are, and 32 more of the
    whole window's.  One plan serves all sizes: texts are dealt to packets by
    one exchange that all three steps read; nothing is sent to the driver.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = C.even_keys(docs.sparkSession, parts, PACKETS)
    of = F.split(F.lit(",".join(map(str, keys))), ",").cast("array<long>")  # a constant of the plan
    packet = lambda: F.get(of, F.pmod(F.xxhash64("d", "t"), F.lit(len(keys))).cast("int"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    keyed = texts.withColumns({"d": F.coalesce("doc_id", F.lit(-(2**63))), "t": F.xxhash64("text")})
    packets = keyed.withColumn("packet", packet()).repartition(parts, "packet")
    spans = repeated_spans(packets, parts).withColumn("packet", packet())
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def remove(rows: pa.Table, spans: pa.Table) -> pa.Table:
        gone: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for d, t, b, e in zip(*(spans.column(c).to_pylist() for c in ("d", "t", "b", "e")), strict=True):
            gone.setdefault((d, t), []).append((b, e))
        out = []
        for batch in C.pieces(iter(rows.to_batches()), "text", 4 * C.CHUNK_BYTES):
            number, removed, kept = [], [], []
            for text, d, t in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("d").to_pylist(), batch.column("t").to_pylist(), strict=True):
                words = text.split()
                left, done = words, 0
                if (d, t) in gone:
                    left = []
                    for b, e in sorted(gone[d, t]):
                        left += words[done:b] if b > done else []
                        done = max(done, e)
                    left += words[done:]
                number.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "replace"))
            out.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(number, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=schema.names))
        return pa.Table.from_batches(out, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]))

    return packets.groupBy("packet").cogroup(spans.groupBy("packet")).applyInArrow(remove, schema)
