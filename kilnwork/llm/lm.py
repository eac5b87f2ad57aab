"""Operator 7, LM scoring: online logistic context mixing.

A text is read as its lower-cased words, a space between them and an end mark: a sequence of bytes, and each byte as bits,
along the Huffman code of the corpus. Predictors look a bit up by a hashed context (the word so far with the last letter beyond
ASCII before it, the last four symbols, the last three) and give log-odds; a logistic mixer adds them with weights that the
code's node gates. As a document is read, the mixer goes on learning: after every block of 32 bytes (later of an eighth of
what was read) each predictor's share and a last correction, both gated by the bit's depth in its byte, take a
step against the errors made since, beginning from the corpus' weights. The bits' probabilities multiply to that of the text.

The predictors' counts come from all training documents: every task counts symbols per context, tables of a fixed number
of slots are summed over tasks, apart for two halves of the texts. The weights that documents begin with are fitted on all
training documents too, each looked up in the other half's tables: one pass tallies every bit by its node, its value and what
the predictors said of it, and Newton's method runs on that tally, whose size is fixed. The unigram baseline counts every word
of the corpus; frequent words, of a bounded number, are looked up from a broadcast, the others by a join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import crc_text, materialize, release, rows, table

#: Symbols: the most frequent bytes, and one that stands for all others, whose byte then costs 8 bits.
SYMBOLS = 64
#: log2 of the number of contexts of each predictor.
ROWS = (17, 17, 16)
CHUNK = 1 << 16
#: For the fit of the weights a predictor's log-odds are told apart in halves, as one of so many levels.
LEVELS = 32
#: Words of the broadcast, at most.
HOT = 200_000
#: Bytes of a block after which the mixer learns; beyond BLOCK * GROWS bytes a block is a GROWS-th of what was read.
BLOCK, GROWS = 32, 8
#: What the corpus' weights count for against a document's own evidence: the shares, and the last correction.
FIRM, FIRM_LAST = 5.0, 20.0
#: Characters that are counted, tallied and scored at once; what a task holds beside its tables is some hundred bytes for each.
COUNT_AT_ONCE, TALLY_AT_ONCE, SCORE_AT_ONCE = 1 << 18, 1 << 21, 1 << 20
#: Bytes whose contexts are worked out at once, and whose bits are looked up at once.
NEAR, STRETCH = 1 << 16, 1 << 15
#: Words that a task counts before it passes them on.
WORDS_AT_ONCE = 250_000
#: Words that are looked up among the frequent ones at once; what they are found by is made anew each time.
WORDS_LOOKED_UP = 1_000_000
#: Predictors' log-odds are kept in SCALE-ths, in bytes; the mixer's in FINE-ths, up to LIMIT.
SCALE, FINE, LIMIT = 16.0, 32, 12
#: Tasks whose counts are added up by one other task.
TOGETHER = 1024
PRIOR = np.array([0.4, 0.4, 0.4])
#: What is added to the counts of either bit.
SMOOTH = 0.05


@dataclass(frozen=True)
class Code:
    """The Huffman code: symbol by byte, and per symbol its (node, bit) path."""

    symbol: np.ndarray
    paths: list[list[tuple[int, int]]]

    @staticmethod
    def of(hist: np.ndarray) -> Code:
        order = np.argsort(-hist, kind="stable")[: SYMBOLS - 1]
        symbol = np.full(256, SYMBOLS - 1, np.uint8)
        symbol[order] = np.arange(SYMBOLS - 1)
        weight = np.bincount(symbol, hist, SYMBOLS) + 0.5
        heap = [(w, i, ("leaf", i)) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        paths: list[list[tuple[int, int]]] = [[] for _ in range(SYMBOLS)]
        below = {("leaf", i): [i] for i in range(SYMBOLS)}
        node = 0
        while len(heap) > 1:
            (wa, ia, a), (wb, ib, b) = heapq.heappop(heap), heapq.heappop(heap)
            for side, bit in ((a, 0), (b, 1)):
                for s in below[side]:
                    paths[s].insert(0, (node, bit))
            below[("node", node)] = below[a] + below[b]
            heapq.heappush(heap, (wa + wb, SYMBOLS + node, ("node", node)))
            node += 1
        return Code(symbol, paths)

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths of the paths, and node and bit by depth and symbol."""
        length = np.array([len(p) for p in self.paths])
        node, bit = (np.zeros((length.max(), SYMBOLS), np.int64) for _ in range(2))
        for s, path in enumerate(self.paths):
            for j, (n, b) in enumerate(path):
                node[j, s], bit[j, s] = n, b
        return length, node, bit


def powers_of(factor: int, n: int, kept: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006  a memo
    if len(kept.get(factor, ())) < n:
        kept[factor] = np.multiply.accumulate(np.concatenate([[1], np.full(n - 1, factor)]).astype(np.uint32), dtype=np.uint32)
    return kept[factor][:n]


FACTOR = 0x9E3779B1


def contexts(symbols: np.ndarray, space: int, wide: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Per predictor the first slot (context times SYMBOLS) of every position; `first` marks the positions where a text
    starts, `wide` those of bytes beyond ASCII."""
    n = len(symbols)
    s = symbols.astype(np.uint32)
    s += np.uint32(1)
    start, other = np.flatnonzero(first), np.empty(n, np.uint32)
    # the last three symbols, and the last four; what lies before a text's start is 0
    powers, lately, x = np.array([1, 65, 4225, 274625], np.uint32), [], np.zeros(n, np.uint32)
    at = start[:, None] + np.arange(4)
    inside = at < np.append(start[1:], n)[:, None]
    early = s.take(at[:, :3], mode="clip") @ np.stack([np.pad(powers[: 3 - i], (i + 1, 0)) for i in range(3)])
    x[1:] = s[:-1]
    for k in (1, 2, 3):
        np.multiply(s[: -k - 1], powers[k], out=other[k + 1 :])
        x[k + 1 :] += other[k + 1 :]
        if k >= 2:
            x[at[:, : k + 1][inside[:, : k + 1]]] = early[:, : k + 1][inside[:, : k + 1]]
            lately.insert(0, x * np.uint32(2654435761))
    # the word so far: a hash of the symbols since the last space or start
    begin = first.copy()
    begin[1:] |= symbols[:-1] == space
    origin = np.flatnonzero(begin)
    run = np.diff(origin, append=n)
    sums = np.zeros(n + 1, np.uint32)
    np.multiply(s, powers_of(FACTOR, n), out=other)
    np.cumsum(other, out=sums[1:], dtype=np.uint32)
    back = powers_of(pow(FACTOR, -1, 1 << 32), n)[origin]
    h = sums[:n]
    offset = sums[origin] * back + origin.astype(np.uint32)
    h *= np.repeat(back, run)
    h += np.arange(n, dtype=np.uint32)
    h -= np.repeat(offset, run)
    np.right_shift(h, np.uint32(15), out=other)
    h ^= other
    # the word so far, and the last symbol of a byte beyond ASCII before it: it tells languages apart
    marks = wide | first
    before = np.flatnonzero(marks)[np.cumsum(marks, dtype=np.int32)[np.maximum(origin - 1, 0)] - 1]
    last = np.where(wide[before] & ~first[origin], s[before], np.uint32(0))
    if last.any():
        h += np.repeat(last * np.uint32(0x85EBCA6B), run)
    h *= np.uint32(3266489917)
    out = []
    for x, r in zip((h, *lately), ROWS):
        x >>= np.uint32(26 - r)
        x &= np.uint32((SYMBOLS << r) - SYMBOLS)
        out.append(x.view(np.int32))
    return out


#: Bytes as they are read: white space is a space, A to Z are lower-cased.
READ_AS = bytes(32 if 9 <= i <= 13 else i for i in range(256)).lower()


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in turn, one space between words and an end mark behind each text, and where each text's bytes end."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(bytearray(b" ".join([*parts, b""]).translate(READ_AS)), np.uint8)
    data[np.cumsum([len(p) + 1 for p in parts]) - 1] = 10
    # white space stays where a letter follows, if it doesn't begin a text
    letter = (data != 32) & (data != 10)
    kept = data != 32
    kept[:-1] |= letter[1:]
    begin = np.flatnonzero(data[:-1] == 10) + 1
    if data[0] == 32 or (data[begin] == 32).any():
        after = np.flatnonzero(data != 32)  # the first byte of each text that stays
        kept[np.maximum(after[np.searchsorted(after, np.append(0, begin))] - 1, 0)] = False
        kept |= data != 32
    data = data if kept.all() else data[kept]
    return data, np.flatnonzero(data == 10) + 1


def split(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words in turn, and where each text's words begin. A text without words has one, the empty one."""
    between = (data == 32) | (data == 10)
    stops = np.flatnonzero(between)
    offsets = np.zeros(len(stops) + 1, np.int32)
    np.subtract(stops, np.arange(len(stops)), out=offsets[1:], casting="unsafe")
    words = pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(data[~between])])
    return words, np.searchsorted(stops, np.concatenate([[0], ends[:-1]]))


def read(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words, all bytes in turn, and where each text's bytes end."""
    data, ends = joined(texts)
    return split(data, ends)[0], data, ends


def starts_of(ends: np.ndarray) -> np.ndarray:
    first = np.zeros(int(ends[-1]), bool)
    first[np.concatenate([[0], ends[:-1]])] = True
    return first


def located(code: Code, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Symbols and contexts of texts, worked out for some texts at a time, whose figures the processor's cache holds."""
    symbols, first, space = code.symbol[data], starts_of(ends), int(code.symbol[32])
    parts, lo = [], 0
    while lo < len(data):
        hi = int(ends[max(np.searchsorted(ends, lo + NEAR, "right") - 1, np.searchsorted(ends, lo, "right"))])
        parts.append(contexts(symbols[lo:hi], space, data[lo:hi] >= 128, first[lo:hi]))
        lo = hi
    return symbols, [np.concatenate(p) for p in zip(*parts)]


def add_counts(counts: list[np.ndarray], code: Code, data: np.ndarray, ends: np.ndarray, half: np.ndarray | None = None) -> None:
    """half: which half of the tables each text goes to, where they have two."""
    symbols, ctx = located(code, data, ends)
    shift = None if half is None else np.repeat(half.astype(np.int32), np.diff(ends, prepend=0))
    for table_, at in zip(counts, ctx):
        if shift is not None:
            at += shift * np.int32(len(table_) // 2)
        np.add.at(table_, at + symbols, np.uint32(1))


def odds(counts: list[np.ndarray], code: Code, weights: np.ndarray | None = None) -> list[np.ndarray]:
    """Per predictor the log-odds of every node's bit by context, in SCALE-ths, times the predictor's weight at that node."""
    left, right = (np.zeros((SYMBOLS, SYMBOLS), np.float32) for _ in range(2))
    for s, path in enumerate(code.paths):
        for node, bit in path:
            (right if bit else left)[s, node] = 1
    out = []
    for k, c in enumerate(counts):
        quantised = np.empty(len(c), np.int8)
        by_node = SCALE if weights is None else SCALE * weights[:, k].astype(np.float32)
        for i in range(0, len(c), 1 << 20):
            part = c[i : i + (1 << 20)].reshape(-1, SYMBOLS).astype(np.float32)
            z = np.log((part @ right + SMOOTH) / (part @ left + SMOOTH)) * by_node
            quantised[i : i + (1 << 20)] = np.clip(np.round(z), -127, 127).astype(np.int8).ravel()
        out.append(quantised)
    return out


class Mixer:
    """Scores texts, all texts of a batch at once: block by block, all bits of a block together, in order of their depth in the code
    and of the texts. What a bit needs of the mixed log-odds (its logarithm, error and weight of evidence) is looked up by a small
    whole number."""

    def __init__(self, code: Code, tables: list[np.ndarray]):
        """tables: the predictors' log-odds, times the corpus' weights."""
        self.code, self.tables = code, tables
        length, self.node, bit = code.steps()
        self.length = length.astype(np.uint8)
        z = np.arange(-LIMIT * FINE, LIMIT * FINE + 1) / FINE
        p = 1 / (1 + np.exp(-z))
        self.log = np.concatenate([np.log10(1 - p), np.log10(p)])
        self.error = np.concatenate([-p, 1 - p]).astype(np.float32)
        self.mass = (p * (1 - p)).astype(np.float32)
        self.side = (bit * len(p)).astype(np.intp)  # where the figures of a bit's value begin

    def look_up(self, symbols: np.ndarray, ctx: list[np.ndarray], ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By depth: the predictors' log-odds of every bit, its side, and where the bits of each stretch of symbols end, after a 0;
        `ends` has where the stretches do."""
        out, length, to = [], self.length.take(symbols), np.concatenate([[0], ends])
        symbols, ctx = symbols.astype(np.intp), np.stack(ctx, dtype=np.intp)
        for depth, (node, side) in enumerate(zip(self.node, self.side)):
            if depth >= self.length.min():
                more = np.flatnonzero(length > depth)
                symbols, length, ctx, to = symbols.take(more), length.take(more), ctx.take(more, axis=1), np.searchsorted(more, to)
            at, odds_ = ctx + node.take(symbols, mode="clip"), np.empty(ctx.shape, np.int8)
            for x, t, c in zip(odds_, self.tables, at):
                t.take(c, out=x, mode="clip")
            out.append((odds_, side.take(symbols, mode="clip"), to))
        return out

    def blocks(self, size: np.ndarray, begin: np.ndarray) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
        """How many texts have the next block (`size` falls), its lengths, and the places of its bytes; some blocks at a time, of
        about STRETCH bytes."""
        held, room, lo = [], STRETCH, 0
        while live := int(np.searchsorted(-size, -lo)):
            n = np.minimum(max(BLOCK, lo // GROWS), size[:live] - lo)
            held.append((live, n, np.repeat(begin[:live] + lo - np.cumsum(n) + n, n) + np.arange(n.sum())))
            lo, room = lo + max(BLOCK, lo // GROWS), room - n.sum()
            if room <= 0:
                yield held
                held, room = [], STRETCH
        if held:
            yield held

    def score(self, data: np.ndarray, ends: np.ndarray, learn: bool = True) -> np.ndarray:
        """log10 probability of every text. No text's score depends on the others of its batch."""
        symbols, ctx = located(self.code, data, ends)
        begin, depths = np.concatenate([[0], ends[:-1]]), len(self.node)
        order = np.argsort(begin - ends, kind="stable")  # the longest first: those that have a block come before the others
        out = np.zeros(len(ends))
        # of each predictor its share, and the last correction, by depth and text
        own, proof = np.ones((4, depths, len(ends))), np.full((4, depths, len(ends)), FIRM)
        own[3], proof[3] = 0, FIRM_LAST
        units = np.array([1 / SCALE, 1 / SCALE, 1 / SCALE, 1])[:, None, None]
        room = np.empty((2, 4, 0), np.float32)
        for some in self.blocks((ends - begin)[order], begin[order]):
            at, n = (np.concatenate(x) for x in list(zip(*some))[:0:-1])
            bits = self.look_up(symbols.take(at), [c.take(at) for c in ctx], np.cumsum(n))
            hi = 0
            for live, _, _ in some:
                lo, hi = hi, hi + live
                held = [(x[:, to[lo] : to[hi]], side[to[lo] : to[hi]], to[lo + 1 : hi + 1] - to[lo:hi]) for x, side, to in bits]
                n = np.concatenate([k for _, _, k in held])
                x = np.concatenate([v for v, _, _ in held], axis=1, dtype=np.float32, casting="unsafe")
                full = np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[full]
                by_text = (own[:, :, :live] * (units * FINE)).astype(np.float32).reshape(4, -1)
                by_text[3] += LIMIT * FINE
                z = np.repeat(by_text, n, axis=1)
                z[:3] *= x
                *z, mixed = z
                for k in z:
                    mixed += k
                np.rint(mixed, out=mixed)
                np.clip(mixed, 0, 2 * LIMIT * FINE, out=mixed)
                q = mixed.astype(np.intp)
                look = np.concatenate([v for _, v, _ in held])
                look += q
                sums = np.zeros(len(n))
                sums[full] = np.add.reduceat(self.log.take(look, mode="clip"), starts)
                out[:live] += sums.reshape(depths, -1).sum(0)
                if not learn:
                    continue
                if room.shape[2] < len(look):
                    room = np.empty((2, 4, len(look)), np.float32)
                terms = room[:, :, : len(look)]
                self.mass.take(q, out=terms[0, 3], mode="clip")
                self.error.take(look, out=terms[1, 3], mode="clip")
                np.multiply(terms[:, 3:], x, out=terms[:, :3])
                terms[0, :3] *= x
                sums = np.zeros((2, 4, len(n)))
                sums[:, :, full] = np.add.reduceat(terms, starts, axis=2)
                gain, pull = sums.reshape(2, 4, depths, -1)
                gain *= units**2
                pull *= units
                proof[:, :, :live] += gain
                pull /= proof[:, :, :live]
                own[:, :, :live] += pull
                for k, least, most in ((slice(3), 0, 3), (3, -2, 2)):
                    np.clip(own[k, :, :live], least, most, out=own[k, :, :live])
        out[order] = out.copy()
        rare = np.add.reduceat(symbols == SYMBOLS - 1, begin, dtype=np.int64) if len(ends) else 0
        return out - rare * (8 * np.log10(2))


def levels(odds_: np.ndarray) -> np.ndarray:
    """Log-odds in SCALE-ths as levels: LEVELS // 2 is 0, a level more is half a unit more."""
    out = np.empty(len(odds_), np.uint8)
    for i in range(0, len(out), 1 << 20):
        near = (odds_[i : i + (1 << 20)].astype(np.int16) + 4) >> 3
        out[i : i + (1 << 20)] = near.clip(1 - LEVELS // 2, LEVELS // 2 - 1) + LEVELS // 2
    return out


def add_tally(tally: np.ndarray, code: Code, tables: list[np.ndarray], data: np.ndarray, ends: np.ndarray, half: np.ndarray) -> None:
    """Adds every bit of some texts to tally[node, bit, levels of the three predictors]. `tables` has the predictors' levels by the
    texts of the first half, then by those of the second; a text is looked up in the half that it isn't in. Equal symbols in
    equal contexts are looked up once, and count as often as they occur."""
    symbols, ctx = located(code, data, ends)
    key = symbols.astype(np.uint64)
    for c, r in zip(ctx, ROWS):
        key <<= np.uint64(r)
        key |= (c >> 6).astype(np.uint64)
    key <<= np.uint64(1)
    key |= np.repeat(1 - half.astype(np.uint8), np.diff(ends, prepend=0))
    del symbols, ctx
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times, key = np.diff(np.append(first, len(key))), key[first]
    other, key = (key & np.uint64(1)).astype(np.intp), key >> np.uint64(1)
    ctx = []
    for r in reversed(ROWS):
        ctx.insert(0, (key & np.uint64((1 << r) - 1)).astype(np.intp) + (other << r))
        key >>= np.uint64(r)
    tables = [t.reshape(-1, SYMBOLS) for t in tables]
    stop = np.searchsorted(key, np.arange(1, SYMBOLS + 1, dtype=np.uint64)).tolist()
    for start, end, path in zip([0, *stop], stop, code.paths):
        cells, n = np.empty((len(path), end - start), np.uint16), times[start:end]
        for lo in range(start, end, 1 << 14):
            first, *others = (t.take(c[lo : min(lo + (1 << 14), end)], axis=0) for t, c in zip(tables, ctx))
            for some, (node, _) in zip(cells[:, lo - start : lo - start + (1 << 14)], path):
                some[:] = first[:, node]
                for t in others:
                    some *= np.uint16(LEVELS)
                    some += t[:, node]
        for some, (node, bit) in zip(cells, path):
            if len(some) > LEVELS**3 // 16:
                tally[node, bit] += np.bincount(some, n, LEVELS**3).astype(tally.dtype)
            else:
                np.add.at(tally[node, bit], some.astype(np.intp), n.astype(tally.dtype))


def tallied(docs: DataFrame, code: Code, tables: list[np.ndarray], name: str) -> np.ndarray:
    """The tally of all documents (text, half), counted in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast((code, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_, tables_ = shared.value
        tally = np.zeros((SYMBOLS, 2, LEVELS**3), np.uint32)
        for part in rows(batches, "text", "half", limit_bytes=TALLY_AT_ONCE):
            data, ends = joined([t for t, _ in part])
            add_tally(tally, code_, tables_, data, ends, np.array([h for _, h in part]))
        chunk, salt, packed = packed_chunks([tally.ravel()])
        yield pa.record_batch([pa.array(chunk, pa.int32()), pa.array(salt, pa.int32()), pa.array(packed, pa.binary())], ["chunk", "salt", "counts"])

    parts = materialize(docs.select("text", "half").mapInArrow(run, "chunk int, salt int, counts binary"), f"{name}-tally")
    out = np.zeros(SYMBOLS * 2 * LEVELS**3)
    add_tables([out], parts, f"{name}-tallied")
    release(parts)
    return out.reshape(SYMBOLS, 2, LEVELS**3)


def fit_weights(tally: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Weights by node and predictor: Newton's method, held to PRIOR."""
    node, bit, cell = np.nonzero(tally)
    n = tally[node, bit, cell]
    x = [((cell // LEVELS**k) % LEVELS - LEVELS // 2) / 2 for k in (2, 1, 0)]
    pairs = [(a, b) for a in range(3) for b in range(a, 3)]
    weights = np.tile(PRIOR, (SYMBOLS, 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-sum(weights[node, k] * x[k] for k in range(3))))
        pull = np.stack([np.bincount(node, n * (bit - p) * v, SYMBOLS) for v in x], 1)
        curve = np.zeros((SYMBOLS, 3, 3))
        for a, b in pairs:
            curve[:, a, b] = curve[:, b, a] = np.bincount(node, n * p * (1 - p) * x[a] * x[b], SYMBOLS)
        step = np.linalg.solve(curve + 20 * np.eye(3), (pull - 20 * (weights - PRIOR))[:, :, None])[:, :, 0]
        weights = np.round(weights + step.clip(-0.5, 0.5), 6)
    return weights


def histogram(docs: DataFrame) -> np.ndarray:
    """How often each byte occurs in what is read of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for part in rows(batches, "text"):
            data, _ = joined([t for (t,) in part])
            for i in range(0, len(data), CHUNK):
                total += np.bincount(data[i : i + CHUNK], minlength=256)
        yield pa.record_batch([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])

    out = np.zeros(256)
    for r in docs.select("text").mapInArrow(run, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():  # 256 rows
        out[r.byte] = r.n
    return out


GATHER = "word binary, n long, chunk int, salt int, counts binary"


def tally_words(words: pa.Array, more: int) -> pa.Table:
    """How often each word occurs; the end mark is the empty word, which `more` texts have beside their words."""
    found = words.value_counts()
    return pa.table({"word": pa.chunked_array([found.field("values"), pa.array([b""], pa.binary())]), "n": pa.chunked_array([found.field("counts"), pa.array([more], pa.int64())])})


def gather(docs: DataFrame, code: Code) -> DataFrame:
    """Of every task's documents (text, half): how often each word occurs (the end mark is the empty word), a row each, and its symbol
    counts per context, of either half of the texts, a row for each chunk of the tables."""
    sizes = [2 * SYMBOLS << r for r in ROWS]
    types = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["word", "n", "chunk", "salt", "counts"]

    def batch(*columns: list | pa.Array | None) -> pa.RecordBatch:
        size = next(len(c) for c in columns if c is not None)
        return pa.record_batch([pa.nulls(size, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(n, np.uint32) for n in sizes]
        words, held = [], 0  # tables of words and their counts, and their rows in all

        def merge() -> int:
            words[:] = [pa.concat_tables(words).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])]
            return len(words[0])

        def flush() -> Iterator[pa.RecordBatch]:
            for some in words.pop().combine_chunks().to_batches(max_chunksize=1 << 15):
                yield batch(*some.columns, None, None, None)

        for part in rows(batches, "text", "half", limit_bytes=COUNT_AT_ONCE):
            data, ends = joined([t for t, _ in part])
            add_counts(counts, code, data, ends, np.array([h for _, h in part]))
            words.append(tally_words(split(data, ends)[0], int((np.diff(ends, prepend=0) > 1).sum())))
            held += len(words[-1])
            if held > 2 * WORDS_AT_ONCE:
                if (held := merge()) > WORDS_AT_ONCE:
                    yield from flush()
                    held = 0
        if words:
            merge()
            yield from flush()
        for column in zip(*packed_chunks(counts)):
            yield batch(None, None, *([v] for v in column))

    return docs.select("text", "half").mapInArrow(run, GATHER)


def sparse(c: np.ndarray) -> bytes:
    """A chunk's counts: those under 256 as places and bytes, the others as places and long words."""
    at = np.flatnonzero(c)
    small = at[c[at] < 256]
    large = at[c[at] >= 256]
    return b"".join([np.array([len(small), len(large)], np.uint32).tobytes(), small.astype(np.uint16).tobytes(), c[small].astype(np.uint8).tobytes(), large.astype(np.uint16).tobytes(), c[large].astype(np.uint64).tobytes()])


def packed_chunks(tables: list[np.ndarray]) -> tuple[list[int], list[int], list[bytes]]:
    """Of a task's tables all chunks that hold anything: place, salt (tasks of one are added up together) and counts."""
    chunks = [t[i : i + CHUNK] for t in tables for i in range(0, len(t), CHUNK)]
    held = [i for i, c in enumerate(chunks) if c.any()]
    return held, [TaskContext.get().partitionId() // TOGETHER] * len(held), [sparse(chunks[i]) for i in held]


def add_sparse(to: np.ndarray, data: bytes) -> None:
    m, n = np.frombuffer(data, np.uint32, 2).tolist()
    at = 8
    for k, kind in ((m, np.uint8), (n, np.uint64)):
        places = np.frombuffer(data, np.uint16, k, at)
        at += 2 * k
        to[places] += np.frombuffer(data, kind, k, at)
        at += k * np.dtype(kind).itemsize


def sum_chunks(parts: DataFrame) -> DataFrame:
    """Adds the counts of equal (chunk, salt), in a stream: a task holds a sum per key, not the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for chunk, salt, counts in zip(b.column("chunk").to_pylist(), b.column("salt").to_pylist(), b.column("counts")):
                add_sparse(sums.setdefault((chunk, salt), np.zeros(CHUNK, np.uint64)), counts.as_buffer())
        for (chunk, salt), c in sums.items():
            yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([salt], pa.int32()), pa.array([sparse(c)], pa.binary())], ["chunk", "salt", "counts"])

    return parts.select("chunk", "salt", "counts").repartition("chunk", "salt").mapInArrow(run, "chunk int, salt int, counts binary")


def frequent(vocabulary: DataFrame) -> DataFrame:
    """The most frequent words, at most HOT of them: those above the least threshold, on a logarithmic scale, that leaves so few."""
    level = F.floor(F.log2("c") * 32).cast("int")
    room, least = HOT, None
    for r in sorted(vocabulary.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):  # some hundred levels
        room -= r["count"]
        if room < 0:
            break
        least = r.level
    return vocabulary.where(level >= least) if least is not None else vocabulary.limit(0)


def add_tables(counts: list[np.ndarray], parts: DataFrame, name: str) -> None:
    """Adds the counts of all tasks, summed by chunk, to the driver's tables, whose size is fixed."""
    salted = sum_chunks(parts.where("chunk is not null"))
    summed = materialize(sum_chunks(salted.withColumn("salt", F.lit(0))), name)
    chunks = [c[i : i + CHUNK] for c in counts for i in range(0, len(c), CHUNK)]
    for r in summed.coalesce(4).toLocalIterator():  # a fixed number of chunks
        whole = np.zeros(CHUNK, np.uint64)
        add_sparse(whole, bytes(r.counts))
        chunks[r.chunk] += whole
    release(summed)


def base(words: pa.Array, begin: np.ndarray, hot: pa.Array, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """By text, of what split() has: how many tokens are in `hot`, the sum of their `logs`, the words that aren't, and the number of
    words. `hot` has the end mark, the empty word, first."""
    place = pc.index_in(words, value_set=hot).fill_null(len(hot)).to_numpy()
    word, miss = place > 0, place == len(hot)
    n_words, n_miss = (np.add.reduceat(x, begin, dtype=np.int64) for x in (word, miss))
    rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_miss)]), pa.int32()), words.filter(pa.array(miss)))
    sums = np.add.reduceat(np.concatenate([[0.0], logs[1:], [0.0]]).take(place), begin)
    return n_words - n_miss + (logs[0] > 0), sums + logs[0], rare, n_words


def score_texts(docs: DataFrame, train: str, *, name: str = "lm") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every row of `docs` (doc_id, text).

    The model learns from the rows for which `train` (SQL) holds. A null text is empty: the end mark alone. Without
    training rows every bit costs one bit and the base score is that of N = V = 0. Repeated rows count and score each;
    empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    known = docs.where(train)
    code = Code.of(histogram(known))
    known = known.select("text", F.pmod(F.xxhash64(F.lit(42), "text"), F.lit(2)).cast("int").alias("half"))  # copies share a half
    parts = materialize(gather(known, code), f"{name}-gather")
    vocabulary = materialize(parts.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), f"{name}-words")
    figures = vocabulary.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    counts = [np.zeros(2 * SYMBOLS << r, np.float32) for r in ROWS]
    add_tables(counts, parts, f"{name}-counts")
    release(parts)
    weights = fit_weights(tallied(known, code, [levels(x) for x in odds(counts, code)], name))
    counts = [c[: len(c) // 2] + c[len(c) // 2 :] for c in counts]
    mixer = Mixer(code, odds(counts, code, weights))
    del counts
    frequent_ = {bytes(r.word): float(np.log10(r.c + 1)) for r in frequent(vocabulary).collect()}
    logs = {b"": frequent_.pop(b"", 0.0)} | frequent_
    shared = spark.sparkContext.broadcast((mixer, pa.array(logs, pa.binary()), np.array(list(logs.values()))))  # bounded by ROWS and HOT
    out = "rid long, doc_id long, n_tokens long, hot_known long, hot_sum double, score double, n_bytes long, rare array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hot, logs = shared.value
        rid, held = TaskContext.get().partitionId() << 40, []

        def flush() -> pa.RecordBatch:
            nonlocal rid
            ids, words, begin, n, score = zip(*held)
            held.clear()
            before = np.cumsum([0, *map(len, words[:-1])])
            n_known, sums, rare, n_words = base(pa.concat_arrays(words), np.concatenate([b + k for b, k in zip(begin, before)]), hot, logs)
            rid += len(n_words)
            return pa.record_batch(
                [pa.array(rid - len(n_words) + np.arange(len(n_words))), pa.array(list(chain.from_iterable(ids)), pa.int64()), pa.array(n_words + 1), pa.array(n_known), pa.array(sums), pa.array(np.concatenate(score)), pa.array(np.concatenate(n)), rare],
                ["rid", "doc_id", "n_tokens", "hot_known", "hot_sum", "score", "n_bytes", "rare"],
            )

        for part in rows(batches, "doc_id", "text", limit_bytes=SCORE_AT_ONCE):
            data, ends = joined([t for _, t in part])
            held.append(([d for d, _ in part], *split(data, ends), np.diff(ends, prepend=0), model.score(data, ends)))
            if sum(len(words) for _, words, *_ in held) > WORDS_LOOKED_UP:
                yield flush()
        if held:
            yield flush()

    scored = materialize(docs.mapInArrow(run, out), f"{name}-scored")
    rest = scored.select("rid", F.explode("rare").alias("word")).join(vocabulary, "word").groupBy("rid").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_sum"))
    whole = scored.drop("rare").join(rest, "rid", "left")
    return whole.select(
        "doc_id", "n_tokens", (F.col("hot_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(figures.n)).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("more_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(figures.n + figures.v + 1)))).alias("base_score"), "score", "n_bytes", (-F.col("score") / (F.lit(float(np.log10(2))) * F.col("n_bytes"))).alias("bits_per_byte"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 7 <> 2")
    return scored.select("doc_id", (crc_text("doc_id") % 7 == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
