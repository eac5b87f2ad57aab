"""Token counts, padded token arrays and answer-only labels. The tokenizer is a parameter: any function from text to ids."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Special tokens stay whole; otherwise runs of letters and digits, and single other characters. Its counts are its own, not any model's.
_PIECES = re.compile(r"<\|[^|<>]+\|>|\w+|[^\w\s]")
IGNORE = -100
VOCABULARY = 1 << 20


def default_tokenizer(text: str) -> list[int]:
    """A documented stand-in: hashed ids of the pieces above, from 1."""
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % VOCABULARY + 1 for p in _PIECES.findall(text)]


class _Ids(dict):
    """The stand-in's ids by piece, remembered; it empties itself before it grows without bound."""

    def __missing__(self, piece: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[piece] = found = zlib.crc32(piece.encode("utf-8", "surrogatepass")) % VOCABULARY + 1
        return found


_ids = _Ids()
Tokenizer = Callable[[str], list[int]]
_loaded: dict = {}


def encoded(tokenizer: Tokenizer, texts: list[str]) -> list[list[int]]:
    """The ids of many texts: a tokenizer that has a `batch` takes them all at once."""
    if tokenizer is default_tokenizer:
        return [list(map(_ids.__getitem__, _PIECES.findall(t))) for t in texts]
    batch = getattr(tokenizer, "batch", None)
    return batch(texts) if batch else [tokenizer(t) for t in texts]


def local_or_name(folder: str | None, name: str) -> str:
    """A tokenizer's local folder, if it is there, else its name."""
    return folder if folder and os.path.isdir(folder) else name


class FileTokenizer:
    """The tokenizer of a file that every executor can open; a worker loads it once. Nothing is added to a text's ids, unless `special` asks for it."""

    def __init__(self, path: str, special: bool = False):
        self.path, self.special = path, special

    def _file(self):
        if self.path not in _loaded:
            from tokenizers import Tokenizer as File

            _loaded[self.path] = File.from_file(self.path)
        return _loaded[self.path]

    def __call__(self, text: str) -> list[int]:
        return self._file().encode(text, add_special_tokens=self.special).ids

    def batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._file().encode_batch_fast(texts, add_special_tokens=self.special)]


def file_tokenizer(path: str, *, special: bool = False) -> Tokenizer:
    return FileTokenizer(path, special)


def over_batches(f: Callable[..., pa.Array], returns: str) -> Callable[..., Column]:
    """An Arrow UDF over whole columns of a batch, made where it is used."""

    def call(*columns: Column) -> Column:
        return F.arrow_udf(f, returns)(*columns)

    return call


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def token_length(text: Column, tokenizer: Tokenizer = default_tokenizer) -> Column:
    """The number of tokens of a whole text, nothing added; 0 for null."""

    def run(t: pa.Array) -> pa.Array:
        return pa.array([len(x) for x in encoded(tokenizer, texts_of(t))], pa.int32())

    return over_batches(run, "int")(text)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def tokenized(text: Column, length: int, pad: int, tokenizer: Tokenizer = default_tokenizer) -> Column:
    """struct<input_ids, attention_mask>, cut and padded to `length`."""

    def run(t: pa.Array) -> pa.Array:
        cut = [np.asarray(x[:length], np.int32) for x in encoded(tokenizer, texts_of(t))]
        used = np.fromiter(map(len, cut), np.int64, len(cut))
        mask = np.arange(length) < used[:, None]
        ids = np.full(mask.shape, pad, np.int32)
        ids[mask] = np.concatenate(cut) if cut else []
        edges = np.arange(len(cut) + 1) * length
        return pa.StructArray.from_arrays([lists(ids.ravel(), edges), lists(mask.ravel().astype(np.int32), edges)], ["input_ids", "attention_mask"])

    return over_batches(run, "input_ids array<int>, attention_mask array<int>")(text)


def special_ids(encode: Tokenizer, header: str, end: str, pad: int | None = None, eos: int | None = None) -> dict[str, list[int] | int]:
    """Ids of the answer's header and of the end mark, and the id that pads: without one of its own the one that ends a sequence."""
    if (fill := eos if pad is None else pad) is None:
        raise ValueError("neither a padding id nor one that ends a sequence")
    return {"head": encode(header), "end": encode(end), "pad": fill}


def find_pattern(ids: Column, pattern: list[int], start: Column | int = 0) -> Column:
    """The first place from `start` on where the pattern stands; -1 if none, or for an empty pattern."""
    m, start = len(pattern), F.lit(start) if isinstance(start, int) else start
    if not m:
        return F.lit(-1)
    want = F.array(*map(F.lit, pattern))
    last = F.size(ids) - m
    places = F.filter(F.sequence(start, F.greatest(last, start)), lambda i: (i <= last) & (F.slice(ids, i + 1, m) == want))
    return F.coalesce(F.get(places, F.lit(0)), F.lit(-1))


def places_of(pattern: list[int], ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Where a pattern stands in rows that lie one behind the other, never over a border; nowhere, if it is empty."""
    m = len(pattern)
    if not m or len(ids) < m:
        return np.empty(0, np.int64)
    hit = row[m - 1 :] == row[: len(row) - m + 1]
    for j, want in enumerate(pattern):
        hit &= ids[j : len(ids) - m + 1 + j] == want
    return np.flatnonzero(hit)


def labels_of(ids: np.ndarray, offsets: np.ndarray, head: list[int], end: list[int]) -> np.ndarray:
    """Ids behind each header up to and with the end pattern, or to the row's end, IGNORE elsewhere, for rows one behind the other."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    heads, ends = places_of(head, ids, row), places_of(end, ids, row)
    starts = heads + len(head)
    # the end that each header would have, all of them at once: the next end pattern, if it comes in the same row
    after = np.searchsorted(ends, starts)
    border = offsets[row[heads] + 1] if len(heads) else np.empty(0, np.int64)
    stop = border.copy()
    if len(ends):
        nearest = ends[np.minimum(after, len(ends) - 1)]
        stop = np.where((after < len(ends)) & (nearest < border), nearest + len(end), border)
    out, done = np.full(len(ids), IGNORE, ids.dtype), 0
    for at, begin, until in zip(heads.tolist(), starts.tolist(), stop.tolist()):  # headers, not positions
        if at >= done:
            out[begin:until] = ids[begin:until]
            done = until
    return out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a list column, one row behind the other, and the rows' borders; null rows are empty, null numbers -1."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    values = pc.fill_null(column.drop_null().flatten(), -1)
    return np.asarray(values).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def masked(labels: np.ndarray, offsets: np.ndarray, shown: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The labels with IGNORE where a row's mask is 0."""
    n, w = np.diff(offsets), np.diff(edges)
    if (n == w).all():
        labels[shown == 0] = IGNORE
    else:
        for k in np.flatnonzero(np.minimum(n, w)):
            common = min(n[k], w[k])
            labels[offsets[k] : offsets[k] + common][shown[edges[k] : edges[k] + common] == 0] = IGNORE
    return labels


def _labels(ids: list | None, mask: list | None, head: list[int], end: list[int]) -> list[int]:
    """The labels of one row."""
    one = lambda x: (np.array(x or [], np.int64), np.array([0, len(x or [])]))
    values, offsets = one(ids)
    return masked(labels_of(values, offsets, head, end), offsets, *one(mask)).tolist()


def answer_labels(ids: Column, mask: Column, head: list[int], end: list[int]) -> Column:
    """array<int>: the ids behind each assistant header up to and with the end pattern (to the array's end if there is none),
    IGNORE elsewhere and where the mask is 0. An empty header pattern labels nothing; null arrays give an empty one, a mask that is null or
    shorter hides nothing there."""

    def run(i: pa.Array, m: pa.Array) -> pa.Array:
        values, offsets = flat(i)
        return lists(masked(labels_of(values, offsets, head, end), offsets, *flat(m)).astype(np.int32), offsets)

    return over_batches(run, "array<int>")(ids, mask)


def add_tensors(df: DataFrame, text: str, *, length: int, pad: int, head: list[int], end: list[int], tokenizer: Tokenizer = default_tokenizer, keep: tuple[str, ...] = ()) -> DataFrame:
    """input_ids, attention_mask and labels of every row, and nothing else but the columns in `keep`."""
    both = df.select(*keep, tokenized(F.col(text), length, pad, tokenizer).alias("t")).select(*keep, "t.*")
    return both.withColumn("labels", answer_labels(F.col("input_ids"), F.col("attention_mask"), head, end))
