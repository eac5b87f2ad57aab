"""Statistics of whole documents, for the quality operators."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Hashes, bounded_sample, rows, window_hashes

#: The symbols that the base rules count.
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the models see, all of it shares and means, so that they don't depend on a document's length.
FEATURES = (
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share", "bang_share", "bar_share",
    "distinct_share", "top_word_share", "long_word_share", "short_word_share", "line_words", "end_punct_share", "wide_share", "capital_share", "lone_symbol_share", "control_share",
)


def _of(chars: bytes) -> np.ndarray:
    return np.frombuffer(chars, np.uint8)


_UPPER, _LOWER, _DIGIT = _of(bytes(range(65, 91))), _of(bytes(range(97, 123))), _of(b"0123456789")
_SYMBOL, _PUNCT, _SPACE = _of(SYMBOLS), _of(b".,;:!?\"'()-"), _of(b"\x20\t\n\x0b\x0c\r")
_CONTROL = _of(bytes([*range(9), *range(14, 32), 127]))


def describe(text: str | None, memo: Hashes) -> tuple[list[int], list[float]]:
    """The base counts and the features of one whole text; a null text is empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    hist = np.bincount(_of(data), minlength=256)
    points = len(data) - int(hist[0x80:0xC0].sum())
    chars = points - int(hist[_SPACE].sum())
    symbols = int(hist[_SYMBOL].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = 0
    h = memo.array(words)
    if n > REPEAT_WINDOW:
        w = window_hashes(h, REPEAT_WINDOW, 0x9E3779B97F4A7C15)
        order = np.argsort(w, kind="stable")
        same = w[order[1:]] == w[order[:-1]]
        if same.any():
            maybe = np.zeros(len(w), bool)
            maybe[order[1:][same]] = True
            maybe[order[:-1][same]] = True
            # hashes only choose which windows are compared, by their words
            places = np.flatnonzero(maybe).tolist()
            shown = [b" ".join(words[i : i + REPEAT_WINDOW]) for i in places]
            often = Counter(shown)
            twice = np.zeros(len(w), bool)
            twice[[i for i, x in zip(places, shown) if often[x] > 1]] = True
            edge = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            edge[at] += 1
            edge[at + REPEAT_WINDOW] -= 1
            repeats = int((np.cumsum(edge[:-1]) > 0).sum())
    one, c = max(n, 1), max(chars, 1)
    sizes = np.fromiter(map(len, words), np.int64, n)
    _, counts = np.unique(h, return_counts=True)
    letters = max(int(hist[_UPPER].sum() + hist[_LOWER].sum()), 1)
    firsts = _of(b"".join(x[:1] for x in words))
    lasts = _of(b"".join(x[-1:] for x in words))
    lone = sum(1 for x in words if len(x) == 1 and not x.isalnum() and x < b"\x80")
    f = [
        np.log1p(n), min(chars / one, 40.0), symbols / c, dup_lines / max(len(lines), 1), repeats / one, hist[_UPPER].sum() / letters, hist[_DIGIT].sum() / c, hist[_PUNCT].sum() / c, hist[33] / one, hist[124] / one,
        len(counts) / one**0.9, counts.max(initial=0) / one, (sizes > 14).sum() / one, (sizes <= 3).sum() / one, min(np.log1p(n / max(len(lines), 1)), 8.0), np.isin(lasts, _PUNCT).sum() / one, hist[0x80:].sum() / max(len(data), 1), np.isin(firsts, _UPPER).sum() / one, lone / one, hist[_CONTROL].sum() / max(len(data), 1),
    ]
    return [n, chars, symbols, dup_lines, repeats], [float(x) for x in f]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts (long) and features (array<double>) of every row of `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Hashes()
        for part in rows(batches, "doc_id", "text"):
            found = [describe(text, memo) for _, text in part]
            yield pa.record_batch([pa.array([r[0] for r in part], pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*(b for b, _ in found))), pa.array([f for _, f in found], pa.list_(pa.float64()))], ["doc_id", *BASE, "features"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in BASE)}, features array<double>")


def labelled_sample(stats: DataFrame, labels: DataFrame, where: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (quality, 0 or 1) of about `most` labelled documents, those of least hash; `where` is a condition on doc_id.
    Null labels and labels of no document are ignored; of repeated labels the least counts, of repeated documents the row of least features."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(where).groupBy("doc_id").agg(F.min("quality").alias("y"))
    drawn = bounded_sample(known, "doc_id", most)
    one = stats.select("doc_id", "features").join(drawn, "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.min("y").alias("y"))
    got = one.toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["features"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    return x, got["y"].to_numpy(np.float64)
