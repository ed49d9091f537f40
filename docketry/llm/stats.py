"""Counts per text that the rule and quality operators read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docketry.llm.common import Texts, texts

# The symbols of the rules, and the marks that end or join phrases.
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?"

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits",
    "n_marks", "n_bare", "n_chars_all", "longest_word",
]
REPEAT_WINDOW = 5


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _MARK, _DIGIT = _table(SYMBOLS), _table(MARKS), _table("0123456789")
_UPPER, _LOWER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz")


def repeated_words(part: Texts, codes: np.ndarray, size: int = REPEAT_WINDOW) -> np.ndarray:
    """Per text, its words inside a window of ``size`` words that the text has twice or more.

    ``codes`` numbers the words without collisions; windows are numbered by pairing, so nothing is hashed.
    """
    n = len(codes)
    if n < size:
        return np.zeros(part.n, np.int64)
    window, width, numbers = codes, 1, int(codes.max()) + 1
    while width < size:
        step = min(width, size - width)
        tail = window if step == width else None
        if tail is None:  # a shorter tail: pair with single words
            step, tail, tail_numbers = 1, codes, int(codes.max()) + 1
        else:
            tail_numbers = numbers
        pairs = window[: len(window) - step] if width == step else window[: n - width - step + 1]
        follow = tail[width : width + len(pairs)]
        pairs = pairs[: len(follow)]
        found, window = np.unique(pairs * np.int64(tail_numbers) + follow, return_inverse=True)
        numbers, width = len(found), width + step
    owner = np.repeat(np.arange(part.n), np.diff(part.bounds))
    starts = np.flatnonzero(owner[: len(window)] == owner[size - 1 : size - 1 + len(window)])
    if not len(starts):
        return np.zeros(part.n, np.int64)
    _, back, times = np.unique(window[starts] * np.int64(part.n) + owner[starts], return_inverse=True, return_counts=True)
    hit = starts[times[back] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + size, -1)
    return part.word_sums(np.cumsum(edge[:-1]) > 0)


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def counts(part: Texts) -> np.ndarray:
    """One row of ``COUNTS`` per text."""
    part.words()
    data, whole = part.data, part.data.tobytes()
    lead = (data & 0xC0) != 0x80  # first byte of a code point
    marks = np.zeros(len(data) + 1, np.int64)
    np.add.at(marks, part.starts, 1)
    np.add.at(marks, part.ends, -1)
    inside = np.cumsum(marks[:-1]) > 0
    numbers: dict[bytes, int] = {}
    words = [whole[a:b] for a, b in zip(part.starts.tolist(), part.ends.tolist(), strict=True)]
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(part.n, dtype=np.int64), np.diff(part.bounds))
    distinct = np.unique(owner * (len(numbers) + 1) + codes) // (len(numbers) + 1)
    letters = np.concatenate([[0], np.cumsum(_UPPER[data] | _LOWER[data] | (data > 127), dtype=np.int64)])
    bare = letters[part.ends] == letters[part.starts]
    lengths = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    lengths = lengths[part.ends] - lengths[part.starts]
    longest = np.zeros(part.n, np.int64)
    np.maximum.at(longest, owner, lengths)
    lines = np.array([duplicate_lines(part.text(k)) for k in range(part.n)], np.int64).reshape(part.n, 2)
    return np.stack(
        [
            np.diff(part.bounds), part.sums(lead & inside), part.sums(_SYMBOL[data]), lines[:, 1],
            repeated_words(part, codes), lines[:, 0], np.bincount(distinct, minlength=part.n), part.sums(_UPPER[data]),
            part.sums(_DIGIT[data]), part.sums(_MARK[data]), part.word_sums(bare), part.sums(lead), longest,
        ],
        axis=1,
    )


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``COUNTS`` of every whole text; a null text counts as empty.

    Returns the id and one long column per count, one row per input row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts(batch, "t"):
                rows = counts(part)
                ids = batch.column(0).slice(part.first, part.n)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], ["i", *COUNTS])

    plain = docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].alias("t"))
    return plain.mapInArrow(run, "i long, " + ", ".join(f"{c} long" for c in COUNTS)).withColumnRenamed("i", id_col)


def ratios(rows: np.ndarray) -> np.ndarray:
    """Length-free statistics from ``COUNTS`` rows; texts without words get zeros."""
    c = dict(zip(COUNTS, rows.T.astype(float), strict=True))
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_chars_all"], 1), np.maximum(c["n_lines"], 1)
    return np.stack(
        [
            c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
            c["n_distinct"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / words, c["n_bare"] / words,
        ],
        axis=1,
    )


RATIOS = ["word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "marks", "bare"]
