"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import Texts, id_remainder, texts

BUCKET_BITS = 16
ORDERS = (1, 2, 3)  # lengths of the n-grams
SMOOTHING = 0.1
FIT_DOCS = 10_000  # documents of a language that counts are taken from, about
UNKNOWN = "und"
PIECE = 1 << 19  # bytes of text numpy works on at once

_PLANE = 1 << 16


def _folds() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and letter tables of the basic plane, from the running Python's Unicode data."""
    fold, letter = np.arange(_PLANE, dtype=np.uint32), np.zeros(_PLANE, bool)
    for c in range(_PLANE):
        if 0xD800 <= c < 0xE000:
            continue
        low = chr(c).lower()
        fold[c], letter[c] = (ord(low) if len(low) == 1 else c), chr(c).isalpha()
    return np.minimum(fold, _PLANE - 1), letter


class Grams:
    """Buckets of the n-grams of some texts; anything but letters counts as one blank."""

    def __init__(self, bits: int = BUCKET_BITS, orders: tuple[int, ...] = ORDERS):
        self.bits, self.orders = bits, orders
        self.fold, self.letter = _folds()

    def __call__(self, part: Texts) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Letters per text, and for each order the buckets and the limits of each text in them."""
        points = np.frombuffer(part.data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
        if lead[-1] == len(points):
            offsets = lead[part.offsets]
        else:  # bytes that are not UTF-8 became one point each
            offsets = np.array([len(part.data[:o].tobytes().decode("utf-8", "surrogateescape")) for o in part.offsets])
        base = np.minimum(points, _PLANE - 1)
        letter = self.letter[base]
        far = np.flatnonzero(points >= _PLANE)
        if len(far):
            kinds, back = np.unique(points[far], return_inverse=True)
            letter[far] = np.array([chr(c).isalpha() for c in kinds.tolist()], bool)[back]
        codes = np.where(letter, np.where(points < _PLANE, self.fold[base], points), 32).astype(np.uint64)
        total = np.concatenate([[0], np.cumsum(letter)])
        out = []
        owner = np.repeat(np.arange(part.n), np.diff(offsets))
        for k in self.orders:
            n = max(0, len(codes) - k + 1)
            value = np.full(n, k, np.uint64)
            keep = np.ones(n, bool)
            blank = np.ones(n, bool)
            for j in range(k):
                value = (value * np.uint64(0x100000001B3)) ^ codes[j : j + n]
                blank &= codes[j : j + n] == 32
            if k > 1 and n:
                keep &= owner[:n] == owner[k - 1 : k - 1 + n]
            keep &= ~blank
            value = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
            places = np.flatnonzero(keep)
            out.append((value[places].astype(np.int64), np.searchsorted(places, offsets)))
        return total[offsets[1:]] - total[offsets[:-1]], out


class NaiveBayes:
    """Log probabilities of languages by bucket, as one matrix."""

    def __init__(self, languages: list[str], counts: np.ndarray, docs: np.ndarray, smoothing: float = SMOOTHING):
        """``counts`` has a row per language; ``docs`` are the documents of each, for the prior."""
        self.languages = languages
        smooth = counts + smoothing
        self.weights = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)
        self.prior = np.log(docs / docs.sum())

    def score(self, part: Texts, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """Best language of every text (-1 without letters) and its posterior probability."""
        letters, orders = grams(part)
        total = np.tile(self.prior, (part.n, 1)).astype(float)
        for buckets, limits in orders:
            for k in range(len(self.languages)):
                running = np.concatenate([[0.0], np.cumsum(self.weights[k][buckets], dtype=float)])
                total[:, k] += running[limits[1:]] - running[limits[:-1]]
        best = total.argmax(axis=1)
        top = total.max(axis=1, keepdims=True)
        posterior = 1.0 / np.exp(total - top).sum(axis=1)
        return np.where(letters > 0, best, -1), np.where(letters > 0, posterior, 0.0)


def fit(rows: DataFrame, text_col: str, label_col: str, key_col: str, fit_docs: int = FIT_DOCS, grams: Grams | None = None) -> NaiveBayes | None:
    """Learn from about ``fit_docs`` rows of every label, chosen by key hash; None without rows.

    Labels are as many as there are languages. Every task sends one sparse count a
    label and bucket; the sums are at most buckets times languages.
    """
    grams = grams or Grams()
    rows = rows.select(F.col(label_col).alias("label"), F.col(text_col).alias("t"), F.col(key_col).alias("key"))
    rows = rows.where(F.col("label").isNotNull() & F.col("t").isNotNull())
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    scale = 1 << 20
    drawn = F.lit(False)
    for name, n in sizes.items():
        share = int(min(1.0, fit_docs / n) * scale) + 1
        drawn |= (F.col("label") == F.lit(name)) & (F.pmod(F.xxhash64("key", F.lit(11)), F.lit(scale)) < share)
    place = {name: k for k, name in enumerate(languages)}
    buckets = 1 << grams.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(languages) * buckets, np.int64)
        for batch in batches:
            labels = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            for part in texts(batch, "t", PIECE):
                for found, limits in grams(part)[1]:
                    owner = np.repeat(labels[part.first : part.last], np.diff(limits))
                    seen += np.bincount(owner * buckets + found, minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["at", "n"])

    summed = rows.where(drawn).select("label", "t").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    got = summed.toArrow()
    counts = np.zeros(len(languages) * buckets)
    counts[got.column("at").to_numpy()] = got.column("n").to_numpy()
    docs = np.array([sizes[x] for x in languages], float)
    return NaiveBayes(languages, counts.reshape(len(languages), buckets), docs)


def languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", folds: int = 3, held: int = 1,
    fit_docs: int = FIT_DOCS,
) -> DataFrame:
    """Language of every whole text: ``doc_id, held_out, lang_pred, score``.

    Rows whose id's CRC-32 modulo ``folds`` is ``held`` are not learned from, nor are
    null texts and labels; a null id counts as the empty text. Only the text decides a
    prediction. ``score`` is the posterior of the predicted language; a text that is
    null or has no letter gets ``und`` and 0, and so does every text when there is
    nothing to learn from. Rows with equal ids are judged one by one, other columns are
    ignored, an empty table gives no rows. Letters are those of the executors' Python.
    """
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("t"), docs[label_col].alias("label"))
    plain = plain.withColumn("held_out", id_remainder(F.col("doc_id"), folds) == held)
    model = fit(plain.where(~F.col("held_out")), "t", "label", "doc_id", fit_docs)
    if model is None:
        return plain.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    held_model = plain.sparkSession.sparkContext.broadcast(model)  # buckets x languages floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, grams = held_model.value, Grams()
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for part in texts(batch, "t", PIECE):
                best, score = model.score(part, grams)
                own = batch.slice(part.first, part.n)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(2), pa.array(names[best], pa.string()), pa.array(score)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return plain.select("doc_id", "t", "held_out").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, least_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text has a language with at least that score, with their own columns.

    Judged beside the row itself: the model is learned as in ``languages`` and no row moves. Null and empty texts, and all
    without a letter, go. With nothing to learn from, no row in the learning fold with text and label, the
    language is unknown and every text with a letter stays. Repeated rows are judged alike; an empty table stays empty.
    """
    key = docs[id_col].cast("long")
    fold = id_remainder(key, 3) != 1
    model = fit(docs.where(fold).select(docs[text_col].alias("t"), docs[label_col].alias("l"), key.alias("k")), "t", "l", "k")
    if model is None:
        return docs.where(F.coalesce(F.regexp_like(docs[text_col], F.lit(r"\p{L}")), F.lit(False)))
    held_model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, grams = held_model.value, Grams()
        for batch in batches:
            for part in texts(batch, text_col, PIECE):
                best, score = model.score(part, grams)
                yield batch.slice(part.first, part.n).filter(pa.array((best >= 0) & (score >= least_score)))

    return docs.mapInArrow(run, docs.schema)
