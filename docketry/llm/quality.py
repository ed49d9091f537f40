"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import id_remainder, written
from docketry.llm.stats import COUNTS, RATIOS, ratios, text_counts

FIT_ROWS = 20_000  # labelled rows learned from, at most about
BINS = 64
PAIR_BINS = 16
PAIRS = 6
ROUNDS = 200
PAIR_ROUNDS = 60
RATE = 0.1
DAMPING = 5.0  # added to a leaf's curvature
LEAVES = 3

FEATURES = [*RATIOS, "log_words", "log_lines", "log_longest"]


def features(rows: np.ndarray) -> np.ndarray:
    at = {c: k for k, c in enumerate(COUNTS)}
    logs = np.log1p(rows[:, [at["n_words"], at["n_lines"], at["longest_word"]]].astype(float))
    return np.hstack([ratios(rows), logs])


def _leaf(g, h):
    return g / (h + DAMPING)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A shallow tree on one feature: the step of every bin, from gradient and curvature sums per bin."""
    parts = [(0, len(g))]
    sg, sh = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def best(a: int, b: int) -> tuple[float, int]:
        cuts = np.arange(a + 1, b)
        if not len(cuts):
            return 0.0, a
        lg, lh = sg[cuts] - sg[a], sh[cuts] - sh[a]
        rg, rh = sg[b] - sg[cuts], sh[b] - sh[cuts]
        whole = (sg[b] - sg[a]) ** 2 / (sh[b] - sh[a] + DAMPING)
        gain = lg**2 / (lh + DAMPING) + rg**2 / (rh + DAMPING) - whole
        k = int(gain.argmax())
        return float(gain[k]), int(cuts[k])

    while len(parts) < leaves:
        gain, cut, k = max((*best(a, b), k) for k, (a, b) in enumerate(parts))
        if gain <= 0:
            break
        a, b = parts.pop(k)
        parts += [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(sg[b] - sg[a], sh[b] - sh[a])
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cross cut of a pair's grid: the step of every cell, and its gain."""
    def corners(x: np.ndarray) -> list[np.ndarray]:
        s = np.cumsum(np.cumsum(x, axis=0), axis=1)
        a = s[:-1, :-1]
        left, top, whole = s[:-1, -1:], s[-1:, :-1], s[-1, -1]
        return [a, left - a, top - a, whole - left - top + a]

    cg, ch = corners(g), corners(h)
    gain = sum(x**2 / (y + DAMPING) for x, y in zip(cg, ch, strict=True)) - g.sum() ** 2 / (h.sum() + DAMPING)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    steps = [_leaf(x[i, j], y[i, j]) for x, y in zip(cg, ch, strict=True)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = steps
    return out, float(gain[i, j])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class AdditiveModel:
    """Lookup tables per feature and per pair of features; a score is the sum of the entries."""

    def __init__(self, start: float, cuts: list[np.ndarray], tables: list[np.ndarray], pair_cuts: list[np.ndarray], pairs: list[tuple[int, int]], pair_tables: list[np.ndarray]):
        self.start, self.cuts, self.tables = start, cuts, tables
        self.pair_cuts, self.pairs, self.pair_tables = pair_cuts, pairs, pair_tables

    @staticmethod
    def _quantiles(x: np.ndarray, bins: int) -> list[np.ndarray]:
        shares = np.linspace(0, 1, bins + 1)[1:-1]
        return [np.unique(np.quantile(column, shares)) for column in x.T]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        """Boost each feature in turn, round after round; then the most useful pairs on what is left."""
        share = (y.sum() + 1) / (len(y) + 2)
        start = float(np.log(share / (1 - share)))
        cuts, pair_cuts = cls._quantiles(x, BINS), cls._quantiles(x, PAIR_BINS)
        bins = [np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T, strict=True)]
        tables = [np.zeros(len(c) + 1) for c in cuts]
        z = np.full(len(y), start)
        for _ in range(ROUNDS):
            for f, b in enumerate(bins):
                p = _sigmoid(z)
                n = len(tables[f])
                step = RATE * _tree(np.bincount(b, y - p, n), np.bincount(b, p * (1 - p), n))
                tables[f] += step
                z += step[b]
        coarse = [np.searchsorted(c, v, "right") for c, v in zip(pair_cuts, x.T, strict=True)]
        sizes = [len(c) + 1 for c in pair_cuts]

        def grid(i: int, j: int, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            cell, n, p = coarse[i] * sizes[j] + coarse[j], sizes[i] * sizes[j], _sigmoid(z)
            shape = (sizes[i], sizes[j])
            return cell, np.bincount(cell, y - p, n).reshape(shape), np.bincount(cell, p * (1 - p), n).reshape(shape)

        ranked = []
        for i in range(len(sizes)):
            for j in range(i + 1, len(sizes)):
                if sizes[i] > 1 and sizes[j] > 1:
                    ranked.append((_cross(*grid(i, j, z)[1:])[1], i, j))
        pairs = [(i, j) for _, i, j in sorted(ranked, reverse=True)[:PAIRS]]
        pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in pairs]
        for _ in range(PAIR_ROUNDS):
            for k, (i, j) in enumerate(pairs):
                cell, g, h = grid(i, j, z)
                step = RATE * _cross(g, h)[0]
                pair_tables[k] += step
                z += step.ravel()[cell]
        return cls(start, cuts, tables, pair_cuts, pairs, pair_tables)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for c, t, v in zip(self.cuts, self.tables, x.T, strict=True):
            z += t[np.searchsorted(c, v, "right")]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[np.searchsorted(self.pair_cuts[i], x[:, i], "right"), np.searchsorted(self.pair_cuts[j], x[:, j], "right")]
        return _sigmoid(z)


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held: int = 2,
    accept: float = 0.7, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """Quality of every whole text: ``doc_id, held_out, score, predicted``.

    Rows whose id's CRC-32 modulo ``folds`` is ``held`` are not learned from (a null id
    counts as the empty text and has no label). Statistics of the text are the only
    inputs. The model is fitted on about ``fit_rows`` of the other labelled rows, chosen
    by id hash; where labels repeat, the largest counts. Without any the score is a half.
    A null or empty text is scored like any other, rows with equal ids one by one; an
    empty table gives no rows; other columns are ignored.
    """
    counted = written(text_counts(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id"), "quality-counts")
    marked = (
        labels.where(labels[id_col].isNotNull() & labels[label_col].isNotNull())
        .groupBy(labels[id_col].cast("long").alias("doc_id")).agg(F.max(label_col).alias("y"))
    )
    usable = counted.join(marked.where(id_remainder(F.col("doc_id"), folds) != held), "doc_id")
    n = usable.count()
    scale = 1 << 20
    share = int(min(1.0, fit_rows / max(1, n)) * scale) + 1
    drawn = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(scale)) < share)
    rows = np.array([tuple(r) for r in drawn.orderBy("doc_id", *COUNTS).select("y", *COUNTS).collect()], float).reshape(-1, 1 + len(COUNTS))
    model = AdditiveModel.fit(features(rows[:, 1:]), rows[:, 0]) if len(rows) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.stack([np.asarray(batch.column(batch.schema.get_field_index(c))) for c in COUNTS], axis=1)
            score = model.score(features(found)) if model else np.full(len(found), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    scored = counted.select("doc_id", *COUNTS).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", (id_remainder(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted")
    )
