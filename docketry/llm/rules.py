"""Quality rules: base limits, then isolation forests on rule statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import written
from docketry.llm.stats import COUNTS, text_counts

TREES = 100
TREE_ROWS = 256
FIT_ROWS = 20_000  # labelled rows the forest is drawn from, at most about
GOOD_LOST = 0.001  # share of rows labelled good that the threshold may reject

# Statistics the forests read: a count, what it is a share of, and how many of the latter a text is given on top
# at the sample's mean, so that short texts do not look odd by chance. A forest per group: most texts have no repeat
# and no digit, and in one forest the few that do would hide all else.
GROUPS = [
    [
        ("word_chars", "n_words", 100), ("n_symbols", "n_words", 100), ("n_upper", "n_chars_all", 600), ("n_marks", "n_words", 100),
        ("n_bare", "n_words", 100), ("n_distinct", "n_words", 100),
    ],
    [("n_dup_lines", "n_lines", 10), ("n_repeat_words", "n_words", 100)],
    [("n_digits", "n_chars_all", 600)],
]
SHARES = [x for group in GROUPS for x in group]

# The base rules.
LEAST_WORDS = 10
MOST_REPEAT_PERCENT = 20


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` rows."""
    n = np.asarray(n, float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2 * (np.log(n[big] - 1) + np.euler_gamma) - 2 * (n[big] - 1) / n[big]
    return out


def sample_means(rows: np.ndarray) -> np.ndarray:
    """Mean of every share over a sample of ``COUNTS`` rows."""
    at = {c: k for k, c in enumerate(COUNTS)}
    return np.array([rows[:, at[a]].sum() / max(1.0, rows[:, at[b]].sum()) for a, b, _ in SHARES])


def shares(rows: np.ndarray, means: np.ndarray) -> np.ndarray:
    """``SHARES`` of ``COUNTS`` rows, drawn towards the means."""
    at = {c: k for k, c in enumerate(COUNTS)}
    rows = rows.astype(float)
    return np.stack([(rows[:, at[a]] + n * m) / (rows[:, at[b]] + n) for (a, b, n), m in zip(SHARES, means, strict=True)], axis=1)


class IsolationForest:
    """Random splits on random features; rows that few splits set apart are anomalous."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], rows: int):
        self.trees, self.rows = trees, rows

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 5) -> IsolationForest:
        rng = np.random.default_rng(seed)
        rows = min(rows, len(x))
        depth = max(1, int(np.ceil(np.log2(max(2, rows)))))
        return cls([cls._grow(x[rng.choice(len(x), rows, replace=False)], depth, rng) for _ in range(trees)], rows)

    @staticmethod
    def _grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, limit, left, right, length = [], [], [], [], []

        def node(rows: np.ndarray, level: int) -> int:
            k = len(feature)
            for column, value in zip((feature, limit, left, right, length), (-1, 0.0, k, k, 0.0), strict=True):
                column.append(value)
            low, high = rows.min(axis=0), rows.max(axis=0)
            free = np.flatnonzero(high > low)
            if level >= depth or not len(free):
                length[k] = level + float(_average_path(np.array([len(rows)]))[0])
                return k
            f = int(rng.choice(free))
            at = float(rng.uniform(low[f], high[f]))
            goes = rows[:, f] < at
            if not goes.any() or goes.all():  # the draw fell on an end
                at, goes = float(high[f]), rows[:, f] < high[f]
            feature[k], limit[k] = f, at
            left[k] = node(rows[goes], level + 1)
            right[k] = node(rows[~goes], level + 1)
            return k

        node(x, 0)
        return tuple(np.array(v) for v in (feature, limit, left, right, length))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly from 0 to 1; about a half for rows like all others."""
        total, every = np.zeros(len(x)), np.arange(len(x))
        for feature, limit, left, right, length in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                if (f < 0).all():
                    break
                at = np.where(f < 0, at, np.where(x[every, f] < limit[at], left[at], right[at]))
            total += length[at]
        usual = float(_average_path(np.array([self.rows]))[0]) or 1.0
        return 2.0 ** (-total / (len(self.trees) * usual))


class Forests:
    """A forest per group of shares, each on a scale on which its limit is a half; a row's anomaly is its largest."""

    def __init__(self, sample: np.ndarray, good: np.ndarray, lost: float = GOOD_LOST):
        """From ``COUNTS`` rows; a limit is the score that all but the group's part of ``lost`` of the good ones stay below."""
        self.means = sample_means(sample)
        x, self.groups, at = shares(sample, self.means), [], 0
        for group in GROUPS:
            own = slice(at, at := at + len(group))
            forest = IsolationForest.fit(x[:, own])
            score = forest.score(x[good][:, own])
            limit = float(np.quantile(score, 1 - lost / len(GROUPS), method="higher")) if len(score) else 0.5
            self.groups.append((own, forest, np.log(0.5) / np.log(np.clip(limit, 0.01, 0.99))))

    def score(self, rows: np.ndarray) -> np.ndarray:
        x = shares(rows, self.means)
        return np.max([forest.score(x[:, own]) ** power for own, forest, power in self.groups], axis=0)


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))


def rule_verdicts(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS,
    good_lost: float = GOOD_LOST,
) -> DataFrame:
    """Rule statistics of every text, the base verdict, the anomaly and the final verdict.

    Returns ``doc_id``, the counts, ``base_failed, anomaly, threshold, kept``. The
    forests are drawn from about ``fit_rows`` labelled rows that pass the base rules,
    chosen by id hash; the threshold is the anomaly that all but ``good_lost`` of *all*
    rows labelled good stay below. Without such rows nothing is anomalous and
    ``threshold`` is null. A null text counts as empty and fails the base rules; rows
    with equal ids share their label (the largest where they differ) and are judged one
    by one; an empty table gives no rows; other columns are ignored.
    """
    counted = written(text_counts(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id"), "counts")
    marked = labels.where(labels[id_col].isNotNull() & labels["quality"].isNotNull()).groupBy(labels[id_col].cast("long").alias("doc_id"))
    usable = counted.where(~base_failed()).join(marked.agg(F.max("quality").alias("quality")), "doc_id")
    usable = written(usable, "labelled")
    share = min(1.0, fit_rows / max(1, usable.count()))
    drawn = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = np.array([tuple(r) for r in drawn.orderBy("doc_id", *COUNTS).select(*COUNTS, "quality").collect()], float).reshape(-1, len(COUNTS) + 1)
    forest = Forests(sample[:, :-1], sample[:, -1] == 1, good_lost) if len(sample) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(batch.column(batch.schema.get_field_index(c))) for c in COUNTS], axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(forest.score(rows))], [*batch.schema.names, "anomaly"]
            )

    if forest is None:
        return counted.select(
            "doc_id", *COUNTS, base_failed().alias("base_failed"), F.lit(None).cast("double").alias("anomaly"),
            F.lit(None).cast("double").alias("threshold"), (~base_failed()).alias("kept"),
        )
    kind = ", ".join(f"{n} {t}" for n, t in counted.dtypes)
    good = usable.where("quality = 1").select(*counted.columns).mapInArrow(run, f"{kind}, anomaly double")
    threshold = good.agg(F.percentile_approx("anomaly", 1 - good_lost, 100_000)).first()[0]
    limit = F.lit(threshold).cast("double")
    normal = F.coalesce(F.col("anomaly") <= limit, F.lit(True))
    return counted.mapInArrow(run, f"{kind}, anomaly double").select(
        "doc_id", *COUNTS, base_failed().alias("base_failed"), "anomaly", limit.alias("threshold"),
        (~base_failed() & normal).alias("kept"),
    )

