"""Product codes of vectors: per part a codebook, refined by k-means over anchors-hierarchy metric trees."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import written

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
BLOCK_ROWS = 4096  # rows whose parts share a tree
LEAF_ROWS = 64  # points of a ball that is not divided further
LARGEST = 1 << 24  # of a scaled component; beyond it the sums of squares would leave 64 bits


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def scaled_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, x`` of the rows with a finite vector; ``x`` holds ``floor(scale * component)``."""
    return df.where(finite(df[vector_col])).select(
        df[id_col].alias("vec_id"), df[label_col].alias("label"),
        F.transform(df[vector_col], lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"),
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; short rows end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"a scaled component is beyond {LARGEST}")
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


class PartTree:
    """Balls over one part of a block of vectors, each with the sum and count of its points.

    A ball owns the points ``order[start:end]``; ``left`` and ``right`` are its halves, -1 in a leaf.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, start: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray):
        self.points, self.order, self.start, self.end, self.left, self.right = points, order, start, end, left, right
        inside = points[order]
        running = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(inside, axis=0)])
        self.sums, self.counts = running[end] - running[start], end - start
        self.pivot = self.sums / np.maximum(self.counts, 1)[:, None]
        radius = [np.sqrt(((inside[a:b] - p) ** 2).sum(axis=1).max(initial=0)) for a, b, p in zip(start, end, self.pivot, strict=True)]
        self.radius = np.array(radius) * (1 + 1e-9)

    FIELDS = ("points", "order", "start", "end", "left", "right")

    @classmethod
    def grow(cls, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> PartTree:
        """Middle-out: about the root of the number of points as anchors, balls joined upwards, and divided likewise below."""
        exact = points.astype(float)
        children: list[tuple[int, int] | np.ndarray] = []

        def add(node: tuple[int, int] | np.ndarray) -> int:
            children.append(node)
            return len(children) - 1

        def divide(rows: np.ndarray) -> int:
            if len(rows) <= leaf_rows:
                return add(rows)
            owner, anchors = anchor_balls(exact[rows], int(np.ceil(np.sqrt(len(rows)))))
            if len(anchors) == 1:
                return add(rows)  # all points are equal
            balls = [rows[owner == k] for k in range(len(anchors))]
            return join([divide(b) for b in balls], np.array([exact[b].mean(axis=0) for b in balls]), [len(b) for b in balls], exact, balls)

        def join(nodes: list[int], pivots: np.ndarray, counts: list[int], exact: np.ndarray, balls: list[np.ndarray]) -> int:
            """Join the two balls that fit into the smallest ball until one is left."""
            n = np.array(counts, float)
            r = np.array([np.sqrt(((exact[b] - p) ** 2).sum(axis=1).max()) for b, p in zip(balls, pivots, strict=True)])
            apart = np.sqrt(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2))
            size = apart + r[:, None] + r[None]
            np.fill_diagonal(size, np.inf)
            nodes = list(nodes)
            for _ in range(len(nodes) - 1):
                a, b = divmod(int(size.argmin()), len(nodes))
                nodes[a] = add((nodes[a], nodes[b]))
                centre = (pivots[a] * n[a] + pivots[b] * n[b]) / (n[a] + n[b])
                r[a] = max(np.sqrt(((pivots[k] - centre) ** 2).sum()) + r[k] for k in (a, b))
                pivots[a], n[a] = centre, n[a] + n[b]
                row = np.sqrt(((pivots - centre) ** 2).sum(axis=1)) + r + r[a]
                row[np.isinf(size[a])] = np.inf
                size[a] = size[:, a] = row
                size[b] = size[:, b] = np.inf
                size[a, b] = size[b, a] = np.inf
            return nodes[a] if len(nodes) > 1 else nodes[0]

        root = divide(np.arange(len(points)))
        start, end, left, right, order = [], [], [], [], []
        stack, at = [(root, -1, 0)], 0
        while stack:  # depth first, so that every ball's points are one stretch
            node, parent, side = stack.pop()
            if node < 0:  # all below this ball is placed
                end[parent] = at
                continue
            k = len(start)
            if parent >= 0:
                (left if side == 0 else right)[parent] = k
            start.append(at)
            end.append(at)
            left.append(-1)
            right.append(-1)
            held = children[node]
            if isinstance(held, tuple):
                stack += [(-1, k, 0), (held[1], k, 1), (held[0], k, 0)]
            else:
                order.append(held)
                at += len(held)
                end[k] = at
        return cls(points, np.concatenate(order), *(np.array(x, np.int64) for x in (start, end, left, right)))

    def owned(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Balls and the one entry nearest to all their points, then points of open leaves and the nearest entry of each.

        A ball inherits its parent's list of entries and strikes those that are farther than another entry from every point
        of it; the last one left owns the ball whole. Ties go to the first entry.
        """
        m = len(entries)
        exact = entries.astype(float)
        square = (exact**2).sum(axis=1)
        apart = np.sqrt(((exact[:, None] - exact[None]) ** 2).sum(axis=2))
        first = np.zeros(m, bool)
        first[np.unique(entries, axis=0, return_index=True)[1]] = True  # of equal entries only the first can win
        slack = 1e-10 * (square.max() + (self.pivot**2).sum(axis=1).max() + 1)
        balls, whole, open_leaves, lists = [], [], [], []
        active, mask = np.zeros(1, np.int64), first[None].copy()
        while len(active):
            score = square - 2 * self.pivot[active] @ exact.T
            best = np.where(mask, score, np.inf).argmin(axis=1)
            gap = score - score[np.arange(len(active)), best][:, None]
            mask &= gap <= 2 * self.radius[active][:, None] * apart[best] + slack
            alone = mask.sum(axis=1) == 1
            balls.append(active[alone])
            whole.append(best[alone])
            leaf = ~alone & (self.left[active] < 0)
            open_leaves.append(active[leaf])
            lists.append(mask[leaf])
            inner = ~alone & ~leaf
            active = np.concatenate([self.left[active[inner]], self.right[active[inner]]])
            mask = np.concatenate([mask[inner], mask[inner]])
        leaves, mask = np.concatenate(open_leaves), np.concatenate(lists)
        points, chosen = self._nearest(leaves, mask, entries)
        return np.concatenate(balls), np.concatenate(whole), points, chosen

    def _nearest(self, leaves: np.ndarray, mask: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(leaves):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = self.counts[leaves]
        points = self.order[np.arange(size.sum()) + np.repeat(self.start[leaves] - (np.cumsum(size) - size), size)]
        left, candidates = np.nonzero(mask)
        per_leaf = np.bincount(left, minlength=len(leaves))
        first = np.cumsum(per_leaf) - per_leaf
        many = np.repeat(per_leaf, size)
        starts = np.cumsum(many) - many
        at = candidates[np.arange(many.sum()) + np.repeat(np.repeat(first, size) - starts, many)]
        distance = ((self.points[np.repeat(points, many)] - entries[at]) ** 2).sum(axis=1)
        least = np.flatnonzero(distance == np.repeat(np.minimum.reduceat(distance, starts), many))
        return points, at[least[np.searchsorted(least, starts)]]

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and count of the points nearest to each entry; whole balls add what they have cached."""
        balls, whole, points, chosen = self.owned(entries)
        sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
        np.add.at(sums, whole, self.sums[balls])
        np.add.at(counts, whole, self.counts[balls])
        np.add.at(sums, chosen, self.points[points])
        np.add.at(counts, chosen, 1)
        return sums, counts

    def nearest(self, entries: np.ndarray) -> np.ndarray:
        """Nearest entry of every point, in the order of the block's rows."""
        balls, whole, points, chosen = self.owned(entries)
        out = np.zeros(len(self.points), np.int64)
        size = self.counts[balls]
        out[self.order[np.arange(size.sum()) + np.repeat(self.start[balls] - (np.cumsum(size) - size), size)]] = np.repeat(whole, size)
        out[points] = chosen
        return out


def anchor_balls(points: np.ndarray, most: int) -> tuple[np.ndarray, list[int]]:
    """Up to ``most`` anchors and every point's nearest one.

    The next anchor is the point farthest from its own in the widest ball. It looks only
    at points more than half as far from their anchor as the two anchors are apart; no other can be nearer to it.
    """
    anchors = [0]
    far = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    owner = np.zeros(len(points), np.int64)
    while len(anchors) < most:
        new = int(far.argmax())
        if far[new] == 0:
            break
        between = np.sqrt(((points[anchors] - points[new]) ** 2).sum(axis=1))
        seen = np.flatnonzero(far > between[owner] / 2 - 1e-9)
        distance = np.sqrt(((points[seen] - points[new]) ** 2).sum(axis=1))
        nearer = distance < far[seen]
        owner[seen[nearer]] = len(anchors)
        far[seen[nearer]] = distance[nearer]
        anchors.append(new)
    return owner, anchors


def part_trees(vectors: DataFrame, width: int, parts: int = PARTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``ids, labels, trees``: blocks of rows of ``scaled_vectors`` with the trees of all their parts, nothing shuffled."""
    each = width // parts
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def block(rows: pa.Table) -> pa.RecordBatch:
        x = _matrix(rows.column("x").combine_chunks(), width)
        held = io.BytesIO()
        trees = [PartTree.grow(np.ascontiguousarray(x[:, p * each : (p + 1) * each])) for p in range(parts)]
        np.savez(held, **{f"{f}{p}": getattr(t, f) for p, t in enumerate(trees) for f in PartTree.FIELDS})
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), rows.column(c).combine_chunks()) for c in ("vec_id", "label")]
        return pa.RecordBatch.from_arrays([*lists, pa.array([held.getvalue()], pa.binary())], ["ids", "labels", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, block_rows - n))
                n += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if n == block_rows:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held))

    return vectors.mapInArrow(run, f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, trees binary")


def _read(raw: bytes, parts: int) -> list[PartTree]:
    with np.load(io.BytesIO(raw)) as held:
        return [PartTree(*(held[f"{f}{p}"] for f in PartTree.FIELDS)) for p in range(parts)]


def refined(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round of k-means: every entry moves to the floored mean of its points, one without points stays.

    A task sends at most one sum a component of the codebooks.
    """
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for raw in batch.column(0):
                for p, tree in enumerate(_read(raw.as_py(), parts)):
                    s, c = tree.totals(books[p])
                    sums[p] += s
                    counts[p] += c
        for p in range(parts):
            entry, place = np.indices(sums[p].shape).reshape(2, -1)
            used = counts[p][entry] > 0
            columns = [np.full(used.sum(), p), entry[used], place[used], sums[p].reshape(-1)[used], counts[p][entry[used]]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "place", "total", "n"])

    sent = trees.select("trees").mapInArrow(run, "part long, entry long, place long, total long, n long")
    out = [b.copy() for b in books]
    for r in sent.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r.part][r.entry, r.place] = r.total // r.n
    return out


def encoded(trees: DataFrame, books: list[np.ndarray], id_type: str, label_type: str) -> DataFrame:
    """``vec_id, label, code, error`` of every row of the blocks."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{k:02x}" for k in range(max(map(len, books)))])
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels = (batch.column(c)[k].values for c in (0, 1))
                codes, error = [], np.zeros(len(ids), np.int64)
                for p, tree in enumerate(_read(batch.column(2)[k].as_py(), parts)):
                    chosen = tree.nearest(books[p])
                    error += ((tree.points - books[p][chosen]) ** 2).sum(axis=1)
                    codes.append(digits[chosen])
                code = pa.array(["".join(row) for row in np.stack(codes, axis=1).tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([ids, labels, code, pa.array(error)], ["vec_id", "label", "code", "error"])

    return trees.select("ids", "labels", "trees").mapInArrow(run, f"vec_id {id_type}, label {label_type}, code string, error long")


def product_codes(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row with a finite vector.

    Rows whose vector is null or holds a null, infinite or undefined component go. The
    codebooks start from the rows with the smallest ids, a null id last, equal ids by their vectors; with fewer rows than
    ``entries`` there are fewer entries. Vectors shorter than the longest, or than a multiple
    of ``parts``, end in zeros. Repeated rows count each. ``label_error`` sums over equal labels, nulls
    together. Other columns are ignored; an empty table gives no rows. A scaled component beyond
    ``LARGEST`` is an error, since sums of squares would no longer be exact.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (id_col, label_col)}
    vectors = scaled_vectors(df, id_col, vector_col, label_col, scale)
    longest = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    seeds = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = np.array([r.x + [0] * (width - len(r.x)) for r in seeds], np.int64).reshape(len(seeds), width)
    books = [np.ascontiguousarray(b) for b in np.split(start, parts, axis=1)]
    trees = written(part_trees(vectors, width, parts, block_rows), "trees")
    for _ in range(rounds):
        books = refined(trees, books)
    rows = written(encoded(trees, books, kinds[id_col], kinds[label_col]), "codes")
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()
    totals = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    joined = rows.join(totals, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
