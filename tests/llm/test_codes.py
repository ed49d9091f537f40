import hashlib
import random

import numpy as np
import pytest

from docketry.llm import codes
from tests.llm.helpers import rows_of

SCHEMA = "vec_id long, embedding array<float>, label int, x string, code string, n string"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v], lab) for i, v, lab in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    x = np.array([v + [0] * (width - len(v)) for _, v, _ in kept], np.int64)
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    cut = x.reshape(len(x), parts, -1)
    books = cut[first].transpose(1, 0, 2).copy()

    def nearest():
        return np.stack([((cut[:, p, None] - books[p][None]) ** 2).sum(axis=2).argmin(axis=1) for p in range(parts)], axis=1)

    for _ in range(rounds):
        chosen = nearest()
        for p in range(parts):
            for e in np.unique(chosen[:, p]):
                own = cut[chosen[:, p] == e, p]
                books[p, e] = own.sum(axis=0) // len(own)
    chosen = nearest()
    error = sum(((cut[:, p] - books[p][chosen[:, p]]) ** 2).sum(axis=1) for p in range(parts))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    by_label = {}
    for (_, _, lab), e in zip(kept, error.tolist(), strict=True):
        by_label[lab] = by_label.get(lab, 0) + e
    return sorted(
        ((i, "".join(f"{c:02x}" for c in row), e, by_label[lab], digest) for (i, _, lab), row, e in zip(kept, chosen.tolist(), error.tolist(), strict=True)), key=repr
    )


def sample(n, dims=32, spread=0.2, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (7, dims))
    return [(k * 3 % 1009, (centres[k % 7] + rng.normal(0, spread, dims)).tolist(), k % 4 or None) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "a", "b", "c") for i, v, lab in rows], SCHEMA).repartition(3)


COLUMNS = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


@pytest.mark.parametrize("spread", [0.2, 0.004])  # the narrow one has many equal parts and ties
@pytest.mark.parametrize("block_rows", [4096, 50])
def test_codes_match_brute_force(spark, spread, block_rows):
    rows = sample(900, spread=spread)
    odd = [(None, rows[0][1], 2), (5000, None, 1), (5001, [None] + rows[0][1][1:], 1), (5002, [float("nan")] * 32, 1), (5003, [float("inf")] * 32, 1)]
    odd += [(5004, rows[1][1], None), (5004, rows[1][1], None), (5005, [], 9), (5006, [0.5] * 20, 9)]
    rows += odd
    assert rows_of(codes.product_codes(frame(spark, rows), block_rows=block_rows), *COLUMNS) == brute(rows)


def test_few_rows_and_odd_lengths(spark):
    rows = sample(5, dims=30)
    assert rows_of(codes.product_codes(frame(spark, rows)), *COLUMNS) == brute(rows)


def test_empty_table(spark):
    assert codes.product_codes(frame(spark, [])).count() == 0
    assert codes.product_codes(frame(spark, [(1, None, 1)])).count() == 0


def test_component_out_of_range_is_an_error(spark):
    with pytest.raises(Exception, match="scaled component"):
        codes.product_codes(frame(spark, [(1, [1e9] * 16, 1)])).collect()


@pytest.mark.parametrize("n", [1, 64, 65, 1000, 4000])
def test_balls_hold_their_points(n):
    rng = np.random.default_rng(n)
    points = rng.integers(-40, 40, (n, 4))
    tree = codes.PartTree.grow(points)
    assert sorted(tree.order.tolist()) == list(range(n))
    for k in range(len(tree.start)):
        own = points[tree.order[tree.start[k] : tree.end[k]]]
        assert tree.counts[k] == len(own) and (tree.sums[k] == own.sum(axis=0)).all()
        assert np.sqrt(((own - tree.pivot[k]) ** 2).sum(axis=1)).max() <= tree.radius[k] + 1e-9
        if tree.left[k] >= 0:
            assert (tree.start[tree.left[k]], tree.end[tree.right[k]]) == (tree.start[k], tree.end[k])
            assert tree.end[tree.left[k]] == tree.start[tree.right[k]]
    entries = rng.integers(-40, 40, (64, 4))
    want = ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (tree.nearest(entries) == want).all()


def test_distant_entries_own_whole_balls():
    rng = np.random.default_rng(2)
    points = rng.integers(-40, 40, (2000, 4)) + np.array([400, 0, 0, 0]) * (np.arange(2000) % 2)[:, None]
    tree = codes.PartTree.grow(points)
    balls, whole, left, _ = tree.owned(np.array([[0, 0, 0, 0], [400, 0, 0, 0]]))
    assert len(left) == 0 and tree.counts[balls].sum() == 2000 and len(balls) < 100
    assert np.bincount(whole, tree.counts[balls]).tolist() == [1000, 1000]


def test_anchors_are_each_points_nearest():
    rng = random.Random(3)
    points = np.array([[rng.random() for _ in range(3)] for _ in range(500)])
    owner, anchors = codes.anchor_balls(points, 22)
    assert len(anchors) == 22
    distance = np.sqrt(((points[:, None] - points[anchors][None]) ** 2).sum(axis=2))
    assert np.allclose(distance[np.arange(500), owner], distance.min(axis=1))
