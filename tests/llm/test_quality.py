import random
import zlib

import numpy as np

from docketry.llm import quality


def test_model_learns_shapes_and_pairs():
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (4000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (np.abs(x[:, 2]) > 0.9)).astype(float)
    model = quality.AdditiveModel.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.85


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3))
    model = quality.AdditiveModel.fit(x, (x[:, 0] > 0).astype(float))
    z = model.start
    for c, t, v in zip(model.cuts, model.tables, x[7], strict=True):
        z += t[np.searchsorted(c, v, "right")]
    for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
        z += t[np.searchsorted(model.pair_cuts[i], x[7, i], "right"), np.searchsorted(model.pair_cuts[j], x[7, j], "right")]
    assert np.isclose(model.score(x)[7], 1 / (1 + np.exp(-z)))


def corpus(n=700):
    rng = random.Random(8)
    words = "river stone light after meadow under carry bright winter table gather morning silver quiet letter answer".split()
    out = []
    for k in range(n):
        w = [f"{rng.choice(words)}{rng.randint(0, 99)}" for _ in range(rng.randint(20, 150))]
        bad = k % 4 == 0
        if bad:
            w = [x.upper() + "!!" for x in w] if k % 8 else [rng.choice(w[:3]) for _ in w]
        out.append((k, " ".join(w), 0 if bad else 1))
    return out


def test_held_out_accuracy(documents, spark):
    rows = corpus()
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    extra = [(9001, None), (9002, ""), (9003, "river " * 50_000), (None, "stone light"), (5, rows[5][1])]
    out = quality.quality_scores(documents([r[:2] for r in rows] + extra), labels).collect()
    assert len(out) == len(rows) + len(extra)
    truth = {i: q for i, _, q in rows}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in out)


def test_held_out_labels_are_not_read(documents, spark):
    rows = corpus(300)
    flip = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, 0) for i, _, q in rows]
    a, b = (
        sorted((r.doc_id, r.score) for r in quality.quality_scores(documents([x[:2] for x in rows]), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())
        for x in ([(i, q, 0) for i, _, q in rows], flip)
    )
    assert a == b


def test_without_labels_or_rows(documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.quality_scores(documents([(1, "a b")]), none).collect()] == [0.5]
    assert quality.quality_scores(documents([]), none).count() == 0
