import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docketry.llm import nearcopies
from docketry.sources.tables import table
from tests.llm.test_simhash import texts as odd_texts


def brute_set(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_roots(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def near_texts(originals=40, copies=6):
    """Copies that differ in words at several places, on both sides of the limit."""
    rng = random.Random(8)
    rows = []
    for k in range(originals):
        words = [f"w{rng.randrange(2000)}" for _ in range(rng.randint(30, 300))]
        rows.append((k * 100, " ".join(words)))
        for c in range(1, copies):
            changed = list(words)
            for _ in range(max(1, round(len(words) * rng.uniform(0.005, 0.04)))):
                changed[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
            rows.append((k * 100 + c, " ".join(changed)))
    return rows


def groups(pairs):
    out = {}
    for i, g in pairs:
        out.setdefault(g, set()).add(i)
    return {frozenset(x) for x in out.values()}


@pytest.mark.parametrize(("part_rows", "salts"), [(2, 3), (512, 64)])
def test_components_match_brute_force(documents, part_rows, salts):
    rows = near_texts() + [(i + 10**6, t) for i, t in odd_texts() if i is not None]
    out = nearcopies.near_copies(documents(rows), part_rows=part_rows, salts=salts).collect()
    assert len(out) == len(rows)
    want = groups(zip([i for i, _ in rows], brute_roots(rows), strict=True))
    assert groups((r.doc_id, r.component_id) for r in out) == want
    assert all(r.component_id == min(g) for r in out for g in want if r.doc_id in g)


def test_fingerprints_of_sets():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 0, 7, 50_000]
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)) for n in sizes]
    got = nearcopies.set_fingerprints(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    for s, fp in zip(sets, got.tolist(), strict=True):
        for bit in range(64):
            assert (fp >> bit) & 1 == (2 * sum((int(x) >> bit) & 1 for x in s) > len(s))


def test_nodes_meet_by_their_fingerprints(spark):
    """A chain of fingerprints within four bits has one key in common though no band is shared; one five bits away, and a set without shingles, have none."""
    chain = [0, 0b1111, 0b11111111, 0b11111111]
    rows = [(k, fp, [100 + k]) for k, fp in enumerate(chain)] + [(10, 0b1111111111111, [200]), (11, 0, []), (12, (1 << 62) - 1, [201])]
    placed = nearcopies.placed_nodes(spark.createDataFrame(rows, "node long, fp long, bands array<long>")).collect()
    assert sorted(r.node for r in placed) == [0, 1, 2, 3] and len({r.band for r in placed}) == 1


def test_linked_fingerprints_are_compared_without_a_band(documents, monkeypatch):
    """With bands that no two texts share, the fingerprints alone bring near copies together, and the exact count decides."""
    def own_keys(values, limits):
        own = nearcopies.set_hashes(values, limits)[np.diff(limits) > 0]
        return own[:, None] + np.arange(nearcopies.BANDS, dtype=np.uint64)

    monkeypatch.setattr(nearcopies, "band_keys", own_keys)
    words = [f"w{k}" for k in range(2000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(["less", *words])), (4, " ".join(f"z{k}" for k in range(2000)))]
    out = {r.doc_id: r.component_id for r in nearcopies.near_copies(documents(rows)).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 4}


def test_copies_that_meet_only_through_others(documents):
    """A chain in which each text is similar to the next, and copies of one text that are not similar to each other."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join(words)))
        for at in range(6):
            words[(k * 37 + at) % 400] = f"x{k}-{at}"
    base = [f"b{k}" for k in range(300)]
    for k in range(60):
        copy = list(base)
        for at in rng.sample(range(0, 300, 6), 6):
            copy[at] = f"y{k}-{at}"
        rows.append((100 + k, " ".join(copy)))
    rows.append((99, " ".join(base)))
    want = groups(zip([i for i, _ in rows], brute_roots(rows), strict=True))
    assert {frozenset(range(12))} <= want and len(want) < 40
    out = nearcopies.near_copies(documents(rows), part_rows=7, salts=4).collect()
    assert groups((r.doc_id, r.component_id) for r in out) == want


def test_rows_are_told_apart_by_id_and_text(documents):
    words = [f"w{k}" for k in range(100)]
    near = " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(words)), (2, near), (2, "an unrelated text of some words"), (None, near), (None, "lone text"), (7, "same row"), (7, "same row"), (8, None), (9, "")]
    docs = documents(rows).withColumn("marked_key", F.lit("x")).withColumn("again", F.lit("x"))
    left = nearcopies.without_near_copies(docs)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    assert got == sorted([(1, " ".join(words)), (2, "an unrelated text of some words"), (None, "lone text"), (7, "same row"), (8, None)], key=repr)


def test_recall_on_a_larger_table(spark):
    """Every pair of texts with a similarity of 0.8 or more lies in one component (found through an inverted index)."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, brute_set(r.text)) for r in docs.collect()]
    holders = {}
    for k, (_, s) in enumerate(rows):
        for x in s:
            holders.setdefault(x, []).append(k)
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()}
    pairs = found = 0
    for k, (i, s) in enumerate(rows):
        both = Counter(j for x in s for j in holders[x] if j < k)
        for j, n in both.items():
            if 5 * n >= 4 * (len(s) + len(rows[j][1]) - n):
                pairs += 1
                found += got[i] == got[rows[j][0]]
    assert pairs > 50 and found == pairs


def test_stage_leaves_no_pair_above_the_limit(documents):
    rows = near_texts()
    left = corpus_pipeline.near_dedup(None, documents(rows, extra=False), "").collect()
    first = {}
    for (i, _), g in zip(rows, brute_roots(rows), strict=True):
        first.setdefault(g, i)
    assert {r.doc_id for r in left} == set(first.values())


def test_stage_on_the_tables(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    first = {}
    for (i, _), g in zip(rows, brute_roots(rows), strict=True):
        first.setdefault(g, i)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(first.values())


def test_empty_table(documents):
    assert nearcopies.near_copies(documents([])).count() == 0
    assert nearcopies.without_near_copies(documents([])).count() == 0
