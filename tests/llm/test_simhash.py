import random
import re

import numpy as np
import pytest
import xxhash

from docketry.llm import graph, simhash
from tests.llm.helpers import rows_of


def brute_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=4):
    n = len(fps)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def near_points(rng, centres, each, flips):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        out |= {c} | {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, flips))) for _ in range(each)}
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_trees_find_all_within_the_radius(seed):
    rng = random.Random(seed)
    points = np.array(near_points(rng, 8, 40, 6), np.uint64)
    tree = np.sort(np.array([rng.randrange(3) for _ in points]))
    tree = np.unique(tree, return_inverse=True)[1]
    which, node = simhash.Forest(points, tree).near(points, tree, 4)
    got = set(zip(which.tolist(), node.tolist(), strict=True))
    want = {(i, j) for i in range(len(points)) for j in range(len(points)) if tree[i] == tree[j] and int(points[i] ^ points[j]).bit_count() <= 4}
    assert got == want


@pytest.mark.parametrize("tree_rows", [5, 4096])
def test_links_connect_as_brute_force(spark, tree_rows):
    points = near_points(random.Random(9), 25, 30, 5)
    df = spark.createDataFrame([(p - (1 << 64) if p >= 1 << 63 else p,) for p in points], "fp long")
    found = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in graph.components(simhash.links(df, tree_rows=tree_rows)).collect()}
    mine, theirs = [found.get(p, p) for p in points], brute_components(points)
    groups = lambda x: {frozenset(i for i, v in enumerate(x) if v == g) for g in set(x)}
    assert groups(mine) == groups(theirs)


def test_long_paths_and_stars_settle(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000), (6001, 6000)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(300)} | {6000: 6000, 6001: 6000}
    assert got == want


def texts():
    rng = random.Random(5)
    pool = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 120)))) for k in range(80)]
    for k in range(60):
        words = rows[k % 80][1].split()
        if words:
            words[rng.randrange(len(words))] = "changed"
        rows.append((100 + k, " ".join(words)))
    return rows + [
        (200, None), (201, ""), (202, " \n"), (203, rows[3][1].upper()), (204, "a b"), (205, "A\tB"), (206, "x y z " * 30_000), (207, "x y z " * 29_000),
        (208, "same"), (208, "same"), (None, rows[3][1]), (None, "nobody else has this text at all"),
    ]


def test_fingerprints_match_brute_force(documents):
    rows = texts()
    out = simhash.near_duplicates(documents(rows))
    assert rows_of(out, "doc_id", "fingerprint") == sorted(((i, f"{brute_fingerprint(t):016x}") for i, t in rows), key=repr)


def test_components_match_brute_force(documents):
    rows = texts()
    roots = brute_components([brute_fingerprint(t) for _, t in rows])
    least = {g: min((i for (i, _), r in zip(rows, roots, strict=True) if r == g and i is not None), default=None) for g in set(roots)}
    out = simhash.near_duplicates(documents(rows))
    assert rows_of(out, "doc_id", "component_id") == sorted(((i, least[g]) for (i, _), g in zip(rows, roots, strict=True)), key=repr)


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([])).count() == 0
