"""Edit distances under a limit."""

import random

from docketry.functions.edits import WORD, bounded_distance, bounded_distances, start_distances
from docketry.operators import matching


def plain_distance(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, above[j] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


def changed(rng, text, letters, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
    return "".join(out)


def some_pairs(n, longest):
    rng, pairs = random.Random(5), []
    for k in range(n):
        letters = "ab" if k % 3 == 0 else "abcdefgé\U0001f600\0"
        a = "".join(rng.choices(letters, k=rng.randrange(longest)))
        b = changed(rng, a, letters, rng.randrange(12)) if k % 2 else "".join(rng.choices(letters, k=rng.randrange(longest)))
        pairs.append((a, b, rng.randrange(longest // 2)))
    return pairs


def test_distances_are_exact_up_to_the_limit():
    pairs = [*some_pairs(600, 150), ("", "", 0), ("", "x", 0), ("x", "", 1), ("a" * WORD, "a" * WORD, 0), ("a" * WORD, "b" * WORD, WORD)]
    got = bounded_distances(*map(list, zip(*pairs, strict=True)))
    for (a, b, limit), found in zip(pairs, got, strict=True):
        d = plain_distance(a, b)
        assert found == bounded_distance(a, b, limit) == (d if d <= limit else -1), (a, b, limit)


def test_long_texts_are_told_apart_by_their_parts():
    rng = random.Random(3)
    a = "".join(rng.choices("abcdefghij ", k=2500))
    b = changed(rng, a, "xyz", 40)
    d = plain_distance(a, b)
    other = "".join(rng.choices("klmnopqrst ", k=2500))
    assert bounded_distances([a, a, a], [b, b, other], [d, d - 1, 500]).tolist() == [d, -1, -1]


def test_distance_of_starts_is_never_above_the_whole():
    pairs = [tuple(sorted(p[:2], key=len, reverse=True)) for p in some_pairs(400, 200)]
    for (a, b), least in zip(pairs, start_distances(*map(list, zip(*pairs, strict=True))), strict=True):
        assert least <= plain_distance(a, b)


def test_similarity_join_loses_no_pair_of_any_length(spark):
    rng = random.Random(9)
    left, right = [], []
    for k in range(40):
        text = "".join(rng.choices("abcdef ", k=rng.choice([1, 4, 5, 10, 60, 200])))
        left.append(("d", k, text))
        right.append(("d", 100 + k, changed(rng, text, "abc", len(text) * rng.randrange(30) // 100)))
    a, b = (spark.createDataFrame(x, "k string, row int, text string") for x in (left, right))
    got = {(r["row"], r["other"]): r["score"] for r in matching.similar_pairs(a, b, ["k"], 0.8).collect()}
    want = {}
    for _, i, x in left:
        for _, j, y in right:
            n = max(len(x), len(y))
            score = 1 - plain_distance(x, y) / n if min(len(x), len(y)) >= 0.8 * n else 0
            if score >= 0.8:
                want[i, j] = score
    assert got == want and len(want) > 20


def test_a_row_meets_only_the_lengths_its_own_threshold_allows(spark, monkeypatch):
    met = []
    monkeypatch.setattr(matching, "measured", lambda pairs, *a, **b: met.append(pairs) or pairs.selectExpr("*", "1.0 as score"))
    left = spark.createDataFrame([("d", 1, "a" * 100, 0.98)], "k string, row int, text string, least double")
    right = spark.createDataFrame([("d", n, "b" * n) for n in range(50, 200)], "k string, row int, text string")
    matching.similar_pairs(left, right, ["k"], 0.8).collect()
    lengths = {r["other"] for r in met[0].select("other").collect()}
    assert {98, 99, 100, 101, 102} <= lengths and len(lengths) < 60
