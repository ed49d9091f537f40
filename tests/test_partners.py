"""Best partners of a key's rows, compared in one task or through the similarity join."""

import random
import re
from difflib import SequenceMatcher

import pytest

from docketry.functions.partners import exact_block_ratio
from docketry.operators import matching
from docketry.plans import preservation

ROWS = "k int, row int, text string"


def plain_ratio(a, b, metric):
    if metric == "blocks":
        return SequenceMatcher(None, a, b).ratio()
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, above[j] + 1, above[j - 1] + (x != y)))
        above = row
    return 1 - above[-1] / max(len(a), len(b))


def some_rows(seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps", "zeta"], k=rng.randrange(3, 9))) for _ in range(14)]
    old = [(k, i, t) for k in (1, 2) for i, t in enumerate(texts)]
    new = []
    for k, i, t in old:
        if rng.random() < 0.8:
            new.append((k, -i, rng.choice([t, "so, " + t, t[:-1], t.replace("a", "o", 2), t + " xx"])))
    return [*old, (1, 99, texts[0]), (None, 1, texts[0]), (3, 1, texts[1])], [*new, (None, 2, texts[0]), (4, 1, "alone")]


@pytest.mark.parametrize("most", [matching.ROWS_A_GROUP, 3])
@pytest.mark.parametrize("metric", ["edit", "blocks"])
def test_best_partner_is_brute_force(spark, monkeypatch, metric, most):
    monkeypatch.setattr(matching, "ROWS_A_GROUP", most)
    old, new = some_rows(7)
    left, right = spark.createDataFrame(old, ROWS), spark.createDataFrame(new, ROWS)
    wanted = {}
    for k, i, t in old:
        scored = [(-plain_ratio(t, u, metric), j) for q, j, u in new if k is not None and q == k]
        best = min([s for s in scored if -s[0] >= 0.8], default=(None, None))
        wanted[k, i] = (best[1], None if best[0] is None else round(-best[0], 9))
    got = {(r["k"], r["row"]): (r["other"], r["score"] and round(r["score"], 9)) for r in matching.best_partner(left, right, ["k"], 0.8, metric).collect()}
    assert got == wanted
    alone = {(r["k"], r["row"]) for r in matching.without_partner(left, right, ["k"], 0.8, metric).collect()}
    assert alone == {key for key, (other, _) in wanted.items() if other is None}


def test_rows_are_shuffled_once_to_meet(spark):
    old, new = some_rows(3)
    left, right = spark.createDataFrame(old, ROWS), spark.createDataFrame(new, ROWS)
    for met in (matching.best_partner(left, right, ["k"], 0.8), matching.without_partner(left, right, ["k"], 0.8)):
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_partner_texts_come_once_for_every_row_of_the_partner(spark):
    left = spark.createDataFrame([(1, 1, "one two three four")], ROWS)
    right = spark.createDataFrame([(1, 5, "one two three four"), (1, 5, "one two three four"), (1, 6, "one two three four")], ROWS)
    got = matching.best_partner(left, right, ["k"], 0.8, texts=True).collect()
    assert [(r["other"], r["partner"]) for r in got] == [(5, "one two three four")] * 2


def test_block_ratio_is_that_of_the_matching_blocks():
    rng = random.Random(11)
    for k in range(600):
        n = rng.choice([0, 1, 5, 40, 199, 200, 201, 320])
        letters = rng.choice(["ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz 0123456789"])
        b = "".join(rng.choices(letters, k=n))
        a = rng.choice([b, "x " + b, b + " yy", b[3:], b[:-4], "".join(rng.choices(letters, k=rng.randrange(60)))])
        true = SequenceMatcher(None, a, b).ratio()
        assert exact_block_ratio(a, b) == true
        bounded = exact_block_ratio(a, b, 0.8)
        assert bounded == true or true <= bounded < 0.8


def test_checks_read_paragraphs_that_are_written_once(spark):
    rows = [(1, side, pos, text) for side in ("original", "reordered") for pos, text in ((0, "The  first, “quoted” text."), (1, "Plain text here."), (2, None))]
    held = preservation.written_once(spark.createDataFrame(rows, "pair_id int, side string, pos int, text string"))
    got = {(r["pos"], r["key"], r["text"]) for r in held.collect()}
    assert got == {(0, 'The first, "quoted" text.', "The  first, “quoted” text."), (1, "Plain text here.", "Plain text here."), (2, "", "")}
    assert "FileScan parquet" in held._jdf.queryExecution().executedPlan().toString()
