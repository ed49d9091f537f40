import random
import re
from collections import Counter

import numpy as np

from docketry.llm import rules, stats
from tests.llm.helpers import rows_of


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def sample():
    rng = random.Random(3)
    out = [None, "", " ", "a", "é# b\nb\n b\nb", "x " * 40_000, "𝒳 y\r\nz\x0bq\x85r"]
    pool = ["a", "bé", "c|", " ", "\n", "d", "wörd", "e."]
    return out + [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(200)]


def test_counts_match_brute_force(documents):
    rows = list(enumerate(sample()))
    out = stats.text_counts(documents(rows))
    got = rows_of(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=repr)


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (500, 4)), np.full((5, 4), 9.0)])
    score = rules.IsolationForest.fit(x).score(x)
    assert score[-5:].min() > np.quantile(score[:-5], 0.999)
    assert ((score > 0) & (score < 1)).all()
    same = rules.IsolationForest.fit(np.zeros((3, 2))).score(np.zeros((2, 2)))
    assert len(same) == 2


def clean(rng):
    words = "river stone light after meadow under carry bright winter table gather morning silver quiet letter answer".split()
    return " ".join(f"{rng.choice(words)}{rng.randint(0, 400)}" for _ in range(rng.randint(60, 200))) + "."


def test_verdicts(documents, spark):
    rng = random.Random(4)
    rows = [(k, clean(rng)) for k in range(300)]
    rows += [(1000 + k, " ".join(w + "#$%" * 3 for w in clean(rng).split())) for k in range(30)]
    rows += [(2000, None), (2001, "too few words"), (2002, "again and again we say " * 50), (None, clean(rng)), (3, rows[3][1])]
    labels = spark.createDataFrame([(i, 0 if i >= 1000 else 1, 0) for i, _ in rows if i is not None] + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = rules.rule_verdicts(documents(rows), labels, good_lost=0.01).collect()
    assert len(out) == len(rows)
    assert {r.doc_id for r in out if r.base_failed} == {2000, 2001, 2002}
    kept = [r for r in out if r.kept]
    assert sum(1 for r in kept if r.doc_id is None or r.doc_id < 1000) >= 295
    assert sum(1 for r in kept if r.doc_id is not None and 1000 <= r.doc_id < 2000) <= 3
    assert not any(r.kept and r.base_failed for r in out)


def test_repeated_lines_are_set_apart(documents, spark):
    rng = random.Random(6)

    def page(line):
        """Forty lines of their own, each followed by ``line(k)``."""
        return "\n".join(f"{clean(rng)[:-1]}\n{line(k)}" for k in range(40))

    rows = [(k, page(lambda k: f"meadow light{k}")) for k in range(300)] + [(1000 + k, page(lambda k: "meadow light20")) for k in range(10)]
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows], "doc_id long, quality int")
    out = rules.rule_verdicts(documents(rows), labels, good_lost=0.01).collect()
    assert not any(r.base_failed for r in out) and {r.n_dup_lines for r in out} == {0, 39}
    assert not [r.doc_id for r in out if r.kept and r.doc_id >= 1000]
    assert sum(r.kept for r in out if r.doc_id < 1000) >= 295


def test_without_labels_or_rows(documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = rules.rule_verdicts(documents([(1, "a b c d e f g h i j k"), (2, "a")]), none).collect()
    assert {r.doc_id: r.kept for r in out} == {1: True, 2: False}
    assert rules.rule_verdicts(documents([]), none).count() == 0
