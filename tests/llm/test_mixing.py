import re

import pytest

from docketry.llm import mixing

ROWS = [(k, "w " * (1 + k % 7), "en", f"s{k % 5}") for k in range(400)] + [
    (1000, "x " * 3000, "en", "s1"), (1001, None, "en", None), (1002, "a b c", "en", None), (1003, "", "en", "void"), (None, "q r", "en", "s2"),
    (5, "w " * 6, "en", "s0"), (5, "w " * 6, "en", "s0"), (1004, "b", "en", "S"), (1005, "b", "en", "é"),
]


def brute_targets(rows):
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total >= 2 * sizes[s]]
        if not over:
            return sizes, target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.discard(s)
        left -= sum(2 * sizes[s] for s in over)
    return sizes, target


def test_targets_match_brute_force(documents):
    out = mixing.mix_plan(documents(ROWS)).collect()
    assert len(out) == len(ROWS)
    sizes, target = brute_targets(ROWS)
    by_id = {i: s for i, _, _, s in ROWS}
    for r in out:
        s = by_id[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        rate = target[s] / sizes[s] if sizes[s] else 0
        assert r.copies in (int(rate), int(rate) + 1) and r.copies <= 2 and r.taken == r.copies * r["size"]


def test_same_again_and_emitted_as_planned(documents):
    docs = documents(ROWS)
    a, b = (sorted(map(repr, mixing.mix_plan(docs).collect())) for _ in range(2))
    assert a == b
    planned = sum(r.copies for r in mixing.mix_plan(docs).collect())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == planned


def test_taken_words_come_near_the_target(documents):
    rows = [(k, "w " * (5 + k % 11), "en", f"s{k % 4}") for k in range(4000)]
    taken, target = {}, {}
    for r in mixing.mix_plan(documents(rows)).collect():
        s = r.doc_id % 4
        taken[s], target[s] = taken.get(s, 0) + r.taken, r.target
    assert all(taken[s] == pytest.approx(target[s], rel=0.06) for s in taken)


def test_nothing_to_mix(documents):
    assert mixing.mix_plan(documents([])).count() == 0
    out = mixing.mix_plan(documents([(1, None), (2, "")])).collect()
    assert [(r.target, r.taken) for r in out] == [(0.0, 0), (0.0, 0)]
