import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import exact
from tests.llm.helpers import rows_of

NORMAL = re.compile(r"[\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, (1 << 60) - 1), st.integers(1, 9), min_size=1, max_size=200), st.integers(0, 4), st.integers(1, 12))
def test_filter_reads_back_what_it_was_given(counted, shift, top):
    keys = np.array(sorted({(k & ((1 << (64 - shift)) - 1)) for k in counted}), np.uint64)
    counts = np.arange(1, len(keys) + 1) % 3 + 1
    back, again = exact.QuotientFilter.read(exact.QuotientFilter(keys, counts, top, shift).to_bytes())
    assert back.tolist() == keys.tolist() and again.tolist() == counts.tolist()


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    raw, total = [], {}
    for _ in range(5):
        keys, counts = np.unique(rng.integers(0, 300, 200, dtype=np.uint64) << np.uint64(52), return_counts=True)
        raw.append(exact.QuotientFilter(keys, counts, 7).to_bytes())
        for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
            total[k] = total.get(k, 0) + c
    keys, counts = exact.merged(raw)
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == total


def brute(rows):
    out, groups = [], {}
    for i, t in rows:
        groups.setdefault(NORMAL.sub(" ", t or ""), []).append(i)
    for i, t in rows:
        n = NORMAL.sub(" ", t or "")
        ids = groups[n]
        first = min((x for x in ids if x is not None), default=None)
        out.append((i, first, len(ids), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [
    (5, "a  b"), (3, "a b"), (9, "a\tb\n"), (7, "a b "), (1, None), (2, ""), (4, " "), (6, "\n\n"), (8, "é " * 50_000), (10, "é\n" * 50_000),
    (11, "x"), (11, "x"), (None, "x"), (None, "only"), (12, "a b"), *((20 + k, "hot") for k in range(40)),
]


def test_groups_match_brute_force(documents):
    out = exact.exact_duplicates(documents(ROWS))
    assert rows_of(out, "doc_id", "keep_id", "group_size", "text_sha256") == brute(ROWS)
    kept = rows_of(out.where("kept"), "text_sha256")
    assert len(kept) == len(set(kept)) == len({r[3] for r in brute(ROWS)})
    assert {r[0] for r in rows_of(out.where("kept"), "doc_id")} >= {3, 7, 1, 4, 8, 11, 20, None}


def test_rows_that_stay_keep_their_columns(documents):
    docs = documents(ROWS)
    left = exact.without_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert left.count() == len({r[3] for r in brute(ROWS)})


def test_rows_that_stay_are_told_apart_by_id_and_text(documents):
    rows = [(1, "a b"), (1, "a  b"), (1, "c"), (2, "a b"), (3, "d"), (3, "d"), (None, "e"), (4, "e"), (None, "f"), (None, "f"), (5, None), (6, "")]
    docs = documents(rows)
    left = sorted(((r.doc_id, r.text) for r in exact.without_exact_duplicates(docs.withColumn("marked_id", docs["doc_id"])).collect()), key=repr)
    either = [r for r in left if r[0] == 1 and r[1] != "c"]
    assert len(either) == 1 and either[0][1] in ("a b", "a  b")
    assert [r for r in left if r not in either] == sorted([(1, "c"), (3, "d"), (4, "e"), (None, "f"), (5, None)], key=repr)


def test_empty_table(documents):
    assert exact.exact_duplicates(documents([])).count() == 0
    assert exact.without_exact_duplicates(documents([])).count() == 0
