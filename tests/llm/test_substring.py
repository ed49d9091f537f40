import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from docketry.llm import substring
from tests.llm.helpers import rows_of


def brute(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    last = float("inf")
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, last), last if i is None else i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (last if i is None else i):
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows(window):
    rng = random.Random(window)
    pool = [f"w{k}" for k in range(4 if window < 10 else 5000)] + ["é", "漢"]
    long = lambda n: [rng.choice(pool) for _ in range(n)]
    passage, other = long(window + 7), long(window)
    out = []
    for k in range(60):
        w = long(rng.randint(0, 3 * window))
        if k % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage
        if k % 5 == 0:
            w += other + other
        out.append((k * 7 % 61, rng.choice([" ", "\n", " \t"]).join(w)))
    whole = " ".join(long(4 * window))
    out += [(100 + k, whole) for k in range(30)] + [(200, None), (201, ""), (202, " \n "), (203, " ".join(passage[:window])), (204, " ".join(passage[: window - 1]))]
    out += [(205, " ".join(long(20_000))), (206, whole + " tail"), (90, out[0][1]), (90, out[0][1]), (None, whole), (None, " ".join(passage))]
    out += [(300, " ".join(long(window)) + " " + whole), (300, " ".join(other) + " z")]
    return out


@pytest.mark.parametrize("window", [5, 50])
def test_removed_words_match_brute_force(documents, window):
    data = rows(window)
    out = substring.without_repeats(documents(data), window)
    assert rows_of(out, "doc_id", "n_words", "n_removed", "kept_sha256") == brute(data, window)
    for r in out.where("kept_text is not null").collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_full_sketch_only_lets_more_windows_through(documents, monkeypatch):
    monkeypatch.setattr(substring, "CELLS_PER_HASH", 0.0001)
    monkeypatch.setattr(substring, "BLOCK_BITS", 3)
    data = rows(5)
    out = substring.without_repeats(documents(data), 5)
    assert rows_of(out, "doc_id", "n_words", "n_removed", "kept_sha256") == brute(data, 5)


def test_estimates_lose_none_and_pass_few_for_nothing(spark):
    rng = np.random.default_rng(5)
    own = rng.integers(0, 1 << 63, (2000, 100), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    common = rng.integers(0, 1 << 62, 50, dtype=np.uint64)
    sets = [np.unique(np.concatenate([own[k], common[rng.random(50) < 0.01]])) for k in range(2000)]
    times = Counter(x for s in sets for x in s.tolist())
    rows = [(k, bytearray(s.tobytes())) for k, s in enumerate(sets)]
    profiles = spark.createDataFrame(rows, "doc_id long, hashes binary").repartition(7)
    out = substring.repeated_hashes(profiles, sum(map(len, sets))).collect()
    passed = [(r.doc_id, h & ((1 << 64) - 1)) for r in out for h in r.hashes]
    assert len(passed) == len(set(passed))
    wanted = {(k, x) for k, s in enumerate(sets) for x in s.tolist() if times[x] > 1}
    assert wanted and wanted <= set(passed)
    single = sum(n == 1 for n in times.values())
    assert 0 < len(set(passed) - wanted) < 0.02 * single


def test_rows_choose_counters_apart():
    values = np.random.default_rng(1).integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = substring.counters(values, 1, 12), substring.counters(values, 2, 12)
    same = a == a[0]
    assert 0 < same.sum() < 12 and len(set(b[same].tolist())) == same.sum()


def test_many_sketches_a_partition(documents, monkeypatch):
    monkeypatch.setattr(substring, "SKETCH_HASHES", 20)
    data = rows(50)
    out = substring.without_repeats(documents(data), 50)
    assert rows_of(out, "doc_id", "n_words", "n_removed", "kept_sha256") == brute(data, 50)


def test_empty_table(documents):
    assert substring.without_repeats(documents([])).count() == 0
