import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import packing


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2070, exclude_categories=["Cs"]), max_size=60))
def test_fast_ids_are_the_tokenizers_ids(encoder, text):
    assert encoder.ids(text) == encoder.slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "a<|endoftext|>b", "Ärger über Élan ñandú", "  two  spaces \n\n tabs\t", "it's we'll I'M", "漢字 and ไทย", "1234567 €uro – “quote”", "x" * 5000])
def test_special_and_rare_texts(encoder, text):
    assert encoder.ids(text) == encoder.slow.encode(text, add_special_tokens=False).ids


def test_only_long_documents_are_cut():
    assert packing.pieces_of(5, 4) == [(0, 1), (1, 4)]
    assert packing.pieces_of(8, 4) == [(0, 4), (4, 4)]
    assert packing.pieces_of(4, 4) == [(0, 4)] and packing.pieces_of(3, 4) == [(0, 3)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_is_best_fit(sizes):
    bins = []
    for k in np.argsort(-np.array(sizes, np.int64), kind="stable").tolist():
        room = [(64 - sum(sizes[i] for i in b), j) for j, b in enumerate(bins)]
        room = [x for x in room if x[0] >= sizes[k]]
        if room:
            bins[min(room)[1]].append(k)
        else:
            bins.append([k])
    found = packing.best_fit(np.array(sizes, np.int64), 64)
    assert sorted(sum(sizes[k] for k, _ in b) for b in found) == sorted(sum(sizes[k] for k in b) for b in bins)
    assert all([o for _, o in b] == np.cumsum([0, *(sizes[k] for k, _ in b)])[:-1].tolist() for b in found)


def check(rows, out, encoder, length=2048):
    pieces = defaultdict(list)
    for i, t in rows:
        ids = np.array([*encoder.ids(t or ""), 0], "<u4")
        for k, (start, n) in enumerate(packing.pieces_of(len(ids), length)):
            pieces[i].append((k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
    got = defaultdict(list)
    places = defaultdict(list)
    for r in out:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in pieces.items()}
    for at in places.values():
        at.sort()
        assert [o for o, _ in at] == np.cumsum([0, *(n for _, n in at)])[:-1].tolist() and sum(n for _, n in at) <= length
    return len(places), -(-sum(n for at in places.values() for _, n in at) // length)


def texts():
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["river", "stone", "über", "x1"]) for _ in range(rng.choice((3, 40, 300, 900, 2500))))) for k in range(300)]
    return rows + [(1000, None), (1001, ""), (None, "no id"), (1, "same id"), (1, "same id"), (1002, "word " * 60_000), (1003, "<|endoftext|>")]


def test_pieces_round_trip(documents, encoder):
    rows = texts()
    used, least = check(rows, packing.packed_pieces(documents(rows)).collect(), encoder)
    assert used <= least * 1.02 + 2


def test_small_tasks_merge_as_a_tree(documents, encoder):
    rows = texts()
    used, least = check(rows, packing.packed_pieces(documents(rows).repartition(40), fan_in=20).collect(), encoder)
    assert used <= least * 1.05 + 3


def test_items_over_half_never_fit_and_still_come_out(documents, encoder):
    rows = [(k, "river " * 1200) for k in range(60)]
    used, _ = check(rows, packing.packed_pieces(documents(rows).repartition(9), fan_in=10).collect(), encoder)
    assert used == 60


def test_sequences_hold_the_ids(documents, encoder):
    rows = texts()[:300]
    docs = documents(rows)
    plan = packing.packed_pieces(docs)
    plan = plan.sparkSession.createDataFrame(plan.collect(), plan.schema)
    ids = {r.sequence_id: r.ids for r in packing.packed_sequences(docs, plan).collect()}
    for r in plan.collect():
        own = np.array(ids[r.sequence_id][r.offset : r.offset + r.length], "<u4")
        assert zlib.crc32(own.tobytes()) == r.ids_crc32


def test_empty_table(documents):
    assert packing.packed_pieces(documents([])).count() == 0
