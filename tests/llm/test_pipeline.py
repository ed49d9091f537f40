import hashlib
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from docketry.llm import exact, language, mixing, nearcopies, packing
from docketry.sources.tables import table
from tests.llm.test_mixing import brute_targets
from tests.llm.test_nearcopies import brute_roots
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_follow_brute_force(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "exact_dedup", "near_dedup", "source_mix", "packing"]

    a = stages["language"](spark, docs, SF)
    judged = {r.doc_id: r for r in language.languages(docs).collect()}
    assert a.columns == COLUMNS
    rows = a.collect()
    assert {r.doc_id for r in rows} == {i for i, r in judged.items() if r.lang_pred != "und" and r.score >= 0.5}
    assert len(rows) > 0.95 * len(judged)

    a = spark.createDataFrame(rows, a.schema)
    b = stages["exact_dedup"](spark, a, SF)
    first = {}
    for r in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    rows = b.collect()
    assert b.columns == COLUMNS and sorted(rows) == sorted(first.values())

    b = spark.createDataFrame(rows, b.schema)
    c = stages["near_dedup"](spark, b, SF)
    rows = sorted(rows)
    roots = brute_roots([(r.doc_id, r.text) for r in rows])
    least = {}
    for r, g in zip(rows, roots, strict=True):
        least.setdefault(g, r)
    rows = c.collect()
    assert c.columns == COLUMNS and sorted(rows) == sorted(least.values())

    c = spark.createDataFrame(rows, c.schema)
    d = stages["source_mix"](spark, c, SF)
    sizes, target = brute_targets([(r.doc_id, r.text, None, r.source) for r in rows])
    times = Counter()
    for r in rows:
        rate = target[r.source] / sizes[r.source]
        coin = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
        times[r.doc_id] = int(np.floor(rate)) + (coin < rate - np.floor(rate))
    rows = d.collect()
    assert d.columns == COLUMNS and Counter(r.doc_id for r in rows) == +times

    d = spark.createDataFrame(rows, d.schema)
    out = stages["packing"](spark, d, SF).collect()
    used, least = check([(r.doc_id, r.text) for r in rows], out, packing.Encoder(packing.tokenizer_path()))
    assert used <= least * 1.02 + 2


def test_run_is_the_stages_in_turn(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kept = nearcopies.without_near_copies(exact.without_exact_duplicates(language.with_language(table(spark, SF, "documents"))))
    assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in kept.select("doc_id").collect()}


def test_odd_rows_go_through_all_stages(spark):
    words = [f"wort{'abcdefghij'[k % 10]}{'klmnop'[k % 6]}" for k in range(60)]
    rows = [
        (1, " ".join(words), "de", "a", 1), (2, " ".join(words), "de", "a", 1), (3, " ".join([*words[:-1], "anders"]), "de", None, 1), (4, None, "de", "a", 1),
        (5, "", None, None, None), (6, "123 456", "de", "b", 1), (None, "ohne nummer steht es da", "de", "b", 1), (7, "eines davon", "de", "b", 1),
        (7, "eines davon", "de", "b", 1), (7, "ein ganz anderer satz mit sieben worten", "de", "b", 1), (8, "lang " * 40_000, "de", "c", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), schema)
        assert docs.columns == COLUMNS, name
    left = sorted(((r.doc_id, r.text[:12]) for r in docs.collect()), key=repr)
    assert left == sorted([(1, words[0] + " " + words[1][:5]), (None, "ohne nummer "), (7, "eines davon"), (7, "ein ganz and"), (8, "lang lang la")], key=repr)
    for name, stage in corpus_pipeline.STAGES[3:]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema if name == "source_mix" else None)


def test_empty_table_goes_through_all_stages(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name
