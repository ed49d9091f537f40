import random
import zlib

from docketry.llm import language

WORDS = {
    "en": "the river and of that with stone which have they there would about people because light through should".split(),
    "de": "der fluss und das mit stein welche haben sie würde über leute weil licht durch sollte nicht schön".split(),
    "fr": "le fleuve et que avec pierre elles ont été là environ gens parce lumière à travers être français".split(),
}


def text(rng, lang, n=40):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def corpus(n=600):
    rng = random.Random(2)
    return [(k, text(rng, lang := ("en", "de", "fr")[k % 3]), lang) for k in range(n)]


ODD = [(9001, None, "en"), (9002, "", "en"), (9003, "123 !? …", "de"), (9004, "x", None), (None, "der fluss und der stein", "de"), (9005, "licht durch " * 30_000, None), (9006, "𝟙 😀", "en")]


def test_held_out_languages_are_found(documents):
    rows = corpus()
    out = {r.doc_id: r for r in language.languages(documents(rows + ODD)).collect()}
    assert len(out) == len(rows) + len(ODD)
    right = [out[i].lang_pred == lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(right) / len(right) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1) for r in out.values())
    assert all(0 <= r.score <= 1 for r in out.values())
    assert [out[k].lang_pred for k in (9001, 9002, 9003)] == ["und"] * 3
    assert out[None].lang_pred == out[9005].lang_pred == "de"


def test_prediction_depends_on_the_text_only(documents):
    rows = corpus(300)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    wrong = [(i, t, "fr") if (i, t, lang) in held else (i, t, lang) for i, t, lang in rows]
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in language.languages(documents(x)).collect()} for x in (rows, wrong))
    assert a == b


def test_rejected_documents_go(documents):
    docs = documents(corpus(300) + ODD)
    left = language.with_language(docs)
    assert left.columns == docs.columns
    kept = {r.doc_id for r in left.select("doc_id").collect()}
    assert not kept & {9001, 9002, 9003} and kept >= set(range(300))


def test_nothing_to_learn_from(documents):
    assert language.languages(documents([])).count() == 0
    assert {r.lang_pred for r in language.languages(documents([(1, "abc", None), (2, None, None)])).collect()} == {"und"}
    left = language.with_language(documents([(1, "abc", None), (2, None, None), (3, "", None), (4, "12 !", None), (None, "ß", None)]))
    assert {r.doc_id for r in left.collect()} == {1, None}
    assert language.with_language(documents([])).count() == 0
