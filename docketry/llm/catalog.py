"""Registered queries of the text operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from docketry.llm import codes, exact, language, mixing, packing, private, quality, rules, sharding, simhash, substring, warc, whitening
from docketry.sources.tables import table


def op1_languages(spark, sf_dir):
    return language.languages(table(spark, sf_dir, "documents"))


def op2_hilbert_shards(spark, sf_dir):
    return sharding.hilbert_shards(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc_revisits(spark, sf_dir):
    return warc.deduplicated_archive(table(spark, sf_dir, "pages"))


def op5_packed_pieces(spark, sf_dir):
    return packing.packed_pieces(table(spark, sf_dir, "documents"))


def op6_quality_scores(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_without_repeats(spark, sf_dir):
    return substring.without_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op8_source_mix(spark, sf_dir):
    return mixing.mix_plan(table(spark, sf_dir, "documents")).drop("copies")


def op9_exact_duplicates(spark, sf_dir):
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_rule_verdicts(spark, sf_dir):
    return rules.rule_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly"
    )


def op11_personal_data(spark, sf_dir):
    return private.span_report(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark, sf_dir):
    return codes.product_codes(table(spark, sf_dir, "embeddings"))


def op13_whitened_vectors(spark, sf_dir):
    out = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_languages, op2_hilbert_shards, op3_near_duplicates, op4_warc_revisits, op5_packed_pieces, op6_quality_scores, op7_without_repeats,
        op8_source_mix, op9_exact_duplicates, op10_rule_verdicts, op11_personal_data, op12_vector_codes,
        op13_whitened_vectors,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run


def _personal_data_twin() -> str:
    """Every kind's matches by regular expression, placed by the lengths of what lies between them."""
    digits = r"regexp_replace(w, '[^0-9]', '', 'g')"
    luhn = (
        f"list_sum(list_transform(range(1, len({digits}) + 1), lambda k: CASE WHEN (len({digits}) - k) % 2 = 0 THEN substr({digits}, k, 1)::INT "
        f"ELSE (2 * substr({digits}, k, 1)::INT) // 10 + (2 * substr({digits}, k, 1)::INT) % 10 END)) % 10 = 0"
    )
    turned = "substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4)"
    iban = (
        f"list_reduce(list_prepend(0, list_transform(string_split({turned}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END)), "
        "lambda r, x: CASE WHEN x < 10 THEN (r * 10 + x) % 97 ELSE (r * 100 + x) % 97 END) = 1"
    )
    kinds = [
        ("email", private.EMAIL, "true"),
        ("ip", private.IP, "list_bool_and(list_transform(string_split(w, '.'), lambda x: len(ltrim(x, '0')) <= 3 AND ('0' || right(ltrim(x, '0'), 3))::INT <= 255))"),
        ("card", private.CARD, f"len({digits}) BETWEEN 13 AND 19 AND {luhn}"),
        ("phone", private.PHONE, f"len({digits}) BETWEEN 9 AND 15"),
        ("login", private.LOGIN, "true"),
        ("iban", private.IBAN, iban),
        ("account", private.ACCOUNT, "len(regexp_replace(v, '[^0-9]', '', 'g')) >= 6"),
        ("token", private.TOKEN, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')"),
        ("hidden_email", private.HIDDEN_EMAIL, "true"),
    ]
    base = len(private.BASE_KINDS)
    hits = []
    for k, (kind, pattern, valid) in enumerate(kinds):
        quoted = pattern.replace("'", "''")
        group = 1 if kind in ("iban", "account", "token") else 0
        hits.append(f"""SELECT rid, {k} AS k, '{kind}' AS kind, stop - len(v) AS a, stop AS b FROM (
  SELECT rid, v, w, sum(len(r) + len(w)) OVER (PARTITION BY rid ORDER BY i) AS stop FROM (
    SELECT rid, unnest(whole) AS w, unnest(val) AS v, unnest(rest[1:len(whole)]) AS r, unnest(range(len(whole))) AS i FROM (
      SELECT rid, regexp_extract_all(t, '{quoted}') AS whole, regexp_extract_all(t, '{quoted}', {group}) AS val,
        regexp_split_to_array(t, '{quoted}') AS rest FROM d))) WHERE {valid}""")
    counts = ", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{kind}" for k, (kind, _, _) in enumerate(kinds[:base]))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(hits)}),
g AS (
  SELECT rid, {counts}, string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY k, a) AS spans,
    string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY k, a) FILTER (WHERE k < {base}) AS base FROM s GROUP BY rid
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in private.BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


def _vector_codes_twin() -> str:
    """Every part against every entry of its codebook, round after round."""
    rounds = []
    for k in range(codes.ROUNDS + 1):
        rounds.append(f"""
a{k} AS MATERIALIZED (
  SELECT rid, p, any_value(v) AS v, min(d * {codes.ENTRIES} + e) AS de FROM (
    SELECT t.rid, t.p, t.v, c.e, list_sum(list_transform(range(1, len(t.v) + 1), lambda k: (t.v[k] - c.v[k]) * (t.v[k] - c.v[k])))::BIGINT AS d
    FROM cut t JOIN c{k} c USING (p)) GROUP BY rid, p
)""")
        if k < codes.ROUNDS:
            rounds.append(f"""
m{k} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS v FROM (
    SELECT p, e, place, sum(x)::BIGINT AS s, count(*) AS n FROM (
      SELECT p, de % {codes.ENTRIES} AS e, unnest(v) AS x, unnest(range(len(v))) AS place FROM a{k}) GROUP BY p, e, place) GROUP BY p, e
), c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (p, e))""")
    last = codes.ROUNDS
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, vec_id, label,
    list_transform(embedding, lambda c: floor({codes.SCALE} * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), cut AS MATERIALIZED (
  SELECT rid, p, x[p * (len(x) // {codes.PARTS}) + 1:(p + 1) * (len(x) // {codes.PARTS})] AS v FROM kept, range({codes.PARTS}) r(p)
), c0 AS MATERIALIZED (SELECT p, rid - 1 AS e, v FROM cut WHERE rid <= {codes.ENTRIES}),{",".join(rounds)},
coded AS (
  SELECT rid, string_agg(printf('%02x', (de % {codes.ENTRIES})::INT), '' ORDER BY p) AS code, sum(de // {codes.ENTRIES})::BIGINT AS error
  FROM a{last} GROUP BY rid
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c{last}) AS codebooks_sha256
FROM kept JOIN coded USING (rid)
"""


ORACLE = {
    "op11_personal_data": _personal_data_twin(),
    "op12_vector_codes": _vector_codes_twin(),
    "op4_warc_revisits": r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, 5 * (k // 4) + 1, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest FROM p
), g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to FROM g
""",
    "op7_without_repeats": r"""
WITH w AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50
), digests AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS d FROM starts),
repeats AS (SELECT * FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY d) AS first_id FROM digests) WHERE first_id < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM repeats),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM each ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT w.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op8_source_mix": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE place % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS w FROM per_source
), levels AS (  -- a source is at its limit when the others, shared out without those filled earlier, would give it more
  SELECT a.source, a.source_size, a.w,
    4 * a.source_size * (SELECT sum(b.w) FROM weighed b
      WHERE b.source_size * 2 / b.w > a.source_size * 2 / a.w OR (b.source_size * 2 / b.w = a.source_size * 2 / a.w AND b.place >= a.place))
    <= a.w * (3 * (SELECT sum(source_size) FROM weighed) - 4 * coalesce((SELECT sum(b.source_size) FROM weighed b
      WHERE b.source_size * 2 / b.w < a.source_size * 2 / a.w OR (b.source_size * 2 / b.w = a.source_size * 2 / a.w AND b.place < a.place)), 0)) AS stops
  FROM weighed a
), rest AS (
  SELECT 3 * sum(source_size) - 4 * coalesce(sum(source_size) FILTER (WHERE stops), 0) AS words,
    coalesce(sum(w) FILTER (WHERE NOT stops), 0) AS w FROM levels
), targets AS (
  SELECT l.source, l.source_size,
    CASE WHEN l.stops THEN (2 * l.source_size)::DOUBLE ELSE (l.w * r.words)::DOUBLE / (r.w * 2)::DOUBLE END AS target
  FROM levels l, rest r
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate)
    THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
""",
    "op9_exact_duplicates": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
""",
}
