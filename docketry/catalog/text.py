"""Scalar functions over whole texts and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import fixed_values as fv
from docketry.catalog import inputs
from docketry.catalog.inputs import sql_list, sql_text
from docketry.functions import dates, patterns, rules, text
from docketry.functions.arrays import let
from docketry.operators import cases
from docketry.sources.tables import table


def f1_search_key(spark: SparkSession, d: str) -> DataFrame:
    key = text.search_key(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(key).alias("chars"), F.md5(key).alias("digest"))


def f2_comparison_key(spark: SparkSession, d: str) -> DataFrame:
    key = text.comparison_key(F.col("text"), compatibility=True)
    return table(spark, d, "documents").select("doc_id", F.length(key).alias("chars"), F.md5(key).alias("digest"))


def f3_similarity(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_name")
    following = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name"))
    return part.join(following, "p_partkey").select(
        "p_partkey", "p_name", "next_name", text.similarity(F.col("p_name"), F.col("next_name")).alias("score")
    )


def f4_section_numbers(spark: SparkSession, d: str) -> DataFrame:
    number = text.section_number(F.col("text"))
    return inputs.lines(spark, d).select("doc_key", "pos", F.length(number).alias("chars"), F.md5(number).alias("digest"))


def f5_check_digits(spark: SparkSession, d: str) -> DataFrame:
    number = ((F.col("o_orderkey") * 7919 + 12345) % 1000000000).cast("string")
    return table(spark, d, "orders").select("o_orderkey", patterns.check_digit_valid(number).alias("valid"))


def f6_detectors(spark: SparkSession, d: str) -> DataFrame:
    found = inputs.lines(spark, d).select(
        "doc_key", F.explode(patterns.detect(F.col("text"), patterns.LATIN_DETECTORS)).alias("x")
    )
    return found.groupBy("doc_key", "x.category", "x.value").agg(F.count(F.lit(1)).alias("n"))


def f7_quotes(spark: SparkSession, d: str) -> DataFrame:
    found = inputs.lines(spark, d).select("doc_key", "pos", F.explode(text.quotes(F.col("text"), 12, 1)).alias("quote"))
    return found


LATIN_REFERENCES = [r"Version \d+\.\d+", r"\d+\.\d+\.\d+\.\d+", r"\d+\.\d+"]


def f8_references(spark: SparkSession, d: str) -> DataFrame:
    refs = patterns.legal_references(F.col("text"), LATIN_REFERENCES)
    return table(spark, d, "documents").select("doc_id", F.explode(refs).alias("ref"))


def f9_masking(spark: SparkSession, d: str) -> DataFrame:
    shown = F.transform(
        F.split("text", " ", -1), lambda w: F.when(F.length(w) >= 12, text.mask(w)).otherwise(w)
    )
    return inputs.lines(spark, d).select("doc_key", "pos", F.md5(F.array_join(shown, " ")).alias("digest"))


CONNECTORS = ["In addition,", "However,"]


def f10_leading_additions(spark: SparkSession, d: str) -> DataFrame:
    front = F.element_at(F.array(F.lit("In addition, "), F.lit("Whatever "), F.lit("")), (F.col("pos") % 3 + 1).cast("int"))
    added = let(
        text.comparison_key(F.col("text")),
        lambda o: let(text.comparison_key(F.concat(front, F.col("text"))), lambda n: text.leading_addition(o, n)),
    )
    # Exploding the filtered one-element array works the keys out once per line; a filter would do so again.
    kept = F.explode(F.filter(F.array(added), lambda x: F.length(x) > 0))
    return inputs.lines(spark, d).select("doc_key", "pos", kept.alias("added")).withColumn(
        "allowed", F.col("added").isin(*CONNECTORS)
    )


LATIN_APPENDIX = [("A", r"License, Version (\d)"), ("B", r"Version (\d)"), ("C", r"(\d{3})")]


def f11_appendix_references(spark: SparkSession, d: str) -> DataFrame:
    hits = patterns.first_per_reference(patterns.appendix_references(F.col("text"), LATIN_APPENDIX, ["555"]))
    found = inputs.lines(spark, d).filter(F.col("text").rlike("[0-9]")).select(
        "doc_key", (F.col("pos") + 1).alias("line_num"), F.explode(hits).alias("h")
    )
    return found.select("doc_key", "line_num", "h.ref_id", "h.family")


def f12_appendix_labels(spark: SparkSession, d: str) -> DataFrame:
    style = F.when(F.col("p_partkey") % 2 == 0, "hebrew").otherwise("arabic")
    labelled = table(spark, d, "part").select(
        "p_partkey", style.alias("style"), patterns.appendix_label(F.col("p_size") - 1, style).alias("label")
    )
    return labelled.withColumn("back", patterns.appendix_index(F.col("label"), F.col("style")))


def f13_path_reroot(spark: SparkSession, d: str) -> DataFrame:
    folder = F.when(F.col("c_custkey") % 5 == 0, "C:\\Other\\").otherwise("C:\\Office\\tmpDocs\\")
    path = F.concat(folder, F.col("c_mktsegment"), F.lit("\\"), F.col("c_custkey").cast("string"), F.lit(".pdf"))
    return table(spark, d, "customer").select("c_custkey", text.reroot_path(path, "/archive").alias("path"))


def f14_clean_titles(spark: SparkSession, d: str) -> DataFrame:
    return inputs.lines(spark, d).select("doc_key", "pos", text.clean_title(F.col("text")).alias("title"))


def f15_dates(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    k = F.col("o_orderkey") % 4
    written = (
        F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "dd/MM/yyyy"))
        .when(k == 2, F.date_format(at, "d/M/yyyy")).otherwise(F.lit("soon"))
    )
    parsed = table(spark, d, "orders").select("o_orderkey", dates.parse_date(written).alias("parsed"))
    return parsed.select(
        "o_orderkey", "parsed", dates.file_date(F.col("parsed")).alias("file_date"), dates.prose_date(F.col("parsed")).alias("prose_date")
    )


EVENT_KINDS = [14, 3, 7, 15, 39, 52, 200, 201, 999]


def f16_event_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.element_at(F.array(*[F.lit(k) for k in EVENT_KINDS]), (F.col("event_id") % 9 + 1).cast("int"))
    requests = e.select(
        F.col("event_id").alias("request_id"), kind.alias("kind"),
        F.when(kind == 200, 2).when(kind == 201, 5).alias("kind_group"),
        F.to_date("ts").alias("day"),
        F.when(F.col("event_id") % 4 > 0, F.hour("ts") * 60 + F.minute("ts")).alias("start_minutes"),
        F.lit(None).cast("int").alias("end_minutes"),
        F.when(F.col("event_id") % 2 == 0, F.col("value").cast("decimal(18,2)")).alias("amount"),
    )
    rows = cases.event_rows(requests, "17", F.lit(615))
    return rows.withColumn("bill_sum", F.col("bill_sum").cast("double"))


def f17_valid_characters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.valid_character_ratio(F.col("text")).alias("ratio"))


def f18_markup_text(spark: SparkSession, d: str) -> DataFrame:
    plain = text.markup_to_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(plain).alias("chars"), F.md5(plain).alias("digest"))


TURN_RULES = [
    ("both", [["tion"], ["ing "]]), ("tion", [["tion"]]), ("que", [["que ", "der "]]), ("la", [["la "]]),
]


def f19_first_rule(spark: SparkSession, d: str) -> DataFrame:
    label = rules.first_rule(F.col("text"), TURN_RULES, "other")
    return table(spark, d, "conversations").select("conv_id", "turn", label.alias("label"))


LANGUAGE_RULES = {
    "english": {" the ": 2, " and ": 1, " of ": 1},
    "french": {" le ": 2, " les ": 1, " de ": 1},
    "german": {" der ": 2, " und ": 1, " den ": 1},
    "spanish": {" que ": 1, " los ": 1, " de ": 1},
}


def f20_document_class(spark: SparkSession, d: str) -> DataFrame:
    return _classed(table(spark, d, "documents").select("doc_id", rules.rule_scores(F.col("text"), LANGUAGE_RULES).alias("scores")), LANGUAGE_FOLDERS)


def _classed(scored: DataFrame, folders: dict[str, str]) -> DataFrame:
    """Class, state and folder of ``(doc_id, scores)``; each text is searched for its phrases once."""
    one = F.explode(F.array(F.struct(rules.best_class(F.col("scores")).alias("label"), rules.class_state(F.col("scores")).alias("state"))))
    judged = scored.select("doc_id", F.explode(F.array("scores")).alias("scores")).select("doc_id", one.alias("c"))
    return judged.select("doc_id", "c.label", "c.state", rules.target_folder(F.col("c.label"), folders).alias("folder"))


LANGUAGE_FOLDERS = {"english": "01", "french": "02", "german": "03"}


def f20_case_documents(spark: SparkSession, d: str) -> DataFrame:
    """The fixed class tables on texts into which the signature phrases of a class are written."""
    classes = list(fv.DOCUMENT_CLASSES)
    phrase = F.element_at(F.array(*[F.lit(fv.DOCUMENT_CLASSES[c][0]) for c in classes]), (F.col("doc_id") % len(classes) + 1).cast("int"))
    second = F.when(F.col("doc_id") % 5 == 0, F.lit(fv.DOCUMENT_CLASSES[classes[0]][0])).otherwise(F.lit(""))
    written = F.when(F.col("doc_id") % 7 == 0, F.col("text")).otherwise(F.concat_ws(" ", phrase, "text", second))
    texts = table(spark, d, "documents").select("doc_id", F.explode(F.array(written)).alias("written"))
    scores = rules.rule_scores(F.col("written"), {c: {p: 1 for p in phrases} for c, phrases in fv.DOCUMENT_CLASSES.items()})
    return _classed(texts.select("doc_id", scores.alias("scores")), fv.CLASS_FOLDERS)


COURTS = ["tionth", "eaux"]


def f23_question_lint(spark: SparkSession, d: str) -> DataFrame:
    asked = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    broken = rules.question_violations(asked, (F.col("turn") % 14).cast("int"), COURTS)
    plan = rules.question_plan((F.col("turn") % 14).cast("int"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.array_join(broken, ",").alias("violations"),
        (plan["case_law"] + plan["statutes"] + plan["literature"]).alias("passages"), plan["analyse"].alias("analyse"),
    )


PLANTED = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License."]


def f28_planted_text(spark: SparkSession, d: str) -> DataFrame:
    clean, planted, digits = text.remove_planted(F.col("text"), PLANTED)
    return table(spark, d, "documents").select(
        "doc_id", planted.alias("planted"), digits.alias("footnote_digits"), F.md5(clean).alias("digest")
    )


def f30_word_drift(spark: SparkSession, d: str) -> DataFrame:
    after = F.when(F.col("pos") % 3 == 0, F.concat("text", F.lit(" one two"))).otherwise(F.col("text"))
    a, b = text.word_count(F.col("text")), text.word_count(after)
    counted = inputs.lines(spark, d).select("doc_key", "pos", a.alias("before"), b.alias("after"))
    drift = F.abs(F.col("after") - F.col("before")) / F.col("before") > fv.DRIFT_TOLERANCE
    return counted.filter((F.col("before") > 0) & drift)


QUERIES = {
    f.__name__: f
    for f in (
        f1_search_key, f2_comparison_key, f3_similarity, f4_section_numbers, f5_check_digits, f6_detectors, f7_quotes,
        f8_references, f9_masking, f10_leading_additions, f11_appendix_references, f12_appendix_labels, f13_path_reroot,
        f14_clean_titles, f15_dates, f16_event_rows, f17_valid_characters, f18_markup_text, f19_first_rule,
        f20_document_class, f20_case_documents, f23_question_lint, f28_planted_text, f30_word_drift,
    )
}

_KEY = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_SCORES = {
    name: " + ".join(f"CASE WHEN contains(text, '{p}') THEN {w} ELSE 0 END" for p, w in phrases.items())
    for name, phrases in LANGUAGE_RULES.items()
}
_EVENT_TYPE = "CASE kind " + " ".join(f"WHEN {k} THEN '{v[0]}'" for k, v in fv.EVENT_TEMPLATES.items()) + " WHEN 200 THEN 'cal' WHEN 201 THEN 'cal' END"


def _event_value(i: int) -> str:
    own = " ".join(f"WHEN {k} THEN {v[i] if v[i] is not None else 'NULL'}" for k, v in fv.EVENT_TEMPLATES.items())
    return f"CASE kind {own} WHEN 200 THEN {fv.GROUP_TEMPLATES[2][i]} WHEN 201 THEN {fv.GROUP_TEMPLATES[5][i]} END"


ORACLE = {
    "f1_search_key": r"""
        WITH k AS (SELECT doc_id, regexp_replace(lower(translate(text, '"''`׳״.,-–—()[]/\', '')), '\s+', '', 'g') AS k FROM documents)
        SELECT doc_id, CAST(length(k) AS INTEGER) AS chars, md5(k) AS digest FROM k""",
    "f2_comparison_key": r"""
        WITH k AS (SELECT doc_id, trim(regexp_replace(translate(nfc_normalize(text), '״“”„«»’׳–—―', repeat(chr(34), 6) || '''''---'), '\s+', ' ', 'g')) AS k
                   FROM documents)
        SELECT doc_id, CAST(length(k) AS INTEGER) AS chars, md5(k) AS digest FROM k""",
    "f3_similarity": """
        WITH p AS (SELECT a.p_partkey, a.p_name, b.p_name AS next_name, string_split(a.p_name, ' ') AS x, string_split(b.p_name, ' ') AS y
                   FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
        s AS (SELECT *, len(list_filter(x, lambda w: list_contains(y, w))) / len(list_distinct(list_concat(x, y))) AS jac,
                     CASE WHEN contains(p_name, next_name) OR contains(next_name, p_name)
                          THEN least(1.0::DOUBLE, least(length(p_name), length(next_name)) / greatest(length(p_name), length(next_name)) + 0.3::DOUBLE)
                          ELSE 0.0 END AS cont,
                     1 - levenshtein(p_name, next_name) / greatest(length(p_name), length(next_name)) AS ed FROM p)
        SELECT p_partkey, p_name, next_name,
               CASE WHEN p_name = next_name THEN 1.0::DOUBLE ELSE round_even(least(1.0::DOUBLE, greatest(jac, cont, ed)), 2) END AS score FROM s""",
    "f4_section_numbers": f"""
        WITH {inputs.LINES}, k AS (SELECT doc_key, pos, regexp_replace(trim(text), '[\\s.]+$', '') AS k FROM lines)
        SELECT doc_key, CAST(pos AS INTEGER) AS pos, CAST(length(k) AS INTEGER) AS chars, md5(k) AS digest FROM k""",
    "f5_check_digits": """
        WITH n AS (SELECT o_orderkey, CAST((o_orderkey * 7919 + 12345) % 1000000000 AS VARCHAR) AS s FROM orders),
        w AS (SELECT o_orderkey, s, list_transform(range(1, 10),
                lambda i: CAST(substr(lpad(s, 9, '0'), i, 1) AS INTEGER) * (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END)) AS p FROM n)
        SELECT o_orderkey, length(s) BETWEEN 5 AND 9
               AND list_sum(list_transform(p, lambda v: CASE WHEN v > 9 THEN v - 9 ELSE v END)) % 10 = 0 AS valid FROM w""",
    "f6_detectors": f"""
        WITH {inputs.LINES}, f AS (
        """
    + " UNION ALL ".join(
        f"SELECT doc_key, '{x.category}' AS category, unnest(regexp_extract_all(text, {sql_text(x.pattern)})) AS value FROM lines"
        for x in patterns.LATIN_DETECTORS
    )
    + ") SELECT doc_key, category, value, count(*) AS n FROM f GROUP BY ALL",
    "f7_quotes": f"""
        WITH {inputs.LINES}
        SELECT doc_key, CAST(pos AS INTEGER) AS pos, trim(unnest(regexp_extract_all({_KEY.format('text')}, '"([^"]{{12,}})"', 1))) AS quote FROM lines""",
    "f8_references": "SELECT DISTINCT doc_id, ref FROM ("
    + " UNION ALL ".join(
        f"SELECT doc_id, unnest(regexp_extract_all({_KEY.format('text')}, {sql_text(p)})) AS ref FROM documents" for p in LATIN_REFERENCES
    )
    + ")",
    "f9_masking": f"""
        WITH {inputs.LINES}
        SELECT doc_key, CAST(pos AS INTEGER) AS pos, md5(array_to_string(list_transform(string_split(text, ' '),
               lambda w: CASE WHEN length(w) >= 12 THEN repeat('█', length(w)) ELSE w END), ' ')) AS digest FROM lines""",
    "f10_leading_additions": f"""
        WITH {inputs.LINES}, k AS (
          SELECT doc_key, pos, {_KEY.format('text')} AS o,
                 {_KEY.format("(['In addition, ', 'Whatever ', ''])[CAST(pos % 3 + 1 AS INTEGER)] || text")} AS n FROM lines),
        a AS (SELECT doc_key, pos, CASE WHEN ends_with(n, o) AND length(n) > length(o) THEN trim(left(n, length(n) - length(o))) END AS added FROM k)
        SELECT doc_key, CAST(pos AS INTEGER) AS pos, added, added IN ('In addition,', 'However,') AS allowed FROM a WHERE length(added) > 0""",
    "f11_appendix_references": f"WITH {inputs.LINES}, f AS ("
    + " UNION ALL ".join(
        f"SELECT doc_key, pos, {i} AS p, '{fam}' AS family, unnest(regexp_extract_all(text, {sql_text(pat)}, 1)) AS ref_id FROM lines"
        for i, (fam, pat) in enumerate(LATIN_APPENDIX)
    )
    + """) SELECT doc_key, CAST(pos + 1 AS INTEGER) AS line_num, ref_id, min_by(family, p) AS family
           FROM f WHERE ref_id <> '555' GROUP BY doc_key, pos, ref_id""",
    "f12_appendix_labels": f"""
        WITH l AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 2 = 0 THEN 'hebrew' ELSE 'arabic' END AS style FROM part)
        SELECT p_partkey, style,
               CASE WHEN style = 'arabic' THEN CAST(p_size AS VARCHAR) ELSE ({sql_list(fv.APPENDIX_LETTERS)})[p_size] END AS label,
               CASE WHEN style = 'arabic' OR p_size <= 30 THEN p_size - 1 END AS back FROM l""",
    "f13_path_reroot": r"""
        SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'C:\Other\' || c_mktsegment || '\' || c_custkey || '.pdf'
               ELSE '/archive/' || c_mktsegment || '\' || c_custkey || '.pdf' END AS path FROM customer""",
    "f14_clean_titles": f"""
        WITH {inputs.LINES}
        SELECT doc_key, CAST(pos AS INTEGER) AS pos,
               trim(substr(regexp_replace(trim(regexp_replace(replace(text, '"', '״'), '[\\\\/:*?<>|\\r\\n]+', ' ', 'g')), '\\s{{2,}}', ' ', 'g'), 1, 99)) AS title
        FROM lines""",
    "f15_dates": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS parsed,
               CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%d.%m.%y') END AS file_date,
               CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%-d.%-m.%Y') END AS prose_date FROM orders""",
    "f16_event_rows": f"""
        WITH r AS (SELECT event_id, ({sql_list(EVENT_KINDS)})[CAST(event_id % 9 + 1 AS INTEGER)] AS kind, CAST(ts AS DATE) AS day,
                          CASE WHEN event_id % 4 > 0 THEN hour(ts) * 60 + minute(ts) END AS s,
                          CASE WHEN event_id % 2 = 0 THEN CAST(value AS DECIMAL(18,2)) ELSE 250.00 END AS amount FROM events),
        t AS (SELECT *, {_EVENT_TYPE} AS row_type, {_event_value(1)} AS product, {_event_value(2)} AS colour, {_event_value(3)} AS alarm FROM r),
        u AS (SELECT *, coalesce(s, CASE row_type WHEN 'cal' THEN 540 WHEN 'task' THEN 480 WHEN 'call' THEN 615 END) AS st FROM t)
        SELECT event_id AS request_id, kind, row_type, day,
               CAST(CASE WHEN row_type IN ('cal', 'task', 'call') THEN st WHEN row_type = 'damage' THEN 615 END AS INTEGER) AS start_minutes,
               CAST(CASE WHEN row_type = 'cal' THEN st + 30 END AS INTEGER) AS end_minutes,
               CAST(CASE WHEN row_type IN ('cal', 'task', 'call') AND alarm > 0 THEN st - alarm END AS INTEGER) AS alarm_minutes,
               product, colour, row_type = 'cal' AS has_basket_row,
               CASE WHEN row_type = 'damage' THEN CAST(round_even(CAST(amount AS DECIMAL(18,4)) * 1.17, 2) AS DOUBLE) END AS bill_sum,
               row_type IS NULL AS rejected FROM u""",
    "f17_valid_characters": r"""
        WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)
        SELECT doc_id, CASE WHEN length(t) = 0 THEN 0.0::DOUBLE
               ELSE length(regexp_replace(t, '[^\x{0590}-\x{05FF}A-Za-z0-9\s.,;:!?()\[\]{}\-–"''/\\%&@#*+=°₪$]', '', 'g')) / length(t) END AS ratio
        FROM t""",
    "f18_markup_text": r"""
        WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '''''''(.+?)''''''', '\1', 'gs'), '''''(.+?)''''', '\1', 'gs') AS t FROM pages),
        b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '<[^>\n]{0,80}>', '', 'g'),
              '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM a)
        SELECT page_id, CAST(length(t) AS INTEGER) AS chars, md5(t) AS digest FROM b""",
    "f19_first_rule": """
        SELECT conv_id, turn, CASE WHEN contains(text, 'tion') AND contains(text, 'ing ') THEN 'both' WHEN contains(text, 'tion') THEN 'tion'
               WHEN contains(text, 'que ') OR contains(text, 'der ') THEN 'que' WHEN contains(text, 'la ') THEN 'la' ELSE 'other' END AS label
        FROM conversations""",
    "f20_document_class": "WITH s AS (SELECT doc_id, "
    + ", ".join(f"{sql} AS {name}" for name, sql in _SCORES.items())
    + " FROM documents), m AS (SELECT *, greatest("
    + ", ".join(_SCORES)
    + ") AS top FROM s) SELECT doc_id, CASE WHEN top = 0 OR "
    + " + ".join(f"CAST({n} = top AS INTEGER)" for n in _SCORES)
    + " > 1 THEN 'unknown' "
    + " ".join(f"WHEN {n} = top THEN '{n}'" for n in _SCORES)
    + " END AS label, CASE WHEN top = 0 THEN 'no hit' WHEN "
    + " + ".join(f"CAST({n} = top AS INTEGER)" for n in _SCORES)
    + " > 1 THEN 'conflict' ELSE 'found' END AS state, CASE WHEN top = 0 OR "
    + " + ".join(f"CAST({n} = top AS INTEGER)" for n in _SCORES)
    + " > 1 THEN NULL "
    + " ".join(f"WHEN {n} = top THEN '{f}'" for n, f in LANGUAGE_FOLDERS.items())
    + " END AS folder FROM m",
    "f20_case_documents": f"""
        WITH k AS (SELECT doc_id, doc_id % {len(fv.DOCUMENT_CLASSES)} AS c FROM documents)
        SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'unknown' WHEN doc_id % 5 = 0 AND c <> 0 THEN 'unknown'
                            ELSE ({inputs.sql_list(list(fv.DOCUMENT_CLASSES))})[CAST(c + 1 AS INTEGER)] END AS label,
               CASE WHEN doc_id % 7 = 0 THEN 'no hit' WHEN doc_id % 5 = 0 AND c <> 0 THEN 'conflict' ELSE 'found' END AS state,
               CASE WHEN doc_id % 7 = 0 OR (doc_id % 5 = 0 AND c <> 0) THEN NULL
                    ELSE ({inputs.sql_list([fv.CLASS_FOLDERS[c] for c in fv.DOCUMENT_CLASSES])})[CAST(c + 1 AS INTEGER)] END AS folder FROM k""",
    "f23_question_lint": """
        WITH q AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || '?' ELSE text END AS q FROM conversations)
        SELECT conv_id, turn, array_to_string(list_filter([
            CASE WHEN length(q) > 200 THEN 'too_long' END, CASE WHEN NOT ends_with(rtrim(q), '?') THEN 'no_question_mark' END,
            CASE WHEN regexp_matches(q, '[0-9]') THEN 'has_digits' END,
            CASE WHEN turn % 14 <> 1 AND (contains(q, 'tionth') OR contains(q, 'eaux')) THEN 'names_court' END,
            CASE WHEN length(q) - length(replace(q, '?', '')) > 1 THEN 'more_than_one' END,
            CASE WHEN turn % 14 NOT BETWEEN 1 AND 12 THEN 'unknown_template' END], lambda v: v IS NOT NULL), ',') AS violations,
          """
    + "CASE turn % 14 " + " ".join(f"WHEN {k} THEN {a + b + c}" for k, (a, b, c, _, _) in fv.QUESTION_TEMPLATES.items()) + " END AS passages, "
    + "CASE turn % 14 " + " ".join(f"WHEN {k} THEN {str(x).lower()}" for k, (_, _, _, x, _) in fv.QUESTION_TEMPLATES.items()) + " END AS analyse FROM q",
    "f28_planted_text": r"""
        WITH p AS (SELECT doc_id, (length(text) - length(replace(text, 'Licensed under the Apache License, Version 2.0.', '')))
                            // length('Licensed under the Apache License, Version 2.0.')
                          + (length(text) - length(replace(text, 'Released under the MIT License.', ''))) // length('Released under the MIT License.') AS planted,
                          replace(replace(text, 'Licensed under the Apache License, Version 2.0.', ''), 'Released under the MIT License.', '') AS t
                   FROM documents)
        SELECT doc_id, CAST(planted AS INTEGER) AS planted,
               CAST(len(regexp_extract_all(t, '\p{L}\d{1,2}($|[\s.,;:])')) AS INTEGER) AS footnote_digits,
               md5(regexp_replace(t, '(\p{L})\d{1,2}($|[\s.,;:])', '\1\2', 'g')) AS digest FROM p""",
    "f30_word_drift": f"""
        WITH {inputs.LINES}, k AS (SELECT doc_key, pos, {_KEY.format('text')} AS a,
             {_KEY.format("CASE WHEN pos % 3 = 0 THEN text || ' one two' ELSE text END")} AS b FROM lines),
        c AS (SELECT doc_key, pos, CASE WHEN a = '' THEN 0 ELSE len(string_split(a, ' ')) END AS before,
                     CASE WHEN b = '' THEN 0 ELSE len(string_split(b, ' ')) END AS "after" FROM k)
        SELECT doc_key, CAST(pos AS INTEGER) AS pos, CAST(before AS INTEGER) AS before, CAST("after" AS INTEGER) AS "after"
        FROM c WHERE before > 0 AND abs("after" - before) / before > 0.1""",
}
