"""Text and reference matching between two sides."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.arrays import let, matches
from docketry.functions.edits import edit_distance
from docketry.functions.partners import Partners
from docketry.functions.text import block_ratio, comparison_key
from docketry.operators.joining import shuffled
from docketry.session import cut_lineage


# --- similarity joins -------------------------------------------------------

def similar_pairs(left: DataFrame, right: DataFrame, keys: list[str], threshold: float, metric: str = "edit") -> DataFrame:
    """Pairs of rows with equal ``keys`` whose ``text`` is at least ``threshold`` alike.

    Both sides have the keys, ``row`` and ``text``; the result has the keys,
    ``row``, ``other`` (the right row) and ``score``. A score this high forces
    the right length into the few length bands around the left one, so the band joins the keys:
    a hot key is spread over its bands, and pairs that differ too much in
    length never meet. Only pairs that pass leave the join. Exact: no partner
    above the threshold is lost. A left row may bring a higher threshold of its own, ``least``, and then has fewer bands.
    """
    def shortest(asked: Column) -> Column:
        return asked if metric == "edit" else asked / (2 - asked)

    width = F.log(1 / shortest(F.lit(threshold)))

    def band(size: Column, slack: float = 0.0) -> Column:
        return F.floor(F.log(size) / width + slack).cast("int")

    least = ["least"] if "least" in left.columns else []
    asked = shortest(F.col("least") if least else F.lit(threshold))
    size = F.greatest(F.length("text"), F.lit(1)).cast("double")
    # the slack is far above the rounding of a logarithm and far below the step of a length
    reach = F.sequence(band(size * asked, -1e-7), band(size / asked, 1e-7))
    a = left.select(*keys, F.col("row"), F.col("text").alias("ta"), *least, F.explode(reach).alias("band"))
    b = right.select(*keys, F.col("row").alias("other"), F.col("text").alias("tb"), band(size).alias("band"))
    met = a.join(shuffled(b), [*keys, "band"])
    return measured(met, threshold, metric, long=True).select(*keys, "row", "other", "score")


def measured(pairs: DataFrame, threshold: float, metric: str = "edit", long: bool = False) -> DataFrame:
    """The pairs of texts ``ta`` and ``tb`` that are at least ``threshold`` alike, with their ``score``.

    The edit distance with an upper limit works on a narrow band, and only pairs within it get a score of matching
    blocks. Pairs may bring a higher threshold of their own, ``least``, which narrows the band. With ``long``, for texts
    of any length, distances of long texts are worked out a column at a time (``functions/edits.py``).
    """
    la, lb = F.length("ta"), F.length("tb")
    small, large = F.least(la, lb), F.greatest(la, lb)
    asked = F.col("least") if "least" in pairs.columns else F.lit(threshold)
    shortest = asked if metric == "edit" else asked / (2 - asked)
    # Matching blocks leave at most (1 - t)(a + b) characters to edit.
    limit = F.floor((large if metric == "edit" else la + lb) * (1 - asked)).cast("int") + 1
    met = pairs.filter(small >= F.floor(large * shortest))
    if long:
        near = met.withColumn("edits", edit_distance(F.col("ta"), F.col("tb"), limit)).filter("edits >= 0")
    else:
        # Exploding the filtered one-element array computes the distance once per pair.
        distance = F.call_function("levenshtein", F.col("ta"), F.col("tb"), limit)
        near = met.withColumn("edits", F.explode(F.filter(F.array(distance), lambda x: x >= 0)))
    if metric == "edit":
        score = F.when(large == 0, F.lit(1.0)).otherwise(F.lit(1) - F.col("edits") / large)
    else:
        score = block_ratio("ta", "tb")
    return near.withColumn("score", score).filter(F.col("score") >= asked).drop("edits")


def _digest(text: Column) -> list[Column]:
    """128 bits that stand for a text in joins and groups."""
    return [F.xxhash64(text).alias("d1"), F.xxhash64(text, F.lit(1)).alias("d2")]


DIGEST = ["d1", "d2"]
SEED_WORDS = 3
SEEDS = 4


def _seeds(text: Column) -> Column:
    """The smallest hashes of a text's runs of three words: texts that are much alike have some in common."""
    def runs(words: Column) -> Column:
        last = F.greatest(F.lit(0), F.size(words) - SEED_WORDS)
        # reads just these elements; a slice unpacks all words of the text every time
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.xxhash64(F.concat_ws(" ", *[F.get(words, k + i) for i in range(SEED_WORDS)])))

    return F.slice(F.sort_array(F.array_distinct(let(F.split(text, " "), runs))), 1, SEEDS)


def _seeded(left: DataFrame, targets: DataFrame, keys: list[str], threshold: float, metric: str) -> DataFrame:
    """Every left row with the target that shares most of its seeds, ``(keys, row, other, score)``, if it is alike enough.

    Of the targets that have a seed one is looked up, so a frequent seed makes no pairs; texts are fetched for
    the one pair of a row.
    """
    held = targets.select(*keys, F.explode(_seeds(F.col("text"))).alias("seed"), "row").groupBy(*keys, "seed").agg(F.min("row").alias("other"))
    asked = left.select(*keys, F.explode(_seeds(F.col("text"))).alias("seed"), "row")
    shared = asked.join(shuffled(held), [*keys, "seed"]).groupBy(*keys, "row", "other").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy(*keys, "row").agg(F.max(F.struct("n", "other")).alias("m")).select(*keys, "row", "m.other")
    pairs = left.select(*keys, "row", F.col("text").alias("ta")).join(shuffled(best), [*keys, "row"])
    pairs = pairs.join(shuffled(targets.select(*keys, F.col("row").alias("other"), F.col("text").alias("tb"))), [*keys, "other"])
    return measured(pairs, threshold, metric, long=True).select(*keys, "row", "other", "score")


def _targets(right: DataFrame, keys: list[str]) -> DataFrame:
    """Each text of a key once, with its smallest row."""
    digested = right.select(*keys, "row", "text", *_digest(F.col("text")))
    return digested.groupBy(*keys, *DIGEST).agg(F.min("row").alias("row"), F.any_value("text").alias("text"))


ROWS_A_GROUP = 4_096  # rows of both sides with one key that a task compares by itself
CHARACTERS_A_GROUP = 1 << 24


def _heavy_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys with too many rows or characters for one task, if there are any; few, as each has so many rows."""
    sizes = left.select(*keys, F.length("text").alias("n")).unionByName(right.select(*keys, F.length("text").alias("n"))).groupBy(*keys)
    many = sizes.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("chars")).filter(
        (F.col("rows") > ROWS_A_GROUP) | (F.col("chars") > CHARACTERS_A_GROUP)
    )
    heavy = cut_lineage(many.select(*keys).dropna())
    return None if heavy.isEmpty() else F.broadcast(heavy)


def _dealt(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both sides by key, each key's right rows first, in the order of ``row``."""
    whole = right.dropna(subset=keys).select(*keys, "row", "text", F.lit(False).alias("__left"))
    both = left.select(*keys, "row", "text", F.lit(True).alias("__left")).unionByName(whole)
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(tasks, *keys).sortWithinPartitions(*keys, "__left", "row")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], threshold: float, metric: str, any_one: bool) -> Iterator[tuple[pa.Table, list, list]]:
    """Of every batch its table, the numbers of the left rows, and what each has found among its key's right rows."""
    at, partners = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        own = list(zip(*(table.column(c).to_pylist() for c in keys), strict=True))
        rows, texts = table.column("row").to_pylist(), table.column("text").to_pylist()
        numbers, asked = [], []
        for k, left in enumerate(table.column("__left").to_pylist()):
            if partners is None or own[k] != at:
                at, partners = own[k], Partners(threshold, metric, any_one)
            if left:
                numbers.append(k)
                asked.append(partners.ask(texts[k]))
            else:
                partners.add(rows[k], texts[k])
        Partners.settle(asked)
        if numbers:
            yield table, numbers, asked


def best_partner(
    left: DataFrame, right: DataFrame, keys: list[str], threshold: float, metric: str = "edit", texts: bool = False
) -> DataFrame:
    """Every left row with its most alike right row, or nulls when none reaches ``threshold``.

    Rows of a key are shuffled once and compared in one task: equal texts first, then the one that shares most seeds, whose score
    becomes the row's own threshold, then all whose length allows as much; distances stay in a narrow band. Keys with too many rows for a
    task go through a similarity join instead. Ties go to the smallest right row. With ``texts`` a left row comes with the
    text of every right row that has its partner's ``row``, as ``partner``.
    """
    heavy = _heavy_keys(left, right, keys)
    if heavy is not None:
        hot = _joined_partner(left.join(heavy, keys, "left_semi"), right.join(heavy, keys, "left_semi"), keys, threshold, metric)
        if texts:
            partner = right.join(heavy, keys, "left_semi").select(*keys, F.col("row").alias("other"), F.col("text").alias("partner"))
            hot = hot.join(shuffled(partner), [*keys, "other"], "left")
        left, right = left.join(heavy, keys, "left_anti"), right.join(heavy, keys, "left_anti")
    dealt = _dealt(left, right, keys)
    names = [*keys, "row", "text"]
    schema = dealt.select(*names, F.col("row").alias("other"), F.lit(1.0).alias("score"), F.array("text").alias("partners")).schema
    for field in schema.fields:
        field.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, numbers, asked in _groups(batches, keys, threshold, metric, False):
            at = pa.array(numbers, pa.int64())
            columns = [table.column(c).take(at) for c in names]
            columns.append(pa.array([a.other for a in asked], table.schema.field("row").type))
            columns.append(pa.array([a.score for a in asked], pa.float64()))
            columns.append(pa.array([a.texts if texts else None for a in asked], pa.list_(pa.string())))
            yield from pa.table(columns, names=[*names, "other", "score", "partners"]).to_batches()

    found = dealt.mapInArrow(run, schema)
    out = [*names, "other", "score"]
    if texts:
        found = found.select(*out, F.explode_outer("partners").alias("partner"))
        out.append("partner")
    return found.select(*out) if heavy is None else found.select(*out).unionByName(hot.select(*out))


def _joined_partner(left: DataFrame, right: DataFrame, keys: list[str], threshold: float, metric: str) -> DataFrame:
    """``best_partner`` for keys of any number of rows.

    Equal texts are matched first, by digests. Then rows that share a seed are measured, a few for each
    row, and the score found becomes the row's own threshold in the similarity join, whose distances then stay in a
    narrow band; it finds whatever is as good or better.
    """
    targets = cut_lineage(_targets(right, keys))
    same = targets.select(*keys, *DIGEST, F.col("row").alias("same"))
    marked = cut_lineage(left.select(*keys, "row", "text", *_digest(F.col("text"))).join(shuffled(same), [*keys, *DIGEST], "left").drop(*DIGEST))
    rest = marked.filter(F.col("same").isNull()).select(*keys, "row", "text")
    found = _seeded(rest, targets, keys, threshold, metric).groupBy(*keys, "row").agg(F.max("score").alias("least"))
    asked = cut_lineage(rest.join(shuffled(found), [*keys, "row"], "left").withColumn("least", F.coalesce("least", F.lit(threshold))))
    scored = similar_pairs(asked, targets, keys, threshold, metric)
    best = scored.groupBy(*keys, "row").agg(F.min(F.struct((-F.col("score")).alias("neg"), "other")).alias("m"))
    return marked.join(shuffled(best), [*keys, "row"], "left").select(
        *keys,
        "row",
        "text",
        F.coalesce("same", F.col("m.other")).alias("other"),
        F.when(F.col("same").isNotNull(), F.lit(1.0)).otherwise(-F.col("m.neg")).alias("score"),
    )


def without_partner(left: DataFrame, right: DataFrame, keys: list[str], threshold: float, metric: str = "edit") -> DataFrame:
    """Left rows that no right row reaches ``threshold`` with; a row needs no second look once one does."""
    heavy = _heavy_keys(left, right, keys)
    if heavy is not None:
        hot = _joined_without_partner(left.join(heavy, keys, "left_semi"), right.join(heavy, keys, "left_semi"), keys, threshold, metric)
        left, right = left.join(heavy, keys, "left_anti"), right.join(heavy, keys, "left_anti")
    dealt = _dealt(left, right, keys)
    names = [*keys, "row", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, numbers, asked in _groups(batches, keys, threshold, metric, True):
            at = pa.array([k for k, a in zip(numbers, asked, strict=True) if a.score is None], pa.int64())
            yield from pa.table([table.column(c).take(at) for c in names], names=names).to_batches()

    found = dealt.mapInArrow(run, dealt.select(*names).schema)
    return found if heavy is None else found.unionByName(hot.select(*names))


def _joined_without_partner(left: DataFrame, right: DataFrame, keys: list[str], threshold: float, metric: str) -> DataFrame:
    """``without_partner`` for keys of any number of rows."""
    targets = cut_lineage(_targets(right, keys))
    digested = left.select("*", *_digest(F.col("text")))
    rest = cut_lineage(digested.join(shuffled(targets.select(*keys, *DIGEST)), [*keys, *DIGEST], "left_anti").drop(*DIGEST))
    seeded = _seeded(rest, targets, keys, threshold, metric).select(*keys, "row").distinct()
    left_over = cut_lineage(rest.join(shuffled(seeded), [*keys, "row"], "left_anti"))
    met = similar_pairs(left_over, targets, keys, threshold, metric).select(*keys, "row").distinct()
    return left_over.join(shuffled(met), [*keys, "row"], "left_anti")


# --- references -------------------------------------------------------------

def reconcile(used: DataFrame, declared: DataFrame, keys: list[str], ref: str) -> DataFrame:
    """Each reference of each group: ``matched``, ``orphaned`` (used only) or ``missing`` (declared only)."""
    u = used.select(*keys, ref).distinct().withColumn("u", F.lit(True))
    d = declared.select(*keys, ref).distinct().withColumn("d", F.lit(True))
    side = F.when(F.col("d").isNull(), "orphaned").when(F.col("u").isNull(), "missing").otherwise("matched")
    return u.join(shuffled(d), [*keys, ref], "full").select(*keys, ref, side.alias("side"))


def first_hits(hits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per ``keys``: the hit that comes first in ``order``."""
    rest = [c for c in hits.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("m")
    return hits.groupBy(*keys).agg(first).select(*keys, "m.*")


def valid_groups(sides: DataFrame, keys: list[str]) -> DataFrame:
    return sides.groupBy(*keys).agg(
        F.count_if(F.col("side") == "orphaned").alias("orphaned"),
        F.count_if(F.col("side") == "missing").alias("missing"),
        F.bool_and(F.col("side") == "matched").alias("is_valid"),
    )


def case_number_key(text: Column) -> Column:
    """Digits of a case number without leading zeros."""
    return F.regexp_replace(F.regexp_replace(text, r"[^0-9/\-]", ""), r"^0+(?=\d)", "")


def two_sources(a: DataFrame, b: DataFrame, number: str) -> DataFrame:
    """Full reconciliation of two result lists on the normalized case number."""
    left = a.select(case_number_key(F.col(number)).alias("case_key")).distinct().withColumn("in_a", F.lit(True))
    right = b.select(case_number_key(F.col(number)).alias("case_key")).distinct().withColumn("in_b", F.lit(True))
    status = F.when(F.col("in_b").isNull(), "only A").when(F.col("in_a").isNull(), "only B").otherwise("both")
    return left.join(right, "case_key", "full").select("case_key", status.alias("provenance"))


def uncovered_citations(drafts: DataFrame, key: str, text: str, pattern: str, holdings: DataFrame, number: str) -> DataFrame:
    """Case numbers written in a draft that no holding carries."""
    cited = drafts.select(key, F.explode(matches(F.col(text), pattern)).alias("cited"))
    keyed = cited.withColumn("case_key", case_number_key(F.col("cited"))).select(key, "case_key").distinct()
    known = holdings.select(case_number_key(F.col(number).cast("string")).alias("case_key")).distinct()
    return keyed.join(known, "case_key", "left_anti").select(key, "case_key")


# --- quotes -----------------------------------------------------------------

def quotes_kept(old: DataFrame, new: DataFrame, keys: list[str], threshold: float, metric: str = "blocks") -> DataFrame:
    """Each quote of the old side as ``same``, ``near`` or ``lost`` among the new side's quotes of its group.

    ``(keys, row, text)`` on both sides, texts in comparison form.
    """
    matched = best_partner(old, new, keys, threshold, metric)
    state = F.when(F.col("score").isNull(), "lost").when(F.col("score") < 1.0, "near").otherwise("same")
    return matched.select(*keys, "row", "text", "score", state.alias("state"))


def quotes_in_source(quotes: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Whether each quote stands word for word in its own source.

    A quote with an ellipsis is checked segment by segment. The source text is
    compared inside the join and does not travel with the result; a null
    ``found`` means there is no source to check against.
    """
    wanted = quotes.withColumn("__q", comparison_key(F.col("quote")))
    held = sources.select(key, comparison_key(F.col("text")).alias("__s"))
    segments = F.filter(
        F.transform(F.split("__q", r"\.\.\.|…"), lambda s: F.trim(s)), lambda s: F.length(s) > 0
    )
    found = F.when(
        F.col("__s").isNotNull(), F.forall(segments, lambda s: F.contains(F.col("__s"), s))
    )
    return wanted.join(shuffled(held), key, "left").select(*quotes.columns, found.alias("found"))
