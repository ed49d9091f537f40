"""Repeated passages across documents, found behind a count-min prefilter.

1. *Profile.* One pass over the texts keeps each document's word count, the SHA-256 of
   its words and the hashes of its windows. A window hashes to the smallest hash of the
   short word runs inside it, so neighbouring windows share most of their hashes, and
   equal windows always have the same one.
2. *Sketch.* Every partition counts the documents of each hash in a count-min sketch: several
   rows of counters, in each of which a hash has a counter of its own choosing. A row is far wider than a
   partition fills, so it travels as its non-zero counters, cut into blocks of columns; sketches are merged by adding up
   a block's counters. A hash's estimate is the smallest of its counters, and never below the number of
   documents that have it. A hash that one partition has in two documents is settled there; one that it has in one
   document asks the first row's blocks, once a partition, so a hot passage sends no more than that, and what passes asks the
   other rows. The width follows the number of hashes, so the share that passes for nothing does not grow.
3. *Exact pass.* Only windows estimated in two documents or more are grouped, by two
   independent 64-bit hashes of their whole word sequence, which counts as exact.

Exact copies are one document until the end.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import SPACE_PATTERN, Texts, mixed, span_hashes, texts, whole_runs, written

WINDOW = 50  # words
RUN = 6  # words of the short runs a window's hash is chosen from
SKETCH_ROWS = 3
CELLS_PER_HASH = 4  # counters of a row for each hash counted; at 1 - exp(-1 / 4) a row, one hash in a hundred passes all three for nothing
BLOCK_BITS = 21  # counters of a block, as a power of two
SKETCH_HASHES = 1 << 21  # hashes after which a partition starts another sketch
_SECOND = np.uint64(0xD6E8FEB86659FD93)
_ROW_STEP = 0x9E3779B97F4A7C15
_SETTLED = -1  # stands in for a row of the sketch
_NO_ID = (1 << 63) - 1  # stands for a null id, after all others

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:]) if step < len(values) else values[:0]
        have += step
    return values


def windows(part: Texts, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and of every window its first word, its text and its sketch hash."""
    part.words()
    hashes = part.word_hashes()
    n = len(hashes)
    owner = np.repeat(np.arange(part.n), np.diff(part.bounds))
    none = np.zeros(0, np.int64)
    if n < window:
        return hashes, none, none, none.astype(np.uint64)
    run = min(RUN, window)
    places = np.arange(n - run + 1)
    runs = span_hashes(hashes, places, places + run)
    least = _smallest(runs, window - run + 1)
    starts = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    return hashes, starts, owner[starts], mixed(least[starts] ^ _SECOND)  # a minimum is small; spread it over all cells


def profile(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id, n_words, sha, hashes``: the distinct window hashes of every text as packed 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts(batch, "t"):
                _, _, owner, least = windows(part, window)
                fresh = np.ones(len(least), bool)
                fresh[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
                owner, least = owner[fresh], least[fresh]
                limits = np.searchsorted(owner, np.arange(part.n + 1))
                shas = [hashlib.sha256(b" ".join(part.text(k).split())).hexdigest() for k in range(part.n)]
                packed = [np.unique(least[a:b]).tobytes() for a, b in zip(limits[:-1], limits[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.n), pa.array(np.diff(part.bounds)), pa.array(shas), pa.array(packed, pa.binary())],
                    ["doc_id", "n_words", "sha", "hashes"],
                )

    return docs.mapInArrow(run, "doc_id long, n_words long, sha string, hashes binary")


def counters(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of every hash in a row of the sketch. The first row's follow the order of the hashes."""
    if row:
        values = mixed(values ^ np.uint64(_ROW_STEP * row & (1 << 64) - 1))
    return values >> np.uint64(64 - bits)


def repeated_hashes(profiles: DataFrame, n_hashes: int) -> DataFrame:
    """``doc_id, hashes``: of every document, those of its hashes that are estimated in two documents or more."""
    bits = max(BLOCK_BITS, math.ceil(math.log2(max(2, CELLS_PER_HASH * n_hashes))))
    wide = 1 << BLOCK_BITS

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, hashes, held = [], [], 0
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(raw.as_py(), np.uint64)
                docs.append(np.full(len(own), name, np.int64))
                hashes.append(own)
                held += len(own)
                if held >= SKETCH_HASHES:
                    yield from one_sketch(np.concatenate(docs), np.concatenate(hashes))
                    docs, hashes, held = [], [], 0
        if docs:
            yield from one_sketch(np.concatenate(docs), np.concatenate(hashes))

    def one_sketch(doc: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Blocks of every row: counters at one, and those at two or more. In the first row the hashes that ask stand for the former."""
        order = np.argsort(value, kind="stable")  # the first row's counters and blocks come in order too
        doc, value = doc[order], value[order]
        opens = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        times = np.diff([*opens, len(value)])
        often = np.repeat(times > 1, times)
        if often.any():
            yield _blocks(_SETTLED, [0], [value[often]], [doc[often]])  # whatever the others have
        for row in range(SKETCH_ROWS):
            counter = counters(value, row, bits)
            place = np.arange(len(counter)) if row == 0 else np.argsort(counter, kind="stable")
            counter = counter[place]
            first = np.flatnonzero(np.concatenate([[True], counter[1:] != counter[:-1]]))
            n = np.diff([*first, len(counter)])
            block = (counter[first] >> np.uint64(BLOCK_BITS)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            names, ones, more = [], [], []
            for a, b in zip(cuts, [*cuts[1:], len(block)], strict=True):
                once, many = first[a:b][n[a:b] == 1], first[a:b][n[a:b] > 1]
                names.append(block[a])
                if row == 0:
                    asking = np.flatnonzero(~often[first[a] : first[b - 1] + n[b - 1]]) + first[a]
                    ones.append(value[asking])
                    more.append((doc[asking], (counter[many] & np.uint64(wide - 1)).astype(np.uint32)))
                else:
                    ones.append((counter[once] & np.uint64(wide - 1)).astype(np.uint32))
                    more.append((counter[many] & np.uint64(wide - 1)).astype(np.uint32))
                if len(names) >= 1000:
                    yield _blocks(row, names, ones, more)
                    names, ones, more = [], [], []
            if names:
                yield _blocks(row, names, ones, more)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "run", 64):
            names, row = table.column("run").to_numpy(), table.column("row").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            for a, b in zip(cuts, [*cuts[1:], len(names)], strict=True):
                part = table.slice(a, b - a)
                ones, docs, more = ([x.as_py() for x in part.column(c)] for c in ("ones", "docs", "more"))
                many = np.frombuffer(b"".join(more), np.uint32)
                if row[a] > 0:
                    total = np.bincount(np.frombuffer(b"".join(ones), np.uint32), minlength=wide) + 2 * np.bincount(many, minlength=wide)
                    at = np.flatnonzero(total > 1) + (int(part.column("block")[0].as_py()) << BLOCK_BITS)
                    yield _passed(row[a], np.full(len(at), -1), at, None)
                    continue
                value, doc = np.frombuffer(b"".join(ones), np.uint64), np.frombuffer(b"".join(docs), np.int64)
                if row[a] == 0:
                    own = (counters(value, 0, bits) & np.uint64(wide - 1)).astype(np.int64)
                    # a hash that asks has added one; counters at two or more in a partition add two, those that ask included
                    total = np.bincount(own, minlength=wide) + 2 * np.bincount(many, minlength=wide)
                    value, doc = value[total[own] > 1], doc[total[own] > 1]
                others = np.stack([counters(value, r, bits) for r in range(1, SKETCH_ROWS)], axis=1) if SKETCH_ROWS > 1 else np.zeros((len(value), 0))
                yield _passed(row[a], doc, value.view(np.int64), others.astype(np.int64))

    tasks = int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = profiles.select("doc_id", "hashes").mapInArrow(sketch, "row int, block long, salt int, ones binary, docs binary, more binary")
    dealt = sent.repartition(tasks, "row", "block", "salt").withColumn("run", F.col("row") * F.lit(1 << 48) + F.col("block"))
    passed = written(dealt.sortWithinPartitions("run").mapInArrow(merge, "row int, doc_id long, value long, others array<long>"), "estimates")
    asked = passed.where("row = 0").select("doc_id", "value", "others")
    for r in range(1, SKETCH_ROWS):
        full = passed.where(F.col("row") == r).select(F.col("value").alias("counter"))
        asked = asked.join(full, F.get("others", F.lit(r - 1)) == F.col("counter"), "left_semi")
    settled = passed.where(F.col("row") == _SETTLED).select("doc_id", "value")
    return asked.select("doc_id", "value").unionByName(settled).groupBy("doc_id").agg(F.collect_list("value").alias("hashes"))


def _passed(row: int, doc: np.ndarray, value: np.ndarray, others: np.ndarray | None) -> pa.RecordBatch:
    n = len(value)
    each = np.zeros((n, 0), np.int64) if others is None else others
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * each.shape[1], pa.int32()), pa.array(each.reshape(-1).astype(np.int64)))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, row, np.int32)), pa.array(doc.astype(np.int64)), pa.array(value.astype(np.int64)), lists], ["row", "doc_id", "value", "others"]
    )


def _blocks(row: int, blocks: list, ones: list, more: list) -> pa.RecordBatch:
    from pyspark import TaskContext

    salt = TaskContext.get().partitionId() if row == _SETTLED else 0  # settled rows go anywhere
    n = len(blocks)
    if row == _SETTLED:
        docs, many = more, [b""] * n
    else:
        docs, many = ([d for d, _ in more], [m for _, m in more]) if row == 0 else ([b""] * n, more)
    pack = lambda xs: pa.array([x if isinstance(x, bytes) else x.tobytes() for x in xs], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, row, np.int32)), pa.array(np.array(blocks, np.int64)), pa.array(np.full(n, salt, np.int32)), pack(ones), pack(docs), pack(many)],
        ["row", "block", "salt", "ones", "docs", "more"],
    )


def _candidates(part: Texts, wanted: list, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows whose hash is wanted in their text: text, first word, and both exact hashes."""
    hashes, starts, owner, least = windows(part, window)
    limits = np.searchsorted(owner, np.arange(part.n + 1))
    keep = np.zeros(len(starts), bool)
    for k, (a, b) in enumerate(zip(limits[:-1], limits[1:], strict=True)):
        if b > a:
            keep[a:b] = np.isin(least[a:b], wanted[k])
    starts, owner = starts[keep], owner[keep]
    one = span_hashes(hashes, starts, starts + window)
    two = span_hashes(mixed(hashes ^ _SECOND), starts, starts + window)
    return owner, starts - part.bounds[owner], one.view(np.int64), two.view(np.int64)


def repeated_words(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Where every text repeats earlier documents.

    Returns two tables: one row per input row with ``doc_id, n_words, sha, first_id``
    (``first_id``: smallest id with the same words), and ``doc_id, sha, t, starts`` with
    the first words of the windows that a document with a smaller id has too, for the
    first documents of equal words that have such windows.
    """
    plain = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("t"))
    profiles = written(profile(plain, window), "profile")
    firsts = written(profiles.groupBy("sha").agg(F.min("doc_id").alias("first_id")), "firsts")  # or a hot text's rows would stay in one task
    rows = written(profiles.select("doc_id", "n_words", "sha").join(firsts, "sha"), "classes")
    long_firsts = rows.where((F.col("doc_id") == F.col("first_id")) & (F.col("n_words") >= window)).select("doc_id", "sha").distinct()
    alone = profiles.join(long_firsts.hint("shuffle_hash"), ["doc_id", "sha"], "left_semi").dropDuplicates(["doc_id", "sha"])
    n_hashes = profiles.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    hot = repeated_hashes(alone, n_hashes // 8)
    asked = hot.join(long_firsts, "doc_id")  # small tables meet first, so the texts are dealt out once
    found = plain.join(asked.hint("shuffle_hash"), "doc_id")
    own = F.sha2(F.trim(F.regexp_replace("t", SPACE_PATTERN, " ")), 256)  # rows may share an id but not the text
    suspects = written(found.where(F.col("sha") == own).withColumn("row", F.monotonically_increasing_id()), "suspects")

    def listed(batch: pa.RecordBatch) -> list:
        return [np.array(x.as_py(), np.int64).view(np.uint64) for x in batch.column(batch.schema.get_field_index("hashes"))]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each window once a batch, with the smallest and largest id that has it there."""
        for batch in batches:
            wanted, ids = listed(batch), np.asarray(batch.column(0))
            got = [(ids[o + p.first], a, b) for p in texts(batch, "t") for o, _, a, b in [_candidates(p, wanted[p.first : p.last], window)]]
            if not got:
                continue
            doc, one, two = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((doc, two, one))
            doc, one, two = doc[order], one[order], two[order]
            opens = np.ones(len(doc), bool)
            opens[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            at = np.flatnonzero(opens)
            last = np.concatenate([at[1:] - 1, [len(doc) - 1]]) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one[at], two[at], doc[at], doc[last])], ["one", "two", "low", "high"])

    gathered = suspects.select("doc_id", "t", "hashes").mapInArrow(gather, "one long, two long, low long, high long")
    shared = gathered.groupBy("one", "two").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("one", "two", "low")
    shared = written(shared, "shared")  # else the join below would keep a hot window's places in the task that grouped it

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, ids, rows_of = listed(batch), np.asarray(batch.column(0)), np.asarray(batch.column(3))
            for p in texts(batch, "t"):
                o, start, one, two = _candidates(p, wanted[p.first : p.last], window)
                columns = (rows_of[o + p.first], ids[o + p.first], start.astype(np.int64), one, two)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["row", "doc_id", "start", "one", "two"])

    placed = suspects.select("doc_id", "t", "hashes", "row").mapInArrow(places, "row long, doc_id long, start long, one long, two long")
    repeats = placed.join(shared, ["one", "two"]).where("low < doc_id").groupBy("row").agg(F.collect_list("start").alias("starts"))
    return rows, suspects.select("row", "doc_id", "sha", "t").join(repeats, "row").drop("row")


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of every text when passages of ``window`` words that an earlier document has are removed.

    Returns ``doc_id, n_words, n_removed, kept_sha256`` for every row, and the kept words
    joined by one space as ``kept_text`` for texts that lost some but not all (null else,
    where the text itself or nothing is left). Windows are judged on the input. A null
    text has no words. "Earlier" is by id; equal ids are not earlier than each other and a
    null id comes after all others, so repeated rows keep their words. An empty table
    gives no rows; other columns are ignored. Ids are expected to name one text; rows
    that share an id but not the text are judged by their own text against other ids.
    """
    rows, repeats = repeated_words(docs, window, id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = batch.column(2)[k].as_py().encode().split()
                starts = np.array(batch.column(3)[k].as_py(), np.int64)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([int(gone.sum())]), pa.array([hashlib.sha256(kept).hexdigest()]), pa.array([kept.decode()])],
                    ["doc_id", "sha", "n_cut", "cut_sha", "kept_text"],
                )

    done = repeats.select("doc_id", "sha", "t", "starts").mapInArrow(cut, "doc_id long, sha string, n_cut long, cut_sha string, kept_text string")
    done = done.dropDuplicates(["doc_id", "sha"])  # repeated rows
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= window)
    return rows.join(done, ["doc_id", "sha"], "left").select(
        F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(~copy, F.col("kept_text")).alias("kept_text"),
    )
