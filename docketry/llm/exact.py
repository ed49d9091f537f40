"""Exact duplicates by counting quotient filters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import SPACE_PATTERN, kept_rows, tasks_for, text_keys, whole_runs, written

SEGMENT_ROWS = 1 << 16  # fingerprints a merged filter segment holds on average


class QuotientFilter:
    """A counting quotient filter over 64-bit fingerprints.

    A fingerprint is cut into a quotient (its top bits) and a remainder (the rest).
    Slots hold remainders sorted inside their quotient's run; ``occupied`` marks the
    quotients that have a run and ``runends`` the last slot of each run, so nothing
    is lost: fingerprints and counts can be read back exactly, and two filters merge
    by merging their sorted remainders. Counts above one are kept beside the slots
    that have them.
    """

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray, top: int, shift: int = 0):
        """``fingerprints`` sorted and distinct, all sharing their first ``shift`` bits; ``top`` quotient bits follow."""
        self.top, self.shift, self.n = top, shift, len(fingerprints)
        bits = 64 - shift - top
        body = fingerprints & np.uint64((1 << (64 - shift)) - 1)
        quotients = (body >> np.uint64(bits)).astype(np.int64)
        self.prefix = int(fingerprints[0] >> np.uint64(64 - shift)) if self.n and shift else 0
        occupied = np.zeros(1 << top, bool)
        occupied[quotients] = True
        runends = np.ones(self.n, bool)
        runends[:-1] = quotients[1:] != quotients[:-1]
        self.occupied, self.runends = np.packbits(occupied), np.packbits(runends)
        width = -(-bits // 8)
        remainders = body & np.uint64((1 << bits) - 1)
        self.remainders = remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        many = np.flatnonzero(counts > 1)
        self.slots, self.counts = many.astype(np.uint32), counts[many].astype(np.int64)

    def to_bytes(self) -> bytes:
        head = np.array([self.top, self.shift, self.n, self.prefix, len(self.slots)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.occupied, self.runends, self.slots, self.counts)) + self.remainders

    @staticmethod
    def read(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints, sorted, and their counts."""
        top, shift, n, prefix, many = np.frombuffer(raw, np.int64, 5).tolist()
        at = 40
        parts = []
        for kind, size in ((np.uint8, -(-(1 << top) // 8)), (np.uint8, -(-n // 8)), (np.uint32, many), (np.int64, many)):
            parts.append(np.frombuffer(raw, kind, size, at))
            at += size * np.dtype(kind).itemsize
        bits = 64 - shift - top
        width = -(-bits // 8)
        remainders = np.zeros((n, 8), np.uint8)
        remainders[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
        runends = np.unpackbits(parts[1], count=n).astype(np.int64)
        runs = np.flatnonzero(np.unpackbits(parts[0], count=1 << top))  # quotient of the k-th run
        quotients = runs[np.cumsum(runends) - runends].astype(np.uint64)
        found = remainders.view("<u8").reshape(n).astype(np.uint64) | (quotients << np.uint64(bits))
        if shift:
            found |= np.uint64(prefix) << np.uint64(64 - shift)
        counts = np.ones(n, np.int64)
        counts[parts[2]] = parts[3]
        return found, counts


def merged(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All fingerprints of some filters of one segment, with summed counts."""
    read = [QuotientFilter.read(x) for x in filters]
    keys, back = np.unique(np.concatenate([k for k, _ in read]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, back, np.concatenate([c for _, c in read]))
    return keys, counts


def _top_bits(n: int) -> int:
    return max(1, math.ceil(math.log2(max(2, n))))


def repeated_fingerprints(fingerprints: DataFrame, column: str, n_rows: int) -> DataFrame:
    """Fingerprints (64-bit longs) that occur twice or more, as a column of the same name.

    Every partition builds filters, one per segment of the fingerprint space; equal
    fingerprints are counted there before anything moves, so a hot one sends one
    slot a partition. Segments meet by their number and are merged.
    """
    shift = max(0, math.ceil(math.log2(max(1, n_rows) / SEGMENT_ROWS)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = [np.asarray(b.column(0)).astype(np.int64).view(np.uint64) for b in batches]
        if not values:
            return
        keys, counts = np.unique(np.concatenate(values), return_counts=True)
        segment = (keys >> np.uint64(64 - shift)).astype(np.int64) if shift else np.zeros(len(keys), np.int64)
        cuts = np.flatnonzero(np.diff(segment, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            made = QuotientFilter(keys[a:b], counts[a:b], min(_top_bits(b - a), 64 - shift), shift)
            yield pa.RecordBatch.from_arrays([pa.array([segment[a]]), pa.array([made.to_bytes()])], ["segment", "filter"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "segment", 1):
            segments = table.column("segment").to_numpy()
            cuts = np.flatnonzero(np.diff(segments, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(segments)], strict=True):
                keys, counts = merged(table.column("filter").slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(keys[counts > 1].view(np.int64))], [column])

    filters = fingerprints.select(column).mapInArrow(build, "segment long, filter binary")
    tasks = min(1 << shift, tasks_for(n_rows, SEGMENT_ROWS))
    return filters.repartition(tasks, "segment").sortWithinPartitions("segment").mapInArrow(merge, f"{column} long")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row's ``doc_id, sha, key, again, row``, with its group's ``group_size`` and ``first`` row if it has any equal."""
    text = F.regexp_replace(F.coalesce(docs[text_col], F.lit("")), SPACE_PATTERN, " ")
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), *text_keys(docs[text_col]), text.alias("norm")).withColumn("fp", F.xxhash64("norm"))
    digest = written(
        plain.select("doc_id", "key", "again", "fp", F.sha2("norm", 256).alias("sha"), F.monotonically_increasing_id().alias("row")), "digest"
    )
    repeated = written(repeated_fingerprints(digest, "fp", digest.count()), "repeated")
    # ``repeated`` is a written table of true size: it is copied to the tasks while that is under the optimizer's limit
    suspects = plain.select("fp", "norm").join(repeated, "fp", "left_semi")
    equal = (  # by bytes; a hash collision falls apart into groups of one
        # not grouped by fingerprint too: that would keep the rows of the join, and a hot text's copies, in one task
        suspects.groupBy("norm").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
        .select(F.sha2("norm", 256).alias("sha"), "group_size")
    )
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    first = digest.join(repeated, "fp", "left_semi").groupBy("sha").agg(F.min(order).alias("first"))
    groups = written(equal.join(first, "sha"), "groups")
    return digest.join(groups, "sha", "left")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts that are identical once every run of white space is one space.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256`` for every row. A null
    text counts as empty. Of a group the smallest id stays, a null id after all
    others; of repeated rows of that id exactly one has ``kept``. Other columns of
    ``docs`` are ignored. An empty table gives an empty result.

    Fingerprints go through the filters; only texts whose fingerprint counts above one
    are grouped by their bytes, and only there can two texts be called equal.
    """
    own = F.col("first").isNull()
    return _grouped(docs, id_col, text_col).select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (own | (F.col("row") == F.col("first.row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; see ``exact_duplicates``.

    Only the keys of rows that go, or that repeat one that stays, are looked up; no text
    moves while they are under the optimizer's limit.
    """
    equal = _grouped(docs, id_col, text_col).where("first is not null").withColumn("kept", F.col("row") == F.col("first.row"))
    return kept_rows(docs, equal.select("doc_id", "key", "again", "kept"), id_col, text_col)
