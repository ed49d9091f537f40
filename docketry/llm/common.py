"""Helpers the text operators share: written cuts, id hashes, vectorised words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.session import scratch_path

FILTER_BITS = 25
CHUNK_BYTES = 1 << 21  # of text that numpy works on at once; one longer text is worked on alone

# The white space bytes of the contracts, 0x20 and 0x09 to 0x0D.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SPACE = np.zeros(256, bool)
SPACE[list(SPACE_BYTES)] = True
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"

_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back.

    Cuts the lineage, survives lost executors, and gives the optimizer true sizes.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_keys(text: Column) -> list[Column]:
    """``key`` and ``again``: two hashes of a text, 128 bits together; a null text has hashes of its own."""
    return [F.xxhash64(text).alias("key"), F.xxhash64(text, F.lit(1)).alias("again")]


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def key_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of ``2 ** bits`` bits, 4 MB, with the hashed place of every key set. Its size does not grow with the keys."""
    at = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    words = keys.select(F.shiftright(at, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("set"))
    got = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got.column("word").to_numpy()] = got.column("set").to_numpy()
    return out


def may_hold(df: DataFrame, key: Column, bitmap: np.ndarray) -> Column:
    """False where the key is certainly not among those of the bitmap.

    Keeps rows that have no partner out of a shuffle. The more keys there are, the more rows pass for nothing; then as many
    move as without it, and the result is the same.
    """
    held = df.sparkSession.sparkContext.broadcast(bitmap)
    bits = int(len(bitmap)).bit_length() + 5

    @F.arrow_udf("boolean")
    def test(at: pa.Array) -> pa.Array:
        place = at.to_numpy()
        return pa.array((held.value[place >> 6] >> (place & 63)) & 1 == 1)

    return test(F.pmod(F.xxhash64(key), F.lit(1 << bits)))


def kept_rows(docs: DataFrame, judged: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``judged`` (``doc_id, key, again, kept``) keeps or does not name, with their own columns.

    Rows equal in id and text share a key; where some of them are kept, one is. Only rows whose text may be one of
    those that go, or that repeat one that stays, move to meet their keys.
    """
    out = docs.columns
    keys = [unused(docs, name) for name in ("marked_id", "marked_key", "marked_again")]
    counted = judged.groupBy("doc_id", "key", "again").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    marks = counted.where("not kept or n > 1").select(*[F.col(c).alias(k) for c, k in zip(("doc_id", "key", "again"), keys, strict=True)], "kept")
    marks = written(marks, "marks")
    possible = may_hold(docs, text_keys(docs[text_col])[0], key_filter(marks, keys[1]))

    def same(rows: DataFrame, named: DataFrame) -> Column:
        first, again = text_keys(rows[text_col])
        return rows[id_col].cast("long").eqNullSafe(named[keys[0]]) & (first == named[keys[1]]) & (again == named[keys[2]])

    moved = docs.where(possible)
    left = docs.where(~possible).unionByName(moved.join(marks.hint("merge"), same(docs, marks), "left_anti"))
    repeated = marks.where("kept").select(*keys)
    if repeated.isEmpty():
        return left.select(*out)
    once = moved.join(repeated.hint("merge"), same(docs, repeated)).dropDuplicates(keys)
    return left.select(*out).unionByName(once.select(*[docs[c] for c in out]))


def id_remainder(column: Column, modulus: int) -> Column:
    """CRC-32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def tasks_for(rows: int, rows_a_task: int) -> int:
    return max(1, -(-rows // rows_a_task))


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words under which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
INVERSE = pow(BASE, -1, 1 << 64)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of ``values[start:end]``, equal for equal sequences anywhere."""
    n = len(values)
    if not n or not len(starts):
        return np.zeros(len(starts), np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(BASE, n), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(INVERSE, n)[np.minimum(starts, n - 1)])


class Texts:
    """Some whole texts of an Arrow batch as one byte array.

    ``offsets`` has one entry more than there are texts; ``first`` and ``last`` are
    the rows of the batch. A null text has no bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int):
        self.data, self.offsets, self.first, self.last = data, offsets, first, last

    @property
    def n(self) -> int:
        return self.last - self.first

    def words(self) -> None:
        """Find the words: ``starts`` and ``ends`` in bytes, ``bounds`` of each text's words."""
        inside = ~SPACE[self.data]
        n = len(inside)
        opens, closes = inside.copy(), inside.copy()
        if n:
            cuts = self.offsets[(self.offsets > 0) & (self.offsets < n)]
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            opens[cuts] = inside[cuts]
            closes[cuts - 1] = inside[cuts - 1]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def word_hashes(self) -> np.ndarray:
        return span_hashes(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends)

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def word_sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per word over each text."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def texts(batch: pa.RecordBatch, name: str, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The texts of a batch in pieces of about ``limit`` bytes, each text whole."""
    column = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return
    _, places, content = column.buffers()
    offsets = np.frombuffer(places, np.int32, n + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    if column.null_count:  # bytes under a null are not part of the text
        gone = np.asarray(column.is_null())
        if (np.diff(offsets)[gone] > 0).any():
            yield from texts(pa.RecordBatch.from_arrays([column.fill_null("")], [name]), name, limit)
            return
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield Texts(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first, last)
        first = last


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, at_least: int) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys from batches sorted by ``key``, each of ``at_least`` rows or the last."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < at_least:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if cut:
            yield table.slice(0, cut)
            held, rows = table.slice(cut).combine_chunks().to_batches(), len(keys) - cut
        else:
            held, rows = table.combine_chunks().to_batches(), 0  # one run so far: wait for as many rows again
    if held:
        yield pa.Table.from_batches(held)
