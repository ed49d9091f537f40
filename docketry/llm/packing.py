"""Best-fit packing of token sequences, merged as a tree of residual bins."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import tasks_for, written

LENGTH = 2048
END = 0  # id that ends a document
TOKENIZER = "byte_bpe_50k.json"
BATCH_BYTES = 1 << 20  # of text encoded at once
FULL = 2040  # tokens from which a bin is emitted without meeting others
FAN_IN_BINS = 50_000  # bins a merging task takes on average
ROUNDS = 8  # merging rounds at most; what is left then is emitted as it is
GAIN = 0.02  # share of the bins that a round must save for another to follow

# Code points on which the two encoders are tested to agree; texts with others go to the slower one.
_COMMON = re.compile("[^\x00-ɏ‐-‧‰-⁞]")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as the tokenizer file gives them.

    The file's vocabulary is in merge order, so the same ids come from a byte-pair
    encoder over its ranks, several times faster. Texts with a special token's string
    or with characters outside the common ones go through the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        special = {x["content"] for x in said["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        letter = self._bytes()
        ranks = {bytes(letter[c] for c in word): k for word, k in said["model"]["vocab"].items() if word not in special}
        import public_tokenizers

        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _bytes() -> dict[str, int]:
        """The byte that each letter of a byte-level vocabulary stands for."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(shown)]
        return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}

    def ids(self, text: str) -> list[int]:
        if _COMMON.search(text) or self.special.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pieces_of(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids; only the first may be shorter when there are several."""
    first = n % length or length
    return [(0, n)] if n <= length else [(0, first), *((s, length) for s in range(first, n, length))]


class Bins:
    """Best fit: an item goes to the fullest bin that still has room for it.

    Bins wait in one stack per free space; a bit mask of the spaces in use finds the
    smallest that is enough.
    """

    def __init__(self, length: int = LENGTH):
        self.length, self.spaces, self.stacks = length, 0, [[] for _ in range(length + 1)]
        self.members: list[list] = []

    def put(self, item, size: int) -> None:
        enough = self.spaces >> size
        if enough:
            space = size + (enough & -enough).bit_length() - 1
            k = self.stacks[space].pop()
            if not self.stacks[space]:
                self.spaces ^= 1 << space
            self.members[k].append((item, self.length - space))
        else:
            space, k = self.length, len(self.members)
            self.members.append([(item, 0)])
        left = space - size
        if left:
            self.spaces |= 1 << left
            self.stacks[left].append(k)


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Bins of ``(item, offset)``, items taken from the longest down."""
    bins = Bins(length)
    for k in np.argsort(-sizes, kind="stable").tolist():
        bins.put(k, int(sizes[k]))
    return bins.members


MEMBER = "array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"
BIN = f"sequence_id long, total long, full boolean, members {MEMBER}"
_MEMBER_TYPE = pa.list_(
    pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
)


def _bin_batch(names: list[int], bins: list[list[tuple]], full: list[bool]) -> pa.RecordBatch:
    rows = [[dict(zip(("doc_id", "piece", "start", "length", "ids_crc32", "offset"), m, strict=True)) for m in b] for b in bins]
    totals = [sum(m[3] for m in b) for b in bins]
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.int64()), pa.array(totals, pa.int64()), pa.array(full), pa.array(rows, _MEMBER_TYPE)],
        ["sequence_id", "total", "full", "members"],
    )


class _Names:
    """Sequence numbers that no other round or task gives; a repeated task gives the same."""

    def __init__(self, step: int):
        self.next = (step << 57) | (TaskContext.get().partitionId() << 33)

    def take(self, n: int) -> list[int]:
        self.next += n
        return list(range(self.next - n, self.next))


def _emit(names: _Names, bins: list[list[tuple]], limit: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(bins), 2000):
        part = bins[at : at + 2000]
        yield _bin_batch(names.take(len(part)), part, [sum(m[3] for m in b) >= limit for b in part])


def _local(docs: DataFrame, path: str, length: int, full: int, at_once: int) -> DataFrame:
    """Encode, cut and best-fit inside every partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, names = Encoder(path), _Names(0)
        short: list[tuple] = []
        whole: list[list[tuple]] = []
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encoder.ids(text.as_py() or ""), END], "<u4")
                for k, (start, size) in enumerate(pieces_of(len(ids), length)):
                    piece = (name, k, start, size, zlib.crc32(ids[start : start + size].tobytes()))
                    if size == length:
                        whole.append([(*piece, 0)])
                    else:
                        short.append(piece)
            if len(whole) >= 2000:
                yield from _emit(names, whole, full)
                whole = []
            if len(short) >= at_once:
                yield from _emit(names, _packed(short, length), full)
                short = []
        yield from _emit(names, whole + _packed(short, length), full)

    return docs.mapInArrow(run, BIN)


def _packed(pieces: list[tuple], length: int) -> list[list[tuple]]:
    sizes = np.array([p[3] for p in pieces], np.int64)
    return [[(*pieces[k], offset) for k, offset in b] for b in best_fit(sizes, length)]


def _merged(bins: DataFrame, step: int, length: int, full: int, at_once: int) -> DataFrame:
    """Best-fit underfull bins as items; the members of a merged bin move by its offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names(step)
        held: list[list[dict]] = []

        def join(held: list[list[dict]]) -> list[list[tuple]]:
            sizes = np.array([sum(m["length"] for m in b) for b in held], np.int64)
            return [
                [(m["doc_id"], m["piece"], m["start"], m["length"], m["ids_crc32"], m["offset"] + base) for k, base in b for m in held[k]]
                for b in best_fit(sizes, length)
            ]

        for batch in batches:
            held += batch.column(batch.schema.get_field_index("members")).to_pylist()
            if len(held) >= at_once:
                yield from _emit(names, join(held), full)
                held = []
        yield from _emit(names, join(held), full)

    return bins.mapInArrow(run, BIN)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH,
    full: int = FULL, fan_in: int = FAN_IN_BINS,
) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` tokens, one row per sequence.

    Returns ``sequence_id, total, members``; a member is a piece of a document with
    its place, its length, its ids' CRC-32 and its offset in the sequence. A document
    is its ids and an end id; only longer ones are cut, and only their first piece may
    be short. A null text counts as empty and still takes its end id; rows with equal
    ids are packed one by one, a null id stays null; an empty table gives no rows; other
    columns are ignored.

    Partitions pack on their own and emit bins of ``full`` tokens or more. Underfull
    bins go up a tree as items, about ``fan_in`` to a task, until a round saves less
    than a fiftieth of them; then the rest is emitted. Tasks hold at most
    ``4 * fan_in`` items at once.
    """
    path = path or tokenizer_path()
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("t"))
    done, at_once = [], 4 * fan_in
    level = written(_local(plain, path, length, full, at_once), "bins-0")
    for step in range(1, ROUNDS + 1):
        left = level.where(~F.col("full"))
        n = left.count()
        done.append(level.where("full"))
        if not n:
            break
        tasks = tasks_for(n, fan_in)
        level = written(_merged(left.repartition(tasks), step, length, full, at_once), f"bins-{step}")
        if level.count() > n * (1 - GAIN) or tasks == 1 or step == ROUNDS:
            done.append(level)
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("sequence_id", "total", "members")


def packed_pieces(docs: DataFrame, **options) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``; see ``pack``."""
    return pack(docs, **options).select("sequence_id", F.explode("members").alias("m")).select("m.*", "sequence_id").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def packed_sequences(
    docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH
) -> DataFrame:
    """The token ids of every sequence, ``sequence_id, ids``, for a table of pieces whose document ids are unique."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = [*encoder.ids(text.as_py() or ""), END]
                cut = pieces_of(len(ids), length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(cut), pa.int64()), pa.array(range(len(cut)), pa.int32()), pa.array([ids[s : s + n] for s, n in cut], pa.list_(pa.int32()))],
                    ["doc_id", "piece", "ids"],
                )

    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("t"))
    tokens = plain.mapInArrow(run, "doc_id long, piece int, ids array<int>")
    placed = plan.select("doc_id", "piece", "sequence_id", "offset").join(tokens, ["doc_id", "piece"])
    ordered = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return ordered.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
