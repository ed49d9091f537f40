"""SimHash near-duplicates found with BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import texts, whole_runs, written
from docketry.llm.graph import components, spanning

RADIUS = 4
SHINGLE = 4
SEED = 42
BLOCKS = 6  # a link leaves at least BLOCKS - RADIUS blocks of the fingerprint equal
TREE_ROWS = 4096  # nodes of a shard's tree, about
PROBES = 4096  # fingerprints that search a tree at once

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the hashes of the word shingles."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    n = len(words)
    whole = b" ".join(words)
    if n <= size:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[: n - size]]).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n - size + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` of every whole text; a null text has no words and the fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts(batch, "t"):
                found = np.array([fingerprint(part.text(k), size) for k in range(part.n)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), pa.array(found)], ["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("t")).mapInArrow(run, "doc_id long, fp long")


class Forest:
    """BK-trees, one per shard, grown level by level.

    Every point is a node. A child hangs on its parent by the edge labelled with their
    distance, and a parent has one child per label. ``points`` must be sorted by
    ``tree`` and distinct within it.
    """

    def __init__(self, points: np.ndarray, tree: np.ndarray):
        self.points = points
        first = np.ones(len(tree), bool)
        first[1:] = tree[1:] != tree[:-1]
        self.roots = np.flatnonzero(first)  # of the trees in turn
        at = np.repeat(self.roots, np.diff([*self.roots, len(tree)]))
        live = np.flatnonzero(~first)
        at = at[live]
        keys, nodes = [], []
        while len(live):
            edge = at * 65 + np.bitwise_count(points[live] ^ points[at]).astype(np.int64)
            key, lead, back = np.unique(edge, return_index=True, return_inverse=True)
            node = live[lead]
            keys.append(key)
            nodes.append(node)
            at = node[back]
            rest = at != live
            live, at = live[rest], at[rest]
        order = np.argsort(np.concatenate(keys), kind="stable") if keys else np.zeros(0, np.int64)
        self.edges = np.concatenate(keys)[order] if keys else np.zeros(0, np.int64)
        self.children = np.concatenate(nodes)[order] if nodes else np.zeros(0, np.int64)

    def near(self, probes: np.ndarray, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a probe's number and a node at most ``radius`` away, in the probe's tree."""
        which, found = [], []
        for begin in range(0, len(probes), PROBES):
            probe = np.arange(begin, min(begin + PROBES, len(probes)))
            node = self.roots[tree[probe]]
            while len(probe):
                away = np.bitwise_count(probes[probe] ^ self.points[node]).astype(np.int64)
                hit = away <= radius
                which.append(probe[hit])
                found.append(node[hit])
                low = np.searchsorted(self.edges, node * 65 + np.maximum(away - radius, 0))
                high = np.searchsorted(self.edges, node * 65 + np.minimum(away + radius, 64), "right")
                n = high - low
                probe = np.repeat(probe, n)
                step = np.arange(len(probe)) - np.repeat(np.cumsum(n) - n, n)
                node = self.children[np.repeat(low, n) + step]
        return np.concatenate(which) if which else np.zeros(0, np.int64), np.concatenate(found) if found else np.zeros(0, np.int64)


def _masks(blocks: int, kept: int) -> list[int]:
    """Bit masks of all choices of ``kept`` out of ``blocks`` nearly equal blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    one = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(one, kept)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Edges ``u, v`` that connect the distinct fingerprints ``fp`` exactly as all links within ``radius`` do.

    Two linked fingerprints agree on at least ``blocks - radius`` blocks, so they meet
    in the shard of one such choice of blocks and its bits. A shard's tree is sent only
    to the fingerprints that share the shard. A shard of more than ``tree_rows`` is
    cut into trees of about that many, and every part searches each tree once. From a
    shard come the edges of a spanning forest, never all pairs.
    """
    masks = _masks(blocks, blocks - radius)
    choices = F.array(*[F.struct(F.lit(k).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("bits")) for k, x in enumerate(masks)])
    placed = distinct.select("fp", F.explode(choices).alias("s")).select("fp", "s.m", "s.bits")
    sizes = placed.groupBy("m", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / tree_rows).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int")
    shared = placed.join(sizes.withColumn("parts", parts), ["m", "bits"]).withColumn("mine", mine)
    # every part is a tree for itself and the later parts, and searches the earlier trees
    units = shared.withColumn(
        "unit", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, "mine").alias("a"), F.greatest(k, "mine").alias("b"))))
    )
    key = F.xxhash64("m", "bits", "unit.a", "unit.b")
    rows = units.select(key.alias("unit"), F.col("mine").alias("part"), "m", "bits", "fp")

    wide = np.array(masks, np.uint64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "unit", 20_000):
            unit, part, m, bits, fp = (table.column(c).to_numpy() for c in ("unit", "part", "m", "bits", "fp"))
            order = np.lexsort((part, bits, m, unit))  # units whose keys collide fall apart here
            unit, part, m, bits, fp = (x[order] for x in (unit, part, m, bits, fp.view(np.uint64)))
            opens = np.ones(len(unit), bool)
            opens[1:] = (unit[1:] != unit[:-1]) | (m[1:] != m[:-1]) | (bits[1:] != bits[:-1])
            group = np.cumsum(opens) - 1
            treed = part == part[np.flatnonzero(opens)][group]  # the first part of a unit is its tree
            forest = Forest(fp[treed], group[treed])
            place = np.flatnonzero(treed)
            alone = treed[np.concatenate([np.flatnonzero(opens)[1:] - 1, [len(unit) - 1]])][group]  # no other part: search itself
            probes = np.flatnonzero(~treed | alone)
            which, node = forest.near(fp[probes], group[probes], radius)
            u, v = probes[which], place[node]
            u, v = u[u != v], v[u != v]
            differ, chosen = fp[u] ^ fp[v], m[u]
            first = np.ones(len(u), bool)  # each link counts in the first shard it could be found in
            for k in range(len(wide)):
                first &= (chosen <= k) | ((differ & wide[k]) != 0)
            label = spanning(len(fp), u[first], v[first])
            moved = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[label[moved]].view(np.int64))], ["u", "v"])

    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "unit").sortWithinPartitions("unit").mapInArrow(search, "u long, v long")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Components of documents whose fingerprints differ in at most ``radius`` bits.

    Returns ``doc_id, fingerprint, component_id`` for every row; the component is named
    by its smallest id. A null text and one without words have fingerprint zero and
    link like any other; rows with equal ids are one document; a null id names a
    component only if it has no other (then the component is null); an empty table
    gives no rows; other columns are ignored.

    Equal fingerprints are one node from the start, so copies cost nothing later.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = written(rooted.join(named, "root").select("fp", "component_id"), "names")
    return rows.join(names, "fp").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
