"""Near copies by the Jaccard similarity of whole texts' word shingles: SimHash classes by BK-trees and min-hash bands for candidates, exact counts for links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import Texts, kept_rows, key_filter, may_hold, mixed, span_hashes, text_keys, texts, whole_runs, written
from docketry.llm.graph import components
from docketry.llm.simhash import RADIUS
from docketry.llm.simhash import links as fingerprint_links

SHINGLE = 5
SIMILAR_PERCENT = 80
BANDS = 40  # a pair meets in one with 1 - (1 - s ** BAND_HASHES) ** BANDS: all but 5 in a million at similarity 0.8
BAND_HASHES = 6
SALTS = 64  # units that the partners of one node are dealt over
PART_ROWS = 512  # sets that one part of a group holds, about
PART_SHINGLES = 1 << 18  # and the shingles of them
PART_BITS = 1 << 15  # hashes whose bits are counted at once
PIECE = 1 << 18  # bytes of text numpy works on at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(part: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word shingles of every text, sorted within it, and each text's limits in them.

    A text of fewer words than ``size`` has one shingle, one without words has none. ASCII letters are folded.
    """
    part = Texts(_LOWER[part.data], part.offsets, part.first, part.last)
    part.words()
    n = np.diff(part.bounds)
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    limits = np.concatenate([[0], np.cumsum(many)])
    begin = np.repeat(part.bounds[:-1], many) + np.arange(limits[-1]) - np.repeat(limits[:-1], many)
    value = span_hashes(part.word_hashes(), begin, np.minimum(begin + size, np.repeat(part.bounds[1:], many)))
    sets = [np.unique(value[a:b]) for a, b in zip(limits, limits[1:], strict=False)]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def set_hashes(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """One hash per set; 0 for an empty one."""
    return np.where(np.diff(limits) > 0, span_hashes(values, limits[:-1], limits[1:]), np.uint64(0))


def band_keys(values: np.ndarray, limits: np.ndarray, bands: int = BANDS, hashes: int = BAND_HASHES) -> np.ndarray:
    """A row of ``bands`` keys for every set that is not empty."""
    starts = limits[:-1][np.diff(limits) > 0]
    short = (values >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(17)  # fixed: the keys must agree between tasks
    turn = rng.integers(0, 1 << 32, (bands, hashes), np.uint32)
    factor = rng.integers(0, 1 << 32, (bands, hashes), np.uint32) | np.uint32(1)
    out = np.zeros((len(starts), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(starts), band, np.uint64)
        for k in range(hashes):
            least = np.minimum.reduceat((short ^ turn[band, k]) * factor[band, k], starts) if len(starts) else np.zeros(0, np.uint32)
            key = mixed(key * np.uint64(0x100000001B3) ^ least.astype(np.uint64))
        out[:, band] = key
    return out


def set_fingerprints(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """64 bits per set, each set if it is set in over half of the shingles' hashes; 0 for an empty set."""
    out = np.zeros(len(limits) - 1, np.uint64)
    for k, (a, b) in enumerate(zip(limits, limits[1:], strict=False)):
        total = np.zeros(64, np.int64)
        for at in range(a, b, PART_BITS):
            part = values[at : min(at + PART_BITS, b)].astype("<u8")
            total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * total > b - a, bitorder="little").view("<u8")[0]
    return out


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``doc_id, key, again, node, fp, bands`` of every row: two hashes of the text, its shingle set's hash, fingerprint and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts(batch, "t", PIECE):
                values, limits = shingle_sets(part, size)
                keys = band_keys(values, limits)
                places = np.concatenate([[0], np.cumsum(np.diff(limits) > 0)]) * BANDS
                bands = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                own = batch.slice(part.first, part.n)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(0), own.column(1), own.column(2), pa.array(set_hashes(values, limits).view(np.int64)),
                        pa.array(set_fingerprints(values, limits).view(np.int64)), bands,
                    ],
                    ["doc_id", "key", "again", "node", "fp", "bands"],
                )

    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), *text_keys(docs[text_col]), docs[text_col].alias("t"))
    return plain.mapInArrow(run, "doc_id long, key long, again long, node long, fp long, bands array<long>")


def fingerprint_keys(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``node, band``: one key for all nodes (``node, fp, bands``) whose fingerprints the BK-trees of ``simhash`` put in one component.

    A set without shingles has none.
    """
    prints = nodes.where(F.size("bands") > 0).select("node", "fp")
    roots = components(fingerprint_links(written(prints.select("fp").distinct(), "fingerprints"), radius))
    classed = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return classed.select("node", F.xxhash64(F.coalesce("root", "fp"), F.lit("fingerprint")).alias("band"))


def placed_nodes(nodes: DataFrame) -> DataFrame:
    """``node, band, weight`` of every node under every key that another node has too: its fingerprint's component and its bands.

    The weight is the number of nodes met under all keys: an original has more of it than its copies, which differ
    from each other more than from it.
    """
    classes = written(fingerprint_keys(nodes), "classes")
    every = nodes.select("node", F.explode("bands").alias("band")).unionByName(classes)
    sizes = written(every.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band-sizes")
    shared = every.where(may_hold(every, F.col("band"), key_filter(sizes, "band")))
    met = written(shared.join(sizes.hint("merge"), "band"), "met")
    return written(met.join(met.groupBy("node").agg(F.sum("n").alias("weight")), "node").select("node", "band", "weight"), "placed")


def star_pairs(placed: DataFrame) -> DataFrame:
    """Pairs ``u, v``, once each: the nodes of every band key with the heaviest of them."""
    centres = placed.groupBy("band").agg(F.max(F.struct("weight", "node")).alias("heaviest"))
    return placed.join(centres, "band").select(F.col("node").alias("u"), F.col("heaviest.node").alias("v")).where("u != v").distinct()


def member_sets(docs: DataFrame, members: DataFrame, text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``node, shingles`` of every member (``key, node``), once, from the texts; no other text moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts(batch, "t", PIECE):
                values, limits = shingle_sets(part, size)
                own = batch.slice(part.first, part.n)
                sets = pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), pa.array(values.view(np.int64)))
                out = pa.RecordBatch.from_arrays([own.column(0), sets], ["node", "shingles"])
                # another text whose hash collides has another set
                yield out.filter(pa.array(set_hashes(values, limits).view(np.int64) == own.column(0).to_numpy()))

    plain = docs.select(text_keys(docs[text_col])[0], docs[text_col].alias("t"))
    plain = plain.where(may_hold(plain, F.col("key"), key_filter(members, "key"))).join(members.hint("merge"), "key")
    return plain.select("node", "t").mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int = SIMILAR_PERCENT, salts: int = SALTS) -> DataFrame:
    """The pairs ``u, v`` whose sets have that similarity. A pair sends the set of ``u`` once.

    The pairs of one ``v`` are dealt over up to ``salts`` units, each of which gets its set first and then reads the
    others' as a stream, so a node with any number of partners fills no task.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(salts)).cast("int"))
    lead = salted.select("v", "salt").distinct().join(sets, F.col("v") == F.col("node"))
    rest = salted.join(sets, F.col("u") == F.col("node"))
    rows = lead.select("v", "salt", F.lit(None).cast("long").alias("u"), "shingles").unionByName(rest.select("v", "salt", "u", "shingles"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.zeros(0, np.uint64)
        for batch in batches:
            v, u, column = batch.column(0).to_numpy(), batch.column(2), batch.column(3)
            values, n = column.flatten().to_numpy().view(np.uint64), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            limits = np.concatenate([[0], np.cumsum(n)])
            heads = np.flatnonzero(np.asarray(u.is_null()))
            near = np.zeros(batch.num_rows, bool)
            for a, b in zip([0, *heads + 1], [*heads, batch.num_rows], strict=True):
                if a:
                    lead = values[limits[a - 1] : limits[a]].copy()
                if a < b:
                    own = values[limits[a] : limits[b]]
                    hit = lead[np.minimum(np.searchsorted(lead, own), len(lead) - 1)] == own
                    both = np.diff(np.concatenate([[0], np.cumsum(hit)])[limits[a : b + 1] - limits[a]])
                    near[a:b] = 100 * both >= percent * (n[a:b] + len(lead) - both)
            yield pa.RecordBatch.from_arrays([u.filter(pa.array(near)), pa.array(v[near])], ["u", "v"])

    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(tasks, "v", "salt").sortWithinPartitions("v", "salt", F.col("u").asc_nulls_first())
    return ordered.mapInArrow(search, "u long, v long")


def similar(sets: list[np.ndarray], treed: np.ndarray, label: np.ndarray, percent: int = SIMILAR_PERCENT) -> np.ndarray:
    """Labels of the sets' components, under those they have and the links of ``treed`` sets with the others, or with each other if all are."""
    tree = np.flatnonzero(treed)
    label = label.copy()
    sizes = np.array([len(x) for x in sets], np.int64)
    token, code = np.unique(np.concatenate([sets[k] for k in tree]), return_inverse=True)
    order = np.argsort(code, kind="stable")
    owner = np.repeat(np.arange(len(tree)), sizes[tree])[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(token)))])
    for k in range(len(sets)) if treed.all() else np.flatnonzero(~treed):
        if (label[tree] == label[k]).all():
            if (label == label[k]).all():
                break
            continue
        at = np.minimum(np.searchsorted(token, sets[k]), len(token) - 1)
        at = at[token[at] == sets[k]]
        n = first[at + 1] - first[at]
        places = np.arange(n.sum()) + np.repeat(first[at] - (np.cumsum(n) - n), n)
        both = np.bincount(owner[places], minlength=len(tree))
        linked = tree[100 * both >= percent * (sizes[tree] + sizes[k] - both)]
        joined = np.unique(label[[k, *linked]])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    return label


def unsettled(placed: DataFrame, roots: DataFrame) -> DataFrame:
    """``unit, node, root``, once each: nodes of the band keys under which three or more lie in different components.

    Two nodes of one key have been compared with each other. The unit is the component that most nodes of the
    key are in, so keys of the same copies share their unit and a node comes to it once.
    """
    rooted = placed.join(roots, "node", "left").select("node", "band", F.coalesce("root", "node").alias("root"))
    per_root = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    top = F.max(F.struct(F.col("n"), (-F.col("root")).alias("least"))).alias("top")
    groups = per_root.groupBy("band").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("roots"), top).where("roots > 1 and all > 2")
    units = groups.select(F.col("band").alias("of_band"), (-F.col("top.least")).alias("unit"))
    return rooted.join(units, F.col("band") == F.col("of_band")).select("unit", "node", "root").distinct()


def links(
    units: DataFrame, sets: DataFrame, percent: int = SIMILAR_PERCENT, part_rows: int = PART_ROWS, part_shingles: int = PART_SHINGLES
) -> DataFrame:
    """Edges ``u, v`` that connect the components of a unit (``unit, node, root``) exactly as all pairs of ``percent`` similarity do.

    A unit's own component and the nodes outside it are cut into parts; every two parts outside meet, and each of them meets
    every part of the component, whose own parts have nothing to settle. Only nodes of different components are compared,
    and what comes out are the edges of a spanning forest, never all pairs.
    """
    members = units.withColumn("own", F.col("root") == F.col("unit")).join(sets.select("node", F.size("shingles").alias("m")), "node")

    def parts(own: Column) -> Column:
        n, held = F.count_if(own), F.coalesce(F.sum(F.when(own, F.col("m"))), F.lit(0))
        return F.ceil(F.greatest(n / part_rows, F.least(n, held / part_shingles))).cast("int")

    sizes = members.groupBy("unit").agg(parts(F.col("own")).alias("inside"), parts(~F.col("own")).alias("outside"))
    dealt = members.join(sizes, "unit").withColumn(
        "mine", F.pmod(F.xxhash64("node"), F.when(F.col("own"), F.col("inside")).otherwise(F.col("outside")).cast("long")).cast("int")
    )
    none = F.array().cast("array<struct<a:int,b:int>>")  # parts outside count from 0, those of the component down from -1

    def numbers(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def cell(a: Column, b: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"))

    with_outside = F.transform(numbers(F.col("outside")), lambda k: cell(F.least(k, "mine"), F.greatest(k, "mine")))
    with_inside = F.transform(numbers(F.col("inside")), lambda k: cell(-1 - k, F.col("mine")))
    cells_of_own = F.transform(numbers(F.col("outside")), lambda k: cell(-1 - F.col("mine"), k))
    every = F.when(F.col("own"), cells_of_own).otherwise(F.concat(none, with_outside, with_inside))
    met = dealt.withColumn("cell", F.explode(every))
    part = F.when(F.col("own"), -1 - F.col("mine")).otherwise(F.col("mine"))
    cells = met.select(F.xxhash64("unit", "cell.a", "cell.b").alias("cell"), "unit", part.alias("part"), "node", "root")
    rows = cells.join(sets, "node").select("cell", "unit", "part", "node", "root", "shingles")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "cell", 1000):
            column = table.column("shingles").combine_chunks()
            values, limits = column.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            cell, unit, part, node, root = (table.column(c).to_numpy() for c in ("cell", "unit", "part", "node", "root"))
            order = np.lexsort((node, part, unit, cell))  # cells whose keys collide fall apart here, if their units differ
            edge = np.flatnonzero((np.diff(cell[order], prepend=cell[order[0]] ^ 1) != 0) | (np.diff(unit[order], prepend=unit[order[0]] ^ 1) != 0))
            u, v = [], []
            for a, b in zip(edge, [*edge[1:], len(order)], strict=True):
                at = order[a:b]
                known, label = np.unique(root[at], return_inverse=True)
                if len(known) > 1:
                    found = similar([values[limits[k] : limits[k + 1]] for k in at], part[at] == part[at[0]], label, percent)
                    joined = np.unique(np.stack([label, found]), axis=1)
                    u.append(known[joined[0]])
                    v.append(known[joined[1]])
            if u:
                u, v = np.concatenate(u), np.concatenate(v)
                yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])

    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(search, "u long, v long")


def _components(
    docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, part_rows: int, salts: int
) -> DataFrame:
    """``doc_id, key, again, node, root`` of every row; the root is one node of the component."""
    rows = written(sketches(docs, id_col, text_col, size), "sketches")
    nodes = written(rows.groupBy("node").agg(F.min("key").alias("key"), F.min("fp").alias("fp"), F.any_value("bands").alias("bands")), "nodes")
    placed = placed_nodes(nodes)
    members = written(nodes.select("node", "key").join(placed.select("node").distinct(), "node"), "members")
    sets = written(member_sets(docs, members, text_col, size), "sets")
    star = written(linked_pairs(star_pairs(placed), sets, percent, salts), "star")
    first = written(components(star), "first-roots")
    second = components(links(written(unsettled(placed, first), "units"), sets, percent, part_rows))  # links between roots
    second = second.select(F.col("node").alias("of_root"), F.col("root").alias("last"))
    linked = placed.select("node").distinct().join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = linked.join(second, F.col("root") == F.col("of_root"), "left").select(F.col("node").alias("linked"), F.coalesce("last", "root").alias("root"))
    rooted = rows.select("doc_id", "key", "again", "node").join(written(roots, "roots"), F.col("node") == F.col("linked"), "left")
    return written(rooted.select("doc_id", "key", "again", "node", F.coalesce("root", "node").alias("root")), "rooted")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = SIMILAR_PERCENT,
    part_rows: int = PART_ROWS, salts: int = SALTS,
) -> DataFrame:
    """``doc_id, component_id`` for every row: components of texts whose shingle sets have that Jaccard similarity.

    The component is named by its smallest id; a null id names one only if it has no other. Texts with equal sets, and
    all texts without words, null ones too, are one node from the start. Nodes whose SimHash fingerprints the BK-trees link, as in
    ``simhash.near_duplicates`` but of this shingle size, have a key in common, and so have nodes with an equal band of min-hashes. First each node meets the heaviest
    of its key; where nodes of a key are then in different components, those meet too, until every pair of the key is
    linked through others or compared. All counts are on the whole sets. Rows with equal ids are judged by their own
    texts. Other columns are ignored; an empty table gives no rows.
    """
    rooted = _components(docs, id_col, text_col, size, percent, part_rows, salts)
    named = written(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1"), "names")
    out = rooted.join(named, "root", "left")
    return out.select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component of ``near_copies``, with its own columns: the one with the smallest id, a null id last.

    Rows are told apart by id and text, so one that shares its id with a near copy stays; of rows equal in both,
    one stays. Only the keys of rows that go are looked up, no text moves while they are under the optimizer's limit.
    """
    rooted = _components(docs, id_col, text_col, SHINGLE, SIMILAR_PERCENT, PART_ROWS, SALTS)
    rooted = written(rooted.withColumn("row", F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "again", "row")
    several = rooted.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    judged = rooted.join(several, "root").withColumn("kept", F.col("row") == F.col("first.row"))
    return kept_rows(docs, judged.select("doc_id", "key", "again", "kept"), id_col, text_col)
