"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. One Arrow pass gives each text its set size, a 128-bit digest of the set,
   the hashes of its MinHash bands, and the low bits of all minima packed as
   bit planes.
2. Texts with equal sets collapse into one node (``min`` aggregate), so exact
   copies never meet each other again.
3. Nodes that share a band are candidates.  First every member of a band meets
   only the band's leader, the member found in the fullest bands.  What those
   links do not yet connect is then compared inside each band, in blocks, and
   only across components, so groups of copies never emit all their pairs.
4. Candidates are screened by the collision-corrected estimate from bit counts
   of the packed planes, far enough below the threshold that a true link passes
   (over 4.5 standard deviations), then confirmed exactly on the whole sets.
   Members of bands that step 3 left open get a second, longer signature for a
   closer estimate, so little but true links is left to confirm.

With 32 bands of 6 minima a pair at the threshold 0.85 shares no band with
probability 3e-7, at 0.80 with 6e-5, less above.

Defined results: null or empty text: empty set, linked with nothing; fewer words
than a shingle: the whole sequence is one shingle; a null id: not linked,
component null, kept; rows that repeat an id are one node, linked with all that
any of them is linked with or equal to; rows are dropped by id, so all rows of an
id stay or go together, repeated ones too; equal texts and repeated rows share a component, the smallest id is kept;
an empty table gives an empty result; other columns are not looked at."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simsift.llm import words as W
from simsift.llm.common import is_small, materialize, semi, small_bytes
from simsift.llm.components import components

SHINGLE = 5
PERCENT = 85                # a link: 100 * intersection >= PERCENT * union
BANDS, ROWS = 32, 6
MARGIN = 4.5                # standard deviations below the threshold
BLOCK = 2_000               # members of one band that one block holds
HUB_ROWS = 128              # pairs of one node that meet its row under one key


class Hashes:
    """A family of 32-bit hashes and the bits kept of their minima."""

    def __init__(self, seed: int, count: int, bits: int):
        rng = np.random.default_rng(seed)
        self.count, self.bits = count, bits
        self.lanes = count // 64                  # longs in one bit plane
        self.multiply = rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 1 << 32, count, dtype=np.uint32)

    def minima(self, shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """MinHash minima, one row per non-empty set."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.empty((len(starts), self.count), dtype=np.uint32)
        for p in range(self.count if len(starts) else 0):
            out[:, p] = np.minimum.reduceat(x * self.multiply[p] + self.add[p], starts)
        return out

    def pack(self, minima: np.ndarray) -> np.ndarray:
        """The low bits of mixed minima as bit planes of ``lanes`` longs each."""
        low = W.mix(minima.astype(np.uint64), 3)
        planes = [np.packbits((low >> np.uint64(b)).astype(np.uint8) & 1, axis=1) for b in range(self.bits)]
        return np.concatenate(planes, axis=1).view(np.int64)

    def estimate(self, left: str, right: str) -> Column:
        """Jaccard estimate of two packed signatures, corrected for chance
        equality of the kept bits: (m - 2^-b) / (1 - 2^-b) for the share m of
        equal minima."""
        differ = []
        for lane in range(self.lanes):
            planes = [F.col(left)[b * self.lanes + lane].bitwiseXOR(F.col(right)[b * self.lanes + lane])
                      for b in range(self.bits)]
            differ.append(F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), planes)))
        equal = 1 - reduce(lambda x, y: x + y, differ) / float(self.count)
        chance = 2.0 ** -self.bits
        return (equal - chance) / (1 - chance)

    def least(self, percent: int) -> float:
        """The estimate that a pair at the threshold exceeds but for MARGIN
        standard deviations."""
        j, chance = percent / 100, 2.0 ** -self.bits
        seen = j + (1 - j) * chance
        return j - MARGIN * (seen * (1 - seen) / self.count) ** 0.5 / (1 - chance)


COARSE = Hashes(20_170_517, BANDS * ROWS, 4)      # of every text; the bands are made of its minima
FINE = Hashes(20_170_518, 2_048, 2)               # of members of open bands
_JOIN = np.random.default_rng(9).integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)

SIGNATURES = "id long, n long, k1 long, k2 long, bands array<long>, planes array<long>"
SETS = "id long, shingles array<long>"
FINE_SIGNATURES = "id long, fine array<long>"


def shingle_sets(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text of a chunk, and row pointers."""
    starts, ends, ptr = chunk.spans(W.SPACED)
    return W.distinct_sorted(*W.windows(chunk.hashes(starts, ends, lower=True), ptr, SHINGLE, True))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, chunk in W.chunks(batch.column(1)):
            sets, ptr = shingle_sets(chunk)
            size = np.diff(ptr)
            full = size > 0
            starts, rows = ptr[:-1][full], int(full.sum())
            keys = np.zeros((2, hi - lo), dtype=np.uint64)
            low = COARSE.minima(sets, starts)
            if rows:
                keys[0, full] = np.add.reduceat(W.mix(sets, 1), starts)
                keys[1, full] = np.add.reduceat(W.mix(sets, 2), starts)
            bands = W.mix((low.reshape(rows, BANDS, ROWS).astype(np.uint64) * _JOIN).sum(axis=2, dtype=np.uint64)
                          + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            many = np.concatenate([[0], np.cumsum(full)])
            yield pa.record_batch([
                batch.column(0).slice(lo, hi - lo), pa.array(size.astype(np.int64)),
                pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)),
                W.list_array(bands.view(np.int64).ravel(), many * BANDS),
                W.list_array(COARSE.pack(low).ravel(), many * COARSE.bits * COARSE.lanes),
            ], names=["id", "n", "k1", "k2", "bands", "planes"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, chunk in W.chunks(batch.column(1)):
            sets, ptr = shingle_sets(chunk)
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), W.list_array(sets.view(np.int64), ptr)],
                                  names=["id", "shingles"])


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, chunk in W.chunks(batch.column(1)):
            sets, ptr = shingle_sets(chunk)
            full = np.flatnonzero(np.diff(ptr))
            made = FINE.pack(FINE.minima(sets, ptr[:-1][full]))
            yield pa.record_batch([
                batch.column(0).slice(lo, hi - lo).take(pa.array(full)),
                W.list_array(made.ravel(), np.arange(len(full) + 1) * FINE.bits * FINE.lanes)], names=["id", "fine"])


def hub_join(pairs: DataFrame, table: DataFrame, on: str, spread: str, counted: DataFrame) -> DataFrame:
    """``pairs`` with the one row of ``table`` for each ``on``; ``counted`` is the written
    table that ``pairs`` comes from, row for row.  Pairs of a node
    with over HUB_ROWS of them are spread by ``spread`` over several keys, and that
    node's row is copied once for each."""
    hubs = materialize(counted.groupBy(on).agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("_keys"))
                       .where("_keys > 1"), "hubs")
    if hubs.isEmpty():
        return pairs.join(table, on)
    hubs = F.broadcast(hubs) if small_bytes(hubs) else hubs
    keys = F.coalesce("_keys", F.lit(1))
    left = pairs.join(hubs, on, "left").withColumn("_key", F.pmod(F.xxhash64(spread), keys).cast("int")).drop("_keys")
    right = table.join(hubs, on, "left").withColumn("_key", F.explode(F.sequence(F.lit(0), keys - 1))).drop("_keys")
    return left.join(right, [on, "_key"]).drop("_key")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (hub_join(hub_join(pairs, a, "a", "b", pairs), b, "b", "a", pairs)
            .where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = PERCENT) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialize(rows.mapInArrow(_signatures, SIGNATURES), "signatures")

    # Equal sets are one node, named by the smallest id; so are repeats of an id.
    linkable = signed.where("n > 0 and id is not null")
    # Only sets that occur again are joined back, so the largest group of copies
    # is counted map-side and its rows meet a table of one row per set.
    classes = materialize(
        linkable.groupBy("k1", "k2").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
        .where("copies > 1").drop("copies"), "classes")
    member = materialize(linkable.select("id", "k1", "k2")
                         .join(F.broadcast(classes) if is_small(classes) else classes, ["k1", "k2"])
                         .where("id <> node"), "members")
    row = ["id", "k1", "k2"]
    nodes = linkable.join(F.broadcast(member) if is_small(member) else member, row, "left_anti")

    # An id with several sets joins the nodes of all of them.
    ids = semi(linkable.select(row), member, "id").groupBy("id").agg(
        F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi"))
    mixed = materialize(ids.where("lo <> hi").select("id"), "mixed-ids")
    joined = semi(member.select("id", "node"), mixed, "id").distinct().toDF("a", "b")

    # Bands that several nodes share; a node's weight is how full its bands are.
    banded = nodes.select("id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    bands = materialize(banded.join(shared, "key"), "bands")
    weight = bands.groupBy("id").agg(F.sum("size").alias("weight"))
    leader = bands.join(weight, "id").groupBy("key").agg(
        F.max_by("id", F.struct("weight", -F.col("id"))).alias("leader"))
    candidates = (bands.join(leader, "key").where("id <> leader")
                  .select("id", "leader").distinct())
    planes = semi(nodes.select("id", "planes"), bands.select("id"), "id")
    candidates = materialize(candidates, "candidates")
    near = materialize(
        hub_join(candidates, planes.toDF("leader", "pb"), "leader", "id", candidates)
        .join(planes.toDF("id", "pa"), "id").where(COARSE.estimate("pa", "pb") >= COARSE.least(percent))
        .select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct(), "leader-pairs")

    # What the leaders leave unconnected: pairs of one band and two components.
    first_ids = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
    sets = _sets_of(rows, first_ids)
    links = materialize(_confirmed(near, sets, percent).union(joined), "leader-links")
    found = components(links).toDF("id", "component")
    placed = bands.join(found, "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("component"))
    split = placed.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("lo"),
                                      F.max("component").alias("hi")).where("lo <> hi")
    placed = materialize(placed.join(split.select("key", "size"), "key"), "open")
    open_ids = materialize(placed.select("id").distinct(), "open-ids")
    fine = materialize(semi(rows, open_ids, "id").mapInArrow(_fine, FINE_SIGNATURES), "fine")
    open_rows = materialize(
        placed.join(planes, "id").join(fine, "id")
        .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "open-bands")
    side = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = open_rows.select("key", F.col("id").alias("a"), F.col("component").alias("ca"),
                            F.col("planes").alias("pa"), F.col("fine").alias("fa"), F.col("block").alias("x"),
                            side.alias("y"))
    right = open_rows.select("key", F.col("id").alias("b"), F.col("component").alias("cb"),
                             F.col("planes").alias("pb"), F.col("fine").alias("fb"), side.alias("x"),
                             F.col("block").alias("y"))
    rest = (left.join(right, (left.key == right.key) & (left.x == right.x) & (left.y == right.y)
                      & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
                      & (COARSE.estimate("pa", "pb") >= COARSE.least(percent))
                      & (FINE.estimate("fa", "fb") >= FINE.least(percent)))
            .select("a", "b").distinct().join(near, ["a", "b"], "left_anti"))
    rest = materialize(rest, "open-pairs")
    if not rest.isEmpty():
        ids = rest.select(F.col("a").alias("id")).union(rest.select("b")).distinct()
        more = _confirmed(rest, _sets_of(rows, ids), percent)
        found = components(links.union(more)).toDF("id", "component")

    # Copies follow their node.
    copied = member.join(found.toDF("node", "c"), "node", "left").select(
        "id", F.coalesce("c", "node").alias("component"))
    moved = materialize(found.union(copied).groupBy("id").agg(F.min("component").alias("component")), "components")
    moved = moved.where("component <> id")
    return (signed.select("id", "n").join(F.broadcast(moved) if is_small(moved) else moved, "id", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.coalesce("component", "id").alias("component_id"),
                    F.coalesce("component", "id").eqNullSafe(F.col("id")).alias("kept")))


def _sets_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Whole shingle sets of the documents that some candidate pair needs."""
    needed = materialize(ids, "set-ids")
    return materialize(semi(rows, needed, "id").mapInArrow(_sets, SETS), "sets")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents whose component has a smaller id; columns
    unchanged.  All rows of an id stay or go together."""
    judged = near_duplicates(docs, id_col, text_col, percent)
    gone = materialize(judged.where("not kept").select(F.col(id_col).alias("id")).distinct(), "gone")
    wide = gone.withColumnRenamed("id", id_col)
    return docs.join(F.broadcast(wide) if is_small(gone) else wide, id_col, "left_anti").select(docs.columns)
