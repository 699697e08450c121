"""Hard negatives by exact inner products, from lists shared by anchor clusters.

1. All usable rows are packed into blocks of BLOCK rows, partition by partition,
   without a shuffle, and written once.
2. The anchors are clustered (spherical k-means; the centres come from a bounded
   sample, every anchor is assigned).  A cluster of over MEMBERS anchors is
   split, so copies of one anchor fill several blocks.  A block's radius is the
   widest angle between its centre and a member.
3. Every anchor block meets every block of rows.  The block of rows is sorted
   once for the whole cluster, by ``|x| * cos(max(0, angle(x, centre) - radius))``:
   no member of unit length can score a row higher than that.  All members walk the
   list together, STEP rows at a time (one matrix product); a member stops for good when its
   length times the bound of the next row is below the score of the last place
   it still wants, which is known from its own list so far and from a floor that
   the members of its own cluster gave before.  So the best rows are exact.
4. Two walks: the first finds the positives of each anchor; they set, for
   each of them, the range a negative's score must lie in.  The second looks for
   the first rows of other labels inside each of these ranges.  The partial
   lists of an anchor are merged by rank.

The anchors are the stated query set.  Their blocks are broadcast, in
groups of at most ANCHOR_BYTES; rows are never shuffled nor brought to the driver.

Scores are integer inner products (in longs where a double could round; a
product beyond a long raises ValueError).

Defined results: a null label or id, a null or empty vector or one with a null or
non-finite component: the row takes no part; vectors of different lengths raise
ValueError; every row counts by itself, so a repeated anchor row has its
rows twice and copies of an anchor are among its positives; ties by score go to the smaller id (equal
ids: to the row packed first, with the same result); zero vectors score 0; an
empty table, and one without anchors, gives an empty result; other columns are
not looked at."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simsift.llm.common import materialize
from simsift.llm.vectors import floored, usable, vector_lists
from simsift.operators.topk import _arrow_records
from simsift.session import release

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95            # a negative's score, in hundredths of the positive's
BLOCK = 4_096                 # rows of a block
MEMBERS = 512                 # anchors of a block
STEP = 512                    # rows between two looks at the bound
SAMPLE, ROUNDS, MOST = 4_096, 6, 256    # anchors that fit the centres, rounds, centres
ANCHOR_BYTES = 64 << 20
SLOT_BLOCKS = 16              # anchor blocks that a copy of a block of rows meets
_EXACT = 2.0 ** 53


# --- packing ------------------------------------------------------------------------

_PACKED = "ids array<long>, labels array<long>, vecs array<long>"


def _pack(scale: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, count = TaskContext.get().partitionId() << 20, 0, [], 0

        def block(rows: int) -> pa.RecordBatch:
            nonlocal number, held, count
            ids, labels, vecs = (np.concatenate(c) for c in zip(*held, strict=True))
            held = [(ids[rows:], labels[rows:], vecs[rows:])]
            count -= rows
            number += 1
            return pa.record_batch(
                [pa.array([part + number]), pa.array([ids[:rows]]), pa.array([labels[:rows]]),
                 pa.array([vecs[:rows].ravel()])], names=["block", "ids", "labels", "vecs"])
        for batch in batches:
            batch = batch.filter(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
            rows, vectors = usable(batch.column(2))
            if len(rows):
                held.append((batch.column(0).to_numpy()[rows], batch.column(1).to_numpy()[rows], floored(vectors, scale)))
                count += len(rows)
            while count >= size:
                yield block(size)
        if count:
            yield block(count)
    return run


def pack(rows: DataFrame, scale: int = SCALE, size: int = BLOCK) -> DataFrame:
    """(block, ids, labels, vecs): usable rows of (id, label, vec) in blocks, the
    vectors one after the other as integers."""
    return rows.mapInArrow(_pack(scale, size), f"block long, {_PACKED}")


def _matrix(flat: pa.Scalar, n: int) -> np.ndarray:
    return flat.values.to_numpy(zero_copy_only=False).reshape(n, -1)


def _numbers(value: pa.Scalar) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False)


# --- clusters -------------------------------------------------------------------------

def _members(every: int):
    """(uid, id, label, vec) of the anchors of packed blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, labels, vecs in zip(*batch.columns, strict=True):
                ids = _numbers(ids)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    yield pa.record_batch([
                        pa.array(number.as_py() * BLOCK_LIMIT + at), pa.array(ids[at]), pa.array(_numbers(labels)[at]),
                        vector_lists(_matrix(vecs, len(ids))[at])], names=["uid", "id", "label", "vec"])
    return run


#: A row's number in all blocks is block * BLOCK_LIMIT + place; no block is larger.
BLOCK_LIMIT = 1 << 16


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def centres_of(sample: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of ``sample``: k-means by angle, from evenly spaced rows."""
    sample = _unit(sample.astype(np.float64))
    centres = sample[np.linspace(0, len(sample) - 1, count).astype(int)]
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centres)
    return centres


def _nearest(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(usable(batch.column(3))[1])
                yield pa.record_batch(
                    batch.columns + [pa.array((x @ centres.T).argmax(axis=1).astype(np.int32))],
                    names=["uid", "id", "label", "vec", "cluster"])
    return run


def anchor_blocks(anchors: DataFrame, members: int = MEMBERS) -> DataFrame:
    """(anchor_block, uids, ids, labels, vecs): the written (uid, id, label, vec)
    by cluster, large clusters in several blocks."""
    n = anchors.count()
    sample = anchors.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("vec").collect()
    centres = centres_of(np.array([r.vec for r in sample]), min(MOST, int(np.ceil(np.sqrt(n)))))
    near = materialize(anchors.mapInArrow(
        _nearest(centres), "uid long, id long, label long, vec array<long>, cluster int"), "anchors-near")
    size = F.broadcast(near.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / members).alias("splits")))
    grouped = near.join(size, "cluster").withColumn("split", F.pmod(F.xxhash64("uid"), F.col("splits"))) \
        .groupBy("cluster", "split").agg(F.collect_list(F.struct("uid", "id", "label", "vec")).alias("rows"))
    return grouped.select(
        (F.col("cluster").cast("long") * (1 << 31) + F.col("split")).alias("anchor_block"),
        *[F.col(f"rows.{c}").alias(f"{c}s") for c in ("uid", "id", "label")], F.flatten("rows.vec").alias("vecs"))


# --- the walk ---------------------------------------------------------------------------

@dataclass
class Walk:
    """One cluster's members on the rows they meet.  ``wants`` has one list for each
    (member, low, high): the best ``keep`` rows with a score in that range,
    of the member's label or of all others; ``floor`` is a score that the last of
    them is known to reach."""

    uids: np.ndarray
    labels: np.ndarray
    vecs: np.ndarray
    member: np.ndarray
    high: np.ndarray
    floor: np.ndarray
    keep: int
    same: bool
    products: int = field(default=0, init=False)

    def __post_init__(self):
        self.lengths = np.linalg.norm(self.vecs.astype(np.float64), axis=1)
        units = _unit(self.vecs.astype(np.float64))
        self.centre = _unit(units.sum(axis=0, keepdims=True))[0]
        if not self.centre.any():
            self.centre = units[0]
        live = self.lengths > 0
        self.radius = float(np.arccos(np.clip(units[live] @ self.centre, -1, 1)).max()) if live.any() else 0.0

    def bounds(self, rows: np.ndarray) -> np.ndarray:
        """No member of unit length scores a row higher (but for rounding, which
        the slack covers)."""
        rows = rows.astype(np.float64)
        size = np.linalg.norm(rows, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            angle = np.arccos(np.clip(np.where(size > 0, rows @ self.centre / size, 1.0), -1, 1))
        return size * (np.cos(np.maximum(0.0, angle - self.radius - 1e-7)) + 1e-9)

    def _scores(self, members: np.ndarray, rows: np.ndarray) -> np.ndarray:
        mine = self.vecs[members]
        most = float(np.abs(mine).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1]
        self.products += len(mine) * len(rows)
        if most < _EXACT:
            return (mine.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
        if most >= 2.0 ** 63:
            raise ValueError("an inner product may not fit a long")
        return mine @ rows.T

    def run(self, uids: np.ndarray, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray):
        """(list, id, uid, score) of all lists, each in order."""
        bound = self.bounds(vecs)
        order = np.argsort(-bound, kind="stable")
        floor = self.floor.copy()
        found = [np.zeros(0, dtype=np.int64) for _ in range(4)]          # list, score, id, uid
        for a in range(0, len(order), STEP):
            # A list is open while the next row may still reach its last place.
            open_ = np.flatnonzero(self.lengths[self.member] * bound[order[a]] + 1 >= floor)
            if not len(open_):
                break
            at = order[a:a + STEP]
            members, back = np.unique(self.member[open_], return_inverse=True)
            scores = self._scores(members, vecs[at])
            fits = (self.labels[members][:, None] == labels[at][None, :]) == self.same
            fits &= self.uids[members][:, None] != uids[at][None, :]
            wanted = fits[back] & (scores[back] <= self.high[open_][:, None]) & (scores[back] >= floor[open_][:, None])
            lists, places = np.nonzero(wanted)
            if not len(lists):
                continue
            new = (open_[lists], scores[back[lists], places], ids[at][places], uids[at][places])
            found = [np.concatenate(c) for c in zip(found, new, strict=True)]
            best = np.lexsort((found[3], found[2], -found[1], found[0]))
            found = [c[best] for c in found]
            rank = np.arange(len(best)) - np.searchsorted(found[0], found[0])
            found = [c[rank < self.keep] for c in found]
            last = np.flatnonzero(rank[rank < self.keep] == self.keep - 1)
            floor[found[0][last]] = np.maximum(floor[found[0][last]], found[1][last])
        return found[0], found[2], found[3], found[1]


def _lists(row: dict, keep: int, same: bool) -> Walk:
    n = len(row["uids"])
    return Walk(_numbers(row["uids"]), _numbers(row["labels"]), _matrix(row["vecs"], n), _numbers(row["member"]),
                _numbers(row["high"]), _numbers(row["floor"]), keep, same)


_LISTS = "member array<long>, list array<long>, high array<long>, floor array<long>"
_BLOCK = "anchor_block long, uids array<long>, ids array<long>, labels array<long>, vecs array<long>"


def _floors(keep: int, same: bool):
    """Raise the floors of a block's lists by what its own members reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i] for j, c in enumerate(names)}
                walk = _lists(row, keep, same)
                lists, _, _, scores = walk.run(walk.uids, _numbers(row["ids"]), walk.labels, walk.vecs)
                floor = walk.floor.copy()
                full = np.flatnonzero(np.arange(len(lists)) - np.searchsorted(lists, lists) == keep - 1)
                floor[lists[full]] = np.maximum(floor[lists[full]], scores[full])
                out = batch.slice(i, 1)
                yield out.set_column(names.index("floor"), "floor", pa.array([floor]))
    return run


_FOUND = "list long, id long, uid long, score long"


def _walk(keep: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i] for j, c in enumerate(names)}
                ids = _numbers(row["row_ids"])
                lists, found, uids, scores = _lists(row, keep, same).run(
                    row["block"].as_py() * BLOCK_LIMIT + np.arange(len(ids)), ids, _numbers(row["row_labels"]),
                    _matrix(row["row_vecs"], len(ids)))
                yield pa.record_batch([pa.array(_numbers(row["list"])[lists]), pa.array(found), pa.array(uids),
                                       pa.array(scores)], names=["list", "id", "uid", "score"])
    return run


def _best(packed: DataFrame, blocks: DataFrame, keep: int, same: bool, anchor_bytes: int) -> DataFrame:
    """(list, id, uid, score, rank) of every list of ``blocks`` (written), over
    all rows; groups of anchor blocks of a bounded size are broadcast one after the other."""
    raised = materialize(blocks.mapInArrow(_floors(keep, same), f"{_BLOCK}, {_LISTS}"), "anchor-floors")
    size, count = raised.agg(F.sum(8 * (F.size("vecs") + 4 * F.size("list") + 3 * F.size("uids"))),
                             F.count(F.lit(1))).first()
    groups = max(1, -(-int(size or 0) // anchor_bytes))
    slots = -(-count // groups // SLOT_BLOCKS) or 1
    place = F.pmod(F.xxhash64("anchor_block"), F.lit(groups * slots))
    rows = packed.select("block", F.col("ids").alias("row_ids"), F.col("labels").alias("row_labels"),
                         F.col("vecs").alias("row_vecs"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    parts = []
    for g in range(groups):
        mine = raised.withColumn("slot", (place - g * slots).cast("int")).where(F.col("slot").between(0, slots - 1))
        met = rows.join(F.broadcast(mine), "slot").drop("slot")
        parts.append(materialize(met.mapInArrow(_walk(keep, same), _FOUND), "anchor-lists"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    order = Window.partitionBy("list").orderBy(F.desc("score"), "id", "uid")
    out = materialize(whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep), "anchor-best")
    for table in [raised, *parts]:
        release(table)
    return out


def _hundredths(x: str) -> Column:
    """The largest long at most ``x / 100`` (SQL), without a double between."""
    return F.expr(f"(({x}) - pmod({x}, 100L)) div 100L")


def hard_negatives(table: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
                   label: Column | None = None, every: int = 50, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
                   block: int = BLOCK, members: int = MEMBERS, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``; ``label`` may replace
    the label column.  ``low`` and ``high`` bound a negative's score, in hundredths of
    the positive's score."""
    if not 0 < block <= BLOCK_LIMIT:
        raise ValueError(f"block must be from 1 to {BLOCK_LIMIT}")
    rows = table.select(F.col(id_col).cast("long").alias("id"),
                        (F.col(label_col) if label is None else label).cast("long").alias("label"),
                        F.col(vec_col).alias("vec"))
    packed = materialize(pack(rows, scale, block), "packed")
    schema = T.StructType([T.StructField(c, T.IntegerType() if c == "rank" else T.LongType()) for c in (
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")])
    width = packed.select((F.size("vecs") / F.size("ids")).cast("int").alias("d")).first()
    if width is None:
        return table.sparkSession.createDataFrame([], schema)
    # A record of the kernels is a block of rows and one of anchors.
    with _arrow_records(table.sparkSession, 8 * (block + members) * (width.d + 4)):
        anchors = materialize(packed.mapInArrow(_members(every), "uid long, id long, label long, vec array<long>"),
                              "anchors")
        if anchors.isEmpty():
            return table.sparkSession.createDataFrame([], schema)
        blocks = materialize(anchor_blocks(anchors, members), "anchor-blocks")
        lowest, highest = F.lit(-(1 << 62)).cast("long"), F.lit(1 << 62).cast("long")
        first = blocks.select("*", F.transform("uids", lambda _, i: i.cast("long")).alias("member"),
                              F.col("uids").alias("list"), F.transform("uids", lambda _: highest).alias("high"),
                              F.transform("uids", lambda _: lowest).alias("floor"))
        found = _best(packed, first, positives, True, anchor_bytes)
        # A list of negatives for every positive: (anchor, rank of the positive).
        numbered = found.withColumn("uid", F.col("list")) \
            .withColumn("list", F.col("list") * positives + F.col("rank") - 1)
        ranges = numbered.select("uid", "list", _hundredths(f"score * {high}L").alias("high"),
                                 (-_hundredths(f"-score * {low}L")).alias("floor")).where("floor <= high")
        lists = blocks.select("anchor_block", F.posexplode("uids").alias("member", "uid")).join(ranges, "uid") \
            .groupBy("anchor_block").agg(F.collect_list(
                F.struct(F.col("member").cast("long").alias("member"), "list", "high", "floor")).alias("r"))
        second = materialize(blocks.join(lists, "anchor_block").select(
            *blocks.columns, *[F.col(f"r.{c}").alias(c) for c in ("member", "list", "high", "floor")]),
            "anchor-ranges")
        wrong = _best(packed, second, negatives, False, anchor_bytes)
    for t in (packed, blocks, second):
        release(t)
    said = numbered.select("list", "uid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return wrong.select("list", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                        F.col("score").alias("negative_score")) \
        .join(said, "list").join(anchors.select("uid", F.col("id").alias("anchor_id")), "uid") \
        .select(*schema.names)
