"""Most similar vectors by cross-polytope hashing.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform) turns a unit vector; its hash is
the signed axis nearest to it. One hash of a table is a row of such axes; further probes take the next nearest
axes, in the order of what they lose. Vectors that share a bucket in any table are candidates and are compared
exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectorium.llm.common import checkpointed, in_parts

#: Vectors of one side in one comparison; larger buckets are compared block by block.
BLOCK = 2_000
#: Of so many vectors one is hashed to tell which buckets are large.
SAMPLED = 16
#: Queries, and rows, of a pair of blocks in a search.
QUERY_BLOCK = 20_000
#: Expected share of the pairs at the threshold itself that are met, whatever the number of rows.
RECALL = 0.995


@dataclass
class Hashing:
    """`tables` tables of `axes` rotations each; `probes` buckets are looked into for each vector and table."""

    dimension: int
    tables: int
    axes: int
    probes: int
    seed: int = 7
    signs: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.padded = 1 << max(1, (self.dimension - 1).bit_length())
        self.signs = np.random.default_rng(self.seed).choice([-1.0, 1.0], (self.tables, self.axes, 3, self.padded)).astype(np.float32)

    def rotated(self, unit: np.ndarray, table: int, axis: int) -> np.ndarray:
        """`unit` (rows of unit vectors) under one pseudo-rotation."""
        x = np.zeros((len(unit), self.padded), np.float32)
        x[:, : self.dimension] = unit
        for signs in self.signs[table, axis]:
            x *= signs
            h = 1
            while h < self.padded:
                y = x.reshape(len(x), -1, 2, h)
                x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), -1)
                h *= 2
            x /= np.sqrt(self.padded)
        return x

    def buckets(self, unit: np.ndarray, table: int) -> np.ndarray:
        """For each vector the buckets of its probes, nearest first, shape (rows, probes)."""
        wide = 2 * self.padded
        codes = np.zeros((len(unit), 1), np.int64)
        lost = np.zeros((len(unit), 1), np.float32)
        for axis in range(self.axes):
            x = self.rotated(unit, table, axis)
            both = np.concatenate((x, -x), axis=1)
            keep = min(self.probes, wide)
            near = np.argpartition(-both, keep - 1, axis=1)[:, :keep]
            value = np.take_along_axis(both, near, axis=1)
            order = np.argsort(-value, axis=1, kind="stable")
            near, value = np.take_along_axis(near, order, axis=1), np.take_along_axis(value, order, axis=1)
            loss = (value[:, :1] - value) ** 2
            codes = (codes[:, :, None] * wide + near[:, None, :]).reshape(len(unit), -1)
            lost = (lost[:, :, None] + loss[:, None, :]).reshape(len(unit), -1)
            keep = min(self.probes, codes.shape[1])
            best = np.argsort(lost, axis=1, kind="stable")[:, :keep]
            codes, lost = np.take_along_axis(codes, best, axis=1), np.take_along_axis(lost, best, axis=1)
        return codes


def usable(df: DataFrame, id_column: str, vector_column: str, dimension: int) -> DataFrame:
    """(id, vec): one unit vector for each id; null, empty, all-zero, not finite and wrong-sized vectors are left out."""
    v = F.col(vector_column)
    rows = df.select(F.col(id_column).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size(v) == dimension)).dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 4_000):
            x = _matrix(batch.column("v"), dimension).astype(np.float64)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            keep = (norm > 0) & np.isfinite(norm)
            unit = (x[keep] / norm[keep][:, None]).astype(np.float32)
            ends = pa.array(np.arange(0, unit.size + 1, dimension), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(keep)), pa.ListArray.from_arrays(ends, pa.array(unit.ravel()))], ["id", "vec"])

    kind = df.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, vec array<float>")


def usual_dimension(df: DataFrame, vector_column: str) -> int | None:
    """The most frequent size of a vector; None if there is none."""
    sizes = df.where(F.size(vector_column) > 0).groupBy(F.size(vector_column).alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1).collect()
    return sizes[0]["n"] if sizes else None


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _entries(vectors: DataFrame, hashing: Hashing, kind: str) -> DataFrame:
    """A row for each vector, table and probe: (rep, small, table, bucket, home), home for the nearest bucket.

    `small` holds the vector's components in steps of 1/127 as bytes.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(hashing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = shared.value
        for batch in in_parts(batches, 4_000):
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column("vec"), hashing.dimension)
            steps = np.round(unit * 127).astype(np.int8)
            small = pa.array([row.tobytes() for row in steps], pa.binary())
            for table in range(hashing.tables):
                codes = hashing.buckets(unit, table)
                n, probes = codes.shape
                at = pa.array(np.repeat(np.arange(n), probes))
                home = np.zeros((n, probes), bool)
                home[:, 0] = True
                yield pa.RecordBatch.from_arrays([batch.column("rep").take(at), small.take(at), pa.array(np.full(n * probes, table, np.int32)), pa.array(codes.ravel()), pa.array(home.ravel())], ["rep", "small", "table", "bucket", "home"])

    return vectors.mapInArrow(run, f"rep {kind}, small binary, table int, bucket bigint, home boolean")


def _axes_for(rows: int, padded: int) -> int:
    """Rotations of a table, so that a bucket of home entries has some tens of rows whatever their number."""
    axes = 1
    while rows > 40 * (2 * padded) ** axes:
        axes += 1
    return axes


def meeting_rate(dimension: int, axes: int, probes: int, least: float, pairs: int = 4_000, tables: int = 4) -> float:
    """Chance that a pair of cosine `least` meets in one table, by trial, less two standard errors.

    Pseudo-rotations are random, so it is the same for every pair of that cosine.
    """
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(2, pairs, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= x * np.einsum("ij,ij->i", x, y)[:, None]
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    y = least * x + math.sqrt(max(0.0, 1 - least * least)) * y
    hashing = Hashing(dimension, tables, axes, probes, seed=13)
    met = 0
    for table in range(tables):
        a, b = hashing.buckets(x.astype(np.float32), table), hashing.buckets(y.astype(np.float32), table)
        met += int(((a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)).sum())
    n = pairs * tables
    return met / n - 2 * math.sqrt(met / n * (1 - met / n) / n)


def _tables_for(dimension: int, axes: int, probes: int, least: float) -> float:
    """Tables in which a pair of cosine `least` meets with a chance of RECALL; infinite if trials met none."""
    rate = meeting_rate(dimension, axes, probes, least)
    if rate >= 1:
        return 1
    return math.ceil(math.log(1 - RECALL) / math.log(1 - rate)) if rate > 0 else math.inf


def hashing_for(rows: int, dimension: int, least: float, tables: int, probes: int) -> Hashing:
    """Hashing of so many rows that meets pairs of cosine `least` with a chance of RECALL, with `tables` tables or more.

    An axis more makes buckets smaller and takes more tables; where these would outweigh that, an axis less is taken.
    """
    padded = 1 << max(1, (dimension - 1).bit_length())
    axes = _axes_for(rows, padded)
    needed = _tables_for(dimension, axes, probes, least)
    while axes > 1 and needed > 2 * padded:
        fewer = _tables_for(dimension, axes - 1, probes, least)
        if needed <= 2 * padded * fewer and needed < math.inf:
            break
        axes, needed = axes - 1, fewer
    if needed == math.inf:
        raise ValueError(f"hashing meets no pairs of a cosine of {least}")
    return Hashing(dimension, max(tables, int(needed)), axes, probes)


def similar_pairs(df: DataFrame, id_column: str, vector_column: str, least: float, tables: int = 8, probes: int = 3, dimension: int | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of ids whose vectors have a cosine similarity of `least` or more.

    Equal vectors are one class: classes are compared, and pairs follow from their members. Entries carry a copy
    of the vector in bytes for a first comparison in the bucket, which forms no pair below `least` less its
    rounding; what is left is compared exactly. Buckets above BLOCK entries are compared in blocks. `tables` is the
    least number of tables: there are as many as RECALL takes with the axes and probes.
    """
    dimension = dimension or usual_dimension(df, vector_column)
    kind = df.schema[id_column].dataType.simpleString()
    if dimension is None:
        return df.select(F.col(id_column).alias("id_a"), F.col(id_column).alias("id_b")).limit(0)
    vectors = usable(df, id_column, vector_column, dimension)
    members = checkpointed(vectors.select("id", F.struct(F.xxhash64("vec").alias("h"), F.hash("vec").alias("g")).alias("key"), "vec"))
    classes = members.groupBy("key").agg(F.min_by(F.struct("id", "vec"), "id").alias("x")).select("key", F.col("x.id").alias("rep"), F.col("x.vec").alias("vec"))
    rows = classes.count()
    hashing = hashing_for(rows, dimension, least, tables, probes)

    # copies in bytes: a component is off by at most half a step, so cosines by little; the exact comparison follows
    entries = _entries(classes.select("rep", "vec"), hashing, kind)
    # sizes are estimated from one vector in SAMPLED, as they only decide how a bucket is split: all of it meets in any case
    some = _entries(classes.where(F.pmod(F.xxhash64("rep", F.lit(9)), F.lit(SAMPLED)) == 0).select("rep", "vec"), hashing, kind)
    large = some.groupBy("table", "bucket").agg((F.count("*") * SAMPLED).alias("size")).where(F.col("size") > BLOCK)
    large = checkpointed(large)
    if large.isEmpty():
        entries = entries.withColumn("blocks", F.lit(1))
    else:
        entries = entries.join(large, ["table", "bucket"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int"))
    entries = entries.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(1 << 20)))
    # entry in block i meets all pairs of blocks that hold i
    entries = entries.withColumn("own", F.pmod("salt", F.col("blocks")).cast("int"))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    entries = entries.select("table", "bucket", "rep", "small", "home", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    rough = least - 0.03

    # several buckets share a task's group; each of them is compared by itself
    groups = max(8, -(-rows * hashing.tables * probes // 40_000))
    key = F.xxhash64("table", "bucket", "low", "high")
    entries = entries.select("rep", "small", "home", "own", (F.col("low") != F.col("high")).alias("cross"), key.alias("key"), F.pmod(key, F.lit(groups)).alias("part"))

    def compare(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        ids, home, own, cross = (group.column(c).to_numpy()[order] for c in ("rep", "home", "own", "cross"))
        m = np.frombuffer(b"".join(group.column("small").to_pylist()), np.int8).reshape(-1, dimension)[order]
        bounds = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1, append=keys[-1] + 1))
        found: list[np.ndarray] = []
        for start, end in zip(bounds[:-1], bounds[1:]):
            at = home[start:end]
            if end - start < 2 or not at.any():
                continue
            x = m[start:end].astype(np.float32)
            x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-9)
            i, j = np.nonzero(x[at] @ x.T >= rough)
            i = np.flatnonzero(at)[i] + start
            j = j + start
            ok = ids[i] != ids[j]
            if cross[start]:
                ok &= own[i] != own[j]
            if ok.any():
                i, j = ids[i[ok]], ids[j[ok]]
                found.append(np.stack((np.minimum(i, j), np.maximum(i, j)), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), ids.dtype)
        kind = group.schema.field("rep").type
        return pa.table([pa.array(pairs[:, 0]).cast(kind), pa.array(pairs[:, 1]).cast(kind)], names=["rep_a", "rep_b"])

    met = entries.groupBy("part").applyInArrow(compare, f"rep_a {kind}, rep_b {kind}").distinct()
    a = classes.select(F.col("rep").alias("rep_a"), F.col("vec").alias("va"), F.col("key").alias("key_a"))
    b = classes.select(F.col("rep").alias("rep_b"), F.col("vec").alias("vb"), F.col("key").alias("key_b"))
    cosine = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    close = met.join(a, "rep_a").join(b, "rep_b").where(cosine >= least - 1e-7).select("key_a", "key_b")
    # pairs of classes, and each class with itself, become pairs of their members
    several = members.groupBy("key").count().where("count > 1").select(F.col("key").alias("key_a"), F.col("key").alias("key_b"))
    owners = members.select("id", "key")
    pairs = close.unionByName(several).join(owners.select(F.col("key").alias("key_a"), F.col("id").alias("x")), "key_a").join(owners.select(F.col("key").alias("key_b"), F.col("id").alias("y")), "key_b")
    pairs = pairs.where((F.col("key_a") != F.col("key_b")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def _bucket_candidates(probe: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, rows) that meet in each bucket of one table: probes (queries, probes) against home buckets (rows)."""
    row_order = np.argsort(home, kind="stable")
    codes, starts = np.unique(home[row_order], return_index=True)
    ends = np.append(starts[1:], len(home))
    flat = probe.ravel()
    asked_order = np.argsort(flat, kind="stable")
    asked = flat[asked_order]
    owner = asked_order // probe.shape[1]
    low, high = np.searchsorted(asked, codes, "left"), np.searchsorted(asked, codes, "right")
    for i in range(len(codes)):
        if high[i] > low[i]:
            yield owner[low[i] : high[i]], row_order[starts[i] : ends[i]]


class _Best:
    """The k best rows of each query so far: larger similarity, then smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.floor = np.full(queries, -2.0, np.float32)
        self.kept: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        self.new: list[tuple[np.ndarray, ...]] = []

    def offer(self, query: np.ndarray, row: np.ndarray, similarity: np.ndarray) -> None:
        self.new.append((query, row, similarity))

    def settle(self) -> tuple[np.ndarray, ...]:
        """Takes in what was offered; a row offered by several tables counts once."""
        if self.new:
            query, row, sim = (np.concatenate(c) for c in zip(self.kept, *self.new))
            self.new = []
            order = np.lexsort((row, -sim, query))
            query, row, sim = query[order], row[order], sim[order]
            fresh = np.ones(len(query), bool)
            fresh[1:] = (query[1:] != query[:-1]) | (row[1:] != row[:-1])  # equal pairs have equal similarity, so they are neighbours
            query, row, sim = query[fresh], row[fresh], sim[fresh]
            place = np.arange(len(query)) - np.searchsorted(query, query, "left")
            keep = place < self.k
            self.kept = query[keep], row[keep], sim[keep]
            last = place == self.k - 1
            self.floor[query[last]] = sim[last]
        return self.kept


def nearest(df: DataFrame, id_column: str, vector_column: str, queries: DataFrame, k: int = 10, tables: int = 8, probes: int = 10, axes: int = 1, dimension: int | None = None) -> DataFrame:
    """(query_id, neighbour_id, similarity, rank): about the k most similar vectors of each query, itself left out.

    `queries` is a DataFrame of ids. Queries meet all rows in blocks of QUERY_BLOCK each; within a pair of blocks
    the tables' buckets collect the candidates, which are ranked by their exact similarity, and only the k best
    of a query leave the task. One axis a table is for vectors as unlike each other as most embeddings are: their neighbours lie
    at wide angles and only wide buckets hold them. Ties go to the smaller id. Vectors that can't be used neither ask nor
    are found.
    """
    dimension = dimension or usual_dimension(df, vector_column)
    kind = df.schema[id_column].dataType.simpleString()
    if dimension is None:
        empty = df.select(F.col(id_column).alias("query_id"), F.col(id_column).alias("neighbour_id")).limit(0)
        return empty.select("*", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"))
    vectors = checkpointed(usable(df, id_column, vector_column, dimension))
    asked = vectors.join(queries.toDF("id").distinct(), "id", "left_semi").toDF("asking", "question")
    hashing = Hashing(dimension, tables, axes, probes)
    shared = df.sparkSession.sparkContext.broadcast(hashing)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    parts = max(-(-vectors.count() // QUERY_BLOCK), -(-df.sparkSession.sparkContext.defaultParallelism // blocks))
    left = asked.select("asking", "question", F.pmod(F.xxhash64("asking"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = vectors.select("id", "vec", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def compare(keys: tuple, ask: pa.Table, rows: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        if ask.num_rows and rows.num_rows:
            hashing = shared.value
            nearest_only = Hashing(dimension, hashing.tables, hashing.axes, 1, hashing.seed)
            order = np.argsort(rows.column("id").to_numpy(), kind="stable")  # so that ties of rows are ties of ids
            ids, x = rows.column("id").to_numpy()[order], _matrix(rows.column("vec"), dimension)[order]
            asking, q = ask.column("asking").to_numpy(), _matrix(ask.column("question"), dimension)
            best = _Best(len(q), k)
            for table in range(hashing.tables):
                for mine, theirs in _bucket_candidates(hashing.buckets(q, table), nearest_only.buckets(x, table)[:, 0]):
                    for i in range(0, len(mine), BLOCK):
                        some = mine[i : i + BLOCK]
                        sims = q[some] @ x[theirs].T
                        a, b = np.nonzero(sims >= best.floor[some][:, None])
                        other = asking[some[a]] != ids[theirs[b]]
                        a, b = a[other], b[other]
                        best.offer(some[a], theirs[b], np.round(sims[a, b], 6))
                    if sum(len(n[0]) for n in best.new) > 2_000_000:
                        best.settle()
                best.settle()
            query, row, sim = best.settle()
            out = [asking[query], ids[row], sim.astype(np.float64)]
        kinds = (ask.schema.field("asking").type, rows.schema.field("id").type, pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], names=["query_id", "neighbour_id", "similarity"])

    from pyspark.sql import Window

    made = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(compare, f"query_id {kind}, neighbour_id {kind}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "neighbour_id")  # at most k x parts rows
    return made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
