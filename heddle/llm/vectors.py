"""Embedding near-duplicates by Euclidean p-stable hashing.

Each vector is scaled to length one, so cosine c is the distance sqrt(2 - 2c). A hash function
projects on a Gaussian direction, shifts, and quantises to cells of ``WIDTH``; a table's bucket is
the tuple of ``k`` cells. ``k`` and the number of tables follow from the number of vectors as the theory
has it: k so that a vector meets about ``STRANGERS`` unrelated ones in a bucket, and as many tables
as find a pair *at* the threshold with probability ``recall``; nearer pairs are found more surely.
All vectors are hashed, and no bucket is capped.

Strangers are sorted out before any vector is shuffled: a bucket's rows carry ``SIGNS`` signs of further
projections, of which two vectors differ in a share of angle / pi, and a semi-join keeps the rows that
have another in their bucket with few enough differing signs (``most_signs``: a pair at the threshold
has more in fewer than one of 10**9 cases). What is kept gets an exact cosine in double precision.

Equal vectors are one node with a count, named by hashes. A bucket of more than ``BLOCK`` nodes is dealt
out as pairs of blocks, by hash of the node, so that every two nodes meet in one block pair, and no task
holds more than two blocks. Pairs are not written: a block gives the number of links to add to
each node, counting a pair in the first table only where both share a bucket, and a star for each
connected group of its nodes.

Null, empty and zero vectors and those with a null or non-finite component link with nothing, nor
do vectors of different dimension with each other. Very large and very small components are
scaled by a power of two first. Ids may be null or repeat: rows are counted, not ids. No rows give no rows; other
columns are not read.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialise
from heddle.llm.components import connected_components

WIDTH, BLOCK, SEED = 2.5, 512, 20240229
#: Groups up to this size are compared for many groups at once.
SMALL = 24
ROWS_PER_BATCH = 8192
#: Unrelated vectors that one meets in a bucket, about; signs that tell them apart.
STRANGERS, SIGNS = 128, 256


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one hash function puts two points at this distance in one cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def parameters(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(k, tables) for n vectors."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    k = max(3, int(math.log(max(n / STRANGERS, 2)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def most_signs(threshold: float) -> int:
    """Signs that a pair at the threshold differs in but for one case in 10**9."""
    p = math.acos(threshold) / math.pi
    there, most = 0.0, -1
    while there < 1 - 1e-9:
        most += 1
        there += math.comb(SIGNS, most) * p**most * (1 - p) ** (SIGNS - most)
    return most


class Hasher:
    """Bucket keys of vectors of one dimension, the same in every process."""

    def __init__(self, dim: int, k: int, tables: int):
        rng = np.random.default_rng([SEED, dim])
        self.k, self.tables = k, tables
        self.directions = rng.standard_normal((dim, k * tables))
        self.shifts = rng.uniform(0, WIDTH, k * tables)
        self.mix = rng.integers(1, 2**62, k, np.int64) | 1
        self.signs = rng.standard_normal((dim, SIGNS))
        self.of = np.int64(0x2545F4914F6CDD1D) * np.arange(1, tables + 1, dtype=np.int64) ^ np.int64(dim << 40)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables) bucket keys, which differ between tables and dimensions."""
        cells = np.floor((unit @ self.directions + self.shifts) / WIDTH).astype(np.int64).reshape(-1, self.tables, self.k)
        mixed = (cells * self.mix).sum(axis=2, dtype=np.int64) + self.of
        mixed ^= mixed >> 29
        return mixed * np.int64(0x9E3779B97F4A7C1 | 1)

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        """(rows, SIGNS / 64) signs as longs."""
        return np.packbits(unit @ self.signs > 0, axis=1).view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    x = np.ldexp(x, -exponent)  # exact, and the squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _bucket_rows(nodes: DataFrame, k: int, tables: int) -> DataFrame:
    """(bucket, node, s0, ...): a row for each node and table, with the node's signs."""
    signs = [f"s{k}" for k in range(SIGNS // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy()
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                hasher = hashers.setdefault(int(dim), Hasher(int(dim), k, tables))
                for at in range(0, part.num_rows, 512):
                    piece = part.slice(at, 512)
                    unit = _units(_matrix(piece.column("vector")))
                    repeated = [np.repeat(x, tables) for x in (piece.column("node").to_numpy(), *hasher.sketch(unit).T)]
                    yield pa.record_batch([pa.array(x) for x in (hasher.keys(unit).reshape(-1), *repeated)], ["bucket", "node", *signs])

    return nodes.select("node", "vector").mapInArrow(run, ", ".join(f"{c} long" for c in ("bucket", "node", *signs)))


def _compare(rows: DataFrame, k: int, tables: int, threshold: float) -> DataFrame:
    """From rows (bucket, i, j, side, node, n, vector), sorted so that a block pair's rows
    follow each other: (node, add, to), links to add to a node, or an edge to another."""

    def pairs_of(group: np.ndarray, unit: np.ndarray, meets) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs of rows: of small groups for all groups at once, of others by blocks."""
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(group)])
        left, right = [], []
        small = np.repeat(sizes <= SMALL, sizes)
        for d in range(1, min(SMALL, int(sizes.max()))):
            a = np.flatnonzero((group[:-d] == group[d:]) & small[:-d])
            if not len(a):
                break
            near = np.einsum("ij,ij->i", unit[a], unit[a + d]) >= threshold
            left.append(a[near])
            right.append(a[near] + d)
        for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            a, b = np.nonzero(np.triu(unit[s : s + n] @ unit[s : s + n].T >= threshold, 1))
            left.append(a + s)
            right.append(b + s)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        keep = meets(a, b)
        return a[keep], b[keep]

    def work(block: pa.Table, hashers: dict[int, Hasher]) -> list[tuple]:
        out = []
        dims = np.concatenate([c.value_lengths().to_numpy() for c in block.column("vector").chunks])
        for dim in np.unique(dims):
            part = block.filter(pa.array(dims == dim)).combine_chunks()
            bucket, i, j, side = (part.column(c).to_numpy() for c in ("bucket", "i", "j", "side"))
            node, n = part.column("node").to_numpy(), part.column("n").to_numpy()
            unit = _units(_matrix(part.column("vector").chunk(0)))
            new = np.r_[True, (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            # two blocks are compared with each other only; one with itself
            a, b = pairs_of(np.cumsum(new), unit, lambda a, b: (i[a] == j[a]) | (side[a] != side[b]))
            if not len(a):
                continue
            used, where = np.unique(np.r_[a, b], return_inverse=True)
            hasher = hashers.setdefault(int(dim), Hasher(int(dim), k, tables))
            keys = hasher.keys(unit[used])
            a_, b_, first = where[: len(a)], where[len(a) :], np.ones(len(a), bool)
            for at in range(0, len(a), 65536):
                s = slice(at, at + 65536)
                met = keys[a_[s]] == keys[b_[s]]
                here = keys[a_[s]] == bucket[a[s]][:, None]
                first[s] = met.argmax(axis=1) >= here.argmax(axis=1)
            a, b = a[first], b[first]
            if not len(a):
                continue
            add = np.zeros(len(node), np.int64)
            np.add.at(add, a, n[b])
            np.add.at(add, b, n[a])
            some = np.flatnonzero(add)
            out.append((node[some], add[some], np.full(len(some), -1, np.int64)))
            # a star for each connected group: labels sink to the smallest row
            label = np.arange(len(node))
            while True:
                low = label.copy()
                np.minimum.at(low, a, label[b])
                np.minimum.at(low, b, label[a])
                low = low[low]
                if (low == label).all():
                    break
                label = low
            some = np.flatnonzero(label != np.arange(len(node)))
            out.append((node[some], np.zeros(len(some), np.int64), node[label[some]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        kept: list[pa.RecordBatch] = []

        def done(block: pa.Table) -> Iterator[pa.RecordBatch]:
            for node, add, to in work(block, hashers):
                yield pa.record_batch([pa.array(node), pa.array(add), pa.array(to)], ["node", "add", "to"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [batch.column(c).to_numpy() for c in ("bucket", "i", "j")]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0))
            first = [c[0] for c in ids]
            if kept and first != [kept[-1].column(c)[-1].as_py() for c in ("bucket", "i", "j")]:
                yield from done(pa.Table.from_batches(kept))
                kept = []
            if len(change):
                cut = int(change[-1]) + 1
                yield from done(pa.Table.from_batches([*kept, batch.slice(0, cut)]))
                kept = [batch.slice(cut)]
            else:
                kept.append(batch)
        if kept:
            yield from done(pa.Table.from_batches(kept))

    return rows.mapInArrow(run, "node long, add long, to long")


def near_vectors(df: DataFrame, threshold: float = 0.9, recall: float = 0.92, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for each row."""
    spark = df.sparkSession
    v = F.col("vector")
    largest = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    finite = (largest > 0) & (largest < float("inf")) & ~F.isnan(largest) & ~F.exists(v, lambda x: x.isNull())
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).withColumn("good", F.coalesce(finite, F.lit(False)))
    rows = rows.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit("second"), "vector")})
    nodes = rows.where("good").groupBy("h1", "h2", "vector").agg(F.count("*").alias("n"), F.min("id").alias("root"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()))
    k, tables = parameters(nodes.count(), threshold, recall)

    conf, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(conf, str(ROWS_PER_BATCH))
    try:
        keyed = materialise(_bucket_rows(nodes, k, tables))
        one, other = keyed.alias("one"), keyed.alias("other")
        pairs = [F.bit_count(F.col(f"one.s{x}").bitwiseXOR(F.col(f"other.s{x}"))) for x in range(SIGNS // 64)]
        near = (F.col("one.node") != F.col("other.node")) & (functools.reduce(operator.add, pairs) <= most_signs(threshold))
        met = one.join(other, (F.col("one.bucket") == F.col("other.bucket")) & near, "left_semi")
        met = materialise(met.select("bucket", "node"))
        sizes = met.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        met = met.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pair = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
        met = met.select("bucket", *pair, (F.col("block") > F.col("other")).alias("side"), "node")
        full = met.join(nodes.select("node", "n", "vector"), "node")
        group = ["bucket", "i", "j"]
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        full = full.repartition(partitions, *group).sortWithinPartitions(*group, "node")
        found = materialise(_compare(full, k, tables, threshold))
    finally:
        spark.conf.set(conf, usual)

    labels = connected_components(found.where("to >= 0").select(F.col("node").alias("a"), F.col("to").alias("b")))
    added = found.where("to < 0").groupBy("node").agg(F.sum("add").alias("more"))
    named = nodes.select("node", "h1", "h2", "n", "root").join(added, "node", "left").join(labels, "node", "left")
    links = (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")
    named = materialise(named.select("h1", "h2", "root", links, F.coalesce("label", "node").alias("label")))
    least = named.groupBy("label").agg(F.min("root").alias("component_id"))
    named = materialise(named.join(least, "label").select("h1", "h2", "n_links", "component_id"))
    linked = rows.where("good").select("id", "h1", "h2").join(named, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = linked.unionAll(alone)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    return both.select(F.col("id").alias(id_col), "n_links", "component_id", kept)
