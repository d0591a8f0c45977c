"""Near duplicates of embeddings: cross-polytope hashing after Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import load, small_batches
from ledgerloom.operators.components import connected_components
from ledgerloom.scratch import written

THRESHOLD = 0.98
#: Hash tables, cross-polytope hashes joined in each, and further buckets that a vector is looked up in.
TABLES, JOINED, PROBES = 8, 3, 3
#: Vectors of a bucket that one task compares with as many others.
BLOCK = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; their length is a power of two."""
    rows, size = x.shape
    step = 1
    while step < size:
        x = x.reshape(rows, -1, 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2)
        step *= 2
    return x.reshape(rows, size) / np.sqrt(size)


class CrossPolytope:
    """Codes of unit vectors: in each table, JOINED hashes; a hash is the nearest signed axis after a random rotation."""

    def __init__(self, size: int, tables: int = TABLES, joined: int = JOINED, probes: int = PROBES, seed: int = 9):
        self.size = 1 << max(1, (size - 1).bit_length())
        self.tables, self.joined, self.probes = tables, joined, probes
        rng = np.random.default_rng([seed, size])
        self.signs = rng.choice([-1.0, 1.0], (tables, joined, 3, self.size))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Codes ``[vector, table, 1 + probes]``; the first is the vector's own bucket.

        A probe changes one of the joined hashes to its second axis: first where that costs the least.
        """
        x = np.pad(x, ((0, 0), (0, self.size - x.shape[1])))
        rows = np.arange(len(x))
        out = np.empty((len(x), self.tables, 1 + self.probes), np.int64)
        for table in range(self.tables):
            own, second, loss = [], [], []
            for hashed in range(self.joined):
                y = x
                for signs in self.signs[table, hashed]:
                    y = hadamard(y * signs)
                size = np.abs(y)
                two = np.argpartition(size, -2, axis=1)[:, -2:]
                swap = size[rows, two[:, 0]] > size[rows, two[:, 1]]
                two[swap] = two[swap][:, ::-1]
                axes = two * 2 + (y[rows[:, None], two] < 0)
                own.append(axes[:, 1])
                second.append(axes[:, 0])
                loss.append(size[rows, two[:, 1]] - size[rows, two[:, 0]])
            own, second = np.stack(own, 1), np.stack(second, 1)
            place = (2 * self.size) ** np.arange(self.joined)
            out[:, table, 0] = own @ place
            order = np.argsort(np.stack(loss, 1), axis=1, kind="stable")
            for probe in range(self.probes):
                changed = own.copy()
                at = order[:, probe % self.joined]
                changed[rows, at] = second[rows, at]
                out[:, table, 1 + probe] = changed @ place
        return out


def usable_rows(vectors: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which vectors are finite and not zero, and those in double precision with length 1."""
    usable, found = [], []
    for i, vector in enumerate(vectors):
        if vector and None not in vector:
            x = np.asarray(vector, np.float64)
            largest = np.abs(x).max()
            if np.isfinite(largest) and largest > 0:
                x = x / largest
                usable.append(i)
                found.append(x / np.sqrt(x @ x))
    return np.asarray(usable, np.int64), found


def bytes_kind(vectors: DataFrame) -> type:
    """The type in which components travel: that of the input, where it is floating."""
    return np.float32 if dict(vectors.dtypes)["vector"] == "array<float>" else np.float64


def hashed(vectors: DataFrame, tables: int, joined: int, probes: int) -> DataFrame:
    """``(id, label, size, raw, codes)`` of the usable vectors; raw has the bytes of their components."""
    kind = bytes_kind(vectors)

    def hashing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[int, CrossPolytope] = {}
        for batch in batches:
            given = batch.column("vector").to_pylist()
            usable, found = usable_rows(given)
            sizes = np.array([len(x) for x in found], np.int64)
            for size in map(int, np.unique(sizes)):
                at = np.flatnonzero(sizes == size)
                if size not in hashes:
                    hashes[size] = CrossPolytope(size, tables, joined, probes)
                x = np.stack([found[i] for i in at])
                codes = hashes[size](x).reshape(len(x), -1)
                rows = pa.array(usable[at])
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(rows), batch.column("label").take(rows), pa.array(sizes[at].astype(np.int32)),
                    pa.array([np.asarray(given[i], kind).tobytes() for i in usable[at]], pa.binary()), pa.array(list(codes), pa.list_(pa.int64())),
                ], ["id", "label", "size", "raw", "codes"])

    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(hashing, f"id {kinds['id']}, label {kinds['label']}, size int, raw binary, codes array<long>")


def groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in sorted batches. A run is as large as the caller has let it get."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        change = np.zeros(batch.num_rows, bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:], strict=False):
            if start == end:
                continue
            key = tuple(column[start] for column in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def first_met(i: np.ndarray, j: np.ndarray, left: np.ndarray, right: np.ndarray, table: int, code: int) -> np.ndarray:
    """Of links between rows i and j, those that share no bucket of an earlier table, or a lower one of this table."""
    keep = np.ones(len(i), bool)
    for start in range(0, len(i), 1 << 16):
        a, b = left[i[start : start + (1 << 16)]], right[j[start : start + (1 << 16)]]
        same = a[:, : table + 1, :, None] == b[:, : table + 1, None, :]
        same[:, table] &= a[:, table, :, None] < code
        keep[start : start + (1 << 16)] = ~same.any(axis=(1, 2, 3))
    return keep


def roots_of(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that links reach, for each of ``size`` positions."""
    root = np.arange(size)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def links(candidates: DataFrame, tables: int, probes: int, threshold: float, kind: type) -> DataFrame:
    """``(id, n, other)``: for each block of a bucket and vector in it, its links first met there, and one it connects to.

    Rows are ``(key, p, q, block, id, raw, keys)``; blocks p and q of bucket ``key`` meet in one group. ``keys`` are all of
    the vector's buckets, table by table.
    """
    id_type = dict(candidates.dtypes)["id"]

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["key", "p", "q"]):
            ids, block = group.column("id"), group.column("block").to_numpy()
            p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
            unit = np.stack([np.frombuffer(x, kind) for x in group.column("raw").to_pylist()]).astype(np.float64)
            unit /= np.abs(unit).max(1, keepdims=True)
            unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
            keys = np.array(group.column("keys").to_pylist(), np.int64).reshape(len(unit), tables, 1 + probes)
            key = group.column("key")[0].as_py()
            table = int(np.argwhere(keys[0] == key)[0, 0])
            left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
            met = unit[left] @ unit[right].T >= threshold
            if p == q:
                met = np.triu(met, 1)
            i, j = np.nonzero(met)
            i, j = left[i], right[j]
            keep = first_met(i, j, keys, keys, table, key)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            count = np.bincount(i, minlength=len(unit)) + np.bincount(j, minlength=len(unit))
            linked = np.flatnonzero(count)
            root = roots_of(len(unit), i, j)[linked]
            values = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            yield pa.RecordBatch.from_arrays(
                [values.take(pa.array(linked)), pa.array(count[linked]), values.take(pa.array(root))], ["id", "n", "other"])

    return candidates.mapInArrow(meeting, f"id {id_type}, n long, other {id_type}")


def vector_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD, tables: int = TABLES, joined: int = JOINED, probes: int = PROBES, block: int = BLOCK,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors of one label and length that share a bucket are compared in double precision; a cosine of ``threshold`` or
    more is a link. A pair counts once, in the first bucket that it shares. Buckets larger than ``block`` are compared
    block by block, so that no task gets more than two blocks and no pair is written. Vectors that are null, empty,
    zero or hold null or non-finite components, and those of null labels, have no links. Rows that repeat an id are one
    vector, the smallest by label and components; a null id has no links, a null component and is kept. Other columns
    are not looked at. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    one = rows.where("id is not null").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("least"))
    one = one.select("id", "least.label", "least.vector")
    usable = hashed(one.where("label is not null"), tables, joined, probes)
    width = 1 + probes
    keys = F.transform("codes", lambda code, place: F.xxhash64("label", "size", F.floor(place / width), code))
    units = written(usable.select("id", "raw", keys.alias("keys")), "units")
    spread = units.select("id", F.explode(F.array_distinct("keys")).alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = spread.join(shared, "key").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")).select(
        "key", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), "block", "id")
    candidates = (
        met.join(units, "id").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    )
    found = written(links(candidates, tables, probes, threshold, bytes_kind(one)), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    roots = written(connected_components(found, "id", "other"), "classes").withColumnRenamed("node", "id")
    ids = one.select("id").unionByName(rows.where("id is null").select("id"))
    component = F.coalesce("root", "id")
    return ids.join(counts, "id", "left").join(roots, "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(load(spark, sf_dir, "embeddings"))


SQL = """
WITH usable AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
), near AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
    WITH RECURSIVE r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, near.b FROM r JOIN near ON r.b = near.a)
    SELECT a, min(b) AS component_id FROM r GROUP BY a
), linked AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN reach ON reach.a = e.vec_id LEFT JOIN linked ON linked.a = e.vec_id
"""
