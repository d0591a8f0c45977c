"""Near duplicates: improved consistent weighted sampling over TF-IDF word shingles, banded, verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, join_groups, load, may_be_in, per_batch, small_batches
from ledgerloom.llm.shingles import BUCKETS, LEVELS, Shingler, levels, mixed, similarity, weights
from ledgerloom.llm.vector_dedup import groups
from ledgerloom.operators.components import connected_components
from ledgerloom.scratch import drop, written

THRESHOLD = 0.8
BANDS, ROWS = 20, 4
#: Entries of the table of random draws that elements are dealt to, by hash.
DRAWS = 1 << 16
#: Shingles that are hashed at once.
CHUNK = 1 << 16
#: Share of equal samples from which a pair is verified, and from which a document follows a leader and leads none: four
#: standard deviations and one under the threshold's own share.
MAYBE, FOLLOWS = 0.62, 0.75
#: Documents of a bucket that one task leads at once, or compares with as many others.
BLOCK = 4096
#: Distinct shingles of such a block's documents.
SHINGLES = 1 << 22
#: Documents that follow one leader and are compared with it in one group.
FOLLOWERS = 1024
#: Of a block's rows, as many at a time.
STRIPE = 512
#: Slices that the table of document frequencies is summed in.
SLICES = 64


class Sampler:
    """Improved consistent weighted sampling of (shingle, weight level) sets.

    For an element of weight w and a hash function, with r, c ~ Gamma(2, 1) and b ~ U(0, 1) drawn for the two:
    t = floor(ln w / r + b), y = exp(r (t - b)), a = c / (y e^r); the sample is the element of the least a, with its t.
    The draws come from a table of ``DRAWS`` triples that each hash function deals the elements to, and weights have
    few levels, so all values of a are tabled once and replaced by their rank. Equal ranks are told apart by further
    bits of the element's hash. Equal samples of two sets are equal numbers.
    """

    def __init__(self, samples: int, seed: int = 20):
        rng = np.random.default_rng(seed)
        r, c, b = rng.gamma(2, 1, DRAWS), rng.gamma(2, 1, DRAWS), rng.uniform(size=DRAWS)
        log_w = np.log(weights(np.arange(LEVELS)))[:, None]
        t = np.floor(log_w / r + b)
        ln_a = np.log(c) - r * (t - b) - r
        _, rank = np.unique(ln_a, return_inverse=True)
        self.rank = rank.reshape(-1).astype(np.uint64) << np.uint64(32)
        self.deal = rng.integers(1, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.tie = rng.integers(1, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, shingles: np.ndarray, level: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row of samples for each set; sets lie one after the other, none empty."""
        out = np.empty((len(starts), len(self.deal)), np.uint64)
        row = level.astype(np.uint64) * np.uint64(DRAWS)
        shift = np.uint64(64 - DRAWS.bit_length() + 1)
        for k, (deal, tie) in enumerate(zip(self.deal, self.tie, strict=True)):
            value = self.rank[((shingles * deal) >> shift) + row] | ((shingles * tie) >> np.uint64(32))
            out[:, k] = np.minimum.reduceat(value, starts)
        return out


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Documents of ``(id, text)``, and how many have a shingle in each of ``BUCKETS`` buckets, less the buckets' mean.

    Every document counts. What comes to the driver is a table of one size whatever the corpus.
    """
    width = BUCKETS // SLICES

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, table, documents = Shingler(), np.zeros(BUCKETS, np.int32), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                shingles, _ = shingler(text)
                np.add.at(table, shingles >> np.uint64(64 - BUCKETS.bit_length() + 1), 1)
                documents += 1
        if documents:
            for i in range(SLICES):
                part = table[i * width : (i + 1) * width]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([documents if not i else 0], pa.int64()), pa.array([part.tobytes()], pa.binary())],
                    ["slice", "documents", "counts"])

    def summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, documents, total = 0, 0, np.zeros(width, np.int64)
        for batch in batches:
            for i, n, counts in zip(*(batch.column(c).to_pylist() for c in ("slice", "documents", "counts")), strict=True):
                number, documents = i, documents + n
                total += np.frombuffer(counts, np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int32()), pa.array([documents], pa.int64()), pa.array([total.tobytes()], pa.binary())],
            ["slice", "documents", "counts"])

    schema = "slice int, documents long, counts binary"
    parts = rows.select("text").mapInArrow(counting, schema).groupBy("slice").applyInArrow(summing, schema).collect()
    table = np.zeros(BUCKETS, np.int64)
    for part in parts:
        table[part["slice"] * width : (part["slice"] + 1) * width] = np.frombuffer(part["counts"], np.int64)
    return sum(part["documents"] for part in parts), (table - table.mean()).astype(np.float32)


def sampled(rows: DataFrame, model, bands: int, per_band: int) -> DataFrame:
    """``(id, samples, size, keys)``: a byte of each sample, then two of each band's key; distinct shingles; the bands' keys.

    Samples that differ have one byte in common once in 256 times, which only adds to a pair's estimate. Texts without
    words have no row.
    """

    def hashing():
        documents, frequencies = model.value
        shingler, sampler = Shingler(), Sampler(bands * per_band)
        number = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

        def one(batch: pa.RecordBatch):
            sets, at, size = [], [], 0

            def done() -> pa.RecordBatch:
                starts = np.cumsum([0] + [len(s) for s, _ in sets[:-1]])
                found = mixed(sampler(np.concatenate([s for s, _ in sets]), np.concatenate([v for _, v in sets]), starts))
                found >>= np.uint64(32)
                key = np.broadcast_to(number, (len(sets), bands))
                for i in range(per_band):
                    key = mixed(key * np.uint64(31) + found[:, i::per_band])
                ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands)
                keys = pa.ListArray.from_arrays(ends, pa.array(key.astype(np.int64).reshape(-1)))
                short = np.concatenate([found.astype(np.uint8), key.astype(np.uint16).view(np.uint8).reshape(len(sets), -1)], axis=1)
                return pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(at)), pa.array([row.tobytes() for row in short], pa.binary()),
                    pa.array([len(s) for s, _ in sets], pa.int32()), keys], ["id", "samples", "size", "keys"])

            for i, text in enumerate(batch.column("text").to_pylist()):
                shingles, times = shingler(text)
                if len(shingles):
                    sets.append((shingles, levels(shingles, times, documents, frequencies)))
                    at.append(i)
                    size += len(shingles)
                if size >= CHUNK:
                    yield done()
                    sets, at, size = [], [], 0
            if sets:
                yield done()

        return one

    return rows.mapInArrow(per_batch(hashing), f"id {dict(rows.dtypes)['id']}, samples binary, size int, keys array<long>")


def led(members: DataFrame, samples: int) -> DataFrame:
    """``(leader, id)`` from rows ``(key, block, order, id, samples)``: for each id, the likest of its buckets' leaders.

    A block's rows pass in their order, one after the other. A row that is probably like a leader follows the likest one,
    others lead those after them. This makes one class of most copies at little cost; ``crossing`` does the rest.
    """
    id_type = dict(members.dtypes)["id"]

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leaders, ids, count, follows = None, np.empty((16, samples), np.uint8), [], 0, FOLLOWS * samples
        for batch in batches:
            own = byte_rows(batch)[:, :samples]
            out = []
            for key, block, row, one in zip(*(batch.column(c).to_pylist() for c in ("key", "block", "id")), own, strict=True):
                if (key, block) != last:
                    last, ids, count = (key, block), [], 0
                if count:
                    equal = (leaders[:count] == one).sum(1)
                    best = int(equal.argmax())
                    if equal[best] >= follows:
                        out.append((ids[best], row, int(equal[best])))
                        continue
                if count == len(leaders):
                    leaders = np.concatenate([leaders, np.empty_like(leaders)])
                leaders[count] = one
                ids.append(row)
                count += 1
            if out:
                kind = batch.schema.field("id").type
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[i] for o in out], t) for i, t in enumerate((kind, kind, pa.int32()))], ["leader", "id", "equal"])

    ordered = members.repartition("key", "block").sortWithinPartitions("key", "block", "order").select("key", "block", "id", "samples")
    each = ordered.mapInArrow(leading, f"leader {id_type}, id {id_type}, equal int")
    likest = F.max_by("leader", F.struct("equal", F.xxhash64("leader")))
    return each.groupBy("id").agg(likest.alias("leader")).select("leader", "id")


def byte_rows(table: pa.RecordBatch | pa.Table) -> np.ndarray:
    """The ``samples`` of a table as rows of bytes."""
    return np.frombuffer(b"".join(table.column("samples").to_pylist()), np.uint8).reshape(table.num_rows, -1)


def likely(samples: np.ndarray, root: np.ndarray, block: np.ndarray, band: int, per_band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i, j of rows of a group's two blocks (or one) that are of different classes and may be links, and their equal samples.

    A pair that shares a bucket of an earlier band was met there. Rows of the most frequent class don't meet one another.
    """
    first, second = block == block.min(), block == block.max()
    within = block.min() == block.max()
    classes, number, times = np.unique(root, return_inverse=True, return_counts=True)
    minor = number != times.argmax()
    count_of = samples.shape[1] * per_band // (per_band + 2)  # a byte for each sample, two for each band
    columns = np.ascontiguousarray(samples[:, :count_of].T)
    bands = np.concatenate([samples[:, :count_of].reshape(len(samples), -1, per_band), samples[:, count_of:].reshape(len(samples), -1, 2)], axis=2)
    found = []
    for left, right in [(first & minor, second), (first & ~minor, second & minor)][: 1 if within else 2]:
        left, right = np.flatnonzero(left), np.flatnonzero(right)
        for start in range(0, len(left), STRIPE):
            own = left[start : start + STRIPE]
            count = np.zeros((len(own), len(right)), np.uint16)
            for column in columns:
                count += column[own, None] == column[right]
            a, b = np.nonzero((count >= MAYBE * len(columns)) & (number[own, None] != number[right]))
            i, j, equal = own[a], right[b], count[a, b]
            keep = (i < j) | ~minor[j] if within else np.ones(len(i), bool)
            i, j, equal = i[keep], j[keep], equal[keep]
            for at in range(0, len(i), 1 << 16):
                x, y, z = (c[at : at + (1 << 16)] for c in (i, j, equal))
                met = (bands[x, :band] == bands[y, :band]).all(2).any(1)
                found.append((x[~met], y[~met], z[~met]))
    if not found:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing
    i, j, equal = (np.concatenate(c) for c in zip(*found, strict=True))
    return i, j, equal


def group_arrays(group: pa.Table, roots: str = "root") -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    samples = byte_rows(group)
    _, root = np.unique(group.column(roots).to_numpy(), return_inverse=True)
    return samples, root, group.column("block").to_numpy(), group.column("band")[0].as_py()


def crossing(members: DataFrame, per_band: int) -> DataFrame:
    """Of rows ``(key, p, q, band, block, id, root, samples)``, those that may be linked to a row of another class, without samples.

    Blocks p and q of bucket ``key`` meet in one group, all rows with all.
    """
    kept = [c for c in members.columns if c != "samples"]

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["key", "p", "q"]):
            i, j, _ = likely(*group_arrays(group), per_band)
            if len(i):
                yield from group.select(kept).take(pa.array(np.union1d(i, j))).combine_chunks().to_batches()

    ordered = members.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return ordered.mapInArrow(meeting, members.select(*kept).schema)


def crossing_links(members: DataFrame, model, threshold: float, per_band: int) -> DataFrame:
    """``(a, b)`` from rows as of ``crossing`` with their texts: of all pairs that may be links, those that are and join classes.

    A pair is left out only where links found before it join its classes.
    """
    kind = dict(members.dtypes)["id"]

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, frequencies = model.value
        shingler = Shingler()
        for group in groups(batches, ["key", "p", "q"]):
            samples, root, block, band = group_arrays(group)
            i, j, equal = likely(samples, root, block, band, per_band)
            sets, parent, out = {}, list(range(len(root))), []

            def top(k: int) -> int:
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            def of(k: int):
                if k not in sets:
                    shingles, times = shingler(group.column("text")[k].as_py())
                    sets[k] = shingles, weights(levels(shingles, times, documents, frequencies))
                return sets[k]

            order = np.argsort(-equal.astype(np.int64), kind="stable")
            for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
                x, y = top(int(root[a])), top(int(root[b]))
                if x != y and similarity(*of(a), *of(b)) >= threshold:
                    parent[max(x, y)] = min(x, y)
                    out.append((a, b))
            if out:
                ids = group.column("id").combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([o[k] for o in out])) for k in (0, 1)], ["a", "b"])

    ordered = members.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return ordered.mapInArrow(meeting, f"a {kind}, b {kind}")


def verified(pairs: DataFrame, rows: DataFrame, model, threshold: float, followers: int = FOLLOWERS) -> DataFrame:
    """``(a, b)`` of those ``(leader, id)`` whose weighted Jaccard similarity reaches the threshold; ``pairs`` is written.

    A leader's text is sent once to each ``followers`` of its followers, not with every pair.
    """
    kind = dict(pairs.dtypes)["id"]

    def comparing():
        documents, frequencies = model.value
        shingler = Shingler()
        leader, of_leader = None, None

        def sets(text: str):
            shingles, times = shingler(text)
            return shingles, weights(levels(shingles, times, documents, frequencies))

        def one(batch: pa.RecordBatch):
            nonlocal leader, of_leader
            out = []
            for lead, follows, row, text in zip(*(batch.column(c).to_pylist() for c in ("leader", "follows", "id", "text")), strict=True):
                own = sets(text)
                if not follows:
                    leader, of_leader = lead, own
                elif lead == leader and similarity(*of_leader, *own) >= threshold:
                    out.append((lead, row))
            if out:
                kinds = batch.schema.field("id").type
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kinds) for i in (0, 1)], ["a", "b"])

        return one

    parts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / followers).cast("int").alias("parts"))
    leads = parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("follows"), F.col("leader").alias("id"))
    follow = pairs.join(parts, "leader").select("leader", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(True).alias("follows"), "id")
    dealt = leads.unionByName(follow).join(texts_of(rows, written(pairs.select(F.explode(F.array("leader", "id")).alias("id")).distinct(), "wanted")), "id")
    ordered = dealt.repartition("leader", "part").sortWithinPartitions("leader", "part", "follows").select("leader", "follows", "id", "text")
    return ordered.mapInArrow(per_batch(comparing), f"a {kind}, b {kind}")


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the ids of ``wanted``, which is written; of rows that repeat an id, any."""
    may = may_be_in(rows, F.xxhash64("id"), wanted.select(F.xxhash64("id").alias("h"))).where("__may").drop("__may")
    return may.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))


def near_edges(rows: DataFrame, firsts: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, per_band: int = ROWS, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: verified links between rows of ``(id, text)``, enough to connect classes.

    ``firsts`` has the ids of one row for each distinct text; frequencies count all rows, links are between these. First
    the rows of a bucket are led, large buckets block by block, and the links so found make classes. Then, in buckets of
    several classes, every row meets every other of another class, large buckets by pairs of blocks, and all pairs that may
    be links are compared by their texts; nothing is capped.
    """
    spark = rows.sparkSession
    model = spark.sparkContext.broadcast(document_frequencies(rows))
    known = written(sampled(rows, model, bands, per_band).join(firsts, "id", "left_semi"), "samples")
    keyed = known.select(F.posexplode("keys").alias("band", "key"), "id", "size")
    # A bucket's blocks are bounded in rows, and in shingles for texts that are long.
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum(F.col("size").cast("long")) / SHINGLES)).cast("int").alias("blocks")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), blocks).where("n > 1").drop("n")
    samples = known.select("id", "samples")
    block_of = F.pmod(F.xxhash64("id", "key"), "blocks").cast("int").alias("block")
    members = keyed.join(shared, "key").select("key", "id", F.xxhash64("id").alias("order"), block_of)
    pairs = written(led(members.join(samples, "id"), bands * per_band), "pairs")
    links = written(verified(pairs, rows, model, threshold), "links")
    drop(pairs)

    roots = connected_components(links, "a", "b").withColumnRenamed("node", "id")
    placed = written(keyed.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "placed")
    several = placed.groupBy("key").agg(blocks, F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "blocks")
    dealt = placed.join(several, "key").withColumn("block", block_of)
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), "band", "block", "id", "root")
    open_ = written(crossing(dealt.join(samples, "id"), per_band), "crossing")
    drop(placed)
    texts = texts_of(rows, written(open_.select("id").distinct(), "wanted"))
    further = written(crossing_links(open_.join(samples, "id").join(texts, "id"), model, threshold, per_band), "links")
    drop(open_)
    drop(known)
    return links.unionByName(further)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, class_id, kept.

    Documents are linked when their shingles' weighted Jaccard similarity is ``threshold`` or more; equal texts always
    are. A class is what links connect, its id the smallest document id in it, and that document is kept. Null counts as
    empty; texts without words are linked with equal texts only. A null id belongs to no class (class_id null) and is
    kept. Rows that repeat an id share its class, whatever their texts. Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    members = written(rows.where("id is not null").select("id", F.sha2("text", 256).alias("digest")), "members")
    of_text = written(members.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")), "texts")
    copies = join_groups(members, of_text, ["digest"], "n", "inner").where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    links = near_edges(rows, of_text.select(F.col("first").alias("id")).distinct(), threshold)
    roots = written(connected_components(links.unionByName(copies), "a", "b"), "classes")
    found = rows.select("id").join(roots, F.col("id") == F.col("node"), "left")
    class_id = F.coalesce("root", "id")
    return found.select(F.col("id").alias(id_col), class_id.alias("class_id"), (F.col("id").isNull() | (F.col("id") == class_id)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``near_dedup`` keeps. Rows that surely stay don't move with their texts."""
    dropped = written(near_dedup(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("__dropped")).distinct(), "dropped")
    judged = may_be_in(docs, F.xxhash64(F.col(id_col)), dropped.select(F.xxhash64("__dropped").alias("h")))
    stay = judged.where("__may").join(dropped, F.col(id_col) == F.col("__dropped"), "left_anti")
    return judged.where("not __may").unionByName(stay).drop("__may")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(load(spark, sf_dir, "documents"))
