"""Tables of hashes in sorted shards, written by tasks to the shared folder and mapped into memory by workers."""

from __future__ import annotations

import json
import os
import uuid
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.scratch import new_path, shared_dir

#: Tables of one kind that a worker keeps mapped at a time.
MOST_OPEN = 256


def shards_for(rows: DataFrame, shard_bytes: int) -> int:
    """How many shards of ``shard_bytes`` of text each the ``text`` of all rows takes."""
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return -(-size // shard_bytes) or 1


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash: a range of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Store:
    """Shards of tables as files in the shared folder: written whole by the task that made them, mapped by workers.

    The folder must be one that executors see as files (a mount). A table is one file; a task that runs again writes it
    anew and puts it in place in one step. ``seal`` compares what the driver finds with what tasks say they wrote, so a
    folder that isn't shared is found out, and a table that is missing later is an error, not an empty table. Of a key
    the upper 48 bits are kept: 16 of them as the place where keys that begin with these start, 32 as a sorted array;
    values are numbers of the shard's distinct rows of values.
    """

    def __init__(self, spark: SparkSession, name: str):
        where = urlparse(new_path(spark, name))
        if where.scheme not in ("", "file"):
            raise ValueError(f"memory-mapped tables need a mounted folder in spark.checkpoint.dir, not {shared_dir(spark)}")
        self.path, self.present = where.path, {}

    def put(self, kind: str, shard: int, keys: np.ndarray, *values: np.ndarray) -> int:
        """Sorted keys and their columns of values; no keys, no table. The number of tables written."""
        if not len(keys):
            return 0
        os.makedirs(self.path, exist_ok=True)
        rows = np.stack(values, 1).astype(np.int64)
        if all(v.max(initial=0) < 1 << (63 // len(values)) for v in values):
            one = np.zeros(len(rows), np.int64)
            for v in values:
                one = (one << (63 // len(values))) | v
            _, first, number = np.unique(one, return_index=True, return_inverse=True)
            distinct = rows[first]
        else:
            distinct, number = np.unique(rows, axis=0, return_inverse=True)
        number = number.reshape(-1).astype(np.uint8 if len(distinct) <= 1 << 8 else np.uint16 if len(distinct) <= 1 << 16 else np.uint32)
        starts = np.searchsorted(keys >> np.uint64(48), np.arange((1 << 16) + 1, dtype=np.uint64)).astype(np.uint32)
        parts = {"starts": starts, "rest": (keys >> np.uint64(16)).astype(np.uint32), "number": number, "values": distinct}
        shapes = json.dumps([[a.dtype.str, a.shape] for a in parts.values()]).encode()
        own = f"{self.path}/.{uuid.uuid4().hex}"
        with open(own, "wb") as file:
            file.write(len(shapes).to_bytes(8, "little") + shapes)
            for array in parts.values():
                file.write(b"\0" * (-file.tell() % 8))
                array.tofile(file)
        os.replace(own, f"{self.path}/{kind}.{shard}")
        return 1

    def seal(self, shards: int, tables: int) -> None:
        """Note which tables there are, a bit for each shard and kind, once all ``tables`` have been written."""
        found = [name.rsplit(".", 1) for name in (os.listdir(self.path) if tables else []) if name[0] != "."]
        if len(found) != tables:
            raise FileNotFoundError(f"{tables} tables were written, but {len(found)} are in {self.path}: spark.checkpoint.dir must be a folder that all machines share")
        for kind in {k for k, _ in found}:
            bits = np.zeros(shards, bool)
            bits[[int(n) for k, n in found if k == kind]] = True
            self.present[kind] = np.packbits(bits)

    def get(self, kind: str, shard: int) -> list[np.ndarray] | None:
        """The arrays of a table, mapped; none for a shard without keys."""
        bits = self.present.get(kind)
        if bits is None or not bits[shard >> 3] >> (7 - (shard & 7)) & 1:
            return None
        whole = np.asarray(np.memmap(f"{self.path}/{kind}.{shard}", np.uint8, "r"))
        at, out = 8 + int.from_bytes(whole[:8].tobytes(), "little"), []
        for dtype, shape in json.loads(whole[8:at].tobytes()):
            at += -at % 8
            size = int(np.prod(shape)) * np.dtype(dtype).itemsize
            out.append(whole[at : at + size].view(dtype).reshape(shape))
            at += size
        return out


class Shards:
    """Lookups in the mapped shards of one kind; of those opened, the ``MOST_OPEN`` used last stay open."""

    def __init__(self, store: Store, kind: str, shards: int, missing: tuple[int, ...]):
        self.store, self.kind, self.shards, self.missing = store, kind, shards, np.array(missing, np.int64)
        self.open: OrderedDict = OrderedDict()

    def opened(self, number: int) -> list[np.ndarray] | None:
        if number not in self.open:
            self.open[number] = self.store.get(self.kind, number)
            if len(self.open) > MOST_OPEN:
                self.open.popitem(last=False)  # unmapped with its last array
        self.open.move_to_end(number)
        return self.open[number]

    def __call__(self, hashes: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Rows of values of keys, in the shards of ``hashes``; ``missing`` where there are none."""
        shard = shard_of(hashes, self.shards).astype(np.uint16 if self.shards <= 1 << 16 else np.uint32)
        order = np.argsort(shard, kind="stable")
        sorted_ = shard[order]
        edges = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(order) else []
        out = np.broadcast_to(self.missing, (len(key), len(self.missing))).copy()
        for own in np.split(order, edges[1:]) if len(order) else []:
            table = self.opened(int(shard[own[0]]))
            if table is None:
                continue
            starts, rest, row, values = table
            first, wanted = (key[own] >> np.uint64(48)).astype(np.int64), (key[own] >> np.uint64(16)).astype(np.uint32)
            low, end = starts[first].astype(np.int64), starts[first + 1].astype(np.int64)
            for step in 1 << np.arange(int((end - low).max()).bit_length())[::-1]:  # halve the keys that begin alike
                probe = low + (step - 1)
                less = rest.take(probe, mode="clip") < wanted
                less &= probe < end
                low += less * step
            found = (low < end) & (rest.take(low, mode="clip") == wanted)
            out[own[found]] = values[row[low[found]]]
        return out
