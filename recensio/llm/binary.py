"""Packed token-id shards: best-fit-decreasing packing and a binary format.

Each task takes documents until their ids reach ``shard_tokens``, splits those
longer than a row into pieces without loss, and packs the pieces, longest
first, each into the fullest row that takes it.  That row is found by a
segment tree over free capacities: a node counts the rows whose free space
lies in its range, and the smallest capacity that is large enough and taken by
a row is found going up and down once.  A shard is packed and written by one
task in memory bounded by ``shard_tokens`` (or one document); shards are
independent, so nothing is shuffled and a lost task writes its shards again.

A shard file holds the id matrix (rows x width, little-endian, padded), each
row's cumulative segment lengths, and per segment its document, its start
within the document, and the offset in the row where positions restart.
Files are written by Spark's text writer, a shard per row; its line separator
is the format's end mark.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import keyed_text, prepare, shared_folder, small_batches, table
from .tokens import default_path, token_ids

WIDTH, END_ID, SHARD_TOKENS = 2048, 50256, 1 << 22
MAGIC, FOOT = b"IDSHARD1", b"\n#IDSHARD1 end#\n"


class Capacities:
    """Segment tree over free capacities 0 to ``top``, counting rows."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int = 1) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += n
            node >>= 1

    def at_least(self, capacity: int) -> int:
        """The smallest capacity of a row that is at least this, or -1."""
        node, count = capacity + self.size, self.count
        while not count[node]:
            # up until there is a right sibling that counts
            while node & 1 or not count[node + 1]:
                node >>= 1
                if node <= 1:
                    return -1
            node += 1
        while node < self.size:
            node *= 2
            if not count[node]:
                node += 1
        return node - self.size


def best_fit_decreasing(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Rows as lists of piece numbers; the longest piece first, ties in order."""
    rows: list[list[int]] = []
    tree, having = Capacities(width), [[] for _ in range(width + 1)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        free = tree.at_least(need)
        if free < 0:
            row, free = len(rows), width
            rows.append([])
        else:
            row = having[free].pop()
            tree.add(free, -1)
        rows[row].append(i)
        if free > need:
            having[free - need].append(row)
            tree.add(free - need)
    return rows


def shard_bytes(name: str, docs: list[tuple[int | None, np.ndarray]], width: int, pad: int, dtype: str) -> bytes:
    """One shard (without its end mark) of documents (id, token ids)."""
    pieces = [(i, doc, a, ids[a: a + width]) for i, (doc, ids) in enumerate(docs) for a in range(0, len(ids), width)]
    rows = best_fit_decreasing(np.array([len(p[3]) for p in pieces], np.int64), width)
    matrix = np.full((len(rows), width), pad, dtype)
    splits, cu, order = [0], [], []
    for r, members in enumerate(rows):
        at = 0
        cu.append(0)
        for m in members:
            ids = pieces[m][3]
            matrix[r, at: at + len(ids)] = ids
            at += len(ids)
            cu.append(at)
            order.append(m)
        splits.append(len(order))
    resets = np.concatenate([cu_row[:-1] for cu_row in np.split(np.array(cu, "<u4"), [s + r for r, s in enumerate(splits)][1:-1])]) if rows else np.empty(0, "<u4")
    head = json.dumps({"name": name, "rows": len(rows), "width": width, "pad": pad, "dtype": dtype, "segments": len(order)}).encode()
    parts = [MAGIC, struct.pack("<I", len(head)), head, matrix.tobytes(), np.array(splits, "<u4").tobytes(), np.array(cu, "<u4").tobytes(), resets.astype("<u4").tobytes(),
             np.array([pieces[m][1] or 0 for m in order], "<i8").tobytes(), np.array([pieces[m][1] is None for m in order], "u1").tobytes(), np.array([pieces[m][2] for m in order], "<i8").tobytes()]
    return b"".join(parts)


def parse_shard(data: bytes) -> Iterator[dict]:
    """The rows of one shard file: ids (without padding), cu_seqlens, resets,
    doc_ids and starts."""
    if not data:
        return
    if not data.startswith(MAGIC) or not data.endswith(FOOT):
        raise ValueError("not a whole shard")
    (n,) = struct.unpack_from("<I", data, len(MAGIC))
    at = len(MAGIC) + 4 + n
    head = json.loads(data[len(MAGIC) + 4: at])

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype, count, at)
        at += out.nbytes
        return out

    rows, width, segments = head["rows"], head["width"], head["segments"]
    matrix = take(head["dtype"], rows * width).reshape(rows, width)
    splits, cu, resets = take("<u4", rows + 1).astype(int), take("<u4", segments + rows), take("<u4", segments)
    docs, none, starts = take("<i8", segments), take("u1", segments), take("<i8", segments)
    if at + len(FOOT) != len(data):
        raise ValueError("shard of another length")
    for r in range(rows):
        s = slice(splits[r], splits[r + 1])
        lens = cu[splits[r] + r: splits[r + 1] + r + 1]
        yield {"shard": head["name"], "row": r, "ids": matrix[r, : lens[-1]], "cu_seqlens": lens, "resets": resets[s],
               "doc_ids": [None if z else d for d, z in zip(docs[s].tolist(), none[s].tolist())], "starts": starts[s]}


def position_ids(length: int, resets: np.ndarray) -> np.ndarray:
    """Positions of a row: counting from 0 again at each reset."""
    base = np.zeros(length, np.int64)
    base[resets[1:]] = np.diff(resets.astype(np.int64))
    return np.arange(length) - np.cumsum(base)


def write_shards(docs: DataFrame, path: str, width: int = WIDTH, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, tokenizer: str | None = None) -> None:
    """Write the ids of every document (and ``end_id`` after each) as shards.

    Null texts count as empty: one segment holding ``end_id``.  Repeated rows
    and null ids are rows of their own.  Other columns, whatever their names,
    are not read.  A shard's ids, and so any one document's, are held in memory.
    An empty table writes no shard.
    """
    prepare(docs.sparkSession)
    source = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = token_ids(source), TaskContext.get().partitionId()
        dtype = "<u2" if ids_of.n_vocab <= 1 << 16 and end_id < 1 << 16 else "<u4"
        held, size, n = [], 0, 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([shard_bytes(f"{part:05d}-{n:05d}", held, width, end_id, dtype)], pa.binary())], ["shard"])

        for b in small_batches(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(ids_of(text), end_id).astype(dtype)
                held.append((doc, ids))
                size += len(ids)
                if size >= shard_tokens:
                    yield out()
                    held, size, n = [], 0, n + 1
        if held:
            yield out()

    shards = keyed_text(docs).mapInArrow(run, "shard binary")
    text = shards.select(F.col("shard").cast("string").alias("value"))
    text.write.option("lineSep", FOOT.decode()).option("maxRecordsPerFile", 1).text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per packed row: shard, row, n_tokens, doc_ids, starts,
    cu_seqlens, resets, and ids (binary, little-endian unsigned 32-bit)."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        for b in batches:
            for k in range(b.num_rows):
                rows: list[dict] = []

                def out():
                    col = lambda f, t: pa.array([f(x) for x in rows], t)
                    return pa.RecordBatch.from_arrays(
                        [col(lambda x: x["shard"], pa.string()), col(lambda x: x["row"], pa.int32()), col(lambda x: len(x["ids"]), pa.int64()), col(lambda x: x["doc_ids"], longs),
                         col(lambda x: x["starts"], longs), col(lambda x: x["cu_seqlens"].astype(np.int32), ints), col(lambda x: x["resets"].astype(np.int32), ints),
                         col(lambda x: x["ids"].astype("<u4").tobytes(), pa.binary())], ["shard", "row", "n_tokens", "doc_ids", "starts", "cu_seqlens", "resets", "ids"])

                for x in parse_shard(b.column(0)[k].as_py()):
                    rows.append(x)
                    if len(rows) >= 256:
                        yield out()
                        rows.clear()
                yield out()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(
        run, "shard string, row int, n_tokens long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, resets array<int>, ids binary")


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into shards and read back; edge cases as in
    ``write_shards``."""
    path = shared_folder(spark, "shards")
    write_shards(table(spark, sf_dir, "documents"), path)
    return read_shards(spark, path).select("shard", "row", "n_tokens", "doc_ids", "starts", "cu_seqlens", "resets", F.sha2("ids", 256).alias("ids_sha256"))
