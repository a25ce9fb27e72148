"""Best-fit-decreasing packing of token pieces into fixed-length sequences, in
bulk rounds.

There is one round per size, from the largest down.  It sweeps the open gaps
upwards: each gap takes as long a run of the round's equal pieces as it holds,
and new sequences are opened for what is left.  This is best fit decreasing,
piece by piece: what a piece leaves of the smallest gap is the smallest gap
again, until no further piece of the size goes in.

Gaps of one size whose sequences were numbered in a row are one row (size,
first sequence, number of sequences).  A round splits at most one of them in
three and opens at most two, so the rounds need no more than the number of
pieces of each size, and their state is bounded by the capacity, not by the
pieces.  A piece finds its place by its rank among the pieces of its size: a
running count per range partition plus the totals of the partitions before it
(one number per partition and size).
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, keyed_text, prepare, small_batches, table
from .tokens import default_path, token_ids

CAPACITY, END_ID = 1024, 2


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the
    closing ``end_id``, cut into pieces of ``capacity`` of which the first may
    be shorter.  Null texts count as empty (one piece holding ``end_id``)."""
    prepare(docs.sparkSession)
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = token_ids(path)
        for b in small_batches(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(ids_of(text), end_id).astype("<u4")
                at = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, e) in enumerate(zip(at, at[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(e - a)
                    crc.append(zlib.crc32(ids[a:e].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def rounds(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Best fit decreasing of ``counts[size]`` pieces of each size.  Per size
    rows (rank, first, each, place), by rank: from this rank on, each sequence
    from ``first`` on takes ``each`` pieces, at ``place`` and after."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # free space -> (first sequence, number of sequences)
    opened, out = 0, {}
    for size in sorted(counts, reverse=True):
        rank, left, rows = 0, counts[size], []

        def take(free: int, first: int, n: int) -> None:
            nonlocal rank, left
            each = free // size
            full = min(n, left // each)
            for m, k in ((full, each), (int(full < n), left - full * each)):  # the second: one gap for the last few
                if m and k:
                    rows.append((rank, first, k, capacity - free))
                    if free > k * size:
                        gaps.setdefault(free - k * size, []).append((first, m))
                    rank, left, first, n = rank + m * k, left - m * k, first + m, n - m
            if n:
                gaps.setdefault(free, []).append((first, n))

        for free in sorted(g for g in gaps if g >= size):
            if not left:
                break
            for first, n in gaps.pop(free):
                take(free, first, n)
        if left:
            n = -(-left // (capacity // size))
            opened += n
            take(capacity, opened - n, n)
        out[size] = rows
    return out


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items(id long, unique; size long, 1 to capacity) -> (id, sequence_id,
    place): each item's sequence, numbered from 0, and its offset there,
    without gaps from 0.  As many sequences as best fit decreasing makes."""
    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            size = b.column(1).to_numpy()
            if not len(size):
                continue
            first = np.concatenate(([0], np.flatnonzero(np.diff(size)) + 1))
            at = np.arange(len(size)) - np.repeat(first, np.diff(np.append(first, len(size))))
            if size[0] == last:
                at[: first[1] if len(first) > 1 else len(size)] += seen
            last, seen = size[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(at)], ["id", "size", "part", "rank"])

    ordered = cut(items.select("id", F.col("size").cast("long").alias("size")).repartitionByRange("size", "id").sortWithinPartitions("size", "id")
                  .mapInArrow(ranked, "id long, size long, part int, rank long"))
    before, counts = {}, Counter()  # a row per partition and size, and sizes lie in a row
    for part, size, n in sorted(tuple(r) for r in ordered.groupBy("part", "size").agg(F.count("*")).collect()):
        before[part, size] = counts[size]
        counts[size] += n
    sent = items.sparkSession.sparkContext.broadcast((before, rounds(counts, capacity)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, plan = sent.value
        for b in batches:
            sequence, place = [], []
            for size, part, rank in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                rank += before[part, size]
                rows = plan[size]
                start, first, each, at = rows[bisect_right(rows, rank, key=lambda r: r[0]) - 1]
                n, k = divmod(rank - start, each)
                sequence.append(first + n)
                place.append(at + k * size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sequence, pa.int64()), pa.array(place, pa.int64())], ["id", "sequence_id", "place"])

    return ordered.mapInArrow(placed, "id long, sequence_id long, place long")


def packed_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """The pieces of ``token_pieces`` with sequence_id and offset.

    Repeated rows and shared or null ids are packed as rows of their own; other
    columns, whatever their names, are not read; one document's ids are held
    at a time; an empty table gives an empty result.
    """
    p = cut(token_pieces(docs, capacity, end_id, tokenizer)).withColumn("id", F.monotonically_increasing_id())
    at = pack(p.select("id", F.col("length").alias("size")), capacity)
    return p.join(at, "id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("place").alias("offset"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences; edge cases as in ``packed_pieces``."""
    return packed_pieces(table(spark, sf_dir, "documents"))
