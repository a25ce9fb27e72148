"""Repeated-substring removal: depth-limited radix passes over byte suffixes.

Every byte covered by a ``threshold``-byte string that also starts elsewhere
in the corpus is removed.  Suffixes need ordering only to that depth, and only
groups of equal suffixes matter, so the sort is a radix partition on digits,
most significant first; after each pass a suffix alone in its group drops out
(it cannot be repeated) and what is left of a full-depth group is exactly a
repeated window.  Digits are byte blocks, dealt by their hashes:

1. *Anchor digit.*  The leading digit of a window is the ``block``-byte string
   at its minimiser: of all blocks in the window, the one with the smallest
   hash (leftmost of equals).  Equal windows choose the same block at the same
   offset, so windows meet if they are equal.  Neighbouring windows mostly
   choose the same block: a run of them is one row, (block hash, context
   hash), where the context is the union of the run's windows.
2. *Context digit.*  A context seen twice makes all its windows repeated.  A
   context seen once, alone under its block, drops out.
3. *Window digits.*  Where a block has several different contexts, their
   bytes are fetched and the windows compared one by one, dealt by the block.
   A block with more than ``crowd`` different contexts is dealt by the windows
   themselves instead, so no task gathers it.

Groups are compared by two independent 64-bit hashes, always of strings that
agree on the passes before.  Rows are told apart by a unique number that is
written with them, whatever their ids and texts.  Counts are partial aggregates; the joins back to
the occurrences are sort-merge joins whose crowded keys AQE splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import Scratch, cut, dealt, prepare, small_batches, table

THRESHOLD, BLOCK, CROWD = 200, 64, 4096
#: Window starts handled at once: bounds a task's arrays for any text length.
CHUNK = 1 << 17
_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = [_RNG.integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1) for _ in range(2)]
_BASE = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_POS = _U((1 << 24) - 1)


@lru_cache(maxsize=2)
def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for base in _BASE:
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, _U(b))
            p[0] = 1
            pair.append(np.cumprod(p))
        out.append(tuple(pair))
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(29))


class _Rolling:
    """Hashes of any substrings of one byte string (at most the power table
    long), by prefix sums of a polynomial modulo 2^64."""

    def __init__(self, x: np.ndarray, which: int):
        power, self.inverse = _powers(CHUNK + (1 << 12))[which]
        self.sums = np.zeros(len(x) + 1, _U)
        np.cumsum(_BYTE[which][x] * power[: len(x)], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.inverse[a])

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return _mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """min(v[i:i+w]) for every i, by block-wise prefix and suffix minima."""
    m = len(v)
    g = np.full(-(-m // w) * w, _U(0xFFFFFFFFFFFFFFFF))
    g[:m] = v
    g = g.reshape(-1, w)
    ahead = np.minimum.accumulate(g, axis=1).ravel()
    behind = np.minimum.accumulate(g[:, ::-1], axis=1)[:, ::-1].ravel()
    s = m - w + 1
    return np.minimum(behind[:s], ahead[w - 1: w - 1 + s])


def runs(data: bytes, threshold: int, block: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The text's window runs, chunk by chunk: (block hash, context hash,
    first window start, number of windows, block start minus first start)."""
    whole = np.frombuffer(data, np.uint8)
    for base in range(0, max(0, len(whole) - threshold + 1), CHUNK):
        x = whole[base: base + CHUNK + threshold - 1]
        h0, h1 = _Rolling(x, 0), _Rolling(x, 1)
        kh = h0.all(block)
        order = (kh & ~_POS) | np.arange(len(kh), dtype=_U)
        pos = (_sliding_min(order, threshold - block + 1) & _POS).astype(np.int64)
        step = np.flatnonzero(np.diff(pos)) + 1
        a = np.concatenate(([0], step))
        b = np.concatenate((step, [len(pos)])) - 1
        p = pos[a]
        ctx = _mix(h1(a, b + threshold) + ((p - a) * 4099 + (b - a)).astype(_U) * _U(_BASE[0]))
        yield kh[p], ctx, a + base, b - a + 1, p - a


def _numbered(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """(row, doc_id, z, rest), written, dealt by row: row is a unique number, z
    the text's bytes compressed.  The text moves this once; later joins bring
    spans and requests to it."""
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rest = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), data.alias("data"), rest.alias("rest"))
    schema = T.StructType([f if f.name != "data" else T.StructField("z", T.BinaryType()) for f in rows.schema.fields])

    def run(batches):
        c = zstandard.ZstdCompressor(level=1)
        for b in small_batches(batches):
            z = pa.array([c.compress(x) for x in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), z, b.column(3)], [f.name for f in schema.fields])

    return dealt(rows.mapInArrow(run, schema), "row")


def _unpack(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def _occurrences(rows: DataFrame, threshold: int, block: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            cols: list[list] = [[], [], [], [], []]
            row = []
            for i, z in enumerate(b.column(1).to_pylist()):
                for part in runs(_unpack(z), threshold, block):
                    row.append(np.full(len(part[0]), i))
                    for c, v in zip(cols, part):
                        c.append(v)
            if row:
                row = pa.array(np.concatenate(row))
                k, c, a, n, lead = (np.concatenate(x) for x in cols)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(row), pa.array(k.view(np.int64)), pa.array(c.view(np.int64)),
                     pa.array(a.astype(np.int64)), pa.array(n.astype(np.int16)), pa.array(lead.astype(np.int16))],
                    ["row", "block", "ctx", "start", "n", "lead"])

    return rows.select("row", "z").mapInArrow(run, "row long, block long, ctx long, start long, n short, lead short")


def _windows(data: list[bytes], threshold: int):
    """Of all windows of several contexts: (context number, start, hash, hash)."""
    who, at, w0, w1 = [], [], [], []
    for i, d in enumerate(data):
        x = np.frombuffer(d, np.uint8)
        n = len(x) - threshold + 1
        who.append(np.full(n, i))
        at.append(np.arange(n))
        w0.append(_Rolling(x, 0).all(threshold))
        w1.append(_Rolling(x, 1).all(threshold))
    return tuple(np.concatenate(v) for v in (who, at, w0, w1))


def _spans_of(who: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts per context: (context, first, last)."""
    if not len(who):
        return who, at, at
    new = np.concatenate(([True], (np.diff(who) != 0) | (np.diff(at) != 1)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(who)])) - 1
    return who[first], at[first], at[last]


def _compare(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block (row, block, start, data): the windows that
    are equal to one of another context of the same block, as spans."""
    names = ["row", "start", "stop"]

    def solve(t: pa.Table) -> pa.RecordBatch:
        who, at, w0, w1 = _windows(t.column("data").to_pylist(), threshold)
        key = w0 ^ _mix(t.column("block").to_numpy().view(_U)[who])
        order = np.lexsort((w1, key))
        same = (np.diff(key[order]) == 0) & (np.diff(w1[order]) == 0)
        hit = np.zeros(len(who), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        row, a, b = _spans_of(who[hit], at[hit])
        base = t.column("start").to_numpy()[row]
        i = pa.array(row)
        return pa.RecordBatch.from_arrays([t.column("row").combine_chunks().take(i), pa.array(base + a), pa.array(base + b + threshold)], names)

    left = None
    for b in small_batches(batches, 2048):
        t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
        k = t.column("block").to_numpy()
        change = np.flatnonzero(np.diff(k)) + 1
        whole = int(change[-1]) if len(change) else 0  # the last block may go on in the next batch
        if whole:
            yield solve(t.slice(0, whole).combine_chunks())
        left = t.slice(whole)
    if left is not None and left.num_rows:
        yield solve(left.combine_chunks())


def repeated_spans(rows: DataFrame, scratch: Scratch, threshold: int = THRESHOLD, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """(row, start, stop) of ``rows(row, z)``, as ``_numbered`` writes them:
    byte ranges made of repeated windows; they may overlap, and together they
    cover every byte that is to go.  It reads the tables of ``scratch``."""
    # pass 1: a block met once cannot be part of a repeated window
    every = _occurrences(rows, threshold, block)
    twice = scratch.keep(every.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select("block"), "blocks")
    seen = scratch.keep(every.join(twice, "block", "left_semi"), "seen")
    # pass 2, on what is left: how often each context occurs (m), and how many
    # contexts share its block (k)
    ctx = seen.groupBy("block", "ctx").agg(F.count("*").alias("m"), F.min(F.struct("row", "start", "n")).alias("at"))
    shared = scratch.keep(ctx.groupBy("block").agg(F.count("*").alias("k")), "shared")
    live = scratch.keep(ctx.join(shared, "block").where("m > 1 or k > 1").select("block", "ctx", "m", "k", "at"), "live")
    full = seen.join(live.where("m > 1").select("block", "ctx"), ["block", "ctx"]).select(
        "row", "start", (F.col("start") + F.col("n") + (threshold - 1)).alias("stop"))
    # one occurrence of each context that shares its block with another context
    need = live.where("k > 1").select("block", "k", "at.row", "at.start", "at.n")

    def slices(batches):
        for b in small_batches(batches, 256):
            got = [_unpack(z) for z in b.column(1).to_pylist()]
            row, block_, k_, start_, data_ = [], [], [], [], []
            for i, (data, want) in enumerate(zip(got, b.column(2).to_pylist())):
                for w in want:
                    row.append(i)
                    block_.append(w["block"])
                    k_.append(w["k"])
                    start_.append(w["start"])
                    data_.append(data[w["start"]: w["start"] + w["n"] + threshold - 1])
            i = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(i), pa.array(block_, pa.int64()), pa.array(k_, pa.int64()), pa.array(start_, pa.int64()), pa.array(data_, pa.binary())],
                ["row", "block", "k", "start", "data"])

    asked = need.groupBy("row").agg(F.collect_list(F.struct("block", "k", "start", "n")).alias("want"))
    some = rows.select("row", "z").join(asked.hint("merge"), "row").select("row", "z", "want")
    parts = scratch.keep(some.mapInArrow(slices, "row long, block long, k long, start long, data binary"), "parts")
    columns = "row long, start long, stop long"
    near = parts.where(F.col("k") <= crowd).select("row", "block", "start", "data").repartition("block").sortWithinPartitions("block").mapInArrow(lambda it: _compare(it, threshold), columns)

    def explode(batches):
        for b in small_batches(batches, 1024):
            who, at, w0, w1 = _windows(b.column(3).to_pylist(), threshold)
            i = pa.array(who)
            key = w0 ^ _mix(b.column(1).to_numpy().view(_U)[who])
            yield pa.RecordBatch.from_arrays([b.column(0).take(i), pa.array(b.column(2).to_numpy()[who] + at), pa.array(key.view(np.int64)), pa.array(w1.view(np.int64))], ["row", "start", "w0", "w1"])

    single = parts.where(F.col("k") > crowd).select("row", "block", "start", "data").mapInArrow(explode, "row long, start long, w0 long, w1 long")
    twice = single.groupBy("w0", "w1").agg(F.count("*").alias("m")).where("m > 1").select("w0", "w1")
    far = single.join(twice, ["w0", "w1"]).select("row", "start", (F.col("start") + threshold).alias("stop"))
    return full.unionByName(near).unionByName(far)


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, kept (binary: the remaining bytes;
    or, ``as_text``, the remaining text without characters that were cut
    apart), n_bytes, spans (array of start, stop: the maximal removed runs) and rest
    (a struct of the ``carry`` columns).

    Null and empty texts, and texts under ``threshold`` bytes, have nothing
    removed.  Repeated rows lose all their windows, each being repeated by the
    other.  Every row is handled for itself, whatever rows share its id; null
    ids are kept.  An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = _numbered(docs, id_col, text_col, list(carry))
    scratch = Scratch(docs.sparkSession)
    spans = repeated_spans(rows, scratch, threshold, block, crowd)
    mine = cut(spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    scratch.drop()
    joined = rows.join(mine.hint("merge"), "row", "left").select("doc_id", "z", "rest", "spans")
    rest = joined.schema["rest"]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("kept", T.StringType() if as_text else T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), rest])

    def run(batches):
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for b in small_batches(batches, 256):
            kept, size, out = [], [], []
            col = b.column(3)
            for i, z in enumerate(b.column(1).to_pylist()):
                data = _unpack(z)
                size.append(len(data))
                merged = []
                if col[i].is_valid:
                    flat = col[i].values
                    a, e = flat.field("start").to_numpy(), flat.field("stop").to_numpy()
                    order = np.argsort(a, kind="stable")
                    a, e = a[order], np.maximum.accumulate(e[order])
                    first = np.concatenate(([True], a[1:] > e[:-1]))
                    stop = e[np.concatenate((np.flatnonzero(first)[1:], [len(a)])) - 1]
                    merged = list(zip(a[first].tolist(), stop.tolist()))
                edge = [0, *(v for s in merged for v in s), len(data)]
                left = b"".join(data[x:y] for x, y in zip(edge[::2], edge[1::2])) if merged else data
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
                out.append([{"start": s, "stop": e} for s, e in merged])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(size, pa.int64()), pa.array(out, span_type), b.column(2)], ["doc_id", "kept", "n_bytes", "spans", "rest"])

    return joined.mapInArrow(run, schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed bytes and the rest of every document; edge cases as in
    ``remove_repeats``."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
