"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint is the bitwise majority of the XXH64 values of its word
shingles.  To find all pairs of fingerprints within ``max_bits``, the words of
a linear covering code serve as anchors: every fingerprint lies within the
covering radius R of some anchor (its home), so a fingerprint within
``max_bits`` of it lies within R + ``max_bits`` of that same anchor.  Each
distinct fingerprint is therefore sent to all anchors within R + max_bits, and
at each anchor the fingerprints at home there are compared with all sent
there.  No pair is lost, and each is met once.

The code is the direct sum of the perfect [23,12] Golay code and the perfect
[7,4] Hamming code on the fingerprint's low 30 bits: 65,536 anchors, R = 4, of
which about 47 lie within 6.  With more fingerprints the anchors would become
crowded; then it is the sum of two Golay codes, on 46 bits: 16.8 million
anchors, R = 6, of which about 80 lie within 8.  The work at the anchors grows
with the square of the fingerprints divided by the anchors.
The distance over those bits is at most the distance over all 64, and the
comparison at the anchor uses all 64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, keyed_text, prepare, small_batches, table
from .components import connected_components

SEED = 42
#: Distinct fingerprints from which the wider code costs less (measured by the
#: rows it sends: 80 instead of 47, against 256 times the anchors).
WIDE_FROM = 2_000_000
GOLAY_POLY = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


# ---- fingerprints ---------------------------------------------------------

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit set (bit 0 first)."""
    by = h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    if len(h) < 512:
        return np.unpackbits(by, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(by[:, j], minlength=256) @ _BITS for j in range(8)])


def fingerprint(text: str, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text (0 for a text without words)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts, step = np.zeros(64, np.int64), 1 << 16
    for i in range(0, n, step):
        pairs = zip(starts[i:min(n, i + step)].tolist(), last[i:i + step].tolist())
        counts += _bit_counts(np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64))
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, fp): the fingerprint of each whole text as a signed long,
    and a hash of the text that tells rows sharing an id apart.  A null text
    counts as empty; a null id is kept as null."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp)], ["doc_id", "h", "fp"])

    rows = keyed_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, h long, fp long")


# ---- covering code --------------------------------------------------------

def _golay_columns() -> list[int]:
    cols, r = [], 1
    for _ in range(23):
        cols.append(r)
        r <<= 1
        if r >> 11:
            r ^= GOLAY_POLY
    return cols


class Part:
    """A binary linear code given by the syndrome of each single bit, with
    every error pattern up to a weight, by syndrome and weight."""

    def __init__(self, columns: list[int], weight: int):
        self.n, self.weight = len(columns), min(weight, len(columns))
        syndromes = 1 << max(columns).bit_length()
        cols = np.array(columns, np.int64)
        byte = np.arange(256)
        self._tables = []
        for i in range(0, self.n, 8):
            t = np.zeros(256, np.int64)
            for j, c in enumerate(cols[i:i + 8]):
                t ^= np.where(byte >> j & 1, c, 0)
            self._tables.append(t)
        pats, top, every = np.zeros(1, np.int64), np.full(1, -1), [np.zeros(1, np.int64)]
        for _ in range(self.weight):
            nxt, tops = [], []
            for j in range(self.n):
                p = pats[top < j] | (1 << j)
                nxt.append(p)
                tops.append(np.full(len(p), j))
            pats, top = np.concatenate(nxt), np.concatenate(tops)
            every.append(pats)
        flat = np.concatenate(every)
        key = self.syndrome(flat) * (self.weight + 1) + np.repeat(np.arange(len(every)), [len(e) for e in every])
        order = np.argsort(key, kind="stable")
        self.patterns = flat[order]
        # first[s, w]: where the patterns of syndrome s and weight w begin
        edges = np.searchsorted(key[order], np.arange(syndromes * (self.weight + 1) + 1))
        self.first = np.stack([np.append(edges[s * (self.weight + 1):(s + 1) * (self.weight + 1)], edges[(s + 1) * (self.weight + 1)]) for s in range(syndromes)])
        #: A lightest pattern of each syndrome; the heaviest of them has the
        #: covering radius.
        self.leader = self.patterns[self.first[:, 0]]
        self.radius = int(np.bitwise_count(self.leader).max())

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for k, t in enumerate(self._tables):
            out ^= t[(x >> (8 * k)) & 255]
        return out


class CoveringCode:
    """The direct sum of two codes, on the low bits of a value: radii add up,
    and a pattern is a pair of patterns."""

    def __init__(self, low: list[int], high: list[int], reach: int):
        """reach: how far beyond the covering radius anchors are wanted."""
        radius = sum(Part(c, 4).radius for c in (low, high))  # these codes' radii are at most 3
        self.low, self.high = Part(low, radius + reach), Part(high, radius + reach)
        self.radius, self.within = radius, radius + reach
        self.n = self.low.n + self.high.n

    def _split(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = fp & ((1 << self.n) - 1)
        return x, self.low.syndrome(x & ((1 << self.low.n) - 1)), self.high.syndrome(x >> self.low.n)

    def home(self, fp: np.ndarray) -> np.ndarray:
        """A nearest anchor of each value (on the code's bits)."""
        x, s, t = self._split(fp)
        return x ^ self.low.leader[s] ^ (self.high.leader[t] << self.low.n)

    def anchors(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor): every anchor within radius + reach of each value."""
        x, s, t = self._split(fp)
        rows, out = [], []
        for w in range(min(self.low.weight, self.within) + 1):
            # patterns of weight w below, of what is left of the weight above
            a, n = self.low.first[s, w], self.low.first[s, w + 1] - self.low.first[s, w]
            b = self.high.first[t, 0]
            m = self.high.first[t, min(self.within - w, self.high.weight) + 1] - b
            each = n * m
            row = np.repeat(np.arange(len(x)), each)
            k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            i, j = np.divmod(k, np.maximum(m, 1)[row])
            rows.append(row)
            out.append(x[row] ^ self.low.patterns[a[row] + i] ^ (self.high.patterns[b[row] + j] << self.low.n))
        return np.concatenate(rows), np.concatenate(out)


@lru_cache(maxsize=4)
def covering_code(reach: int, wide: bool = False) -> CoveringCode:
    return CoveringCode(_golay_columns(), _golay_columns() if wide else list(range(1, 8)), reach)


# ---- links ----------------------------------------------------------------

def links(fps: DataFrame, max_bits: int, wide: bool | None = None) -> DataFrame:
    """(a, b): every pair of different fingerprints of ``fps(fp)`` (distinct
    values) within ``max_bits``, once.  wide: the code with more anchors, by
    default for more than ``WIDE_FROM`` fingerprints; the pairs are the same."""
    prepare(fps.sparkSession)
    if wide is None:
        wide = fps.count() > WIDE_FROM

    def at_home(batches):
        code = covering_code(max_bits, wide)
        for b in batches:
            fp = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(code.home(fp)), b.column(0)], ["anchor", "a"])

    def sent(batches):
        code = covering_code(max_bits, wide)
        for b in small_batches(batches, 2048):
            fp = b.column(0).to_numpy()
            row, anchor = code.anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row])], ["anchor", "b"])

    one = fps.select("fp")
    home = one.mapInArrow(at_home, "anchor long, a long")
    away = one.mapInArrow(sent, "anchor long, b long")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    # merge: both sides are dealt by anchor, and AQE splits a crowded anchor
    return home.hint("merge").join(away, "anchor").where(near).select("a", "b")


def simhash_components(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, fp, root, component_id), one row per row of ``docs``.

    root is the group's smallest fingerprint and names it.  component_id is the smallest id reachable over links of at most
    ``max_bits`` differing bits.  Equal fingerprints link.  Null and empty
    texts have fingerprint zero and link like any other.  Rows with a null id
    link others but never name a component (null only if all its ids are
    null).  Repeated rows are kept.  An empty table gives an empty result.
    """
    f = cut(fingerprints(docs, shingle, id_col, text_col))
    one = cut(f.groupBy("fp").agg(F.min("doc_id").alias("low")))
    root = connected_components(links(one, max_bits))
    rooted = one.join(root, one.fp == root.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of = rooted.join(named, "root").select("fp", "root", "component_id")
    return f.join(of, "fp").select("doc_id", "h", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group does:
    that of the smallest id (of rows without any id, that of the smallest text
    hash).  Of repeated rows, one stays."""
    sim = simhash_components(docs, shingle, max_bits)
    keep = sim.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("k")).select(F.col("k.doc_id").alias("_i"), F.col("k.h").alias("_h"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = row.select("row", F.col("row.doc_id").cast("long").alias("i"), F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))).alias("h"))
    kept = keyed.join(keep.hint("merge"), F.col("i").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_h")), "left_semi")
    return kept.groupBy("i", "h").agg(F.first("row").alias("row")).select("row.*")


def hex_fingerprint(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; edge cases as in
    ``simhash_components``."""
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
