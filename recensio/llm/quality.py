"""Quality rules: boosted trees over document statistics.

A document's statistics (counts of words, symbols, repeated lines and word
windows, letters) go through fixed base rules and then through gradient
boosted trees fitted on labelled documents.  The trees are complete binary
trees flattened into numpy arrays (feature, cut, value per node), so a batch
of documents descends all trees level by level without Python loops over
documents.  Chosen features are monotone: more symbols, capitals or repetition
never raises a score.

The trees are fitted on at most about ``max_rows`` labelled documents (a bound
on the sample, taken by a hash of the id); every document is scored in one
map-only pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import prepare, small_batches, table

WHITE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PCT = 10, 20
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = b"0123456789"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_letters", "n_digits", "n_marks", "n_stops"]

#: Feature name -> direction a rise may move the score (0: any).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0,
    "upper_share": -1, "letter_share": 0, "digit_share": 0, "marks_per_word": -1, "stops_per_word": 0, "words_per_line": 0}


def repeated_words(ids: np.ndarray, distinct: int, width: int = WINDOW) -> int:
    """How many words lie in a window of ``width`` words that occurs twice or
    more; ``ids`` number the words from 0 to distinct - 1.  Exact: windows are
    compared as integers built without loss."""
    if len(ids) <= width:
        return 0
    rank, span = ids.astype(np.int64), distinct
    for k in range(1, width):  # rank of the window of k + 1 words
        rank, nxt = rank[:-1], ids[k:]
        if span > (1 << 62) // distinct:
            u, rank = np.unique(rank, return_inverse=True)
            span = len(u)
        rank, span = rank * distinct + nxt, span * distinct
    order = np.argsort(rank, kind="stable")
    same = np.diff(rank[order]) == 0
    hit = np.zeros(len(rank), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: str) -> list[int]:
    """The statistics named in COUNTS.  A word is a run of characters other
    than ASCII white space; a line counts as repeated if it has a word and
    equals an earlier line."""
    b = text.encode("utf-8", "surrogatepass")
    words = b.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = text.split("\n")
    seen, dup, full = set(), 0, 0
    for line in lines:
        if line.strip(WHITE):
            full += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    size = len(b)
    return [len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), dup, repeated_words(ids, len(number)), full, len(number),
            size - len(b.translate(None, _UPPER)), size - len(b.translate(None, _LETTERS)), size - len(b.translate(None, _DIGITS)), text.count("!") + text.count("?"), text.count(".")]


def base_failed(c: np.ndarray) -> np.ndarray:
    """The fixed rules: under 10 words, or over 20 % of words in repeats."""
    return (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > MAX_REPEAT_PCT * c[:, 0])


def features(c: np.ndarray) -> np.ndarray:
    """Feature matrix (rows as FEATURES) from a matrix of COUNTS."""
    c = c.astype(np.float64)
    words, chars, lines = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1), np.maximum(c[:, 5], 1)
    letters = np.maximum(c[:, 8], 1)
    return np.stack([np.log1p(c[:, 0]), c[:, 1] / words, c[:, 2] / words, c[:, 3] / lines, c[:, 4] / words, c[:, 6] / words,
                     c[:, 7] / letters, c[:, 8] / chars, c[:, 9] / chars, c[:, 10] / words, c[:, 11] / words, c[:, 0] / lines], axis=1)


# ---- boosted trees --------------------------------------------------------

@dataclass
class Trees:
    """Complete binary trees: the children of node i are 2i + 1 and 2i + 2."""

    bias: float
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # a value over the cut goes right
    value: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        n, (trees, inner) = len(x), self.feature.shape if len(self.feature) else (0, 0)
        out = np.full(n, self.bias)
        if trees:
            tree, row = np.arange(trees)[None, :], np.arange(n)[:, None]
            node = np.zeros((n, trees), np.int64)
            while inner:
                node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.cut[tree, node])
                inner //= 2
            out += self.value[tree, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 8) -> Trees:
    """Logistic boosting on binned features, with Newton leaf values.  A split
    on a monotone feature must order its children's values, and the halves
    stay on their sides of the middle from there down."""
    n, m = x.shape
    rate_1 = min(max((y.sum() + 0.5) / (n + 1.0), 1e-4), 1 - 1e-4)
    bias = float(np.log(rate_1 / (1 - rate_1)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    if not n or y.min() == y.max():
        return Trees(bias, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1)
    raw = np.full(n, bias)
    out_f, out_c, out_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feat, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for level in range(depth):
            base, width = (1 << level) - 1, 1 << level
            best = np.zeros(width)
            local = node - base
            for j in range(m):
                k = len(cuts[j]) + 1
                if k < 2:
                    continue
                slot = local * k + binned[:, j]
                sums = [np.bincount(slot, w, width * k).reshape(width, k).cumsum(axis=1) for w in (g, h, None)]
                gl, hl, nl = (s[:, :-1] for s in sums)
                gt, ht, nt = (s[:, -1:] for s in sums)
                lo, hi = low[base: base + width, None], high[base: base + width, None]
                vl, vr = np.clip(gl / (hl + ridge), lo, hi), np.clip((gt - gl) / (ht - hl + ridge), lo, hi)
                v0 = np.clip(gt / (ht + ridge), lo, hi)
                worth = lambda a, b, v: a * v - 0.5 * (b + ridge) * v * v
                gain = worth(gl, hl, vl) + worth(gt - gl, ht - hl, vr) - worth(gt, ht, v0)
                gain[(nl < least) | (nt - nl < least)] = 0
                if monotone[j]:
                    gain[(vr - vl) * monotone[j] < 0] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                for i in np.flatnonzero(top > best + 1e-9):
                    best[i], feat[base + i], cut[base + i] = top[i], j, cuts[j][at[i]]
                    left, right = 2 * (base + i) + 1, 2 * (base + i) + 2
                    low[[left, right]], high[[left, right]] = low[base + i], high[base + i]
                    if monotone[j]:
                        mid = (vl[i, at[i]] + vr[i, at[i]]) / 2
                        (high if monotone[j] > 0 else low)[left] = mid
                        (low if monotone[j] > 0 else high)[right] = mid
            for i in np.flatnonzero(best == 0):  # no split: all go left, with the node's bounds
                low[2 * (base + i) + 1], high[2 * (base + i) + 1] = low[base + i], high[base + i]
            node = 2 * node + 1 + (x[np.arange(n), feat[node]] > cut[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        value = rate * np.clip(gs / (hs + ridge), low[inner:], high[inner:])
        raw += value[leaf]
        out_f.append(feat)
        out_c.append(cut)
        out_v.append(np.where(np.bincount(leaf, minlength=leaves) > 0, value, 0.0))
    return Trees(bias, np.array(out_f), np.array(out_c), np.array(out_v))


# ---- operator -------------------------------------------------------------

MAX_TRAIN = 20_000


def _counted(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in small_batches(batches):
        yield b, np.array([counts(t or "") for t in b.column(text).to_pylist()], np.int64).reshape(-1, len(COUNTS))


def sampled_labels(labels: DataFrame, label: str, max_rows: int, keep=None) -> DataFrame:
    """(doc_id, y) of labelled rows, about ``max_rows`` of them at most,
    chosen by a hash of the id; rows without id or label are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    if keep is not None:
        known = known.where(keep)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, max_rows / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def labelled_texts(rows: DataFrame, some: DataFrame) -> DataFrame:
    """(doc_id, text, y) of ``rows(doc_id, text)``: one row per labelled id, of
    rows that share it the one whose text has the smallest hash."""
    known = rows.join(F.broadcast(some), "doc_id")
    one = known.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))).alias("one"))
    return one.select("doc_id", F.col("one.text").alias("text"), "y")


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN, label: str = "quality") -> Trees:
    """Trees fitted on about ``max_rows`` labelled documents at most.  Without
    labels, or with one class only, the score is constant."""
    prepare(docs.sparkSession)
    some = sampled_labels(labels, label, max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for b, c in _counted(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(c.tolist(), pa.list_(pa.int64()))], ["y", "c"])

    got = labelled_texts(rows, some).mapInArrow(run, "y int, c array<long>").toPandas()
    if not len(got):
        return fit_trees(np.zeros((0, len(FEATURES))), np.zeros(0), list(FEATURES.values()))
    got["key"] = got["c"].map(lambda v: tuple(v))
    got = got.sort_values(["key", "y"])  # the same trees whatever order the rows came in
    c = np.array(got["key"].tolist(), np.int64)
    return fit_trees(features(c), got["y"].to_numpy(np.float64), list(FEATURES.values()))


def quality_rules(docs: DataFrame, model: Trees, least_score: float = 0.5) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, and: counts (array as
    COUNTS), base_failed, score (probability of good quality) and kept.

    Null and empty texts have no words and fail the base rules.  Map-only:
    rows keep their order and number, repeated rows included.  Other columns
    may have any name (they come in ``row``).  A text is counted whole, in
    memory of a few times its size.  An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("base_failed", T.BooleanType()),
                           T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches):
        for b, c in _counted(batches, 1):
            bad, score = base_failed(c), model.score(features(c))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.tolist(), pa.list_(pa.int64())), pa.array(bad), pa.array(score), pa.array(~bad & (score >= least_score))], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; edge cases as in ``quality_rules``."""
    docs = table(spark, sf_dir, "documents")
    out = quality_rules(docs.select("doc_id", "text"), fit_quality(docs, table(spark, sf_dir, "labels")))
    return out.select("row.doc_id", *[F.col("counts")[i].alias(COUNTS[i]) for i in range(5)], "base_failed", "kept", "score")
