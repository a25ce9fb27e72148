"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms are byte trigrams, hashed to ``HASHED`` columns, plus a column for each
level of repetition within the text (words equal to the word before, lines and
five-word windows seen before), which counts as often as the text has words.  A document's term vector is log
frequency times inverse document frequency (counted over all documents), of
length one, projected on the leading right singular vectors of a bounded
sample of labelled documents.  The sample's projected vectors are broadcast:
at most about ``max_rows`` x ``rank`` floats, whatever the corpus.  Each block
of documents is multiplied with all of them at once, which gives the exact
cosines; the ``k`` nearest vote with their labels, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import keyed_text, prepare, small_batches, table
from .quality import labelled_texts, sampled_labels

HASHED = 1 << 13
LEVELS = (0.02, 0.08, 0.2, 0.4)
TERMS = HASHED + 3 * len(LEVELS)
MAX_ROWS, RANK, NEAREST, POWER = 4096, 32, 15, 4.0


def term_counts(text: str) -> np.ndarray:
    """How often each term occurs in a text."""
    b = text.encode("utf-8", "surrogatepass")
    x = np.frombuffer(b, np.uint8).astype(np.uint32)
    out = np.zeros(TERMS, np.float32)
    if len(x) > 2:
        code = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(0x9E3779B1)
        out[:HASHED] = np.bincount(code >> np.uint32(32 - 13), minlength=HASHED)
    words, lines = b.split(), [v for v in b.split(b"\n") if v.strip()]
    if words:
        windows = list(zip(*(words[i:] for i in range(5))))
        shares = (sum(map(bytes.__eq__, words, words[1:])) / len(words), (len(lines) - len(set(lines))) / len(lines),
                  (len(windows) - len(set(windows))) / max(1, len(windows)))
        out[HASHED:] = [len(words) * (share >= level) for share in shares for level in LEVELS]
    return out


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.stack([term_counts(t or "") for t in texts]) if texts else np.zeros((0, TERMS), np.float32)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents holding each term, documents), over all documents.  A task
    sends at most one row per term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(TERMS, np.int64), 0
        for b in small_batches(batches, 256):
            df += (_matrix(b.column(1).to_pylist()) > 0).sum(axis=0)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(np.append(df, n))], ["term", "n"])

    rows = keyed_text(docs).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # TERMS + 1 rows
    out = np.zeros(TERMS + 1, np.int64)
    for r in rows:
        out[r.term] = r.n
    return out[:TERMS], int(out[TERMS])


@dataclass
class Voters:
    idf: np.ndarray
    axes: np.ndarray  # (TERMS, rank)
    vectors: np.ndarray  # (labelled, rank), unit length
    labels: np.ndarray
    prior: float
    nearest: int

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_weigh(counts, self.idf) @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest; the prior
        where nothing is similar (texts without terms)."""
        out = np.full(len(counts), self.prior)
        if not len(self.labels) or not len(counts):
            return out
        cos = self.embed(counts) @ self.vectors.T
        k = min(self.nearest, cos.shape[1])
        # the k-th largest cosine is the bar; equals of it all vote, so ties
        # do not depend on the order of the labelled rows
        bar = np.partition(cos, cos.shape[1] - k, axis=1)[:, -k][:, None]
        w = np.where(cos >= bar, np.maximum(cos, 0), 0).astype(np.float64) ** POWER
        total = w.sum(axis=1)
        some = total > 1e-12
        out[some] = np.clip((w @ self.labels)[some] / total[some], 0, 1)
        return out


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts) * idf)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_voters(docs: DataFrame, labels: DataFrame, label: str = "quality", keep=None, max_rows: int = MAX_ROWS, rank: int = RANK, nearest: int = NEAREST) -> Voters:
    """Labelled vectors from about ``max_rows`` labelled documents at most
    (chosen by a hash of the id, among the rows where ``keep`` holds)."""
    prepare(docs.sparkSession)
    df, n = document_frequencies(docs)
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)
    some = sampled_labels(labels, label, max_rows, keep)

    def run(batches):
        for b in small_batches(batches, 256):
            m = _matrix(b.column(0).to_pylist())
            packed = [v.astype("<u2" if v.max() < 1 << 16 else "<u4").tobytes() for v in m]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(packed, pa.binary())], ["y", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    got = labelled_texts(rows, some).select("text", "y").mapInArrow(run, "y int, counts binary").collect()
    got = sorted((bytes(r.counts), r.y) for r in got)
    y = np.array([v for _, v in got], np.float64)
    counts = [c for c, _ in got]
    del got
    if not len(y):
        return Voters(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5, nearest)
    # the one large array of the fit, filled and weighed in place
    x = np.empty((len(y), TERMS), np.float32)
    for i in range(len(y)):
        x[i] = _weigh(np.frombuffer(counts[i], "<u2" if len(counts[i]) == 2 * TERMS else "<u4").astype(np.float32)[None, :], idf)[0]
        counts[i] = b""
    rank = min(rank, len(x))
    # Randomised subspace iteration: the leading right singular vectors.
    q = np.random.default_rng(11).standard_normal((TERMS, rank + 16)).astype(np.float32)
    for _ in range(2):
        q, _r = np.linalg.qr(x.T @ (x @ q))
    _u, _s, vt = np.linalg.svd(x @ q, full_matrices=False)
    axes = (q @ vt.T)[:, :rank].astype(np.float32)
    return Voters(idf, axes, _unit(x @ axes), y, float(y.mean()), nearest)


def quality_votes(docs: DataFrame, voters: Voters) -> DataFrame:
    """(doc_id, score), one row per row of ``docs``, map-only.  Null and empty
    texts have no terms and get the prior; null ids and repeated rows are kept; other columns are not read; an empty table gives
    an empty result.  Texts of any length are counted whole."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches):
        v = sent.value
        for b in small_batches(batches, 256):
            s = v.score(_matrix(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    return keyed_text(docs).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id):
    """Rows of the held-out fold: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op3_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document; edge cases as in ``quality_votes``."""
    docs = table(spark, sf_dir, "documents")
    voters = fit_voters(docs, table(spark, sf_dir, "labels"), keep=~held_out(F.col("doc_id")))
    out = quality_votes(docs, voters)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
