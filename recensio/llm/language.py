"""Language identification by error-correcting output codes.

Every language has a codeword.  For each bit a binary classifier over letter
n-grams (logistic regression on the square roots of the shares of hashed byte
2- to 4-grams of lower-case words) predicts on which side of that bit's split
of the languages a text lies.  Up to ``EXHAUSTIVE`` languages the code is
exhaustive (every split once); beyond, it is the seeded random code of largest
least distance among some draws.

Decoding is loss-weighted: a language's loss is the logistic loss of all bits
against its codeword, each bit weighted by how often that bit was right for
that language on validation rows.  The least loss wins; equal losses go to the
language that sorts first.  Probabilities are the softmax of the negative
losses; a text whose two best lie within ``CLOSE`` of each other is flagged as
ambiguous.

Fitting uses at most ``MAX_ROWS`` texts, equally many per language, chosen by a
hash of the id; the languages themselves and their counts come from all rows.
Prediction is map-only over whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import prepare, small_batches, table

BITS_HASHED = 12
TERMS = 1 << BITS_HASHED
#: Texts that the classifiers are fitted on, at most; one in ``CHECK`` of a
#: language's only weighs the bits.
MAX_ROWS, CHECK = 2048, 5
EXHAUSTIVE, DRAWS = 8, 64
ROUNDS, RIDGE = 300, 1e-5
CLOSE = 0.2
UNKNOWN = "und"
#: Characters of a text that are read at a time.
STRETCH = 1 << 20

_WORD = re.compile(r"[^\W\d_]+")
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def features(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a text; None if it has no letter."""
    out, letters = np.zeros(TERMS, np.int64), False
    for at in range(0, len(text or ""), STRETCH):
        words = _WORD.findall(text[at:at + STRETCH].lower())
        letters = letters or any(c.isalpha() for w in words for c in w)
        x = np.frombuffer((" " + " ".join(words) + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        code = x
        for n, mix in enumerate(_MIX, 1):
            code = code[:-1] << np.uint32(8) | x[n:]
            out += np.bincount((code * mix) >> np.uint32(32 - BITS_HASHED), minlength=TERMS)
    return out if letters else None


def _shares(counts: np.ndarray) -> np.ndarray:
    c = counts.astype(np.float32)
    return np.sqrt(c / np.maximum(c.sum(axis=1, keepdims=True), 1))


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """(n, bits) of -1 and 1: rows differ, no column is constant and no two
    columns are equal or opposite where the code is exhaustive."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= EXHAUSTIVE:
        cols = [(1, *c) for c in product((-1, 1), repeat=n - 1) if -1 in c]
        return np.array(cols, np.int8).T
    rng, bits, best = np.random.default_rng(seed), max(15, int(np.ceil(10 * np.log2(n)))), None
    for _ in range(DRAWS):
        m = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        alike = m.astype(np.float32) @ m.T.astype(np.float32)
        np.fill_diagonal(alike, -bits)
        if (abs(m.sum(axis=0)) < n).all() and alike.max() < bits and (best is None or alike.max() < best[0]):
            best = alike.max(), m
    return best[1]


@dataclass
class Identifier:
    langs: list[str]
    code: np.ndarray  # (languages, bits)
    axes: np.ndarray  # (TERMS, bits)
    shift: np.ndarray  # (bits,)
    weight: np.ndarray  # (languages, bits), rows add up to 1

    def losses(self, counts: np.ndarray) -> np.ndarray:
        f = _shares(counts) @ self.axes + self.shift
        return np.stack([np.logaddexp(0, -f * self.code[k]) @ self.weight[k] for k in range(len(self.langs))], axis=1)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, probability, ambiguous) of each row."""
        n = len(self.langs)
        loss = self.losses(counts)
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * max(1, self.code.shape[1]))
        p /= p.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        ranked = np.sort(p, axis=1)
        close = ranked[:, -1] - ranked[:, -2] < CLOSE if n > 1 else np.zeros(len(p), bool)
        return best, p[np.arange(len(p)), best], close


def train(counts: np.ndarray, y: np.ndarray, langs: list[str]) -> Identifier:
    """Fit from n-gram counts and language numbers."""
    code = codewords(len(langs))
    order = np.arange(len(y))
    nth = np.zeros(len(y), np.int64)
    for k in range(len(langs)):
        nth[y == k] = order[: (y == k).sum()]
    x, check = _shares(counts), nth % CHECK == CHECK - 1
    xs, target = x[~check], code[y[~check]].astype(np.float32)
    # each language weighs the same, however many of its texts were found
    share = (1 / np.bincount(y[~check], minlength=len(langs)).clip(1))[y[~check]]
    share = (share / share.sum()).astype(np.float32)[:, None]
    w = np.zeros((TERMS, code.shape[1]), np.float32)
    b = np.zeros(code.shape[1], np.float32)
    # accelerated gradient descent; rows have length one, so a step of 2 is safe
    vw, vb, t = w.copy(), b.copy(), 1.0
    for _ in range(ROUNDS if code.shape[1] else 0):
        pull = -target * share / (1 + np.exp(np.clip(target * (xs @ vw + vb), -30, 30)))
        nw, nb = vw - 2 * (xs.T @ pull + RIDGE * vw), vb - 2 * pull.sum(axis=0)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    right = np.ones((len(langs), code.shape[1]))
    f = x[check] @ w + b
    for k in range(len(langs)):
        mine = y[check] == k
        right[k] = ((f[mine] * code[k] > 0).sum(axis=0) + 1) / (mine.sum() + 1)
    return Identifier(langs, code, w, b, right / np.maximum(right.sum(axis=1, keepdims=True), 1e-12))


def fit_identifier(docs: DataFrame, max_rows: int = MAX_ROWS) -> Identifier | None:
    """Learn from docs(doc_id, text, lang); null languages and texts without a
    letter teach nothing.  None if nothing is left."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not counts:
        return None
    langs, each = sorted(counts), max(CHECK, max_rows // len(counts))
    # The hash keeps about twice what is wanted of a language, then the exact
    # number is taken in the hash's order.
    h = F.xxhash64("doc_id", F.lit("language"))
    share = F.create_map(*[v for k in langs for v in (F.lit(k), F.lit(min(1.0, 2 * each / counts[k] + 20 / counts[k])))])
    some = rows.withColumn("h", h).where(F.pmod("h", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text"), "text"))
    some = some.withColumn("nth", nth).where(F.col("nth") <= each)
    number = F.create_map(*[v for i, k in enumerate(langs) for v in (F.lit(k), F.lit(i))])

    def run(batches):
        for b in small_batches(batches, 256):
            got = [(y, n, f) for y, n, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), map(features, b.column(2).to_pylist())) if f is not None]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32()),
                                              pa.array([np.minimum(g[2], 2**32 - 1).astype("<u4").tobytes() for g in got], pa.binary())], ["y", "nth", "c"])

    got = sorted((r.y, r.nth, bytes(r.c)) for r in some.select(F.element_at(number, F.col("lang")).alias("y"), "nth", "text").mapInArrow(run, "y int, nth int, c binary").collect())
    if not got:
        return None
    found = sorted({y for y, _, _ in got})
    y = np.searchsorted(found, [g[0] for g in got])
    return train(np.stack([np.frombuffer(g[2], "<u4") for g in got]), y, [langs[i] for i in found])


def identify(docs: DataFrame, model: Identifier | None) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous), one row per row of ``docs``.

    A null text, or one without a letter, is ``und`` with score 0 and not
    ambiguous; so is every text if nothing was learned.  If one language was
    learned, every other text has it, with score 1.  Whole texts are read,
    in stretches of ``STRETCH`` characters.  Null ids and repeated rows are
    kept; other columns, whatever their names, are not read; an empty table
    gives an empty result.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in small_batches(batches, 256):
            got = [features(t) if m else None for t in b.column(1).to_pylist()]
            lang, score, close = [UNKNOWN] * len(got), np.zeros(len(got)), np.zeros(len(got), bool)
            some = [i for i, g in enumerate(got) if g is not None]
            if some:
                best, score[some], close[some] = m.predict(np.stack([got[i] for i in some]))
                for i, k in zip(some, best.tolist()):
                    lang[i] = m.langs[k]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score), pa.array(close)], ["doc_id", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id):
    """Rows of the held-out fold: crc32 of the id as text, modulo 4, is 2.
    Rows without an id are in no fold and teach nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op13_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; edge cases as in ``identify``."""
    docs = table(spark, sf_dir, "documents")
    model = fit_identifier(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
