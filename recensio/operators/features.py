"""TF-IDF features of the cleaned review text.

Tokens are whole cleaned words of at least 3 ASCII letters.  A term enters
the vocabulary when it occurs in at least ``min_df`` reviews and in at most
``max_df`` of them; of those the ``max_features`` terms with the highest
total count are kept (ties by term).  Weights are raw count times the
smoothed idf ``ln((1+n)/(1+df)) + 1``, scaled to unit L2 norm per review.

Plan: the corpus is never shuffled by (review, term).
* ``term_stats``: one pass; the words of an Arrow batch are numbered and
  counted in place (a row per distinct word of the batch), then both counts are
  aggregated per term, partial aggregation first, so a task ships at most one
  row per distinct term.
* ``vocabulary``: a top-k of at most ``max_features`` rows.
* ``with_vectors``: the vocabulary (bounded by ``max_features``) is a
  literal of ``CountVectorizerModel`` -> ``ElementwiseProduct(idf)`` ->
  ``Normalizer``: sparse vectors, map-only, JVM-side.
* ``tfidf``: the long table (seq, idx, term, tfidf) exploded from those
  vectors, still map-only.

Many companies, each a corpus of its own:
* ``dictionaries``: one pass for all companies; the counts per (company, term)
  are partial aggregates, the cut at ``max_features`` is a window group limit;
  a row per company holds its terms.
* ``company_vectors``: a review meets its company's dictionary (a join by
  company with one small row per company, broadcast up to
  ``BROADCAST_COMPANIES`` of them) and its terms are counted in place, per
  Arrow batch: tokens are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recensio.config import Config
from recensio.functions import text as T
from recensio.operators.reviews import review_key
from recensio.session import materialize, ship_package, stored

#: Dictionaries (at most max_features terms each) are broadcast up to so many
#: companies, beyond it shuffled.
BROADCAST_COMPANIES = 4096
#: Words numbered at once.
BATCH_WORDS = 1 << 22


def _pieces(b: pa.RecordBatch, words: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch whose lists (in column ``words``) hold at most some
    ``BATCH_WORDS`` in all, with the length of each row's list."""
    lens = np.asarray(pc.fill_null(pc.list_value_length(b.column(words)), 0)).astype(np.int64)
    piece = np.cumsum(lens) // BATCH_WORDS
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), b.num_rows]
    for i, j in zip(cuts, cuts[1:]):
        if j > i:
            yield b.slice(i, j - i), lens[i:j]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(company, term, df, cf) of each piece of (company, parole): a row per
    distinct word, and one without a word with the number of reviews."""
    for whole in batches:
        for b, lens in _pieces(whole, 1):
            groups = b.column(0).dictionary_encode(null_encoding="encode")
            of = np.asarray(groups.indices).astype(np.int64)
            coded = b.column(1).flatten().dictionary_encode()
            code, size = np.asarray(pc.fill_null(coded.indices, -1)).astype(np.int64), max(len(coded.dictionary), 1)
            row = np.repeat(np.arange(b.num_rows), lens)
            held, tf = np.unique((row * size + code)[code >= 0], return_counts=True)
            key, place, n = np.unique(of[held // size] * size + held % size, return_inverse=True, return_counts=True)
            total = np.bincount(place, tf, len(key)).astype(np.int64)
            there = np.bincount(of[np.asarray(b.column(1).is_valid())], minlength=len(groups.dictionary))
            at = np.concatenate([key // size, np.flatnonzero(there)])
            yield pa.RecordBatch.from_arrays([
                groups.dictionary.take(pa.array(at)),
                pa.concat_arrays([coded.dictionary.take(pa.array(key % size)), pa.nulls(len(at) - len(key), coded.dictionary.type)]),
                pa.array(np.concatenate([n, there[there > 0]]).astype(np.int64)),
                pa.array(np.concatenate([total, np.zeros(len(at) - len(key), np.int64)]))], ["company", "term", "df", "cf"])


def _term_counts(reviews: DataFrame) -> DataFrame:
    """(company, term, df, cf) of words(company, parole): the reviews that
    hold a term and its occurrences; without a term, the reviews."""
    ship_package(reviews.sparkSession)
    counts = reviews.select(F.col("company").cast("string").alias("company"), "parole").mapInArrow(_counted, "company string, term string, df long, cf long")
    return counts.filter(F.col("term").isNull() | T.is_feature_token(F.col("term"))).groupBy("company", "term").agg(
        F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def term_stats(reviews: DataFrame) -> DataFrame:
    """(term, df, cf): reviews containing the term, total occurrences."""
    return _term_counts(reviews.select(F.lit("").alias("company"), "parole")).filter(F.col("term").isNotNull()).drop("company")


def vocabulary(reviews: DataFrame, cfg: Config = Config(), n_docs: int | None = None) -> DataFrame:
    """(idx, term, df, cf, idf): the kept terms, idx in term order."""
    n = reviews.count() if n_docs is None else n_docs
    stats = term_stats(reviews)
    kept = stats.filter((F.col("df") >= cfg.min_df) & (F.col("df") <= F.lit(cfg.max_df * n)))
    top = kept.orderBy(F.desc("cf"), "term").limit(cfg.max_features)
    # At most max_features rows: a single-partition window is fine here.
    idx = F.row_number().over(Window.orderBy("term")) - 1
    idf = F.log((F.lit(1.0) + n) / (F.col("df") + 1.0)) + 1.0
    return top.select(idx.cast("int").alias("idx"), "term", "df", "cf", idf.alias("idf"))


def vocab_rows(vocab: DataFrame) -> list[tuple[str, float]]:
    """(term, idf) in idx order.  The vocabulary holds at most
    ``max_features`` rows, so it is read to the driver and becomes a literal
    of the vector transformers."""
    return [(r["term"], float(r["idf"])) for r in vocab.orderBy("idx").select("term", "idf").collect()]


def with_vectors(reviews: DataFrame, vocab: list[tuple[str, float]], out: str = "features") -> DataFrame:
    """``reviews`` plus ``out``: the L2-normalised TF-IDF vector (sparse,
    size = vocabulary size; all zeros when no vocabulary term occurs)."""
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    terms = [t for t, _ in vocab]
    # Words outside the vocabulary are ignored by the counter, so the cleaned
    # words can be counted directly (vocabulary terms are all feature tokens).
    cv = CountVectorizerModel.from_vocabulary(terms, inputCol="parole", outputCol="_tf")
    ep = ElementwiseProduct(scalingVec=Vectors.dense([w for _, w in vocab]), inputCol="_tf", outputCol="_w")
    nz = Normalizer(p=2.0, inputCol="_w", outputCol=out)
    return nz.transform(ep.transform(cv.transform(reviews))).drop("_tf", "_w")


def tfidf_from_vectors(vectors: DataFrame, vocab: list[tuple[str, float]], keep: tuple[str, ...] = ("seq",),
                       col: str = "features") -> DataFrame:
    """(*keep, idx, term, tfidf): one row per non-zero weight."""
    from pyspark.ml.functions import vector_to_array

    terms = F.array(*[F.lit(t) for t, _ in vocab])
    long = vectors.select(*keep, F.posexplode(vector_to_array(col)).alias("idx", "tfidf")).filter(F.col("tfidf") != 0)
    return long.select(*keep, F.col("idx").cast("int").alias("idx"), F.element_at(terms, F.col("idx") + 1).alias("term"), "tfidf")


def tfidf(reviews: DataFrame, cfg: Config = Config(), vocab: DataFrame | None = None) -> DataFrame:
    """(seq, idx, term, tfidf) for the vocabulary terms of each review;
    reviews without any vocabulary term have no rows."""
    key = review_key(reviews)
    # Read three times (size, counts, vectors): cleaned once.
    words = stored(reviews.select(*key, "parole"))
    vocab = vocabulary(words, cfg) if vocab is None else vocab
    rows = vocab_rows(vocab)
    if not rows:
        none = lambda t: F.lit(None).cast(t)
        return words.filter(F.lit(False)).select(*key, none("int").alias("idx"), none("string").alias("term"), none("double").alias("tfidf"))
    return tfidf_from_vectors(with_vectors(words, rows), rows, tuple(key))


# ---- a corpus per company ------------------------------------------------------

def dictionaries(reviews: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(company, n, terms, dfs, cfs, idfs): each company's number of reviews
    and its vocabulary, in term order (empty arrays when no term is kept)."""
    # One pass gives the sizes and both counts.  Read for the sizes and for the
    # terms: counted once.
    stats = materialize(_term_counts(reviews))
    sizes = stats.filter(F.col("term").isNull()).select("company", F.col("df").alias("n"))
    kept = stats.join(sizes, "company").filter(F.col("term").isNotNull() & (F.col("df") >= cfg.min_df) & (F.col("df") <= cfg.max_df * F.col("n")))
    nth = F.row_number().over(Window.partitionBy("company").orderBy(F.desc("cf"), "term"))
    top = kept.withColumn("nth", nth).filter(F.col("nth") <= cfg.max_features)
    words = top.groupBy("company").agg(F.array_sort(F.collect_list(F.struct("term", "df", "cf"))).alias("v"))
    v = F.coalesce("v", F.array().cast("array<struct<term:string,df:bigint,cf:bigint>>"))
    idf = lambda t: F.log((F.lit(1.0) + F.col("n")) / (t["df"] + F.lit(1.0))) + F.lit(1.0)
    return sizes.join(words, "company", "left").select("company", "n", v.alias("v")).select(
        "company", "n", F.col("v.term").alias("terms"), F.col("v.df").alias("dfs"), F.col("v.cf").alias("cfs"), F.transform("v", idf).alias("idfs"))


def company_vocabulary(dicts: DataFrame) -> DataFrame:
    """(company, idx, term, df, cf, idf) of ``dictionaries``."""
    zipped = F.arrays_zip(F.col("terms").alias("term"), F.col("dfs").alias("df"), F.col("cfs").alias("cf"), F.col("idfs").alias("idf"))
    return dicts.select("company", F.posexplode(zipped).alias("idx", "t")).select("company", "idx", "t.*")


def company_vectors(reviews: DataFrame, dicts: DataFrame) -> DataFrame:
    """(company, seq, n, terms, idx array<int>, w array<double>): per review
    the places of its company's terms it holds, rising, and their weights, of
    length one together (none held: empty arrays)."""
    ship_package(reviews.sparkSession)
    dicts = dicts.select("company", "n", "terms", "idfs")
    few = len(dicts.limit(BROADCAST_COMPANIES + 1).select("n").collect()) <= BROADCAST_COMPANIES
    r = reviews.select("company", "seq", "parole").join(F.broadcast(dicts) if few else dicts, "company")
    return r.select("company", "seq", "n", "terms", "idfs", "parole").mapInArrow(_weighed, "company string, seq long, n long, terms array<string>, idx array<int>, w array<double>")


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b, lens in _pieces(whole, 5):
            groups = b.column(0).dictionary_encode()
            of, parole = np.asarray(groups.indices), b.column(5)
            start, flat = np.concatenate([[0], np.cumsum(lens)]), parole.flatten()
            rows, idx, w = [], [], []
            for g in range(len(groups.dictionary)):
                mine = np.flatnonzero(of == g)
                terms, idfs = b.column(3)[mine[0]].values, np.asarray(b.column(4)[mine[0]].values)
                if not len(terms):
                    continue
                # the places of this company's words in the piece
                at = np.repeat(start[mine] - np.concatenate([[0], np.cumsum(lens[mine])[:-1]]), lens[mine]) + np.arange(lens[mine].sum())
                term = np.asarray(pc.fill_null(pc.index_in(flat.take(pa.array(at)), value_set=terms, skip_nulls=True), -1)).astype(np.int64)
                key, tf = np.unique((np.repeat(np.arange(len(mine)), lens[mine]) * len(terms) + term)[term >= 0], return_counts=True)
                row, i = key // len(terms), key % len(terms)  # in vocabulary order, each once
                raw = tf * idfs[i]
                # summed in that order
                norm = np.sqrt(np.bincount(row, raw * raw, len(mine)))
                rows.append(mine[row])
                idx.append(i)
                w.append(raw / norm[row])
            rows, idx, w = (np.concatenate([np.empty(0, t), *v]) for v, t in ((rows, np.int64), (idx, np.int32), (w, np.float64)))
            order = np.argsort(rows, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=b.num_rows))])
            # no words at all (null): no lists either
            off = pa.array(ends.astype(np.int32), mask=np.append(~np.asarray(parole.is_valid()), False))
            lists = [pa.ListArray.from_arrays(off, pa.array(v[order])) for v in (idx.astype(np.int32), w)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *lists], ["company", "seq", "n", "terms", "idx", "w"])


def company_tfidf(vectors: DataFrame) -> DataFrame:
    """(company, seq, idx, term, tfidf): one row per non-zero weight."""
    zipped = F.arrays_zip(F.col("idx").alias("idx"), F.col("w").alias("tfidf"))
    return vectors.select("company", "seq", "terms", F.explode(zipped).alias("e")).select(
        "company", "seq", F.col("e.idx").alias("idx"), F.get("terms", F.col("e.idx")).alias("term"), F.col("e.tfidf").alias("tfidf"))
