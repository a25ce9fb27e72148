"""Topics: k-means over TF-IDF vectors and per-topic aggregates.

``assign_topics`` labels every review within its company: vocabulary, vectors,
seeds and centres are the company's own, all companies in one run (k-means in
whole numbers, see ``operators.kmeans``).  The per-topic
operators take *any* review table with a ``cluster`` column; sizes, shares,
ranks and examples are per company:

* ``topic_centroids``: mean TF-IDF vector per topic (one partial aggregate);
* ``topic_terms``: the 10 heaviest centroid weights of each topic, then
  terms longer than 3 chars that are not digits, first 5;
* ``topic_summary``: size, share, mean of the non-zero ratings;
* ``topic_examples``: in topic-id order, the first 3 reviews of each topic
  whose identity no earlier pick used.  Only the first 3k identities of a
  topic can ever be picked (earlier topics use at most 3k), so a
  WindowGroupLimit keeps <= 3k rows per topic and the greedy pick folds
  those <= 3k^2 rows in one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recensio.config import Config
from recensio.operators import features as FT
from recensio.operators import kmeans as KM
from recensio.operators.reviews import company_of, review_key, with_identity
from recensio.session import materialize, stored

TOP_TERMS = 10
KEPT_TERMS = 5
MIN_REVIEWS = 5


def auto_k(n_reviews: Column | int) -> Column:
    """min(8, max(3, n div 10))."""
    n = n_reviews if isinstance(n_reviews, Column) else F.lit(n_reviews)
    return F.least(F.lit(8), F.greatest(F.lit(3), F.floor(n / 10))).cast("int")


def topic_vectors(words: DataFrame, dicts: DataFrame, k: int | None = None) -> DataFrame:
    """What ``kmeans`` reads, from words(company, seq, parole): the companies
    with enough reviews and a vocabulary, weights in whole millionths."""
    able = dicts.filter((F.col("n") >= MIN_REVIEWS) & (F.size("terms") > 0))
    v = FT.company_vectors(words, able)
    return v.select(
        "company", "seq", "n", F.size("terms").alias("dim"), (auto_k(F.col("n")) if k is None else F.lit(k)).alias("k"),
        KM.draw_of(F.col("company"), F.col("seq")).alias("draw"), "idx", F.transform("w", lambda x: F.floor(x * KM.UNIT + 0.5)).alias("val"))


def assign_topics(reviews: DataFrame, k: int | None = None, cfg: Config = Config(), written: bool = False):
    """Returns (labelled reviews, centroids, vocab, k_used).

    ``labelled`` is ``reviews`` plus ``cluster`` (NULL for the reviews of a
    company with fewer than 5 of them or an empty vocabulary); ``centroids``
    is (company, cluster, weights array<double>) in vocabulary order; ``vocab``
    is (company, idx, term, df, cf, idf); k_used is the largest number of
    topics a company has (fewer than asked for with fewer distinct vectors).
    A table without companies is one company, and its results have no such
    column.  written: ``reviews`` is a written table.
    """
    by = company_of(reviews)
    keyed = reviews if by else reviews.withColumn("company", F.lit(""))
    # Read twice (vocabulary, then vectors): cleaned once.
    words = keyed.select("company", "seq", "parole")
    words = words if written else stored(words)
    dicts = materialize(FT.dictionaries(words, cfg))
    labels, centroids = KM.kmeans(stored(topic_vectors(words, dicts, k)), cfg)
    centroids = materialize(centroids)
    vocab = FT.company_vocabulary(dicts)
    labelled = reviews.join(labels if by else labels.drop("company"), review_key(reviews), "left")
    used = centroids.agg(F.max("cluster")).first()[0]
    if not by:
        centroids, vocab = centroids.drop("company"), vocab.drop("company")
    return labelled, centroids, vocab, 0 if used is None else used + 1


def assign_nearest(reviews: DataFrame, centroids: DataFrame, vocab: list[tuple[str, float]]) -> DataFrame:
    """``reviews`` plus ``cluster``: the nearest of the given centroids (at
    most k rows, a literal here), ties (to 9 places) to the lower id."""
    from pyspark.ml.functions import vector_to_array

    cents = sorted((r["cluster"], [float(x) for x in r["weights"]]) for r in centroids.collect())
    if not cents:
        return reviews.withColumn("cluster", F.lit(None).cast("int"))
    vec = FT.with_vectors(reviews, vocab).withColumn("_x", vector_to_array("features"))
    dist = [
        F.struct(F.round(F.aggregate(F.zip_with("_x", F.array(*[F.lit(w) for w in ws]), lambda x, y: (x - y) * (x - y)),
                                     F.lit(0.0), lambda s, d: s + d), 9).alias("d"), F.lit(c).alias("c"))
        for c, ws in cents
    ]
    return vec.withColumn("cluster", F.array_min(F.array(*dist))["c"].cast("int")).drop("features", "_x")


def topic_centroids(labelled: DataFrame, vocab: list[tuple[str, float]]) -> DataFrame:
    """Mean TF-IDF vector of each topic, (cluster, weights) in vocabulary
    order, from a labelled review table.  One pass: every review emits its
    non-zero weights plus one size marker (idx -1), summed per (cluster,
    idx) with partial aggregation, so a task ships at most
    k * (|vocabulary| + 1) rows."""
    n_terms = len(vocab)
    vec = FT.with_vectors(labelled.filter(F.col("cluster").isNotNull()).select("cluster", "parole"), vocab)
    from pyspark.ml.functions import vector_to_array

    arr = vector_to_array("features")
    entries = F.concat(
        F.array(F.struct(F.lit(-1).alias("idx"), F.lit(1.0).alias("v"))),
        F.filter(
            F.transform(arr, lambda x, i: F.struct(i.alias("idx"), x.alias("v"))),
            lambda e: e["v"] != 0,
        ),
    )
    sums = (
        vec.select("cluster", F.explode(entries).alias("e"))
        .groupBy("cluster", F.col("e.idx").alias("idx"))
        .agg(F.sum("e.v").alias("s"))
        .groupBy("cluster")
        .agg(F.map_from_entries(F.collect_list(F.struct("idx", "s"))).alias("m"))
    )
    size = F.col("m")[-1]
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(n_terms - 1)),
        lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)) / size,
    )
    return sums.select("cluster", dense.alias("weights"))


def topic_terms(centroids: DataFrame, vocab: list[tuple[str, float]]) -> DataFrame:
    """(cluster, top_terms, parole_chiave): 10 heaviest terms (weight
    descending, ties by later term first), then the kept keywords."""
    # The vocabulary has at most max_features terms: it is a literal here.
    return centroids.select("cluster", *_heaviest(F.array(*[F.lit(t) for t, _ in vocab])))


def company_topic_terms(centroids: DataFrame, vocab: DataFrame) -> DataFrame:
    """The same for every company's (company, cluster, weights), by its own
    vocabulary: (company, cluster, top_terms, parole_chiave)."""
    terms = vocab.groupBy("company").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "term"))), lambda t: t["term"]).alias("terms"))
    return centroids.join(terms, "company").select("company", "cluster", *_heaviest(F.col("terms")))


def _heaviest(terms: Column) -> list[Column]:
    pairs = F.arrays_zip(F.transform("weights", lambda x: F.round(x, 9)).alias("w"), terms.alias("t"))
    ranked = F.array_sort(
        pairs,
        lambda a, b: F.when(a["w"] > b["w"], -1).when(a["w"] < b["w"], 1)
        .when(a["t"] > b["t"], -1).when(a["t"] < b["t"], 1).otherwise(0),
    )
    top = F.transform(F.slice(ranked, 1, TOP_TERMS), lambda p: p["t"])
    kept = F.slice(F.filter(top, lambda t: (F.length(t) > 3) & ~t.rlike(r"^\p{Nd}+$")), 1, KEPT_TERMS)
    return [top.alias("top_terms"), kept.alias("parole_chiave")]


def topic_summary(labelled: DataFrame, k: int) -> DataFrame:
    """(company, id, n_recensioni, percentuale, rating_medio) for topics
    0..k-1 of every company; an empty topic has size 0 and mean NULL."""
    by = company_of(labelled)
    total = F.sum("n_recensioni").over(Window.partitionBy(*by))  # k rows
    stats = labelled.filter(F.col("cluster").isNotNull()).groupBy(*by, "cluster").agg(
        F.count(F.lit(1)).alias("n_recensioni"),
        F.avg(F.when(F.col("rating") != 0, F.col("rating"))).alias("rating_medio"),
    )
    # A company's k topics, also where it has no review in one.
    companies = stats.select(*by).distinct() if by else labelled.sparkSession.range(1).select()
    ids = companies.select(*by, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("cluster"))
    s = ids.join(stats, [*by, "cluster"], "left").select(
        *by, F.col("cluster").alias("id"),
        F.coalesce("n_recensioni", F.lit(0)).alias("n_recensioni"),
        "rating_medio",
    )
    return s.withColumn("percentuale", F.col("n_recensioni") / total * 100).select(
        *by, "id", "n_recensioni", "percentuale", "rating_medio"
    )


def topic_examples(labelled: DataFrame, k: int, cfg: Config = Config()) -> DataFrame:
    """(company, id, example, seq, review_id, testo, rating, data, link)."""
    per, by, key = cfg.topic_examples, company_of(labelled), review_key(labelled)
    r = with_identity(labelled.filter(F.col("cluster").isNotNull()), cfg)
    firsts = r.groupBy(*by, "cluster", "ident").agg(F.min("seq").alias("seq"))
    w = Window.partitionBy(*by, "cluster").orderBy("seq")
    cand = firsts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per * k)
    # <= per*k*k rows a company, folded in topic-then-review order.
    items = F.array_sort(F.collect_list(F.struct("cluster", "seq", "ident")))
    init = F.struct(
        F.array().cast("array<string>").alias("used"),
        F.array().cast("array<struct<cluster:int,seq:bigint>>").alias("picked"),
    )

    def step(acc, x):
        n_here = F.size(F.filter(acc["picked"], lambda p: p["cluster"] == x["cluster"]))
        take = ~F.array_contains(acc["used"], x["ident"]) & (n_here < per)
        return F.when(
            take,
            F.struct(
                F.concat(acc["used"], F.array(x["ident"])).alias("used"),
                F.concat(acc["picked"], F.array(F.struct(x["cluster"].alias("cluster"), x["seq"].alias("seq")))).alias("picked"),
            ),
        ).otherwise(acc)

    picked = cand.groupBy(*by).agg(F.aggregate(items, init, step)["picked"].alias("p")).select(*by, F.explode("p").alias("p"))
    picked = picked.select(*by, F.col("p.cluster").alias("id"), F.col("p.seq").alias("seq"))
    ex = picked.withColumn("example", F.row_number().over(Window.partitionBy(*by, "id").orderBy("seq")))
    cols = labelled.select(*key, "review_id", "testo", "rating", "data", "link")
    return ex.join(cols, key).select(*by, "id", "example", "seq", "review_id", "testo", "rating", "data", "link")


def order_topics(summary: DataFrame) -> DataFrame:
    """Size descending, ties by id (``rank`` 1..k)."""
    w = Window.partitionBy(*company_of(summary)).orderBy(F.desc("n_recensioni"), "id")  # k rows a company
    return summary.withColumn("rank", F.row_number().over(w))


def topic_rows(labelled: DataFrame, centroids: DataFrame, vocab: list[tuple[str, float]] | DataFrame, k: int, cfg: Config = Config()) -> DataFrame:
    """The topics as one table: (company, rank, id, parole_chiave,
    n_recensioni, percentuale, rating_medio, esempi), esempi being an array of
    at most ``cfg.topic_examples`` reviews.  Centroids and vocabulary are
    common to all companies, or each company's own (as ``assign_topics`` gives
    them); then a company has the topics it has centroids for."""
    by, summary = company_of(labelled), topic_summary(labelled, k)
    own = company_of(centroids)
    if isinstance(vocab, DataFrame) and not own:
        vocab = FT.vocab_rows(vocab)
    terms = (company_topic_terms if own else topic_terms)(centroids, vocab).select(*own, F.col("cluster").alias("id"), "parole_chiave")
    if own:
        summary = summary.join(terms.select(*own, "id"), [*own, "id"], "left_semi")
    ranked = order_topics(summary)
    shown = F.struct("example", "seq", "review_id", "testo", "rating", "data", "link")
    examples = topic_examples(labelled, k, cfg).groupBy(*by, "id").agg(F.array_sort(F.collect_list(shown)).alias("esempi"))
    none = examples.schema["esempi"].dataType
    return ranked.join(terms, [*own, "id"], "left").join(examples, [*by, "id"], "left").select(
        *by, "rank", "id", F.coalesce("parole_chiave", F.array().cast("array<string>")).alias("parole_chiave"),
        "n_recensioni", "percentuale", "rating_medio", F.coalesce("esempi", F.array().cast(none)).alias("esempi"))
