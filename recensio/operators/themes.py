"""How often each strength / weakness is mentioned (theme frequency).

A theme (``company``, ``tipo``, ``theme_pos``, ``punto``) matches a review of
its company and rating band when at least min(2, #keywords) of its keywords (first three words
longer than 3 chars) are substrings of the review's cleaned text; a theme
without keywords matches the whole band.  The count is the number of
distinct review identities among the matches, the share divides it by all
rows of the band.

Two exact plans for the match:
* ``plan="broadcast"``, for a theme table that is a literal of the caller:
  the substring condition is evaluated inside a broadcast hash join on
  company and band (reviews are never shuffled before the aggregate);
* ``plan="index"`` (the default), for themes from data, of any number: they
  are matched through a word index: a keyword has no
  whitespace, so it is a substring of the text iff it is a substring of one
  of its words.  Substrings of every distinct word (only of the keyword
  lengths in use) are equi-joined with the distinct keywords; the result is
  joined back to (review, word) pairs.  Where the pairs themselves are wanted
  (examples), themes meet reviews only through their rarest keywords (prefix
  filter) and each candidate is verified.  All joins are equi-joins on
  shuffled keys, so nothing has to fit in one task.  For the frequencies no
  pairs are made: a band's reviews are dealt into parts of at most some
  ``PART_REVIEWS`` reviews and ``PART_CHARS`` characters, all reviews of an
  identity in one part, and each part meets the keyword sets of the band, at
  most some ``PART_SETS`` at a time.  There the reviews of a keyword are a
  bitmap, a theme is an AND / OR of at most three of them, and identities are
  counted as bits.  A text moves once (for each ``PART_SETS`` sets), and only
  one number per part and set comes back.  Identities of too many reviews for
  a part are dealt by review, and come back by name.

Themes without keywords are counted per band (distinct identities of the
band), never paired with each review.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recensio.config import Config
from recensio.functions import text as T
from recensio.operators.ordering import running_offset
from recensio.operators.reviews import company_of, review_key, with_identity
from recensio.session import materialize, ship_package, stored

THEME = ("tipo", "theme_pos", "punto")
STRENGTHS = "punti_forza"
WEAKNESSES = "punti_debolezza"
SHIFT = 6
BITS = 1 << SHIFT  # reviews to a word of a bitmap
# Keywords are broadcast up to this number (a few MB), beyond it shuffled.
BROADCAST_KEYWORDS = 50_000
# What one group of the frequencies holds.
PART_REVIEWS, PART_CHARS, PART_SETS = 8192, 32 << 20, 32768
# Hash of a window of letters, found by its first bits (and then compared).
HASH_BASE, HASH_BITS = 0x9E3779B97F4A7C15, 20


def theme_keys(df: DataFrame) -> list[str]:
    return [*company_of(df), *THEME]


def rating_band(rating: Column, cfg: Config = Config()) -> Column:
    """'punti_forza' for positive ratings, 'punti_debolezza' for negative
    ones, NULL otherwise (missing and 0 ratings are in no band)."""
    truthy = rating.isNotNull() & (rating != 0)
    return (
        F.when(truthy & (rating >= cfg.positive_min), F.lit(STRENGTHS))
        .when(truthy & (rating <= cfg.negative_max), F.lit(WEAKNESSES))
    )


def theme_keywords(themes: DataFrame) -> DataFrame:
    """Adds ``kw`` (array of keywords) and ``nkw`` to a theme table."""
    return themes.withColumn("kw", T.theme_keywords(F.col("punto"))).withColumn("nkw", F.size("kw"))


def band_reviews(reviews: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Reviews in a rating band: company, seq, ident, tipo, txt (lower-cased clean
    text) and parole.  Only these columns travel through the match."""
    r = with_identity(reviews, cfg).withColumn("tipo", rating_band(F.col("rating"), cfg))
    return r.filter(F.col("tipo").isNotNull()).select(
        *review_key(r), "ident", "tipo", F.lower("testo_pulito").alias("txt"), "parole"
    )


def band_sizes(reviews: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Rows per company and band (the denominator of the share)."""
    by = company_of(reviews)
    return (
        reviews.select(*by, rating_band(F.col("rating"), cfg).alias("tipo"))
        .filter(F.col("tipo").isNotNull())
        .groupBy(*by, "tipo")
        .agg(F.count(F.lit(1)).alias("band_rows"))
    )


def _match_condition(kw: Column, nkw: Column, txt: Column) -> Column:
    hits = F.size(F.filter(kw, lambda k: F.instr(txt, k) > 0))
    return hits >= F.least(F.lit(2), nkw)


def _matches_broadcast(band: DataFrame, themes: DataFrame) -> DataFrame:
    j = band.join(F.broadcast(themes), [*company_of(band), "tipo"])
    return j.filter(_match_condition(F.col("kw"), F.col("nkw"), F.col("txt"))).select(*theme_keys(band.select(*company_of(band))), "nkw", "seq", "ident")


def _kw_rows(themes: DataFrame) -> DataFrame:
    """(company, tipo, theme_pos, punto, nkw, k_idx, kw): one row per keyword slot."""
    return themes.filter(F.col("nkw") > 0).select(
        *theme_keys(themes), "nkw", F.posexplode("kw").alias("k_idx", "kw")
    )


def _word_keywords(words: DataFrame, kw_rows: DataFrame) -> DataFrame | None:
    """(word, kw): the keywords that are substrings of each of words(word)
    (None when there is no keyword at all)."""
    keywords = kw_rows.select("kw").distinct()
    # Distinct keyword lengths: a handful of small integers.
    sizes = keywords.groupBy(F.length("kw").alias("n")).count().collect()
    lengths = sorted(r["n"] for r in sizes)
    if not lengths:
        return None
    if sum(r["count"] for r in sizes) <= BROADCAST_KEYWORDS:
        keywords = F.broadcast(keywords)  # a word's substrings meet them in place
    subs = words.distinct().select(
        "word",
        F.explode(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.array(*[F.lit(n) for n in lengths]),
                        lambda n: F.transform(
                            F.sequence(F.lit(1), F.greatest(F.length("word") - n + 1, F.lit(0))),
                            lambda i: F.substring(F.col("word"), i, n),
                        ),
                    )
                )
            )
        ).alias("kw"),
    ).filter(F.length("kw") > 0)
    return subs.join(keywords, "kw").select("word", "kw").distinct()


def _presence(band: DataFrame, kw_rows: DataFrame) -> DataFrame | None:
    """(company, seq, ident, tipo, kw): one row per keyword a band review
    contains (None when there is no keyword at all)."""
    key = review_key(band)
    review_words = band.select(*key, "ident", "tipo", F.explode(F.array_distinct("parole")).alias("word"))
    word_kw = _word_keywords(review_words.select("word"), kw_rows)
    if word_kw is None:
        return None
    # (review, keyword) presence: one row per keyword a review contains.
    # Read three times (frequencies, candidates, verification): written once.
    return materialize(review_words.join(word_kw, "word").select(*key, "ident", "tipo", "kw").distinct())


def _bit(seq: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), seq.bitwiseAND(BITS - 1).cast("int"))


def keyword_bitmaps(band: DataFrame, kw_rows: DataFrame) -> DataFrame | None:
    """(company, tipo, kw, w, bits): the reviews that hold each keyword, as
    bits of 64-bit words; review seq is bit seq % 64 of word seq / 64.  Only
    words with a bit set have a row, so a keyword costs a row per review at
    most, and a row per 64 reviews where it is everywhere."""
    by = company_of(band)
    review_words = band.select(*by, "seq", "tipo", F.explode(F.array_distinct("parole")).alias("word"))
    word_kw = _word_keywords(review_words.select("word"), kw_rows)
    if word_kw is None:
        return None
    w = F.shiftright("seq", SHIFT).alias("w")
    return materialize(review_words.join(word_kw, "word").groupBy(*by, "tipo", "kw", w).agg(F.bit_or(_bit(F.col("seq"))).alias("bits")))


def _set_of(kw: Column) -> Column:
    """The keywords of a theme (none holds a space) in a fixed order."""
    return F.array_join(F.array_sort(kw), " ")


def _matched_words(bitmaps: DataFrame, sets: DataFrame) -> DataFrame:
    """(company, tipo, kws, w, bits): the reviews that match each keyword set,
    an AND / OR of at most three bitmaps; no review is paired with a theme."""
    by = company_of(sets)
    slots = sets.select(*by, "tipo", "kws", F.posexplode(F.split("kws", " ")).alias("k", "kw"))
    b = [F.coalesce(F.bit_or(F.when(F.col("k") == i, F.col("bits"))), F.lit(0).cast("long")).alias(f"b{i}") for i in range(3)]
    held = slots.join(bitmaps, [*by, "tipo", "kw"]).groupBy(*by, "tipo", "kws", "w").agg(*b)
    n = F.size(F.split("kws", " "))
    both = lambda x, y: F.col(x).bitwiseAND(F.col(y))
    bits = F.when(n == 1, F.col("b0")).when(n == 2, both("b0", "b1")).otherwise(both("b0", "b1").bitwiseOR(both("b0", "b2")).bitwiseOR(both("b1", "b2")))
    return held.select(*by, "tipo", "kws", "w", bits.alias("bits")).filter(F.col("bits") != 0)


def _dealt(band: DataFrame, sets: DataFrame, per: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The band's texts and the keyword sets, each with the part and chunk
    they meet in.  per: rows and characters of every identity of the band."""
    by = [*company_of(band), "tipo"]
    sizes = per.groupBy(*by).agg(F.greatest(F.ceil(F.sum("n") / PART_REVIEWS), F.ceil(F.sum("chars") / PART_CHARS)).alias("parts")).unionByName(
        sets.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / PART_SETS).alias("chunks")), allowMissingColumns=True)
    # Tables of the large bands and identities alone: a row per thousands of reviews or sets.
    large = sizes.groupBy(*by).agg(*[F.max(c).cast("int").alias(c) for c in ("parts", "chunks")]).filter("parts > 1 or chunks > 1")
    hot = per.filter((F.col("n") > PART_REVIEWS // 2) | (F.col("chars") > PART_CHARS // 2)).select(*by, "ident", F.lit(True).alias("hot"))
    large, hot = F.broadcast(materialize(large)), F.broadcast(materialize(hot))
    parts, chunks = (F.coalesce(c, F.lit(1)) for c in ("parts", "chunks"))
    place = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    hot_one = F.coalesce("hot", F.lit(False))
    texts = band.join(large, by, "left").join(hot, [*by, "ident"], "left").select(
        *by, F.when(hot_one, place("seq", parts)).otherwise(place("ident", parts)).alias("part"), every(chunks).alias("chunk"), "ident", hot_one.alias("hot"), "text")
    sets = sets.join(large, by, "left").select(*by, place("kws", chunks).alias("chunk"), every(parts).alias("part"), "kws")
    return texts, sets


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def _keywords_of(words: list[str], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(number of a keyword, place of a word it is a substring of), each pair
    once, in order.  The windows of the keywords' lengths (no keyword holds a
    space) are looked up by a hash, those found are compared."""
    base, inverse = np.uint64(HASH_BASE), np.uint64(pow(HASH_BASE, -1, 1 << 64))
    lengths: dict[int, list[str]] = {}
    for k in number:
        lengths.setdefault(len(k), []).append(k)
    up = np.cumprod(np.full(max(lengths, default=0), base))
    tables = {}
    for m, ks in lengths.items():
        tables[m] = np.zeros(1 << HASH_BITS, bool)
        tables[m][(_codes("".join(ks)).reshape(-1, m) * up[:m]).sum(axis=1, dtype=np.uint64) >> np.uint64(64 - HASH_BITS)] = True
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
    pairs, lo = [np.zeros(0, np.int64)], 0
    while lo < len(words):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + (1 << 20), "right")))
        text = " ".join(words[lo:hi])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c := _codes(text)) * np.cumprod(np.full(len(c), base)))])
        down = np.cumprod(np.full(len(c), inverse)) * base
        for m, table in tables.items():
            if m > len(c):
                continue
            at = np.flatnonzero(table[((sums[m:] - sums[:-m]) * down[:len(c) - m + 1]) >> np.uint64(64 - HASH_BITS)])
            k = np.fromiter((number.get(text[i:i + m], -1) for i in at.tolist()), np.int64, len(at))
            w = lo + np.searchsorted(ends[lo:hi] - before, at[k >= 0], "right")
            pairs.append(k[k >= 0] * len(words) + w)
        lo = hi
    pair = np.sort(np.concatenate(pairs))
    return np.divmod(pair[np.diff(pair, prepend=-1) > 0], max(len(words), 1))


def _part_counts(texts: pa.Table, sets: pa.Table) -> tuple[np.ndarray, list[tuple[int, str]]]:
    """(distinct identities among the reviews that match each set, pairs of a
    set and a hot identity that does)."""
    ident = texts["ident"].combine_chunks().dictionary_encode()
    names, code = ident.dictionary, np.asarray(ident.indices)
    hot = texts["hot"].to_numpy().astype(bool)
    # Places of the bits: identities with one review, then the others, each
    # side by side, from a whole byte on.
    n = np.bincount(code)
    order = np.lexsort((code, n[code] > 1, hot))
    single = int(((n[code] == 1) & ~hot).sum())
    from_byte = -(-single // 8)
    place = np.empty(len(code), np.int64)
    place[order] = np.arange(len(code)) + np.where(np.arange(len(code)) < single, 0, 8 * from_byte - single)
    others = code[order][single:]
    starts = np.flatnonzero(np.diff(others, prepend=-1))
    is_hot = hot[order][single:][starts]

    split = pc.split_pattern(texts["text"].combine_chunks(), " ")
    row = np.repeat(np.arange(len(code)), np.asarray(pc.fill_null(pc.list_value_length(split), 0)))
    words = split.flatten().dictionary_encode()
    slots = [s.split(" ") for s in sets["kws"].to_pylist()]
    number = {k: i for i, k in enumerate({k for s in slots for k in s})}
    # (keyword, word) by keyword, and the places of every word
    of, of_w = _keywords_of(words.dictionary.to_pylist(), number)
    held = np.bincount(of_w, minlength=len(words.dictionary))
    word = np.asarray(words.indices).astype(np.int64)
    word, row = word[held[word] > 0], row[held[word] > 0]
    places, times = place[row][np.argsort(word, kind="stable")], np.bincount(word, minlength=len(held))
    begin = np.cumsum(times) - times
    width = from_byte + -(-len(others) // 8)
    maps = np.zeros((len(number) + 1, width), np.uint8)  # the last: no keyword
    for lo in range(0, len(number), 1024):
        here = slice(*np.searchsorted(of, (lo, lo + 1024)))
        w, n_kw = of_w[here], min(1024, len(number) - lo)
        reps = times[w]
        at = np.repeat(begin[w] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        bits = np.zeros((n_kw, 8 * width), bool)
        bits.reshape(-1)[np.repeat((of[here] - lo) * (8 * width), reps) + places[at]] = True
        maps[lo:lo + n_kw] = np.packbits(bits, axis=1)

    keys = np.full((len(slots), 3), len(number))
    for i, s in enumerate(slots):
        keys[i, :len(s)] = [number[k] for k in s]
    many = np.array([len(s) for s in slots])
    counts, found = np.zeros(len(slots), np.int64), []
    for lo in range(0, len(slots), 1024):
        a, b, c = (maps[keys[lo:lo + 1024, j]] for j in range(3))
        m = many[lo:lo + 1024, None]
        match = np.where(m == 1, a, np.where(m == 2, a & b, (a & b) | (a & c) | (b & c)))
        counts[lo:lo + 1024] = np.bitwise_count(match[:, :from_byte]).sum(axis=1, dtype=np.int64)
        if len(starts):
            any_of = np.maximum.reduceat(np.unpackbits(match[:, from_byte:], axis=1, count=len(others)), starts, axis=1)
            counts[lo:lo + 1024] += any_of[:, ~is_hot].sum(axis=1, dtype=np.int64)
            s, i = np.nonzero(any_of * is_hot)
            found += zip((s + lo).tolist(), names.take(pa.array(others[starts[i]])).to_pylist())
    return counts, found


def _set_counts(band: DataFrame, sets: DataFrame, per: DataFrame) -> DataFrame:
    """(company, tipo, kws, count): distinct identities among the reviews that
    match each set, of band(company, seq, ident, tipo, text)."""
    ship_package(band.sparkSession)
    by = [*company_of(band), "tipo"]
    texts, dealt = _dealt(band, sets, per)
    keys = [*by, "part", "chunk"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        counts, found = _part_counts(left, right) if left.num_rows and right.num_rows else (np.zeros(0, np.int64), [])
        some = np.flatnonzero(counts)
        at = pa.array(np.concatenate([some, np.array([s for s, _ in found], np.int64)]))
        cells = [pa.array([right[c][0].as_py()] * len(at) if len(at) else [], pa.string()) for c in by]
        return pa.Table.from_arrays([*cells, right["kws"].take(at).combine_chunks() if len(at) else pa.array([], pa.string()),
                                     pa.array([None] * len(some) + [i for _, i in found], pa.string()), pa.array(counts[some].tolist() + [0] * len(found), pa.int64())],
                                    names=[*by, "kws", "ident", "n"])

    schema = "".join(f"{c} string, " for c in by) + "kws string, ident string, n long"
    counted = texts.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(run, schema)
    return counted.groupBy(*by, "kws").agg((F.sum("n") + F.countDistinct("ident")).alias("count"))


def _pairs(present: DataFrame, kw_rows: DataFrame) -> DataFrame:
    """(company, tipo, theme_pos, punto, nkw, seq, ident) for every match."""
    keys, key = theme_keys(kw_rows), review_key(present)
    by = company_of(present)
    # Prefix filter: a match hits >= need = min(2, nkw) of the nkw keyword
    # slots, so it hits at least one of the nkw - need + 1 rarest slots
    # (rarity = reviews of the band containing the keyword).  Only those
    # probe slots are joined with the reviews; each candidate is then checked
    # against all of its theme's (<= 3) slots.  Exact, and a keyword common to
    # many themes and reviews is joined only where it is a theme's rarest.
    need = F.least(F.lit(2), F.col("nkw"))
    freq = present.groupBy(*by, "tipo", "kw").agg(F.count(F.lit(1)).alias("kdf"))
    slot_order = Window.partitionBy(*keys).orderBy("kdf", "k_idx")  # <= 3 rows per theme
    ranked = (
        kw_rows.join(freq, [*by, "tipo", "kw"], "left")
        .withColumn("kdf", F.coalesce("kdf", F.lit(0)))
        .withColumn("slot", F.row_number().over(slot_order))
    )
    probes = ranked.filter(F.col("slot") <= F.col("nkw") - need + 1).select(*keys, "kw", "nkw")
    cand = present.join(probes, [*by, "tipo", "kw"]).select(*keys, "nkw", "seq", "ident").distinct()
    checks = cand.join(kw_rows.select(*keys, "kw", "k_idx"), keys)
    hits = checks.join(present.select(*key, "tipo", "kw"), [*key, "tipo", "kw"])
    return (
        hits.groupBy(*keys, "nkw", "seq", "ident")
        .agg(F.count(F.lit(1)).alias("hits"))
        .filter(F.col("hits") >= need)
        .drop("hits")
    )


def _matches_word_index(band: DataFrame, themes: DataFrame) -> DataFrame:
    kw_rows = _kw_rows(themes)
    present = _presence(band, kw_rows)
    if present is None:
        return themes.join(band.select(*company_of(band), "seq", "ident", "tipo"), [*company_of(band), "tipo"]).filter(F.lit(False)).select(*theme_keys(themes), "nkw", "seq", "ident")
    return _pairs(present, kw_rows)


def _matches_no_keyword(band: DataFrame, themes: DataFrame) -> DataFrame:
    """Themes without any keyword match every review of their band."""
    empty = themes.filter(F.col("nkw") == 0).select(*theme_keys(themes), "nkw")
    return band.join(empty, [*company_of(band), "tipo"]).select(*theme_keys(themes), "nkw", "seq", "ident")


def _prepared_themes(themes: DataFrame) -> DataFrame:
    """Themes with keywords, written once: they are read for their keyword
    lengths and joined several times."""
    return materialize(theme_keywords(themes))


def _keyword_matches(band: DataFrame, th: DataFrame, cfg: Config) -> DataFrame:
    """Matching (review, theme) pairs for themes with at least one keyword."""
    with_kw = th.filter(F.col("nkw") > 0)
    if cfg.theme_plan == "broadcast":
        return _matches_broadcast(band, with_kw)
    return _matches_word_index(band, with_kw)


def _keyword_counts(band: DataFrame, th: DataFrame, cfg: Config, per: DataFrame | None = None) -> DataFrame:
    """(tipo, theme_pos, punto, count) for themes with keywords.  In the
    index plan the reviews of each keyword are a bitmap; themes with the same
    keywords are counted once."""
    by, keys = company_of(band), theme_keys(th)
    if cfg.theme_plan == "broadcast":
        return _matches_broadcast(band, th.filter(F.col("nkw") > 0)).groupBy(*keys).agg(F.countDistinct("ident").alias("count"))
    named = th.filter(F.col("nkw") > 0).select(*keys, _set_of(F.col("kw")).alias("kws"))
    sets = materialize(named.select(*by, "tipo", "kws").distinct())
    return named.join(_set_counts(band, sets, per), [*by, "tipo", "kws"]).select(*keys, "count")


def theme_matches(reviews: DataFrame, themes: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(tipo, theme_pos, punto, nkw, seq, ident) for every matching pair
    (a theme without keywords is paired with every review of its band)."""
    band = band_reviews(reviews, cfg)
    th = _prepared_themes(themes)
    return _keyword_matches(band, th, cfg).unionByName(_matches_no_keyword(band, th))


def theme_frequency(reviews: DataFrame, themes: DataFrame, cfg: Config = Config(), matches: DataFrame | None = None,
                    written: bool = False) -> DataFrame:
    """(company, tipo, theme_pos, punto, count, percentuale); themes with no match
    are left out.  Sort with ``order_themes`` for the ranked view.  written:
    ``reviews`` is a written table, reading it again costs little.

    Pairs are only formed for themes with keywords; a theme without any
    matches its whole band, so its count is the band's number of distinct
    identities, counted once per band instead of once per theme."""
    by, keys = company_of(reviews), theme_keys(reviews)
    if matches is None and cfg.theme_plan == "index":
        return _frequency_by_parts(reviews, themes, cfg, written)
    if matches is not None:
        counts = matches.groupBy(*keys).agg(F.countDistinct("ident").alias("count"))
    else:
        band = band_reviews(reviews, cfg)
        th = _prepared_themes(themes)
        counts = _keyword_counts(band, th, cfg)
        idents = band.groupBy(*by, "tipo").agg(F.countDistinct("ident").alias("count"))
        no_kw = th.filter(F.col("nkw") == 0).select(*keys).join(idents, [*by, "tipo"])
        counts = counts.unionByName(no_kw.select(*keys, "count"))
    sizes = band_sizes(reviews, cfg)
    return counts.join(sizes, [*by, "tipo"]).select(
        *keys, "count", (F.col("count") / F.col("band_rows") * 100).alias("percentuale")
    )


def _frequency_by_parts(reviews: DataFrame, themes: DataFrame, cfg: Config, written: bool) -> DataFrame:
    by, keys = company_of(reviews), theme_keys(reviews)
    # Keywords hold no space, so the words' text holds them where a word does.
    band = band_reviews(reviews, cfg).select(*by, "seq", "ident", "tipo", F.array_join("parole", " ").alias("text"))
    band = band if written else stored(band)
    th = _prepared_themes(themes)
    # A row per identity: the parts, the bands' sizes and their identities follow from it.
    per = materialize(band.groupBy(*by, "tipo", "ident").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")))
    sizes = per.groupBy(*by, "tipo").agg(F.count(F.lit(1)).alias("idents"), F.sum("n").alias("band_rows"))
    counts = _keyword_counts(band, th, cfg, per)
    no_kw = th.filter(F.col("nkw") == 0).select(*keys).join(sizes, [*by, "tipo"]).select(*keys, F.col("idents").alias("count"))
    return counts.unionByName(no_kw).join(sizes, [*by, "tipo"]).select(*keys, "count", (F.col("count") / F.col("band_rows") * 100).alias("percentuale"))


def order_themes(freq: DataFrame) -> DataFrame:
    """Rank (1..) of every theme within its company and type: count
    descending, then theme order.  The theme table grows with the answers, so
    no window holds a whole type (``running_offset``)."""
    ranked = running_offset(freq, [F.desc("count"), F.col("theme_pos")], F.lit(1), partition=[*company_of(freq), "tipo"], out="_r")
    return ranked.withColumn("rank", (F.col("_r") + 1).cast("int")).drop("_r")


def top_themes(freq: DataFrame, n: int) -> DataFrame:
    """The first ``n`` themes of each type with their rank; ``row_number()
    <= n`` is planned as a WindowGroupLimit, so each task keeps n rows per
    type before the shuffle."""
    w = Window.partitionBy(*company_of(freq), "tipo").orderBy(F.desc("count"), "theme_pos")
    return freq.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def theme_examples(reviews: DataFrame, themes: DataFrame, cfg: Config = Config(), matches: DataFrame | None = None) -> DataFrame:
    """First ``cfg.theme_examples`` matching reviews of distinct identity per
    theme (by review order), for themes with at least one keyword."""
    keys, key = theme_keys(reviews), review_key(reviews)
    if matches is None:
        m = _keyword_matches(band_reviews(reviews, cfg), _prepared_themes(themes), cfg)
    else:
        m = matches
    firsts = (
        m.filter(F.col("nkw") > 0)
        .groupBy(*keys, "ident")
        .agg(F.min("seq").alias("seq"))
    )
    # row_number() <= n becomes a WindowGroupLimit, applied before the
    # shuffle too, so a theme matched by millions of reviews ships n rows
    # per map task.
    w = Window.partitionBy(*keys).orderBy("seq")
    picked = firsts.withColumn("example", F.row_number().over(w)).filter(F.col("example") <= cfg.theme_examples)
    cols = reviews.select(*key, "review_id", "testo", "rating", "data", "link")
    return picked.join(cols, key).select(*keys, "example", "seq", "review_id", "testo", "rating", "data", "link")
