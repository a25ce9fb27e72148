"""Steps that grew faster than their input: the same results with bounded
passes, groups and moves."""

from __future__ import annotations

import json
import random
from collections import Counter
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from oracle import SF_SMALL
from recensio.config import Config
from recensio.operators import blocks as BL
from recensio.operators import features as FT
from recensio.operators import kmeans as KM
from recensio.operators import themes as TH
from recensio.plans import export as EX
from recensio.plans import queries as Q
from recensio.plans import report as RP


def _vectors(spark, n=1500, dim=12):
    rng = np.random.default_rng(3)
    rows = [("a", s, n, dim, 6, int(rng.integers(1 << 30)), list(range(dim)), [int(v) for v in rng.integers(0, 300_000, dim)]) for s in range(n)]
    return spark.createDataFrame(rows, "company string, seq long, n long, dim int, k int, draw long, idx array<int>, val array<long>"), rows


def test_lloyd_takes_several_steps_a_pass(spark, monkeypatch):
    """Same centres and costs as plain steps, after any number of them, in far
    fewer passes over the vectors."""
    vectors, rows = _vectors(spark)
    x = np.array([r[7] for r in rows], float)
    monkeypatch.setattr(KM, "BLOCK", 256)
    KM.ship_package(spark)
    blocks = KM.Blocks(vectors)
    first = KM.packed_centres(vectors.where("seq < 6").withColumn("topic", F.col("seq").cast("int")))
    passes = []
    meet = KM.Blocks.meet
    monkeypatch.setattr(KM.Blocks, "meet", lambda *a, **k: passes.append(1) or meet(*a, **k))
    for most in (1, 9, 300):
        want, steps, moved = x[:6], 0, True
        while moved and steps < most:
            _, cost, n, sums = KM.step(x, want)
            new = KM.means(want, n, sums)
            moved, want, steps = bool((new != want).any()), new, steps + 1
        passes.clear()
        got = sorted(KM.lloyd(blocks, first, 1, most).collect(), key=lambda r: r.topic)
        assert (np.stack([np.frombuffer(r.vec, "<i8") for r in got]) == want).all()
        assert {(r.cost, r.moved) for r in got} == {(cost, moved)} and len(passes) <= steps
    assert steps > 15 and len(passes) <= steps - 8


def _read_once(spark, monkeypatch, name):
    """How many times the reviews are made while a query runs, in rows."""
    seen, made = spark.sparkContext.accumulator(0), Q.reviews_df

    def counted(*a):
        r = made(*a)

        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b
        return r.mapInArrow(run, r.schema)

    monkeypatch.setattr(Q, "reviews_df", counted)
    Q.QUERIES[name](spark, SF_SMALL).collect()
    return seen.value / made(spark, SF_SMALL).count()


def test_topic_terms_cleans_once(spark, monkeypatch):
    assert _read_once(spark, monkeypatch, "topic_terms") == 1


def test_topic_assign_cleans_once(spark, monkeypatch):
    assert _read_once(spark, monkeypatch, "topic_assign") == 1


def test_topic_cards_cleans_once(spark, monkeypatch):
    assert _read_once(spark, monkeypatch, "topic_cards") == 1


def test_theme_frequency_word_index_cleans_once(spark, monkeypatch):
    assert _read_once(spark, monkeypatch, "theme_frequency_word_index") == 1


def test_term_counts_with_nulls_and_odd_words(spark):
    rows = [("a", 1, ["uno", "due", "uno", None, "x1"]), ("a", 2, ["uno\n", "due"]), ("a", 3, None), ("b", 1, []), ("b", 2, ["è", "uno"])]
    df = spark.createDataFrame(rows, "company string, seq long, parole array<string>")
    assert {r.term: (r.df, r.cf) for r in FT.term_stats(df).collect()} == {"uno": (2, 3), "uno\n": (1, 1), "due": (2, 2)}
    d = {r.company: r for r in FT.dictionaries(df, Config(min_df=1, max_df=1.0)).collect()}
    assert (d["a"].n, d["b"].n) == (2, 2) and d["a"].terms == ["due", "uno", "uno\n"] and d["b"].terms == ["uno"]
    v = {(r.company, r.seq): r for r in FT.company_vectors(df, FT.dictionaries(df, Config(min_df=1, max_df=1.0))).collect()}
    assert v["a", 3].idx is None and v["b", 1].idx == [] and v["a", 1].idx == [0, 1] and v["b", 2].w == [1.0]


def test_frequencies_in_many_parts(spark, monkeypatch):
    """Parts and chunks of a few rows, identities larger than a part: no row
    but one per text and chunk is moved, counts as the other plan's."""
    monkeypatch.setattr(TH, "PART_REVIEWS", 16)
    monkeypatch.setattr(TH, "PART_SETS", 5)
    rnd = random.Random(8)
    words = [f"parola{chr(97 + i)}" for i in range(20)]
    rows = []
    for s in range(500):
        p = rnd.choices(words, k=rnd.randrange(9))
        rows.append(("ab"[s % 5 == 0], s, None if s % 4 == 0 else f"id{rnd.randrange(200)}", " ".join(p), p, rnd.choice([1, 2, 4, 5])))
    r = spark.createDataFrame(rows, "company string, seq long, review_id string, testo_pulito string, parole array<string>, rating int")
    puntos = [" ".join(rnd.choices(words, k=rnd.randrange(1, 5))) for _ in range(30)] + ["a of", "parola", "arola parolab", "manca"]
    th = spark.createDataFrame([(c, t, i, p) for c in "ab" for t in (TH.STRENGTHS, TH.WEAKNESSES) for i, p in enumerate(puntos)], "company string, tipo string, theme_pos int, punto string")
    got, want = (sorted(map(tuple, TH.theme_frequency(r, th, replace(Config(), theme_plan=p)).collect())) for p in ("index", "broadcast"))
    assert got == want and len(got) > 60
    band = TH.band_reviews(r, Config()).select("company", "seq", "ident", "tipo", F.array_join("parole", " ").alias("text"))
    sets = spark.createDataFrame([("a", TH.STRENGTHS, "parolaa parolab"), ("b", TH.STRENGTHS, "parolac")], "company string, tipo string, kws string")
    per = band.groupBy("company", "tipo", "ident").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    texts, dealt = TH._dealt(band, sets, per)
    assert texts.count() == band.count() and max(Counter((x.company, x.tipo, x.part) for x in texts.collect()).values()) <= 48
    assert dealt.select("part").distinct().count() > 1


def test_blocks_of_words_with_spaces_and_nulls(spark):
    """A text that its spaces part otherwise keeps its words; only texts move."""
    rows = [(0, ["uno", "due", "tre"]), (1, ["a b", None, "c"]), (2, []), (3, ["", "d"]), (4, [None, None, "e"])]
    df = spark.createDataFrame(rows, "seq long, parole array<string>")
    flat = [w for _, p in rows for w in p]
    out = {r.block_id: (r.n_words, r.testo) for r in BL.text_blocks(df, Config(block_words=2)).collect()}
    assert out == {i: (len(flat[2 * i:2 * i + 2]), " ".join(w for w in flat[2 * i:2 * i + 2] if w is not None)) for i in range((len(flat) + 1) // 2)}


def test_blocks_move_one_text_per_review(spark):
    df = spark.createDataFrame([(0, ["uno", "due"]), (1, ["a b"])], "seq long, parole array<string>")
    assert [tuple(r) for r in BL.moved_words(df, ["seq"]).sort("seq").collect()] == [(0, "uno due", None), (1, "a b", ["a b"])]


def test_themes_with_fallback_makes_the_frequencies_once(spark):
    """Ranks and the types that have any come from one reading."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [("a", TH.STRENGTHS, i, f"p{i}", 20 - i, 1.0) for i in range(14)]
    freq = spark.createDataFrame(rows, "company string, tipo string, theme_pos int, punto string, count long, percentuale double")
    ins = spark.createDataFrame([("a", TH.STRENGTHS, 0, "p0"), ("a", TH.WEAKNESSES, 0, "w0"), ("a", TH.WEAKNESSES, 10, "w10")], "company string, categoria string, pos long, elemento string")
    out = RP.themes_with_fallback(freq.mapInArrow(run, freq.schema), ins).collect()
    assert seen.value == len(rows)
    assert sorted(map(tuple, out)) == sorted([("a", TH.STRENGTHS, i + 1, f"p{i}", "frequenza") for i in range(10)] + [("a", TH.WEAKNESSES, 1, "w0", "elenco")])


def test_themes_with_fallback_query_counts_once(spark, monkeypatch):
    """No second pass over the parts of the corpus."""
    seen, counts = spark.sparkContext.accumulator(0), TH._set_counts

    def counted(*a):
        df = counts(*a)

        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b
        return df.mapInArrow(run, df.schema)

    monkeypatch.setattr(TH, "_set_counts", counted)
    r = spark.createDataFrame([("a", i, f"id{i}", "buono prezzo", ["buono", "prezzo"], 5) for i in range(9)], "company string, seq long, review_id string, testo_pulito string, parole array<string>, rating int")
    ins = spark.createDataFrame([("a", TH.STRENGTHS, 0, "buono prezzo"), ("a", TH.STRENGTHS, 1, "prezzo")], "company string, categoria string, pos long, elemento string")
    out = RP.themes_with_fallback(TH.theme_frequency(r, Q.merged_themes(ins), Config(), written=True), ins).collect()
    assert sorted(map(tuple, out)) == [("a", TH.STRENGTHS, 1, "buono prezzo", "frequenza"), ("a", TH.STRENGTHS, 2, "prezzo", "frequenza")] and seen.value == 2


def test_keywords_of_words():
    """As by looking for every keyword in every word, over more than one chunk of letters."""
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choices("abàc𝒳", k=n))
    words = [word(rnd.randrange(12)) for _ in range(400)] + ["b" * (1 << 20) + "àca", "", "aaaa"]
    keys = sorted({word(rnd.randrange(4, 9)) for _ in range(300)} | {"b" * 300, "aaaa"})
    kw, at = TH._keywords_of(words, {k: i for i, k in enumerate(keys)})
    assert list(zip(kw.tolist(), at.tolist())) == [(i, j) for i, k in enumerate(keys) for j, w in enumerate(words) if k in w]
    assert [len(x) for x in TH._keywords_of([], {"aaaa": 0})] == [0, 0] == [len(x) for x in TH._keywords_of(["aaaa"], {})]


def test_json_document_makes_the_frequencies_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    make = spark.createDataFrame
    freq = make([("a", t, i, f"p{i}", 9 - i, 1.0) for t in (TH.STRENGTHS, TH.WEAKNESSES) for i in range(3)], "company string, tipo string, theme_pos int, punto string, count long, percentuale double")
    doc = EX.json_document(
        make([("a", 3, 4.0)], "company string, n_recensioni long, rating_medio double"),
        make([("a", 1, 0, ["x"], 100.0, 4.0)], "company string, rank int, id int, parole_chiave array<string>, percentuale double, rating_medio double"),
        make([("a", TH.STRENGTHS, 0, "p0")], "company string, categoria string, pos long, elemento string"),
        make([("a", 1, 0, 0)], "company string, positivo long, neutro long, negativo long"), freq.mapInArrow(run, freq.schema))
    text = "".join(r.testo for r in doc.orderBy(*EX.PLACE).collect())
    got = json.loads(text)["a"]["frequenze"]
    assert {t: [*v] for t, v in got.items()} == {t: ["p0", "p1", "p2"] for t in (TH.STRENGTHS, TH.WEAKNESSES)} and seen.value == 6
