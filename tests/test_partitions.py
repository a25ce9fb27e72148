"""Results do not depend on how the input is partitioned."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from recensio.config import Config
from recensio.operators import blocks as BL
from recensio.operators.ordering import running_offset


def _reviews(spark, n=120, seed=3):
    rnd = random.Random(seed)
    rows = []
    for s in range(n):
        k = rnd.choice([0, 1, 3, 7, 25])
        rows.append((s * 7 + 1, [f"w{s}_{i}" for i in range(k)]))
    return spark.createDataFrame(rows, "seq bigint, parole array<string>")


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_text_blocks_match_python_slicing(spark, parts):
    cfg = Config(block_words=10)
    r = _reviews(spark).repartition(parts)
    words = [w for _, p in sorted((x.seq, x.parole) for x in r.collect()) for w in p]
    expected = [" ".join(words[i:i + 10]) for i in range(0, len(words), 10)]
    got = [x.testo for x in BL.text_blocks(r, cfg).orderBy("block_id").collect()]
    assert got == expected
    total = BL.block_count(r, cfg).first()
    assert (total.n_words, total.n_blocks) == (len(words), len(expected))


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_running_offset_equals_prefix_sum(spark, parts):
    rnd = random.Random(parts)
    rows = [(g, s, rnd.randrange(10)) for g in ("a", "b") for s in rnd.sample(range(500), 60)]
    df = spark.createDataFrame(rows, "g string, k bigint, w int").repartition(parts)
    got = {(x.g, x.k): x.offset for x in running_offset(df, ["k"], F.col("w"), partition=["g"]).collect()}
    for g in ("a", "b"):
        acc = 0
        for _, k, w in sorted(r for r in rows if r[0] == g):
            assert got[(g, k)] == acc
            acc += w


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_merge_insights_partition_independent(spark, parts):
    from recensio.operators import insights as IN

    rows = [(b, 1, '{"punti_forza": [%s]}' % ", ".join(f'"x{(b * 3 + i) % 11}"' for i in range(4))) for b in range(30)]
    resp = spark.createDataFrame(rows, "block_id bigint, attempt int, content string").repartition(parts)
    got = [(x.pos, x.elemento) for x in IN.merge_insights(IN.first_valid(IN.parse_responses(resp))).orderBy("pos").collect()]
    seen, expected = set(), []
    for b in range(30):
        for i in range(4):
            e = f"x{(b * 3 + i) % 11}"
            if e not in seen:
                seen.add(e)
                expected.append((len(expected), e))
    assert got == expected


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_order_themes_equals_sort(spark, parts):
    from recensio.operators.themes import order_themes

    rnd = random.Random(parts)
    rows = [(t, p, f"p{p}", rnd.choice([1, 1, 1, 2, 3, 7])) for t in ("punti_forza", "punti_debolezza") for p in range(70)]
    freq = spark.createDataFrame(rows, "tipo string, theme_pos int, punto string, count bigint").repartition(parts)
    got = {(x.tipo, x.theme_pos): x.rank for x in order_themes(freq).collect()}
    for t in ("punti_forza", "punti_debolezza"):
        ordered = sorted((r for r in rows if r[0] == t), key=lambda r: (-r[3], r[1]))
        assert [got[(t, r[1])] for r in ordered] == list(range(1, len(ordered) + 1))


def test_spread_only_when_fewer_splits_than_slots(spark):
    from recensio.sources.tables import spread

    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == slots
    many = spark.range(100).repartition(slots * 2)
    assert spread(many).rdd.getNumPartitions() == slots * 2
    assert sorted(r.id for r in spread(one).collect()) == list(range(100))


@pytest.mark.parametrize("parts", [1, 16])
def test_running_offset_on_sparse_and_page_built_order(spark, parts):
    rnd = random.Random(parts)
    rows = [("c%d" % (i % 3), (rnd.randrange(1, 100) << 20) + i, rnd.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "company string, seq bigint, w int").repartition(parts)
    got = {(x.company, x.seq): x.offset for x in running_offset(df, ["seq"], F.col("w"), partition=["company"]).collect()}
    for c in ("c0", "c1", "c2"):
        acc = 0
        for _, s, w in sorted(r for r in rows if r[0] == c):
            assert got[(c, s)] == acc
            acc += w


def test_blocks_are_numbered_per_company(spark):
    cfg = Config(block_words=10)
    r = _reviews(spark).withColumn("company", F.concat(F.lit("c"), (F.col("seq") % 3).cast("string")))
    for c in ("c0", "c1", "c2"):
        words = [w for _, p in sorted((x.seq, x.parole) for x in r.filter(F.col("company") == c).collect()) for w in p]
        got = [x.testo for x in BL.text_blocks(r, cfg).filter(F.col("company") == c).orderBy("block_id").collect()]
        assert got == [" ".join(words[i:i + 10]) for i in range(0, len(words), 10)]


def test_topic_labels_do_not_depend_on_layout(spark):
    from recensio.operators import topics as TP

    rnd = random.Random(2)
    vocab = [f"parola{chr(97 + i)}" for i in range(12)]
    rows = [(s, [rnd.choice(vocab) for _ in range(6)]) for s in range(80)]
    df = spark.createDataFrame(rows, "seq bigint, parole array<string>")
    cfg = Config(n_init=2, kmeans_max_iter=30)
    labels = []
    for layout in (df.coalesce(1), df.repartition(4), df.repartition(16, "seq").sortWithinPartitions(F.desc("seq"))):
        labels.append({x.seq: x.cluster for x in TP.assign_topics(layout, 4, cfg)[0].collect()})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        labels.append({x.seq: x.cluster for x in TP.assign_topics(df, 4, cfg)[0].collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(x == labels[0] for x in labels) and len(labels[0]) == 80
