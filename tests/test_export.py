"""One JSON document from many tasks; tables committed together."""

from __future__ import annotations

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from oracle import SF_SMALL, duck
from recensio.plans import export as EX
from recensio.plans import queries as Q


def read_document(path):
    return json.loads("".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*"))))


def test_document_of_the_whole_chain_equals_the_one_built_in_duckdb(spark, tmp_path):
    doc = Q.report_document(spark, SF_SMALL)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        EX.write_json_document(doc, str(tmp_path / "doc"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(glob.glob(f"{tmp_path}/doc/part-*")) > 1
    got = read_document(tmp_path / "doc")
    rows = duck(SF_SMALL).execute(Q.ORACLE["report_document"]).fetchall()
    want = json.loads("".join(r[4] for r in sorted(rows, key=lambda r: (r[0], r[1] or "", r[2], r[3]))))
    assert got == want and len(got) == 24
    one = got["c1"]
    assert set(one) == {"metadata", "clusters", "insights", "frequenze"} and len(one["clusters"]) == 8 and len(one["insights"]) == 10
    assert one["metadata"]["url_analizzato"].endswith("/c1") and got["c5"]["insights"]["suggerimenti_cro"] == []


def test_odd_values(spark, tmp_path):
    stats = spark.createDataFrame([('a"b', 3, float("nan")), ("è", 0, None)], "company string, n_recensioni long, rating_medio double")
    topics = spark.createDataFrame([('a"b', 1, 0, ["qualità", "x\\y"], 100.0, None)], "company string, rank int, id int, parole_chiave array<string>, percentuale double, rating_medio double")
    ins = spark.createDataFrame([('a"b', "punti_forza", 0, "line\nbreak   \"q\""), ('a"b', "punti_forza", 1, "[,]")], "company string, categoria string, pos long, elemento string")
    sent = spark.createDataFrame([('a"b', 1, 2, 3)], "company string, positivo long, neutro long, negativo long")
    freq = spark.createDataFrame([('a"b', "punti_forza", i, f"t{i}", 30 - i, 1.5) for i in range(25)], "company string, tipo string, theme_pos int, punto string, count long, percentuale double")
    EX.write_json_document(EX.json_document(stats, topics, ins, sent, freq), str(tmp_path / "d"))
    got = read_document(tmp_path / "d")
    a, e = got['a"b'], got["è"]
    assert a["metadata"] == {"n_recensioni": 3, "rating_medio": None, "n_clusters": 1, "url_analizzato": None}
    assert a["clusters"] == [{"id": 0, "tematiche": ["qualità", "x\\y"], "percentuale": 100.0, "rating_medio": None}]
    assert a["insights"]["punti_forza"] == ["line\nbreak   \"q\"", "[,]"] and list(a["frequenze"]["punti_forza"]) == [f"t{i}" for i in range(20)]
    assert e["clusters"] == [] and e["insights"]["sentiment_distribution"] == {"positivo": 0, "neutro": 0, "negativo": 0} and e["frequenze"] == {"punti_forza": {}, "punti_debolezza": {}}
    EX.write_json_document(EX.json_document(*[d.limit(0) for d in (stats, topics, ins, sent, freq)]), str(tmp_path / "none"))
    assert read_document(tmp_path / "none") == {}
    EX.write_json_document(EX.json_document(*[d.filter("company = 'è'").drop("company") for d in (stats, topics, ins, sent, freq)]), str(tmp_path / "one"))
    assert list(read_document(tmp_path / "one")) == [""]


def test_a_failed_export_leaves_the_one_before(spark, tmp_path):
    ex = EX.Export(spark, str(tmp_path / "out"))
    with pytest.raises(FileNotFoundError):
        ex.tables()
    six = {f"t{i}": spark.range(i + 1).withColumn("v", F.lit("old")) for i in range(6)}
    assert ex.write(six) == 1
    bad = {k: d.withColumn("v", F.lit("new")) for k, d in six.items()}
    bad["t3"] = bad["t3"].withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        ex.write(bad)
    seen = ex.tables()
    assert {k: (d.count(), {r.v for r in d.collect()}) for k, d in seen.items()} == {f"t{i}": (i + 1, {"old"}) for i in range(6)}
    good = {k: d.withColumn("v", F.lit("new")) for k, d in six.items()}
    assert ex.write(good) == 2 and {r.v for r in ex.tables()["t5"].collect()} == {"new"} and {r.v for r in ex.tables(1)["t5"].collect()} == {"old"}
    assert len(os.listdir(tmp_path / "out" / "runs")) == 3
    ex.expire()
    assert len(os.listdir(tmp_path / "out" / "runs")) == 1 and {r.v for r in ex.tables()["t2"].collect()} == {"new"}


def test_two_writers_take_two_numbers(spark, tmp_path, monkeypatch):
    a, b = (EX.Export(spark, str(tmp_path)) for _ in range(2))
    df = spark.range(2)
    numbers = a._numbers
    monkeypatch.setattr(a, "_numbers", lambda: (b.write({"t": df}), [])[1])  # b commits while a does
    assert a.write({"t": df}, "csv") == 2
    monkeypatch.setattr(a, "_numbers", numbers)
    assert a.tables()["t"].count() == 2 and a._numbers() == [1, 2]
