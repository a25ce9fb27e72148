"""Exports of an analysis: one JSON document, and a set of tables committed
together.

The document is written by many tasks and by none as a whole: every entry is
a row of text with its place (company, part, position), the brackets are rows
of their own, and an entry knows from its position whether a comma stands
before it.  Sorted by place over all partitions, the part files, read one after
the other, are one valid document.

The tables of an export are written under a run of their own; one manifest,
put in place by a rename, makes the run the export.  Until then, and whenever
a run fails, readers see the export before it, whole.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recensio.config import INSIGHT_CATEGORIES, SENTIMENT_CLASSES
from recensio.operators import themes as TH
from recensio.operators.reviews import company_of
from recensio.plans import report as RP
from recensio.session import materialize

# ---- one JSON document -----------------------------------------------------------

PLACE = ("blocco", "company", "parte", "pos")
OPEN, BODY, CLOSE = 0, 1, 2
N_THEMES = 20


def _json(fields: dict[str, Column]) -> Column:
    """An object as text: null fields are written, NaN is null."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def _number(name: str) -> Column:
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c), c)


def _text(c: Column) -> Column:
    """A string as JSON text."""
    whole = F.to_json(F.array(c))  # ["..."]
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def _after(c: Column, pos: Column) -> Column:
    return F.concat(F.when(pos > 0, F.lit(",")).otherwise(F.lit("")), c)


def json_document(stats: DataFrame, topics: DataFrame, insights: DataFrame, sentiment: DataFrame, freq: DataFrame,
                  url: str | None = None, n_themes: int = N_THEMES) -> DataFrame:
    """(blocco, company, parte, pos, testo): the rows whose texts, sorted by
    the other columns, are the JSON report: an object with a member per
    company (metadata, clusters, insights, frequenze).

    Companies are those of ``stats``; a company without topics, insights,
    sentiment counts or themes has empty lists, zeros and objects.  In
    ``url``, ``{company}`` stands for the company.  Tables without the column
    are one company, named ''.
    """
    if not company_of(stats):
        stats, topics, insights, sentiment, freq = (d.withColumn("company", F.lit("")) for d in (stats, topics, insights, sentiment, freq))
    rows, parte = [], 0

    def add(df: DataFrame, pos, text: Column) -> None:
        nonlocal parte
        rows.append(df.select(F.lit(BODY).alias("blocco"), "company", F.lit(parte).alias("parte"), F.lit(pos).cast("long").alias("pos") if isinstance(pos, int) else pos.cast("long").alias("pos"), text.alias("testo")))
        parte += 1

    # The company of lowest name has no comma before it: one value.
    first = stats.agg(F.min("company")).first()[0]
    per_topic = topics.groupBy("company").agg(F.count(F.lit(1)).alias("n_clusters"))
    heads = stats.join(per_topic, "company", "left").join(sentiment, "company", "left")
    at = F.lit(url).cast("string")
    meta = _json({"n_recensioni": F.col("n_recensioni"), "rating_medio": _number("rating_medio"), "n_clusters": F.coalesce("n_clusters", F.lit(0).cast("long")),
                  "url_analizzato": F.replace(at, F.lit("{company}"), F.col("company"))})
    comma = F.when(F.col("company") == F.lit(first), F.lit("")).otherwise(F.lit(","))
    add(heads, 0, F.concat(comma, _text(F.col("company")), F.lit(':{"metadata":'), meta, F.lit(',"clusters":[')))
    add(topics, F.col("rank") - 1, _after(_json({"id": F.col("id"), "tematiche": F.col("parole_chiave"), "percentuale": _number("percentuale"), "rating_medio": _number("rating_medio")}), F.col("rank") - 1))
    for i, cat in enumerate(INSIGHT_CATEGORIES):
        lead = '],"insights":{' if i == 0 else "],"
        add(heads, 0, F.lit(f'{lead}"{cat}":['))
        mine = insights.filter(F.col("categoria") == cat)
        add(mine, F.col("pos"), _after(_text(F.col("elemento")), F.col("pos")))
    counts = _json({s: F.coalesce(s, F.lit(0).cast("long")) for s in SENTIMENT_CLASSES})
    add(heads, 0, F.concat(F.lit('],"sentiment_distribution":'), counts, F.lit("}")))
    # At most n_themes rows a company and type, written: the frequencies are made once.
    shown = materialize(TH.top_themes(freq, n_themes))
    for tipo, lead in ((TH.STRENGTHS, ',"frequenze":{'), (TH.WEAKNESSES, "},")):
        add(heads, 0, F.lit(f'{lead}"{tipo}":{{'))
        item = F.concat(_text(F.col("punto")), F.lit(":"), _json({"count": F.col("count"), "percentuale": _number("percentuale")}))
        add(shown.filter(F.col("tipo") == tipo), F.col("rank") - 1, _after(item, F.col("rank") - 1))
    add(heads, 0, F.lit("}}}"))
    ends = stats.sparkSession.createDataFrame([(OPEN, None, 0, 0, "{"), (CLOSE, None, 0, 0, "}")], "blocco int, company string, parte int, pos long, testo string")
    out = ends
    for r in rows:
        out = out.unionByName(r)
    return out


def write_json_document(document: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the rows of ``json_document`` as text files (UTF-8, not
    ASCII-escaped) that make one document in the order of their names."""
    document.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE).select("testo").write.mode(mode).text(path)


# ---- tables committed together ---------------------------------------------------

class Export:
    """A folder of exports: ``runs/<id>/<table>`` and ``manifests/<n>.json``;
    the manifest of the highest number names the run that is in force."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _numbers(self) -> list[int]:
        folder = self._at("manifests")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, number: int) -> dict:
        source = self.fs.open(self._at(f"manifests/{number:08d}.json"))
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def write(self, tables: dict[str, DataFrame], fmt: str = "parquet") -> int:
        """Write all tables, then commit; returns the export's number.  A
        failure leaves the export in force as it is, and its own run unread;
        writing again is a new run."""
        run = uuid.uuid4().hex
        for name, df in tables.items():
            w = df.write.format(fmt)
            (w.option("header", "true") if fmt == "csv" else w).save(f"{self.path}/runs/{run}/{name}")
        staged = self._at(f"manifests/.staged-{run}")
        out = self.fs.create(staged)
        out.write(bytearray(json.dumps({"run": run, "format": fmt, "tables": {n: df.schema.jsonValue() for n, df in tables.items()}}).encode()))
        out.close()
        number = (self._numbers() or [0])[-1] + 1
        # A rename does not replace a file: whoever comes second takes the next number.
        while self.fs.exists(self._at(f"manifests/{number:08d}.json")) or not self.fs.rename(staged, self._at(f"manifests/{number:08d}.json")):
            number += 1
        return number

    def tables(self, number: int | None = None) -> dict[str, DataFrame]:
        """The tables of an export (the one in force)."""
        from pyspark.sql.types import StructType

        numbers = self._numbers()
        if not numbers:
            raise FileNotFoundError(f"no export in {self.path}")
        m = self._manifest(numbers[-1] if number is None else number)
        reader = self.spark.read.format(m["format"])
        if m["format"] == "csv":
            reader = reader.option("header", "true")
        return {n: reader.schema(StructType.fromJson(s)).load(f"{self.path}/runs/{m['run']}/{n}") for n, s in m["tables"].items()}

    def expire(self, keep: int = 1) -> None:
        """Remove the manifests before the last ``keep``, and every run that
        no manifest names.  Not for use while another export is written."""
        numbers = self._numbers()
        for n in numbers[:-keep]:
            self.fs.delete(self._at(f"manifests/{n:08d}.json"), False)
        live = {self._manifest(n)["run"] for n in numbers[-keep:]}
        if self.fs.exists(self._at("runs")):
            for s in self.fs.listStatus(self._at("runs")):
                if s.getPath().getName() not in live:
                    self.fs.delete(s.getPath(), True)


def export_report(spark: SparkSession, tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> int:
    """The six sheets of ``report.analyze`` as one export."""
    return Export(spark, path).write({k: tables[k] for k in RP.SHEETS}, fmt)
