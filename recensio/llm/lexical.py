"""Ranked lexical search: Block-Max MaxScore over a sharded inverted index.

Index.  Each task cuts its documents into shards of bounded size and writes one
row per shard: document lengths, and per term a list of postings in blocks of
``BLOCK``.  A block's bytes (document steps and frequencies in the narrowest
width that holds them) stand apart from its description: first and last
document, and the competitive (frequency, length) pairs, that is those that no
other posting of the block beats in both.  From these the block's largest
possible impact follows exactly, whatever the corpus statistics are, so one
pass over the texts gives both the index and the statistics (documents, terms,
document frequencies).  The index is written once.

Search.  A task walks its shards and holds one heap per item.  A list's bound
is its largest block bound times the term's weight.  Lists are ordered by
bound; the longest prefix whose bounds add up to less than the heap's lowest
score is not essential: a document met only there cannot enter.  Candidates
come from the essential lists; going down the others, a candidate whose score
so far, plus the maximum of the one block that could hold it, plus the bounds
of the lists below, is under the bar is rejected before that block is
decompressed.  The heaps of all tasks are merged by rank.

No document's text or posting is shuffled, and nothing is cut off: a rejected
document is one whose bound is *below* the bar, so ties are settled by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, prepare, small_batches, table

TOP, BLOCK = 50, 128
#: A shard is closed at so many documents (steps fit 16 bits) or terms.
SHARD_DOCS, SHARD_TERMS = 1 << 15, 1 << 21
#: Terms of the items up to which the index is built for these alone (some
#: 20 MB in each worker); beyond, the index holds every term of the corpus.
VOCABULARY = 200_000
#: Weighted item terms of one search pass: what a pass broadcasts.
BATCH_TERMS = 500_000

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: On UTF-8 bytes: letters and digits of ASCII and all other bytes belong to
#: terms, the rest separates them.
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b > 127 else 32 for b in range(256))

INDEX = ("n_docs long, n_terms long, terms array<string>, dfs array<int>, ids array<long>, lens binary, first_block binary, "
         "blk_first binary, blk_last binary, blk_at binary, blk_kind binary, blk_n binary, pair_at binary, pair_tf binary, pair_len binary, data binary")
_WIDTHS = ("<u1", "<u2", "<u4")


def terms_of(text: bytes) -> list[bytes]:
    """All terms of a UTF-8 text, in order, with repeats."""
    return text.translate(_FOLD).split()


def _width(top: np.ndarray) -> np.ndarray:
    return np.where(top < 1 << 8, 0, np.where(top < 1 << 16, 1, 2)).astype(np.uint8)


def build_shard(ids: list, lens: list[int], docs: np.ndarray, terms: np.ndarray, names: list[str]) -> list:
    """The cells of one shard's row from (document, term) occurrences."""
    n_docs, length = len(ids), np.array(lens, np.int64)
    key, tf = np.unique(terms.astype(np.int64) * n_docs + docs, return_counts=True)
    term, doc = key // n_docs, key % n_docs
    present, start, df = np.unique(term, return_index=True, return_counts=True)
    n_blocks = -(-df // BLOCK)
    first_block = np.concatenate(([0], np.cumsum(n_blocks)))
    within = np.arange(len(key)) - np.repeat(start, df)
    blk = np.repeat(first_block[:-1], df) + within // BLOCK
    at = np.flatnonzero(within % BLOCK == 0)
    end = np.append(at[1:], len(key))
    # the pairs that no other of the block beats: by length, frequency rising
    order = np.lexsort((-tf, length[doc], blk))
    lift = blk[order] * (int(tf.max(initial=0)) + 1) + tf[order]
    best = np.maximum.accumulate(lift)
    pairs = order[np.concatenate(([True], lift[1:] > best[:-1]))] if len(order) else order
    pair_at = np.searchsorted(blk[pairs], np.arange(len(at)))
    step = np.diff(doc, prepend=0)
    step[at] = 0
    many = len(at) > 0
    doc_w = _width(np.maximum.reduceat(step, at)) if many else np.zeros(0, np.uint8)
    tf_w = _width(np.maximum.reduceat(tf, at)) if many else np.zeros(0, np.uint8)
    parts = [step[a:b].astype(_WIDTHS[d]).tobytes() + tf[a:b].astype(_WIDTHS[t]).tobytes() for a, b, d, t in zip(at.tolist(), end.tolist(), doc_w.tolist(), tf_w.tolist())]
    where = np.concatenate(([0], np.cumsum([len(p) for p in parts])))[:-1] if parts else np.zeros(0)
    cell = lambda x, kind: np.ascontiguousarray(x, kind).tobytes()
    return [n_docs, int(length.sum()), [names[t] for t in present.tolist()], df.tolist(), ids, cell(length, "<i8"), cell(first_block, "<i4"),
            cell(doc[at], "<i4"), cell(doc[end - 1] if many else doc, "<i4"), cell(where, "<i8"), cell(doc_w * 4 + tf_w, "u1"), cell(end - at, "<i4"),
            cell(pair_at, "<i4"), cell(tf[pairs], "<i8"), cell(length[doc[pairs]], "<i8"), b"".join(parts)]


def inverted_index(docs: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Rows ``INDEX``: one per shard of ``docs(doc_id, text)``.  ``only``: the
    terms that get postings (None: all); lengths count every term."""
    spark = docs.sparkSession
    prepare(spark)
    sent = None if only is None else spark.sparkContext.broadcast([t.encode() for t in only])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], {"long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}[c.split()[1]]) for c in INDEX.split(", ")])

        def fresh():
            known = {t: i for i, t in enumerate(sent.value)} if sent else {}
            return known, [], [], [], []

        def closed():
            counts = np.array([len(x) for x in found], np.int64)
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            row = build_shard(ids, lens, np.repeat(np.arange(len(ids)), counts), flat, [t.decode() for t in known])
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        known, ids, lens, found, size = *fresh()[:4], 0
        for b in small_batches(batches):
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                words = terms_of(text)
                if not words:
                    continue  # neither counted nor found
                if sent:
                    got = [x for x in map(known.get, words) if x is not None]
                else:
                    got = [known.setdefault(w, len(known)) for w in words]
                ids.append(i)
                lens.append(len(words))
                found.append(np.array(got, np.int32))
                size += len(words)
                if len(ids) >= SHARD_DOCS or size >= SHARD_TERMS:
                    yield closed()
                    known, ids, lens, found, size = (known if sent else {}), [], [], [], 0
        if ids:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, INDEX)


class Shard:
    """One shard opened for search under given corpus statistics."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        get = lambda c, kind: np.frombuffer(row[c], kind)
        self.terms, self.data = row["terms"], row["data"]
        self.null = np.array([i is None for i in row["ids"]])
        self.ids = np.array([i or 0 for i in row["ids"]], np.int64)
        self.place = lambda length: 20 * (50 + (50 * length * n_docs) // n_terms)
        self.m = self.place(get("lens", "<i8"))
        self.first_block, self.first, self.last = get("first_block", "<i4"), get("blk_first", "<i4"), get("blk_last", "<i4")
        self.at, self.kind, self.n = get("blk_at", "<i8"), get("blk_kind", "u1"), get("blk_n", "<i4")
        tf, pair_at = get("pair_tf", "<i8"), get("pair_at", "<i4")
        self.block_max = np.maximum.reduceat(impact(tf, self.place(get("pair_len", "<i8"))), pair_at) if len(pair_at) else np.zeros(0, np.int64)
        self.list_max = np.maximum.reduceat(self.block_max, self.first_block[:-1]) if len(self.block_max) else self.block_max
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of one block, decompressed once."""
        got = self.opened.get(b)
        if got is None:
            n, at, (dw, tw) = int(self.n[b]), int(self.at[b]), divmod(int(self.kind[b]), 4)
            step = np.frombuffer(self.data, _WIDTHS[dw], n, at)
            tf = np.frombuffer(self.data, _WIDTHS[tw], n, at + (n << dw)).astype(np.int64)
            doc = np.cumsum(step, dtype=np.int64) + self.first[b]
            got = self.opened[b] = doc, impact(tf, self.m[doc])
        return got

    def whole(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        got = self.lists.get(t)
        if got is None:
            parts = [self.block(b) for b in range(self.first_block[t], self.first_block[t + 1])]
            got = self.lists[t] = tuple(np.concatenate([p[i] for p in parts]) for i in (0, 1)) if len(parts) > 1 else parts[0]
        return got


def impact(tf: np.ndarray, m20: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + m20)


def search_shard(s: Shard, lists: np.ndarray, weights: np.ndarray, bar: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the shard that may be among the ``k`` best, all
    that reach ``bar`` included."""
    none = np.zeros(0, np.int64)
    bound = weights * s.list_max[lists]
    order = np.argsort(bound, kind="stable")
    lists, weights = lists[order].tolist(), weights[order].tolist()
    under = np.cumsum(bound[order])
    essential = int(np.searchsorted(under, bar, "left"))  # those before add up to less than the bar
    if essential == len(lists):
        return none, none
    score = np.zeros(len(s.ids), np.int64)
    for t, w in zip(lists[essential:], weights[essential:]):
        doc, imp = s.whole(t)
        score[doc] += w * imp
    cand = np.flatnonzero(score)
    for j in range(essential - 1, -1, -1):
        so_far = score[cand]
        if len(cand) > k:
            bar = max(bar, int(np.partition(so_far, len(cand) - k)[len(cand) - k]))
        lo, hi = int(s.first_block[lists[j]]), int(s.first_block[lists[j] + 1])
        b = lo + np.searchsorted(s.last[lo:hi], cand)
        inside = b < hi
        inside[inside] = s.first[b[inside]] <= cand[inside]
        most = np.zeros(len(cand), np.int64)
        most[inside] = weights[j] * s.block_max[b[inside]]
        stay = so_far + most + (under[j - 1] if j else 0) >= bar
        cand, b = cand[stay], b[stay][inside[stay]]
        if len(b):
            parts = [s.block(x) for x in np.unique(b).tolist()]
            doc, imp = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            at = np.searchsorted(doc, cand)
            at[at == len(doc)] = 0
            hit = doc[at] == cand
            score[cand[hit]] += weights[j] * imp[at[hit]]
    got = score[cand]
    if len(cand) > k:
        bar = max(bar, int(np.partition(got, len(cand) - k)[len(cand) - k]))
    top = got >= max(bar, 1)
    return cand[top], got[top]


def best(score: np.ndarray, null: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best: score falling, then id rising, null ids last."""
    return np.lexsort((ids, null, -score))[:k]


def _search(batches: Iterator[pa.RecordBatch], items: list[tuple[int, list[str], list[int]]], n_docs: int, n_terms: int, k: int) -> Iterator[pa.RecordBatch]:
    number: dict[str, int] = {}
    asked = [(no, np.array([number.setdefault(t, len(number)) for t in ts], np.int64), np.array(ws, np.int64)) for no, ts, ws in items]
    heaps: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for b in batches:
        for r in range(b.num_rows):
            s = Shard({c: b.column(c)[r].as_py() for c in b.schema.names}, n_docs, n_terms)
            here = np.full(len(number), -1, np.int64)
            for place, t in enumerate(s.terms):
                if (x := number.get(t)) is not None:
                    here[x] = place
            for no, ts, ws in asked:
                lists = here[ts]
                some = lists >= 0
                if not some.any():
                    continue
                heap = heaps.get(no)
                bar = int(heap[0][-1]) if heap is not None and len(heap[0]) == k else 0
                doc, score = search_shard(s, lists[some], ws[some], bar, k)
                if len(doc):
                    new = score, s.null[doc], s.ids[doc]
                    if heap is not None:
                        new = tuple(np.concatenate(p) for p in zip(heap, new))
                    top = best(*new, k)
                    heaps[no] = tuple(x[top] for x in new)
    for no, (score, null, ids) in heaps.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), no)), pa.array(ids, mask=null), pa.array(score)], ["no", "doc_id", "score"])


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, batch_terms: int = BATCH_TERMS, vocabulary: int = VOCABULARY) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score
    above 0 of each row of ``items(item_id, text)``, among all rows of
    ``docs(doc_id, text)``; fewer if fewer share a term of weight with it.

    Null and empty texts hold no term: such documents are neither counted nor
    found, such items find nothing.  Every row counts, also those that share
    an id or a text; rows of one id tie by it.  Null ids are kept and come
    last among equal scores.  Empty tables give an empty result.  Other
    columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    folded = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    asked = cut(items.select("item_id", F.array_distinct(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))).alias("terms")).withColumn("no", F.monotonically_increasing_id()))
    words = asked.select(F.explode("terms").alias("term")).distinct()
    only = [r.term for r in words.limit(vocabulary + 1).collect()]
    index = cut(inverted_index(docs, sorted(only) if len(only) <= vocabulary else None))
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    found = spark.createDataFrame([], "no long, doc_id long, score long")
    if n_docs:
        df = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))
        weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("df") + 1)))
        weighed = asked.select("no", F.explode("terms").alias("term")).join(df, "term").select("no", "term", weight.alias("w")).where("w > 0")
        weighed = cut(weighed.groupBy("no").agg(F.collect_list(F.struct("term", "w")).alias("t")))
        passes = -(-(weighed.agg(F.sum(F.size("t"))).first()[0] or 0) // batch_terms)
        for p in range(passes):
            some = [(r.no, [t.term for t in r.t], [t.w for t in r.t]) for r in weighed.where(F.pmod(F.xxhash64("no"), F.lit(passes)) == p).collect()]
            sent = spark.sparkContext.broadcast(some)
            found = found.unionByName(index.mapInArrow(lambda it, sent=sent: _search(it, sent.value, n_docs, n_terms, k), "no long, doc_id long, score long"))
    w = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.select("no", F.row_number().over(w).alias("rank"), "doc_id", "score").where(F.col("rank") <= k)
    return ranked.join(asked.select("no", "item_id"), "no").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item; edge cases as in
    ``ranked_search``."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = f"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') as ts from documents),
l as (select r, doc_id, len(ts) as n from d where len(ts) > 0),
c as (select count(*)::bigint as docs, sum(n)::bigint as terms from l),
p as (select r, term, count(*)::bigint as tf from (select r, unnest(ts) as term from d) group by r, term),
f as (select term, count(*)::bigint as df from p group by term),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from f, c),
i as (select distinct r, item_id, term from (
  select r, item_id, unnest(ts) as term from (
    select row_number() over () as r, item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') as ts from benchmark))),
s as (
  select i.r, i.item_id, l.doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * l.n * c.docs) // c.terms))))::bigint as score
  from i join w on i.term = w.term join p on p.term = i.term join l on l.r = p.r, c
  group by i.r, i.item_id, l.r, l.doc_id),
o as (select item_id, row_number() over (partition by r order by score desc, doc_id nulls last) as rank, doc_id, score from s where score > 0)
select item_id, rank::int as rank, doc_id, score from o where rank <= 50
"""
