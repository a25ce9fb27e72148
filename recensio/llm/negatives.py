"""Hard-negative mining over anchor-clustered shared lists (MAXIMUS style).

Anchors are clustered by direction.  For a cluster with centre c and angular
radius r, no member a has an inner product with a candidate x above
|a| * |x| * cos(max(0, angle(x, c) - r)); the part without |a| is the
candidate's bound in that cluster.  Each cluster's candidates are sorted by it
once, and every member walks this one list from the top until what it has found
is certain: the bound of what follows lies under its last wanted score.  The
list is walked twice, for the positives (first rows of the anchor's label) and
then, within the score windows these give, for the negatives.

On Spark the lists are range-partitioned by (cluster, bound), packed into
blocks of at most ``LIST`` rows and written once.  A walk goes in rounds over
segments of growing length; a round joins the members still open, in blocks of
at most ``MEMBERS``, with the segment's blocks, dealt so that no task holds more
than one member block and some list blocks at a time; then members whose
results are certain leave.  The round's finds are merged by rank with those
before.  A block that is under a member's bar at the start of the round is not
multiplied for it.

Components are integers, so products are exact: in float32 or float64 where
the sums fit their mantissa, else in Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, prepare, table

SCALE = 256.0
POSITIVES, NEGATIVES = 5, 3
#: Anchors that the centres are fitted on, at most (chosen by a hash).
SAMPLE = 4096
LIST, MEMBERS = 2048, 512
#: Blocks of a list's first segment, and how much longer each next one is.
FIRST, GROWTH = 4, 4
#: List blocks that one task takes against one member block.
RUN = 32
#: Dimensions without a sampled anchor share so many lists (bound: the norm).
OTHER = 16
NONE = -(1 << 63)
#: Slack on cosines and on products of bounds, above all rounding.
COS_SLACK, SLACK = 1e-6, 1e-9


def usable(df: DataFrame) -> DataFrame:
    """(id, label, vec) rows that take part, each different row once."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vec").cast("array<double>").alias("vec"))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", bad)).distinct()


def integers(cell) -> np.ndarray:
    return np.floor(SCALE * np.asarray(cell, np.float64))


def packed(v: np.ndarray) -> bytes:
    return v.astype("<i2" if not len(v) or np.abs(v).max() < 1 << 15 else "<f8").tobytes()


def matrix(cells: list[bytes], dim: int) -> np.ndarray:
    """Vectors packed one by one, as rows."""
    return np.array([np.frombuffer(c, "<i2" if len(c) == 2 * dim else "<f8") for c in cells], np.float64).reshape(len(cells), dim)


def opened(cell: bytes, dim: int) -> np.ndarray:
    """A block of vectors, packed as one."""
    kind, body = ("<i2", cell[1:]) if cell[:1] == b"i" else ("<f8", cell[1:])
    return np.frombuffer(body, kind).reshape(-1, dim) if dim else np.zeros((0, 0))


def block_of(cells: list[bytes], dim: int) -> bytes:
    """Vectors packed one by one, as one block."""
    if all(len(c) == 2 * dim for c in cells):
        return b"i" + b"".join(cells)
    return b"f" + matrix(cells, dim).astype("<f8").tobytes()


def products(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Exact inner products as 64-bit integers, and which of them fit (None: all)."""
    most = q.shape[1] * float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0))
    if most < 1 << 24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64), None
    if most < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64), None
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    s = whole(q) @ whole(c).T
    fits = np.array(abs(s) < 1 << 62, bool).reshape(s.shape)
    return np.where(fits, s, 0).astype(np.int64), fits


def window(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest negative score for a positive's (both included):
    50 p <= 100 n <= 95 p.  Below zero there is none."""
    return np.where(positive >= 0, (positive + 1) // 2, 0), np.where(positive >= 0, positive - (positive + 19) // 20, -1)


# ---- clusters ---------------------------------------------------------------

def fit_centres(anchors: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Unit centres by dimension, from at most ``sample`` anchors: spherical
    k-means, about a quarter of the sample's square root of them."""
    rows = anchors.select(F.xxhash64("id", "vec").alias("h"), "id", "vec").orderBy("h", "id").limit(sample).collect()
    by: dict[int, list[np.ndarray]] = {}
    for r in rows:
        v = integers(r.vec)
        if len(v) and (n := np.linalg.norm(v)) > 0:
            by.setdefault(len(v), []).append(v / n)
    out = {}
    for dim, vs in sorted(by.items())[:SAMPLE]:
        x = np.array(vs)
        c = x[: max(1, round(len(x) ** 0.5 / 4))].copy()
        for _ in range(8):
            near = (x @ c.T).argmax(axis=1)
            for k in range(len(c)):
                m = x[near == k].sum(axis=0)
                if (n := np.linalg.norm(m)) > 0:
                    c[k] = m / n
        out[dim] = c
    return out


class Clusters:
    """Centres of all dimensions with running numbers; negative numbers are
    the lists of dimensions without a centre."""

    def __init__(self, centres: dict[int, np.ndarray]):
        self.centres, self.first, n = centres, {}, 0
        for dim in sorted(centres):
            self.first[dim], n = n, n + len(centres[dim])

    def home(self, v: np.ndarray) -> tuple[int, float]:
        """(cluster, cosine with its centre) of one vector."""
        c = self.centres.get(len(v))
        if c is None:
            return -1 - len(v) % OTHER, -1.0
        n = np.linalg.norm(v)
        cos = c @ v / n if n > 0 else np.ones(len(c))
        return self.first[len(v)] + int(cos.argmax()), float(cos.max())

    def bounds(self, v: np.ndarray, radius: dict[int, float]) -> Iterator[tuple[int, float]]:
        """(cluster, bound) of one candidate in each list it belongs to.
        radius: least cosine of a member with its centre, by cluster."""
        n, c = float(np.linalg.norm(v)), self.centres.get(len(v))
        if c is None:
            yield -1 - len(v) % OTHER, n
            return
        for k, cos in enumerate((c @ v / n).tolist() if n > 0 else [1.0] * len(c)):
            r = radius.get(self.first[len(v)] + k)
            if r is not None:
                # cos(a - b), or 1 where the candidate lies within the radius
                near = 1.0 if cos >= r else cos * r + (max(0.0, 1 - cos * cos) * max(0.0, 1 - r * r)) ** 0.5
                yield self.first[len(v)] + k, n * (min(near, 1.0) + COS_SLACK)


def members_of(anchors: DataFrame, clusters: Clusters) -> DataFrame:
    """(anchor row, id, label, cl, cos, dim, norm, vec) of anchors(row, id, label, vec)."""
    def run(batches):
        for b in batches:
            vs = [integers(v) for v in b.column(3).to_pylist()]
            home = [clusters.home(v) for v in vs]
            cells = [pa.array([h[0] for h in home], pa.int32()), pa.array([h[1] for h in home], pa.float64()), pa.array([len(v) for v in vs], pa.int32()),
                     pa.array([float(np.linalg.norm(v)) for v in vs], pa.float64()), pa.array([packed(v) for v in vs], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cells], ["row", "id", "label", "cl", "cos", "dim", "norm", "vec"])

    return anchors.select("row", "id", "label", "vec").mapInArrow(run, "row long, id long, label long, cl int, cos double, dim int, norm double, vec binary")


def sorted_lists(candidates: DataFrame, clusters: Clusters, radius: dict[int, float], size: int) -> DataFrame:
    """Each cluster's candidates by falling bound, in blocks whose number b
    rises along every list: (b, cl, dim, hi, ids, labels, vecs)."""
    def bound(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                out = [(cl, -x, i, lab, len(v), packed(v)) for i, lab, cell in zip(*(part.column(c).to_pylist() for c in range(3))) for v in [integers(cell)] for cl, x in clusters.bounds(v, radius)]
                kinds = (pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], ["cl", "under", "id", "label", "dim", "vec"])

    def pack(batches):
        held: dict[tuple[int, int], list] = {}

        def out(key):
            rows = held.pop(key)
            cells = [key[0], key[1], -rows[0][0], np.array([r[1] for r in rows], "<i8").tobytes(), np.array([r[2] for r in rows], "<i8").tobytes(), block_of([r[3] for r in rows], key[1])]
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], ["cl", "dim", "hi", "ids", "labels", "vecs"])

        last = None
        for b in batches:
            for cl, under, i, lab, dim, vec in zip(*(c.to_pylist() for c in b.columns)):
                if cl != last:
                    for key in sorted(held):
                        yield out(key)
                    last = cl
                rows = held.setdefault((cl, dim), [])
                rows.append((under, i, lab, vec))
                if len(rows) >= size:
                    yield out((cl, dim))
        for key in sorted(held):
            yield out(key)

    rows = candidates.select("id", "label", "vec").mapInArrow(bound, "cl int, under double, id long, label long, dim int, vec binary")
    dealt = rows.repartitionByRange("cl", "under", "id").sortWithinPartitions("cl", "under", "id")
    return cut(dealt.mapInArrow(pack, "cl int, dim int, hi double, ids binary, labels binary, vecs binary").withColumn("b", F.monotonically_increasing_id()))


# ---- the walk ---------------------------------------------------------------

def first_of_each(who: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first rows of each ``who``: score falling, id rising."""
    order = np.lexsort((ids, -score, who))
    w = who[order]
    start = np.searchsorted(w, w, "left")
    return order[np.arange(len(w)) - start < k]


def walk_tiles(batches: Iterator[pa.RecordBatch], k: int, same: bool, slots: int) -> Iterator[pa.RecordBatch]:
    """(row, slot, score, id): what each tile's members find in its block."""
    for b in batches:
        for r in range(b.num_rows):
            get = lambda c, kind="<i8": np.frombuffer(b.column(c)[r].as_py(), kind)
            dim, hi = b.column("dim")[r].as_py(), b.column("hi")[r].as_py()
            row, qid, qlab, norm = get("rows"), get("qids"), get("qlabels"), get("norms", "<f8")
            bars, pos, ids, labels = get("bars").reshape(-1, slots), get("pos").reshape(-1, slots), get("ids"), get("labels")
            top = norm * hi * (1 + SLACK) + SLACK
            lo, most = window(pos) if not same else (np.full(pos.shape, NONE), np.full(pos.shape, -(NONE + 1)))
            wanted = (top[:, None] >= np.maximum(bars, lo)) & (lo <= most)
            alive = np.flatnonzero(wanted.any(axis=1))
            if not len(alive):
                continue
            q, c = opened(b.column("qvecs")[r].as_py(), dim), opened(b.column("vecs")[r].as_py(), dim)
            s, fits = products(q[alive], c) if dim else (np.zeros((len(alive), len(ids)), np.int64), None)
            met = (qlab[alive, None] == labels[None, :]) == same
            met &= qid[alive, None] != ids[None, :]
            if fits is not None:
                met &= fits
            out = []
            for slot in range(slots):
                low = np.maximum(bars[alive, slot], lo[alive, slot])[:, None]
                i, j = np.nonzero(met & (s >= low) & (s <= most[alive, slot][:, None]) & wanted[alive, slot][:, None])
                got = s[i, j]
                keep = first_of_each(i, got, ids[j], k)
                out.append((row[alive][i[keep]], np.full(len(keep), slot, np.int32), got[keep], ids[j[keep]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["row", "slot", "score", "id"])


def member_blocks(members: DataFrame, slices: dict[int, int], slots: int) -> DataFrame:
    """Members in blocks of one cluster, dimension and slice."""
    size = MEMBERS

    def pack(batches):
        held: dict[tuple[int, int, int], list] = {}

        def out(key):
            rows = held.pop(key)
            cells = [np.array([r[c] for r in rows], kind).tobytes() for c, kind in ((0, "<i8"), (1, "<i8"), (2, "<i8"), (3, "<f8"), (4, "<i8"), (5, "<i8"))]
            return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in key], *[pa.array([c], pa.binary()) for c in (*cells, block_of([r[6] for r in rows], key[1]))]],
                                              ["cl", "dim", "slice", "rows", "qids", "qlabels", "norms", "bars", "pos", "qvecs"])

        for b in batches:
            for cl, dim, part, *rest in zip(*(c.to_pylist() for c in b.columns)):
                rows = held.setdefault((cl, dim, part), [])
                rows.append(rest)
                if len(rows) >= size:
                    yield out((cl, dim, part))
        for key in sorted(held):
            yield out(key)

    dealt = members.withColumn("slice", F.pmod(F.xxhash64("row"), of_cluster(slices)).cast("int")).repartition("cl", "dim", "slice")
    return dealt.select("cl", "dim", "slice", "row", "id", "label", "norm", "bars", "pos", "vec").mapInArrow(
        pack, "cl int, dim int, slice int, rows binary, qids binary, qlabels binary, norms binary, bars binary, pos binary, qvecs binary")


def of_cluster(values: dict, default=1, kind: str = "long"):
    """A column of a value per cluster (a bounded number of them)."""
    out = F.lit(default).cast(kind)
    for cl, v in values.items():
        out = F.when(F.col("cl") == cl, F.lit(v).cast(kind)).otherwise(out)
    return out


class Segments:
    """Where the rounds cut each list: (first block, end, top bound, blocks)
    by round and cluster; a bounded number of entries."""

    def __init__(self, lists: DataFrame):
        first, growth = FIRST, GROWTH
        nth = F.row_number().over(Window.partitionBy("cl").orderBy("b")) - 1
        ends = [first * (growth ** (s + 1) - 1) // (growth - 1) for s in range(30)]
        seg = F.coalesce(*[F.when(F.col("nth") < e, s) for s, e in enumerate(ends)])
        rows = lists.select("cl", "b", "hi").withColumn("nth", nth).withColumn("seg", seg).groupBy("cl", "seg").agg(
            F.min("b").alias("b0"), F.max("b").alias("b1"), F.max("hi").alias("hi"), F.count("*").alias("n")).collect()
        self.rounds: dict[int, dict[int, tuple]] = {}
        for r in rows:
            self.rounds.setdefault(r.seg, {})[r.cl] = (r.b0, r.b1, r.hi, r.n)

    def of(self, s: int, part: int, default) -> dict[int, object]:
        return {cl: v[part] for cl, v in self.rounds.get(s, {}).items()} or {NONE: default}


def walk(members: DataFrame, lists: DataFrame, segments: Segments, slices: dict[int, int], k: int, same: bool, slots: int) -> DataFrame:
    """(row, slot, score, id): per member and slot the ``k`` first list rows of
    the same label, or of other labels within the slot's window."""
    spark = members.sparkSession
    found = spark.createDataFrame([], "row long, slot int, score long, id long")
    nobar = F.array_repeat(F.lit(NONE).cast("long"), slots)
    still = members.withColumn("bars", nobar)
    for s in sorted(segments.rounds):
        here = segments.rounds[s]
        runs = {cl: -(-v[3] // RUN) for cl, v in here.items()}
        inside = F.col("cl").isin(list(here)) & F.col("b").between(of_cluster(segments.of(s, 0, 0)), of_cluster(segments.of(s, 1, 0)))
        blocks = lists.where(inside).withColumn("run", F.pmod(F.col("b"), of_cluster(runs)).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), (of_cluster(slices) - 1).cast("int"))))
        asked = member_blocks(still, slices, slots).withColumn("run", F.explode(F.sequence(F.lit(0), (of_cluster(runs) - 1).cast("int"))))
        tiles = asked.hint("merge").join(blocks.drop("b"), ["cl", "dim", "slice", "run"])
        new = tiles.mapInArrow(lambda it: walk_tiles(it, k, same, slots), "row long, slot int, score long, id long")
        w = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "id")
        found = cut(found.unionByName(new).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).drop("nth"))
        if s + 1 not in segments.rounds:
            break
        bar = found.groupBy("row", "slot").agg(F.when(F.count("*") >= k, F.min("score")).alias("bar")).where("bar is not null")
        by_slot = bar.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "bar"))).alias("m"))
        bars = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(NONE).cast("long")))
        top = F.col("norm") * of_cluster(segments.of(s + 1, 2, 0.0), -1.0, "double") * (1 + SLACK) + SLACK
        still = members.join(by_slot, "row", "left").withColumn("bars", F.coalesce(bars, nobar)).drop("m")
        # open: a slot whose last score, or window, the rest of the list may reach
        least = lambda p: F.when(p >= 0, p - F.floor(p / 2)).otherwise(F.lit(float("inf")))
        low = (lambda i: F.get("bars", i).cast("double")) if same else (lambda i: F.greatest(F.get("bars", i).cast("double"), least(F.get("pos", i)).cast("double")))
        still = still.where(F.col("cl").isin(list(segments.rounds[s + 1])) & F.exists(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: top >= low(i)))
        if still.isEmpty():
            break
    return found


def hard_negatives(rows: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, sample: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) for the rows(id, label, vec) where ``is_anchor`` holds.

    Rows with a null id, label or vector, or any null or non-finite component
    take no part.  Rows equal in id, label and vector count once; rows that
    share an id only are different rows, but never each other's partners.
    Vectors of zeros (score 0) and of no components take part; only vectors
    of one length meet.  Scores of 2^62 and more are no longs and their pairs
    are left out.  Ties go to the smaller id.  An anchor without positives, or
    a positive without a negative in its window, has no row; empty tables give
    an empty result.
    """
    prepare(rows.sparkSession)
    live = usable(rows)
    anchors = cut(live.where(is_anchor).withColumn("row", F.monotonically_increasing_id()))
    # Of candidates equal in label and vector only the first few by id can be
    # among the first of any anchor (one more, as the anchor may be one).
    w = Window.partitionBy("label", "vec").orderBy("id")
    candidates = live.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= max(positives + 1, negatives)).drop("nth")
    clusters = Clusters(fit_centres(anchors, sample))
    members = cut(members_of(anchors, clusters).withColumn("pos", F.array(F.lit(-1).cast("long"))))
    sizes = members.groupBy("cl").agg(F.min("cos").alias("cos"), F.count("*").alias("n")).collect()  # a row per cluster
    lists = sorted_lists(candidates, clusters, {r.cl: max(-1.0, r.cos) for r in sizes if r.cl >= 0}, LIST)
    segments, slices = Segments(lists), {r.cl: -(-r.n // MEMBERS) for r in sizes}

    near = walk(members, lists, segments, slices, positives, True, 1)
    nth = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))
    near = cut(near.join(members.select("row", F.col("id").alias("anchor_id")), "row").select(
        "row", "anchor_id", (nth - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    slots = near.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "positive_score"))).alias("m"))
    pos = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(-1).cast("long")))
    seekers = cut(members.drop("pos").join(slots, "row").withColumn("pos", pos).drop("m"))
    far = walk(seekers, lists, segments, slices, negatives, False, positives)
    rank = F.row_number().over(Window.partitionBy("row", "slot").orderBy(F.desc("score"), "id"))
    return far.withColumn("rank", rank).join(near, ["row", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 50; edge cases
    as in ``hard_negatives``."""
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = e.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vec"))
    return hard_negatives(rows, F.col("id") % 50 == 0)


OP11_SQL = """
with e as (
  select distinct vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (
  select a.id as a, c.id as c, a.label = c.label as same,
         coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])), 0)::bigint as s
  from e a join e c on a.id % 50 = 0 and a.id <> c.id and len(a.v) = len(c.v)),
pos as (
  select a, c as positive_id, s as positive_score from (
    select *, row_number() over (partition by a order by s desc, c) as r from p where same) where r <= 5),
neg as (
  select pos.a, positive_id, positive_score, p.c, p.s,
         row_number() over (partition by pos.a, positive_id order by p.s desc, p.c) as rank
  from pos join p on p.a = pos.a and not p.same and 50 * positive_score <= 100 * p.s and 100 * p.s <= 95 * positive_score)
select a as anchor_id, positive_id, rank::int as rank, c as negative_id, positive_score, s as negative_score from neg where rank <= 3
"""
