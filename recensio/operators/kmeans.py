"""k-means of many companies at once, in whole numbers.

Vectors hold weights in whole millionths (``UNIT``), centres are rounded to
the same unit, so every product, sum and cost is an exact integer (below 2^53,
as floats hold them).  Nothing depends on the order in which rows are added
up: labels follow from the data and the parameters alone, whatever the layout,
the number of tasks or the company's size.

Seeding is k-means++ as a race: each review draws an exponential time from a
hash of its key, the start and the turn, divides it by its squared distance to
the nearest centre chosen so far, and the earliest one (ties: the earlier
review) is the next centre.  That picks reviews with probability in proportion
to the squared distance, and needs a minimum per company only.  Lloyd steps
assign each review to its nearest centre (ties: the lower number) and round the
means; a start is done when its centres stand still.  Of ``n_init`` starts the
one of least cost counts (ties: the lower number).

Two plans with the same kernel, hence the same result:

* a company of at most ``kmeans_rows`` reviews is one bounded group: all its
  starts run in one task, all companies in one job;
* a larger one is dealt into blocks of ``BLOCK`` vectors, written once.  A turn
  of the race, or a pass of steps, is one job for all such companies together:
  blocks meet their company's centres, a task sends one partial result per
  (company, start) and these are merged.  Starts that are done are left out.
  A pass takes more than one step where it can: besides the sums, blocks send
  the few vectors that lie nearest to a border between two centres.  While no
  centre has moved farther than the others' distance to a border allows, only
  those few can change sides, so the merge goes on by itself, exactly; then the
  next pass begins.  What is sent is bounded (``BORDER`` vectors per company and
  start), and nothing is sent while centres still move far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recensio.config import Config
from recensio.session import materialize, ship_package, stored

UNIT = 1_000_000
BLOCK = 2048
#: Centres (n_init x k x dim numbers a company) are broadcast up to so many
#: bytes in all; beyond, they are joined by shuffle.
BROADCAST = 64 << 20
#: About so many vectors of a company next to a border are sent in a pass.
BORDER = 2048
BORDER_BYTES = 32 << 20  # held by a task before it sends them
#: The race's arithmetic is modulo this prime; ROOT is a primitive root of it.
PRIME, ROOT = (1 << 31) - 1, 16807
TURNS = 1024  # turns of one start that have a multiplier of their own

LABELS = "company string, seq long, cluster int"
CENTRES = "company string, start int, topic int, dim int, vec binary"


# ---- kernel -----------------------------------------------------------------

def draw_of(company: Column, seq: Column) -> Column:
    """A review's own number below 2^31, from its key."""
    digits = F.substring(F.md5(F.concat_ws("/", company, seq.cast("string"))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(PRIME))


def multiplier(seed: int, start: int, turn: int) -> int:
    return pow(ROOT, 1 + TURNS * (seed + start) + turn, PRIME)


def race_times(draw: np.ndarray, seed: int, start: int, turn: int) -> np.ndarray:
    """Exponential times of unit rate."""
    a = multiplier(seed, start, turn)
    x = draw * a % PRIME
    x = (x * x + draw) % PRIME
    x = (x * a + 1) % PRIME
    return -np.log((x + 1) / (PRIME + 1.0))


def squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def distances(x: np.ndarray, centres: np.ndarray, xx: np.ndarray | None = None) -> np.ndarray:
    """Squared distances, exact; xx: the rows' squares, where known."""
    return (squares(x) if xx is None else xx)[:, None] - 2 * (x @ centres.T) + squares(centres)[None, :]


def earliest(x: np.ndarray, seq: np.ndarray, draw: np.ndarray, centres: np.ndarray, seed: int, start: int, xx: np.ndarray | None = None) -> tuple[float, int] | None:
    """(time, row) of the race's first arrival; None if every review lies on a
    centre."""
    time = race_times(draw, seed, start, len(centres))
    if len(centres):
        d = distances(x, centres, xx).min(axis=1)
        time = np.where(d > 0, time / np.where(d > 0, d, 1), np.inf)
    best = time.min(initial=np.inf)
    if not np.isfinite(best):
        return None
    tied = np.flatnonzero(time == best)
    return float(best), int(tied[seq[tied].argmin()])


def step(x: np.ndarray, centres: np.ndarray, xx: np.ndarray | None = None) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """(labels, cost, members of each centre, their sums)."""
    d = distances(x, centres, xx)
    label = d.argmin(axis=1)
    return label, int(d[np.arange(len(x)), label].sum()), *sums_by(x, label, len(centres))


def sums_by(x: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(members of each centre, their sums)."""
    of = (label[None, :] == np.arange(k)[:, None]).astype(np.float64)
    return np.bincount(label, minlength=k), (of @ x).astype(np.int64)


def margins(d: np.ndarray) -> np.ndarray:
    """How much farther than its nearest centre the next one is, per row of
    squared distances."""
    if d.shape[1] < 2:
        return np.full(len(d), np.inf)
    two = np.sqrt(np.maximum(np.partition(d, 1, axis=1)[:, :2], 0))
    return two[:, 1] - two[:, 0]


def farthest(old: np.ndarray, new: np.ndarray) -> float:
    """The longest way of a centre."""
    return float(np.sqrt(squares(new - old).max(initial=0)))


def means(centres: np.ndarray, n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Rounded means; a centre without members stays."""
    return np.where(n[:, None] > 0, (2 * sums + n[:, None]) // np.maximum(2 * n[:, None], 1), centres.astype(np.int64)).astype(np.float64)


def cluster(x: np.ndarray, seq: np.ndarray, draw: np.ndarray, k: int, cfg: Config) -> tuple[np.ndarray, np.ndarray]:
    """(centres, labels) of one company."""
    best, xx = None, squares(x)
    for start in range(cfg.n_init):
        centres = np.zeros((0, x.shape[1]))
        while len(centres) < k and (got := earliest(x, seq, draw, centres, cfg.kmeans_seed, start, xx)):
            centres = np.vstack([centres, x[got[1]]])
        cost = 0
        for _ in range(cfg.kmeans_max_iter):
            _, cost, n, sums = step(x, centres, xx)
            new = means(centres, n, sums)
            same = (new == centres).all()
            centres = new
            if same:
                break
        if best is None or cost < best[0]:
            best = cost, centres
    return best[1], distances(x, best[1], xx).argmin(axis=1)


def dense(ptr: np.ndarray, idx: np.ndarray, val: np.ndarray, dim: int) -> np.ndarray:
    x = np.zeros((len(ptr) - 1, dim))
    x[np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), idx] = val
    return x


def _lists(col) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, values) of a list column."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    off = a.offsets.to_numpy()
    return off - off[0], a.values.to_numpy()[off[0]:off[-1]]


# ---- small companies: one group each ------------------------------------------

def _whole(vectors: DataFrame, cfg: Config) -> DataFrame:
    """(company, seq, cluster, vec): label rows, and a row without seq per
    centre."""
    def run(t: pa.Table) -> pa.Table:
        ptr, idx = _lists(t["idx"])
        dim, seq = t["dim"][0].as_py(), t["seq"].to_numpy()
        x = dense(ptr, idx, _lists(t["val"])[1], dim)
        centres, label = cluster(x, seq, t["draw"].to_numpy(), t["k"][0].as_py(), cfg)
        m, company = len(centres), t["company"][0].as_py()
        return pa.table({
            "company": pa.array([company] * (len(seq) + m), pa.string()),
            "seq": pa.concat_arrays([pa.array(seq, pa.int64()), pa.nulls(m, pa.int64())]),
            "cluster": pa.array(np.concatenate([label, np.arange(m)]).astype(np.int32)),
            "dim": pa.array(np.full(len(seq) + m, dim, np.int32)),
            "vec": pa.concat_arrays([pa.nulls(len(seq), pa.binary()), pa.array([c.astype("<i8").tobytes() for c in centres], pa.binary())]),
        })

    cols = ("company", "seq", "dim", "k", "draw", "idx", "val")
    # So many tasks: companies take long, whatever the bytes they hold.
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return vectors.select(*cols).repartition(tasks, "company").groupBy("company").applyInArrow(run, "company string, seq long, cluster int, dim int, vec binary")


# ---- large companies: blocks and rounds ----------------------------------------

class Blocks:
    """The vectors of large companies in blocks, written once."""

    def __init__(self, vectors: DataFrame, size: int = BLOCK):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, list] = {}

            def out(company):
                rows = held.pop(company)
                n, dim, k = rows[0][:3]
                ptr = np.concatenate([[0], np.cumsum([len(r[5]) for r in rows])])
                cells = [np.array([r[3] for r in rows], "<i8"), np.array([r[4] for r in rows], "<i8"), ptr.astype("<i4"),
                         np.concatenate([np.asarray(r[5], "<i4") for r in rows]), np.concatenate([np.asarray(r[6], "<i4") for r in rows])]
                return pa.RecordBatch.from_arrays([pa.array([company]), pa.array([n], pa.int64()), pa.array([dim], pa.int32()), pa.array([k], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]],
                                                  ["company", "n", "dim", "k", "seqs", "draws", "ptr", "idx", "val"])

            for b in batches:
                for company, *row in zip(*(c.to_pylist() for c in b.columns)):
                    rows = held.setdefault(company, [])
                    rows.append(row)
                    if len(rows) >= size:
                        yield out(company)
            for company in sorted(held):
                yield out(company)

        part = F.pmod(F.xxhash64("seq"), F.ceil(F.col("n") / size))
        # Passes over few bytes take long: a number of tasks of their own.
        tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = vectors.withColumn("part", part).repartition(tasks, "company", "part").select("company", "n", "dim", "k", "seq", "draw", "idx", "val")
        self.rows = stored(dealt.mapInArrow(pack, "company string, n long, dim int, k int, seqs binary, draws binary, ptr binary, idx binary, val binary"))
        sizes = self.rows.groupBy("company").agg(F.max("dim").alias("dim"), F.max("k").alias("k")).agg(
            F.count("*").alias("n"), F.max("k").alias("k"), F.sum(F.col("k").cast("long") * F.col("dim")).alias("cells")).first()
        self.companies, self.k, self.cells = sizes.n, sizes.k or 0, sizes.cells or 0

    def meet(self, centres: DataFrame, starts: int, how: str = "inner") -> DataFrame:
        """Each block with its company's centres(company, start, topic, vec)
        and, where there are, the steps they took and the way of the last."""
        cols = [c for c in ("start", "topic", "vec", "steps", "way") if c in centres.columns]
        per = centres.groupBy("company").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("c"))
        small = self.cells * 8 * starts <= BROADCAST
        return self.rows.join(F.broadcast(per) if small else per, "company", how)


def _opened(b: pa.RecordBatch, r: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    get = lambda c, kind="<i4": np.frombuffer(b.column(c)[r].as_py(), kind)
    x = dense(get("ptr"), get("idx"), get("val"), b.column("dim")[r].as_py())
    starts: dict[int, list[np.ndarray]] = {}
    for c in b.column("c")[r].as_py() or []:
        starts.setdefault(c["start"], []).append(np.frombuffer(c["vec"], "<i8").astype(np.float64))
    return b.column("company")[r].as_py(), get("seqs", "<i8"), get("draws", "<i8"), x, {s: np.stack(v) for s, v in starts.items()}


def seeds(blocks: Blocks, cfg: Config) -> DataFrame:
    """(company, start, topic, dim, vec, seq): the starting centres, in turn."""
    spark = blocks.rows.sparkSession
    found = spark.createDataFrame([], CENTRES + ", seq long")

    def run(batches, turn):
        for b in batches:
            for r in range(b.num_rows):
                company, seq, draw, x, starts = _opened(b, r)
                rows, xx = [], squares(x)
                for s in range(cfg.n_init):
                    centres = starts.get(s, np.zeros((0, x.shape[1])))
                    got = earliest(x, seq, draw, centres, cfg.kmeans_seed, s, xx) if len(centres) == turn else None
                    if got:
                        rows.append((company, s, x.shape[1], got[0], int(seq[got[1]]), x[got[1]].astype("<i8").tobytes()))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in rows], k) for i, k in enumerate(kinds)], ["company", "start", "dim", "time", "seq", "vec"])

    for turn in range(blocks.k):
        met = blocks.meet(found, cfg.n_init, "left").where(F.col("k") > turn)
        arrivals = met.mapInArrow(lambda it, turn=turn: run(it, turn), "company string, start int, dim int, time double, seq long, vec binary")
        first = arrivals.groupBy("company", "start", "dim").agg(F.min(F.struct("time", "seq", "vec")).alias("f"))
        found = materialize(found.unionByName(first.select("company", "start", F.lit(turn).alias("topic"), "dim", "f.vec", "f.seq")))
    return found


def lloyd(blocks: Blocks, centres: DataFrame, starts: int, max_iter: int) -> DataFrame:
    """(company, start, topic, dim, vec, cost, moved) after at most
    ``max_iter`` steps from the given centres; cost is that of the last step."""
    spark = blocks.rows.sparkSession
    state = CENTRES + ", cost long, moved boolean, steps int, way double"
    names = ("company", "start", "dim", "steps", "way", "safe", "cost", "xx", "n", "sums", "old", "border")
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
    part = "company string, start int, dim int, steps int, way double, safe double, cost long, xx long, n binary, sums binary, old binary, border binary"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}

        def out():
            rows = [(c, s, p["old"].shape[1], p["steps"], p["way"], p["safe"], p["cost"], p["xx"], p["n"].astype("<i8").tobytes(), p["sums"].astype("<i8").tobytes(),
                     p["old"].astype("<i8").tobytes(), b"".join(a.tobytes() for a in p["border"])) for (c, s), p in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v[i] for v in rows], k) for i, k in enumerate(kinds)], list(names))

        for b in batches:
            for r in range(b.num_rows):
                company, _, _, x, by_start = _opened(b, r)
                n, xx = b.column("n")[r].as_py(), squares(x)
                more = {c["start"]: (c["steps"], c["way"]) for c in b.column("c")[r].as_py() or []}
                room = min(len(x) // 4, 2 * BORDER * len(x) // n + 1)
                for s, c in by_start.items():
                    d = distances(x, c, xx)
                    label = d.argmin(axis=1)
                    members, sums = sums_by(x, label, len(c))
                    steps, way = more[s]
                    safe, near = _border(margins(d), room, way) if np.isfinite(way) else (0.0, [])
                    p = held.setdefault((company, s), {"old": c, "steps": steps, "way": way, "safe": np.inf, "cost": 0, "xx": 0, "n": 0, "sums": 0, "border": []})
                    p["cost"] += int(d[np.arange(len(x)), label].sum())
                    p["xx"] += int(xx.sum())
                    p["n"] = p["n"] + members
                    p["sums"] = p["sums"] + sums
                    p["safe"] = min(p["safe"], safe)
                    p["border"] = [*p["border"], x[near].astype("<i4")] if p["safe"] > 0 else []
                if len(held) >= 1024 or sum(a.nbytes for p in held.values() for a in p["border"]) > BORDER_BYTES:
                    yield out()
        if held:
            yield out()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def out():
            c, steps, moved, cost, way = _advance(*held, max_iter)
            m, dim = c.shape
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * m, pa.string()), pa.array([key[1]] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array([dim] * m, pa.int32()),
                 pa.array([v.astype("<i8").tobytes() for v in c], pa.binary()), pa.array([cost] * m, pa.int64()), pa.array([moved] * m),
                 pa.array([steps] * m, pa.int32()), pa.array([way] * m, pa.float64())],
                ["company", "start", "topic", "dim", "vec", "cost", "moved", "steps", "way"])

        for b in batches:  # sorted by company and start
            for company, s, dim, steps, _, safe, cost, xx, *cells in zip(*(c.to_pylist() for c in b.columns)):
                n, sums, old = (np.frombuffer(c, "<i8") for c in cells[:3])
                near = np.frombuffer(cells[3], "<i4").reshape(-1, dim) if safe > 0 else None
                if (company, s) != key:
                    if key is not None:
                        yield out()
                    key, held = (company, s), [old.reshape(-1, dim).astype(np.float64), n, sums.reshape(-1, dim), cost, xx, steps, safe, [near]]
                else:
                    held[1], held[2], held[3], held[4], held[6] = held[1] + n, held[2] + sums.reshape(-1, dim), held[3] + cost, held[4] + xx, min(held[6], safe)
                    held[7] = [*held[7], near] if held[6] > 0 else []
        if key is not None:
            yield out()

    now = centres.select("company", "start", "topic", "dim", "vec", F.lit(0).cast("long").alias("cost"), F.lit(True).alias("moved"),
                         F.lit(0).alias("steps"), F.lit(float("inf")).alias("way"))
    done, schema = spark.createDataFrame([], state), CENTRES + ", cost long, moved boolean"
    while max_iter > 0:
        sums = blocks.meet(now, starts).mapInArrow(partial, part)
        new = materialize(sums.repartition("company", "start").sortWithinPartitions("company", "start").mapInArrow(merged, state))
        # Starts that are done wait in the tables of their passes.
        going = F.col("moved") & (F.col("steps") < max_iter)
        done, now = done.unionByName(new.where(~going)), new.where(going)
        if now.isEmpty():
            return materialize(done.select(*schema_names(schema)))
    return now.select(*schema_names(schema))


def schema_names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _border(margin: np.ndarray, room: int, way: float) -> tuple[float, np.ndarray]:
    """(how far centres may move, the rows that may change sides by then): at
    most ``room`` rows, those nearest to a border.  (0, none) where that would
    not last for a step as long as the one before (``way``)."""
    want = 16 * way + 1
    near = margin <= 2 * want + 2
    if near.sum() > room:
        limit = np.partition(margin, room)[room] if room < len(margin) else np.inf
        near = margin < limit
        want = (limit - 2) / 2
        if want < way:
            return 0.0, np.zeros(0, int)
    return max(want, 0.0), np.flatnonzero(near)


def _advance(c: np.ndarray, n: np.ndarray, sums: np.ndarray, cost: int, xx: int, steps: int, safe: float, near: list, max_iter: int):
    """(centres, steps, moved, cost of the last step, its longest way): the
    step that n, sums and cost are of, then more of them while no centre is
    farther than ``safe`` from where it was: until then only the rows ``near``
    can change sides."""
    old, new = c, means(c, n, sums)
    steps, way = steps + 1, farthest(c, new)
    if safe > 0:
        x = np.concatenate(near).astype(np.float64)
        sq = squares(x)
        n_near, sums_near = sums_by(x, distances(x, old, sq).argmin(axis=1), len(old)) if len(x) else (0, 0)
        n_far, sums_far = n - n_near, sums - sums_near
        while way > 0 and steps < max_iter and farthest(old, new) <= safe:
            c = new
            n, sums = sums_by(x, distances(x, c, sq).argmin(axis=1), len(c)) if len(x) else (0, 0)
            n, sums = n_far + n, sums_far + sums
            cost = xx + sum(int(n[t]) * int(v @ v) - 2 * int(v @ sums[t]) for t, v in enumerate(c.astype(np.int64)))
            new = means(c, n, sums)
            steps, way = steps + 1, farthest(c, new)
    return new, steps, way > 0, cost, way


def nearest(blocks: Blocks, centres: DataFrame) -> DataFrame:
    """(company, seq, cluster) for one start's centres."""
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                company, seq, _, x, starts = _opened(b, r)
                (c,) = starts.values()
                label = distances(x, c).argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([company] * len(seq), pa.string()), pa.array(seq), pa.array(label)], ["company", "seq", "cluster"])

    return blocks.meet(centres, 1).mapInArrow(run, LABELS)


def _by_rounds(vectors: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    blocks = Blocks(vectors)
    done = lloyd(blocks, seeds(blocks, cfg), cfg.n_init, cfg.kmeans_max_iter)
    best = done.groupBy("company").agg(F.min(F.struct("cost", "start")).alias("b")).select("company", F.col("b.start").alias("start"))
    centres = materialize(done.join(best, ["company", "start"]).select("company", "start", "topic", "dim", "vec"))
    return nearest(blocks, centres), centres


def packed_centres(vectors: DataFrame) -> DataFrame:
    """Rows of vectors(company, topic, dim, idx, val) as centres of start 0."""
    def run(batches):
        for b in batches:
            vec = [dense(np.array([0, len(i)]), np.array(i, int), np.array(v), d)[0].astype("<i8").tobytes()
                   for d, i, v in zip(*(b.column(c).to_pylist() for c in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([0] * b.num_rows, pa.int32()), b.column(1).cast(pa.int32()), b.column(2), pa.array(vec, pa.binary())],
                                             ["company", "start", "topic", "dim", "vec"])

    return vectors.select("company", "topic", "dim", "idx", "val").mapInArrow(run, CENTRES)


def centre_weights(centres: DataFrame) -> DataFrame:
    """(company, cluster, weights array<double>) from packed centres."""
    def run(batches):
        for b in batches:
            w = [np.frombuffer(v, "<i8") / UNIT for v in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tolist() for x in w], pa.list_(pa.float64()))], ["company", "cluster", "weights"])

    return centres.select("company", "cluster", "vec").mapInArrow(run, "company string, cluster int, weights array<double>")


def kmeans(vectors: DataFrame, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Labels (company, seq, cluster) and centres (company, cluster, weights)
    of ``vectors(company, seq, n, dim, k, draw, idx, val)``: n is the company's
    number of reviews, idx and val the non-zero places and whole weights."""
    ship_package(vectors.sparkSession)
    whole = materialize(_whole(vectors.where(F.col("n") <= cfg.kmeans_rows), cfg))
    labels = whole.where("seq is not null").select("company", "seq", "cluster")
    centres = whole.where("seq is null").select("company", "cluster", "vec")
    large = vectors.where(F.col("n") > cfg.kmeans_rows)
    if not large.isEmpty():
        more, c = _by_rounds(large, cfg)
        labels = labels.unionByName(more)
        centres = centres.unionByName(c.select("company", F.col("topic").alias("cluster"), "vec"))
    return labels, centre_weights(centres)
