"""Near duplicates of embeddings by NN-descent.

Equal vectors are one representative before anything is compared. The
representatives' neighbour graph starts from blocks of vectors that lie side by
side in the order of random hyperplane codes, and is refined by joins of
neighbours of neighbours: every vector's neighbours, forward and reverse, meet
at it and are compared with each other. Both steps ship vectors of 16-bit
numbers, a quarter of the bytes; similarities so near the threshold that the
rounding could decide are computed again in double precision. Both are one kernel: rows sorted
by a key stream through a task, and runs of a key, cut into blocks of at most
BLOCK rows, are multiplied as matrices. A vector all of whose list lies above
the threshold is saturated; its list is enlarged, up to MAX_LIST, and the
refinement goes on while any vector gains links or room. Links are the list
entries at the threshold, and components follow from them. Full lists may hide
links from one dense component to another, so the vectors still saturated are
compared exactly across components: in cells of at most BLOCK, leaving out the
pairs of cells whose centres are too far apart for their radii.

Inside each component the links are then counted exactly: its vectors form cells
of at most BLOCK. Two cells so close that every pair of theirs is linked count by
their sizes, two too far apart not at all; only the others meet as vectors, and
their matrix product gives, for each vector, the number of linked ones. So a
clique of any size needs no pair rows, and no list bound limits n_links. An audit compares vectors with all others, drawn until
AUDIT_LINKED of them have links (or none is left): from those outside the large
components and from all. Each weighs the same, however many links or copies it
has. While the recall is below AUDIT_RECALL the descent runs again from other
and twice as many hyperplane codes and for more rounds; if three don't reach it,
all vectors are compared exactly.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterlens.llm.common import components, runs, shuffle_partitions
from raterlens.session import cut_lineage

THRESHOLD = 0.95
NEIGHBOURS = 8        # first length of the lists; saturated ones grow
GROWTH, MAX_LIST = 4, 128
PLANES = 20           # bits of a code, at least
TREES = 4             # codes of the first graph, at least
BLOCK = 256
ROUNDS = 6            # at most, but for vectors that still gain links
SETTLED = 0.002       # changed share of the entries at which unlinked vectors are settled
CELLS = 1024          # cells whose centres are compared at once
AUDIT_RECALL, AUDIT_TRIES = 0.99, 3
AUDIT_LINKED = 300    # linked vectors to audit, if there are so many
AUDIT_ENOUGH = 20     # of them show that a recall is far too low
AUDIT_BATCH = 4096    # vectors drawn at once
SEED = 5
SHORT = 32_767        # a component of 1 in a vector of 16-bit numbers

LOG = logging.getLogger(__name__)

CODES = "id bigint, keys array<bigint>, short binary"
_CAND = pa.schema([("u", pa.int64()), ("w", pa.int64()), ("sim", pa.float64())])


def _matrix(column) -> np.ndarray:
    """List column of vectors of one length, as float64 rows."""
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(),
                      dtype=np.float64).reshape(len(column), -1)


def _short_matrix(column) -> np.ndarray:
    """Column of vectors of 16-bit numbers, of one length, as float32 rows."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i2").reshape(len(column), -1).astype(np.float32) / np.float32(SHORT)


def rounding(size: int) -> float:
    """Most by which the cosine of two unit vectors of ``size`` components may
    change when they become 16-bit numbers and are multiplied as float32: each
    component moves by half a unit, and a sum of ``size`` products rounds."""
    moved = math.sqrt(size) * 0.5 / SHORT
    return 2 * moved + moved * moved + (size + 4) * 2.0 ** -23


def _compare(block: int):
    """Kernel of the first graph and of the joins. Columns: key, id, k (list
    length), floor (similarity of the last entry), fresh, short. Gives each
    member its best k others of the block that beat its floor; where no row of
    the run is fresh there is nothing new to compare."""

    def run(batches):
        out = [[], [], []]
        for t in runs(batches, block):
            n = t.num_rows
            fresh = t.column(4).to_numpy()
            if n < 2 or not fresh.any():
                continue
            ids = t.column(1).to_numpy()
            x = _short_matrix(t.column(5))
            sim = (x @ x.T).astype(np.float64)
            sim[ids[:, None] == ids[None, :]] = -2
            sim[~(fresh[:, None] | fresh[None, :])] = -2
            ks, floors = t.column(2).to_numpy(), t.column(3).to_numpy()
            top = min(n - 1, int(ks.max()))
            best = np.argpartition(-sim, top - 1, axis=1)[:, :top]
            value = np.take_along_axis(sim, best, 1)
            if ks.min() < top:
                order = np.argsort(-value, 1)
                best, value = np.take_along_axis(best, order, 1), np.take_along_axis(value, order, 1)
                value[np.arange(top)[None, :] >= ks[:, None]] = -2
            r, c = np.nonzero(value > np.maximum(floors, -1.5)[:, None])
            out[0].append(ids[r])
            out[1].append(ids[best[r, c]])
            out[2].append(value[r, c])
            if sum(map(len, out[0])) > 100_000:
                yield _candidates(out)
                out = [[], [], []]
        if out[0]:
            yield _candidates(out)

    return run


def _candidates(out):
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(c)) for c in out], schema=_CAND)


def _first_graph(n: int, threshold: float) -> tuple[int, int]:
    """Codes and bits of a code by which two of ``n`` vectors that are just
    linked share a block with probability AUDIT_RECALL. Blocks follow about
    log2(n / BLOCK) bits, each equal with probability 1 - angle / pi."""
    bits = max(0.0, math.log2(max(1, n) / BLOCK))
    share = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    trees = math.ceil(math.log(1 - AUDIT_RECALL) / math.log1p(-share)) if 0 < share < 1 else TREES
    return max(TREES, trees), min(62, max(PLANES, math.ceil(bits) + 2))


def _codes(seed: int, trees: int, n_planes: int):
    """Hyperplane codes of each vector and the vector as 16-bit numbers; planes
    depend on the seed, the tree and the vector's length."""
    schema = pa.schema([("id", pa.int64()), ("keys", pa.list_(pa.int64())), ("short", pa.binary())])

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            codes, short = np.empty((batch.num_rows, trees), np.int64), np.empty(batch.num_rows, object)
            sizes = batch.column(1).value_lengths().to_numpy()
            for d in np.unique(sizes):
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).normal(size=(int(d), trees * n_planes))
                at = np.flatnonzero(sizes == d)
                x = _matrix(batch.column(1).take(pa.array(at)))
                bits = (x @ planes[d] > 0).reshape(len(at), trees, n_planes)
                codes[at] = bits @ (1 << np.arange(n_planes, dtype=np.int64)[::-1])
                short[at] = [v.tobytes() for v in np.rint(x * SHORT).astype("<i2")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(codes), pa.list_(pa.int64())), pa.array(short, pa.binary())], schema=schema)

    return run


def _count_blocks(threshold: float):
    """Counts of linked copies and of linked vectors for pairs of cells of a
    component. Columns: key, id, side (0, 1 or 2 where both cells are one),
    mult, vec."""
    schema = pa.schema([("u", pa.int64()), ("links", pa.int64()), ("vectors", pa.int64())])

    def run(batches):
        for t in runs(batches):  # a run holds two cells at most
            side = t.column(2).to_numpy()
            ids, mult, x = t.column(1).to_numpy(), t.column(3).to_numpy(), _matrix(t.column(4))
            near = (x @ x.T >= threshold) & (ids[:, None] != ids[None, :])
            if side[0] != 2:
                near &= side[:, None] != side[None, :]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(near @ mult), pa.array(near.sum(1, dtype=np.int64))], schema=schema)

    return run


def _block_runs(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def _lists(entries: DataFrame, size: DataFrame) -> DataFrame:
    """The best k entries of each list (u, w, sim, fresh), k by vector."""
    once = entries.groupBy("u", "w").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = Window.partitionBy("u").orderBy(F.desc("sim"), "w")
    return once.withColumn("rank", F.row_number().over(rank)).join(size.select(F.col("id").alias("u"), "k"), "u") \
        .filter("rank <= k").select("u", "w", "sim", "fresh", "rank", "k")


def _descend(vecs: DataFrame, threshold: float, seed: int, trees: int, planes: int,
             rounds: int) -> tuple[DataFrame, DataFrame]:
    """Entries (u, w) at the threshold of the refined lists, and the vectors
    (id, code) whose lists are saturated in the end. Inside, an entry counts as
    linked from the threshold less the rounding of short vectors."""
    spark = vecs.sparkSession
    slack = rounding(vecs.agg(F.max(F.size("vec"))).first()[0] or 1)
    exact, threshold = threshold, threshold - slack
    n = shuffle_partitions(spark)
    size = vecs.select("id", F.lit(NEIGHBOURS).alias("k"))
    codes = cut_lineage(vecs.mapInArrow(_codes(seed, trees, planes), CODES))
    short = codes.select("id", "short")
    start = codes.select("id", "short", F.posexplode("keys").alias("tree", "code")).select(
        (F.col("tree").cast("bigint") * (1 << 32) + F.length("short")).alias("key"), "id", "short", "code")
    first = _block_runs(start, n, "key", "code", "id").select(
        "key", "id", F.lit(NEIGHBOURS).alias("k"), F.lit(-2.0).alias("floor"), F.lit(True).alias("fresh"), "short") \
        .mapInArrow(_compare(BLOCK), "u bigint, w bigint, sim double")
    lists = cut_lineage(_lists(first.withColumn("fresh", F.lit(True)), size))
    turn = 0
    while True:
        turn += 1
        # a vector's floor is its last entry's similarity once its list is full
        state = lists.groupBy("u").agg(
            F.min("sim").alias("low"), F.count(F.lit(1)).alias("n"), F.max("k").alias("k")) \
            .withColumn("full", F.col("n") >= F.col("k")) \
            .withColumn("k", F.when(F.col("full") & (F.col("low") >= threshold) & (F.col("k") < MAX_LIST),
                                    F.col("k") * GROWTH).otherwise(F.col("k"))) \
            .select(F.col("u").alias("id"), "k", F.when(F.col("full") & (F.col("n") >= F.col("k")), F.col("low"))
                    .otherwise(F.lit(-2.0)).alias("floor"))
        state = cut_lineage(vecs.select("id").join(state, "id", "left").select(
            "id", F.coalesce("k", F.lit(NEIGHBOURS)).alias("k"), F.coalesce("floor", F.lit(-2.0)).alias("floor")))
        forward = lists.select(F.col("u").alias("key"), F.col("w").alias("id"), "fresh")
        reverse = lists.select(F.col("w").alias("key"), F.col("u").alias("id"), "fresh")
        meet = forward.union(reverse).groupBy("key", "id").agg(F.max("fresh").alias("fresh"))
        # members of a hub larger than a block meet in other blocks each round
        active = meet.groupBy("key").agg(F.max("fresh").alias("any"), (F.count(F.lit(1)) > BLOCK).alias("hub")) \
            .filter("any").select("key", "hub")
        rows = meet.join(active, "key").join(state, "id").join(short, "id").select(
            "key", "id", "k", "floor", (F.col("fresh") | F.col("hub")).alias("fresh"), "short",
            F.when(F.col("hub"), F.xxhash64("id", F.lit(turn))).otherwise(F.col("id")).alias("place"))
        found = _block_runs(rows, n, "key", "place", "id").select("key", "id", "k", "floor", "fresh", "short") \
            .mapInArrow(_compare(BLOCK), "u bigint, w bigint, sim double")
        entries = lists.select("u", "w", "sim", F.lit(False).alias("fresh")) \
            .union(found.select("u", "w", "sim", F.lit(True).alias("fresh")))
        lists = cut_lineage(_lists(entries, state))
        ends = lists.groupBy("u").agg(
            F.min("sim").alias("low"), F.count(F.lit(1)).alias("n"), F.max("k").alias("k"),
            F.sum(F.col("fresh").cast("long")).alias("new"),
            F.max(F.col("fresh") & (F.col("sim") >= threshold)).alias("linked")) \
            .withColumn("saturated", (F.col("n") >= F.col("k")) & (F.col("low") >= threshold))
        more = F.when(F.col("saturated"), F.col("k") < MAX_LIST).otherwise(F.col("linked"))
        r = ends.agg(F.sum("new").alias("new"), F.sum("n").alias("n"), F.sum(more.cast("long")).alias("more")).first()
        if not r["more"] and (turn >= rounds or (r["new"] or 0) < SETTLED * (r["n"] or 1)):
            break
    full = codes.join(ends.filter("saturated").select(F.col("u").alias("id")), "id", "left_semi") \
        .select("id", F.col("keys")[0].alias("code"))
    sure = lists.filter(F.col("sim") >= exact + slack).select("u", "w")
    unsure = lists.filter((F.col("sim") >= exact - slack) & (F.col("sim") < exact + slack)) \
        .select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("w")).distinct() \
        .join(vecs.select(F.col("id").alias("u"), F.col("vec").alias("x")), "u") \
        .join(vecs.select(F.col("id").alias("w"), F.col("vec").alias("y")), "w") \
        .filter(F.expr("aggregate(zip_with(x, y, (a, b) -> a * b), 0D, (s, p) -> s + p)") >= exact).select("u", "w")
    return sure.union(unsure), cut_lineage(full)


def _cells(batches):
    """Blocks of consecutive vectors of a component with their centre and the
    largest angle to it. Columns: component, id, vec."""
    for t in runs(batches, BLOCK):
        ids, x = t.column(1).to_numpy(), _matrix(t.column(2))
        centre = x.sum(0)
        norm = np.linalg.norm(centre)
        centre = centre / norm if norm > 1e-9 else x[0]
        radius = float(np.arccos(np.clip((x @ centre).min(), -1, 1)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(ids.min())]), t.column(0).slice(0, 1).combine_chunks(), pa.array([radius]),
             pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([ids.tolist()], pa.list_(pa.int64()))],
            names=["cell", "component", "radius", "centre", "ids"])


def _near_cells(threshold: float):
    """Pairs of cells of two components that may hold a link, by the triangle
    inequality of angles. Columns: key, cell, component, side, radius, centre."""
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6

    def run(batches):
        for t in runs(batches):
            cell, component, side, radius = (t.column(i).to_numpy() for i in range(1, 5))
            x = _matrix(t.column(5))
            for lo in range(0, len(cell), 256):
                at = slice(lo, lo + 256)
                near = np.arccos(np.clip(x[at] @ x.T, -1, 1)) <= radius[at, None] + radius[None, :] + reach
                near &= (component[at, None] != component[None, :]) & (cell[at, None] < cell[None, :])
                if side[0] != 2:
                    near &= side[at, None] != side[None, :]
                a, b = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(cell[at][a]), pa.array(cell[b])], names=["a", "b"])

    return run


def _bridge(threshold: float):
    """The best link between two cells, if there is one; it joins their
    components. Columns: key, id, side, vec."""

    def run(batches):
        for t in runs(batches):
            ids, side, x = t.column(1).to_numpy(), t.column(2).to_numpy(), _matrix(t.column(3))
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            sim = x[one] @ x[two].T
            i, j = np.unravel_index(int(sim.argmax()), sim.shape)
            if sim[i, j] >= threshold:
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[one[i]])]), pa.array([int(ids[two[j]])])],
                                                 names=["u", "w"])

    return run


def _bridges(full: DataFrame, parts: DataFrame, vecs: DataFrame, threshold: float) -> DataFrame:
    """Links (u, w) that join the components of saturated vectors, exactly."""
    n = shuffle_partitions(vecs.sparkSession)
    rows = full.join(parts, "id", "left").join(vecs, "id").select(
        F.coalesce("component", "id").alias("component"), "id", "vec", "code")
    cells = cut_lineage(_block_runs(rows, n, "component", "code", "id").select("component", "id", "vec").mapInArrow(
        _cells, "cell bigint, component bigint, radius double, centre array<double>, ids array<bigint>"))
    groups = max(1, math.ceil(cells.count() / CELLS))
    placed = cells.withColumn("mine", F.pmod(F.xxhash64("cell"), F.lit(groups))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    near = placed.select(
        F.xxhash64(F.size("centre"), F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "cell", "component",
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
        "radius", "centre")
    near = cut_lineage(near.repartition(n, "key").sortWithinPartitions("key").mapInArrow(
        _near_cells(threshold), "a bigint, b bigint"))
    member = near.select(F.xxhash64("a", "b").alias("key"), F.posexplode(F.array("a", "b")).alias("side", "cell")) \
        .join(cells.select("cell", F.explode("ids").alias("id")), "cell").join(vecs, "id").select("key", "id", "side", "vec")
    return member.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_bridge(threshold), "u bigint, w bigint")


def _links_between(threshold: float):
    """Links inside a cell or between two, for vectors of different components.
    Columns: key, id, side (0, 1, or 2 where both cells are one), component,
    vec. Links form small components of their own, of which each member but
    the smallest gives one row."""

    def run(batches):
        for t in runs(batches):
            ids, side, part, x = t.column(1).to_numpy(), t.column(2).to_numpy(), t.column(3).to_numpy(), _matrix(t.column(4))
            near = (x @ x.T >= threshold) & (part[:, None] != part[None, :])
            if side[0] != 2:
                near &= side[:, None] != side[None, :]
            label = np.arange(len(ids))
            while True:  # smallest reachable row
                new = np.minimum(label, np.where(near, label[None, :], len(ids)).min(1))
                new = new[new]
                if (new == label).all():
                    break
                label = new
            rows = np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[label[rows]]), pa.array(ids[rows])], names=["u", "w"])

    return run


def _exact_links(vecs: DataFrame, parts: DataFrame | None, threshold: float, planes: int) -> DataFrame:
    """Links (u, w) that join the components of all vectors, without a descent:
    all pairs of cells of vectors side by side in the order of a code are
    compared but those too far apart for their radii. Its cost may grow with
    the square of the vectors; it is the way out where descents fail."""
    n = shuffle_partitions(vecs.sparkSession)
    codes = vecs.mapInArrow(_codes(SEED, 1, planes), CODES)
    rows = codes.select("id", F.col("keys")[0].alias("code")).join(vecs, "id") \
        .select(F.size("vec").cast("bigint").alias("key"), "code", "id", "vec")
    cells = cut_lineage(_block_runs(rows, n, "key", "code", "id").select("key", "id", "vec").mapInArrow(
        _cells, "cell bigint, component bigint, radius double, centre array<double>, ids array<bigint>")
        .withColumnRenamed("component", "size"))
    groups = max(1, math.ceil(cells.count() / CELLS))
    placed = cells.withColumn("mine", F.pmod(F.xxhash64("cell"), F.lit(groups))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    near = placed.select(
        F.xxhash64("size", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "cell",
        F.col("cell").alias("component"),
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
        "radius", "centre")
    near = near.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_near_cells(threshold), "a bigint, b bigint")
    pairs = cut_lineage(near.union(cells.select(F.col("cell").alias("a"), F.col("cell").alias("b"))))
    none = vecs.select("id", F.col("id").alias("component")).limit(0)
    named = vecs.join(none if parts is None else parts, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component"), "vec")
    sides = pairs.select(F.xxhash64("a", "b").alias("key"), F.explode(F.when(
        F.col("a") == F.col("b"), F.array(F.struct(F.lit(2).alias("side"), F.col("a").alias("cell")))).otherwise(F.array(
            F.struct(F.lit(0).alias("side"), F.col("a").alias("cell")),
            F.struct(F.lit(1).alias("side"), F.col("b").alias("cell"))))).alias("s")).select("key", "s.side", "s.cell")
    member = sides.join(cells.select("cell", F.explode("ids").alias("id")), "cell").join(named, "id") \
        .select("key", "id", "side", "component", "vec")
    return member.repartition(n, "key").sortWithinPartitions("key").mapInArrow(
        _links_between(threshold), "u bigint, w bigint").distinct()


def _sample_counts(sample: list, threshold: float):
    """Linked vectors of the sampled ones among all (block by block)."""
    schema = pa.schema([("u", pa.int64()), ("links", pa.int64())])
    by_size: dict[int, tuple] = {}
    for d in {len(v) for _, v in sample}:
        of = [(i, v) for i, v in sample if len(v) == d]
        by_size[d] = (np.array([i for i, _ in of]), np.array([v for _, v in of]))

    def run(batches):
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for d in np.unique(sizes):
                if d not in by_size:
                    continue
                ids, x = by_size[d]
                all_at, found = np.flatnonzero(sizes == d), np.zeros(len(ids), np.int64)
                for lo in range(0, len(all_at), 1024):
                    at = all_at[lo:lo + 1024]
                    near = x @ _matrix(batch.column(1).take(pa.array(at))).T >= threshold
                    found += (near & (ids[:, None] != batch.column(0).to_numpy()[at][None, :])).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found)], schema=schema)

    return run


def _recall(pool: DataFrame, vecs: DataFrame, counts: DataFrame | None, threshold: float) -> tuple[float, int]:
    """Mean share of found links over audited vectors of the pool that have
    links, each weighing the same (1 if none has), and their number.

    Vectors are drawn in the order of a hash, AUDIT_BATCH at a time (what the
    driver holds), until AUDIT_LINKED of them have links or the recall is
    plainly missed, or every vector has been audited."""
    drawn = cut_lineage(pool.select("id", F.xxhash64("id", F.lit(SEED)).alias("h"), "vec"))
    at, linked, found = None, 0, 0.0
    while linked < AUDIT_LINKED:
        rest = drawn if at is None else drawn.filter((F.col("h") > at[0]) | ((F.col("h") == at[0]) & (F.col("id") > at[1])))
        batch = rest.orderBy("h", "id").limit(AUDIT_BATCH).collect()
        if not batch:
            break
        at = (batch[-1]["h"], batch[-1]["id"])
        truth = vecs.mapInArrow(_sample_counts([(r["id"], list(r["vec"])) for r in batch], threshold),
                                "u bigint, links bigint") \
            .groupBy("u").agg(F.sum("links").alias("all")).filter("all > 0")
        got = truth.withColumn("vectors", F.lit(0)) if counts is None else \
            truth.join(counts.select("u", "vectors"), "u", "left")
        row = got.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.least(
            F.coalesce("vectors", F.lit(0)) / F.col("all"), F.lit(1.0))), F.lit(0.0)).alias("s")).first()
        linked, found = linked + row["n"], found + row["s"]
        if linked >= AUDIT_ENOUGH and found < 0.9 * linked:
            break
    return (found / linked if linked else 1.0), linked


def embedding_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Components of vectors linked by cosine >= ``threshold``, in double
    precision.

    ``vectors`` needs vec_id and embedding (array of numbers); further columns
    are ignored. Returns a row for every input row: vec_id, n_links (other
    rows linked directly), component_id (smallest vec_id reachable, itself
    included) and kept (vec_id = component_id).

    Null, empty and zero vectors and those with null or non-finite components
    link with nothing, and vectors of different lengths don't link with each
    other. Equal vectors link. A repeated vec_id is a row of its own with the
    same component; rows without a vec_id take part and count as links, but
    name no component unless alone (null). An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")) \
        .withColumn("norm", F.expr("sqrt(aggregate(e, 0D, (s, x) -> s + x * x))"))
    good = F.coalesce(F.col("norm") > 0, F.lit(False)) & (F.col("norm") < F.lit(float("inf"))) & ~F.isnan("norm")
    rows = cut_lineage(rows.select(
        "vec_id", F.when(good & F.col("vec_id").isNotNull(), F.expr("transform(e, x -> x / norm)")).alias("vec"),
        F.when(good & F.col("vec_id").isNull(), F.lit(True)).alias("unnamed")))
    vecs = cut_lineage(rows.filter("vec IS NOT NULL").groupBy("vec").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("mult")).select("id", "mult", "vec"))
    only = vecs.select("id", "vec")
    links, counts, parts = None, None, None
    n = vecs.count()
    trees, planes = _first_graph(n, threshold)
    for attempt in range(AUDIT_TRIES if n > 1 else 0):
        new, full = _descend(only, threshold, SEED + attempt, trees << attempt, planes, ROUNDS << attempt)
        links = cut_lineage(new if links is None else links.union(new).distinct())
        rest = only
        if links.isEmpty():
            parts, counts = None, None
        else:
            parts = components(links, "u", "w")
            bridges = cut_lineage(_bridges(full, parts, only, threshold))
            if not bridges.isEmpty():
                links = cut_lineage(links.union(bridges))
                parts = components(links, "u", "w")
            counts = _count(parts, vecs, threshold)
            large = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > BLOCK)
            rest = only.join(parts.join(large, "component").select("id"), "id", "left_anti")
        # outside large components is the harder pool; the other one needs no audit if nothing is left out of it
        recall = [_recall(rest, only, counts, threshold)]
        if recall[0][0] >= AUDIT_RECALL and rest is not only:
            recall.append(_recall(only, only, counts, threshold))
        LOG.info("descent %d: recall and audited linked vectors %s", attempt + 1, recall)
        if min(recall)[0] >= AUDIT_RECALL:
            break
    else:
        if n > 1:
            LOG.warning("recall %s after %d descents: all vectors are compared", recall, AUDIT_TRIES)
            exact = cut_lineage(_exact_links(only, parts, threshold, planes))
            links = exact if links is None else cut_lineage(links.union(exact))
            if not links.isEmpty():
                parts = components(links, "u", "w")
                counts = _count(parts, vecs, threshold)
    named = vecs.select("id", "mult", "vec")
    if parts is not None:
        named = named.join(parts, "id", "left").join(counts.select(F.col("u").alias("id"), "links"), "id", "left")
    else:
        named = named.withColumn("component", F.lit(None).cast("bigint")).withColumn("links", F.lit(0).cast("bigint"))
    named = named.select("vec", F.coalesce("component", "id").alias("component"),
                         (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).cast("bigint").alias("n"))
    linked = rows.filter("vec IS NOT NULL").join(named, "vec").select("vec_id", F.col("n").alias("n_links"), "component")
    rest = rows.filter("vec IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"),
                                             F.col("vec_id").alias("component"))
    return linked.union(rest).select(
        "vec_id", "n_links", F.col("component").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


def _cell_pairs(threshold: float):
    """How pairs of cells of a component stand, by the triangle inequality of
    angles. Columns: key, cell, side, radius, weight (copies), size, centre.
    Gives a row (a, b, 0, 0) for two cells whose vectors have to be compared,
    and for a cell the copies and vectors of all cells that lie wholly within
    the threshold of it (a, a, links, vectors)."""
    reach, slack = float(np.arccos(np.clip(threshold, -1, 1))), 1e-6

    def run(batches):
        for t in runs(batches):
            cell, side, radius, weight, size = (t.column(i).to_numpy() for i in range(1, 6))
            x = _matrix(t.column(6))
            for lo in range(0, len(cell), 256):
                at = slice(lo, lo + 256)
                apart = np.arccos(np.clip(x[at] @ x.T, -1, 1))
                span = radius[at, None] + radius[None, :]
                other = cell[at, None] != cell[None, :]
                if side[0] != 2:
                    other &= side[at, None] != side[None, :]
                inside = other & (apart + span <= reach - slack)
                meet = other & ~inside & (apart - span <= reach + slack) & (cell[at, None] < cell[None, :])
                i, j = np.nonzero(meet)
                near = np.flatnonzero(inside.any(1))
                none = np.zeros(len(i), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in (
                        (cell[at][i], cell[at][near]), (cell[j], cell[at][near]),
                        (none, (inside @ weight)[near]), (none, (inside @ size)[near]))],
                    names=["a", "b", "links", "vectors"])

    return run


def _count(parts: DataFrame, vecs: DataFrame, threshold: float) -> DataFrame:
    """Exact numbers of linked copies and linked vectors inside the components
    (u, links, vectors).

    A component of at most BLOCK vectors is one matrix. A larger one is cut into
    cells in the order of a code; a vector is written once for its own cell and
    once for each cell that may hold both linked and unlinked ones."""
    n = shuffle_partitions(parts.sparkSession)
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    small = parts.join(sizes.filter(F.col("n") <= BLOCK), "component").join(vecs, "id").select(
        F.col("component").alias("key"), "id", F.lit(2).alias("side"), "mult", "vec")
    counted = _multiplied(small, n, threshold)
    large = cut_lineage(parts.join(sizes.filter(F.col("n") > BLOCK), "component").join(vecs, "id")
                        .select("component", "id", "mult", "vec"))
    if large.isEmpty():
        return cut_lineage(counted)
    codes = large.select("id", "vec").mapInArrow(_codes(SEED, 1, PLANES), CODES)
    rows = large.join(codes.select("id", F.col("keys")[0].alias("code")), "id")
    cells = cut_lineage(_block_runs(rows, n, "component", "code", "id").select("component", "id", "vec").mapInArrow(
        _cells, "cell bigint, component bigint, radius double, centre array<double>, ids array<bigint>"))
    member = cells.select("cell", F.explode("ids").alias("id"))
    weights = member.join(vecs.select("id", "mult"), "id").groupBy("cell").agg(F.sum("mult").alias("weight"))
    groups = cells.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELLS)).cast("bigint").alias("groups"))
    placed = cells.join(groups, "component").join(weights, "cell") \
        .withColumn("mine", F.pmod(F.xxhash64("cell"), F.col("groups"))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)))
    stands = placed.select(
        F.xxhash64("component", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "cell",
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
        "radius", "weight", F.size("ids").cast("bigint").alias("size"), "centre")
    stands = cut_lineage(stands.repartition(n, "key").sortWithinPartitions("key").mapInArrow(
        _cell_pairs(threshold), "a bigint, b bigint, links bigint, vectors bigint"))
    whole = stands.filter("vectors > 0").groupBy(F.col("a").alias("cell")).agg(
        F.sum("links").alias("links"), F.sum("vectors").alias("vectors"))
    whole = member.join(whole, "cell").select(F.col("id").alias("u"), "links", "vectors")
    sides = stands.filter("vectors = 0").select(F.xxhash64("a", "b").alias("key"), F.posexplode(F.array("a", "b")).alias("side", "cell")) \
        .union(cells.select(F.xxhash64("cell", "cell").alias("key"), F.lit(2).alias("side"), "cell"))
    meet = sides.join(member, "cell").join(vecs, "id").select("key", "id", "side", "mult", "vec")
    return cut_lineage(counted.union(whole).union(_multiplied(meet, n, threshold))
                       .groupBy("u").agg(F.sum("links").alias("links"), F.sum("vectors").alias("vectors")))


def _multiplied(rows: DataFrame, n: int, threshold: float) -> DataFrame:
    """Counts by vector of rows that meet by key."""
    return rows.repartition(n, "key").sortWithinPartitions("key") \
        .mapInArrow(_count_blocks(threshold), "u bigint, links bigint, vectors bigint") \
        .groupBy("u").agg(F.sum("links").alias("links"), F.sum("vectors").alias("vectors"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
g AS (SELECT vec_id, list_transform(e, lambda x: x / norm) AS u FROM n WHERE norm > 0 AND isfinite(norm)),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u)
  WHERE list_dot_product(a.u, b.u) >= {THRESHOLD}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN k USING (vec_id)
"""
