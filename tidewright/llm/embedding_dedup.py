"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors at cosine >= t are at distance <= eps = sqrt(2 - 2t).  Equal
vectors are merged first.  The others are projected on leading principal
directions (an orthonormal projection never lengthens a distance, so any such
directions give right results; they are fitted on a bounded sample), sorted by
their cells of width eps (the epsilon grid order) and cut, by their place in
that order, into blocks of BLOCK_BYTES, each with its bounding box.  Pairs of
stretches of the order are then joined recursively: first over the boxes alone,
as a distributed tree (FAN blocks make a node, FAN nodes one above it), where
pairs of nodes more than eps apart are skipped with all that is below them;
then inside the pairs of blocks that are left, halving the sequences and
skipping distant halves, down to small products in double precision.

A block is sent once for each block that it may meet, so vectors are sent
n / (vectors a block) times at most.  A pair of blocks gives, for each vector
with a link, how many it has there and the least vector of its connected part:
counts and spanning links, never the pairs themselves.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths don't link; rows
with equal ids are vectors each; ties go to the least id; an empty table gives
no rows; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, connected_components, freeing, hashed_sample, join_spread, stored, table

THRESHOLD, DIRECTIONS, LEAF, SAMPLE, LENGTHS = 0.95, 16, 128, 2_000, 8
#: Bytes of a block's vectors in double precision, and children of a node of the tree of boxes.
BLOCK_BYTES, FAN = 4 << 20, 16
ROW_BITS = 33  # of monotonically_increasing_id: the place inside a partition


def directions(sample: list) -> dict[int, np.ndarray]:
    """Leading principal directions (dim, DIRECTIONS) for each length of vector in the sample."""
    by_dim: dict[int, list] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    out = {}
    for d, rows in by_dim.items():
        u = np.array(rows, np.float64)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        u -= u.mean(0)
        _, vectors = np.linalg.eigh(u.T @ u)
        out[d] = np.ascontiguousarray(vectors[:, ::-1][:, :DIRECTIONS])
    return out


def placed(reps: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """(rep, n, v) with dim, cells c0.. and projections p, from the epsilon grid."""
    k = DIRECTIONS
    cells = [f"c{i}" for i in range(k)]

    def place(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            values = b.column(2)
            size = np.diff(values.offsets.to_numpy())
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            cut = np.concatenate([[0], np.cumsum(size)])
            spot = np.zeros((b.num_rows, k))
            for d in np.unique(size).tolist():
                own = np.flatnonzero(size == d)
                u = np.stack([flat[cut[i] : cut[i + 1]] for i in own.tolist()])
                u /= np.linalg.norm(u, axis=1, keepdims=True)
                p = u @ axes.get(d, np.eye(d, min(k, d)))
                spot[own, : p.shape[1]] = p
            grid = np.floor(spot / eps).astype(np.int32)
            p = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * k), pa.array(spot.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), values, pa.array(size.astype(np.int32)), p, *(pa.array(grid[:, i]) for i in range(k))], ["rep", "n", "v", "dim", "p", *cells])

    kind = dict(reps.dtypes)["v"]
    return reps.select("rep", "n", "v").mapInArrow(freeing(place), f"rep long, n long, v {kind}, dim int, p array<double>, " + ", ".join(f"{c} int" for c in cells))


def in_blocks(reps: DataFrame, axes: dict[int, np.ndarray], eps: float) -> tuple[DataFrame, int]:
    """((rep, n, v, dim, block, p) stored, number of blocks): blocks are stretches of the epsilon grid order, numbered in it.

    Rows are sorted over range partitions and stored; a row's place is its place
    in the partition and the rows of those before it (one number a partition).
    """
    cells = [f"c{i}" for i in range(DIRECTIONS)]
    first = Stored(placed(reps, axes, eps))  # a range partitioning reads its rows twice
    ordered = first.df.repartitionByRange("dim", *cells, "rep").sortWithinPartitions("dim", *cells, "rep").drop(*cells)
    ordered = stored(ordered.withColumn("at", F.monotonically_increasing_id()))
    first.drop()
    part, row = F.shiftright("at", ROW_BITS), F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.max("dim").alias("dim")).orderBy("part").collect()
    widest = max((r["dim"] for r in sizes), default=1)
    block = max(LEAF, BLOCK_BYTES // (8 * max(widest, 1)))
    before, starts = 0, []
    for r in sizes:
        starts.append((r["part"], before))
        before += r["rows"]
    offsets = reps.sparkSession.createDataFrame(starts, "part long, before long")
    rows = ordered.join(F.broadcast(offsets), part == F.col("part"))
    rows = rows.select("rep", "n", "v", "dim", F.floor((F.col("before") + row) / block).cast("long").alias("block"), "p")
    return rows, -(-before // block)


def near_blocks(rows: DataFrame, count: int, eps: float) -> DataFrame:
    """(dim, i, j) with i <= j for blocks that may hold a link: down a tree of boxes, from one pair of roots for each length of vector."""
    k = DIRECTIONS
    low, high = [f"l{x}" for x in range(k)], [f"h{x}" for x in range(k)]
    ends = [F.min(F.col("p")[x]).alias(low[x]) for x in range(k)] + [F.max(F.col("p")[x]).alias(high[x]) for x in range(k)]
    levels = [stored(rows.groupBy("dim", F.col("block").alias("node")).agg(*ends))]
    while count > 1:
        count = -(-count // FAN)
        up = levels[-1].groupBy("dim", F.floor(F.col("node") / FAN).cast("long").alias("node"))
        levels.append(stored(up.agg(*[F.min(c).alias(c) for c in low], *[F.max(c).alias(c) for c in high])))
    pairs = levels[-1].select("dim", F.col("node").alias("i"), F.col("node").alias("j"))
    for boxes in levels[-2::-1]:
        children = boxes.withColumn("up", F.floor(F.col("node") / FAN).cast("long"))
        x, y, p = children.alias("x"), children.alias("y"), pairs.alias("p")
        gap = F.lit(0.0)
        for a, b in zip(low, high):
            apart = F.greatest(F.col(f"x.{a}") - F.col(f"y.{b}"), F.col(f"y.{a}") - F.col(f"x.{b}"), F.lit(0.0))
            gap = gap + apart * apart
        left = p.join(x, F.expr("p.dim = x.dim AND p.i = x.up"))
        met = left.join(y, F.expr("p.dim = y.dim AND p.j = y.up AND x.node <= y.node")).where(gap <= eps * eps * (1 + 1e-9))
        pairs = stored(met.select("p.dim", F.col("x.node").alias("i"), F.col("y.node").alias("j")))
    return pairs


def links(rows: DataFrame, pairs: DataFrame, threshold: float, eps: float, axes: dict[int, np.ndarray]) -> DataFrame:
    """(rep, links, least) for each vector and pair of blocks that link it; least is the smallest rep of its part there."""
    leaf, k = LEAF, DIRECTIONS
    sides = pairs.select("dim", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    both = rows.select("rep", "n", "v", "dim", "block").join(sides.hint("merge"), ["dim", "block"]).select("dim", "i", "j", "block", "rep", "n", "v")

    def run(key, part):
        import numpy as np
        import pyarrow as pa

        def hits(ua, ub, pa_, pb, same):
            """Yields (first row of a, first row of b, link matrix) of leaves, recursively."""
            todo = [(0, len(ua), 0, len(ub))]
            while todo:
                a0, a1, b0, b1 = todo.pop()
                if same and b1 <= a0:
                    continue
                la, ha, lb, hb = pa_[a0:a1].min(0), pa_[a0:a1].max(0), pb[b0:b1].min(0), pb[b0:b1].max(0)
                away = np.maximum(np.maximum(la - hb, lb - ha), 0)
                if (away * away).sum() > eps * eps * (1 + 1e-9):
                    continue
                if a1 - a0 <= leaf and b1 - b0 <= leaf:
                    hit = ua[a0:a1] @ ub[b0:b1].T >= threshold
                    if same:
                        hit &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
                    if hit.any():
                        yield a0, b0, hit
                    continue
                am, bm = (a0 + a1) // 2, (b0 + b1) // 2
                if a1 - a0 <= leaf:
                    todo += [(a0, a1, b0, bm), (a0, a1, bm, b1)]
                elif b1 - b0 <= leaf:
                    todo += [(a0, am, b0, b1), (am, a1, b0, b1)]
                else:
                    todo += [(a0, am, b0, bm), (a0, am, bm, b1), (am, a1, b0, bm), (am, a1, bm, b1)]

        d, i, j = (x.as_py() for x in key)
        block, ids, n = (part.column(c).to_numpy() for c in ("block", "rep", "n"))
        u = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        p = u @ axes.get(d, np.eye(d, min(k, d)))
        order = np.lexsort((ids, *np.floor(p / eps).T[::-1], block))
        block, ids, n, u, p = block[order], ids[order], n[order], u[order], p[order]
        cut = int(np.searchsorted(block, i, side="right"))
        other = 0 if i == j else cut
        count, part_of = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for a, b, hit in hits(u[:cut], u[other:], p[:cut], p[other:], i == j):
            b += other
            rows_a, rows_b = slice(a, a + hit.shape[0]), slice(b, b + hit.shape[1])
            count[rows_a] += hit @ n[rows_b]
            count[rows_b] += hit.T @ n[rows_a]
            x, y = np.nonzero(hit)
            for s, t in np.unique(np.stack([part_of[x + a], part_of[y + b]], 1), axis=0).tolist():
                s, t = part_of[s], part_of[t]  # a part goes by one of its members
                if s != t:
                    part_of[part_of == t] = s
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, part_of, ids)
        own = np.flatnonzero(count)
        return pa.table({"rep": pa.array(ids[own]), "links": pa.array(count[own]), "least": pa.array(least[part_of[own]])})

    return both.groupBy("dim", "i", "j").applyInArrow(run, "rep long, links long, least long")


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of ``vectors``."""
    eps = float(np.sqrt(2 - 2 * threshold)) * (1 + 1e-9)
    v = F.col("v")
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).withColumn("v", F.when(F.coalesce(fine, F.lit(False)), v))
    rows = rows.select("vec_id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit("vector"), "v").alias("g"))  # 128 bits name a vector
    reps = stored(rows.where("v IS NOT NULL").groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")))
    axes = directions([r[0] for r in hashed_sample(reps.select("v", "h", F.size("v").alias("dim")), "h", "dim", SAMPLE, LENGTHS).select("v").collect()])
    blocks, count = in_blocks(reps, axes, eps)
    met = stored(links(blocks, near_blocks(blocks, count, eps), threshold, eps, axes))
    comps = connected_components(met.select(F.col("rep").alias("u"), F.col("least").alias("v")))
    counts = met.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = comps.join(counts, F.col("node") == F.col("rep"), "full").select(F.coalesce("rep", "node").alias("r"), "component", "links")
    known = reps.select("h", "g", "rep", "n").join(linked, F.col("rep") == F.col("r"), "left").where("n > 1 OR links > 0")  # all others are alone
    known = stored(known.select("h", "g", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("links"), F.coalesce("component", "rep").alias("component")))
    seen = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.col("h")).alias("h"), "g")
    found = join_spread(seen, known, ["h", "g"], "n", "vec_id")
    out = found.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


#: All pairs and the closure of their links; for small tables.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
f AS MATERIALIZED (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS MATERIALIZED (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM f WHERE list_dot_product(e, e) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.95),
r AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x, min(y) AS least FROM r GROUP BY x), n AS (SELECT x, count(*) AS links FROM p GROUP BY x)
SELECT vec_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.x LEFT JOIN n ON vec_id = n.x
"""
