"""Operator 10: exact top-k inner products by a Voronoi join.

1. Pivots, one for about ``CELL_QUERIES`` queries and ``MAX_PIVOTS`` at most,
   drawn by a hash of their ids, divide the space; every vector goes to the cell
   of its nearest pivot.
2. For each query cell a summary is made: its radius R (the greatest distance
   of a query from the pivot P) and a bound: each query is answered from a part
   of its own cell, and the smallest k-th score found is what every query
   of the cell is sure to reach.
3. For a query q of the cell and any vector x, ``q.x <= P.x + R |x|``. Only
   vectors for which the right side reaches the cell's bound are compared there.
   Cells near each other form groups of ``GROUP_BLOCKS`` blocks of queries; a vector is
   sent once to a group, with a bit for each cell that needs it. (Where no bound
   excludes anything, as with vectors in all directions, a vector is sent to every
   group, not to every cell.)
4. Each group is solved in stretches of vectors, so no task holds a whole group: a
   task compares blocks of one cell's queries with blocks of the vectors that the cell
   needs and keeps the best so far. The stretches' best are merged.

Between the steps a vector is a string of bytes, in the smallest type that holds all
components. What a worker builds for a batch is bounded, however many cells there are.

Components are ``floor(64 * x)``; products are exact: in doubles while no sum
can pass 2^53, else in Python integers (saturated to 64 bits).

Defined results: vectors that are null, or hold null or non-finite components,
take no part; rows without an id neither; shorter vectors count as filled up
with zeros; equal rows (id and vector) count once, and rows with the query's id
are its own; fewer than k candidates give what there is; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checkup.llm.common import ship, stored

TOP, EVERY, SCALE = 20, 20, 64
CELL_QUERIES, MAX_PIVOTS = 256, 1024  # queries a cell is meant to hold; most pivots
QUERY_BLOCK, DATA_BLOCK, PROBE_ROWS = 1024, 8192, 2048
GROUP_BLOCKS = 16  # query blocks a group of cells is meant to hold
STRETCHES, STRETCH_BLOCKS = 32, 8  # from so many tasks on, a task gets more data blocks than one; most data blocks a task
REACH_CELLS = 1 << 20  # rows by cells that bounds are worked out for at once
_LIMIT = 2.0**53


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: whole-numbered components (as doubles)."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    whole = F.transform("raw", lambda x: x * F.lit(float(scale)))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("raw"))
            .where("vec_id IS NOT NULL AND raw IS NOT NULL").where(F.forall("raw", finite))
            .select("vec_id", F.transform(whole, lambda x: F.rint(x - F.pmod(x, F.lit(1.0)))).alias("v"))
            .dropDuplicates(["vec_id", "v"]))


def _matrix(column, dim: int) -> np.ndarray:
    """A list column as a matrix with ``dim`` columns."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    at = 0
    for i, n in enumerate(lengths.tolist()):
        out[i, :n] = flat[at:at + n]
        at += n
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64."""
    top = (np.abs(q).max(initial=0.0)) * (np.abs(x).max(initial=0.0)) * max(1, q.shape[1])
    if top < _LIMIT:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in r] for r in m], dtype=object).reshape(m.shape)
    exact = whole(q).dot(whole(x).T)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _block_best(q_ids, q, x_ids, x, k: int, floors=None) -> list:
    """(vectors, scores) of each query's k best, ties by id; with ``floors`` (a score or None for each query)
    only vectors that reach it."""
    score = products(q, x)
    order = np.argsort(x_ids, kind="stable")
    ids = x_ids[order]
    out = []
    for i, own in enumerate(q_ids):
        s = score[i]
        if floors is not None and floors[i] is not None:
            ok = np.flatnonzero(s >= floors[i])
            ok = ok[x_ids[ok] != own]
            top = _smaller(ok, x_ids, s, k)
            out.append((x_ids[top], s[top]))
            continue
        s = s[order]
        ok = np.flatnonzero(ids != own)
        if len(ok) > 4 * k:
            cut = np.partition(s[ok], len(ok) - k)[len(ok) - k]
            ok = ok[s[ok] >= cut]
        top = _smaller(ok, ids, s, k)
        out.append((ids[top], s[top]))
    return out


def _smaller(order, ids, score, k: int):
    """``order`` (places in ``ids`` and ``score``), best first, ties by id, cut to ``k``."""
    return order[np.lexsort((ids[order], ~score[order]))][:k]


def best(q_ids, q, x_ids, x, k: int, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK):
    """(query, vector, score) arrays of each query's k best, ties by id, worked out in blocks: no product of more
    than one block is held."""
    out = [], [], []
    for at in range(0, len(q_ids), query_block):
        some, m = q_ids[at:at + query_block], q[at:at + query_block].astype(np.float64)
        found = None
        for to in range(0, len(x_ids), data_block):
            new = _block_best(some, m, x_ids[to:to + data_block], x[to:to + data_block].astype(np.float64), k,
                       None if found is None else [s[-1] if len(s) >= k else None for _, s in found])
            if found is None:
                found = new
                continue
            for i, (ids, score) in enumerate(new):
                if len(ids):
                    ids, score = np.concatenate((found[i][0], ids)), np.concatenate((found[i][1], score))
                    top = _smaller(np.arange(len(ids)), ids, score, k)
                    found[i] = ids[top], score[top]
        for own, (ids, score) in zip(some, found or ()):
            out[0].append(np.full(len(ids), own))
            out[1].append(ids)
            out[2].append(score)
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)


def _whole_type(most: float) -> np.dtype:
    """The smallest type that holds whole numbers up to ``most`` in size."""
    return np.dtype(next((t for t in (np.int16, np.int32) if most <= np.iinfo(t).max), np.float64))


def _bytes(rows: np.ndarray) -> pa.Array:
    """A matrix as a column of byte strings, one a row."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _rows(column, width: int, dtype) -> np.ndarray:
    """The matrix with ``width`` columns of a column made by ``_bytes``."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def _slices(batches, rows: int):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _assign(df: DataFrame, pivots: np.ndarray, dtype: np.dtype) -> DataFrame:
    """``df`` (vec_id, v) with its cell and the distance to the pivot, v as bytes."""
    dim, half, at_once = pivots.shape[1], (pivots**2).sum(1) / 2, max(1, REACH_CELLS // len(pivots))

    def run(batches):
        for b in _slices(batches, at_once):
            m = _matrix(b.column("v"), dim)
            cell = np.argmax(m @ pivots.T - half, axis=1) if len(m) else np.zeros(0, np.int64)
            far = np.sqrt(((m - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), _bytes(m.astype(dtype)), pa.array(cell.astype(np.int32)),
                                              pa.array(far)], names=["vec_id", "v", "cell", "far"])

    return df.mapInArrow(run, "vec_id long, v binary, cell int, far double")


def _solve(blocks: DataFrame, by: list[str], dim: int, dtype: np.dtype, k: int,
           query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> DataFrame:
    """Each group's best: rows of ``blocks`` are ``is_query, vec_id, v, bit, need``, grouped by ``by``. A query
    has the place of its cell as ``bit``, a vector the bits of the cells that need it as ``need``."""

    def run(table: pa.Table) -> pa.Table:
        flag = table.column("is_query").to_numpy().astype(bool)
        ids, v, bit, need = (table.column(c) for c in ("vec_id", "v", "bit", "need"))
        asked, given = pa.array(flag), pa.array(~flag)
        q_ids, q, bit = ids.filter(asked).to_numpy(), _rows(v.filter(asked), dim, dtype), bit.filter(asked).to_numpy()
        x_ids, x, need = ids.filter(given).to_numpy(), _rows(v.filter(given), dim, dtype), need.filter(given)
        need = _rows(need, len(need[0].as_py()) if len(need) else 1, np.uint8)
        got = []
        for c in np.unique(bit):
            of, to = bit == c, np.flatnonzero(need[:, c >> 3] & (128 >> (c & 7)))
            got.append(best(q_ids[of], q[of], x_ids[to], x[to], k, query_block, data_block))
        q, x, s = (np.concatenate(c) if got else np.zeros(0, np.int64) for c in (zip(*got) if got else [()] * 3))
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(x, pa.int64()),
                         "score": pa.array(s, pa.int64())})

    return blocks.groupBy(*by).applyInArrow(run, "query_id long, vec_id long, score long")


def _chain(centre: np.ndarray) -> list[int]:
    """The rows of ``centre`` in an order in which each is followed by the nearest one left."""
    left, out = np.ones(len(centre), bool), [0]
    left[0] = False
    while left.any():
        far = ((centre - centre[out[-1]]) ** 2).sum(1)
        out.append(int(np.argmin(np.where(left, far, np.inf))))
        left[out[-1]] = False
    return out


def _groups(asking: dict[int, int], order: list[int], room: int) -> tuple[list[list[int]], dict[int, int], dict[int, int]]:
    """Cells in groups of at most ``room`` queries, following ``order``: the cells of each group, the first group
    of each cell, and over how many groups the queries of a cell are dealt (a large cell has some to itself)."""
    groups, first, parts, held = [], {}, {}, room
    for c in order:
        n = asking[c]
        parts[c] = -(-n // room)
        if parts[c] > 1 or held + n > room:
            groups += [[] for _ in range(parts[c])]
            held = 0 if parts[c] == 1 else room
        first[c] = len(groups) - parts[c]
        for g in groups[first[c]:]:
            g.append(c)
        held += n
    return groups, first, parts


def _block(col, n):
    return F.pmod(F.xxhash64(col), n).cast("int")


def top_products(vectors: DataFrame, k: int = TOP, every: int = EVERY, n_pivots: int | None = None,
                 id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
                 query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` for queries whose id ``every`` divides."""
    spark = vectors.sparkSession
    ship(spark)
    data = stored(usable(vectors, id_col, vector_col, scale), "knn-vectors")
    dim, most = data.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if dim is None:
        return empty
    dtype = _whole_type(most or 0.0)
    if n_pivots is None:
        asking = data.where(F.col("vec_id") % every == 0).count()
        n_pivots = min(MAX_PIVOTS, max(1, -(-asking // CELL_QUERIES)))
    drawn = data.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n_pivots).select("v").collect()
    pivots = np.zeros((len(drawn), dim))
    for i, r in enumerate(drawn):
        pivots[i, :len(r["v"])] = r["v"]
    placed = stored(_assign(data, pivots, dtype), "knn-cells")
    queries = placed.where(F.col("vec_id") % every == 0)
    # summaries: one row per cell
    rows = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    summary = {r["cell"]: r for r in queries.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
    if not summary:
        return empty
    cells = sorted(summary)
    centre = pivots[cells]
    q_blocks = {c: -(-r["n"] // query_block) for c, r in summary.items()}
    groups, first, parts = _groups({c: r["n"] for c, r in summary.items()}, [cells[i] for i in _chain(centre)],
                                   GROUP_BLOCKS * query_block)
    place = {c: groups[first[c]].index(c) for c in cells}
    per = lambda d, key="cell": F.element_at(F.map_from_arrays(  # noqa: E731  (one entry per pivot or group)
        F.array(*[F.lit(int(c)) for c in d]), F.array(*[F.lit(int(n)) for n in d.values()])), F.col(key))
    asked = queries.select("cell", _block("vec_id", per(q_blocks)).alias("qb"),
                           (per(first) + _block("vec_id", per(parts))).alias("grp"), per(place).alias("bit"), "vec_id", "v")
    asked = stored(asked, "knn-queries")
    # a bound from a part of each query's own cell
    probed = {c: -(-rows[c] // PROBE_ROWS) for c in summary}
    some = (placed.where(F.col("cell").isin([int(c) for c in summary])).where(_block("vec_id", per(probed)) == 0)
            .select("cell", F.explode(F.sequence(F.lit(0), per(q_blocks) - 1)).alias("qb"), F.lit(False).alias("is_query"),
                    "vec_id", "v", F.lit(None).cast("int").alias("bit"), F.lit(bytearray([255])).alias("need")))
    probe = asked.select("cell", "qb", F.lit(True).alias("is_query"), "vec_id", "v", F.lit(0).alias("bit"),
                         F.lit(None).cast("binary").alias("need")).unionByName(some)
    kth = (_solve(probe, ["cell", "qb"], dim, dtype, k, query_block, data_block).groupBy("query_id")
           .agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") >= k))
    sure = (asked.select("cell", F.col("vec_id").alias("query_id")).join(kth, "query_id", "left")
            .groupBy("cell").agg(F.min("low").alias("low"), F.count("*").alias("n"), F.count("low").alias("known")).collect())
    bound = {r["cell"]: float(r["low"]) if r["n"] == r["known"] else -np.inf for r in sure}
    radius = np.array([summary[c]["radius"] for c in cells])
    floor = np.array([bound[c] for c in cells])
    at = {c: i for i, c in enumerate(cells)}
    columns = [[at[c] for c in g] for g in groups]

    def send(batches):
        for b in _slices(batches, max(1, REACH_CELLS // len(cells))):
            m = _rows(b.column("v"), dim, dtype).astype(np.float64)
            # the slack covers rounding of the bound, not of the products
            reach = m @ centre.T + np.outer(np.sqrt((m**2).sum(1)), radius)
            reach += 1 + 1e-9 * np.abs(reach)
            needed = reach >= floor
            for g, own in enumerate(columns):
                i = np.flatnonzero(needed[:, own].any(axis=1))
                if len(i):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(i), g, np.int32)), b.column("vec_id").take(pa.array(i)),
                         b.column("v").take(pa.array(i)), _bytes(np.packbits(needed[np.ix_(i, own)], axis=1))],
                        names=["grp", "vec_id", "v", "need"])

    sent = stored(placed.select("vec_id", "v").mapInArrow(send, "grp int, vec_id long, v binary, need binary"), "knn-sent")
    got = {r["grp"]: r["n"] for r in sent.groupBy("grp").agg(F.count("*").alias("n")).collect()}
    total = sum(-(-n // data_block) for n in got.values())
    stretch = data_block * min(STRETCH_BLOCKS, max(1, total // STRETCHES))
    x_blocks = {g: -(-got.get(g, 1) // stretch) for g in range(len(groups))}
    blocks = (asked.select("grp", F.explode(F.sequence(F.lit(0), per(x_blocks, "grp") - 1)).alias("xb"),
                           F.lit(True).alias("is_query"), "vec_id", "v", "bit", F.lit(None).cast("binary").alias("need"))
              .unionByName(sent.select(
                  "grp", _block("vec_id", per(x_blocks, "grp")).alias("xb"), F.lit(False).alias("is_query"), "vec_id", "v",
                  F.lit(None).cast("int").alias("bit"), "need")))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = _solve(blocks, ["grp", "xb"], dim, dtype, k, query_block, data_block)
    # dealt out by query once, for the distinct rows and their ranks
    return (found.repartition("query_id").distinct().withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


ORACLE_SQL = f"""
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score
  FROM ok q JOIN ok x ON q.vec_id <> x.vec_id WHERE q.vec_id % {EVERY} = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP}
"""
