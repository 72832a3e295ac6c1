"""Distance work: nearest-neighbour graph, Euclidean silhouette, Davies-Bouldin.

Neighbour graph. Points are assigned to the nearest of P pivots. Each point first searches its own cell, which
gives it a radius; it then visits only those other cells that can hold something nearer (triangle inequality and
bisector bound), so no point meets all others unless the geometry leaves no choice, and the result is exact.
Copies of one point are collapsed first and a large cell is cut into chunks, so no task holds an unbounded
group. Tasks emit k rows per point, never pairs.

Where the bounds leave a point most of the cells, as in many dimensions, blocks of points are compared in pairs instead, so
that a point is shipped once a block and not once a cell. Distances are screened by one matrix product and what passes is
computed difference by difference.

Silhouette. The mean distance to every cluster has no closed form under the plain Euclidean metric; its cost is
quadratic by definition. Rows are packed into blocks of bounded size, stored as arrays in the shared folder. A task maps those of two groups
of blocks, meets them in small tiles and emits one array of sums a block for all its pairs: blocks are never shuffled, and the sums
that are grow with the rows. The squared
metric, another quantity, is linear. The caller names the metric; the number of rows never decides it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayflow.functions.columns import q, squared_distance
from stayflow.llm.ngram_lm import mapped, stored
from stayflow.session import ensure_checkpoint_dir, removed, shared_path

BLOCK_ROWS = 2048
#: Rows of a packed block at most, packed blocks that a table should fill, and rows and columns of a tile of distances.
PACK_ROWS, PACKS, TILE = 16_384, 24, (128, 1024)
#: Groups of packed blocks at least, tasks a core that their pairs should make, and bytes of sums that a task holds.
GROUPS, TASKS_A_CORE, SUMS_HELD = 12, 4, 128 << 20
#: Share of all cells beyond which points are compared by packed blocks, not cell by cell.
MANY_CELLS = 1 / 8
#: Rows that a task hands over at a time.
HANDED = 20_000
CELL_ROWS = 1024
MAX_PIVOTS = 4096


def as_double_array(df: DataFrame, col: str) -> DataFrame:
    """The feature column as array<double>, whatever it was (vector, array of floats)."""
    kind = df.schema[col].dataType
    value = q(col).cast("array<double>") if isinstance(kind, T.ArrayType) else vector_to_array(q(col))
    return df.withColumn(col, value)


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns as new attributes, so that a table can be co-grouped with itself."""
    return df.select(*[q(c).alias(c) for c in df.columns])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.empty((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed dimension by dimension: equal points give exactly 0 and no large temporary."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        gap *= gap
        total += gap
    return np.sqrt(total, out=total)


# ---------------------------------------------------------------- neighbour graph


def _lifted(x: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two factors and squared norms of centred rows: a row of the first times a row of the second is their squared distance,
    up to about 1e-16 of the norms for every column."""
    x = x - middle
    norms = (x * x).sum(axis=1)
    one = np.ones(len(x))
    return np.column_stack([-2.0 * x, norms, one]), np.column_stack([x, one, norms]), norms


def _exact(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (a[rows], b[cols]), summed dimension by dimension."""
    total = np.zeros(len(rows))
    for j in range(a.shape[1]):
        gap = a[rows, j] - b[cols, j]
        total += gap * gap
    return total


def _nearest_in_block(query_ids, queries, members, points, k: int, radius=None, apart=None) -> pd.DataFrame:
    """The k nearest member ids per query, ordered by (distance, id). Ties beyond the k-th place are settled by id.

    Queries come in turns of bounded size. A point stands for up to k ids, which are looked up only for the points that the
    screen lets through. Queries and points of equal number in `apart` do not meet.
    """
    counts = np.array([len(m) for m in members])
    ids, starts = np.concatenate([np.asarray(m) for m in members]), np.cumsum(counts) - counts
    middle = points.mean(axis=0)
    _, right, norms = _lifted(points, middle)
    step, found = max(16, TILE[0] * TILE[1] * 4 // len(points)), []
    for at in range(0, len(queries), step):
        own = queries[at:at + step]
        left, _, mine = _lifted(own, middle)
        gaps = left @ right.T
        if apart is not None:
            gaps[apart[0][at:at + step, None] == apart[1][None, :]] = np.inf
        slack = 2e-15 * (points.shape[1] + 4) * (mine + norms.max())
        place = min(k, len(points)) - 1
        bound = np.partition(gaps, place, axis=1)[:, place] + 2 * slack
        if radius is not None:
            bound = np.minimum(bound, radius[at:at + step] ** 2 * (1 + 1e-12) + slack)
        rows, cols = np.nonzero((gaps <= bound[:, None]) & (gaps < np.inf))
        values = np.sqrt(_exact(own, points, rows, cols))
        times = counts[cols]
        first = np.cumsum(times) - times
        named = ids[np.repeat(starts[cols] - first, times) + np.arange(times.sum())]
        rows, values = np.repeat(rows, times), np.repeat(values, times)
        by = np.lexsort((named, values, rows))
        rows, named, values = rows[by], named[by], values[by]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
        if radius is not None:
            keep &= values <= radius[at:at + step][rows]
        found.append(pd.DataFrame({"src": query_ids[at:at + step][rows[keep]], "dst": named[keep], "distance": values[keep]}))
    return pd.concat(found)


def _block_search(k: int):
    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"src": [], "dst": [], "distance": []})
        return _nearest_in_block(
            queries["id"].to_numpy(), _matrix(queries["x"]), candidates["members"].tolist(), _matrix(candidates["x"]),
            k, queries["radius"].to_numpy(),
        )

    return search


def _spread(df: DataFrame, own: str, other: str, chunks: dict[str, dict[int, int]]) -> DataFrame:
    """Gives every row its own chunk of the cell and repeats it for each chunk of the other side."""
    own_n, other_n = (
        F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in chunks[side].items() for v in kv]), F.col("cell")), F.lit(1))
        for side in (own, other)
    )
    return df.withColumn(f"{own}_chunk", F.pmod(F.xxhash64("id"), own_n.cast("bigint")).cast("int")).withColumn(
        f"{other}_chunk", F.explode(F.sequence(F.lit(0), (other_n - 1).cast("int")))
    )


def _chunk_counts(df: DataFrame) -> dict[int, int]:
    """Chunks per cell so that a chunk has about BLOCK_ROWS rows; at most MAX_PIVOTS rows come back."""
    return {r[0]: -(-r[1] // BLOCK_ROWS) for r in df.groupBy("cell").count().collect()}


def _search_cells(queries: DataFrame, candidates: DataFrame, k: int, id_type: str) -> DataFrame:
    # the "+1" keeps the map literal non-empty when a side has no rows
    chunks = {"q": {-1: 1, **_chunk_counts(queries)}, "c": {-1: 1, **_chunk_counts(candidates)}}
    keys = ["cell", "q_chunk", "c_chunk"]
    left = _spread(queries.select("cell", "id", "x", "radius"), "q", "c", chunks).groupBy(*keys)
    right = _fresh(_spread(candidates.select("cell", "id", "x", "members"), "c", "q", chunks)).groupBy(*keys)
    return left.cogroup(right).applyInPandas(
        _block_search(k), schema=f"src {id_type}, dst {id_type}, distance double"
    )


def _best(df: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("src").orderBy("distance", "dst")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn_graph(df: DataFrame, k: int = 15, id_col: str = "id", features_col: str = "features") -> DataFrame:
    """Edges (src, dst, distance, rank) to the k nearest other rows, ties by the smaller id. Ids must be unique.

    Memory per task is bounded by the block size; the driver holds the pivots (at most MAX_PIVOTS vectors).
    """
    pts = as_double_array(df.select(q(id_col).alias("id"), q(features_col).alias("x0")), "x0").withColumnRenamed("x0", "x")
    id_type = dict(pts.dtypes)["id"]
    want = k + 1  # a row finds itself among the copies of its own point
    # Copies of one point: only the k+1 smallest ids can be among anyone's nearest. The rank filter is applied
    # before the shuffle too, so a point shared by a third of all rows leaves each map task as k+1 rows.
    rank = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    distinct = (
        pts.withColumn("_r", rank).filter(F.col("_r") <= want)
        .groupBy("x").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("members"))
    ).persist()
    n = distinct.count()
    if n == 0:
        return pts.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))
    wanted_pivots = max(1, min(MAX_PIVOTS, n // CELL_ROWS))
    pivots = np.array(
        [r["x"] for r in distinct.orderBy(F.xxhash64("id"), "id").limit(wanted_pivots).select("x").collect()], dtype=float
    )
    celled = _assign_cells(distinct, pivots).persist()
    radii_rows = celled.groupBy("cell").agg(F.max("to_pivot").alias("r")).collect()
    radii = np.full(len(pivots), -np.inf)
    for r in radii_rows:
        radii[r["cell"]] = r["r"]

    own = celled.withColumn("radius", F.lit(float("inf")))
    found = _search_cells(own, celled, want, id_type)
    if len(pivots) > 1:
        found = found.persist()
        reach = found.groupBy("src").agg(
            F.when(F.count(F.lit(1)) >= want, F.max("distance")).otherwise(F.lit(float("inf"))).alias("radius")
        )
        seekers = celled.join(reach, F.col("id") == F.col("src")).select("id", "x", "cell", "radius")
        seekers = seekers.persist()
        if _n_visits(seekers, pivots, radii) > MANY_CELLS * n * len(pivots):
            others = _search_packed(seekers, celled, want, (_pack_count(n),) * 2, id_type)
        else:
            others = _search_cells(_cells_to_visit(seekers, pivots, radii, id_type).persist(), celled, want, id_type)
        found = found.unionByName(others)
    nearest = (
        _best(found, want).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("distance", "dst"))).alias("near"))
    )
    # back to every copy: its list is that of its point without itself
    rep = distinct.select(F.col("x").alias("_x"), F.col("id").alias("_rep"))
    members = pts.join(rep, F.col("x") == F.col("_x")).select(F.col("id").alias("_id"), "_rep")
    others = F.slice(F.filter("near", lambda e: e["dst"] != F.col("_id")), 1, k)
    return (
        members.join(nearest, F.col("_rep") == F.col("src"))
        .select(F.col("_id").alias("src"), F.posexplode(others).alias("pos", "e"))
        .select("src", F.col("e.dst").alias("dst"), F.col("e.distance").alias("distance"), (F.col("pos") + 1).alias("rank"))
    )


def nearest_rows(queries: DataFrame, df: DataFrame, k: int = 15, id_col: str = "id", features_col: str = "features") -> DataFrame:
    """Edges (src, dst, distance, rank) from some rows to the k nearest other rows of the whole table, by brute force: every query
    meets every row. Ties by the smaller id. Ids must be unique."""
    sides = [
        as_double_array(rows.select(q(id_col).alias("id"), q(features_col).alias("x")), "x").withColumn("cell", F.lit(cell))
        for cell, rows in enumerate((queries, df))
    ]
    asked, held = sides[0].withColumn("radius", F.lit(float("inf"))), sides[1].withColumn("members", F.array("id"))
    blocks = max(1, -(-queries.count() // PACK_ROWS)), _pack_count(df.count())
    found = _search_packed(asked, held, k + 1, blocks, dict(held.dtypes)["id"])
    return _best(found.where(F.col("src") != F.col("dst")), k)


def _assign_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                dist = _distances(_matrix(batch["x"]), pivots)
                batch["cell"] = dist.argmin(axis=1).astype("int32")
                batch["to_pivot"] = dist.min(axis=1)
                yield batch

    schema = T.StructType(df.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("to_pivot", T.DoubleType())])
    return df.mapInPandas(assign, schema)


def _cells_in_reach(batches: Iterator[pd.DataFrame], pivots: np.ndarray, radii: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows in turns of bounded size, with a matrix: the other cells that may hold a neighbour within the row's radius."""
    # P x P distances are cheaper to compute per task than to ship
    between = _distances(pivots, pivots)
    np.fill_diagonal(between, np.inf)
    step = max(16, 1_000_000 // len(pivots))
    for whole in batches:
        for at in range(0, len(whole), step):
            batch = whole.iloc[at:at + step]
            dist = _distances(_matrix(batch["x"]), pivots)
            cell = batch["cell"].to_numpy()
            own = dist[np.arange(len(batch)), cell][:, None]
            ball = dist - radii[None, :]
            gap = np.maximum(between[cell], 1e-300)
            bisector = (dist * dist - own * own) / (2.0 * gap)
            # rounding may lift a bound by a few ulps, so it is lowered before it may exclude a cell
            bound = np.maximum(ball, bisector) - 1e-9 * (1.0 + dist)
            near = (bound <= batch["radius"].to_numpy()[:, None]) & (radii >= 0)[None, :]
            near[np.arange(len(batch)), cell] = False
            yield batch, near


def _n_visits(df: DataFrame, pivots: np.ndarray, radii: np.ndarray) -> int:
    """(point, other cell) pairs of `_cells_to_visit`."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"n": [sum(int(near.sum()) for _, near in _cells_in_reach(batches, pivots, radii))]})

    return df.mapInPandas(count, "n long").agg(F.sum("n")).first()[0] or 0


def _cells_to_visit(df: DataFrame, pivots: np.ndarray, radii: np.ndarray, id_type: str) -> DataFrame:
    """One row per (point, other cell) that may hold a neighbour within the point's radius."""

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, near in _cells_in_reach(batches, pivots, radii):
            ids, xs, reach = (batch[c].to_numpy() for c in ("id", "x", "radius"))
            rows, cells = np.nonzero(near)
            for at in range(0, len(rows), HANDED):
                r, c = rows[at:at + HANDED], cells[at:at + HANDED]
                yield pd.DataFrame({"cell": c.astype("int32"), "id": ids[r], "x": list(xs[r]), "radius": reach[r]})

    return df.mapInPandas(visit, f"cell int, id {id_type}, x array<double>, radius double")


def _pack_count(n: int) -> int:
    """Packed blocks of a table: large ones ship less, but there should be enough for all cores."""
    return max(1, -(-n // PACK_ROWS), min(PACKS, n // 512))


def _search_packed(queries: DataFrame, candidates: DataFrame, k: int, blocks: tuple[int, int], id_type: str) -> DataFrame:
    """Neighbours within a query's radius in all cells but its own, by pairs of blocks (so many of queries, of candidates)."""
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in blocks]

    def packed(df: DataFrame, blocks: int, more: str, kind: str) -> DataFrame:
        def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            row = {"block": [key[0]], "ids": [part["id"].tolist()], "x": [_matrix(part["x"]).tobytes()], "cell": [part["cell"].to_numpy("int32").tobytes()]}
            return pd.DataFrame({**row, more: [part[more].tolist()]})

        rows = df.select("id", "x", "cell", more).withColumn("block", F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).cast("int"))
        return rows.groupBy("block").applyInPandas(pack, f"block int, ids array<{id_type}>, x binary, cell binary, {more} array<{kind}>")

    left = packed(queries, blocks[0], "radius", "double").withColumnRenamed("block", "a").withColumn("b", every[1])
    right = packed(candidates, blocks[1], "members", f"array<{id_type}>").withColumnRenamed("block", "b").withColumn("a", every[0])

    def search(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"src": [], "dst": [], "distance": []})
        one, two = one.iloc[0], two.iloc[0]
        a, b = (np.frombuffer(r["x"]).reshape(len(r["ids"]), -1) for r in (one, two))
        cells = tuple(np.frombuffer(r["cell"], np.int32) for r in (one, two))
        return _nearest_in_block(np.asarray(one["ids"]), a, list(two["members"]), b, k, np.asarray(one["radius"], float), cells)

    return left.groupBy("a", "b").cogroup(_fresh(right).groupBy("a", "b")).applyInPandas(search, f"src {id_type}, dst {id_type}, distance double")


# ---------------------------------------------------------------- silhouette


def _tile_sums(a: np.ndarray, b: np.ndarray, hot_a: np.ndarray, hot_b: np.ndarray, mirrored: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of distances from every row of a to the clusters of b, and back if `mirrored`; `hot` are labels as columns of 0 and 1.

    A tile of squared distances is one matrix product. Pairs so near that its rounding would show, copies among them, are
    computed again difference by difference.
    """
    middle = a.mean(axis=0)
    left, _, na = _lifted(a, middle)
    _, right, nb = _lifted(b, middle)
    to_b, to_a = np.zeros((len(a), hot_b.shape[1])), np.zeros((len(b), hot_a.shape[1]))
    for i in range(0, len(a), TILE[0]):
        rows = slice(i, i + TILE[0])
        for j in range(0, len(b), TILE[1]):
            cols = slice(j, j + TILE[1])
            gaps = left[rows] @ right[cols].T
            close = gaps <= 1e-7 * (na[rows].max() + nb[cols].max())
            if close.any():
                r, c = np.nonzero(close)
                gaps[r, c] = _exact(a[rows], b[cols], r, c)
            np.sqrt(gaps, out=gaps)
            to_b[rows] += gaps @ hot_b[cols]
            if mirrored:
                to_a[cols] += gaps.T @ hot_a[rows]
    return to_b, to_a


def _groups(blocks: list[int], cores: int, width: int) -> list[tuple[list[int], list[int]]]:
    """Pairs of groups of blocks, so that every pair of blocks is met once and a task's sums (`width` numbers a row) are bounded."""
    wanted = max(GROUPS, math.isqrt(2 * TASKS_A_CORE * cores))
    size = max(1, min(-(-len(blocks) // wanted), SUMS_HELD // (2 * PACK_ROWS * width * 8)))
    groups = [blocks[i:i + size] for i in range(0, len(blocks), size)]
    return [(one, two) for i, one in enumerate(groups) for two in groups[i:]]


def _pair_sums(folder: str, widths: list[int], tasks: list[tuple[list[int], list[int]]]):
    """Sums of distances from each point to each cluster of each labelling, for all pairs of blocks of two groups."""
    total = sum(widths)
    starts = np.concatenate([[0], np.cumsum(widths)[:-1]]).astype(int)

    def block(at: int) -> tuple[np.ndarray, np.ndarray]:
        labels = mapped(f"{folder}/labels", str(at), "i4").reshape(-1, len(widths))
        hot = np.zeros((len(labels), total))
        for j, start in enumerate(starts):
            hot[np.arange(len(labels)), start + labels[:, j]] = 1.0
        return np.asarray(mapped(f"{folder}/x", str(at), "f8")).reshape(len(labels), -1), hot

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two in (tasks[at] for b in batches for at in b.column("id").to_pylist()):
            sums: dict[int, np.ndarray] = {}
            for i in one:
                a, hot_a = block(i)
                for j in (j for j in two if j >= i):
                    b, hot_b = block(j)
                    # the mirrored pair of blocks is not visited
                    there, back = _tile_sums(a, b, hot_a, hot_b, mirrored=i != j)
                    for at, part in ((i, there), (j, back))[:1 + (i != j)]:
                        sums[at] = sums[at] + part if at in sums else part
            for at in list(sums):
                yield pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "sums": pa.array([sums.pop(at).tobytes()], pa.binary())})

    return work


def silhouette_samples(
    df: DataFrame, label_cols: list[str], id_col: str = "id", features_col: str = "features", metric: str = "squared",
    n_rows: int | None = None,
) -> DataFrame:
    """Silhouette per row and labelling (columns `silhouette_<label>`); labels are 0..K-1.

    The work for `euclidean` is quadratic in the rows, for `squared` linear.
    """
    if metric == "squared":
        return _squared_samples(df, label_cols, id_col, features_col)
    if metric != "euclidean":
        raise ValueError(f"unknown metric {metric}")
    return _euclidean_samples(df, label_cols, id_col, features_col, df.count() if n_rows is None else n_rows)


def _squared_samples(df: DataFrame, label_cols: list[str], id_col: str, features_col: str) -> DataFrame:
    """Per-row silhouette under the squared metric, from cluster sums alone.

    The squared distances of x to the n rows of a cluster add up to n |x|^2 - 2 x.sum + (sum of squared norms).
    """
    rows = as_double_array(df.select(q(id_col), q(features_col).alias("x"), *[q(c).cast("int").alias(c) for c in label_cols]), "x")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    rows = rows.withColumn("_norm", dot(F.col("x"), F.col("x")))
    for c in label_cols:
        stats = rows.groupBy(c).agg(
            vector_to_array(Summarizer.sum(array_to_vector(F.col("x")))).alias("total"),
            F.sum("_norm").alias("norms"), F.count(F.lit(1)).alias("n"),
        )
        packed = stats.agg(F.collect_list(F.struct(F.col(c).alias("label"), "total", "norms", "n")).alias("cs")).first()["cs"]  # K structs
        sizes = [0] * (1 + max(p["label"] for p in packed))
        parts = {p["label"]: p for p in packed}
        for p in packed:
            sizes[p["label"]] = p["n"]
        for j in range(len(sizes)):
            if j in parts:
                center = F.array(*[F.lit(float(v)) for v in parts[j]["total"]])
                total = F.greatest(F.col("_norm") * sizes[j] - 2.0 * dot(F.col("x"), center) + parts[j]["norms"], F.lit(0.0))
            else:
                total = F.lit(0.0)
            rows = rows.withColumn(f"_s{j}", total)
        names = [f"_s{j}" for j in range(len(sizes))]
        rows = rows.withColumn(f"silhouette_{c}", _silhouette_value(names, sizes, F.col(c))).drop(*names)
    return rows.select(q(id_col), *[F.col(f"silhouette_{c}") for c in label_cols])


def _euclidean_samples(df: DataFrame, label_cols: list[str], id_col: str, features_col: str, n: int) -> DataFrame:
    """All labellings share one pass over the distances."""
    pts = as_double_array(
        df.select(q(id_col).alias("id"), q(features_col).alias("x"), F.array(*[q(c).cast("int") for c in label_cols]).alias("labels")),
        "x",
    )
    sizes = cluster_sizes(df, label_cols)
    widths = [len(sizes[c]) for c in label_cols]
    blocks, total, id_type = _pack_count(n), sum(widths), dict(pts.dtypes)["id"]
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = shared_path(spark, "silhouette")

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x, labels = _matrix(part["x"]), np.stack(part["labels"].to_numpy()).astype(np.int32)
        # a task that is run again stores its rows in the same order, which is that of the sums
        order = np.lexsort((*labels.T, *x.T, pd.factorize(part["id"], sort=True)[0]))
        stored(f"{folder}/x", str(key[0]), x[order])
        stored(f"{folder}/labels", str(key[0]), labels[order])
        return pd.DataFrame({"block": [key[0]], "ids": [part["id"].iloc[order].tolist()]})

    numbered = pts.withColumn("block", F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).cast("int"))
    packs = numbered.groupBy("block").applyInPandas(pack, f"block int, ids array<{id_type}>").checkpoint()
    held = sorted(r["block"] for r in packs.select("block").collect())  # one row a block
    tasks = _groups(held, spark.sparkContext.defaultParallelism, total)
    names = [f"s{i}" for i in range(total)]
    pairs = spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(_pair_sums(folder, widths, tasks), "block int, sums binary")

    def unpack(key: tuple, one: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        added = np.sum([np.frombuffer(s).reshape(-1, total) for s in parts["sums"]], axis=0)
        out = pd.DataFrame(added, columns=names)
        out.insert(0, "id", pd.Series(list(one["ids"].iloc[0]), dtype=object if id_type == "string" else None))
        return out

    sums = (
        packs.groupBy("block").cogroup(pairs.groupBy("block"))
        .applyInPandas(unpack, f"id {id_type}, " + ", ".join(f"{s} double" for s in names))
        .groupBy("id").agg(*[F.sum(s).alias(s) for s in names])
    ).checkpoint()
    removed(spark, folder)
    out = sums.join(pts.select(F.col("id").alias("_id"), "labels"), F.col("id") == F.col("_id")).drop("_id")
    start = 0
    for j, c in enumerate(label_cols):
        out = out.withColumn(f"silhouette_{c}", _silhouette_value(names[start:start + widths[j]], sizes[c], F.col("labels")[j]))
        start += widths[j]
    return out.select(F.col("id").alias(id_col), *[F.col(f"silhouette_{c}") for c in label_cols])


def cluster_sizes(df: DataFrame, label_cols: list[str]) -> dict[str, list[int]]:
    """Rows per label 0..K-1 and labelling, from one aggregate (a row per label combination stays on executors)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), q(c).cast("int").alias("v")) for c in label_cols]))
    rows = df.select(pairs.alias("p")).groupBy("p.c", "p.v").count().collect()
    out = {c: [0] * (1 + max(r["v"] for r in rows if r["c"] == c)) for c in label_cols}
    for r in rows:
        out[r["c"]][r["v"]] = r["count"]
    return out


def _silhouette_value(sum_cols: list[str], sizes: list[int], label):
    counts = F.array(*[F.lit(float(s)) for s in sizes])
    sums = F.array(*[F.col(s) for s in sum_cols])
    own_n = F.element_at(counts, label + 1)
    inside = F.try_divide(F.element_at(sums, label + 1), own_n - 1)
    means = F.transform(
        F.arrays_zip(sums.alias("s"), counts.alias("n")),
        lambda e, i: F.when(i != label, F.try_divide(e["s"], e["n"])),
    )
    outside = F.array_min(means)
    return F.when(own_n <= 1, 0.0).otherwise(
        F.coalesce(F.try_divide(outside - inside, F.greatest(outside, inside)), F.lit(0.0))
    )


def silhouette_scores(
    df: DataFrame, label_cols: list[str], id_col: str = "id", features_col: str = "features", metric: str = "squared"
) -> dict[str, float | None]:
    """Mean silhouette of all rows per labelling. One populated cluster gives None."""
    sizes = cluster_sizes(df, label_cols)
    usable = [c for c in label_cols if sum(s > 0 for s in sizes[c]) > 1]
    out: dict[str, float | None] = {c: None for c in label_cols}
    if usable:
        row = silhouette_samples(df, usable, id_col, features_col, metric).agg(
            *[F.avg(f"silhouette_{c}").alias(c) for c in usable]
        ).first()
        out.update({c: row[c] for c in usable})
    return out


# ---------------------------------------------------------------- Davies-Bouldin, inertia


def cluster_scatter(df: DataFrame, label_col: str, features_col: str = "features") -> DataFrame:
    """Per cluster: centroid, rows, mean distance to the centroid and summed squared distance.

    Two aggregates that combine on the map side; only K centroids are joined back to the rows.
    """
    rows = as_double_array(df.select(q(label_col).alias("label"), q(features_col).alias("x")), "x")
    centroids = rows.groupBy("label").agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col("x")))).alias("centroid"), F.count(F.lit(1)).alias("n_rows")
    )
    gap = squared_distance(F.col("x"), F.col("centroid"))
    spread = (
        rows.join(F.broadcast(centroids), "label").groupBy("label")
        .agg(F.avg(F.sqrt(gap)).alias("mean_distance"), F.sum(gap).alias("squared_sum"))
    )
    return centroids.join(spread, "label")


def davies_bouldin(df: DataFrame, label_col: str, features_col: str = "features") -> DataFrame:
    """One row: the index (0 for a single cluster) and the inertia of the labelling."""
    per = cluster_scatter(df, label_col, features_col)
    packed = per.agg(
        F.collect_list(F.struct("label", "centroid", "mean_distance")).alias("cs"), F.sum("squared_sum").alias("inertia")
    )  # K structs

    def worst(c):
        ratios = F.transform(
            F.filter("cs", lambda o: o["label"] != c["label"]),
            lambda o: F.try_divide(
                c["mean_distance"] + o["mean_distance"], F.sqrt(squared_distance(c["centroid"], o["centroid"]))
            ),
        )
        return F.coalesce(F.array_max(ratios), F.lit(0.0))

    index = F.aggregate(F.transform("cs", worst), F.lit(0.0), lambda s, v: s + v) / F.size("cs")
    return packed.select(index.alias("davies_bouldin"), "inertia")
