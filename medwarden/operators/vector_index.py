"""A stored inverted-file index for vector search.

Centroids are trained by k-means on unit vectors; each vector goes to the list of its nearest
centroid and is stored there with its norm. A search reads the lists of a query's nearest centroids
and ranks what they hold by exact cosine. ``probes=None`` reads all lists and is the exact search.

A search compares blocks of queries with blocks of vectors, a pair of blocks a task's group: a matrix
product names what may be among the ``k`` nearest, and only of that the exact cosine is taken.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Mapping
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from medwarden.operators.search import dot

# Vectors that the centroids are trained on at most, taken by a hash of their id. Every vector is
# indexed, whether it was among them or not.
TRAINED = 100_000
# Lists, and so centroids, at most: what is broadcast is bounded by this.
MAX_LISTS = 16_384
# Vectors and queries of a block, about: what a task holds of either side.
BLOCK_VECTORS, BLOCK_QUERIES = 8_192, 2_048
# Queries multiplied at once, and pairs whose exact cosines are taken at once.
_ROWS, _PAIRS = 256, 1 << 16
# More than a matrix product of unit vectors and the exact cosine can differ by.
_SLACK = 1e-9
_SEED = 42

# Functions travel with the task, so executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _unit(vector: Column, norm: Column) -> Column:
    return F.transform(vector, lambda x: x / norm)


def _normed(vectors: DataFrame, vector_col: str, *keep: str) -> DataFrame:
    """(*keep, vector, norm) with doubles; the norm is NULL for a vector without length."""
    rows = vectors.select(*keep, F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.withColumn("norm", F.nullif(F.sqrt(dot("vector", "vector")), F.lit(0.0)))


def train_centroids(vectors: DataFrame, id_col: str, vector_col: str, lists: int, trained: int = TRAINED) -> np.ndarray:
    """(lists, dimensions) unit centroids of at most ``trained`` vectors, picked by a hash of the id."""
    normed = _normed(vectors, vector_col, id_col).filter(F.col("norm").isNotNull())
    total = normed.count()
    if not total:
        return np.zeros((0, 0))
    if min(lists, total) == 1:
        # Whatever the one centroid is, all vectors are nearest to it.
        one = np.array([normed.select("vector").first().vector])
        return one / np.linalg.norm(one)
    share = min(1.0, trained / total)
    picked = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = normed.filter(picked).limit(trained) if share < 1 else normed
    # A limit leaves one partition, and small tables come as one file: all cores train.
    rows = rows.repartition(vectors.sparkSession.sparkContext.defaultParallelism)
    features = rows.select(array_to_vector(_unit(F.col("vector"), F.col("norm"))).alias("features"))
    model = KMeans(k=min(lists, total), distanceMeasure="cosine", seed=_SEED, maxIter=20).fit(features)
    found = np.array(model.clusterCenters())
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _nearest(vector: Column, centroids: np.ndarray, n: int) -> Column:
    """The ``n`` nearest centroids, nearest first, of vectors of any length but none."""

    @F.arrow_udf("array<int>")
    def nearest(batch: pa.Array) -> pa.Array:
        if not len(batch):
            return pa.array([], pa.list_(pa.int32()))
        matrix = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        close = matrix @ centroids.T
        order = np.argsort(-close, axis=1, kind="stable")[:, :n]
        return pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))

    return nearest(vector)


def build_vector_index(
    vectors: DataFrame,
    root: str,
    id_col: str = "case_id",
    vector_col: str = "embedding",
    lists: int | None = None,
    trained: int = TRAINED,
) -> None:
    """Write the index of ``vectors`` to folder ``root``: centroids, and the vectors by list.

    ``lists`` defaults to the square root of the number of vectors. Vectors without length or NULL
    are in list -1, which is read by exact searches only, as they are near to nothing. Adaptive
    execution cuts the files of a large list.
    """
    spark = vectors.sparkSession
    if lists is None:
        lists = max(1, int(vectors.count() ** 0.5))
    centroids = train_centroids(vectors, id_col, vector_col, min(lists, MAX_LISTS), trained)
    # At most MAX_LISTS rows, from the driver's own model.
    rows = [(i, c.tolist()) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "list int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{root}/centroids")
    normed = _normed(vectors, vector_col, F.col(id_col).alias("id"))
    none = normed.filter(F.col("norm").isNull()).withColumn("list", F.lit(-1))
    if len(rows):
        some = normed.filter(F.col("norm").isNotNull())
        placed = some.withColumn("list", F.get(_nearest(F.col("vector"), centroids, 1), F.lit(0))).union(none)
    else:
        placed = none
    placed.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{root}/lists")
    form = spark.createDataFrame([(placed.schema.json(),)], "schema string")
    form.coalesce(1).write.mode("overwrite").parquet(f"{root}/form")


def _probed(vector: Column, centroids: np.ndarray, n: int, dealt: Mapping[int, tuple[int, int]]) -> Column:
    """The blocks that hold lists of the ``n`` nearest centroids, each with those lists."""

    @F.arrow_udf("array<struct<block: int, lists: array<int>>>")
    def probed(batch: pa.Array) -> pa.Array:
        form = pa.list_(pa.struct([("block", pa.int32()), ("lists", pa.list_(pa.int32()))]))
        found = []
        if len(batch):
            matrix = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            for near in np.argsort(-(matrix @ centroids.T), axis=1, kind="stable")[:, :n].tolist():
                held: dict[int, list[int]] = {}
                for at in near:
                    first, parts = dealt.get(at, (0, 0))
                    for block in range(first, first + parts):
                        held.setdefault(block, []).append(at)
                found.append([{"block": b, "lists": some} for b, some in held.items()])
        return pa.array(found, form)

    return probed(vector)


def _dealt(sizes: Mapping[int, int]) -> dict[int, tuple[int, int]]:
    """For each list its first block and the number of its blocks; small lists share one."""
    found, block, held = {}, 0, 0
    for at, n in sorted(sizes.items()):
        parts = max(1, ceil(n / BLOCK_VECTORS))
        if held and held + n > BLOCK_VECTORS:
            block, held = block + 1, 0
        found[at] = (block, parts)
        block, held = (block + parts, 0) if parts > 1 else (block, held + n)
    return found


def _first(q: np.ndarray, v: np.ndarray, close: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` pairs of each query that are closest; ties go by the number of the vector."""
    order = np.lexsort((v, -close, q))
    q, v, close = q[order], v[order], close[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[kept], v[kept], close[kept]


class _Side:
    """Vectors of a block as a matrix; ``has`` tells which of them have a length."""

    def __init__(self, rows: pa.Table, dim: int):
        self.has = rows["norm"].is_valid().to_numpy()
        self.norm = rows["norm"].to_numpy()
        self.vector = np.zeros((len(self.has), dim))
        flat = rows["vector"].filter(rows["norm"].is_valid()).combine_chunks().flatten()
        self.vector[self.has] = flat.to_numpy(zero_copy_only=False).reshape(self.has.sum(), dim)
        with np.errstate(all="ignore"):
            # A length beyond a double's range leaves no bound: such vectors are always looked at.
            self.unit = np.where(np.isfinite(self.norm)[:, None], self.vector / self.norm[:, None], np.nan)


def _closest(asked: _Side, vectors: _Side, q_at: np.ndarray, v_at: np.ndarray, k: int) -> list[tuple]:
    """Of queries ``q_at`` among vectors ``v_at`` the ``k`` closest, as (query, vector, cosine) arrays.

    The products are summed in their order, as ``dot`` does. -inf stands for NULL, inf for NaN, which
    Spark sorts so.
    """
    found = []
    unit, has = vectors.unit[v_at].T, vectors.has[v_at]
    for start in range(0, len(q_at), _ROWS):
        rows = q_at[start : start + _ROWS]
        near = asked.unit[rows] @ unit
        near[:, ~has] = -np.inf
        near[~asked.has[rows]] = -np.inf
        least = np.partition(near, max(0, len(v_at) - k), axis=1)[:, max(0, len(v_at) - k)]
        i, j = np.nonzero(~(near < (least - _SLACK)[:, None]))
        q, v = rows[i], v_at[j]
        close = np.full(len(q), -np.inf)
        for at in range(0, len(q), _PAIRS):
            qs, vs = q[at : at + _PAIRS], v[at : at + _PAIRS]
            both = asked.has[qs] & vectors.has[vs]
            qs, vs = qs[both], vs[both]
            if len(qs):
                with np.errstate(all="ignore"):
                    total = np.cumsum(vectors.vector[vs] * asked.vector[qs], axis=1)[:, -1] + 0.0
                    cosine = total / (vectors.norm[vs] * asked.norm[qs])
                close[at : at + _PAIRS][both] = np.where(np.isnan(cosine), np.inf, cosine)
        found.append(_first(q, v, close, k))
    return found


def _compare(dim: int, k: int, schema: pa.Schema):
    def compare(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        """The ``k`` nearest vectors of a block for each of a block of queries."""
        if not vectors.num_rows or not asked.num_rows:
            return schema.empty_table()
        # In the order of the ids, so that a tie goes to the smaller row number.
        vectors = vectors.take(pc.sort_indices(vectors["id"], null_placement="at_start"))
        left, right = _Side(asked, dim), _Side(vectors, dim)
        of = vectors["list"].to_numpy()
        found = []
        if asked["lists"].null_count:
            found += _closest(left, right, np.arange(len(left.has)), np.arange(len(of)), k)
        else:
            lists = asked["lists"].combine_chunks()
            row = lists.value_parent_indices().to_numpy()
            probed = lists.flatten().to_numpy()
            for at in np.unique(of):
                found += _closest(left, right, row[probed == at], np.flatnonzero(of == at), k)
        q, v, close = _first(*map(np.concatenate, zip(*found, strict=True)), k)
        cosine = pa.array(np.where(close == np.inf, np.nan, close), pa.float64(), mask=close == -np.inf)
        return pa.table([asked["query_id"].take(pa.array(q)), vectors["id"].take(pa.array(v)), cosine], schema=schema)

    return compare


def search_vector_index(
    spark: SparkSession,
    root: str,
    queries: DataFrame,
    k: int = 5,
    probes: int | float | None = None,
    id_col: str = "case_id",
) -> DataFrame:
    """(query_id, ``id_col``, similarity, rank): the ``k`` nearest vectors of each query by cosine.

    Queries are rows (query_id, embedding). ``probes`` is a number of lists, or a share of them below
    1; how many are needed depends on how far the vectors fall into clusters, so measure recall
    against ``probes=None``. Only lists that a query probes are read; of those, each
    block keeps ``k`` rows a query before the ranking. Ties go by id. A query without length finds
    vectors only in an exact search, at similarity NULL.
    """
    # At most MAX_LISTS rows.
    stored = spark.read.schema("list int, vector array<double>").parquet(f"{root}/centroids").orderBy("list").collect()
    centroids = np.array([r.vector for r in stored])
    form = T.StructType.fromJson(json.loads(spark.read.parquet(f"{root}/form").first().schema))
    lists = spark.read.schema(form).parquet(f"{root}/lists")
    dim = centroids.shape[1] if len(stored) else 0
    asked = _normed(queries, "embedding", "query_id")
    # Vectors of another length than the index's are near to nothing, like those without length.
    has = F.col("norm").isNotNull() & (F.size("vector") == dim)
    if probes is None or not len(stored):
        at = None
        asked = asked.withColumns({c: F.when(has, F.col(c)) for c in ("vector", "norm")})
    else:
        n = ceil(probes * len(stored)) if probes < 1 else int(probes)
        asked = asked.filter(F.col("norm").isNotNull())
        # At most MAX_LISTS numbers: the folders that are read.
        near = F.explode(_nearest(F.col("vector"), centroids, n)).alias("list")
        at = [r[0] for r in asked.select(near).distinct().collect()]
        lists = lists.filter(F.col("list").isin(at))
    # At most MAX_LISTS rows and one.
    dealt = _dealt({r["list"]: r["count"] for r in lists.groupBy("list").count().collect()})
    blocks = max((first + parts for first, parts in dealt.values()), default=0)
    parts = max(1, ceil(queries.count() / BLOCK_QUERIES))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    if at is None:
        every = F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))
        asked = asked.select("*", F.explode(every).alias("block"), F.lit(None).cast("array<int>").alias("lists"))
    else:
        asked = asked.select("*", F.inline(_probed(F.col("vector"), centroids, n, dealt)))
    where = spark.createDataFrame([(a, f, p) for a, (f, p) in dealt.items()], "list int, first int, parts int")
    held = lists.join(F.broadcast(where), "list").select(
        "id", "list", F.when(F.col("norm").isNotNull(), F.col("vector")).alias("vector"), "norm",
        (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
    )
    out = T.StructType(
        [
            T.StructField("query_id", asked.schema["query_id"].dataType),
            T.StructField("id", form["id"].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    pairs = held.groupBy("block", "part").cogroup(asked.groupBy("block", "part"))
    best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), "id")
    return (
        pairs.applyInArrow(_compare(dim, k, to_arrow_schema(out)), out)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("id").alias(id_col), F.round("similarity", 6).alias("similarity"), "rank")
    )
