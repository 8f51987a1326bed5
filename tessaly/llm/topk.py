"""Exact top-k by inner product: tiled matrix products and a tree of merges.

Queries are cut into tiles and candidates into shards of bounded size; each (tile, shard) cell is one matrix product with
a partial selection per query, and the cells' short lists are merged in a tree, so no task sees more than `fan` lists of
a query. Components become floor(256 * x) as integers; products are exact in doubles while they stay below 2**53, and
are done in Python integers beyond it (a score past 64 bits is held at the limit).

Cases: null vectors, and those with a null or non-finite component, take no part, nor do rows without an id; vectors
meet only vectors of their own length; a candidate with the query's id is the query's own row; a query id that repeats
is asked once, with its smallest vector, while repeated candidates all count; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import partitions

LONG = (-(1 << 63), (1 << 63) - 1)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of floor(256 * rows of a and b)."""
    with np.errstate(over="ignore"):
        x, y = np.floor(a * 256), np.floor(b * 256)
    top = max(1.0, np.abs(x).max(initial=0)) * max(1.0, np.abs(y).max(initial=0)) * max(1, a.shape[1])
    if top < 2**53:
        return (x @ y.T).astype(np.int64)
    whole = lambda m: [[math.floor(v * 256) if abs(v) < 2**900 else int(v) * 256 for v in r] for r in m.tolist()]
    x, y = whole(a), whole(b)
    return np.array([[min(max(sum(map(int.__mul__, p, q)), LONG[0]), LONG[1]) for q in y] for p in x], np.int64).reshape(len(x), len(y))


def best(ids: np.ndarray, queries: np.ndarray, own: np.ndarray, shard: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and scores of each query's k best candidates."""
    order = np.argsort(own, kind="stable")
    own, shard = own[order], shard[order]
    found = scores(queries, shard)
    if len(own) > k:  # any number of them may be the query's own, which go last
        rough = np.partition(np.where(ids[:, None] == own, LONG[0], found), len(own) - k, axis=1)[:, len(own) - k]
        q, c = np.nonzero(found >= rough[:, None])
    else:
        q, c = np.nonzero(np.ones(found.shape, bool))
    other = ids[q] != own[c]
    q, c = q[other], c[other]
    s = found[q, c]
    rank = np.lexsort((c, -s, q))
    q, c, s = q[rank], c[rank], s[rank]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return ids[q[keep]], own[c[keep]], s[keep]


def search(vectors: DataFrame, is_query: Column, k: int = 5, tile: int = 4096, shard: int = 16384, fan: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("x"), is_query.alias("q")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)) & ~F.isnan(e)))
    rows = rows.withColumn("dim", F.size("x"))
    n, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    shards, tiles = max(partitions(spark), -(-n // shard)), max(1, -(-asked // tile))
    place = lambda salt, m: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(m)).cast("int")
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = rows.where("q").groupBy("vec_id").agg(F.min("x").alias("x")).select("vec_id", "x", F.size("x").alias("dim"), place(1, tiles).alias("tile")).withColumn("shard", spread(shards))
    # A candidate's shard follows its place in the table, not its id or vector: copies of either spread out.
    candidates = rows.select(F.col("vec_id").alias("own_id"), F.col("x").alias("y"), F.col("dim").alias("dim_"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard_")).withColumn("tile_", spread(tiles))

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(a) and len(b):
            group = int(b["shard_"].iloc[0])
            ids, own = a["vec_id"].to_numpy(), b["own_id"].to_numpy()
            x, y = np.array(a["x"].tolist(), float).reshape(len(a), -1), np.array(b["y"].tolist(), float).reshape(len(b), -1)
            for at in range(0, len(ids), 256):
                got = best(ids[at : at + 256], x[at : at + 256], own, y, k)
                made.append(pd.DataFrame({"query_id": got[0], "vec_id": got[1], "score": got[2], "part": group}))
        return pd.concat(made) if made else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score", "part")})

    found = queries.groupBy("tile", "shard", "dim").cogroup(candidates.groupBy("tile_", "shard_", "dim_")).applyInPandas(cell, "query_id long, vec_id long, score long, part int")

    def merged(df: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "vec_id")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    while shards > fan:
        found = merged(found.withColumn("part", F.floor(F.col("part") / fan).cast("int")), "part").drop("rank")
        shards = -(-shards // fan)
    return merged(found).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
