"""Vector search: four metrics, exact and by inverted cells."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import isfinite

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from engram.runtime import materialize, scratch_path

METRICS = ("euclidean", "cosine", "inner_product", "manhattan")
EPSILON = float(np.finfo(np.float32).eps)


def _zip_sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str) -> Column:
    """Distance of two array<double> columns; the inner product counts negative, a vector without length is at cosine distance 1."""
    dot = lambda x, y: _zip_sum(x, y, lambda p, q: p * q)
    if metric == "euclidean":
        return F.sqrt(_zip_sum(a, b, lambda x, y: (x - y) * (x - y)))
    if metric == "manhattan":
        return _zip_sum(a, b, lambda x, y: F.abs(x - y))
    if metric == "inner_product":
        return -dot(a, b)
    if metric == "cosine":
        na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
        cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb)))
        return F.when((na < EPSILON) | (nb < EPSILON), 1.0).otherwise(1.0 - cos)
    raise ValueError(f"no metric {metric}")


def distances(vectors: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """The same for matrices: one row a query."""
    v, q = vectors.astype(np.float64), queries.astype(np.float64)
    if metric == "euclidean":
        return np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * q @ v.T))
    if metric == "inner_product":
        return -(q @ v.T)
    if metric == "cosine":
        nq, nv = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            out = 1 - np.clip(q @ v.T / (nq[:, None] * nv[None]), -1, 1)
        out[nq < EPSILON] = 1.0
        out[:, nv < EPSILON] = 1.0
        return out
    if metric == "manhattan":
        return np.stack([np.abs(v - x).sum(1) for x in q]) if len(q) else np.zeros((0, len(v)))
    raise ValueError(f"no metric {metric}")


def bf16(values: np.ndarray) -> np.ndarray:
    """Round to the nearest 16-bit brain float, ties to even."""
    bits = np.asarray(values, dtype=np.float32).view(np.uint32).astype(np.uint64)
    return (((bits + 0x7FFF + ((bits >> 16) & 1)) & 0xFFFF0000).astype(np.uint32)).view(np.float32)


@F.pandas_udf(ArrayType(FloatType()))
def quantize_bf16(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else bf16(np.array(x, dtype=np.float32)))


def _valid(query: Sequence[float], dim: int | None) -> list[float]:
    q = [float(x) for x in query]
    if not all(map(isfinite, q)) or dim is not None and len(q) != dim:
        raise ValueError("the query must be finite and as long as the vectors")
    return q


def knn(df: DataFrame, query: Sequence[float], k: int, *, key: str = "_id", vector: str = "embedding", metric: str = "euclidean", dim: int | None = None) -> DataFrame:
    """(key, distance) of the k nearest, least distance first, then least key. Null vectors and those of another length are left out."""
    q = _valid(query, dim)
    if k <= 0:
        return df.select(key, F.lit(0.0).alias("distance")).limit(0)
    rows = df.filter(F.size(vector) == len(q)).select(key, distance(F.col(vector).cast("array<double>"), F.array(*[F.lit(x) for x in q]), metric).alias("distance"))
    return rows.orderBy("distance", key).limit(k)


def _top(metric: str, k: int, known, key: str, vector: str, at_once: int = 1_000):
    """The best k of a partition for each query of a broadcast block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = known.value
        blocks = [(matrix[i : i + at_once], np.full((len(matrix[i : i + at_once]), 0), np.inf), np.zeros((len(matrix[i : i + at_once]), 0), dtype=np.int64)) for i in range(0, len(ids), at_once)]
        for pdf in batches:
            pdf = pdf[pdf[vector].map(lambda v: v is not None and len(v) == matrix.shape[1])]
            if not len(pdf):
                continue
            rows, keys = np.stack(pdf[vector].to_numpy()), pdf[key].to_numpy()
            for b, (asked, best_d, best_k) in enumerate(blocks):
                d = distances(rows, asked, metric)
                best_d, best_k = np.hstack([best_d, d]), np.hstack([best_k, np.broadcast_to(keys, d.shape)])
                order = np.lexsort((best_k, best_d), axis=1)[:, :k]
                blocks[b] = asked, np.take_along_axis(best_d, order, 1), np.take_along_axis(best_k, order, 1)
        for b, (_, best_d, best_k) in enumerate(blocks):
            if best_d.shape[1]:
                own = ids[b * at_once : (b + 1) * at_once]
                yield pd.DataFrame({"query": np.repeat(own, best_d.shape[1]), key: best_k.ravel(), "distance": best_d.ravel()})

    return run


def batch_knn(df: DataFrame, queries: DataFrame, k: int, *, key: str = "_id", vector: str = "embedding", metric: str = "euclidean", block: int = 64 << 20) -> DataFrame:
    """(query, key, distance, rank) of the k nearest of each query (a table with the same columns).

    Queries are broadcast in blocks of at most ``block`` bytes, for each of which the
    corpus is read once; every partition answers with its own best k by matrix products,
    so what is shuffled is k rows a query and partition, whatever the corpus holds.
    """
    sc, found, rows, size = df.sparkSession.sparkContext, None, [], 0

    def flush() -> None:
        nonlocal found, rows, size
        if rows:
            known = sc.broadcast(([i for i, _ in rows], np.stack([v for _, v in rows])))
            part = df.select(key, vector).filter(F.col(vector).isNotNull()).mapInPandas(_top(metric, k, known, key, vector), f"query long, {key} long, distance double")
            found, rows, size = part if found is None else found.unionByName(part), [], 0

    for r in queries.select(key, vector).filter(F.col(vector).isNotNull()).toLocalIterator():
        rows.append((r[0], np.array(r[1], dtype=np.float64)))
        size += 8 * len(r[1])
        if size >= block:
            flush()
    flush()
    if found is None:
        return df.sparkSession.createDataFrame([], f"query long, {key} long, distance double, rank int")
    w = Window.partitionBy("query").orderBy("distance", key)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows at length 1; rows without length become zeros."""
    n = np.sqrt((m * m).sum(1))[:, None]
    return np.divide(m, n, out=np.zeros_like(m), where=n >= EPSILON)


def _top_in_cells(metric: str, k: int, ids: list[int], matrix: np.ndarray, opened: np.ndarray, key: str, vector: str):
    """Each query's best k of the cells opened for it (queries x cells)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for cell, rows in pdf.groupby("cell"):
                asking = np.flatnonzero(opened[:, cell])
                if not len(asking):
                    continue
                d, keys = distances(np.stack(rows[vector].to_numpy()), matrix[asking], metric), rows[key].to_numpy()
                for q, own in zip(asking.tolist(), d):
                    had = best.get(q, (np.zeros(0), np.zeros(0, dtype=np.int64)))
                    all_d, all_k = np.concatenate([had[0], own]), np.concatenate([had[1], keys])
                    order = np.lexsort((all_k, all_d))[:k]
                    best[q] = all_d[order], all_k[order]
        for q, (d, keys) in best.items():
            yield pd.DataFrame({"query": ids[q], key: keys, "distance": d})

    return run


class CellIndex:
    """Inverted cells: centres are fitted on a bounded sample, every vector is put into its cell.

    A search opens the cells next to the query first; their k-th distance then tells
    which others may hold a nearer vector, by the distance of the cell's centre and
    its radius, and all of those are opened too. So the result is that of an exact search.
    """

    def __init__(self, cells: np.ndarray, radius: np.ndarray, rows: DataFrame, key: str, vector: str, metric: str):
        self.cells, self.radius, self.rows, self.key, self.vector, self.metric = cells, radius, rows, key, vector, metric

    @staticmethod
    def build(df: DataFrame, *, key: str = "_id", vector: str = "embedding", metric: str = "euclidean", cells: int = 32, sample: int = 20_000, rounds: int = 10, seed: int = 5) -> CellIndex:
        """:param sample: rows the centres are fitted on (those with the least hash of their key)."""
        rows = df.filter(F.col(vector).isNotNull())
        place = _unit if metric == "cosine" else lambda m: m
        fit = place(np.stack([np.array(r[0], dtype=np.float64) for r in rows.orderBy(F.xxhash64(F.lit(seed), key)).select(vector).limit(sample).collect()]))
        rng = np.random.default_rng(seed)
        centres = fit[rng.choice(len(fit), min(cells, len(fit)), replace=False)]
        for _ in range(rounds):
            near = distances(fit, centres, "euclidean").argmin(0)
            centres = np.stack([fit[near == i].mean(0) if (near == i).any() else centres[i] for i in range(len(centres))])

        def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    d = distances(place(np.stack(pdf[vector].to_numpy()).astype(np.float64)), centres, "euclidean")
                    yield pdf.assign(cell=d.argmin(0).astype(np.int32), off=d.min(0))

        # cells are folders, so a search reads those it opens only
        schema = f"{key} long, {vector} array<float>, cell int, off double"
        path = scratch_path(df.sparkSession, "cells")
        rows.select(key, vector).mapInPandas(put, schema).repartition("cell").write.partitionBy("cell").parquet(path)
        placed = df.sparkSession.read.schema(schema).parquet(path)
        radius = np.full(len(centres), -np.inf)
        for r in placed.groupBy("cell").agg(F.max("off").alias("off")).collect():
            radius[r.cell] = r.off
        return CellIndex(centres, radius, placed, key, vector, metric)

    def least(self, queries: np.ndarray) -> np.ndarray:
        """No vector of a cell is nearer to a query than this (queries x cells); empty cells are endlessly far."""
        if self.metric == "inner_product":
            out = -(queries @ self.cells.T) - np.sqrt((queries * queries).sum(1))[:, None] * self.radius
        else:
            # the Manhattan distance is never below the Euclidean one; unit vectors' cosine distance is half their squared Euclidean one
            out = np.maximum(0, distances(self.cells, _unit(queries) if self.metric == "cosine" else queries, "euclidean") - self.radius)
            out = out * out / 2 if self.metric == "cosine" else out
        return np.where(np.isneginf(self.radius), np.inf, out)

    def _found(self, ids: list[int], matrix: np.ndarray, k: int, opened: np.ndarray) -> DataFrame:
        rows = self.rows.filter(F.col("cell").isin(np.flatnonzero(opened.any(0)).tolist()))
        schema = f"query long, {self.key} long, distance double"
        return rows.mapInPandas(_top_in_cells(self.metric, k, ids, matrix, opened, self.key, self.vector), schema)

    def _block(self, ids: list[int], matrix: np.ndarray, k: int, probes: int) -> DataFrame:
        least = self.least(matrix)
        first = np.zeros(least.shape, dtype=bool)
        np.put_along_axis(first, least.argsort(1, kind="stable")[:, :probes], True, 1)
        near = materialize(self._found(ids, matrix, k, first), "near")
        w = Window.partitionBy("query").orderBy("distance", self.key)
        at = {q: i for i, q in enumerate(ids)}
        reach = np.full(len(ids), np.inf)  # stays so where the first cells hold fewer than k
        for r in near.withColumn("n", F.row_number().over(w)).filter(F.col("n") == k).select("query", "distance").collect():
            reach[at[r.query]] = r.distance
        slack = 1e-6 * (1 + np.abs(np.where(np.isfinite(reach), reach, 0)))
        more = ~first & (least <= (reach + slack)[:, None]) & np.isfinite(least)
        return near.unionByName(self._found(ids, matrix, k, more)) if more.any() else near

    def search_batch(self, queries: DataFrame, k: int, *, probes: int = 8, block: int = 2_000) -> DataFrame:
        """(query, key, distance, rank) of the k nearest of each query (a table with the same columns), in blocks as in ``batch_knn``."""
        found, ids, vectors = None, [], []

        def flush() -> None:
            nonlocal found, ids, vectors
            if ids:
                part = self._block(ids, np.array([_valid(v, self.cells.shape[1]) for v in vectors]), k, probes)
                found, ids, vectors = part if found is None else found.unionByName(part), [], []

        for r in queries.select(self.key, self.vector).filter(F.col(self.vector).isNotNull()).toLocalIterator():
            ids.append(r[0])
            vectors.append(r[1])
            if len(ids) == block:
                flush()
        flush()
        if found is None or k <= 0:
            return self.rows.sparkSession.createDataFrame([], f"query long, {self.key} long, distance double, rank int")
        w = Window.partitionBy("query").orderBy("distance", self.key)
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def search(self, query: Sequence[float], k: int, probes: int = 8) -> DataFrame:
        q = np.array([_valid(query, self.cells.shape[1])])
        if k <= 0:
            return self.rows.select(self.key, F.lit(0.0).alias("distance")).limit(0)
        return self._block([0], q, k, probes).select(self.key, "distance").orderBy("distance", self.key).limit(k)
