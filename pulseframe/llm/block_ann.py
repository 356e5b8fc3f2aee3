"""Nearest neighbours by largest inner product: a block matrix join over int8 tiles with error bounds.

Queries and candidates are dealt to blocks by a hash of the id; a tile is one block of queries against one block of candidates. Vectors
are quantised to int8 with a scale of their own. A tile's integer products give every score up to a bound on the quantisation error: for
x = a + e and y = b + f, with a and b the quantised vectors, the scores of x, y and a, b differ by at most |e||b| + |a||f| + |e||f|. A
pair survives if its upper bound reaches the k-th largest lower bound of its query in the tile. Survivors are computed anew in double
precision, component after component, cut to k by a heap per query and merged across tiles. The result is exact.

The integer products run as float32 matrix products of whole numbers, which are exact up to 1,024 components at a time.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id. Vectors of unequal
lengths are compared as if the shorter ended in zeros. Exact repeats of a row count once; a query's own id is never its candidate. Ties go to
the smaller id. Without queries or candidates the result is empty; with fewer than k candidates all are returned.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.vectors import best, matrix, same_width, usable

_PAIRS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_EXACT_WIDTH = 1024


@dataclass(frozen=True)
class TileSettings:
    candidates: int = 16_384
    queries: int = 4_096
    #: Queries whose bounds are held at once, and pairs that are computed anew at once.
    strip: int = 128
    pairs: int = 65_536


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, length of the quantised vector, length of the error), each rounded up where it is a bound."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1.0  # so small that it rounds to nothing
    codes = np.rint(x / scale[:, None]).clip(-127, 127)
    near = codes * scale[:, None]
    return codes.astype(np.int8), scale, _length(near), _length(x - near)


def _length(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, initial=0.0)
    safe = np.where(top > 0, top, 1.0)
    return np.sqrt(((x / safe[:, None]) ** 2).sum(axis=1)) * top * (1 + 1e-12)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of int8 rows, exact."""
    total = np.zeros((len(a), len(b)))
    for j in range(0, a.shape[1], _EXACT_WIDTH):
        total += a[:, j : j + _EXACT_WIDTH].astype(np.float32) @ b[:, j : j + _EXACT_WIDTH].astype(np.float32).T
    return total


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components, so that equal vectors get equal scores."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _distinct(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    x = matrix(table.column("vector"), "f8")
    order = np.lexsort((*x.T[::-1], ids)) if x.shape[1] else np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    keep = np.ones(len(ids), dtype=bool)
    keep[1:] = (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1)
    return ids[keep], x[keep]


def _tile(k: int, settings: TileSettings):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _PAIRS.empty_table()
        query_ids, queries = _distinct(left)
        ids, vectors = _distinct(right)
        queries, vectors = same_width(queries, vectors)
        codes, scale, near, error = _quantised(vectors)
        q_codes, q_scale, q_near, q_error = _quantised(queries)
        out: list[tuple[int, int, float]] = []
        for a in range(0, len(queries), settings.strip):
            strip = slice(a, min(a + settings.strip, len(queries)))
            score = _products(q_codes[strip], codes) * q_scale[strip, None] * scale
            bound = q_error[strip, None] * near + q_near[strip, None] * error + q_error[strip, None] * error
            bound += (np.abs(score) + bound) * 1e-9 + q_near[strip, None] * near * 1e-9
            own = query_ids[strip, None] == ids
            low = np.where(own, -np.inf, score - bound)
            least = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(low), -np.inf)
            row, at = np.nonzero((score + bound >= least[:, None]) & ~own)
            exact = np.concatenate([_exact(queries[strip][row[i : i + settings.pairs]], vectors[at[i : i + settings.pairs]]) for i in range(0, len(row), settings.pairs)] or [np.zeros(0)])
            edges = np.searchsorted(row, np.arange(len(low) + 1))
            for i, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                heap = heapq.nsmallest(k, zip((-exact[s:e]).tolist(), ids[at[s:e]].tolist(), strict=True))
                out += [(int(query_ids[a + i]), v, -x) for x, v in heap]
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, _PAIRS, strict=True)], schema=_PAIRS)

    return search


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def nearest(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", settings: TileSettings = TileSettings()) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of largest inner product. is_query is a condition on the columns of vectors."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking")).first()
    across, down = max(1, -(-sizes.n // settings.candidates)), max(1, -(-sizes.asking // settings.queries))
    block = F.xxhash64("id", F.lit(3))
    candidates = rows.select("id", "vector", F.pmod(block, F.lit(across)).alias("across"), _every(down).alias("down"))
    asking = rows.where("asks").select("id", "vector", _every(across).alias("across"), F.pmod(block, F.lit(down)).alias("down"))
    tiles = asking.groupBy("across", "down").cogroup(candidates.groupBy("across", "down"))
    found = tiles.applyInArrow(_tile(k, settings), "query_id long, vec_id long, score double")
    return best(found.distinct(), k)
