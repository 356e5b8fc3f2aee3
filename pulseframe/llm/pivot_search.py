"""Exact top-k by integer inner product with a pivot-distance index.

Inner products become distances by one more component: with M the greatest length of a vector, a candidate x gets sqrt(M^2 - |x|^2) and a
query q gets 0; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest candidate is the one of largest product. Each candidate is keyed by
its nearest pivot and its distance to it. Candidates of a pivot are dealt to parts of bounded size and sorted by that distance. By the
triangle inequality a candidate at distance r from the pivot is no nearer to the query than |d - r|, with d the query's distance to the
pivot. So a part is searched from r = d outwards in growing annuli, until the bounds of both sides fall below the query's k-th best score.

A query first searches one part of its nearest pivot, which gives it a k-th best score to start with. It is then sent to those parts alone
whose range of distances can hold a better one. Scores are computed in 64-bit integers; bounds in double precision with a margin.

Pivots are chosen from a bounded sample (`sample` rows); that decides how much is searched, never what is found.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. A zero vector does. Vectors of unequal
lengths are compared as if the shorter ended in zeros. Exact repeats of a row count once; a query's own id is never its candidate. Ties go to
the smaller id. Without queries or candidates the result is empty; with fewer than k candidates all are returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.frames import checkpointed
from pulseframe.llm.vectors import best, matrix, same_width, usable

_PAIRS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_PAIRS_DDL = "query_id long, vec_id long, score long"


@dataclass(frozen=True)
class PivotSettings:
    sample: int = 4_096
    most_pivots: int = 64
    #: Candidates in a part, queries that one task takes for it, and candidates in the first annulus.
    part: int = 16_384
    queries: int = 8_192
    annulus: int = 512


def _lengths(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) ** 2).sum(axis=1)


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([x.astype(np.float64), np.sqrt(np.maximum(top - _lengths(x), 0))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((a - row) ** 2).sum(axis=1)) for row in b], axis=1)


def _pivots(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """Centres of a sample: spread starts, then a few rounds of Lloyd's algorithm."""
    centres = [sample[0]]
    near = ((sample - centres[0]) ** 2).sum(axis=1)
    while len(centres) < n and near.max() > 0:
        centres.append(sample[near.argmax()])
        near = np.minimum(near, ((sample - centres[-1]) ** 2).sum(axis=1))
    pivots = np.array(centres)
    for _ in range(rounds):
        of = _distances(sample, pivots).argmin(axis=1)
        for i in range(len(pivots)):
            if (of == i).any():
                pivots[i] = sample[of == i].mean(axis=0)
    return pivots


def _keyed(pivots: np.ndarray, top: float):
    """Adds each vector's nearest pivot and its distance."""
    schema = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.int64())), ("asks", pa.bool_()), ("pivot", pa.int32()), ("far", pa.float64())])

    def run(batches):
        for rows in batches:
            if rows.num_rows:
                lifted = _lifted(_padded(matrix(rows.column("vector"), "i8"), pivots.shape[1] - 1), top)
                d = _distances(lifted, pivots)
                pivot = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("id", "vector", "asks")), pa.array(pivot.astype(np.int32)), pa.array(d[np.arange(len(d)), pivot])], schema=schema)

    return run


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))


def _search(pivots: np.ndarray, top: float, k: int, settings: PivotSettings):
    """One part of one pivot: each query expands annuli from its own distance to the pivot."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _PAIRS.empty_table()
        pivot = pivots[key[0].as_py()]
        ids, far, vectors = right.column("id").to_numpy(), right.column("far").to_numpy(), matrix(right.column("vector"), "i8")
        queries, vectors = same_width(matrix(left.column("vector"), "i8"), vectors)
        order = np.lexsort((*vectors.T[::-1], ids, far))
        ids, far, vectors = ids[order], far[order], vectors[order]
        again = np.zeros(len(ids), dtype=bool)
        again[1:] = (ids[1:] == ids[:-1]) & (vectors[1:] == vectors[:-1]).all(axis=1)
        ids, far, vectors = ids[~again], far[~again], vectors[~again]
        lengths = _lengths(queries)
        away = np.sqrt(((np.column_stack([_padded(queries, len(pivot) - 1).astype(np.float64), np.zeros(len(queries))]) - pivot) ** 2).sum(axis=1))
        # Whole numbers below 2^53 in all partial sums have exact float products.
        whole = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1] < 2**53
        candidates = vectors.astype(np.float64) if whole else vectors
        out = []
        for i, (query_id, least) in enumerate(zip(left.column("id").to_pylist(), left.column("least").to_pylist(), strict=True)):
            query = queries[i].astype(candidates.dtype)
            margin = 1.0 + 1e-9 * (top + lengths[i])
            found_ids, found = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            kth = -np.inf if least is None else float(least)
            hi = lo = int(np.searchsorted(far, away[i]))
            step = settings.annulus
            while True:
                gap_down = away[i] - far[lo - 1] if lo > 0 else np.inf
                gap_up = far[hi] - away[i] if hi < len(far) else np.inf
                parts = []
                if gap_down < np.inf and (lengths[i] + top - max(gap_down, 0) ** 2) / 2 + margin >= kth:
                    parts.append(slice(max(0, lo - step), lo))
                    lo = parts[-1].start
                else:
                    lo = 0
                if gap_up < np.inf and (lengths[i] + top - max(gap_up, 0) ** 2) / 2 + margin >= kth:
                    parts.append(slice(hi, min(len(far), hi + step)))
                    hi = parts[-1].stop
                else:
                    hi = len(far)
                if not parts:
                    break
                for part in parts:
                    found_ids = np.concatenate([found_ids, ids[part]])
                    found = np.concatenate([found, (candidates[part] @ query).astype(np.int64)])
                other = found_ids != query_id
                found_ids, found = found_ids[other], found[other]
                keep = np.lexsort((found_ids, -found))[:k]
                found_ids, found = found_ids[keep], found[keep]
                if len(found) == k:
                    kth = max(kth, float(found[-1]))
                step *= 2
            out.append((np.full(len(found), query_id, dtype=np.int64), found_ids, found))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_PAIRS)

    return run


def top_products(vectors: DataFrame, is_query: Column, k: int, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", settings: PivotSettings = PivotSettings()) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products of floor(scale * x). is_query is a condition on the columns of vectors."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))).cast("long")))
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking"), F.max(length).alias("top"), F.max(F.size("vector")).alias("width")).first()
    if not whole.n or not whole.asking:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    top = float(whole.top) * (1 + 1e-12)
    sample = rows.select("vector").orderBy(F.xxhash64("id", F.lit(17)), "id").limit(settings.sample).toArrow()
    pivots = _pivots(_lifted(_padded(matrix(sample.column("vector"), "i8"), whole.width), top), int(min(settings.most_pivots, max(4, whole.n**0.5 / 8))))

    keyed = checkpointed(rows.mapInArrow(_keyed(pivots, top), "id long, vector array<long>, asks boolean, pivot int, far double"))
    ranges = keyed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("near"), F.max("far").alias("far")).collect()  # a row per pivot
    parts = {r.pivot: -(-r.n // settings.part) for r in ranges}
    chunks = -(-whole.asking // settings.queries)
    n_parts = F.element_at(F.create_map(*[F.lit(x) for item in parts.items() for x in item]), F.col("pivot"))
    placed = keyed.select("id", "vector", "pivot", "far", F.pmod(F.xxhash64("id", F.lit(5)), n_parts).cast("int").alias("part"))
    candidates = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asking = keyed.where("asks").select("id", "vector", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(chunks)).cast("int").alias("chunk"))
    targets = asking.mapInArrow(_targets(pivots, top, {r.pivot: (r.near, r.far) for r in ranges}), "id long, vector array<long>, chunk int, pivot int, reach double, home boolean")
    keys = ("pivot", "part", "chunk")

    def searched(sent: DataFrame) -> DataFrame:
        return sent.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(_search(pivots, top, k, settings), _PAIRS_DDL)

    home = targets.where("home").withColumn("part", F.lit(0)).withColumn("least", F.lit(None).cast("long"))
    first = checkpointed(best(searched(home).distinct(), k))
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    rest = targets.join(kth, "id", "left").where(F.col("least").isNull() | (F.col("reach") >= F.col("least")))
    rest = rest.withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1))).where("NOT (home AND part = 0)")
    return best(first.select("query_id", "vec_id", "score").union(searched(rest)).distinct(), k)


def _targets(pivots: np.ndarray, top: float, ranges: dict[int, tuple[float, float]]):
    """For each query and pivot: the largest score that its candidates can reach, and whether the query starts there."""
    names = np.array(sorted(ranges), dtype=np.int32)
    near, far = (np.array([ranges[p][i] for p in names.tolist()]) for i in (0, 1))
    schema = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.int64())), ("chunk", pa.int32()), ("pivot", pa.int32()), ("reach", pa.float64()), ("home", pa.bool_())])

    def run(batches):
        for rows in batches:
            if not rows.num_rows:
                continue
            x = _padded(matrix(rows.column("vector"), "i8"), pivots.shape[1] - 1)
            d = _distances(np.column_stack([x.astype(np.float64), np.zeros(len(x))]), pivots[names])
            gap = np.maximum(np.maximum(d - far, near - d), 0)
            lengths = _lengths(x)[:, None]
            reach = (lengths + top - gap**2) / 2 + 1.0 + 1e-9 * (top + lengths)
            row = np.repeat(np.arange(len(x)), len(names))
            home = (np.arange(len(names)) == d.argmin(axis=1)[:, None]).ravel()
            taken = [rows.column(c).take(pa.array(row)) for c in ("id", "vector", "chunk")]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(np.tile(names, len(x))), pa.array(reach.ravel()), pa.array(home)], schema=schema)

    return run
