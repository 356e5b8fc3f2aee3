"""Hard negatives for anchors, with score bounds along a spanning tree of anchors.

Scores are integer inner products of floor(scale * x). An anchor's positives are its best-scoring other rows of its label; a negative for an
anchor and positive is a row of another label whose score lies in a window, given in percent of the positive's score.

A task holds a block of anchors and a part of the candidates. A minimum spanning tree joins the anchors. Candidates are scored exactly at
the root. From there on, a child's score of a candidate x differs from its parent's by |(child - parent) . x| <= edge * |x|, so the parent's
score (or the bounds it had) gives bounds at the child. A candidate is scored anew only if its bounds overlap what the child still looks
for: for positives, scores from the best k lower bounds on; for negatives, a window from its lower end, or from the k-th best score that is
sure to lie in it, up to its upper end. The bounds decide what is scored, never what is found.

Positives are searched inside labels: both sides of a label are cut to blocks and parts of bounded size, so that a label with a third of all
rows is many tasks. Their result, at most `positives` rows an anchor, gives the windows. Negatives are searched in all blocks of anchors
against all parts of candidates. Anchors of a block are near each other (they have the same nearest of some pivots, taken from a bounded
sample of anchors), which keeps edges short. Each task keeps the best rows of an anchor and window only. Asking a fixed share of all rows
about all rows is quadratic by contract; candidates are sent once for each block of anchors.

Rows with a null id, label or vector, or with null or non-finite components take no part. Vectors of unequal lengths are compared as if
the shorter ended in zeros; zero vectors take part. Exact repeats of a row count once. Different rows of one id stand for themselves, but
never for each other's candidate; as anchors each gets rows of its own. Ties go to the smaller id. Scores have to fit into 64 bits. With
fewer rows than asked for, all are returned; an anchor without positives, or without negatives in a window, gives no rows, as does an empty
table. Other columns of the table have no influence, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.frames import checkpointed
from pulseframe.llm.vectors import matrix, same_width, usable


@dataclass(frozen=True)
class MiningSettings:
    positives: int = 5
    negatives: int = 10
    #: Window of a negative's score, in percent of the positive's.
    low: int = 30
    high: int = 90
    scale: int = 256
    #: Anchors in a block, candidates in a part, and candidates whose bounds are held at once for all anchors of a block.
    block: int = 1_024
    part: int = 16_384
    portion: int = 2_048
    #: Anchors that pivots are taken from, and pivots at most. More anchors make more parts of a pivot's block, not larger ones.
    sample: int = 4_096
    most_pivots: int = 256


#: Labels whose sizes may be broadcast: about 40 bytes each, so 4 MB at most.
_BROADCAST_LABELS = 100_000
_FOUND = pa.schema([("anchor_id", pa.int64()), ("anchor_key", pa.int64()), ("positive", pa.int32()), ("id", pa.int64()), ("key", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "anchor_id long, anchor_key long, positive int, id long, key long, score long"


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree (Prim): parents come before their children; the first has parent -1."""
    n = len(points)
    order, parent, edge = np.zeros(n, dtype=np.int64), np.full(n, -1), np.zeros(n)
    near, of = ((points - points[0]) ** 2).sum(axis=1), np.zeros(n, dtype=np.int64)
    done = np.zeros(n, dtype=bool)
    done[0] = True
    for i in range(1, n):
        at = int(np.where(done, np.inf, near).argmin())
        order[i], parent[at], edge[at], done[at] = at, of[at], np.sqrt(near[at]), True
        away = ((points - points[at]) ** 2).sum(axis=1)
        of[away < near] = at
        near = np.minimum(near, away)
    return order, parent, edge


@dataclass
class _Side:
    ids: np.ndarray
    keys: np.ndarray
    vectors: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> _Side:
        """Rows of a table, exact repeats left out."""
        ids, keys = (table.column(c).to_numpy() for c in ("id", "key"))
        rows = np.unique(np.stack([ids, keys]), axis=1, return_index=True)[1]
        return cls(ids[rows], keys[rows], matrix(table.column("vector"), "i8")[rows], rows)


def _kth_largest(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _search(anchors: _Side, candidates: _Side, wanted: list[list[tuple[float, float]]], allowed, k: int, portion: int) -> list[tuple]:
    """The k best candidates of each anchor and window (least, most): (anchor, window, candidates, scores). allowed(anchor, slice) tells
    which candidates the anchor may take."""
    a, x = same_width(anchors.vectors, candidates.vectors)
    # Whole numbers below 2^53 in all partial sums have exact float products.
    exact = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1] < 2**53
    points = a.astype(np.float64)
    order, parent, edge = spanning_tree(points)
    lengths = np.sqrt((points**2).sum(axis=1))
    norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    if exact:
        a, x = points, x.astype(np.float64)
    best = [[(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(w) for w in wanted]
    lo, hi = (np.empty((len(a), min(portion, len(x)))) for _ in range(2))
    for start in range(0, len(x), portion):
        rows = slice(start, min(len(x), start + portion))
        size, norm, part = rows.stop - rows.start, norms[rows], x[rows]
        for i in order.tolist():
            below, above = lo[i, :size], hi[i, :size]
            if parent[i] < 0:
                scores = (part @ a[i]).astype(np.int64)
                below[:] = above[:] = scores
                need = np.arange(size)
            else:
                reach = (edge[i] + 1e-9 * (edge[i] + lengths[i])) * norm + 1e-6
                np.subtract(lo[parent[i], :size], reach, out=below)
                np.add(hi[parent[i], :size], reach, out=above)
            may = allowed(i, rows)
            if parent[i] >= 0:
                open_ = np.zeros(size, dtype=bool)
                for (least, most), (_, found) in zip(wanted[i], best[i], strict=True):
                    sure = may & (below >= least) & (above <= most)
                    floor = max(least, _kth_largest(below[sure], k), float(found[-1]) if len(found) == k else -np.inf)
                    open_ |= (above >= floor) & (below <= most)
                need = np.flatnonzero(open_ & may)
                scores = (part[need] @ a[i]).astype(np.int64)
                below[need] = above[need] = scores
            else:
                need, scores = need[may], scores[may]
            for j, (least, most) in enumerate(wanted[i]):
                inside = (scores >= least) & (scores <= most)
                if inside.any():
                    known, had = best[i][j]
                    at, score = np.concatenate([known, need[inside] + start]), np.concatenate([had, scores[inside]])
                    keep = np.lexsort((candidates.keys[at], candidates.ids[at], -score))[:k]
                    best[i][j] = at[keep], score[keep]
    return [(i, j, at, score) for i, windows in enumerate(best) for j, (at, score) in enumerate(windows) if len(at)]


def _rows(anchors: _Side, candidates: _Side, found: list[tuple]) -> pa.Table:
    if not found:
        return _FOUND.empty_table()
    sizes = [len(at) for _, _, at, _ in found]
    i, j = (np.repeat(np.array([f[c] for f in found]), sizes) for c in (0, 1))
    at, score = (np.concatenate([f[c] for f in found]) for c in (2, 3))
    return pa.table([pa.array(c) for c in (anchors.ids[i], anchors.keys[i], j.astype(np.int32), candidates.ids[at], candidates.keys[at], score)], schema=_FOUND)


def _same_label(settings: MiningSettings):
    """The best other rows of each anchor in a block and part of one label."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        anchors, candidates = _Side.of(left), _Side.of(right)
        every = [[(-np.inf, np.inf)] for _ in anchors.ids]
        found = _search(anchors, candidates, every, lambda i, rows: candidates.ids[rows] != anchors.ids[i], settings.positives, settings.portion)
        return _rows(anchors, candidates, found)

    return run


def _other_labels(settings: MiningSettings):
    """The best rows of other labels in each window of each anchor, in a block and part."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        anchors, candidates = _Side.of(left), _Side.of(right)
        labels = pa.chunked_array([*left.column("label").chunks, *right.column("label").chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        own, other = labels[: left.num_rows][anchors.rows], labels[left.num_rows :][candidates.rows]
        scores = left.column("scores").take(pa.array(anchors.rows)).to_pylist()
        # Whole numbers s with low * p <= 100 * s <= high * p.
        windows = [[(-(-settings.low * p // 100), settings.high * p // 100) for p in of] for of in scores]
        found = _search(anchors, candidates, windows, lambda i, rows: (other[rows] != own[i]) & (candidates.ids[rows] != anchors.ids[i]), settings.negatives, settings.portion)
        return _rows(anchors, candidates, found)

    return run


def _pivot_of(pivots: np.ndarray):
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("pivot", pa.int32())])

    def run(batches):
        for rows in batches:
            x, p = same_width(matrix(rows.column("vector"), "f8"), pivots)
            near = ((p**2).sum(axis=1) - 2 * (x @ p.T)).argmin(axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("key"), pa.array(near.astype(np.int32))], schema=schema)

    return run


def _spread(parts: Column, seed: int) -> Column:
    """A part by the id's hash, so that rows of one id share it."""
    return F.pmod(F.xxhash64("id", F.lit(seed)), parts.cast("long"))


def _every(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))


def _anew(columns: tuple[str, ...]) -> list[Column]:
    """Columns that Spark tells from those of the same table on the other side."""
    return [F.col(c).alias(c) for c in columns]


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows by keys; Spark cuts to k in each task before it shuffles."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _positives(rows: DataFrame, settings: MiningSettings) -> DataFrame:
    """(anchor_id, anchor_key, rank, id, key, score): the best other rows of the label of each anchor."""
    sizes = checkpointed(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking")).where("asking > 0"))
    if sizes.count() <= _BROADCAST_LABELS:
        sizes = F.broadcast(sizes)
    down, across = F.ceil(F.col("asking") / settings.block), F.ceil(F.col("n") / settings.part)
    placed = rows.join(sizes, "label")
    columns = ("label", "id", "key", "vector")
    left = placed.where("asks").select(*_anew(columns), _spread(down, 3).alias("down"), _every(across).alias("across"))
    right = placed.select(*columns, _spread(across, 7).alias("across"), _every(down).alias("down"))
    tiles = ("label", "down", "across")
    return _best(left.groupBy(*tiles).cogroup(right.groupBy(*tiles)).applyInArrow(_same_label(settings), _FOUND_DDL), ["anchor_id", "anchor_key"], settings.positives)


def _anchor_blocks(anchors: DataFrame, settings: MiningSettings) -> tuple[DataFrame, int]:
    """Anchors with the number of their block, and the number of blocks: anchors of one nearest pivot, cut to bounded size."""
    asking = anchors.count()
    wanted = min(settings.most_pivots, -(-asking // settings.block))
    if wanted <= 1:
        return anchors.withColumn("block", F.lit(0).cast("long")), 1
    sample = anchors.select("vector").orderBy(F.xxhash64("id", F.lit(11)), "id", "key").limit(min(settings.sample, wanted)).toArrow()
    pivots = anchors.select("id", "key", "vector").mapInArrow(_pivot_of(matrix(sample.column("vector"), "f8")), "id long, key long, pivot int")
    pivots = checkpointed(pivots)
    first, blocks = 0, []
    for r in pivots.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).orderBy("pivot").collect():  # a row per pivot
        blocks.append((r.pivot, first, -(-r.n // settings.block)))
        first += blocks[-1][2]
    table = F.broadcast(anchors.sparkSession.createDataFrame(blocks, "pivot int, first long, parts long"))
    found = pivots.join(table, "pivot").select("id", "key", (F.col("first") + _spread(F.col("parts"), 3)).alias("block"))
    return anchors.join(found.distinct(), ["id", "key"]), first


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", settings: MiningSettings = MiningSettings()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the best negatives of each anchor and positive.
    is_anchor is a condition, and label an expression, on the columns of vectors."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * F.lit(float(settings.scale))).cast("long")))
    rows = checkpointed(rows.withColumn("key", F.xxhash64("label", "vector")))
    n = rows.count()
    found = _positives(rows, settings)
    # At most `positives` rows an anchor, best first.
    listed = F.array_sort(F.collect_list(F.struct("rank", "id", "score")))
    positives = checkpointed(found.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_key").alias("key")).agg(listed.alias("found")))
    # Exact repeats of an anchor fall to one in each task.
    anchors = rows.where("asks").join(positives.select("id", "key", F.col("found.score").alias("scores")), ["id", "key"])
    anchors, blocks = _anchor_blocks(checkpointed(anchors.select("id", "key", "label", "vector", "scores")), settings)
    parts = F.lit(max(1, -(-n // settings.part)))
    columns = ("id", "key", "label", "vector")
    left = anchors.select("block", _every(parts).alias("part"), *_anew(columns), "scores")
    right = rows.select(_every(F.lit(blocks)).alias("block"), _spread(parts, 7).alias("part"), *columns)
    mined = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_other_labels(settings), _FOUND_DDL)
    mined = _best(mined, ["anchor_id", "anchor_key", "positive"], settings.negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score", "key": "negative_key"})
    mined = mined.join(positives.select(F.col("id").alias("anchor_id"), F.col("key").alias("anchor_key"), "found"), ["anchor_id", "anchor_key"])
    positive = F.get("found", F.col("positive"))
    return mined.select("anchor_id", positive.id.alias("positive_id"), "rank", "negative_id", positive.score.alias("positive_score"), "negative_score")
