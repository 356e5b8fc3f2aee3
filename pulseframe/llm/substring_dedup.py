"""Removal of passages that an earlier document already has: relative Lempel-Ziv parsing against indexed reference blocks.

The corpus is its own reference. A passage counts from `window` words on, and a document counts as earlier by its smaller id. Each
window of words is dealt to a reference block by its rarest inner phrase (its anchor: of the 4-word phrases inside, the one of the
greatest length in bytes, then of the least hash). Equal windows have equal anchors, so a document meets exactly the blocks that can hold
a match for it; parsing every document against every block of the corpus would grow with the square of the corpus.

A block indexes its windows with the earliest document that has each. The runs of consecutive windows that documents sent to the block
are then parsed greedily: a factor extends for as long as the next window is known from an earlier document, and a factor of n windows
makes a duplicate span of n + window - 1 words. A run ends where the anchor changes; windows that reach over such a boundary belong to the
next run and are checked in its block, so no duplicate is lost at factor boundaries.

Scale: only phrases' hashes are shuffled, packed per block. Copies inside one portion of a task are settled there, and one entry of
them goes on, so that a passage in a third of all documents sends one entry per portion. Phrases that a bounded sample shows to be very
frequent are dealt by window instead of by phrase, so their varying surroundings don't meet in one block; the sample decides only where
work is done, never a result.

Null texts have no words. A null id is neither earlier nor later than any: such rows lose nothing and are no reference. Rows with the
same id don't remove each other's words. Texts shorter than the window stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.frames import batch, binary, joined, run_starts
from pulseframe.llm.words import grams, mix64, text_chunks, whole_grams

PHRASE = 4
#: Text whose copies are settled together inside a task.
PORTION_BYTES = 5_000_000
#: Words that one reference block takes on average.
BLOCK_WORDS = 150_000
#: Documents looked at to find very frequent phrases and the length of texts, the share that makes a phrase frequent, and at most so many phrases.
SAMPLE_DOCUMENTS = 20_000
FREQUENT_SHARE = 0.002
FREQUENT_PHRASES = 50_000
#: Bytes of a window's hash that are kept beside 4 bytes of its anchor and the number of its block.
WINDOW_BYTES = 5

_RUNS = pa.schema([("block", pa.int64()), ("anchors", pa.binary()), ("docs", pa.binary()), ("places", pa.binary()), ("sizes", pa.binary()), ("windows", pa.binary())])
_RUNS_DDL = "block long, anchors binary, docs binary, places binary, sizes binary, windows binary"
_SPANS = pa.schema([("doc_id", pa.int64()), ("begin", pa.int32()), ("stop", pa.int32())])
_SPANS_DDL = "doc_id long, begin int, stop int"


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def _windows(words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, place in it, anchor, hash) of every window."""
    if len(words.start) < window:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int32, np.uint64, np.uint64))
    hashes = words.hashes(lower=False)
    size = np.cumsum(np.concatenate([[0], words.end - words.start]))
    length = size[PHRASE:] - size[:-PHRASE]
    rank = (np.uint64(1023) - np.minimum(length, 1023).astype(np.uint64)) << np.uint64(54) | grams(hashes, PHRASE) >> np.uint64(10)
    anchors = _sliding_min(rank, window - PHRASE + 1)
    at = np.flatnonzero(whole_grams(words, window))
    text = words.text_of[at]
    return text, (at - words.first[text]).astype(np.int32), anchors[at], grams(hashes, window)[at]


def _packed(docs, places, anchors, windows, blocks: int, frequent: np.ndarray) -> pa.RecordBatch:
    """Rows for the reference blocks: runs of consecutive windows with one anchor, or single windows where the anchor is frequent."""
    known = np.searchsorted(frequent, anchors)
    is_frequent = frequent[np.minimum(known, len(frequent) - 1)] == anchors if len(frequent) else np.zeros(len(anchors), dtype=bool)
    follows = np.zeros(len(docs), dtype=bool)
    follows[1:] = (docs[1:] == docs[:-1]) & (places[1:] == places[:-1] + 1) & (anchors[1:] == anchors[:-1]) & ~is_frequent[1:]
    starts = np.flatnonzero(~follows)
    sizes = np.diff(np.concatenate([starts, [len(docs)]]))
    sizes_fit = np.minimum(sizes, 65_535)
    if (sizes != sizes_fit).any():  # one phrase over and over: cut such a run
        cut = np.concatenate([np.arange(s, s + n, 65_535) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
        starts, sizes = cut, np.diff(np.concatenate([cut, [len(docs)]]))
    block = (mix64(anchors[starts] ^ np.where(is_frequent[starts], windows[starts], np.uint64(0))) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    bounds = np.append(run_starts(block[order]), len(order))
    low = windows.view(np.uint8).reshape(-1, 8)[:, :WINDOW_BYTES]
    rows = [[], [], [], [], [], []]
    taken = np.repeat(starts[order], sizes[order]) + np.arange(len(docs)) - np.repeat(np.cumsum(sizes[order]) - sizes[order], sizes[order])
    low, ends = np.ascontiguousarray(low[taken]), np.concatenate([[0], np.cumsum(sizes[order])])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        runs = starts[order[a:b]]
        parts = (int(block[order[a]]), binary(anchors[runs].astype(np.uint32)), binary(docs[runs]), binary(places[runs]), binary(sizes[order[a:b]].astype(np.uint16)), binary(low[ends[a] : ends[b]]))
        for column, value in zip(rows, parts, strict=True):
            column.append(value)
    return batch(_RUNS, *rows)


def _send(window: int, blocks: int, frequent: np.ndarray):
    """Map side: entries for the reference blocks. Spans settled here go along as rows of block -1."""

    def portion(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        docs, places, anchors, windows = (np.concatenate(c) for c in zip(*parts, strict=True))
        if not len(docs):
            return
        order = np.lexsort((docs, windows))
        starts = run_starts(windows[order])
        first = np.repeat(docs[order][starts], np.diff(np.append(starts, len(order))))
        later = np.zeros(len(docs), dtype=bool)
        later[order] = docs[order] > first
        found = _spans(docs[later], places[later], window)
        if len(found[0]):
            empty = [b""]
            yield batch(_RUNS, [-1], empty, [binary(found[0])], [binary(found[1])], [binary(found[2])], empty)
        if not later.all():
            yield _packed(docs[~later], places[~later], anchors[~later], windows[~later], blocks, frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for rows in batches:
            ids = rows.column("id").to_numpy(zero_copy_only=False)
            for a, _, words in text_chunks(rows.column("text")):
                text, places, anchors, windows = _windows(words, window)
                parts.append((ids[a + text], places, anchors, windows))
                size += len(words.data)
                if size >= PORTION_BYTES:
                    yield from portion(parts)
                    parts, size = [], 0
        if parts:
            yield from portion(parts)

    return run


def _spans(docs: np.ndarray, places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors over consecutive duplicate windows, as spans of words."""
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (places[1:] > places[:-1] + 1)
    starts = np.flatnonzero(new)
    lasts = np.append(starts[1:], len(docs)) - 1 if len(docs) else starts
    return docs[starts].astype(np.int64), places[starts].astype(np.int32), (places[lasts] + window).astype(np.int32)


def _parse_block(window: int):
    """One reference block: index its windows, then parse the runs sent to it."""

    def parse(key: tuple, rows: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            columns = [joined(rows.column(c).to_pylist(), t) for c, t in (("docs", "i8"), ("places", "i4"), ("sizes", "i4"))]
            return pa.Table.from_batches([batch(_SPANS, *columns)])
        sizes = joined(rows.column("sizes").to_pylist(), "u2").astype(np.int64)
        run_anchors, run_docs, run_places = (joined(rows.column(c).to_pylist(), t) for c, t in (("anchors", "u4"), ("docs", "i8"), ("places", "i4")))
        # Only anchors of two documents or more can have a match.
        order = np.argsort(run_anchors, kind="stable")
        starts = run_starts(run_anchors[order])
        many = np.minimum.reduceat(run_docs[order], starts) < np.maximum.reduceat(run_docs[order], starts)
        live = np.zeros(len(order), dtype=bool)
        live[order] = np.repeat(many, np.diff(np.append(starts, len(order))))
        at = np.concatenate([[0], np.cumsum(sizes)])
        live_windows = np.repeat(live, sizes)
        low = np.zeros((int(live_windows.sum()), 8), dtype=np.uint8)
        low[:, :WINDOW_BYTES] = joined(rows.column("windows").to_pylist(), "u1").reshape(-1, WINDOW_BYTES)[live_windows]
        windows = low.view(np.uint64).ravel()
        anchors, docs = np.repeat(run_anchors, sizes)[live_windows], np.repeat(run_docs, sizes)[live_windows]
        places = (np.repeat(run_places, sizes) + np.arange(at[-1]) - np.repeat(at[:-1], sizes))[live_windows]
        order = np.lexsort((docs, windows, anchors))
        starts = run_starts(anchors[order], windows[order])
        first = np.repeat(docs[order][starts], np.diff(np.append(starts, len(order))))
        later = np.zeros(len(docs), dtype=bool)
        later[order] = docs[order] > first
        return pa.Table.from_batches([batch(_SPANS, *_spans(docs[later], places[later], window))])

    return parse


def _sampled(texts: DataFrame, window: int) -> tuple[int, np.ndarray]:
    """(words of all texts, about; frequent anchors, sorted), from a bounded sample."""
    rows = texts.count()
    every = max(1, -(-rows // SAMPLE_DOCUMENTS))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])
        for part in batches:
            for _, _, words in text_chunks(part.column("text")):
                text, _, anchors, _ = _windows(words, window)
                order = np.lexsort((text, anchors))
                starts = run_starts(anchors[order], text[order])  # once per text
                found, n = np.unique(anchors[order][starts], return_counts=True)
                yield batch(schema, [None, *found.view(np.int64).tolist()], [len(words.start), *n.tolist()])

    seen = texts.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).mapInArrow(look, "anchor long, n long")
    least = max(8, int(FREQUENT_SHARE * min(rows, SAMPLE_DOCUMENTS)))
    counts = seen.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("anchor").isNull() | (F.col("n") >= least))
    top = counts.orderBy(F.col("anchor").isNotNull(), F.col("n").desc(), "anchor").limit(FREQUENT_PHRASES + 1).collect()
    words = sum(r.n for r in top if r.anchor is None) * every
    return words, np.sort(np.array([r.anchor for r in top if r.anchor is not None], dtype=np.int64).view(np.uint64))


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """(doc_id, begin, stop): spans of words, end exclusive, all of whose words lie in windows that a document of a smaller id has too.
    Spans of one document may touch or overlap; together they cover exactly the words to remove."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    words, frequent = _sampled(texts, window)
    blocks = max(1, -(-words // BLOCK_WORDS))
    entries = texts.mapInArrow(_send(window, blocks, frequent), _RUNS_DDL)
    # Settled spans need no block; salted keys below 0 spread them.
    salted = F.when(F.col("block") < 0, -1 - F.pmod(F.xxhash64("docs"), F.lit(blocks))).otherwise(F.col("block"))
    return entries.withColumn("block", salted).groupBy("block").applyInArrow(_parse_block(window), _SPANS_DDL)


def remove_duplicate_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each row's words that no earlier document has in a common passage, joined by one space."""
    spans = duplicate_spans(docs, id_col, text_col, window)
    cuts = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("begin", "stop"))).alias("cuts")).withColumnRenamed("doc_id", "cut_id")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            totals, removed, kept = [], [], []
            for text, spans in zip(rows.column("text").to_pylist(), rows.column("cuts").to_pylist(), strict=True):
                words = (text or "").encode().split()
                left, at = [], 0
                for span in spans or ():
                    left += words[at : span["begin"]] if at < span["begin"] else []
                    at = max(at, span["stop"])
                left += words[at:]
                totals.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield batch(schema, rows.column("doc_id"), totals, removed, kept)

    return texts.join(cuts, texts.doc_id == cuts.cut_id, "left").select("doc_id", "text", "cuts").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def kept_digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
