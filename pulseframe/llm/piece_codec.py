"""SentencePiece encoding and decoding (BPE models) by matching pieces in a suffix array.

Encoding a batch: texts are cut into segments (blanks and the word after them; no piece reaches over such a cut, which is checked when
the model is read), and distinct segments are joined to one text. Its suffix array, sorted as deep as the longest piece, is searched by
bisection for each piece of the vocabulary at once; every occurrence is an edge from its first to its last byte. Edges are sorted by
position and relaxed from left to right, all segments side by side: the last piece of a prefix's encoding is the one edge
that may follow the last piece of the prefix before it. Two pieces may stand side by side if merging never joins or crosses them; that
follows from undoing the two pieces' merges, latest first. So relaxation gives exactly what merging by score gives.
Characters without a piece become byte pieces (or the unknown piece) and are never joined to others.

Decoding joins pieces, takes byte pieces as bytes, turns the blank mark into a space and drops the space that encoding puts in front.

Scale: the vocabulary is bounded and broadcast; nothing is shuffled. A task handles `PORTION_BYTES` of text at a time and keeps the
pieces of at most `KNOWN_SEGMENTS` segments it has met.

A null text gives null; an empty text no pieces. Texts are encoded in whole. Equal texts get equal pieces. The blank mark in a
text counts as a space, as in the format. Only models without normalisation rules are taken.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm.frames import release_memory
from pulseframe.llm.words import Words, find_runs, mix64, text_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
PORTION_BYTES = 500_000
KNOWN_SEGMENTS = 200_000
#: Rows encoded at once.
ROWS = 250
#: Places for pairs of pieces whose answer is remembered; a pair that falls on a taken place replaces the older one.
KNOWN_PAIRS = 1 << 20
_NOT_SPACE = np.ones(256, dtype=bool)
_NOT_SPACE[0x20] = False
_END = 0xFF
_NONE = -1


@dataclass
class PieceModel:
    """Tables of a model. Token numbers are piece ids; `rank` orders merges, 0 for pieces that no merge makes. Only pieces that merging can
    produce are in `matchable`."""

    pieces: list[bytes]
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    matchable: np.ndarray
    merge_codes: np.ndarray
    merge_ranks: np.ndarray
    byte_ids: np.ndarray
    unknown: int
    shown: tuple | None = None


def _merged(parts: list[str], ids: dict[str, int], order: dict[int, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Parts after all merges, best first, and the last merge."""
    last = None
    while True:
        options = [(order[ids[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ids]
        if not options:
            return parts, last
        _, i = min(options)
        last = (parts[i], parts[i + 1])
        parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]


def read_model(path: str = MODEL) -> PieceModel:
    """A model file's tables. The file is read where this runs (on the driver); executors get the tables."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "  ﬁ①Å  x\t "
    if model.normalize(probe) != BLANK + probe.replace(" ", BLANK):
        raise ValueError("the model has normalisation rules or leaves out blanks")
    n = model.vocab_size()
    names = [model.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    ids = {names[i]: i for i in plain}
    if any(BLANK in p.lstrip(BLANK) for p in ids):
        raise ValueError("a piece goes on after a blank")
    by_score = sorted((i for i in plain if len(names[i]) > 1), key=lambda i: (-model.get_score(i), i))
    rank = np.zeros(n, dtype=np.int64)
    rank[by_score] = np.arange(1, len(by_score) + 1)
    order = dict(enumerate(rank.tolist()))
    left, right = np.arange(n), np.arange(n)
    matchable = np.zeros(n, dtype=bool)
    for i in plain:
        parts, last = _merged(list(names[i]), ids, order)
        if parts == [names[i]]:
            matchable[i] = True
            if last:
                left[i], right[i] = ids[last[0]], ids[last[1]]
    # Any two pieces whose join is a piece can merge, however that piece is made first.
    codes, ranks = [], []
    for i in by_score:
        for cut in range(1, len(names[i])):
            a, b = ids.get(names[i][:cut]), ids.get(names[i][cut:])
            if a is not None and b is not None:
                codes.append(a * n + b)
                ranks.append(rank[i])
    at = np.argsort(codes)
    plain_set = set(plain)
    pieces = [names[i].encode() if i in plain_set else b"" for i in range(n)]
    byte_ids = np.full(256, model.unk_id(), dtype=np.int64)
    for i in range(n):
        if model.is_byte(i):
            byte_ids[int(names[i][3:5], 16)] = i
    return PieceModel(pieces, rank, left, right, matchable, np.array(codes, dtype=np.int64)[at], np.array(ranks, dtype=np.int64)[at], byte_ids, model.unk_id())


def may_follow(model: PieceModel, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging leaves piece a followed by piece b as they are. Undoes their merges, latest first, and looks for a merge across the
    border that would have come earlier than what is undone."""
    n = len(model.rank)
    a, b = a.astype(np.int64), b.astype(np.int64)
    out = np.ones(len(a), dtype=bool)
    limit = np.full(len(a), np.iinfo(np.int64).max)
    live = np.arange(len(a))
    while len(live):
        x, y, top = a[live], b[live], limit[live]
        code = x * n + y
        at = np.minimum(np.searchsorted(model.merge_codes, code), len(model.merge_codes) - 1) if len(model.merge_codes) else np.zeros(len(code), dtype=np.int64)
        crossing = (model.merge_codes[at] == code) & (model.merge_ranks[at] < top) if len(model.merge_codes) else np.zeros(len(code), dtype=bool)
        out[live[crossing]] = False
        rx, ry = model.rank[x], model.rank[y]
        undo_x = rx > ry
        done = crossing | ((rx == 0) & (ry == 0))
        # Of equal merges the left one comes first: one across the border is earlier than an equal one to its right.
        limit[live] = np.where(undo_x, rx, ry + 1)
        a[live] = np.where(undo_x, model.right[x], x)
        b[live] = np.where(undo_x, y, model.left[y])
        live = live[~done]
    return out


def _words_of(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; zeros follow the text."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    out = np.zeros(len(data), dtype=np.uint64)
    for j in range(8):
        out = out << np.uint64(8) | padded[j : j + len(data)].astype(np.uint64)
    return out


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places sorted by the `depth` bytes from there on, 8-byte words). Ranks of 8 bytes are doubled until they cover the depth."""
    words = _words_of(data)
    order = np.argsort(words)
    rank = np.empty(len(data), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], words[order][1:] != words[order][:-1]]))
    width = 8
    while width < depth and rank.max(initial=0) < len(data) - 1:
        ahead = np.zeros(len(data), dtype=np.int64)
        if width < len(data):
            ahead[:-width] = rank[width:] + 1
        code = rank * (len(data) + 1) + ahead
        order = np.argsort(code)
        rank[order] = np.cumsum(np.concatenate([[0], code[order][1:] != code[order][:-1]]))
        width *= 2
    return order, words


def piece_words(pieces: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in the list, 8-byte words, masks) of the pieces, by their number of words."""
    wide = np.array([-(-len(p) // 8) for p in pieces])
    out = []
    for steps in np.unique(wide).tolist():
        at = np.flatnonzero(wide == steps)
        some = [pieces[i] for i in at.tolist()]
        words, masks = (np.frombuffer(b"".join(x.ljust(8 * steps, b"\0") for x in c), dtype=">u8").reshape(len(at), steps).astype(np.uint64) for c in (some, [b"\xff" * len(p) for p in some]))
        out.append((at, words, masks))
    return out


def occurrence_ranges(order: np.ndarray, words: np.ndarray, pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the range of the suffix array whose suffixes begin with it, by bisection of all pieces at once."""
    n = sum(len(at) for at, _, _ in pieces)
    out = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for at, low, mask in pieces:
        padded = np.concatenate([words, np.zeros(8 * low.shape[1], dtype=np.uint64)])
        for bound, after in zip(out, (False, True), strict=True):
            lo, hi = np.zeros(len(at), dtype=np.int64), np.full(len(at), len(order), dtype=np.int64)
            while (lo < hi).any():
                mid = (lo + hi) // 2
                place = order[np.minimum(mid, len(order) - 1)]
                less, equal = np.zeros(len(at), dtype=bool), np.ones(len(at), dtype=bool)
                for j in range(low.shape[1]):
                    word = padded[place + 8 * j] & mask[:, j]
                    less |= equal & (word < low[:, j])
                    equal &= word == low[:, j]
                open_ = lo < hi
                right = (less | (equal & after)) & open_
                lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
            bound[at] = lo
    return out


class Encoder:
    """Encodes portions of text; keeps the segments it has met."""

    def __init__(self, model: PieceModel):
        self.model = model
        usable = [i for i in np.flatnonzero(model.matchable).tolist() if model.pieces[i]]
        self.ids = np.array(usable, dtype=np.int64)
        pieces = [model.pieces[i] for i in usable]
        self.words = piece_words(pieces)
        self.sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self.depth = int(self.sizes.max(initial=1))
        self.length_of = np.zeros(len(model.pieces) + 1, dtype=np.int64)
        self.length_of[self.ids] = self.sizes
        self.pair_codes, self.pair_ok = np.full(KNOWN_PAIRS, -1, dtype=np.int64), np.zeros(KNOWN_PAIRS, dtype=bool)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.starts, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.int32)

    def _follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """may_follow with a memory of pairs; a negative a is the beginning or a character without a piece."""
        code = a * len(self.model.rank) + b
        out = np.ones(len(code), dtype=bool)
        ask = np.flatnonzero((a >= 0) & (b >= 0))
        code = code[ask]
        place = (mix64(code.view(np.uint64)) & np.uint64(KNOWN_PAIRS - 1)).astype(np.int64)
        known = self.pair_codes[place] == code
        ok = self.pair_ok[place]
        if not known.all():
            new, of = np.unique(code[~known], return_inverse=True)
            answer = may_follow(self.model, new // len(self.model.rank), new % len(self.model.rank))
            ok[~known] = answer[of]
            self.pair_codes[place[~known]], self.pair_ok[place[~known]] = code[~known], ok[~known]
        out[ask] = ok
        return out

    def segments(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, number of pieces by segment) of the segments data[edges[i]:edges[i + 1]], each ended by a byte that no text has."""
        order, words = suffix_array(data, min(self.depth, int(np.diff(edges).max(initial=1))))
        lo, hi = occurrence_ranges(order, words, self.words)
        n = hi - lo
        piece = np.repeat(np.arange(len(n)), n)
        begin = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        token = self.ids[piece]
        stop = begin + self.sizes[piece]
        # A character that no one-character piece matches stands for itself.
        first = (data & 0xC0) != 0x80
        first &= data != _END
        start = np.flatnonzero(first)
        width = np.where(data[start] < 0x80, 1, np.where(data[start] < 0xE0, 2, np.where(data[start] < 0xF0, 3, 4)))
        single = np.zeros(len(data), dtype=bool)
        single[begin[stop - begin == 1]] = True
        wide = np.flatnonzero(data[begin] >= 0xC0)
        whole = wide[(stop - begin)[wide] == np.where(data[begin[wide]] < 0xE0, 2, np.where(data[begin[wide]] < 0xF0, 3, 4))]
        single[begin[whole]] = True
        alone = ~single[start]
        begin, stop = np.concatenate([begin, start[alone]]), np.concatenate([stop, (start + width)[alone]])
        token = np.concatenate([token, np.full(int(alone.sum()), _NONE)])
        origin = np.repeat(edges[:-1], np.diff(edges))
        reach = stop - origin[begin]
        # Numbers of 16 bits are sorted by radix.
        by_reach = np.argsort(reach.astype(np.uint16) if reach.max(initial=0) < 65_536 else reach, kind="stable")
        begin, stop, token, reach = begin[by_reach], stop[by_reach], token[by_reach], reach[by_reach]
        last = np.full(len(data) + 1, _NONE, dtype=np.int64)
        back = np.zeros(len(data) + 1, dtype=np.int64)
        bounds = np.flatnonzero(np.concatenate([[True], reach[1:] != reach[:-1], [True]])) if len(reach) else np.zeros(1, dtype=np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            # `last` is unset at a segment's beginning, so any piece may stand there.
            ok = self._follow(last[begin[a:b]], token[a:b])
            end = stop[a:b][ok]
            last[end], back[end] = token[a:b][ok], begin[a:b][ok]
        # A place is the end of one segment's text; the byte after it keeps it apart from the next one's beginning.
        at, owner = edges[1:] - 1, np.arange(len(edges) - 1)
        owners, places, tokens, lengths = [], [], [], []
        while len(at):
            go = at > edges[owner]
            at, owner = at[go], owner[go]
            owners.append(owner)
            places.append(at)
            tokens.append(last[at])
            lengths.append(at - back[at])
            at = back[at]
        owner, place, token, length = (np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in (owners, places, tokens, lengths))
        order = np.argsort(place, kind="stable")
        owner, place, token, length = owner[order], place[order], token[order], length[order]
        copies = np.where(token == _NONE, length if (self.model.byte_ids != self.model.unknown).all() else 1, 1)
        spread = np.repeat(token, copies)
        odd = np.flatnonzero(spread == _NONE)
        inside = (np.repeat(place - length, copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies))[odd]
        spread[odd] = self.model.byte_ids[data[inside]]
        return spread.astype(np.int32), np.bincount(owner, weights=copies, minlength=len(edges) - 1).astype(np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all texts, number of pieces by text)."""
        start, end = find_runs(data, offsets, _NOT_SPACE)
        text = np.searchsorted(offsets, start, side="right") - 1
        # Segments: the spaces before each run, one more at the beginning of a text, and spaces at the end of a text as a segment of their own.
        before = np.concatenate([[0], end[:-1]]) if len(start) else start
        new = np.ones(len(start), dtype=bool)
        new[1:] = text[1:] != text[:-1]
        spaces = np.where(new, start - offsets[text] + 1, start - before)
        tail_start = offsets[:-1].copy()
        np.maximum.at(tail_start, text, end)
        tail = offsets[1:] - tail_start
        tail += (tail > 0) & (tail_start == offsets[:-1])  # a text of spaces only has the one in front, too
        ends = np.flatnonzero(tail)
        owner = np.concatenate([text, ends])
        spaces = np.concatenate([spaces, tail[ends]])
        start, end = np.concatenate([start, tail_start[ends]]), np.concatenate([end, tail_start[ends]])
        order = np.lexsort((np.concatenate([np.zeros(len(text)), np.ones(len(ends))]), start, owner))
        owner, spaces, start, end = owner[order], spaces[order], start[order], end[order]
        keys = mix64(Words(data, start, end, offsets).hashes(lower=False) + spaces.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        found, place, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, found)
        known = np.zeros(len(found), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == found[inside]
        if not known.all():
            if len(self.keys) + int((~known).sum()) > KNOWN_SEGMENTS:
                self._forget()
                known[:] = False
            self._learn(data, found[~known], place[~known], spaces, start, end)
            at = np.searchsorted(self.keys, found)
        of = at[inverse]
        count = self.counts[of]
        flat = self.pool[np.repeat(self.starts[of], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        return flat, np.bincount(owner, weights=count, minlength=len(offsets) - 1).astype(np.int64)

    def _learn(self, data, keys, place, spaces, start, end) -> None:
        mark = BLANK.encode()
        raw = data.tobytes()
        parts = [mark * k + raw[s:e] for k, s, e in zip(spaces[place].tolist(), start[place].tolist(), end[place].tolist(), strict=True)]
        edges = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        pool, counts = self.segments(np.frombuffer(b"".join(p + b"\xff" for p in parts), dtype=np.uint8), edges)
        starts = len(self.pool) + np.cumsum(counts) - counts
        self.pool = np.concatenate([self.pool, pool])
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        self.keys = all_keys[order]
        self.starts, self.counts = np.concatenate([self.starts, starts])[order], np.concatenate([self.counts, counts])[order]


def encode_column(encoder: Encoder, column: pa.Array) -> pa.Array:
    """list<int32> of pieces for a text column."""
    nulls = column.is_null()
    texts = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), BLANK, " ")
    pools, counts = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
    for data, offsets in text_batches(texts, PORTION_BYTES):
        pool, count = encoder.encode(data, offsets)
        pools.append(pool)
        counts.append(count)
    edges = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
    out = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(pools)))
    return pc.if_else(nulls, pa.scalar(None, out.type), out) if nulls.true_count else out


def _shown(model: PieceModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all pieces, first byte, number of bytes) as they are shown in a text."""
    names = list(model.pieces)
    for byte, i in enumerate(model.byte_ids.tolist()):
        if i != model.unknown:
            names[i] = bytes([byte])
    names[model.unknown] = " ⁇ ".encode()
    mark = BLANK.encode()
    names = [p.replace(mark, b" ") for p in names]
    size = np.array([len(p) for p in names], dtype=np.int64)
    first = np.cumsum(size) - size
    return np.frombuffer(b"".join(names), dtype=np.uint8), first, size


def decode_column(model: PieceModel, column: pa.Array) -> pa.Array:
    """Texts of a column of pieces."""
    if model.shown is None:
        model.shown = _shown(model)
    pool, first, size = model.shown
    out: list[str | None] = []
    edges = np.asarray(column.offsets)
    ids = column.values.to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b, null in zip(edges[:-1].tolist(), edges[1:].tolist(), column.is_null().to_pylist(), strict=True):
        if null:
            out.append(None)
            continue
        part = ids[a:b]
        n = size[part]
        raw = pool[np.repeat(first[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)].tobytes()
        out.append(raw.removeprefix(b" ").decode(errors="replace"))
    return pa.array(out, type=pa.string())


def _tables(model: PieceModel):
    return SparkSession.active().sparkContext.broadcast(tuple(getattr(model, f) for f in PieceModel.__dataclass_fields__))


def encoded(text: Column, model: PieceModel) -> Column:
    """struct<pieces: array<int>, round_trip: boolean>: piece ids, and whether decoding them gives the text back."""
    shared = _tables(model)
    state: dict = {}

    def run(column: pa.Array) -> pa.Array:
        if "encoder" not in state:
            state["encoder"] = Encoder(PieceModel(*shared.value))
        out = [[], []]
        for a in range(0, len(column), ROWS):
            texts = column.slice(a, ROWS)
            pieces = encode_column(state["encoder"], texts)
            same = pc.equal(decode_column(state["encoder"].model, pieces), texts.cast(pa.string())).fill_null(True)
            out[0].append(pieces)
            out[1].append(same)
        release_memory()
        arrays = [pa.concat_arrays(o) if o else pa.array([], type=t) for o, t in zip(out, (pa.list_(pa.int32()), pa.bool_()), strict=True)]
        return pa.StructArray.from_arrays(arrays, names=["pieces", "round_trip"])

    return F.arrow_udf(run, "struct<pieces: array<int>, round_trip: boolean>")(text)


def decoded(pieces: Column, model: PieceModel) -> Column:
    """The text of an array of piece ids."""
    shared = _tables(model)

    def run(column: pa.Array) -> pa.Array:
        return decode_column(PieceModel(*shared.value), column)

    return F.arrow_udf(run, "string")(pieces)


def tokenized(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pieces, n_pieces, round_trip) of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), encoded(F.col(text_col), model).alias("found"))
    return rows.select("doc_id", "found.pieces", F.size("found.pieces").cast("long").alias("n_pieces"), "found.round_trip")
