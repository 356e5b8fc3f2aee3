"""Packing of tokenised documents into sequences: shortest pack first over the histogram of lengths.

Documents are cut to full sequences and a rest shorter than one. Only the histogram of the rests comes to the driver. There, lengths are
placed longest first. Packs with the same space left are one group with a count (a packing pattern); a length goes to the shortest packs,
those with the most space: the whole group takes one or more of it, or the group is split if there are fewer documents than packs. If the
length fits nowhere, a new group of packs is opened, as many as the length fills. No more packs are opened than the tokens fill
in whole; what fits nowhere then is cut to fill the shortest packs, and its rest goes back to the histogram under its shorter length. The
tokens that are left over from full sequences go to packs of different powers of two, which need no padding. So nothing is padded, and at
most one document is cut for each sequence, as each cut fills one.

Each placement is one record: a length, a range of ranks, and where the first of them goes. Documents are joined back to their patterns by
length and rank: a document's rank among those of its length is its place in a bucket (of bounded size, by hash) and the number of those in
earlier buckets; a search in the sorted records then gives pack and offset, and again for the rest of a cut document.

Tokens: texts are cut at ASCII blanks, and between Latin letters, digits and the common marks of punctuation. No token of the tokenizer
crosses these places (it drops white space and keeps letters, digits and marks apart), so a text's ids are those of its segments, Latin
capitals as small letters; each task looks up the distinct segments of a portion and keeps those of about `known_words` met before. The end
id is added to each document. A tokenizer that doesn't treat segments alone like segments in a text is refused.

Scale: tokens are written once, as 2 or 4 bytes each, and shuffled once, by length and bucket. The driver holds one row per length (4,096 at
most by default) and the records, some for each length and group; they are broadcast. Their number depends on the number of lengths and on
how many documents a sequence holds, not on the number of documents.

A null text counts as empty and becomes its end id alone, as does a text without any token. Whole texts are packed, however long. Repeated
rows are packed each; rows of one id keep pieces of their own. Ties of rank go by hash of id and tokens. Null ids take part. An empty
table gives an empty result. Other columns of the table have no influence, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.llm.frames import checkpointed, release_memory, run_starts
from pulseframe.llm.words import lowered, mix64, text_batches


@dataclass(frozen=True)
class PackSettings:
    capacity: int = 4_096
    end_id: int = 2
    #: Documents of one length that are ranked by one sort.
    bucket: int = 4_096
    #: Words, and bytes of words, whose ids a task remembers.
    known_words: int = 150_000
    known_bytes: int = 8_000_000


#: Rows of the table of buckets that may be broadcast: 40 bytes each, so 4 MB at most.
_BROADCAST_BUCKETS = 100_000
_RANKS = 1 << 42
#: Text whose segments are looked up at once.
PORTION_BYTES = 2_000_000
#: Bytes of tokens that are cut to pieces at once.
PIECE_BYTES = 2_000_000
#: Longest word that is merged beside others, a round for each merge; longer ones are given to the tokenizer.
MERGED_BYTES = 64


# ---- tokens

#: Kinds of bytes: 0 blanks, 1 Latin letters, 2 common punctuation, 3 digits, 4 others. Between two of the first four kinds a token ends.
_KINDS = np.full(256, 4, dtype=np.uint8)
_KINDS[[0x20, *range(0x09, 0x0E)]] = 0
_KINDS[[*range(65, 91), *range(97, 123)]] = 1
_KINDS[[ord(c) for c in ",.!?;:"]] = 2
_KINDS[48:58] = 3
#: Second bytes, behind 0xC3, of letters; the first half are capitals, which lie 32 places before their small letters.
_LATIN = np.zeros(256, dtype=bool)
_LATIN[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, or else the next one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class WordMerges:
    """Merges many words side by side: in each round, the first of each word's pairs of least rank."""

    _SIZE = 18

    def __init__(self, inner: np.ndarray, last: np.ndarray, merged: np.ndarray, codes: np.ndarray, ranks: np.ndarray) -> None:
        self.inner, self.last, self.merged, self.codes, self.ranks = inner, last, merged, codes, ranks
        self.none = len(merged)

    @classmethod
    def tables(cls, model: dict) -> tuple[np.ndarray, ...]:
        """Arguments of a new object for the model of a tokenizer file."""
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        inner, last = (np.array([vocabulary.get(c + suffix, -1) for c in _byte_letters()], dtype=np.int64) for suffix in ("", end))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        codes = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], dtype=np.int64)
        table, ranks = [-1] * (1 << cls._SIZE), [0] * (1 << cls._SIZE)
        for rank, (code, at) in enumerate(zip(codes.tolist(), cls._place(codes).tolist(), strict=True)):
            while table[at] >= 0 and table[at] != code:
                at = (at + 1) % len(table)
            if table[at] < 0:
                table[at], ranks[at] = code, rank
        return inner, last, merged, np.array(table), np.array(ranks)

    @classmethod
    def _place(cls, codes: np.ndarray) -> np.ndarray:
        return (mix64(codes.view(np.uint64)) >> np.uint64(64 - cls._SIZE)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges if there is none."""
        codes = left << 32 | right
        at, out = self._place(codes), np.full(len(codes), self.none, dtype=np.int64)
        open_ = np.arange(len(codes))
        while len(open_):
            here = self.codes[at]
            hit = here == codes[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            go = ~hit & (here >= 0)
            open_, at = open_[go], (at[go] + 1) % len(self.codes)
        return out

    def encode(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of the words data[edges[i]:edges[i + 1]], none of which is empty."""
        symbol = self.inner[data]
        symbol[edges[1:] - 1] = self.last[data[edges[1:] - 1]]
        word = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        rank = np.full(len(symbol), self.none, dtype=np.int64)  # of each symbol and the next one of its word
        pair = np.flatnonzero(word[:-1] == word[1:])
        rank[pair] = self.rank(symbol[pair], symbol[pair + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            starts = run_starts(word)
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(word)))
            over = np.repeat(best == self.none, sizes)
            done.append((word[over], symbol[over]))
            least = np.repeat(best, sizes)[~over]
            word, symbol, rank = word[~over], symbol[~over], rank[~over]
            first = np.flatnonzero(rank == least)
            first = first[run_starts(word[first])]
            symbol[first] = self.merged[rank[first]]
            keep = np.ones(len(word), dtype=bool)
            keep[first + 1] = False
            at = first - np.arange(len(first))  # places once the second symbols are gone
            word, symbol, rank = word[keep], symbol[keep], rank[keep]
            rank[at] = self.none
            right = at[(at + 1 < len(word))]
            right = right[word[right] == word[right + 1]]
            left = at[at > 0] - 1
            left = left[word[left] == word[left + 1]]
            for pair in (right, left):
                rank[pair] = self.rank(symbol[pair], symbol[pair + 1])
        words, symbols = (np.concatenate([d[c] for d in done]) if done else np.zeros(0, dtype=np.int64) for c in (0, 1))
        return symbols[np.argsort(words, kind="stable")].astype(np.int32), np.bincount(words, minlength=len(edges) - 1)


def word_merges(model: str) -> tuple[np.ndarray, ...] | None:
    """Tables of WordMerges for a tokenizer of the kind that ends words by a suffix; none for others."""
    kind = json.loads(model)["model"]
    merging = kind.get("type") == "BPE" and kind.get("end_of_word_suffix") and not kind.get("dropout") and not kind.get("ignore_merges")
    return WordMerges.tables(kind) if merging else None


class WordTokens:
    """Token ids of texts, looked up by segment. Words of Latin letters that a task has not met are merged side by side, other segments are
    given to the tokenizer."""

    def __init__(self, model: str, merges: tuple[np.ndarray, ...] | None, settings: PackSettings) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.settings = Tokenizer.from_str(model), settings
        self.merges = WordMerges(*merges) if merges else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.bytes = 0
        self.size = np.zeros(0, dtype=np.int32)
        self.first = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.int32)
        self.again = np.zeros(0, dtype=bool)

    def _keep_common(self) -> None:
        """Forget the words that were met in one portion only; all if that leaves many."""
        keep, words = np.flatnonzero(self.again), list(self.known)
        size, first, pool = self.size[keep], self.first[keep], self.pool
        self._forget()
        if 2 * len(keep) <= self.settings.known_words:
            self.known = {words[i]: k for k, i in enumerate(keep.tolist())}
            self.bytes = sum(map(len, self.known))
            self.size, self.again = size, np.zeros(len(keep), dtype=bool)
            self.first = np.cumsum(size, dtype=np.int64) - size
            self.pool = pool[np.repeat(first - self.first, size) + np.arange(size.sum())]

    def _numbers(self, words: list[bytes], plain: np.ndarray) -> np.ndarray:
        """Numbers of distinct segments; those not met yet get the next ones."""
        found = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = found < 0
        self.again[found[~new]] = True
        if new.any():
            self._learn(*(list(compress(words, (new & side).tolist())) for side in (plain, ~plain)))
            found[new & plain] = np.arange((new & plain).sum()) + (len(self.known) - new.sum())
            found[new & ~plain] = np.arange((new & ~plain).sum()) + (len(self.known) - (new & ~plain).sum())
        return found

    def _learn(self, fast: list[bytes], slow: list[bytes]) -> None:
        others = [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast([w.decode() for w in slow], add_special_tokens=False)]
        ids, size = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        if fast:
            edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, fast), dtype=np.int64, count=len(fast)))])
            ids, size = self.merges.encode(np.frombuffer(b"".join(fast), dtype=np.uint8), edges)
        size = np.concatenate([size, np.array([len(i) for i in others], dtype=np.int64)])
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.pool = np.concatenate([self.pool, ids, *others])
        self.again = np.concatenate([self.again, np.zeros(len(size), dtype=bool)])
        self.known.update(zip(fast + slow, range(len(self.known), len(self.known) + len(size)), strict=True))
        self.bytes += sum(map(len, fast)) + sum(map(len, slow))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, edges) of the texts data[offsets[i]:offsets[i + 1]]: those of text i are ids[edges[i]:edges[i + 1]], with the end id last."""
        kind = _kinds(data)
        start, end = _segments(kind, offsets)
        whole = _may_hold_mark(data)
        # Without blanks, segments lie side by side.
        edges = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        segments = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer((data if whole else _small(data))[kind != 0])])
        distinct = segments.dictionary_encode()
        indices = distinct.indices.to_numpy()
        names = distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
        # Kinds change inside a segment only around bytes of the last kind.
        plain = np.zeros(len(names), dtype=bool)
        if self.merges and not whole:
            foreign = np.zeros(len(kind) + 1, dtype=np.int32)
            np.cumsum(kind != 1, out=foreign[1:], dtype=np.int32)
            plain[indices] = (foreign[end] == foreign[start]) & (end - start <= MERGED_BYTES)
        number = self._numbers(names, plain)[indices]
        size = self.size[number]
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        at = np.repeat(self.first[number] - ends[:-1], size)
        at += np.arange(ends[-1])
        edges = ends[np.searchsorted(start, offsets)] + np.arange(len(offsets))
        ids = np.full(edges[-1], self.settings.end_id, dtype=np.int32)
        own = np.ones(len(ids), dtype=bool)
        own[edges[1:] - 1] = False
        ids[own] = self.pool[at]
        if len(self.known) > self.settings.known_words or self.bytes > self.settings.known_bytes:
            self._keep_common()
        return ids, edges


def _kinds(data: np.ndarray) -> np.ndarray:
    kind = _KINDS[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[_LATIN[data[second]]]
    kind[second] = kind[second - 1] = 1
    return kind


def _small(data: np.ndarray) -> np.ndarray:
    """Latin capital letters as small ones."""
    low = lowered(data)
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[_LATIN[data[second]] & (data[second] < 0x9F)]
    low[second] += 32
    return low


def _segments(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the segments that can be encoded alone."""
    change = np.zeros(len(kind) + 1, dtype=bool)
    a, b = kind[:-1], kind[1:]
    change[1:-1] = (a != b) & (((a != 4) & (b != 4)) | (a == 0) | (b == 0))
    change[offsets] = True
    cuts = np.flatnonzero(change)
    solid = kind[cuts[:-1]] != 0
    return cuts[:-1][solid], cuts[1:][solid]


def _may_hold_mark(data: np.ndarray) -> bool:
    """Whether the special tokens' strings, which are taken before letters are lowered, can be in the bytes."""
    return bool(((data[:-1] == ord("<")) & (data[1:] == ord("|"))).any())


def read_tokenizer(path: str | None = None) -> str:
    """A tokenizer file as text; without a path, the public lower-case word vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        model = file.read()
    _check_words_alone(model)
    return model


def _check_words_alone(model: str) -> None:
    """Refuse a tokenizer for which segments in a text differ from segments alone."""
    from tokenizers import Tokenizer

    tokens, whole = WordTokens(model, word_merges(model), PackSettings()), Tokenizer.from_str(model)
    words = ["Two", "words,", "it's", "12.5", "é", "(x)", "na\u00efve\u2026", "\u0301a", "\u6771\u4eac", "#a_b", "so..!?;:no", "0", "\u00c9t\u00e9", "\u00b5\u00df", "007", "<|A", "\u0130I"]
    for blank in (" ", "\n", "\t \r\n", "\x0b", "\x0c"):
        text = blank + blank.join(words) + blank
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        found, _ = tokens.encode(raw, np.array([0, len(raw)]))
        if whole.encode(text, add_special_tokens=False).ids != found[:-1].tolist():
            raise ValueError("the tokenizer needs more than single words")


def token_ids(text: Column, model: str, width: int, settings: PackSettings = PackSettings()) -> Column:
    """Token ids of a text column with the end id, as little-endian whole numbers of `width` bytes."""
    # A worker keeps a broadcast's value from task to task, and with it the words that it has met.
    shared = SparkSession.active().sparkContext.broadcast({"model": model, "merges": word_merges(model)})

    def run(column: pa.Array) -> pa.Array:
        state = shared.value
        if "tokens" not in state:
            state["tokens"] = WordTokens(state["model"], state["merges"], settings)
        out = []
        for data, offsets in text_batches(column, PORTION_BYTES):
            ids, edges = state["tokens"].encode(data, offsets)
            raw = pa.py_buffer(ids.astype(f"<u{width}"))
            out.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges * width), raw]).cast(pa.binary()))
        release_memory()
        return pa.concat_arrays(out) if out else pa.array([], type=pa.binary())

    return F.arrow_udf(run, "binary")(text)


def id_bytes(model: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_str(model).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


# ---- patterns


@dataclass
class Patterns:
    """Placements, sorted by length and first rank. The i-th document of a range goes to pack + i // per_pack, behind offset +
    i % per_pack * take; if take is less than the length, its rest goes on as rank rest_rank + i of the shorter length."""

    length: np.ndarray
    first_rank: np.ndarray
    take: np.ndarray
    pack: np.ndarray
    per_pack: np.ndarray
    offset: np.ndarray
    rest_rank: np.ndarray
    packs: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, start, length, pack, offset) of all pieces, by document and start. Lengths of 0 have none."""
        keys = self.length * _RANKS + self.first_rank
        row, start = np.flatnonzero(length > 0), np.zeros(int((length > 0).sum()), dtype=np.int64)
        left, rank = length[row], rank[row]
        out = []
        while len(row):
            at = np.searchsorted(keys, left * _RANKS + rank, side="right") - 1
            i, take = rank - self.first_rank[at], self.take[at]
            out.append((row, start, take, self.pack[at] + i // self.per_pack[at], self.offset[at] + i % self.per_pack[at] * take))
            more = take < left
            row, start, rank, left = row[more], (start + take)[more], (self.rest_rank[at] + i)[more], (left - take)[more]
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 5
        order = np.lexsort((columns[1], columns[0]))
        return tuple(c[order] for c in columns)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> Patterns:
    """Placements of all lengths (below capacity) of a histogram."""
    whole, left = divmod(sum(length * n for length, n in histogram.items()), capacity)
    groups: list[tuple[int, int, int, int]] = []  # (-space, first pack, packs, used) of open packs: the shortest first
    packs = whole
    for bit in range(capacity.bit_length()):
        if left >> bit & 1:
            groups.append((-(1 << bit), packs, 1, 0))
            packs += 1
    heapq.heapify(groups)
    opened = 0
    ranks = defaultdict(int, histogram)
    waiting = defaultdict(list, {length: [(0, n)] for length, n in histogram.items()})
    records = []
    for length in range(capacity - 1, 0, -1):
        for rank, n in waiting.pop(length, ()):
            while n:
                space = -groups[0][0] if groups else 0
                if space >= length:
                    _, pack, count, used = heapq.heappop(groups)
                    if n < count:  # split the group
                        heapq.heappush(groups, (-space, pack + n, count - n, used))
                        count = n
                    other = -groups[0][0] if groups else 0
                    # As many of the length on each pack as it stays the shortest for.
                    per = max(1, min(space // length, n // count, (space - min(space, other)) // length + 1))
                    took, kept = count * per, length * per
                    records.append((length, rank, length, pack, per, used, 0))
                elif opened < whole:
                    per = min(n, capacity // length)
                    count = min(whole - opened, n // per)
                    space, pack, used = capacity, opened, 0
                    opened += count
                    took, kept = count * per, length * per
                    records.append((length, rank, length, pack, per, 0, 0))
                else:  # cut
                    _, pack, count, used = heapq.heappop(groups)
                    if n < count:
                        heapq.heappush(groups, (-space, pack + n, count - n, used))
                        count = n
                    took, kept, rest = count, space, length - space
                    records.append((length, rank, space, pack, 1, used, ranks[rest]))
                    waiting[rest].append((ranks[rest], count))
                    ranks[rest] += count
                if space > kept:
                    heapq.heappush(groups, (kept - space, pack, count, used + kept))
                rank, n = rank + took, n - took
    columns = np.array(sorted(records), dtype=np.int64).reshape(-1, 7).T
    return Patterns(*columns, packs=packs)


def _pieces(patterns, capacity: int, width: int, as_bytes: bool):
    """Pieces of documents with their ids, for rows (doc_id, tokens, rank, full_rank); some rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Patterns(*patterns.value)
        release_memory()  # what the worker held for the tokens is not needed here
        for rows in batches:
            tokens = rows.column("tokens")
            edges = np.frombuffer(tokens.buffers()[1], dtype=np.int32)[tokens.offset : tokens.offset + len(tokens) + 1].astype(np.int64)
            raw = np.frombuffer(tokens.buffers()[2], dtype=np.uint8) if len(tokens) else np.zeros(0, dtype=np.uint8)
            a = 0
            while a < len(tokens):
                b = max(a + 1, int(np.searchsorted(edges, edges[a] + PIECE_BYTES, side="right")) - 1)
                ids = raw[edges[a] : edges[b]].view(f"<u{width}").astype(np.int32)
                yield _cut(rows.slice(a, b - a), ids, np.diff(edges[a : b + 1]) // width, table, capacity, as_bytes)
                a = b

    return run


def _cut(rows: pa.RecordBatch, ids: np.ndarray, n: np.ndarray, table: Patterns, capacity: int, as_bytes: bool) -> pa.RecordBatch:
    full, rest = n // capacity, n % capacity
    row, start, length, pack, offset = table.place(rest, rows.column("rank").to_numpy(zero_copy_only=False))
    whole_of = np.repeat(np.arange(len(n)), full)
    nth = np.arange(len(whole_of)) - np.repeat(np.cumsum(full) - full, full)
    sequence = table.packs + rows.column("full_rank").to_numpy(zero_copy_only=False)[whole_of] + nth
    columns = [
        np.concatenate([whole_of, row]), np.concatenate([nth * capacity, start + full[row] * capacity]), np.concatenate([np.full(len(nth), capacity), length]),
        np.concatenate([sequence, pack]), np.concatenate([np.zeros(len(nth), dtype=np.int64), offset]),
    ]
    order = np.lexsort((columns[1], columns[0]))
    of, start, length, sequence, offset = (c[order] for c in columns)
    # Pieces in order cover each document's ids, so lists are cuts of the one array.
    edges = np.concatenate([[0], np.cumsum(length)])
    if as_bytes:
        lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(edges * 4), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
    else:
        lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))
    doc = rows.column("doc_id").take(pa.array(of))
    return pa.RecordBatch.from_arrays([doc, *[pa.array(c) for c in (n[of], start, length, sequence, offset)], lists], names=["doc_id", "doc_tokens", "start", "length", "sequence_id", "offset", "ids"])


def packed(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", settings: PackSettings = PackSettings(), as_bytes: bool = False) -> DataFrame:
    """(doc_id, doc_tokens, start, length, sequence_id, offset, ids): the pieces of all documents. start counts the document's ids before the
    piece, offset the ids before it in its sequence. model is the text of a tokenizer file. With as_bytes, ids are binary, four little-endian
    bytes an id."""
    model = model or read_tokenizer()
    width, capacity = id_bytes(model), settings.capacity
    rows = docs.select(F.col(id_col).alias("doc_id"), token_ids(F.coalesce(F.col(text_col).cast("string"), F.lit("")), model, width, settings).alias("tokens"))
    size = F.expr(f"octet_length(tokens) div {width}").cast("long")
    rows = rows.select("doc_id", "tokens", size.alias("n"), F.xxhash64("doc_id", "tokens").alias("mark"))
    rows = checkpointed(rows.withColumns({"rest": F.col("n") % capacity, "full": F.expr(f"n div {capacity}")}))
    # One row a length, so `capacity` rows at most.
    lengths = rows.groupBy("rest").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")).orderBy("rest").collect()
    patterns = shortest_pack_first({r.rest: r.n for r in lengths if r.rest}, capacity)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(getattr(patterns, f) for f in Patterns.__dataclass_fields__))
    before, sizes = 0, []
    for r in lengths:
        sizes.append((r.rest, -(-r.n // settings.bucket), before))
        before += r.full
    sizes = F.broadcast(docs.sparkSession.createDataFrame(sizes, "rest long, buckets long, full_base long"))
    rows = rows.join(sizes, "rest").withColumn("bucket", F.pmod("mark", "buckets"))
    keys = ["rest", "bucket"]
    counts = checkpointed(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")))
    earlier = Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", "full")])
    if sum(-(-r.n // settings.bucket) for r in lengths) <= _BROADCAST_BUCKETS:
        counts = F.broadcast(counts)
    inside = Window.partitionBy(*keys).orderBy("mark", "doc_id")
    rows = rows.withColumn("place", F.row_number().over(inside) - 1)
    rows = rows.withColumn("full_place", F.coalesce(F.sum("full").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(counts, keys)
    rank, full_rank = F.col("n_before") + F.col("place"), F.col("full_base") + F.col("full_before") + F.col("full_place")
    rows = rows.select("doc_id", "tokens", rank.alias("rank"), full_rank.alias("full_rank"))
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("doc_tokens", "start", "length", "sequence_id", "offset")], T.StructField("ids", T.BinaryType() if as_bytes else T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_pieces(shared, capacity, width, as_bytes), schema)


def _checksums(ids: pa.Array) -> pa.Array:
    if not len(ids):
        return pa.array([], type=pa.int64())
    edges = np.asarray(ids.offsets).astype(np.int64)
    raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).view(np.uint8))
    return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], type=pa.int64())


def piece_checksums(pieces: DataFrame) -> DataFrame:
    """The rows of packed() with a CRC-32 of the ids, as unsigned little-endian 32-bit numbers, in place of the ids. For ids as bytes Spark
    takes it itself; lists go to a second Python worker beside the one of packed()."""
    crc = F.crc32("ids") if isinstance(pieces.schema["ids"].dataType, T.BinaryType) else F.arrow_udf(_checksums, "long")("ids")
    return pieces.select("doc_id", "start", "length", crc.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
