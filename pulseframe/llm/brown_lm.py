"""Language-model scores by a class-based bigram model over exchange clusters (Brown classes).

Every training word has one of `classes` classes. The `class_words` commonest words of all training rows are assigned by exchange: each
word in turn moves to the class that raises the likelihood of the training bigrams most, over several rounds. Each other word then takes the
class of greatest likelihood given its own counts of left and right neighbours (classes of common words, another word, or an end
of the text) against the table of transitions between those. The end of a text is a class of its own, and so are words without a training
count. The model is

  P(word | h) = P(class | h) * P(word | class),  with h the class of the word before, or the beginning of the text.

P(class | h) is counted over all training words and smoothed by `transition_prior` counts towards the transitions of h's group (the classes
are exchanged once more into `groups` groups), and those towards the class's share. P(word | class) adds a half to each count. One unknown word
has half a count of all, about the share that the base model leaves for it, whatever its history.

Counts cover all training rows. Bigrams of common words are counted in each task and added up (at most class_words squared reach the
driver, where the exchange runs). The other words of a portion of texts, with their neighbours, are dealt to blocks by the word's hash; a block
gives each of its words a class and a count and sends both back to the portion, which then knows the classes of all its words.
No table of all words is ever gathered or broadcast.

Words are longest runs of bytes other than ASCII blanks, with A-Z as a-z, known by 64-bit hashes (48 bits and the block for rare ones). A null
or empty text has no words and one end. A row with a null id is scored and not learned from. Repeated rows count each time. Without
training rows all counts are 0 and the same formulas hold. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.frames import batch, binary, checkpointed, joined, run_starts
from pulseframe.llm.words import mix64, text_chunks


@dataclass(frozen=True)
class BrownSettings:
    class_words: int = 2_048
    classes: int = 64
    groups: int = 8
    rounds: int = 6
    transition_prior: float = 50.0
    #: Text of a portion, rows of a portion at most, and occurrences that one block takes on average.
    portion_bytes: int = 8_000_000
    portion_rows: int = 60_000
    block: int = 1_500_000


_COUNTS = pa.schema([("code", pa.int64()), ("n", pa.int64())])
_ENTRIES = pa.schema([("block", pa.int64()), ("portion", pa.int64()), *[(c, pa.binary()) for c in ("words", "seen", "left", "right", "texts", "kinds", "places")]])
_ENTRIES_DDL = "block long, portion long, words binary, seen binary, left binary, right binary, texts binary, kinds binary, places binary"
_ANSWERS = pa.schema([("block", pa.int64()), ("portion", pa.int64()), *[(c, pa.binary()) for c in ("classes", "counts", "texts", "kinds", "places")], ("sums", pa.list_(pa.int64()))])
_ANSWERS_DDL = "block long, portion long, classes binary, counts binary, texts binary, kinds binary, places binary, sums array<long>"
_PORTIONS = pa.schema([("texts", pa.binary()), ("kinds", pa.binary())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_TEXT = np.dtype([("id", "i8"), ("no_id", "?"), ("held", "?"), ("learn", "?"), ("tokens", "i8"), ("known", "i8"), ("base", "f8")])
_WORD_BYTES = 6
#: Words that get a class together, so many rows of likelihoods.
_ASSIGNED = 8_192


# --- exchange clustering, on bounded tables


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Class of each word from the dense table of bigram counts, words by falling frequency. Moves one word at a time to the class of the
    greatest likelihood sum n(c, d) log n(c, d) - sum n(c) log n(c) - sum n(d) log n(d)."""
    n = len(bigrams)
    classes = max(1, min(classes, n))
    of = np.arange(n) % classes
    table = np.zeros((classes, classes))
    np.add.at(table, (np.repeat(of, n), np.tile(of, n)), bigrams.ravel())
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            own = of[w]
            out, into, self_ = bigrams[w] @ member, bigrams[:, w] @ member, bigrams[w, w]
            out[own] -= self_
            into[own] -= self_
            table[own] -= out
            table[:, own] -= into
            table[own, own] -= self_
            rows, columns = table.sum(axis=1) + into, table.sum(axis=0) + out  # bigrams with w count there wherever w goes
            cells = _xlogx(table)
            gain = (_xlogx(table + out) - cells).sum(axis=1) + (_xlogx(table + into[:, None]) - cells).sum(axis=0)
            diagonal = np.diagonal(table)
            gain += _xlogx(diagonal + out + into + self_) + _xlogx(diagonal) - _xlogx(diagonal + out) - _xlogx(diagonal + into)
            gain -= _xlogx(rows + out.sum() + self_) - _xlogx(rows) + _xlogx(columns + into.sum() + self_) - _xlogx(columns)
            best = int(gain.argmax()) if gain.max() > gain[own] + 1e-9 else own
            table[best] += out
            table[:, best] += into
            table[best, best] += self_
            if best != own:
                member[w, own], member[w, best], of[w] = 0, 1, best
                moved += 1
        if not moved:
            break
    return of


# --- tokens of a chunk of texts


class _Tokens:
    """Words and ends of a chunk. Kinds: 0.. are classes of common words, then other words, then ends; before a text's first is an end."""

    def __init__(self, words, common: np.ndarray, class_of: np.ndarray, classes: int):
        n_texts = len(words.first) - 1
        hashes = words.hashes(lower=True)
        at = np.searchsorted(common, hashes)
        at[at == len(common)] = 0
        is_common = common[at] == hashes if len(common) else np.zeros(len(hashes), dtype=bool)
        self.text = np.repeat(np.arange(n_texts), words.counts + 1)
        self.end_at = words.first[1:] + np.arange(n_texts)
        word_at = np.arange(len(hashes)) + words.text_of
        self.hash = np.zeros(len(self.text), dtype=np.uint64)
        self.hash[word_at] = hashes
        self.common = np.full(len(self.text), -1, dtype=np.int64)
        self.common[word_at] = np.where(is_common, at, -1)
        self.kind = np.full(len(self.text), classes, dtype=np.int64)
        self.kind[word_at[is_common]] = class_of[at[is_common]]
        self.kind[self.end_at] = classes + 1
        self.history = _histories(self.kind, classes + 1)
        self.rare = self.kind == classes


def _histories(kinds: np.ndarray, end: int) -> np.ndarray:
    """The kind before each; the last one of another text is an end."""
    return np.concatenate([[end], kinds[:-1]])[: len(kinds)].astype(np.int64)


# --- passes over the corpus


def _common_words(rows: DataFrame, settings: BrownSettings) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the commonest words of all training rows, by falling count, and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for _, _, words in text_chunks(part.column("text")):
                found, n = np.unique(words.hashes(lower=True), return_counts=True)
                yield batch(_COUNTS, found.view(np.int64), n)

    counts = rows.where("learn").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "code").limit(settings.class_words).toArrow()
    return top.column("code").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy().astype(np.int64)


def _total(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (code, n) by code. Codes are bounded by the caller."""
    total = counts.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return total.column("code").to_numpy().astype(np.int64), total.column("n").to_numpy().astype(np.int64)


def _count(rows: DataFrame, counted) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the training rows of the codes that `counted(words)` gives for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for _, _, words in text_chunks(part.column("text")):
                found, n = np.unique(counted(words), return_counts=True)
                yield batch(_COUNTS, found, n)

    return _total(rows.where("learn").mapInArrow(run, "code long, n long"))


@dataclass
class CommonWords:
    """Common words (sorted hashes), their classes and counts, and counts of transitions between kinds: classes, other words, end."""

    common: np.ndarray
    class_of: np.ndarray
    counts: np.ndarray
    classes: int
    moves: np.ndarray

    @property
    def n_tokens(self) -> int:
        return int(self.moves.sum())

    @property
    def n_rare(self) -> int:
        return int(self.moves[:, self.classes].sum())

    @property
    def n_ends(self) -> int:
        return int(self.moves[:, self.classes + 1].sum())


def fit_common_words(rows: DataFrame, settings: BrownSettings) -> CommonWords:
    """Classes of the common words of rows (id, text, learn)."""
    ranked, n_ranked = _common_words(rows, settings)
    size = len(ranked)
    order = np.argsort(ranked)
    common, counts = ranked[order], n_ranked[order]
    none = np.zeros(size, dtype=np.int64)

    def bigrams(words) -> np.ndarray:
        t = _Tokens(words, common, none, 1)
        a, b = t.common[:-1], t.common[1:]
        pair = (a >= 0) & (b >= 0) & (t.text[:-1] == t.text[1:])
        return a[pair] * size + b[pair]

    codes, n = _count(rows, bigrams)
    table = np.zeros((size, size))
    table.ravel()[codes] = n
    place = np.empty(size, dtype=np.int64)
    place[order] = np.arange(size)  # of the word of each rank among the sorted hashes
    class_of = np.zeros(size, dtype=np.int64)
    class_of[place] = exchange(table[np.ix_(place, place)], settings.classes, settings.rounds) if size else none
    classes = int(class_of.max()) + 1 if size else 1
    kinds = classes + 2

    def transitions(words) -> np.ndarray:
        t = _Tokens(words, common, class_of, classes)
        return t.history * kinds + t.kind

    codes, n = _count(rows, transitions)
    moves = np.zeros(kinds * kinds)
    moves[codes] = n
    return CommonWords(common, class_of, counts, classes, moves.reshape(kinds, kinds))


def _deal(model: CommonWords, blocks: int, settings: BrownSettings):
    """Map side: the kinds of each text's words, and for the blocks the other words of a portion with the neighbours of each occurrence in
    training rows."""
    common, class_of, counts, classes, n_ends = model.common, model.class_of, model.counts, model.classes, model.n_ends
    portion_bytes, portion_rows = settings.portion_bytes, settings.portion_rows

    def portion(number: int, parts: list) -> Iterator[pa.RecordBatch]:
        hashes, learn, left, right, kinds, texts = (np.concatenate(c) for c in zip(*parts, strict=True))
        words, place = np.unique(hashes, return_inverse=True)
        block = (words % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        words, block, place = words[order], block[order], rank[place]
        low = np.ascontiguousarray((words // np.uint64(blocks)).view(np.uint8).reshape(-1, 8)[:, :_WORD_BYTES])
        seen = np.bincount(place[learn], minlength=len(words))
        by_word = np.argsort(place[learn], kind="stable")
        left, right = left[learn][by_word], right[learn][by_word]
        first = np.append(0, np.cumsum(seen))
        yield batch(_ENTRIES, [-1 - number], [number], [b""], [b""], [b""], [b""], [binary(texts)], [binary(kinds)], [binary(place.astype(np.uint32))])
        bounds = np.append(run_starts(block), len(block))
        out: list[list] = [[] for _ in _ENTRIES]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            near = slice(first[a], first[b])
            values = (int(block[a]), number, binary(low[a:b]), binary(seen[a:b].astype(np.uint32)), binary(left[near]), binary(right[near]), b"", b"", b"")
            for column, value in zip(out, values, strict=True):
                column.append(value)
        yield batch(_ENTRIES, *out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        parts, size, n_rows = [], 0, 0
        for part in batches:
            ids = part.column("id").fill_null(0).to_numpy(zero_copy_only=False)
            no_id = part.column("id").is_null().to_numpy(zero_copy_only=False)
            learn, held = (part.column(c).to_numpy(zero_copy_only=False) for c in ("learn", "held_out"))
            for a, b, words in text_chunks(part.column("text")):
                t = _Tokens(words, common, class_of, classes)
                n = b - a
                if n + n_rows > portion_rows and parts:
                    yield from portion(number, parts)
                    number, parts, size, n_rows = number + 1, [], 0, 0
                is_common = t.common >= 0
                base = np.zeros(len(t.kind))
                base[is_common] = np.log10(counts[t.common[is_common]] + 0.5)
                base[t.end_at] = np.log10(n_ends + 0.5)
                row = np.zeros(n, dtype=_TEXT)
                row["id"], row["no_id"], row["held"], row["learn"] = ids[a:b], no_id[a:b], held[a:b], learn[a:b]
                row["tokens"] = words.counts + 1
                row["known"] = np.bincount(t.text, weights=is_common, minlength=n) + (n_ends > 0)
                row["base"] = np.bincount(t.text, weights=base, minlength=n)
                after = np.append(t.kind[1:], classes + 1)
                parts.append((mix64(t.hash[t.rare] + np.uint64(41)), learn[a:b][t.text[t.rare]], t.history[t.rare].astype(np.uint8), after[t.rare].astype(np.uint8), t.kind.astype(np.uint8), row))
                n_rows += n
                size += len(words.data)
                if size >= portion_bytes:
                    yield from portion(number, parts)
                    number, parts, size, n_rows = number + 1, [], 0, 0
        if parts:
            yield from portion(number, parts)

    return run


def likeliest_classes(left: np.ndarray, right: np.ndarray, owner: np.ndarray, total: np.ndarray, moves: np.ndarray, prior: float) -> np.ndarray:
    """Class of each word from the kinds beside its occurrences (owner: the word of each); words without an occurrence get the number of
    classes. moves: transitions between classes, other words and ends."""
    kinds = len(moves)
    classes = kinds - 2
    share = (moves.sum(axis=0) + 0.5) / (moves.sum() + 0.5 * kinds)
    logs = np.log((moves + prior * share) / (moves.sum(axis=1, keepdims=True) + prior))
    held = moves.sum(axis=0)[:classes]
    out = np.full(len(total), classes, dtype=np.uint8)
    cells = [np.unique(owner * kinds + near, return_counts=True) for near in (left, right)]
    tables = [logs[:, :classes], np.ascontiguousarray(logs[:classes].T)]
    words = np.flatnonzero(total)
    for at in range(0, len(words), _ASSIGNED):
        some = words[at : at + _ASSIGNED]
        score = -total[some, None] * np.log(held + total[some, None])
        for (code, n), table in zip(cells, tables, strict=True):
            a, b = np.searchsorted(code, (some[0] * kinds, (some[-1] + 1) * kinds))
            of = code[a:b] // kinds
            score += np.add.reduceat(n[a:b, None] * table[code[a:b] % kinds], run_starts(of))
        out[some] = score.argmax(axis=1)
    return out


def _block(model: CommonWords, prior: float):
    """One block of words: the class and the count of each word of each portion."""
    moves, classes = model.moves, model.classes

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        n = rows.num_rows
        whole = [rows.column(c).to_pylist() for c in ("texts", "kinds", "places")]
        if key[0].as_py() < 0:
            return pa.Table.from_batches([batch(_ANSWERS, rows.column("block").to_pylist(), rows.column("portion").to_pylist(), [b""] * n, [b""] * n, *whole, [[]] * n)])
        raw = joined(rows.column("words").to_pylist(), "u1").reshape(-1, _WORD_BYTES)
        wide = np.zeros((len(raw), 8), dtype=np.uint8)
        wide[:, :_WORD_BYTES] = raw
        _, word = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
        sizes = [len(x) // _WORD_BYTES for x in rows.column("words").to_pylist()]
        seen = joined(rows.column("seen").to_pylist(), "u4").astype(np.int64)
        left, right = (joined(rows.column(c).to_pylist(), "u1") for c in ("left", "right"))
        total = np.bincount(word, weights=seen, minlength=word.max(initial=-1) + 1).astype(np.int64)
        class_of = likeliest_classes(left, right, np.repeat(word, seen), total, moves, prior)
        bounds = np.cumsum([0, *sizes]).tolist()
        of, count = class_of[word], total[word].astype(np.uint32)
        known = class_of < classes
        sums = np.concatenate([np.bincount(class_of[known], weights=x, minlength=classes) for x in (total[known], np.ones(known.sum()))]).astype(np.int64).tolist()
        parts = [[binary(x[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] for x in (of, count)]
        return pa.Table.from_batches([batch(_ANSWERS, rows.column("block").to_pylist(), rows.column("portion").to_pylist(), *parts, *whole, [sums, *[[]] * (n - 1)])])

    return run


def _gathered(classes: int):
    """One portion: its texts, and the classes of all their words."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("block").to_numpy(), kind="stable")
        of, count = (joined([x[i] for i in order], t) for x, t in ((rows.column("classes").to_pylist(), "u1"), (rows.column("counts").to_pylist(), "u4")))
        texts = joined(rows.column("texts").to_pylist(), "u1").view(_TEXT).copy()
        kinds = joined(rows.column("kinds").to_pylist(), "u1").copy()
        place = joined(rows.column("places").to_pylist(), "u4")
        rare = kinds == classes
        text = np.repeat(np.arange(len(texts)), texts["tokens"])[rare]
        kinds[rare] = of[place]
        n = count[place].astype(np.int64)
        texts["known"] += np.bincount(text, weights=n > 0, minlength=len(texts)).astype(np.int64)
        texts["base"] += np.bincount(text, weights=np.log10(n + 0.5), minlength=len(texts))
        return pa.Table.from_batches([batch(_PORTIONS, [binary(texts)], [binary(kinds)])])

    return run


def _moves(classes: int):
    """Transitions of the training texts of portions."""
    kinds = classes + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(kinds * kinds, dtype=np.int64)
        for part in batches:
            for texts, row in zip(part.column("texts").to_pylist(), part.column("kinds").to_pylist(), strict=True):
                texts, row = np.frombuffer(texts, dtype=_TEXT), np.frombuffer(row, dtype=np.uint8)
                learn = np.repeat(texts["learn"], texts["tokens"])
                total += np.bincount((_histories(row, classes + 1) * kinds + row)[learn], minlength=len(total))
        found = np.flatnonzero(total)
        yield batch(_COUNTS, found, total[found])

    return run


def _log_steps(moves: np.ndarray, mass: np.ndarray, unknown: float, settings: BrownSettings) -> np.ndarray:
    """log10 of P(class | h) / mass(class) by kind before and kind; of P(end | h); and of the share of one unknown word."""
    kinds = len(moves)
    classes = kinds - 2
    between = moves[:classes, :classes]
    busy = np.argsort(-between.sum(axis=1), kind="stable")
    group_of = np.zeros(kinds, dtype=np.int64)
    group_of[busy] = exchange(between[np.ix_(busy, busy)], settings.groups, settings.rounds)
    group_of[classes:] = group_of[:classes].max() + np.array([1, 2])
    by_group = np.zeros((int(group_of.max()) + 1, kinds))
    np.add.at(by_group, group_of, moves)
    prior, some = settings.transition_prior, np.arange(kinds) != classes
    share = np.where(some, moves.sum(axis=0) + 0.5, 0.0)
    share /= share.sum()
    by_group = (by_group + prior * share) / (by_group.sum(axis=1, keepdims=True) + prior)
    steps = (moves + prior * by_group[group_of]) / (moves.sum(axis=1, keepdims=True) + prior) * (1 - unknown)
    steps[:, :classes] /= np.where(mass > 0, mass, 1.0)
    steps[:, classes] = unknown
    return np.log10(steps)


def _scored(classes: int, steps: np.ndarray, log_bottom: float, n_training: int, n_ends: int):
    """Scores of the texts of portions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for texts, row in zip(part.column("texts").to_pylist(), part.column("kinds").to_pylist(), strict=True):
                texts, row = np.frombuffer(texts, dtype=_TEXT), np.frombuffer(row, dtype=np.uint8)
                n = len(texts)
                text = np.repeat(np.arange(n), texts["tokens"])
                unknown = np.bincount(text, weights=row == classes, minlength=n)
                # The base has log(count + 1/2) of all words and the end; that of known words is the emission's upper part.
                words = texts["base"] - unknown * np.log10(0.5) - np.log10(n_ends + 0.5)
                score = words + np.bincount(text, weights=steps[_histories(row, classes + 1), row], minlength=n)
                ids = pa.array(texts["id"].astype(np.int64), mask=texts["no_id"].astype(bool))
                base = texts["base"] - texts["tokens"] * log_bottom
                yield batch(_SCORES, ids, texts["held"].astype(bool), texts["tokens"].astype(np.int64), texts["known"].astype(np.int64), np.full(n, n_training), base, score)

    return run


def brown_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: BrownSettings = BrownSettings()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row. Rows whose crc32(id as text) mod 5 is 1 are held out;
    the model and the base model learn from the others."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(fold != 1, F.lit(False)).alias("learn"), F.coalesce(fold == 1, F.lit(False)).alias("held_out")
    )
    model = fit_common_words(rows, settings)
    classes = model.classes
    blocks = max(1, -(-model.n_rare * 5 // 4 // settings.block))
    entries = rows.mapInArrow(_deal(model, blocks, settings), _ENTRIES_DDL)
    answers = checkpointed(entries.groupBy("block").applyInArrow(_block(model, settings.transition_prior), _ANSWERS_DDL))
    sums = np.zeros(2 * classes, dtype=np.int64)
    for r in answers.select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
        sums[r.at] = r.n
    tokens, types = sums[:classes], sums[classes:]
    mass = tokens + 0.5 * types + np.bincount(model.class_of, weights=model.counts + 0.5, minlength=classes)
    bottom = model.n_tokens + 0.5 * (int(types.sum()) + len(model.common) + (model.n_ends > 0) + 1)
    portions = checkpointed(answers.drop("sums").groupBy("portion").applyInArrow(_gathered(classes), "texts binary, kinds binary"))
    codes, n = _total(portions.mapInArrow(_moves(classes), "code long, n long"))
    moves = np.zeros((classes + 2) ** 2)
    moves[codes] = n
    # Half a count more than in the base: without training rows the end keeps a share.
    steps = _log_steps(moves.reshape(classes + 2, -1), mass, 0.5 / (bottom + 0.5), settings)
    return portions.mapInArrow(_scored(classes, steps, float(np.log10(bottom)), model.n_tokens, model.n_ends), _SCORES_DDL)
