"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy.

Features are byte n-grams inside words (A-Z as a-z; a blank may be the first or last byte, so that beginnings and ends of words differ)
and whole words, hashed to `buckets` embeddings. A text is the mean of all its features' embeddings, classified by a linear softmax.
Once trained, embedding times weights is one row of logits per bucket, so that a text's logits are a mean of rows.

The model is fitted on a bounded sample of labelled rows: excerpts of at most `sample_chars` code points from about `per_language` rows of each
label, fewer if there are so many labels that this would be more than `most_texts`; rows and places are chosen by hashes of the id. All
labels are learned. Every row is predicted, from its whole text.

Rejection: the score of a text is the probability of its language times its familiarity, the share of its n-grams that occur in the sample
(`prior` more count as known, so that a short text is not judged by a handful). A fifth of the sample calibrates both, beside the same texts
with their bytes shuffled, which are in no language: the temperature has the least log loss, with equal shares as the target of shuffled texts;
the least score that is accepted lies between the highest scores of shuffled texts (`unlike` of them) and the lowest of the others, nearer to
the former (`doubt` of the way) so that odd but clean texts stay; or at the lowest of the others if they overlap.

A null text, and one without a letter, gets `und` with score 0 and is rejected. So does every text if there was nothing to learn from. A
single label is learned too: then only familiarity tells. Rows with a null id are never held out. Long texts are read in whole; repeated rows
get equal results. Other columns of the table have no influence, whatever their names.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm.frames import release_memory
from pulseframe.llm.words import find_words, lowered, mix64, text_batches

UNKNOWN = "und"
#: Text whose features are found at once: each byte has several, of 16 bytes each.
PORTION_BYTES = 300_000
#: Labels whose counts may be broadcast: about 40 bytes each, so 2 MB at most.
_BROADCAST_LABELS = 50_000
_BLANKS = np.zeros(256, dtype=bool)
_BLANKS[[0x20, *range(0x09, 0x0E)]] = True
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True


@dataclass(frozen=True)
class LanguageSettings:
    buckets: int = 1 << 15
    size: int = 16
    grams: tuple[int, ...] = (2, 3, 4)
    per_language: int = 500
    most_texts: int = 20_000
    sample_chars: int = 6_000
    epochs: int = 4
    rate: float = 0.5
    #: Places of the table of known n-grams, and n-grams that count as known in any text.
    known: int = 1 << 20
    prior: int = 8
    #: Share of the shuffled texts that the least score is to lie above, and its way from there to the lowest score of the others.
    unlike: float = 0.95
    doubt: float = 0.25
    seed: int = 11


def _features(data: np.ndarray, offsets: np.ndarray, grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """(hash, number of the text) of all features, sorted by text within each kind of feature, and how many of them are n-grams; these come
    first."""
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), 0
    low = np.where(_BLANKS[data], np.uint8(32), lowered(data))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    blank = low == 32
    hashes, owners = [], []
    for n in grams:
        count = max(0, len(low) - n + 1)
        code = np.zeros(count, dtype=np.uint64)
        whole = text[:count] == text[n - 1 :][:count]
        for j in range(n):
            code = code << np.uint64(8) | low[j : j + count].astype(np.uint64)
            if 0 < j < n - 1:
                whole &= ~blank[j : j + count]
        whole &= ~(blank[:count] & blank[n - 1 : n - 1 + count])
        code = code[whole]
        hashes.append(mix64(code * np.uint64(5) + np.uint64(n)))
        owners.append(text[:count][whole])
    words = find_words(data, offsets)
    hashes.append(mix64(words.hashes(lower=True) + np.uint64(1)))
    owners.append(words.text_of)
    return np.concatenate(hashes), np.concatenate(owners), sum(map(len, hashes[:-1]))


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes % np.uint64(size)).astype(np.int64)


@dataclass
class LanguageModel:
    """Languages, embeddings, output weights, a bias, a table of known n-grams, a temperature and the least score that is accepted."""

    settings: LanguageSettings
    names: list[str]
    embed: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    seen: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0

    def __post_init__(self) -> None:
        # Few languages: a row of logits per bucket; many: a row of the embedding, which is shorter.
        few = len(self.names) <= self.embed.shape[1]
        self.rows, self.weights = (self.embed @ self.out, None) if few else (self.embed, self.out)

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Uncalibrated logits, and the familiarity, of each text."""
        n = len(offsets) - 1
        hashes, owner, grams = _features(data, offsets, self.settings.grams)
        bucket = _places(hashes, self.settings.buckets)
        total = np.maximum(np.bincount(owner, minlength=n), 1)
        mean = np.empty((n, self.rows.shape[1]))
        for k in range(self.rows.shape[1]):
            mean[:, k] = np.bincount(owner, weights=self.rows[:, k][bucket], minlength=n) / total
        known = self.seen[_places(hashes[:grams] >> np.uint64(20), len(self.seen))]
        familiar = np.bincount(owner[:grams], weights=known, minlength=n) + self.settings.prior
        familiar /= np.bincount(owner[:grams], minlength=n) + self.settings.prior
        return (mean if self.weights is None else mean @ self.weights) + self.bias, familiar

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the likeliest language, score) of each text."""
        return self.scored(*self.raw(data, offsets))

    def scored(self, raw: np.ndarray, familiar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = _softmax(raw / self.temperature)
        best = found.argmax(axis=1)
        return best, found[np.arange(len(best)), best] * familiar

    def predict(self, text: Column) -> Column:
        """struct<lang, score, accepted> of a text column."""
        if not self.names:
            return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
        fields = (self.names, self.embed, self.out, self.bias, self.seen, self.temperature, self.least_score)
        shared = SparkSession.active().sparkContext.broadcast((asdict(self.settings), *fields))

        def run(column: pa.Array) -> pa.Array:
            settings, *rest = shared.value
            model = LanguageModel(LanguageSettings(**settings), *rest)
            names = np.array([*model.names, UNKNOWN], dtype=object)
            langs, scores = [], []
            for data, offsets in text_batches(column, PORTION_BYTES):
                best, score = model.scores(data, offsets)
                none = ~_has_letter(data, offsets)
                best[none], score[none] = len(model.names), 0.0
                langs += names[best].tolist()
                scores.append(score)
            score = np.concatenate(scores) if scores else np.zeros(0)
            release_memory()
            accepted = (score >= model.least_score) & (np.array(langs, dtype=object) != UNKNOWN)
            return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score), pa.array(accepted.astype(bool))], names=["lang", "score", "accepted"])

        return F.arrow_udf(run, "struct<lang: string, score: double, accepted: boolean>")(text)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    counts = np.concatenate([[0], np.cumsum(_LETTERS[data])])
    has = counts[offsets[1:]] > counts[offsets[:-1]]
    for i in np.flatnonzero(~has).tolist():
        has[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return has


def train(texts: pa.Array, labels: list[str], settings: LanguageSettings) -> LanguageModel:
    """Stochastic gradient descent, one text at a time; then calibration on every fifth text."""
    names = sorted(set(labels))
    number = {name: i for i, name in enumerate(names)}
    target = np.array([number[x] for x in labels])
    random = np.random.default_rng(settings.seed)
    place = random.permutation(len(texts))
    held, learn = place[: len(texts) // 5], place[len(texts) // 5 :]
    known = np.zeros(settings.known, dtype=bool)
    rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i in learn.tolist():
        text = np.frombuffer(texts[i].as_py().encode(), dtype=np.uint8)
        hashes, _, grams = _features(text, np.array([0, len(text)]), settings.grams)
        bucket, counts = np.unique(_places(hashes, settings.buckets), return_counts=True)
        rows[i] = bucket.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)
        known[_places(hashes[:grams] >> np.uint64(20), settings.known)] = True
    share = np.bincount(target[learn], minlength=len(names))
    weight = share.sum() / np.maximum(share, 1) / len(names)  # rare labels count as much as common ones
    embed = (random.random((settings.buckets, settings.size), dtype=np.float32) - 0.5) / settings.size
    out = np.zeros((settings.size, len(names)), dtype=np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    steps, done = settings.epochs * max(1, len(learn)), 0
    for _ in range(settings.epochs):
        for i in random.permutation(learn):
            bucket, share_of = rows[i]
            if not len(bucket):
                continue
            rate = np.float32(settings.rate * (1 - done / steps) * min(weight[target[i]], 5.0))
            done += 1
            hidden = share_of @ embed[bucket]
            error = _softmax((hidden @ out + bias)[None])[0].astype(np.float32)
            error[target[i]] -= 1
            back = out @ error
            out -= rate * np.outer(hidden, error)
            bias -= rate * error
            # The mean spreads the step thinly over many rows; scaling by their number keeps them learning at the output's pace.
            embed[bucket] -= rate * np.float32(np.sqrt(len(bucket))) * np.outer(share_of, back)
    model = LanguageModel(settings, names, embed, out, bias.astype(np.float64), known)
    rows.clear()
    _calibrate(model, [texts[i].as_py().encode() for i in held.tolist()], target[held])
    release_memory()
    return model


def _shuffled(text: bytes, random: np.random.Generator) -> bytes:
    """The text with all its bytes but blanks in random order."""
    out = np.frombuffer(text, dtype=np.uint8).copy()
    solid = ~_BLANKS[out]
    out[solid] = random.permutation(out[solid])
    return out.tobytes()


def _calibrate(model: LanguageModel, texts: list[bytes], target: np.ndarray) -> None:
    def measured(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Logits and familiarity, some texts at a time."""
        found, at = [], 0
        ends = np.cumsum([len(p) for p in parts])
        while at < len(parts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION_BYTES, side="right")))
            some = parts[at:stop]
            found.append(model.raw(np.frombuffer(b"".join(some), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in some])])))
            at = stop
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    use = [i for i, t in enumerate(texts) if t.strip()]
    if not use:
        return
    random = np.random.default_rng(model.settings.seed)
    own, familiar = measured([texts[i] for i in use])
    other, strange = measured([_shuffled(texts[i], random) for i in use])
    target = target[use]

    def loss(t: float) -> float:
        right, none = (np.log(np.maximum(_softmax(x / t), 1e-12)) for x in (own, other))
        return -right[np.arange(len(use)), target].mean() - none.mean()

    model.temperature = float(min(np.geomspace(0.001, 1000, 121), key=loss))
    (best, score), (_, shuffled) = model.scored(own, familiar), model.scored(other, strange)
    score = score[best == target]  # a wrong prediction says nothing about texts that are to stay
    if len(score):
        most = np.quantile(shuffled, model.settings.unlike)
        model.least_score = float(min(score.min(), most + model.settings.doubt * (score.min() - most)))


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: LanguageSettings = LanguageSettings()) -> LanguageModel:
    """A model from rows with text and label whose crc32(id as text) mod 3 is not 1."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.where(fold(F.col("id")) != 1)
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    labels = counts.count()
    if not labels:
        nothing = np.zeros((settings.buckets, settings.size), dtype=np.float32)
        return LanguageModel(settings, [], nothing, np.zeros((settings.size, 0), dtype=np.float32), np.zeros(0), np.zeros(1, dtype=bool))
    each = min(settings.per_language, max(5, settings.most_texts // labels))
    draw = F.pmod(F.xxhash64("id", F.lit(settings.seed)), F.lit(1 << 30))
    if labels <= _BROADCAST_LABELS:
        counts = F.broadcast(counts)
    chosen = rows.join(counts, "lang").where(draw < F.least(F.lit(1.0), each / F.col("n")) * (1 << 30))
    # Excerpts from anywhere in a text.
    spare = F.greatest(F.length("text") - settings.sample_chars, F.lit(0))
    excerpt = F.substring("text", (F.pmod(F.xxhash64("id", F.lit(settings.seed + 1)), spare + 1) + 1).cast("int"), F.lit(settings.sample_chars))
    sample = chosen.select("id", "lang", excerpt.alias("text")).orderBy("id", "lang", "text").toArrow()
    return train(sample.column("text").combine_chunks(), sample.column("lang").to_pylist(), settings)


def fold(doc_id: Column, folds: int = 3) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of each row."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(F.col(id_col)) == 1, F.lit(False)).alias("held_out"), model.predict(F.col(text_col)).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.accepted")
