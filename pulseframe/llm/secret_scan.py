r"""Secrets in texts: fixed patterns, and a battery of randomness tests on any long token.

Fixed kinds, found leftmost and without overlaps, by kind:
  assign  a word such as password or token, a separator, a value of 12 characters or more
  access  an access key id of 18 characters or more
  hex     16 lower-case hex digits or more
The battery looks at other runs of 16 or more of A-Z a-z 0-9 + / _ -. For the run's inferred encoding (hex, letters of one case, base 32,
lower-case base 36, base 64) it makes a chi-squared test of uniformity over the alphabet, a runs test and a test of serial correlation, each against two ideas:
  even      symbols drawn evenly from the alphabet; a run that is unlikely so (p of the joined tests below 0.001) is no secret
  ordinary  names or words of this length, whatever joins them (+ / _ - do not count): symbols coincide as often as letters of a text do,
            classes of characters (lower case, upper case, digits) change at few places, a capital's step to lower case aside, and neighbours
            are alike; in letters of one case, vowels and consonants change often
The tests against `ordinary` that can tell the two ideas apart for this encoding are joined by Fisher's method to one p-value, which falls with length
as evidence grows. Over all long tokens of a text, the Benjamini-Hochberg procedure on these keeps the share of false finds below 0.01. Such
finds get the kind `random`; they are only added where no fixed kind has a span. So are short or chance-like strings missed: of random
tokens of 40 letters of one case, some are.

Rows with equal ids or texts each have their own result; the text of a very long document is one value of a task.
Whole texts are scanned; null and empty texts have no spans. A task first looks, over whole batches, for texts that can have a
span at all; only these are matched one by one.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.frames import release_memory
from pulseframe.llm.words import find_runs, text_batches

KINDS = ("assign", "access", "hex", "random")
#: An ordinary token changes its character class at a place with this chance.
CHANGE_RATE = 0.1
#: An ordinary word goes from vowel to consonant or back at a place with this chance.
VOWEL_RATE = 0.58
#: Two symbols of ordinary tokens are the same with this chance.
COINCIDENCE = 0.065
#: Neighbours in an ordinary token of several classes are correlated at least so far.
LIKENESS = 0.3
FALSE_SHARE = 0.01
LOOKS_RANDOM = 0.001

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_SEPARATORS = re.compile(r"[+/_-]+")
_ALPHABETS = (
    re.compile(r"[0-9a-f]+|[0-9A-F]+"),
    re.compile(r"[a-z]+|[A-Z]+"),
    re.compile(r"[A-Z2-7]+"),
    re.compile(r"[a-z0-9]+"),
)
_SYMBOLS = ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")


def _table(characters: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(characters.encode())] = True
    return table


_TOKEN_BYTES = _table(_SYMBOLS[4] + "_-")


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, free: float, upper: bool = True) -> float:
    """Chance that chi-squared of so many degrees of freedom exceeds x, or stays below it, by Wilson and Hilferty's cube root."""
    z = ((x / free) ** (1 / 3) - 1 + 2 / (9 * free)) / math.sqrt(2 / (9 * free))
    return 0.5 * math.erfc((z if upper else -z) / math.sqrt(2))


def _joined_p(chances: list[float]) -> float:
    """Fisher's method: chance of as small a product of p-values."""
    joint = -sum(math.log(min(1.0, max(p, 1e-300))) for p in chances)
    terms = accumulate(range(1, len(chances)), lambda term, i: term * joint / i, initial=1.0)
    return min(1.0, math.exp(-joint) * sum(terms))


def _codes(token: str) -> tuple[list[int], int]:
    """Places of a token's symbols in the alphabet of its inferred encoding, and the alphabet's size."""
    kind = next((i for i, p in enumerate(_ALPHABETS) if p.fullmatch(token)), 4)
    place = {c: i for i, c in enumerate(_SYMBOLS[kind])}
    text = token.lower() if kind < 2 else token.replace("-", "+").replace("_", "/")
    return [place[c] for c in text], len(place)


def _serial(codes: list[int]) -> float:
    """Correlation of neighbours; 1 for equal symbols."""
    centre = sum(codes) / len(codes)
    square = sum((c - centre) ** 2 for c in codes)
    return sum((a - centre) * (b - centre) for a, b in zip(codes, codes[1:], strict=False)) / square if square else 1.0


def randomness(token: str) -> float:
    """p-value of the battery against `even`: low if the token does not look like symbols drawn evenly from its encoding's alphabet."""
    codes, size = _codes(token)
    n = len(codes)
    bins = min(size, max(2, n // 5))
    counts = [0] * bins
    for c in codes:
        counts[c * bins // size] += 1
    shares = [0] * bins
    for c in range(size):
        shares[c * bins // size] += 1
    chi = sum((o - n * s / size) ** 2 / (n * s / size) for o, s in zip(counts, shares, strict=True))
    high = [c * 2 >= size for c in codes]
    ups = sum(high)
    mean = 1 + 2 * ups * (n - ups) / n
    spread = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    p_runs = _normal_tail((runs - mean) / math.sqrt(spread)) if 0 < ups < n else 2.0 ** (1 - n)
    return _joined_p([_chi_tail(chi, bins - 1), p_runs, _normal_tail((_serial(codes) + 1 / n) * math.sqrt(n))])


def _at_least(k: int, n: int, rate: float) -> float:
    """Chance of k or more among n, each with this rate."""
    if k <= 0:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log(1 - rate)
    odds = rate / (1 - rate)
    if k <= n * rate:  # the terms below k are the smaller part
        terms = accumulate(range(k, 0, -1), lambda term, i: term * i / ((n - i + 1) * odds), initial=math.exp(log))
        return max(0.0, 1 - sum(terms) + math.exp(log))
    terms = accumulate(range(k, n), lambda term, i: term * (n - i) / (i + 1) * odds, initial=1.0)
    return math.exp(log) * sum(terms)


def as_even(codes: list[int], size: int) -> float | None:
    """Chance that ordinary symbols are spread as evenly: the lower tail of chi-squared, off centre by what coincidence makes of this
    length (Patnaik's approximation). Nothing for small alphabets, of which ordinary symbols use all."""
    n, free = len(codes), size - 1
    off = n * (COINCIDENCE * size - 1)
    if off < n / 4:
        return None
    counts = [0] * size
    for c in codes:
        counts[c] += 1
    chi = sum((o - n / size) ** 2 for o in counts) * size / n
    scale, like = (free + 2 * off) / (free + off), (free + off) ** 2 / (free + 2 * off)
    return _chi_tail(chi / scale, like, upper=False)


def _class(c: str) -> str:
    return "l" if c.islower() else "u" if c.isupper() else "d"


def ordinary(token: str) -> float:
    """p-value of the battery against `ordinary`: low if a name or words of this length hardly look as random as the token."""
    core = _SEPARATORS.sub("", token)
    if len(core) < 8:
        return 1.0
    classes = [_class(c) for c in core]
    places = len(core) - 1
    changes = sum(a != b and (a, b) != ("u", "l") for a, b in zip(classes, classes[1:], strict=False))
    codes, size = _codes(core)
    if len(set(classes)) > 1:
        apart = math.atanh(max(-0.999, min(0.999, _serial(codes)))) - math.atanh(LIKENESS)
        chances = [_at_least(changes, places, CHANGE_RATE), 0.5 * math.erfc(-apart * math.sqrt(places - 2) / math.sqrt(2))]
    elif classes[0] in "lu":
        vowels = [c in "aeiouy" for c in core.lower()]
        turns = sum(a != b for a, b in zip(vowels, vowels[1:], strict=False))
        chances = [_at_least(places - turns, places, 1 - VOWEL_RATE)]
    else:
        return 1.0
    even = as_even(codes, size)
    return _joined_p(chances if even is None else [*chances, even])


def false_discovery(chances: list[float], share: float) -> float:
    """The largest p-value that the Benjamini-Hochberg procedure accepts; below 0 if none."""
    ranked = sorted(chances)
    return max((p for i, p in enumerate(ranked, 1) if p <= share * i / len(ranked)), default=-1.0)


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans of one text, by start, then kind."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    taken = sorted((s, e) for _, s, e in found)
    starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    tested = []
    for m in _TOKEN.finditer(text):
        p = ordinary(m[0])
        tested.append((p if p < 0.5 and randomness(m[0]) >= LOOKS_RANDOM else 1.0, m.start(), m.end()))
    limit = false_discovery([p for p, _, _ in tested], FALSE_SHARE)
    for p, s, e in tested:
        before = bisect_left(starts, e)
        if p <= limit and not (before and ends[before - 1] > s):
            found.append(("random", s, e))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def _may_have(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that can have a span: a sign of an assignment, or a long run of token characters (those of hex are among them)."""
    maybe = np.zeros(len(offsets) - 1, dtype=bool)

    def mark(places: np.ndarray) -> None:
        maybe[np.searchsorted(offsets, places, side="right") - 1] = True

    mark(np.flatnonzero((data == ord("=")) | (data == ord(":"))))
    start, end = find_runs(data, offsets, _TOKEN_BYTES)
    mark(start[end - start >= 16])
    return maybe


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])


def _secrets(column: pa.Array) -> pa.Array:
    out = []
    for data, offsets in text_batches(column):
        maybe = _may_have(data, offsets)
        for i, may in enumerate(maybe.tolist()):
            spans = spans_of(data[offsets[i] : offsets[i + 1]].tobytes().decode()) if may else []
            out.append([{"kind": k, "start": s, "stop": e} for k, s, e in spans])
    return pa.array(out, type=pa.list_(_SPAN))


def secrets(text: Column) -> Column:
    """array<struct<kind, start, stop>>: spans in code points, end exclusive, by start, then kind."""
    return F.arrow_udf(_secrets, "array<struct<kind: string, start: int, stop: int>>")(text)


def _redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    parts, at = [], 0
    for _, start, stop in spans:
        if stop > at:
            parts += [text[at : max(at, start)], "[secret]" if start >= at else ""]
            at = stop
    return "".join(parts) + text[at:]


def _without_secrets(column: pa.Array) -> pa.Array:
    found, texts, at = [], column.to_pylist(), 0
    for data, offsets in text_batches(column):
        for i, may in enumerate(_may_have(data, offsets).tolist(), at):
            spans = spans_of(texts[i]) if may else []
            found.append(bool(spans))
            if spans:
                texts[i] = _redacted(texts[i], spans)
        at += len(offsets) - 1
    release_memory()
    return pa.StructArray.from_arrays([pa.array(found, pa.bool_()), pa.array(texts, pa.string())], names=["found", "text"])


def without_secrets(text: Column) -> Column:
    """struct<found: boolean, text: string>: whether a text has a span, and the text with each span (overlapping ones together) replaced by
    [secret]. A null text stays null."""
    return F.arrow_udf(_without_secrets, "struct<found: boolean, text: string>")(text)


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of each row."""
    found = docs.select(F.col(id_col).alias("doc_id"), secrets(F.col(text_col)).alias("found"))
    base = F.filter("found", lambda s: s.kind != "random")
    digest = F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", _count("assign"), _count("access"), _count("hex"), digest, _joined(F.col("found")).alias("spans"), _count("random"))
