"""Fill-in-middle transformation with a sparse exception index between code points and bytes.

A text is cut at two of its units into prefix, middle and suffix, which are written in another order behind marks. Units are words with the
blanks before them (blanks at the end of a text are a unit of their own), or code points. Cuts are drawn as numbers of units, found as byte
places (words) or as code-point places (code points), and needed as both: bytes to cut the text, code points to report the parts. The index
that converts one into the other records only the multibyte characters of a batch: their places and the bytes that they have in excess of
one. Between two of them code points and bytes run in step, so that a place is one searchsorted and one subtraction; a batch of plain ASCII
has an empty index.

The draws follow from a digest of a seed and the id, so they are the same wherever and however often a row is handled. A text stays plain
(as it is) if it is empty, if it contains a mark, or by its draw. No mark can arise where parts and marks meet, since a mark begins with
the one character `<` that stands nowhere else in it; so the first marks found in an output are those that were written, and `restored`
gives back the exact text.

Scale: one pass over the rows, nothing shuffled or kept; a task holds one batch of rows and cuts `words.CHUNK_BYTES` of text at a time.

A null text counts as empty; empty texts are plain, with no units. A null id draws as an empty one. Whole texts are cut, however long; a
single longer text is a portion of its own. Rows of one id draw the same numbers, repeated rows give equal results. Other columns of the table
have no influence, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.words import find_words, text_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_CUT = "n long, prefix_chars long, middle_chars long, output string"
_EXCESS = np.zeros(256, dtype=np.int64)
_EXCESS[0xC0:0xE0], _EXCESS[0xE0:0xF0], _EXCESS[0xF0:0xF8] = 1, 2, 3


@dataclass(frozen=True)
class MiddleSettings:
    #: Text before the id in the digest that the draws are taken from.
    seed: str = "42"
    #: "word" or "char".
    unit: str = "word"
    #: Texts of a hundred that are transformed, and those of a hundred transformed ones that get the suffix first.
    transformed: int = 50
    suffix_first: int = 80


class ExceptionIndex:
    """Places of the multibyte characters in UTF-8 bytes, and the running sum of their bytes in excess of one."""

    def __init__(self, data: np.ndarray) -> None:
        self.at = np.flatnonzero(data >= 0xC0)
        self.excess = np.concatenate([[0], np.cumsum(_EXCESS[data[self.at]])])
        self.at_char = self.at - self.excess[:-1]

    def chars(self, place: np.ndarray) -> np.ndarray:
        """Code points before byte places, which must lie between characters."""
        return place - self.excess[np.searchsorted(self.at, place)]

    def bytes(self, place: np.ndarray) -> np.ndarray:
        """Bytes before code-point places."""
        return place + self.excess[np.searchsorted(self.at_char, place)]


def _cuts(data: np.ndarray, offsets: np.ndarray, draws: tuple[np.ndarray, np.ndarray], unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, ExceptionIndex]:
    """(number of units, byte of the end of the prefix, byte of the end of the middle) of each text, and the index they were found with."""
    index = ExceptionIndex(data)
    begin, end = offsets[:-1], offsets[1:]
    if unit == "char":
        first = index.chars(begin)
        n = index.chars(end) - first
        places = [index.bytes(first + draw % (n + 1)) for draw in draws]
    else:
        words = find_words(data, offsets)
        last = np.zeros(len(begin), dtype=np.int64)  # end of the last word
        has = words.counts > 0
        last[has] = words.end[words.first[1:][has] - 1]
        n = words.counts + ((last < end) & (end > begin))
        places = []
        for draw in draws:
            units = draw % (n + 1)
            inside = (units > 0) & (units <= words.counts)
            place = np.where(units > 0, end, begin)
            place[inside] = words.end[words.first[:-1][inside] + units[inside] - 1]
            places.append(place)
    return n, np.minimum(*places), np.maximum(*places), index


def _transform(unit: str):
    schema = pa.struct([("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(texts: pa.Array, forms: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        draws = [h.to_numpy(zero_copy_only=False) for h in (h1, h2)]
        counts, prefixes, middles, outputs = [], [], [], []
        at = 0
        for data, offsets in text_batches(texts):
            size = len(offsets) - 1
            n, a, b, index = _cuts(data, offsets, tuple(d[at : at + size] for d in draws), unit)
            start, mid, stop = index.chars(offsets[:-1]), index.chars(a), index.chars(b)
            counts.append(n)
            prefixes.append(mid - start)
            middles.append(stop - mid)
            raw, out = data.tobytes(), []
            for form, i, j, k, m in zip(forms[at : at + size].to_pylist(), offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist(), strict=True):
                if form == "psm":
                    out.append(b"".join((b"<P>", raw[i:j], b"<S>", raw[k:m], b"<M>", raw[j:k])))
                elif form == "spm":
                    out.append(b"".join((b"<S>", raw[k:m], b"<P>", raw[i:j], b"<M>", raw[j:k])))
                else:
                    out.append(raw[i:m])
            outputs.append(pa.array(out, type=pa.binary()).cast(pa.string()))
            at += size
        if not outputs:
            return pa.array([], type=schema)
        columns = [pa.array(np.concatenate(c)) for c in (counts, prefixes, middles)]
        return pa.StructArray.from_arrays([*columns, pa.concat_arrays(outputs)], fields=list(schema))

    return run


def draws(doc_id: Column, seed: str) -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 digest of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: MiddleSettings = MiddleSettings()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row: units, form (plain, psm or spm), code points of the first two parts
    (null if plain) and the text in its new order."""
    if settings.unit not in ("word", "char"):
        raise ValueError(f"unknown unit {settings.unit}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col(id_col), settings.seed), 1)])
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= settings.transformed)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < settings.suffix_first, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", form.alias("form"), "h1", "h2")
    cut = F.arrow_udf(_transform(settings.unit), _CUT)("text", "form", "h1", "h2")
    rows = rows.select("doc_id", "form", cut.alias("cut"))
    parts = [F.when(F.col("form") != "plain", F.col(f"cut.{c}")).alias(c) for c in ("prefix_chars", "middle_chars")]
    return rows.select("doc_id", "cut.n", "form", *parts, "cut.output")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    psm = F.regexp_replace(output, f"(?s)^{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)$", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)$", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def middle_digests(found: DataFrame) -> DataFrame:
    """The rows of fill_in_middle with digests of the output and of the restored text in place of the output."""
    digests = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
