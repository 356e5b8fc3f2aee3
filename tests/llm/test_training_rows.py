"""Hard negatives, packing and fill-in-middle against brute force, on the small given tables and on tables of odd rows."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import sql
from pulseframe.llm.fill_in_middle import ExceptionIndex, MiddleSettings, fill_in_middle, middle_digests, restored
from pulseframe.llm.negative_mining import MiningSettings, hard_negatives, spanning_tree
from pulseframe.llm.registry import llm_queries
from pulseframe.llm.sequence_packing import PackSettings, packed, piece_checksums, read_tokenizer, shortest_pack_first
from tests.llm import cases

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    more = [(400, "a<P>b c"), (401, "<S"), (402, "x <M> y"), (403, "é" * 50 + " 東京 🙂 \n"), (404, "\t lead and trail \r\n"), (405, "<|endoftext|> A<|startoftext|>B 007 it's"), (406, "ÀÉÎ ΣΑΣ İx µ a\x00b a\x1cb \x85")]
    rows = [(i, t, "en", "s", 0, *cases.EXTRA) for i, t in more]
    return cases.documents(spark).union(spark.createDataFrame(rows, cases.SCHEMA)).cache()


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name, text", [("op11_negative_mining", sql.NEGATIVE_MINING), ("op13_fill_in_middle", sql.FILL_IN_MIDDLE)])
def test_query_equals_sql(spark, database, name, text):
    frame = llm_queries()[name](spark, FOLDER)
    cursor = database.execute(text)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    want = Counter(cursor.fetchall())
    assert want and Counter(tuple(r) for r in frame.select(*names).collect()) == want


# --- hard negatives


def mined(rows, anchors, settings):
    """rows: distinct (id, label, integer vector) -> multiset of result rows."""
    found = Counter()
    for i, label, vector in rows:
        if not anchors(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(vector, v, strict=False)), j, lab) for j, lab, v in rows if j != i)
        for minus, positive, _ in [s for s in scored if s[2] == label][: settings.positives]:
            inside = [(m, j) for m, j, lab in scored if lab != label and settings.low * -minus <= 100 * -m <= settings.high * -minus]
            found.update((i, positive, rank, j, -minus, -m) for rank, (m, j) in enumerate(inside[: settings.negatives], 1))
    return found


def vectors(spark, seed, n, size, labels, spread=1.0):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(size)] for _ in range(4)]
    rows = []
    for i in range(n):
        centre = draw.choice(centres)
        label = 0 if draw.random() < 0.4 else draw.randrange(labels)  # one label holds a third and more
        rows.append((i, label, [c + spread * draw.gauss(0, 1) for c in centre]))
    return rows


SCHEMA = "vec_id long, label int, embedding array<double>, id long, key string, score long, asks boolean, rank int, block int"
CLASH = (1, "k", 2, False, 3, 4)


@pytest.mark.parametrize("spread, settings", [(0.05, MiningSettings(block=16, part=64, portion=16, sample=8)), (1.0, MiningSettings(block=7, part=50, portion=9, positives=3, negatives=4)), (0.3, MiningSettings(low=-50, high=120, block=200))])
def test_negatives(spark, spread, settings):
    rows = vectors(spark, 5, 400, 6, 5, spread)
    whole = [(i, lab, [math.floor(settings.scale * x) for x in v]) for i, lab, v in rows]
    frame = spark.createDataFrame([(i, lab, v, *CLASH) for i, lab, v in rows], SCHEMA).repartition(4)
    found = hard_negatives(frame, F.col("vec_id") % 5 == 0, F.col("label"), settings=settings).collect()
    assert Counter(map(tuple, found)) == mined(whole, lambda i: i % 5 == 0, settings)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.4]), (2, 2, [0.5, 0.4]), (3, 2, [0.5, 0.4]), (3, 2, [0.5, 0.4]), (4, 2, None), (5, None, [1.0, 1.0]),
        (6, 2, [nan, 1.0]), (7, 1, [inf, 1.0]), (8, 1, [1.0, None]), (9, 2, []), (10, 1, [0.0, 0.0]), (None, 1, [1.0, 1.0]), (11, 3, [0.9]), (12, 2, [0.5, 0.4, 0.1]),
        (13, 1, [0.7, 0.6]), (14, 2, [-1.0, 0.3]), (15, 9, [1.0, 1.0]), (3, 1, [0.2, 0.2]),
    ]
    frame = spark.createDataFrame([(i, lab, v, *CLASH) for i, lab, v in rows], SCHEMA)
    usable = {(i, lab, tuple(math.floor(256 * x) for x in v)) for i, lab, v in rows if None not in (i, lab, v) and None not in v and all(map(math.isfinite, v))}
    for settings in (MiningSettings(), MiningSettings(block=2, part=3, portion=2)):
        found = hard_negatives(frame, F.lit(True), F.col("label"), settings=settings).collect()
        assert Counter(map(tuple, found)) == mined(sorted(usable), lambda i: True, settings) and found
    assert hard_negatives(frame, F.lit(False), F.col("label")).count() == 0
    assert hard_negatives(frame.limit(0), F.lit(True), F.col("label")).count() == 0


def test_spanning_tree():
    points = np.random.default_rng(3).normal(size=(60, 3))
    order, parent, edge = spanning_tree(points)
    assert sorted(order.tolist()) == list(range(60)) and parent[order[0]] == -1
    place = {v: k for k, v in enumerate(order.tolist())}
    assert all(place[parent[i]] < place[i] and math.isclose(edge[i], np.linalg.norm(points[i] - points[parent[i]])) for i in order[1:].tolist())
    # Kruskal's total length
    pairs = sorted((np.linalg.norm(points[i] - points[j]), i, j) for i in range(60) for j in range(i))
    of, total = list(range(60)), 0.0
    for away, i, j in pairs:
        if of[i] != of[j]:
            total, old = total + away, of[i]
            of = [of[j] if o == old else o for o in of]
    assert math.isclose(edge.sum(), total)


# --- packing


def one_by_one(lengths, capacity):
    """Cuts of the same rule, a document and a pack at a time: multiset of (length, taken) placements, and the packs' totals."""
    whole, left = divmod(sum(lengths), capacity)
    packs = [(-(1 << b), 0) for b in range(capacity.bit_length()) if left >> b & 1]
    heapq.heapify(packs)
    opened, placed, totals = 0, Counter(), []
    waiting = [-n for n in lengths if n]
    heapq.heapify(waiting)
    while waiting:
        length = -heapq.heappop(waiting)
        space, used = (-packs[0][0], packs[0][1]) if packs else (0, 0)
        if space >= length or opened == whole:
            heapq.heappop(packs)
        else:
            space, used, opened = capacity, 0, opened + 1
        take = min(space, length)
        placed[length, take] += 1
        if take < length:
            heapq.heappush(waiting, take - length)
        if space > take:
            heapq.heappush(packs, (take - space, used + take))
        else:
            totals.append(used + take)
    assert not packs
    return placed, Counter(totals)


@pytest.mark.parametrize("seed", range(40))
def test_patterns_equal_packing_one_by_one(seed):
    draw = random.Random(seed)
    capacity = (16, 64, 100)[seed % 3]
    kinds = [lambda: draw.randint(1, capacity - 1), lambda: draw.choice([1, 3, capacity - 1]), lambda: min(capacity - 1, int(draw.lognormvariate(1.5, 1)) + 1), lambda: capacity // 2 + 1]
    lengths = sorted(kinds[seed % 4]() for _ in range(draw.randint(0, 400)))
    patterns = shortest_pack_first(dict(Counter(lengths)), capacity)
    length = np.array(lengths, dtype=np.int64)
    row, start, took, pack, offset = patterns.place(length, np.arange(len(length)) - np.searchsorted(length, length))
    placed = Counter((length[i] - s, t) for i, s, t in zip(row.tolist(), start.tolist(), took.tolist(), strict=True))
    totals = Counter()
    for p, o, t in zip(pack.tolist(), offset.tolist(), took.tolist(), strict=True):
        totals[p] = max(totals[p], o + t)
    assert sorted(totals) == list(range(patterns.packs))
    assert (placed, Counter(totals.values())) == one_by_one(lengths, capacity)
    assert len(row) - len(length) <= patterns.packs


def check_packing(frame, settings, model):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model)
    want = Counter()
    for r in frame.select("doc_id", "text").collect():
        want[r.doc_id, (*tokenizer.encode(r.text or "", add_special_tokens=False).ids, settings.end_id)] += 1
    rows = packed(frame, model, settings=settings).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id, r.doc_tokens].append((r.start, tuple(r.ids)))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == settings.capacity or at & (at - 1) == 0
    # Pieces of each id and length make up its documents.
    assert Counter(i for (_, ids), n in want.items() for i in ids for _ in range(n)) == Counter(i for r in rows for i in r.ids)
    for (doc, n), parts in documents.items():
        texts = [ids for (d, ids), k in want.items() for _ in range(k) if d == doc and len(ids) == n]
        if len(set(texts)) == 1:  # repeated rows: each piece as often as there are rows
            for start, ids in parts:
                assert texts[0][start : start + len(ids)] == ids
            assert sum(len(ids) for _, ids in parts) == n * len(texts)
    assert sum(len(ids) * n for (_, ids), n in want.items()) == sum(r.length for r in rows)
    assert len(rows) - sum(want.values()) <= len(sequences)


def test_packing(odd, given):
    model = read_tokenizer()
    check_packing(odd, PackSettings(capacity=64, bucket=3, known_words=50), model)
    check_packing(odd, PackSettings(), model)
    check_packing(given, PackSettings(), model)
    assert packed(odd.limit(0), model).count() == 0


def test_checksums(odd):
    pieces = packed(odd)
    want = Counter((r.doc_id, r.start, r.length, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)), r.doc_tokens) for r in pieces.collect())
    assert Counter(tuple(r)[:5] for r in piece_checksums(pieces).collect()) == want


def test_checksums_of_bytes(odd):
    """Ids as bytes are those of the lists, and their checksums need no second Python worker beside that of the pieces."""
    settings = PackSettings(capacity=64, bucket=3)
    lists, raw = (packed(odd, settings=settings, as_bytes=b) for b in (False, True))
    want = Counter((*tuple(r)[:4], b"".join(i.to_bytes(4, "little") for i in r.ids)) for r in lists.collect())
    assert Counter((*tuple(r)[:4], bytes(r.ids)) for r in raw.collect()) == want
    assert Counter(tuple(r) for r in piece_checksums(raw).collect()) == Counter(tuple(r) for r in piece_checksums(lists).collect())
    assert packed(odd.limit(0), as_bytes=True).count() == 0


def test_checksums_in_one_python_worker(spark):
    plan = llm_queries()["op12_sequence_packing"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_only_word_tokenizers(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError, match="single words"):
        read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


# --- fill in the middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def transformed(doc_id, text, unit="word"):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text) if unit == "word" else list(text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("unit", ["word", "char"])
def test_fill_in_middle(odd, given, unit):
    for frame in (odd, given):
        rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        found = fill_in_middle(frame, settings=MiddleSettings(unit=unit))
        assert Counter(map(tuple, found.collect())) == Counter(transformed(i, t, unit) for i, t in rows)
        back = found.select("doc_id", restored(F.col("output"), F.col("form")).alias("text")).collect()
        assert Counter(map(tuple, back)) == Counter((i, t or "") for i, t in rows)
    forms = Counter(r.form for r in middle_digests(fill_in_middle(given)).collect())
    assert set(forms) == {"plain", "spm", "psm"}


def test_all_texts_transformed(odd):
    settings = MiddleSettings(seed="x", transformed=100, suffix_first=50)
    found = fill_in_middle(odd, settings=settings)
    rows = found.select("doc_id", "form", "output", restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect())
    assert all((r.form == "plain") == (not r.text or any(m in r.text for m in ("<P>", "<S>", "<M>"))) for r in rows)


def test_no_rows_and_unknown_unit(spark):
    assert fill_in_middle(cases.empty(spark)).count() == 0
    with pytest.raises(ValueError, match="unit"):
        fill_in_middle(cases.empty(spark), settings=MiddleSettings(unit="line"))


@pytest.mark.parametrize("text", ["", "plain", "é", "aé東🙂b", "🙂" * 5, "x" * 9 + "ß"])
def test_exception_index(text):
    index = ExceptionIndex(np.frombuffer(text.encode(), dtype=np.uint8))
    chars = np.arange(len(text) + 1)
    places = np.array([len(text[:i].encode()) for i in chars.tolist()])
    assert index.bytes(chars).tolist() == places.tolist() and index.chars(places).tolist() == chars.tolist()
    assert len(index.at) == sum(ord(c) > 127 for c in text)
