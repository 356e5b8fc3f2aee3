"""Near duplicates by the chosen-path similarity join: trees of selected minwise tokens, small nodes compared exhaustively.

A document's set is its distinct word shingles; documents of one set are one class from the start. Each class has a sketch of minwise
tokens (coordinate i holds the least hash of the set under hash function i). A tree starts with all classes in its root; each node
chooses coordinates by its own hash and sends every member to the child of its token there. Similar sets agree on a coordinate with a
probability equal to their similarity, so they stay together in some child, while others part. Trees are independent; all grow at once.

Nodes are looked at `first_depth` levels below the roots, where each node on the way chooses one coordinate. A small node compares all its
pairs. In a large one, each member is first compared with the node's smallest member, which settles a group of copies with one
comparison per member; if the members are then all in one component, the node is done. If one component holds half of the members, the
node is a group of copies that further levels would not part: its other members are compared with all members, in blocks, once for all
trees. If not, its members follow `ways` coordinates per level for `stride` levels, and the nodes there are looked at in the same way.
What is still large at the last look is compared in blocks, too, so no pair is lost to a size limit. Pairs of small nodes first
pass a test on sketches, five standard deviations wide; every link is confirmed on the full sets.

Recall: a pair at the threshold s shares no node at the first look with probability (1 - s^2)^trees, below 1e-7 by the defaults. It shares about
ten such nodes; should all be large, it stays together below one of them with probability above 0.9 each (1 - q with q = (1 - s + s q)^2).

Scale: shingles stay in the task that reads the text and are read again only for documents that have a candidate; nodes hold keys, not
sketches; counts and smallest members are aggregated before shuffling; joins on a node or a member are plain joins that adaptive
execution can split. A group of copies costs one comparison per member and look, and one more per member for each of its members that
is in no or another component. Components come from repeated hooking to the smallest neighbour and pointer jumping over written tables.

Null and empty texts have an empty set, link with nothing and are their own component. Rows with a null id take part in links but never give
their id to a component. Repeated rows are of one class. Ties have no influence: components don't depend on the order of comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.frames import batch, binary, checkpointed, release_memory, run_starts
from pulseframe.llm.words import grams, mix64, text_chunks, whole_grams


@dataclass(frozen=True)
class JoinSettings:
    shingle: int = 4
    #: Similarity in percent, so that the test on full sets is exact.
    percent: int = 80
    coordinates: int = 128
    #: Independent trees, levels down to the first nodes that are looked at, and members of a node that is compared exhaustively.
    trees: int = 16
    first_depth: int = 2
    small_node: int = 8
    #: Members of a block of a large node.
    block: int = 512
    #: Children that a large node's members go to at each level, levels between looks, and looks.
    ways: int = 2
    stride: int = 3
    looks: int = 2

    @property
    def least_agreeing(self) -> int:
        p = self.percent / 100
        return int(np.floor(self.coordinates * p - 5 * np.sqrt(self.coordinates * p * (1 - p))))


_ODD = np.random.default_rng(97).integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SETS = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("sketch", pa.list_(pa.int32()))])
_SETS_DDL = "id long, text_hash long, n long, key binary, sketch array<int>"
_NODES = pa.schema([("node", pa.int64()), ("member", pa.struct([("id", pa.int64()), ("key", pa.binary())]))])
_NODES_DDL = "node long, member struct<id: long, key: binary>"
#: Stands for a null id, so that it never becomes a component's.
_NO_ID = 2**63 - 1
#: Members whose paths are followed at once.
_MEMBERS = 512
#: Documents whose ids may be broadcast: 24 bytes each, so 5 MB at most.
_BROADCAST_IDS = 200_000


def _shingles(words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, sorted by text, then hash. A text of 1 to k - 1 words has its whole sequence as one."""
    hashes = words.hashes(lower=True)
    at = np.flatnonzero(whole_grams(words, k))
    text, found = words.text_of[at], grams(hashes, k)[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        own = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):  # hash of the sequence, apart from hashes of k words
            has = words.counts[short] > j
            own[has] = mix64(own[has] * np.uint64(3) + hashes[words.first[short[has]] + j] + np.uint64(j + 1))
        text, found = np.concatenate([text, short]), np.concatenate([found, own])
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    keep = run_starts(text, found)
    return text[keep], found[keep]


def _set_keys(text: np.ndarray, found: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, 128-bit key) of each text's set; equal sets have equal keys."""
    starts = run_starts(text)
    has = text[starts]
    sizes = np.zeros(n_texts, dtype=np.int64)
    keys = np.zeros((n_texts, 2), dtype=np.uint64)
    if len(starts):
        sizes[has] = np.diff(np.append(starts, len(text)))
        keys[has, 0] = mix64(np.add.reduceat(found, starts))
        keys[has, 1] = mix64(np.add.reduceat(mix64(found + np.uint64(9)), starts) + sizes[has].astype(np.uint64))
    return sizes, keys


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _sketch(settings: JoinSettings):
    """(id, size, key, sketch) of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a, b, words in text_chunks(rows.column("text")):
                text, found = _shingles(words, settings.shingle)
                sizes, keys = _set_keys(text, found, b - a)
                starts = run_starts(text)
                tokens = np.zeros((b - a, settings.coordinates), dtype=np.uint32)
                if len(starts):
                    for i in range(settings.coordinates):
                        tokens[text[starts], i] = mix64(np.minimum.reduceat(found * _ODD[i], starts)).astype(np.uint32)
                yield batch(_SETS, rows.column("id")[a:b], rows.column("text_hash")[a:b], sizes, [binary(k) for k in keys], _lists(tokens.view(np.int32)))
            release_memory()

    return run


def _paths(start: np.ndarray, tokens: np.ndarray, ways: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) some levels below the rows' nodes. Each node chooses `ways` coordinates by its own hash; a row goes on to the children
    of its tokens there."""
    which = mix64(np.arange(tokens.shape[1], dtype=np.uint64) + np.uint64(1))
    row, node = np.arange(len(start)), start
    for _ in range(levels):
        draw = mix64(mix64(node + np.uint64(0x9E3779B97F4A7C15))[:, None] ^ which[None, :])
        at = np.argpartition(draw, ways - 1, axis=1)[:, :ways] if ways < tokens.shape[1] else np.tile(np.arange(tokens.shape[1]), (len(node), 1))
        row, parent, at = np.repeat(row, at.shape[1]), np.repeat(node, at.shape[1]), at.ravel()
        node = mix64(mix64(parent ^ which[at]) + tokens[row, at].astype(np.uint64))
    return row, node


def _branched(settings: JoinSettings, seed: int | None = None):
    """Nodes of members: below the roots of all trees if a seed is given, or else below the nodes they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            tokens = rows.column("sketch").flatten().to_numpy(zero_copy_only=False).view(np.uint32).reshape(rows.num_rows, settings.coordinates)
            for a in range(0, rows.num_rows, _MEMBERS):
                part = tokens[a : a + _MEMBERS]
                if seed is None:
                    start = rows.column("node").to_numpy(zero_copy_only=False)[a : a + _MEMBERS].view(np.uint64)
                    row, node = _paths(start, part, settings.ways, settings.stride)
                else:
                    roots = mix64(np.arange(settings.trees, dtype=np.uint64) + np.uint64(seed << 32))
                    of = np.repeat(np.arange(len(part)), settings.trees)
                    row, node = _paths(np.tile(roots, len(part)), part[of], 1, settings.first_depth)
                    row = of[row]
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), rows.column("member").take(pa.array(row + a))], schema=_NODES)

    return run


def _agreeing(a: str, b: str) -> Column:
    """Coordinates at which two sketches agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _full_sets(settings: JoinSettings):
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a, b, words in text_chunks(rows.column("text")):
                text, found = _shingles(words, settings.shingle)
                _, keys = _set_keys(text, found, b - a)
                edges = np.searchsorted(text, np.arange(b - a + 1))
                items = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows.column("id")[a:b], pa.array([binary(k) for k in keys], pa.binary()), items], schema=schema)
            release_memory()

    return run


def _sets_of(source: DataFrame, ids: DataFrame, most: int, settings: JoinSettings) -> DataFrame:
    """(member, items) of the documents with these ids, of which there are `most` at most."""
    if most <= _BROADCAST_IDS:
        ids = F.broadcast(ids)
    sets = source.join(ids, "id", "left_semi").mapInArrow(_full_sets(settings), "id long, key binary, items array<long>")
    return sets.select(F.struct("id", "key").alias("member"), "items").dropDuplicates(["member"])  # repeated rows have equal sets


def _confirmed(pairs: DataFrame, classes: DataFrame, source: DataFrame, settings: JoinSettings) -> DataFrame:
    """Of the pairs (hi, lo) of classes, those whose full sets reach the threshold."""
    sketches = classes.select("member", "sketch")
    hi, lo = (sketches.select(F.col("member").alias(m), F.col("sketch").alias(f"sketch_{m}")) for m in ("hi", "lo"))
    close = checkpointed(pairs.join(hi, "hi").join(lo, "lo").where(_agreeing("sketch_hi", "sketch_lo") >= settings.least_agreeing).select("hi", "lo"))
    ids = close.select(F.explode(F.array("hi.id", "lo.id")).alias("id")).distinct()
    sets = _sets_of(source, ids, 2 * close.count(), settings)
    hi, lo = (sets.select(F.col("member").alias(m), F.col("items").alias(f"items_{m}")) for m in ("hi", "lo"))
    common = F.size(F.array_intersect("items_hi", "items_lo"))
    reaches = 100 * common >= settings.percent * (F.size("items_hi") + F.size("items_lo") - common)
    return checkpointed(close.join(hi, "hi").join(lo, "lo").where(reaches).select("hi", "lo"))


def components(links: DataFrame) -> DataFrame:
    """(member, root) for every member of a link (hi, lo), lo < hi; root is the smallest member of its component.

    Each round hooks a member's other lower neighbours to its lowest one, until every member has one link down; then pointers are
    doubled until they reach the root. Each round reads and writes a table.
    """
    edges = links
    lower = Window.partitionBy("hi")
    while True:
        # Each link says what it becomes: the lowest stays, another one hooks its lower end to the lowest. A member has few lower neighbours:
        # one for each node or block it is in.
        down = edges.distinct().withColumn("down", F.min("lo").over(lower))
        apart = F.col("lo") != F.col("down")
        hooked = down.select(F.when(apart, F.col("lo")).otherwise(F.col("hi")).alias("hi"), F.col("down").alias("lo"), apart.alias("open"))
        edges = checkpointed(hooked)
        if edges.where("open").isEmpty():
            break
        edges = edges.select("hi", "lo")
    up = edges.select("hi", "lo")
    while True:
        above = up.select(F.col("hi").alias("lo"), F.col("lo").alias("above"))
        up = checkpointed(up.join(above, "lo", "left").select("hi", F.coalesce("above", "lo").alias("lo"), F.col("above").isNotNull().alias("moved")))
        moved = not up.where("moved").isEmpty()
        up = up.select("hi", "lo")
        if not moved:
            break
    return up.select(F.col("hi").alias("member"), F.col("lo").alias("root")).union(up.select(F.col("lo").alias("member"), F.col("lo").alias("root")).distinct())


def _links(classes: DataFrame, source: DataFrame, settings: JoinSettings, seed: int) -> DataFrame:
    """Links (hi, lo) that join every component: all trees, look by look."""
    nodes = classes.select("member", "sketch").mapInArrow(_branched(settings, seed), _NODES_DDL)
    links = None
    for look in range(settings.looks):
        shared = nodes.groupBy("node").agg(F.min("member").alias("lo"), F.count(F.lit(1)).alias("members")).where("members > 1")
        nodes = checkpointed(nodes.join(shared, "node"))
        if links is not None and nodes.isEmpty():
            return links
        small = nodes.where(F.col("members") <= settings.small_node).select("node", "member")
        pairs = _pairs(small).union(nodes.where((F.col("members") > settings.small_node) & (F.col("member") != F.col("lo"))).select(F.col("member").alias("hi"), "lo"))
        found = _confirmed(pairs.distinct(), classes, source, settings)
        links = found if links is None else links.union(found)
        known = _open(nodes.where(F.col("members") > settings.small_node), links)
        # A node of which one component holds the better half is a group of copies: further levels would not part it. The trees' nodes of one
        # group have the same main component, and are taken together.
        alike = F.col("most") * 2 >= F.col("members")
        own = F.struct(F.col("node").alias("id"), F.lit(b"").alias("key"))
        last = look == settings.looks - 1
        family = known.withColumn("family", F.when(alike, F.col("main")).otherwise(own))
        links = links.union(_compared(family if last else family.where(alike), source, settings))
        rest = known.where(~alike)
        if last or rest.isEmpty():
            return links
        tokens = rest.select("node", "member").join(classes.select("member", "sketch"), "member").select("node", "member", "sketch")
        nodes = tokens.mapInArrow(_branched(settings), _NODES_DDL).distinct()


def _open(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, member, members, root, main, most) of the nodes whose members are of several components. main is the root of most members."""
    known = nodes.join(components(links), "member", "left").select("node", "member", "members", F.coalesce("root", "member").alias("root"))
    sizes = known.groupBy("node", "root").agg(F.count(F.lit(1)).alias("n"))
    several = sizes.groupBy("node").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root")).alias("top")).where("roots > 1")
    several = several.select("node", F.col("top.root").alias("main"), F.col("top.n").alias("most"))
    return checkpointed(known.join(several, "node"))


def _pairs(members: DataFrame) -> DataFrame:
    """All pairs (hi, lo) inside nodes."""
    a, b = (members.select("node", F.col("member").alias(m)) for m in ("hi", "lo"))
    return a.join(b, "node").where("lo < hi").select("hi", "lo")


def _compared(known: DataFrame, source: DataFrame, settings: JoinSettings) -> DataFrame:
    """Links (hi, lo) between different components inside families: each member outside the family's main component against all members, in
    blocks and on full sets. One link joins a member to a component, so there is one at most of each member, component and block."""
    rows = checkpointed(known.select("family", "member", "root", "main").distinct())
    outside = F.col("root") != F.col("main")
    sizes = rows.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.count_if(outside).alias("others"))
    ids = rows.select("member.id").distinct()
    sets = _sets_of(source, ids, rows.count(), settings)
    rows = rows.join(sizes, "family").join(sets, "member")
    spread = F.xxhash64("member")
    down, across = (F.ceil(F.col(c) / settings.block).cast("long") for c in ("others", "members"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    columns = ("family", "member", "root", "items")
    left = rows.where(outside).select(*columns, F.pmod(spread, down).alias("down"), every(across).alias("across"))
    right = rows.select(*columns, F.pmod(spread, across).alias("across"), every(down).alias("down"))
    right = right.select(*[F.col(c).alias(f"other_{c}") for c in right.columns])
    keys = ("family", "down", "across")
    found = left.groupBy(*keys).cogroup(right.groupBy(*[f"other_{k}" for k in keys])).applyInArrow(_block_links(settings), "hi struct<id: long, key: binary>, lo struct<id: long, key: binary>")
    return checkpointed(found.distinct())


def _block_links(settings: JoinSettings):
    member = pa.struct([("id", pa.int64()), ("key", pa.binary())])
    schema = pa.schema([("hi", member), ("lo", member)])

    def side(rows: pa.Table, prefix: str = "") -> tuple[list, list, np.ndarray, np.ndarray]:
        names, roots = ([(m["id"], m["key"]) for m in rows.column(prefix + c).to_pylist()] for c in ("member", "root"))
        items = rows.column(prefix + "items").combine_chunks()
        return names, roots, items.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy(zero_copy_only=False))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            names, roots, items, edges = side(left)
            other_names, other_roots, other_items, other_edges = side(right, "other_")
            number = {r: i for i, r in enumerate(sorted(set(roots) | set(other_roots)))}
            other_of = np.array([number[r] for r in other_roots])
            sizes = np.diff(other_edges)
            # Which members have an item: an index of the block, looked up with each outside member's set.
            order = np.argsort(other_items, kind="stable")
            holder = np.repeat(np.arange(len(sizes)), sizes)[order]
            sorted_items = other_items[order]
            for i, (name, root) in enumerate(zip(names, roots, strict=True)):
                own = items[edges[i] : edges[i + 1]]
                lo, hi = np.searchsorted(sorted_items, own), np.searchsorted(sorted_items, own, side="right")
                n = hi - lo
                at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                common = np.bincount(holder[at], minlength=len(sizes))
                hits = np.flatnonzero((100 * common >= settings.percent * (len(own) + sizes - common)) & (other_of != number[root]))
                _, first = np.unique(other_of[hits], return_index=True)
                found += [(max(name, other_names[j]), min(name, other_names[j])) for j in hits[first].tolist()]
        release_memory()
        columns = [[{"id": m[0], "key": m[1]} for m in c] for c in zip(*found, strict=True)] if found else [[], []]
        return pa.table([pa.array(c, type=member) for c in columns], schema=schema)

    return run


def _labelled(docs: DataFrame, id_col: str, text_col: str, settings: JoinSettings, seed: int) -> DataFrame:
    """(id, text_hash, n, key, component, root_key) of each row; component is the id of the root's class."""
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = checkpointed(source.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sketch(settings), _SETS_DDL))
    sets = rows.where("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch"))
    classes = checkpointed(sets.select(F.struct("id", "key").alias("member"), "sketch"))
    roots = components(_links(classes, source, settings, seed))
    root = F.coalesce("root", "member")
    labels = classes.join(roots, "member", "left").select("member.key", root.id.alias("component"), root.key.alias("root_key"))
    return rows.select("id", "text_hash", "n", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(labels, "key", "left").withColumn("component", F.coalesce("component", "id"))


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: JoinSettings = JoinSettings(), seed: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    own, component = (F.nullif(c, F.lit(_NO_ID)) for c in ("id", "component"))
    found = _labelled(docs, id_col, text_col, settings, seed)
    return found.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), own.eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: JoinSettings = JoinSettings(), seed: int = 5) -> DataFrame:
    """docs with one row of each component, one whose id is the component's; among rows of one id and set the one of the least text hash, and
    one of several equal rows. Rows with an empty set all stay."""
    found = _labelled(docs, id_col, text_col, settings, seed)
    # A component without any id is known by its root's set.
    stays = (F.col("id") == F.col("component")) & ((F.col("id") != _NO_ID) | F.col("key").eqNullSafe(F.col("root_key")))
    one = found.where(stays & (F.col("n") > 0)).groupBy("component", F.when(F.col("id") == _NO_ID, F.col("root_key")).alias("no_id")).agg(F.min("text_hash").alias("text_hash"))
    one = one.select(F.col("component").alias("kept_id"), F.col("text_hash").alias("kept_hash"), F.lit(False).alias("empty"))
    empty = found.where("n = 0").select("id", "text_hash", F.lit(True)).distinct()
    wanted = one.union(empty)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("kept_id"), F.xxhash64(F.col(text_col).cast("string")).alias("kept_hash"))
    place = F.row_number().over(Window.partitionBy("kept_id", "kept_hash").orderBy(F.lit(0)))
    return rows.join(wanted, ["kept_id", "kept_hash"]).withColumn("place", place).where("empty OR place = 1").select("row.*")
