"""Suffix-array dedup: maximal repeats of ``LENGTH`` or more bytes, and texts without them.

Method: the common-prefix interval tree of an enhanced suffix array. A stack scan
over suffixes in order and their common-prefix lengths opens and closes the tree's
nodes; a node whose occurrences differ in the byte before them is a maximal
repeat, and its occurrences are all suffixes below it, not just neighbours.

On a cluster no suffix array of all texts is built. Each window of ``LENGTH`` bytes is
given to its anchor (``anchors``): equal windows have equal anchors, so all suffixes
that share ``LENGTH`` bytes meet under one anchor hash, and arrays over single
anchors' *stretches* together have every interval of the whole tree that counts.
A stretch reaches to the end of its last window, so a longer repeat is a chain of
overlapping groups, each bounded by its stretch; at a stretch's first start the
repeat may go on to the left under another anchor, which counts as a difference.

1. Stretches of every text: (anchor hash, content hash, place), written once.
2. Anchors that occur once are dropped. Where all stretches of an anchor are equal
   the tree is one node: they are covered whole, without reading a byte again.
3. For the other anchors one copy of each different stretch is cut out of its
   text, and the stretches of an anchor go through one enhanced suffix array.
   Copies are never repeated here, however many there are.
4. An anchor with more than ``SPLIT`` different stretches (a frequent line in ever
   new surroundings) is not one task's work: its stretches are cut into single
   windows, which are counted by content, map side first. Nothing is left out.

Texts are compared as UTF-8 bytes; stretches by an anchor hash and a content hash of
64 bits each, single windows by two content hashes, and rows find their texts again by doc_id and a 64-bit hash of the text.

Null texts are empty; empty and short texts lose nothing. Repeated rows are
documents of their own (each is a repeat of the other, if long enough). Null and
repeated doc_ids are kept. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkup.llm import anchors
from checkup.llm.common import ship, step, text_batches

LENGTH = 200        # bytes of a repeat, at least
GRAM = 64           # bytes of an anchor
SPLIT = 4096        # different stretches of an anchor in one array
ARRAY_BYTES = 1 << 19  # stretches of small anchors go through an array together, up to about this
_SLICE = 1 << 20
_BORDER, _DIVERSE = -1, -2

_STRETCH = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("a", pa.int64()), ("b", pa.int64()),
                      ("lo", pa.int64()), ("n", pa.int32())])
_CUT = pa.schema([*_STRETCH, ("copies", pa.int64()), ("bytes", pa.binary())])
_GROUP = pa.schema([("group_id", pa.int64()), ("parent_id", pa.int64()), ("length", pa.int32()),
                    ("h", pa.int64()), ("c", pa.int64()), ("at", pa.int32())])


def _keyed(docs: DataFrame, *more) -> DataFrame:
    """(a, b, text): a row's key is its doc_id and a hash of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    a = F.col("doc_id").cast("bigint")
    return docs.select(F.coalesce(a, F.lit(-1)).alias("a"), F.xxhash64(text).alias("b"), text.alias("text"), *more)


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column in one array, and where each text begins."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def stretch_rows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Step 1: rows (h, c, a, b, lo, n) of every stretch."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in text_batches(batches, _SLICE):
            data, offsets = _bytes_of(batch.column(2))
            h, c, text, lo, n = anchors.stretches(data, offsets, length, gram)
            a, b = (batch.column(i).to_numpy(zero_copy_only=False)[text] for i in (0, 1))
            yield pa.record_batch([pa.array(x) for x in (h, c, a, b, lo, n.astype(np.int32))], schema=_STRETCH)

    return _keyed(docs).mapInArrow(run, "h long, c long, a long, b long, lo long, n int")


class Stretches:
    """Repeated stretches: ``whole`` (rows whose stretch occurs again as a whole),
    ``kinds`` (h, c, copies, a, b, lo, n, crowd): one row per different stretch of the
    anchors that have several; ``crowd`` is their number."""

    def __init__(self, docs: DataFrame, length: int = LENGTH, gram: int = GRAM):
        rows = step(stretch_rows(docs, length, gram), "stretches")
        again = (rows.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("c0"), F.max("c").alias("c1"))
                 .where("k > 1").select("h", (F.col("c0") == F.col("c1")).alias("alike")))
        # a table of its own, so that the join is a plain one, whose frequent anchors Spark splits
        again = step(again, "repeated-anchors")
        found = step(rows.join(again, "h"), "repeated-stretches")
        mixed = found.where("NOT alike")
        kinds = mixed.groupBy("h", "c").agg(F.count(F.lit(1)).alias("copies"),
                                            F.min(F.struct("a", "b", "lo", "n")).alias("x"))
        kinds = step(kinds.select("h", "c", "copies", "x.*"), "stretch-kinds")
        crowd = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("crowd"))
        self.kinds = kinds.join(crowd, "h")
        copied = kinds.where("copies > 1").select("h", "c")
        self.mixed = mixed.drop("alike")
        self.whole = found.where("alike").drop("alike").unionByName(self.mixed.join(copied, ["h", "c"], "left_semi"))


def cut_stretches(docs: DataFrame, kinds: DataFrame, length: int = LENGTH, split: int = SPLIT) -> DataFrame:
    """Step 3: each different stretch with its bytes; those of crowded anchors as
    single windows, ``h`` and ``c`` then being two hashes of the window, and no bytes."""
    wanted = kinds.groupBy("a", "b").agg(F.collect_list(F.struct("h", "c", "lo", "n", "copies",
                                                                 (F.col("crowd") > split).alias("crowded"))).alias("cuts"))
    texts = _keyed(docs).join(wanted, ["a", "b"]).select("a", "b", "text", "cuts")

    def run(batches):
        for batch in text_batches(batches, _SLICE):
            data, offsets = _bytes_of(batch.column(2))
            lists = batch.column(3)
            cuts, first = lists.flatten(), np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(batch.num_rows), first)
            h, c, lo, n, copies, crowded = (cuts.field(i).to_numpy(zero_copy_only=False) for i in range(6))
            a, b = (batch.column(i).to_numpy(zero_copy_only=False)[doc] for i in (0, 1))
            begin = lo + offsets[doc]
            one = ~crowded
            raw = data.tobytes()
            pieces = [raw[x:y] for x, y in zip(begin[one].tolist(), (begin + n + length - 1)[one].tolist())]
            yield pa.record_batch([pa.array(x[one]) for x in (h, c, a, b, lo, n, copies)] + [pa.array(pieces, pa.binary())],
                                  schema=_CUT)
            if crowded.any():
                k = np.repeat(np.flatnonzero(crowded), n[crowded])
                shift = np.arange(len(k)) - np.repeat(np.cumsum(n[crowded]) - n[crowded], n[crowded])
                at = begin[k] + shift
                w1, w2 = (anchors.range_hashes(data, at, at + length, second=s).view(np.int64) for s in (False, True))
                for x in range(0, len(k), 100_000):
                    y = slice(x, x + 100_000)
                    yield pa.record_batch([pa.array(v) for v in (w1[y], w2[y], a[k][y], b[k][y], (lo[k] + shift)[y],
                                                                 np.ones(len(k[y]), np.int32), copies[k][y])]
                                          + [pa.nulls(len(k[y]), pa.binary())], schema=_CUT)

    return texts.mapInArrow(run, "h long, c long, a long, b long, lo long, n int, copies long, bytes binary")


def suffix_array(data: np.ndarray, room: np.ndarray, starts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the next one). ``data`` holds
    several strings one after the other, ``room[i]`` the bytes from i to the end of its
    string; only the suffixes in ``starts`` are listed. Ranks double their reach."""
    n = len(data)
    key = np.zeros(n, np.uint64)
    for j in range(7):
        sym = np.zeros(n, np.uint64)
        sym[:n - j] = data[j:]
        sym += np.uint64(1)
        sym[room <= j] = 0
        key = (key << np.uint64(9)) | sym
    size, levels = 7, []
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
    levels.append((size, rank))
    while size < longest:
        then = np.zeros(n, np.uint64)
        then[:n - size] = rank[size:]
        then[room <= size] = 0
        rank = np.unique((rank << np.uint64(32)) | then, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
        size *= 2
        levels.append((size, rank))
    order = starts[np.argsort(rank[starts], kind="stable")]
    i, j = order[:-1], order[1:]
    shared, limit = np.zeros(len(i), np.int64), np.minimum(room[i], room[j])
    for size, rank in reversed(levels):
        x = np.flatnonzero(shared < limit)
        x = x[rank[i[x] + shared[x]] == rank[j[x] + shared[x]]]
        shared[x] += size
    for _ in range(6):
        x = np.flatnonzero(shared < limit)
        x = x[data[i[x] + shared[x]] == data[j[x] + shared[x]]]
        shared[x] += 1
    return order, np.minimum(shared, limit)


def interval_tree(shared: list[int], before: list[int], least: int) -> tuple[list[int], list[int], list[int], list[bool]]:
    """Stack scan over one run of suffixes (``shared[k]``: common prefix of suffix k
    and k + 1; the last is 0). ``before``: the byte before each suffix, ``_BORDER`` if it
    is no part of the comparison. Returns each suffix's deepest node, and per node its
    length, parent (-1: none) and whether what stands before its suffixes differs."""
    deepest, length, parent, diverse = [], [], [], []
    open_nodes: list[list[int]] = []  # [length, what stands before, number]
    for k, left in enumerate(before):
        nxt = shared[k]
        if left == _BORDER:
            left = _DIVERSE
        if nxt >= least and (not open_nodes or nxt > open_nodes[-1][0]):
            open_nodes.append([nxt, left, len(length)])
            deepest.append(len(length))
            length.append(nxt)
            parent.append(-1)
            diverse.append(False)
            continue
        if not open_nodes:
            deepest.append(-1)
            continue
        top = open_nodes[-1]
        deepest.append(top[2])
        if top[1] != left:
            top[1] = _DIVERSE
        while open_nodes and open_nodes[-1][0] > nxt:
            _, left, number = open_nodes.pop()
            diverse[number] = left == _DIVERSE
            if open_nodes and open_nodes[-1][0] >= nxt:
                up = open_nodes[-1]
                if up[1] != left:
                    up[1] = _DIVERSE
            elif nxt >= least:
                up = [nxt, left, len(length)]
                open_nodes.append(up)
                length.append(nxt)
                parent.append(-1)
                diverse.append(False)
            else:
                continue
            parent[number] = up[2]
    return deepest, length, parent, diverse


def maximal_repeats(strings: list[bytes], n_starts: np.ndarray, least: int = LENGTH):
    """Maximal repeats among strings that are all different, the first
    ``n_starts[s]`` suffixes of string s being asked for. Returns per listed suffix
    (string, place in it, node) with its deepest maximal node, and per node
    (length, parent), the parent being the next maximal node above it or -1."""
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(b"".join(strings), np.uint8)
    string = np.repeat(np.arange(len(strings)), sizes)
    at = np.arange(len(data))
    room, place = ends[string] - at, at - begins[string]
    starts = np.flatnonzero(place < n_starts[string])
    order, shared = suffix_array(data, room, starts, int(sizes.max()))
    # runs of neighbours that share enough; the rest are in no node
    linked = np.concatenate([[False], shared >= least, [False]])
    inside = np.flatnonzero(linked[1:] | linked[:-1])
    order = order[inside]
    shared = np.append(shared, 0)[inside]
    shared[shared < least] = 0
    before = np.where(place[order] == 0, _BORDER, data[order - 1].astype(np.int64))
    deepest, length, parent, diverse = interval_tree(shared.tolist(), before.tolist(), least)
    # the next maximal node at or above each node: parents are closed after their
    # children, so follow the pointers until nothing moves
    up = np.array(parent, np.int64)
    good = np.array(diverse, bool)
    here = np.where(good, np.arange(len(up)), up)
    while len(here):
        move = (here >= 0) & ~good[here]
        if not move.any():
            break
        here = np.where(move, here[here], here)
    above = np.where(up >= 0, here[up], -1) if len(up) else up
    node = np.array(deepest, np.int64)
    node = np.where(node >= 0, here[node], -1) if len(here) else np.full(len(node), -1)
    keep = node >= 0
    return string[order][keep], place[order][keep], node[keep], np.array(length, np.int64), above


def _anchored(batches):
    """Groups of rows (whole anchors, sorted by h) of about ``ARRAY_BYTES`` bytes."""
    held, size, last = [], 0, None
    for batch in batches:
        rows = batch.to_pylist() if batch.num_rows else []
        for r in rows:
            if size >= ARRAY_BYTES and r["h"] != last:
                yield held
                held, size = [], 0
            if held and held[-1]["h"] == r["h"] and held[-1]["c"] == r["c"]:
                continue  # the same stretch cut out of two rows with one key
            held.append(r)
            size += len(r["bytes"])
            last = r["h"]
    if held:
        yield held


def _arrays(cuts: DataFrame, run, schema: str) -> DataFrame:
    return cuts.where("bytes IS NOT NULL").repartition("h").sortWithinPartitions("h", "c").mapInArrow(run, schema)


def array_spans(cuts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(a, b, lo, hi): bytes that the groups of the suffix arrays cover, for
    stretches that occur once (others are covered whole)."""
    def run(batches):
        for rows in _anchored(batches):
            string, place, node, node_length, _ = maximal_repeats([r["bytes"] for r in rows],
                                                                  np.array([r["n"] for r in rows]), length)
            sizes = np.array([len(r["bytes"]) + 1 for r in rows])  # one place between strings stays uncovered
            begin = np.cumsum(sizes) - sizes
            lo = begin[string] + place
            depth = np.zeros(int(sizes.sum()) + 1, np.int64)
            np.add.at(depth, lo, 1)
            np.add.at(depth, lo + node_length[node], -1)
            covered = np.concatenate([[False], np.cumsum(depth) > 0, [False]])
            edge = np.flatnonzero(covered[1:] != covered[:-1])
            lo, hi = edge[::2], edge[1::2]
            s = np.searchsorted(begin, lo, side="right") - 1
            out = [(rows[k]["a"], rows[k]["b"], rows[k]["lo"] + x - begin[k], rows[k]["lo"] + y - begin[k])
                   for k, x, y in zip(s.tolist(), lo.tolist(), hi.tolist()) if rows[k]["copies"] == 1]
            yield pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["a", "b", "lo", "hi"])

    return _arrays(cuts, run, "a long, b long, lo long, hi long")


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, split: int = SPLIT) -> DataFrame:
    """Maximal repeat groups with all their occurrences: (group_id, parent_id,
    length, doc_id, start). An occurrence is listed once, with the longest group it
    is in; a group's occurrences are its own and those of the groups whose parent it
    is, and so on. Windows of crowded anchors are groups of ``length`` bytes. Rows
    with null doc_id are listed as -1."""
    found = Stretches(docs, length, gram)
    cuts = step(cut_stretches(docs, found.kinds, length, split), "cut-stretches")

    def run(batches):
        for rows in _anchored(batches):
            string, place, node, node_length, above = maximal_repeats([r["bytes"] for r in rows],
                                                                      np.array([r["n"] for r in rows]), length)
            h = np.array([r["h"] for r in rows], np.int64)
            c = np.array([r["c"] for r in rows], np.int64)
            # a group is named after one of its suffixes' stretches, its place and its number
            named = np.zeros(len(node_length), np.int64)
            with np.errstate(over="ignore"):
                named[node] = anchors._mix(h[string].view(np.uint64) + node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                                           + np.uint64(1)).view(np.int64)
                lost = np.setdiff1d(above[node][above[node] >= 0], node)  # groups without own occurrences
                while len(lost):
                    named[lost] = anchors._mix(lost.astype(np.uint64) + h[:1].view(np.uint64)).view(np.int64)
                    lost = np.setdiff1d(above[lost][above[lost] >= 0], np.flatnonzero(named))
            up = above[node]
            yield pa.record_batch([
                pa.array(named[node]), pa.array(np.where(up >= 0, named[up], 0), mask=up < 0), pa.array(node_length[node].astype(np.int32)),
                pa.array(h[string]), pa.array(c[string]), pa.array(place.astype(np.int32))], schema=_GROUP)

    inner = _arrays(cuts, run, "group_id long, parent_id long, length int, h long, c long, at int")
    placed = inner.join(found.mixed.select("h", "c", "a", "lo"), ["h", "c"]).select(
        "group_id", "parent_id", "length", F.col("a").alias("doc_id"), (F.col("lo") + F.col("at")).alias("start"))
    none = F.lit(None).cast("bigint").alias("parent_id")
    whole = found.whole.select(F.xxhash64("h", "c").alias("group_id"), none,
                               (F.col("n") + F.lit(length - 1)).alias("length"), F.col("a").alias("doc_id"), F.col("lo").alias("start"))
    single = cuts.where("bytes IS NULL")
    often = single.groupBy("h", "c").agg(F.sum("copies").alias("k")).where("k > 1").select("h", "c")
    windows = single.where("copies = 1").join(often, ["h", "c"], "left_semi").select(
        F.xxhash64("h", "c", F.lit("window")).alias("group_id"), none, F.lit(length).alias("length"),
        F.col("a").alias("doc_id"), F.col("lo").alias("start"))
    return placed.unionByName(whole).unionByName(windows)


def repeat_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, split: int = SPLIT) -> DataFrame:
    """(a, b, spans): per row key, the covered byte ranges (start, end), not yet merged."""
    found = Stretches(docs, length, gram)
    cuts = step(cut_stretches(docs, found.kinds, length, split), "cut-stretches")
    whole = found.whole.select("a", "b", "lo", (F.col("lo") + F.col("n") + F.lit(length - 1)).alias("hi"))
    single = cuts.where("bytes IS NULL")
    often = single.groupBy("h", "c").agg(F.sum("copies").alias("k")).where("k > 1").select("h", "c")
    windows = (single.where("copies = 1").join(often, ["h", "c"], "left_semi")
               .select("a", "b", "lo", (F.col("lo") + F.lit(length)).alias("hi")))
    spans = whole.unionByName(array_spans(cuts, length)).unionByName(windows)
    return spans.groupBy("a", "b").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order; overlapping and touching ones are one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, split: int = SPLIT) -> DataFrame:
    """Per row: doc_id, n_bytes, ``spans`` (removed byte ranges) and ``kept`` (the
    bytes that are left)."""
    spans = step(repeat_spans(docs, length, gram, split), "repeat-spans")
    texts = _keyed(docs, F.col("doc_id").cast("bigint").alias("doc_id")).join(spans, ["a", "b"], "left").select("doc_id", "text", "spans")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()),
                        ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), ("kept", pa.binary())])

    def run(batches):
        for batch in text_batches(batches, _SLICE):
            sizes, runs, kept = [], [], []
            for text, found in zip(batch.column(1).cast(pa.large_binary()), batch.column(2)):
                data = text.as_py()
                gone = merged([(s["lo"], s["hi"]) for s in found.as_py() or []])
                at, parts = 0, []
                for lo, hi in gone:
                    parts.append(data[at:lo])
                    at = hi
                sizes.append(len(data))
                runs.append([{"lo": lo, "hi": hi} for lo, hi in gone])
                kept.append(b"".join(parts) + data[at:])
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, schema.field("spans").type),
                                   pa.array(kept, pa.binary())], schema=schema)

    return texts.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<lo: long, hi: long>>, kept binary")


def repeat_rows(docs: DataFrame) -> DataFrame:
    """The digest of ``without_repeats``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["hi"] - s["lo"])
    return without_repeats(docs).select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                                        F.sha2("kept", 256).alias("kept_sha256"))
