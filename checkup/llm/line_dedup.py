"""Operator 2: near-duplicate lines by a segment-partition edit join.

Lines (``\\n``-separated, blanks at both ends trimmed) of at least ``min_chars``
code points that differ by at most ``k`` edits are one class; shorter lines of
at least ``min_exact`` code points (the job: every line that is not blank) are
one class where they are equal. Only Spark SQL functions are used.

1. Equal lines are grouped first (combined before the shuffle), so that a line
   of many documents is one distinct line with its first place.
2. A distinct line of length l is cut into k + 1 segments. A line within k edits
   of it holds one of them unchanged, at a place that the multi-match-aware
   bounds of the segment join fix for each length difference. Segments and
   probed substrings become hash keys of (length, segment number, text).
3. Keys that two lines share make groups. Their first line is compared with
   every member (linear in the group); after components have been merged, only
   members outside its component are compared with the others of a different
   component. A pair left out is already in one class. Lines of a group with more
   than ``CROWDED`` such members meet again under finer keys instead: all of the
   line but two of its ``FINER`` blocks, which is what two edits leave unchanged. Only
   at the finest blocks are all pairs that are left compared.
4. A comparison is a bit-parallel edit distance over a band of 2k + 1 diagonals
   held in one word, an ``aggregate`` over the shorter line's characters.
5. Every line gets its class: the first place (by doc_id, then line number) of
   its component. A line is kept where it stands in that place.

Defined results: null and empty texts have no lines to compare; rows with equal
``doc_id`` and text count as one document (all their lines are treated alike);
a null ``doc_id`` comes after all others; an empty table gives an empty
result; other columns are ignored. Lines are told apart by two 64-bit hashes
in joins and by their text in step 1 and step 4.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkup.llm.common import bitmap_filter, bitmap_split, components, stored

MAX_EDITS, MIN_CHARS = 2, 20
MIN_EXACT = 1  # of the registered query and the pipeline
SALTS = 8
CROWDED = 32  # members of a group outside its first line's component that are compared with all others
FINER = (8, 16)  # blocks of a line for the keys of lines in larger groups, one round each
LAST_ID = 2**63 - 1
BLANKS = " \t\r\x0b\x0c"


def document_lines(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, line_no, line`` of the lines of ``min_chars`` or more."""
    text = F.col(text_col)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                        F.posexplode(F.split(text, "\n")).alias("line_no", "raw"))
            .select("doc_id", "text_hash", "line_no", F.btrim("raw", F.lit(BLANKS)).alias("line"))
            .where(F.char_length("line") >= min_chars))


def place(doc_id="doc_id", line_no="line_no"):
    """One ordered number for (doc_id, line number); null ids come last."""
    return (F.coalesce(F.col(doc_id), F.lit(LAST_ID)).cast("decimal(38,0)") * F.lit(2**31).cast("decimal(11,0)")
            + F.col(line_no)).cast("decimal(38,0)")


def _line_key(line="line"):
    return [F.xxhash64(F.col(line)).alias("id"), F.xxhash64(F.lit(1), F.col(line)).alias("id2")]


def segment(length, i, k: int):
    """(start, size) of segment ``i`` of the k + 1, 1-based; the last ones are a
    character longer where the length does not divide."""
    n = F.lit(k + 1)
    short = n - length % n
    base = ((length - length % n) / n).cast("int")
    return (base * i + F.greatest(i - short, F.lit(0)) + 1, base + F.when(i >= short, 1).otherwise(0))


def probe_shifts(k: int, delta: int) -> list[tuple[int, int]]:
    """(segment, shift) pairs to probe for lines ``delta`` characters shorter:
    a substring at shift s from the segment's start may match it."""
    out = []
    for i in range(k + 1):
        low = max(-i, delta - (k - i))
        high = min(i, delta + (k - i))
        out += [(i, s) for s in range(low, high + 1)]
    return out


def keys_of(lines: DataFrame, k: int) -> DataFrame:
    """``key, id, chars, owner``: the lines' segments (owner 1) and the probed
    substrings that are not segments themselves (owner 0). The probes are rows of
    a constant list, so that the code Spark makes for one is short enough to be
    compiled well."""
    probes = F.array(*[F.struct(F.lit(delta).alias("delta"), F.lit(i).alias("i"), F.lit(s).alias("s"))
                       for delta in range(k + 1) for i, s in probe_shifts(k, delta)])
    each = lines.select("id", "chars", "line", F.explode(probes).alias("p"))
    other, i, s = F.col("chars") - F.col("p.delta"), F.col("p.i"), F.col("p.s")
    start, size = segment(other, i, k)
    return (each.select("id", "chars", "line", other.alias("other"), i.alias("i"), (start + s).alias("start"),
                        size.alias("size"), F.when((F.col("p.delta") == 0) & (s == 0), 1).otherwise(0).alias("owner"))
            .where("start >= 1 AND start + size - 1 <= chars AND size >= 1")
            .select(F.xxhash64("other", "i", F.expr("substring(line, start, size)")).alias("key"), "id", "chars", "owner"))


def block_keys_of(lines: DataFrame, k: int, blocks: int) -> DataFrame:
    """``key, id, owner`` as ``keys_of``, by all of a line but the blocks that ``k`` <= 2 edits may touch: two
    blocks with an edit each, or one with all. A line ``delta`` characters shorter has its blocks in front of
    the first at the same place, those between the two moved by that edit (``net``) and those behind by ``delta``."""
    if k > 2:
        raise ValueError("block keys are made for two edits at most")
    one = [(delta, b, b, delta) for delta in range(k + 1) for b in range(blocks)]
    two = [(delta, b, c, net) for delta in range(k + 1) for net in (-1, 0, 1) if abs(delta - net) <= 1
           for b in range(blocks) for c in range(b + 1, blocks)] if k == 2 else []
    # the list is one constant; column by column, thousands of them would take the driver a minute
    probes = F.from_json(F.lit(json.dumps([dict(zip(("delta", "b", "c", "net"), p)) for p in one + two])),
                         "array<struct<delta:int,b:int,c:int,net:int>>")
    each = lines.select("id", "chars", "line", F.explode(probes).alias("p"))
    other, b, c, net = F.col("chars") - F.col("p.delta"), F.col("p.b"), F.col("p.c"), F.col("p.net")
    (b_at, b_size), (c_at, c_size) = segment(other, b, blocks - 1), segment(other, c, blocks - 1)
    owner = F.when((F.col("p.delta") == 0) & (net == 0), 1).otherwise(0)
    cut = each.select("id", "chars", "line", other.alias("other"), b.alias("b"), c.alias("c"), net.alias("net"),
                      F.col("p.delta").alias("delta"), owner.alias("owner"), b_at.alias("b_at"),
                      (b_at + b_size).alias("b_end"), c_at.alias("c_at"), (c_at + c_size).alias("c_end"))
    return (cut.where("other >= 1 AND b_end + net >= b_at AND c_end + delta >= c_at + IF(b = c, 0, net)")
            .select(F.xxhash64("other", "b", "c", F.expr("substring(line, 1, b_at - 1)"),
                               F.expr("substring(line, b_end + net, greatest(c_at - b_end, 0))"),
                               F.expr("substring(line, c_end + delta, other - c_end + 1)")).alias("key"), "id", "owner"))


def _let(value, body):
    """``body`` of ``value``, which is evaluated once a row: a lambda's variable is
    not replaced by its definition when Spark moves or merges expressions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def edits_within(a, b, k: int):
    """Whether the character arrays ``a`` and ``b`` (columns or their names;
    ``a`` not the shorter one) are within k edits."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return _let(F.struct(a.alias("x"), b.alias("y")), lambda p: _banded(p["x"], p["y"], k))


def _banded(a, b, k: int):
    """The vertical differences of the band of 2k + 1 diagonals are two words
    (``vp``, ``vn``); each step takes one character of ``b`` and builds the
    word of its matches in the band."""
    width = 2 * k + 1
    full = (1 << width) - 1
    word = lambda v: F.lit(v).cast("bigint")
    m, n = F.size(a), F.size(b)

    def inverse(x):
        return F.lit(full).cast("bigint") - x

    def bit(x, at):
        return F.shiftright(x, at).bitwiseAND(word(1)) if isinstance(at, int) else F.getbit(x, at).cast("bigint")

    def step(acc, j):
        match = word(0)
        for t in range(width):
            row = j - k + t
            match = match + F.when(
                (row >= 1) & (row <= m) & (F.get(a, row - 1) == F.get(b, j - 1)), word(1 << t)
            ).otherwise(word(0))

        def with_match(x):
            vp, vn = acc["vp"], acc["vn"]
            d0 = ((x.bitwiseAND(vp) + vp).bitwiseAND(word(full)).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn)
            return _let(d0, with_d0)

        def with_d0(d0):
            vp, vn = acc["vp"], acc["vn"]
            pair = F.struct(vn.bitwiseOR(inverse(d0.bitwiseOR(vp))).alias("hp"), d0.bitwiseAND(vp).alias("hn"))
            return _let(pair, lambda h: after(d0, h["hp"], h["hn"]))

        def after(d0, hp, hn):
            at = F.greatest(F.lit(width - 1) - (j - (m - k)), F.lit(0))
            d = acc["d"] + F.when(j <= m - k, word(1) - bit(d0, width - 1)).otherwise(bit(hp, at) - bit(hn, at))
            down = F.shiftright(d0, 1)
            return F.struct(hn.bitwiseOR(inverse(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"),
                            d.alias("d"))

        return _let(match, with_match)

    start = F.struct(word(((1 << (k + 1)) - 1) << k).alias("vp"), word(0).alias("vn"), word(k).alias("d"))
    run = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda acc: acc["d"])
    return (m - n <= k) & F.when(m <= k, F.lit(True)).when(n == 0, F.lit(False)).otherwise(run <= k)


def verify(pairs: DataFrame, lines: DataFrame, k: int) -> DataFrame:
    """The pairs (``a``, ``b``: line ids) within k edits. Most pairs are far apart: Spark's own
    distance, which stops at k, is compiled and drops those; the banded automaton runs on the rest."""
    pairs = stored(pairs, "line-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    text = bitmap_filter(lines.select("id", "chars", "line"), ids, "id")
    left = text.select(F.col("id").alias("a"), F.col("chars").alias("ca"), F.col("line").alias("la"))
    right = text.select(F.col("id").alias("b"), F.col("chars").alias("cb"), F.col("line").alias("lb"))
    both = (pairs.join(left, "a").join(right, "b").where(F.abs(F.col("ca") - F.col("cb")) <= k)
            .where(F.levenshtein("la", "lb", k) >= 0))
    # long comparisons in few bytes: spread over tasks of their own, and made by a
    # generator, since Spark would move a plain filter to the few tasks of the join
    n_tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    longer = F.col("ca") >= F.col("cb")
    x = F.split(F.when(longer, F.col("la")).otherwise(F.col("lb")), "")
    y = F.split(F.when(longer, F.col("lb")).otherwise(F.col("la")), "")
    return (both.repartition(n_tasks, "a", "b").select("a", "b", F.explode(F.array(edits_within(x, y, k))).alias("near"))
            .where("near").select("a", "b"))


def _members(keys: DataFrame) -> DataFrame:
    """``key, id, owner, pivot`` of the keys that two lines share, the pivot being their first owner."""
    shared = stored(keys.groupBy("key").agg(F.count("*").alias("size"), F.max("owner").alias("owned"))
                         .where("size > 1 AND owned = 1").select("key"), "line-keys")
    found = stored(bitmap_filter(keys, shared, "key").join(shared, "key")
                        .groupBy("key", "id").agg(F.max("owner").alias("owner")), "line-found")
    pivots = (found.where("owner = 1").groupBy("key").agg(F.min("id").alias("pivot")))
    return stored(found.join(pivots, "key"), "line-members")


def _stars(members: DataFrame) -> DataFrame:
    return (members.where("id <> pivot")
            .select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct())


def _labelled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """The members but pivots, with their component and whether it is another than the pivot's."""
    labels = comps.select(F.col("id"), "component")
    return (members.join(labels, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
            .join(labels.select(F.col("id").alias("pivot"), F.col("component").alias("pc")), "pivot", "left")
            .withColumn("outside", F.col("comp") != F.coalesce("pc", "pivot")).where("id <> pivot"))


def _remaining(m: DataFrame) -> DataFrame:
    """Pairs of one group of ``_labelled`` members in different components that have not been compared;
    one of them owns the segment."""
    out = m.where("outside").select("key", F.col("id").alias("a"), F.col("comp").alias("ac"), F.col("owner").alias("ao"))
    rest = m.select("key", F.col("id").alias("b"), F.col("comp").alias("bc"), F.col("owner").alias("bo"), "outside")
    return (out.join(rest, "key")
            .where((F.col("ac") != F.col("bc")) & (F.col("ao") + F.col("bo") > 0)
                   & (~F.col("outside") | (F.col("a") < F.col("b"))))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def line_components(lines: DataFrame, k: int) -> DataFrame:
    """``id, component`` of the distinct ``lines`` (``id, chars, line``) that are within k edits of another,
    by one round of keys and, for lines in crowded groups, a round for each of ``FINER``."""
    all_lines, keys, links = lines, keys_of(lines, k), None
    finer = list(FINER) if k <= 2 else []
    while keys is not None:
        members = _members(keys)
        new = stored(verify(_stars(members), all_lines, k), "line-links")
        links = new if links is None else links.unionByName(new)
        merged = stored(components(links, "line-components"), "line-first")
        m = stored(_labelled(members, merged), "line-labelled")
        keys, left = None, m
        if finer:
            crowded = stored(m.where("outside").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED)
                             .select("key"), "line-crowded")
            if crowded.limit(1).count():
                left = m.join(crowded, "key", "left_anti")
                # the pivots were compared with every member
                ids = stored(m.join(crowded, "key", "left_semi").select("id").distinct(), "line-crowd")
                lines = stored(bitmap_filter(lines, ids, "id").join(ids, "id", "left_semi"), "line-crowded-lines")
                keys = block_keys_of(lines, k, finer.pop(0))
        more = stored(verify(_remaining(left), all_lines, k), "line-links")
        if linked := bool(more.limit(1).count()):
            links = links.unionByName(more)
    return stored(components(links, "line-components"), "line-first") if linked else merged


def line_classes(docs: DataFrame, k: int = MAX_EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                 text_col: str = "text", min_exact: int | None = None) -> DataFrame:
    """``doc_id, text_hash, line_no, class_place, kept`` for every line long
    enough to compare: by edits from ``min_chars`` on, shorter ones for being
    equal from ``min_exact`` on (None: shorter lines are left alone)."""
    if min_chars < k + 1:
        raise ValueError("lines need a character for each of the k + 1 segments")
    least = min_chars if min_exact is None else max(1, min(min_exact, min_chars))
    lines = document_lines(docs, least, id_col, text_col)
    distinct = stored(
        lines.groupBy("line").agg(F.min(place()).alias("first"), F.count("*").alias("copies"))
        .select(*_line_key(), "first", "copies", F.char_length("line").alias("chars"), "line"), "line-distinct")
    merged = line_components(distinct.where(F.col("chars") >= min_chars).select("id", "chars", "line"), k)
    # lines of one place only are their own class; the others are looked up
    labels = (distinct.select("id", "id2", "first", "copies").join(merged, "id", "left")
              .where("copies > 1 OR component IS NOT NULL")
              .withColumn("label", F.coalesce("component", "id")))
    lows = labels.groupBy("label").agg(F.min("first").alias("class_place"))
    by_line = (labels.join(lows, "label").select("id", "id2", "class_place")
               .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    rows = lines.select("doc_id", "text_hash", "line_no", *_line_key(), place().alias("own"),
                        F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(SALTS)).cast("int").alias("salt"))
    return (rows.join(by_line, ["id", "id2", "salt"], "left")
            .withColumn("class_place", F.coalesce("class_place", "own"))
            .select("doc_id", "text_hash", "line_no", "class_place",
                    (F.col("class_place") == F.col("own")).alias("kept")))


def line_rows(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, line_no, class_doc_id, class_line_no, kept``."""
    step = F.lit(2**31).cast("decimal(11,0)")
    classes = line_classes(docs, **options)
    line_no = F.pmod(F.col("class_place"), step).cast("int")
    doc = ((F.col("class_place") - line_no) / step).cast("decimal(38,0)").cast("long")
    return classes.select("doc_id", "line_no", F.when(doc != LAST_ID, doc).alias("class_doc_id"),
                          line_no.alias("class_line_no"), "kept")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the lines that are not kept; a document that had lines
    and keeps none goes. All other columns stay as they are. Documents that
    lose no line are not shuffled."""
    dropped = stored(
        line_classes(docs, id_col=id_col, text_col=text_col, **options).where("NOT kept")
        .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__key"), "line_no").distinct()
        .groupBy("__id", "__key").agg(F.collect_set("line_no").alias("__drop")), "line-dropped")
    text = F.col(text_col)
    maybe, whole = bitmap_split(docs.withColumn("__key", F.xxhash64(text)), dropped.select("__key"), "__key")
    joined = maybe.withColumnRenamed("__key", "__own").join(
        dropped, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), "left")
    # the dropped line numbers as a map, so that each line is one look-up
    gone = F.map_from_arrays(F.col("__drop"), F.transform("__drop", lambda _: F.lit(True)))
    kept = F.filter(F.split(text, "\n"), lambda _, i: F.col("__gone")[i].isNull())
    changed = (joined.withColumn("__gone", gone)
               .withColumn("__lines", F.when(F.col("__drop").isNotNull(), kept))
               .where("__drop IS NULL OR exists(__lines, x -> btrim(x) <> '')"))
    new = F.when(F.col("__drop").isNull(), text).otherwise(F.array_join("__lines", "\n"))
    return (changed.withColumn(text_col, new).select(*docs.columns)
            .unionByName(whole.select(*docs.columns)))
