"""Operator 1: exact Jaccard self-join of word shingles by filters under
several global token orders.

Two sets of sizes n and m with Jaccard similarity t or more share at least
``ceil(t * max(n, m))`` tokens, so under any total order of the tokens they
share one of each set's first ``p = n - ceil(t * n) + 1``. Three orders are
used, and a candidate must pass all of them before its intersection is counted:

* *frequency order*: ascending document frequency, then the hash. It makes the
  candidates: rare tokens stand first, so passages that many documents share
  hardly ever reach a prefix. The shorter set of a pair is met in its first
  ``n - ceil(2t / (1 + t) * n) + 1`` tokens only, and both must have enough
  tokens left from the common token's position on (length and position filter);
* *hash order* and *reversed hash order*, both ends of the sorted set.

The steps:

1. One pass hashes every text. Copies (equal sets) become one node.
2. Tokens of a fixed range of hashes (the sample) are counted: one that a single
   node holds lies in no other set. A node with p or more such tokens has no
   partner at all and leaves here; most do.
3. The nodes left are read again with all their tokens. Document frequencies
   among them give the frequency-order prefixes; equal prefix tokens make groups.
4. Each group's most shared node (smallest share of tokens of its own) is
   compared with every member, linear in the group. After components have been
   merged, only members outside the component of their group's central node are
   compared with those of a different component. No group is expanded into all
   its pairs; a pair left out is already in one component.
5. Copies take their node's component.

All joins and groupings are Spark's; sets meet in tasks only as pairs. Digests
and tokens are 64- and 63-bit hashes; a wrong link needs a collision between
two sets that are compared.

Defined results: null, empty and blank texts have an empty set, no link and
their own ``doc_id`` as component; repeated rows are copies; a null ``doc_id``
stays null and takes part; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checkup.llm.common import bitmap_filter, bitmap_split, components, ship, stored, text_batches
from checkup.llm.shingles import set_digest, shingle_sets

WIDTH, NUM, DEN = 5, 80, 100
SAMPLE_SHARE = 0.3  # of the hash range; the filter of step 2 needs more than 1 - NUM / DEN
KEY_BITS = 48  # sample tokens are shuffled as the upper 48 of 63 bits
SALTS = 8


def prefix_length(n, num: int = NUM, den: int = DEN):
    return n - -(-num * n // den) + 1


def _prefix_column(n, num, den):
    return n - F.floor((n * num + (den - 1)) / F.lit(den)).cast("long") + 1


def linked(common: int, n: int, m: int, num: int = NUM, den: int = DEN) -> bool:
    return den * common >= num * (n + m - common)


def required(n, m, num: int = NUM, den: int = DEN):
    """The overlap that sets of sizes n and m need."""
    return F.floor((num * (n + m) + (num + den - 1)) / F.lit(num + den)).cast("long")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, d``: set size and digest of each row."""

    def run(batches):
        for b in text_batches(batches, 1 << 20):
            sets = shingle_sets(b.column(1), width)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_digest(s) for s in sets], pa.int64())], names=["doc_id", "n", "d"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n long, d long")


def sample_tokens(docs: DataFrame, width: int, share: float, id_col: str, text_col: str) -> DataFrame:
    """``key, d`` for each row's tokens in the sample (a set's keys are distinct)."""
    shift, limit = 63 - KEY_BITS, int(share * 2**63)

    def run(batches):
        for b in text_batches(batches, 1 << 20):
            keys, owners = [], []
            for s in shingle_sets(b.column(1), width):
                k = np.unique(s[:np.searchsorted(s, limit)] >> shift)
                keys.append(k)
                owners.append(np.full(len(k), set_digest(s)))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))],
                                                 names=["key", "d"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "key long, d long")


def _node_key(col="doc_id"):
    """A document's key for fetching its text; null ids share one."""
    return F.coalesce(F.col(col), F.lit(-1)).alias("kid")


def fetch_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``d, n, tokens`` of the nodes ``wanted`` (``d, kid``); the text of one
    document per node is read again."""
    schema = pa.schema([("d", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches):
        for b in text_batches(batches, 1 << 20):
            sets = shingle_sets(b.column(0), width)
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    base = docs.select(_node_key(id_col), F.col(text_col).alias("text"))
    near = bitmap_filter(base, wanted.select("kid"), "kid")
    texts = near.join(wanted.select("kid").distinct(), "kid", "left_semi").select("text")
    return (texts.mapInArrow(run, "d long, n long, tokens array<long>")
            .join(wanted.select("d"), "d", "left_semi").dropDuplicates(["d"]))


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (``a, b``) that link. Both hash orders filter first."""
    pairs = stored(pairs, "jaccard-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("d"))
    sets = bitmap_filter(sets, ids, "d")  # sets in no pair are not shuffled
    left = sets.select(F.col("d").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("d").alias("b"), F.col("tokens").alias("y"))

    def run(batches):
        for b in text_batches(batches, 8 << 20):
            keep = []
            xs, ys = b.column(2), b.column(3)
            for i in range(b.num_rows):
                x, y = xs[i].values.to_numpy(), ys[i].values.to_numpy()
                p, q = prefix_length(len(x), num, den), prefix_length(len(y), num, den)
                ok = (len(np.intersect1d(x[:p], y[:q], assume_unique=True)) > 0
                      and len(np.intersect1d(x[-p:], y[-q:], assume_unique=True)) > 0
                      and linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), num, den))
                keep.append(ok)
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(keep, pa.bool_())) for c in (b.column(0), b.column(1))], names=["a", "b"])

    return (pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
            .mapInArrow(run, "a long, b long"))


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                          num: int = NUM, den: int = DEN, share: float = SAMPLE_SHARE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``."""
    sig = stored(signatures(docs, width, id_col, text_col), "jaccard-signatures")
    nodes = (sig.where("n > 0").groupBy("d")
             .agg(F.min(_node_key()).alias("kid"), F.max("n").alias("n"), F.min("doc_id").alias("low")))
    # 2. nodes with p tokens that no other set has are done
    own = (sample_tokens(docs, width, share, id_col, text_col)
           .groupBy("key").agg(F.min("d").alias("d"), F.max("d").alias("other")).where("d = other")
           .groupBy("d").agg(F.count("*").alias("alone")))
    p = _prefix_column(F.col("n"), num, den)
    left = stored(nodes.join(own, "d", "left").where(F.coalesce("alone", F.lit(0)) < p)
                       .select("d", "kid"), "jaccard-nodes")
    # 3. frequency-order prefixes of the nodes left
    sets = stored(fetch_sets(docs, left, width, id_col, text_col), "jaccard-sets")
    members = stored(_members(sets, num, den), "jaccard-members")
    # 4. each group's central node with every member
    stars = (members.where("d <> pivot")
             .where(_may_link("n", "pos", "pivot_n", "pivot_pos", num, den))
             .select(F.least("pivot", "d").alias("a"), F.greatest("pivot", "d").alias("b")).distinct())
    links = stored(verify(stars, sets, num, den), "jaccard-links")
    first = stored(components(links, "jaccard-components"), "jaccard-first")
    links2 = stored(verify(_remaining(members, first, num, den), sets, num, den), "jaccard-links")
    merged = (components(links.unionByName(links2), "jaccard-components")
              if links2.limit(1).count() else first)
    # 5. every row gets the smallest doc_id of its component
    label = nodes.join(merged.withColumnRenamed("id", "d"), "d", "left").select(
        "d", "low", F.coalesce("component", "d").alias("label"))
    lows = label.groupBy("label").agg(F.min("low").alias("component_id"))
    by_node = (label.join(lows, "label").select("d", "component_id")
               .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    out = (sig.select("doc_id", "n", F.when(F.col("n") > 0, F.col("d")).alias("d"),
                      F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
           .join(by_node, ["d", "salt"], "left"))
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest
    id; exact repeats of a row's id and text go as well. Only documents that
    may go are shuffled. Rows with a null id stay."""
    comps = stored(similarity_components(docs, id_col, text_col, **options), "jaccard-rows")
    gone = comps.where("component_id <> doc_id").select(F.col("doc_id").alias("__key")).distinct()
    twice = comps.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__key"))
    keyed = docs.withColumn("__key", F.col(id_col).cast("long"))
    maybe, sure = bitmap_split(keyed, gone.unionByName(twice), "__key")
    left = maybe.join(gone, "__key", "left_anti").dropDuplicates([id_col, text_col])
    return left.select(*docs.columns).unionByName(sure.select(*docs.columns))


def _members(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Groups of equal prefix tokens: ``key, d, n, pos, owner`` (whether the
    token stands in the shorter set's prefix) and the group's central node
    (``pivot, pivot_n, pivot_pos``)."""
    keys = sets.select("d", "n", F.explode("tokens").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    found = keys.join(shared, "key")
    by_node = W.partitionBy("d")
    # tokens of one set only stand first in the order; they are not in ``found``
    alone = F.col("n") - F.count("*").over(by_node)
    ranked = found.select("key", "d", "n", alone.alias("alone"),
                          F.row_number().over(by_node.orderBy("df", "key")).alias("rank"))
    short = F.col("n") - required(F.col("n"), F.col("n"), num, den) + 1
    placed = (ranked.withColumn("pos", F.col("alone") + F.col("rank"))
              .where(F.col("pos") <= _prefix_column(F.col("n"), num, den))
              .withColumn("owner", F.col("pos") <= short))
    central = F.struct((F.col("alone") / F.col("n")).alias("share"), F.col("d").alias("pivot"),
                       F.col("n").alias("pivot_n"), F.col("pos").alias("pivot_pos"))
    groups = (placed.groupBy("key").agg(F.count("*").alias("size"), F.min(F.when(F.col("owner"), central)).alias("c"))
              .where("size > 1 AND c IS NOT NULL").select("key", "c.pivot", "c.pivot_n", "c.pivot_pos"))
    return placed.select("key", "d", "n", "pos", "owner").join(groups, "key")


def _may_link(n: str, pos: str, m: str, pos_m: str, num: int, den: int):
    """Length and position filter for a pair met at its first common token."""
    n, pos, m, pos_m = (F.col(c) for c in (n, pos, m, pos_m))
    return ((F.least(n, m) * den >= F.greatest(n, m) * num)
            & (F.least(n - pos, m - pos_m) + 1 >= required(n, m, num, den)))


def _remaining(members: DataFrame, comps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of one group in different components, of which neither is the
    group's central node (those have been compared)."""
    labels = comps.withColumnRenamed("id", "d")
    m = (members.join(labels, "d", "left").withColumn("comp", F.coalesce("component", "d")).drop("component")
         .join(labels.select(F.col("d").alias("pivot"), F.col("component").alias("pc")), "pivot", "left")
         .withColumn("outside", F.col("comp") != F.coalesce("pc", "pivot"))
         .where("d <> pivot"))

    def side(df, x):
        return df.select("key", *[F.col(c).alias(x + c) for c in ("d", "n", "pos", "owner", "comp", "outside")])

    return (side(m.where("outside"), "a").join(side(m, "b"), "key")
            .where((F.col("acomp") != F.col("bcomp")) & (F.col("aowner") | F.col("bowner"))
                   & (~F.col("boutside") | (F.col("ad") < F.col("bd")))
                   & _may_link("an", "apos", "bn", "bpos", num, den))
            .select(F.least("ad", "bd").alias("a"), F.greatest("ad", "bd").alias("b")).distinct())
