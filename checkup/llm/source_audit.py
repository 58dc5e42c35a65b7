"""Source divergence audit: how far the sources of a language are apart in their
use of words, and which words lead a source away from its language.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A
language keeps the terms that stand in at least ``min_docs`` of its documents
(``V`` of them). A group (language, source) with ``N`` kept occurrences gives
each kept term the weight ``1 + floor(scale * (count + prior) / (N + prior * V))``,
and so does the language as a whole.

Counting. Each task counts the terms of its documents in a bounded table and
emits one row per (language, source, term); these are added up by all three, so
a source with a third of all rows is combined on the map side and never lies in
one task.

Pairs of sources (``divergences``): Gustavson's row-by-row product. Kept terms are
dealt into blocks by hash (about ``BLOCK_POSTINGS`` counts each). In a block every
group scatters its terms through the term-major index into one dense
accumulator with a place for each peer; only the accumulators leave the block,
never a pair of counts. A term that a peer lacks has the peer's weight for
count 0, not 0: the accumulator starts from these baselines, and the scattered
terms correct them. All arithmetic is in whole numbers.

Null ``text``, ``lang`` and ``source`` are ''. Repeated rows are documents of
their own; every (language, source) that occurs is a group, with or without
terms; a language without kept terms has divergences of 0 and no leading terms;
an empty table gives no rows; further columns are not read. Ties are ranked by
the item's UTF-8 bytes.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from checkup.llm.common import ship, text_batches
from checkup.session import materialize

MIN_DOCS, PRIOR, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
BLOCK_POSTINGS = 50_000   # counts in a block of terms, about
TABLE_ENTRIES = 250_000    # terms counted in a task before they are emitted
CHUNK = 1 << 20            # bytes of a long text that are split at once

# ASCII letters to lower case, other ASCII bytes to blanks, the rest as it is.
_TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                     ("n", pa.int64()), ("docs", pa.int64())])


def text_terms(data: bytes):
    """Lists of the terms of a UTF-8 text, a bounded part of the text at a time."""
    at = 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        part = data[at:end].translate(_TERM_BYTES)
        if end < len(data):
            cut = part.rfind(b" ")
            while cut < 0 and end < len(data):  # one term longer than a part
                end = min(end + CHUNK, len(data))
                part = data[at:end].translate(_TERM_BYTES)
                cut = part.rfind(b" ")
            if end < len(data):
                part, end = part[:cut], at + cut + 1
        yield part.split()
        at = end


def _emit(table: dict) -> pa.RecordBatch:
    langs, sources, terms, ns, docs = [], [], [], [], []
    for (lang, source), (total, seen) in table.items():
        terms.append(None)  # the group itself
        ns.append(0)
        docs.append(0)
        for t, n in total.items():
            terms.append(t.decode())
            ns.append(n)
            docs.append(seen[t])
        langs += [lang] * (len(total) + 1)
        sources += [source] * (len(total) + 1)
    return pa.record_batch([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.string()),
                            pa.array(ns, pa.int64()), pa.array(docs, pa.int64())], schema=_COUNTS)


def _count(batches):
    table, entries = {}, 0
    for batch in text_batches(batches):
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.large_binary())):
            group = table.get((lang, source))
            if group is None:
                group = table[lang, source] = (Counter(), Counter())
                entries += 1
            before, seen = len(group[0]), set()
            for terms in text_terms(text.as_py()):
                group[0].update(terms)
                seen.update(terms)
            group[1].update(seen)
            entries += len(group[0]) - before
            if entries > TABLE_ENTRIES:
                yield _emit(table)
                table, entries = {}, 0
    if table:
        yield _emit(table)


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, docs): occurrences, and documents that hold
    the term; one row with a null term for each group."""
    ship(docs.sparkSession)
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    part = texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _weight(count, total, terms, prior: int, scale: int):
    """1 + floor(scale * (count + prior) / (total + prior * terms)), exactly."""
    up = (count + F.lit(prior)).cast("decimal(19,0)") * F.lit(scale).cast("decimal(19,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", up, (total + F.lit(prior) * terms).cast("decimal(19,0)"))


class Audit:
    """The tables of one audit: ``groups`` (lang, source, total, terms, base) and
    ``postings`` (lang, source, term, n, p, q), kept terms only."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, prior: int = PRIOR, scale: int = SCALE):
        counts = materialize(term_counts(docs), "term-counts")
        term = Window.partitionBy("lang", "term")
        kept = materialize(
            counts.where("term IS NOT NULL")
            .withColumn("lang_docs", F.sum("docs").over(term)).withColumn("lang_n", F.sum("n").over(term))
            .withColumn("first_of_term", (F.row_number().over(term.orderBy("source")) == 1).cast("bigint"))
            .where(F.col("lang_docs") >= min_docs).drop("docs", "lang_docs"), "kept-terms")
        sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("first_of_term").alias("terms"))
        groups = (counts.where("term IS NULL").select("lang", "source")
                  .join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
                  .select("lang", "source", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                                              for c in ("total", "lang_total", "terms")]))
        zero = F.when(F.col("terms") > 0, _weight(F.lit(0).cast("bigint"), F.col("total"), F.col("terms"), prior, scale))
        self.groups = materialize(groups.withColumn("base", F.coalesce(zero, F.lit(0)).cast("bigint")), "audit-groups")
        self.postings = (
            kept.join(self.groups, ["lang", "source"])
            .select("lang", "source", "term", "n",
                    _weight(F.col("n"), F.col("total"), F.col("terms"), prior, scale).alias("p"),
                    _weight(F.col("lang_n"), F.col("lang_total"), F.col("terms"), prior, scale).alias("q")))
        self.postings = materialize(self.postings, "audit-postings")


def block_accumulators(rows: pd.DataFrame, peers: pd.DataFrame) -> pd.DataFrame:
    """One block of terms: ``rows`` (source, term, p) and all ``peers`` of the
    language (source, base). Returns (a, b, v), a < b: what the terms of this
    block add to the divergence of a and b over |base a - base b| for each term."""
    peers = peers.sort_values("source", kind="stable")
    names, base = peers["source"].to_numpy(object), peers["base"].to_numpy(np.int64)
    place = {s: i for i, s in enumerate(names)}
    who = rows["source"].map(place).to_numpy(np.int64)
    term, p = pd.factorize(rows["term"])[0].astype(np.int64), rows["p"].to_numpy(np.int64)
    by_term = np.argsort(term, kind="stable")            # term-major index
    t_start = np.searchsorted(term[by_term], np.arange(term.max() + 2 if len(term) else 1))
    t_who, t_p = who[by_term], p[by_term]
    by_group = np.argsort(who, kind="stable")
    g_start = np.searchsorted(who[by_group], np.arange(len(names) + 1))
    out_a, out_b, out_v = [], [], []
    everyone = np.arange(len(names))
    for g in range(len(names)):
        own = by_group[g_start[g]:g_start[g + 1]]
        if not len(own):
            continue
        mine, flat = p[own], np.abs(base[g] - base)
        # baselines: each peer as if it had none of the group's terms
        up = np.sort(mine)
        below = np.searchsorted(up, base)
        sums = np.concatenate([[0], np.cumsum(up)])
        acc = (base * below - sums[below]) + (sums[-1] - sums[below] - base * (len(up) - below)) - len(up) * flat
        # the group's terms through the index: places of all postings of each term
        lo, n = t_start[term[own]], t_start[term[own] + 1] - t_start[term[own]]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(lo - (ends - n), n)
        peer, theirs, ours = t_who[at], t_p[at], np.repeat(mine, n)
        later = peer > g  # what both have is added once for the two
        peer, theirs, ours = peer[later], theirs[later], ours[later]
        np.add.at(acc, peer, np.abs(ours - theirs) - np.abs(ours - base[peer]) - np.abs(base[g] - theirs) + flat[peer])
        keep = everyone != g
        out_a.append(np.full(len(names) - 1, g))
        out_b.append(everyone[keep])
        out_v.append(acc[keep])
    a, b, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b, out_v))
    return pd.DataFrame({"a": names[np.minimum(a, b)], "b": names[np.maximum(a, b)], "v": v.astype(np.int64)})


def divergences(audit: Audit) -> DataFrame:
    """Rows (lang, source, item, q, value) for every ordered pair of two sources
    of a language: the sum of |p - q| over all kept terms."""
    spark = audit.groups.sparkSession
    ship(spark)
    blocks = max(1, -(-audit.postings.count() // BLOCK_POSTINGS))
    rows = audit.postings.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), "source", "term", "p")
    peers = audit.groups.select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"),
                                "source", "base")

    def solve(key, left, right):
        out = block_accumulators(left, right)
        out.insert(0, "lang", key[0])
        return out

    parts = (rows.groupBy("lang", "block").cogroup(peers.groupBy("lang", "block"))
             .applyInPandas(solve, "lang string, a string, b string, v long"))
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))
    both = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "v").unionByName(
        sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "v"))
    other = audit.groups.select("lang", F.col("source").alias("item"), F.col("base").alias("item_base"))
    pairs = audit.groups.join(other, "lang").where("source <> item")
    return (pairs.join(both, ["lang", "source", "item"], "left")
            .select("lang", "source", "item",
                    (F.col("terms") * F.abs(F.col("base") - F.col("item_base")) + F.coalesce("v", F.lit(0)))
                    .cast("bigint").alias("value")))


def leading_terms(audit: Audit) -> DataFrame:
    """Rows (lang, source, item, value): terms that a group uses more than its
    language does, and by how much."""
    return audit.postings.where("n > 0 AND p > q").select(
        "lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def audit_rows(docs: DataFrame, min_docs: int = MIN_DOCS, prior: int = PRIOR, scale: int = SCALE,
               top_terms: int = TOP_TERMS) -> DataFrame:
    """Both parts, ranked within a group: ``pair`` whole, ``term`` up to
    ``top_terms`` (tasks keep only so many a group before the shuffle)."""
    audit = Audit(docs, min_docs, prior, scale)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))

    def ranked(df, part):
        return df.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part))

    pair, term = ranked(divergences(audit), "pair"), ranked(leading_terms(audit), "term").where(F.col("rank") <= top_terms)
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select(*cols).unionByName(term.select(*cols))


ORACLE_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents),
w AS MATERIALIZED (
  SELECT id, lang, source, term, count(*) AS n
  FROM (SELECT id, lang, source, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d)
  GROUP BY ALL),
k AS MATERIALIZED (
  SELECT lang, term, sum(n)::hugeint AS lang_n FROM w GROUP BY ALL HAVING count(*) >= 30),
v AS MATERIALIZED (SELECT lang, count(*)::hugeint AS v, sum(lang_n)::hugeint AS lang_total FROM k GROUP BY lang),
c AS MATERIALIZED (
  SELECT lang, source, term, sum(n)::hugeint AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (
  SELECT a.lang, a.source, coalesce(s.total, 0)::hugeint AS total, coalesce(v.v, 0)::hugeint AS v, coalesce(v.lang_total, 0)::hugeint AS lang_total
  FROM (SELECT DISTINCT lang, source FROM d) a
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) s USING (lang, source)
  LEFT JOIN v USING (lang)),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::hugeint AS n,
         1 + (1000000000::hugeint * (coalesce(c.n, 0)::hugeint + 5)) // (g.total + 5 * g.v) AS p,
         1 + (1000000000::hugeint * (k.lang_n + 5)) // (g.lang_total + 5 * g.v) AS q
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.f, 0)::bigint AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT l.lang, l.source, r.source AS item, sum(abs(l.p - r.p)) AS f
             FROM p l JOIN p r ON l.lang = r.lang AND l.term = r.term AND l.source <> r.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q)::bigint AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value,
       (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::integer AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::integer AS rank FROM terms) WHERE rank <= 50
"""
