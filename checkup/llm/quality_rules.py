"""Operator 3: quality rules learned as a decision list.

Per-document statistics feed a sequential-covering learner (grow and prune, in
the manner of IREP / RIPPER): each rule is a conjunction of thresholds that
rejects a document, grown by FOIL gain on two thirds of the labelled rows and
pruned on the rest; covered rows are removed and the next rule is learned. The
list becomes one ordered Spark conditional expression; what no rule catches is
kept. Training uses at most ``max_labelled`` labelled rows, chosen by a hash of
the document id; applying the rules covers every row.

Base rules: ``base_failed`` when there are fewer than 50 words, or when more
than half of the words lie in 3-word windows found twice or more.

Defined results: null and empty texts have zero statistics and fail the base
rule; repeated rows each get a row; no usable labels (or one class only) gives
an empty list that keeps all; an empty table gives an empty result; a null id
stays null; labels with a null or contradictory id or value are left out;
extra columns are ignored (``with_quality`` keeps them).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checkup.llm.common import ship, text_batches

MAX_LABELLED = 20_000
SYMBOLS = b"#*$%&|<>"
ENDS = b".!?,;:"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["symbol_share", "dup_line_share", "repeat_share", "mean_word", "max_word", "upper_share",
          "digit_share", "echo_share", "marked_share", "lone_symbol_share", "exclaim_share",
          "words_per_line"]
STATS_DDL = ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in SHARES])


def text_stats(text: str | None) -> tuple:
    """The statistics of one text, in the order of ``COUNTS + SHARES``."""
    raw = (text or "").encode()
    words = raw.split()  # bytes split on blank and \\t \\n \\v \\f \\r only
    n = len(words)
    if not n:
        return (0,) * len(COUNTS) + (0.0,) * len(SHARES)
    joined = b"".join(words)
    # UTF-8 continuation bytes are no code points of their own
    word_chars = len(joined.decode())
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split()]
    n_dup_lines = len(lines) - len(set(lines))
    ids: dict = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    covered = 0
    if n >= 3:
        # pairs, then triples, are numbered densely, so that no key overflows
        _, pair = np.unique(codes[:-1] * len(ids) + codes[1:], return_inverse=True)
        _, inv, count = np.unique(pair[:-1] * len(ids) + codes[2:], return_inverse=True, return_counts=True)
        twice = np.flatnonzero(count[inv] > 1)
        mask = np.zeros(n, bool)
        for k in range(3):
            mask[twice + k] = True
        covered = int(mask.sum())
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    marked = sum(1 for w in words if w[-1] in SYMBOLS)
    lone = sum(1 for w in words if not w.translate(None, SYMBOLS))
    return (n, word_chars, n_symbols, n_dup_lines, covered,
            n_symbols / n, n_dup_lines / len(lines), covered / n, word_chars / n,
            float(max(map(len, words))), upper / word_chars, digits / word_chars, float((codes[1:] == codes[:-1]).sum()) / n,
            marked / n, lone / n, raw.count(b"!") / n, n / len(lines))


def with_stats(df: DataFrame, text_col: str = "text", out: str = "stats") -> DataFrame:
    """``df`` with a struct column ``out`` of the statistics; any columns (and
    names that clash with the statistics) pass through."""
    ship(df.sparkSession)
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string(STATS_DDL))])
    struct = pa.struct([(c, pa.int64()) for c in COUNTS] + [(c, pa.float64()) for c in SHARES])

    def run(batches):
        for b in text_batches(batches):
            rows = [text_stats(t) for t in b.column(at).to_pylist()]
            cols = list(zip(*rows))
            stats = pa.StructArray.from_arrays(
                [pa.array(c, f.type) for c, f in zip(cols, struct)], fields=list(struct))
            yield pa.RecordBatch.from_arrays([*b.columns, stats], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class Threshold:
    """``stat >= value`` or ``stat <= value``."""
    stat: str
    at_least: bool
    value: float

    def mask(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        col = x[:, names.index(self.stat)]
        return col >= self.value if self.at_least else col <= self.value

    def column(self, stats: str):
        c = F.col(stats).getField(self.stat).cast("double")
        return c >= F.lit(self.value) if self.at_least else c <= F.lit(self.value)


def _covers(rule, x, names):
    m = np.ones(len(x), bool)
    for t in rule:
        m &= t.mask(x, names)
    return m


def _best_test(x, y, names):
    """The threshold with the highest FOIL gain on the rows ``x`` (reject:
    ``y``), from one sort of each statistic."""
    p0, n0 = int(y.sum()), int((~y).sum())
    base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        v, pos = x[order, j], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])  # between rows cut and cut + 1
        if not len(cut):
            continue
        for at_least in (False, True):
            p = pos[cut] if not at_least else p0 - pos[cut]
            total = cut + 1 if not at_least else len(v) - cut - 1
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / total) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                mid = float((v[cut[k]] + v[cut[k] + 1]) / 2)
                best = (float(gain[k]), Threshold(name, at_least, mid))
    return best[1]


def learn(x: np.ndarray, reject: np.ndarray, names: list[str], max_rules: int = 12,
          max_tests: int = 4, min_precision: float = 0.9, min_cover: int = 10) -> list[list[Threshold]]:
    """Ordered rules, each a list of tests that must all hold to reject.

    A rule is kept when, on the pruning third as well as over all rows left,
    at least ``min_precision`` of what it catches is to be rejected, and it
    catches ``min_cover`` rows or more. Learning stops at the first rule that
    isn't."""
    rules: list[list[Threshold]] = []
    third = np.arange(len(x)) % 3 == 2  # rows come in hash order
    alive = np.ones(len(x), bool)
    for _ in range(max_rules):
        grow, prune = alive & ~third, alive & third
        if reject[grow].sum() < 2 or not prune.any():
            break
        rule, inside = [], grow.copy()
        while len(rule) < max_tests and (reject & inside).any() and (~reject & inside).any():
            t = _best_test(x[inside], reject[inside], names)
            if t is None:
                break
            rule.append(t)
            inside &= t.mask(x, names)
        if not rule:
            break

        def worth(r):
            m = _covers(r, x, names) & prune
            p, n = int((reject & m).sum()), int((~reject & m).sum())
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        hit = _covers(rule, x, names) & alive
        good = int((reject & hit).sum())
        if worth(rule) < 2 * min_precision - 1 or hit.sum() < min_cover or good < min_precision * hit.sum():
            break
        rules.append(rule)
        alive &= ~hit
    return rules


def labelled_sample(labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id",
                    label_col: str = "quality") -> DataFrame:
    """At most ``max_labelled`` (doc_id, quality) rows, by a hash of the id."""
    return (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("quality"))
            .dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
            .where("quality = other AND quality IN (0, 1)").drop("other")
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))


def fit_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id",
              text_col: str = "text", **options) -> list[list[Threshold]]:
    """Rules from the labelled rows of ``docs``. The sample is broadcast (its
    size is ``max_labelled`` rows at most) and no more labelled documents than
    that reach the driver, as numbers only."""
    names = SHARES  # counts grow with a text's length, so rules on them would punish long texts
    sample = F.broadcast(labelled_sample(labels, max_labelled))
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .join(sample, "doc_id"))
    got = (with_stats(rows).select("doc_id", "quality", "stats.*")
           .orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(max_labelled).toPandas())
    if got.empty:
        return []
    return learn(got[names].to_numpy(float), got["quality"].to_numpy() == 0, names, **options)


def rules_column(rules: list[list[Threshold]], stats: str = "stats"):
    """The ordered conditional expression: the number of the first rule that
    rejects (from 1), or 0."""
    if not rules:
        return F.lit(0)
    out = None
    for k, rule in enumerate(rules, 1):
        cond = rule[0].column(stats)
        for t in rule[1:]:
            cond = cond & t.column(stats)
        out = F.when(cond, F.lit(k)) if out is None else out.when(cond, F.lit(k))
    return out.otherwise(F.lit(0))


def base_failed_column(stats: str = "stats"):
    s = F.col(stats)
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def with_quality(docs: DataFrame, rules: list[list[Threshold]], text_col: str = "text", out: str = "stats") -> DataFrame:
    """``docs`` with the struct ``out``, to which ``base_failed``, ``rule`` and
    ``kept`` are added."""
    df = with_stats(docs, text_col, out)
    failed, rule = base_failed_column(out), rules_column(rules, out)
    return df.withColumn(out, F.struct(
        F.col(f"{out}.*"), failed.alias("base_failed"), rule.alias("rule"),
        (~failed & (rule == 0)).alias("kept")))


def quality_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 max_labelled: int = MAX_LABELLED, **options) -> DataFrame:
    """One row per document: statistics, ``base_failed``, ``kept``, ``rule``."""
    rules = fit_rules(docs, labels, max_labelled, id_col, text_col, **options)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    q = with_quality(base, rules)
    return q.select("doc_id", *[F.col(f"stats.{c}") for c in COUNTS], "stats.base_failed", "stats.kept", "stats.rule")
