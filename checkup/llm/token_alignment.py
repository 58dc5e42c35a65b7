"""Cross-tokenizer alignment of a byte-level BPE (A) and a sentence-piece BPE (B).

Both tokenizers cut the same bytes, a blank and the text. Byte offsets where a
token of A and one of B both end cut the tokens into groups. They are found by
interval coalescing: the tokens of both sides are sorted by start (``lexsort``),
the largest end so far runs along (``maximum.accumulate``), and a group breaks
where a start reaches it. Within a group, overlapping tokens are expanded into
pairs; a *link* is such a pair whose byte ranges end together.

A text is cut in front of single blanks and line feeds, where both tokenizers
always part (no entry of either vocabulary spans them). Distinct pieces are
encoded and aligned once and kept in a memo that is bounded in bytes; texts for
which the cuts are not certain (other white space, neighbouring blanks) are
encoded and aligned whole.

Corpus-wide counts of linked id pairs: the pairs of each text are counted in the
task, then added up by pair. Of two entries whose ranges end together one ends
with the other, so the number of different pairs is bounded by the vocabularies
(``max_pairs``: the entries of one side that end an entry of the other, about half a
million for the public files), whatever the corpus; the table of counts is
therefore broadcast.

Null or empty texts, and texts whose joined bytes of A or B are not a blank and the
text (a U+2581 in it, for example), have no tokens: zeros and ''. Every row gives one row, repeated
ones too, and a null ``doc_id`` is kept; an empty table gives none; further columns
are not read. Very long texts are handled whole, one at a time.
"""

from __future__ import annotations

import hashlib
import os
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkup.llm.chunk_tokenizer import _BYTE_CHARS, _ODD
from checkup.llm.common import ship, text_batches
from checkup.session import materialize

MEMO_BYTES = 96 << 20
B_SPAN = 1 << 20  # larger than any id of B: a pair is a_id * B_SPAN + b_id

_STATS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                    ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])
_STATS_DDL = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "pairs array<long>, counts array<int>")
_LOADED: dict = {}


def coalesce_intervals(starts: np.ndarray, ends: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): tokens of both sides sorted by start, and the number of
    the group of each. A group breaks where a start reaches the largest end so far."""
    order = np.lexsort((sides, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.empty(len(order), np.int64)
    breaks[:1] = 0
    breaks[1:] = starts[order][1:] >= reach[:-1]
    return order, np.cumsum(breaks)


def overlapping_pairs(a_start, a_end, b_start, b_end) -> tuple[np.ndarray, np.ndarray]:
    """Places (in A, in B) of all tokens that share bytes. Both sides are sorted
    and gapless, so the partners of a token are one run."""
    first = np.searchsorted(b_end, a_start, side="right")
    last = np.searchsorted(b_start, a_end, side="left")
    n = np.maximum(last - first, 0)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(n) else 0
    return np.repeat(np.arange(len(n)), n), np.arange(total) - np.repeat(ends - n, n) + np.repeat(first, n)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces in one array, and how many each piece has."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


class ByteSide:
    """A byte-level BPE: ids of pieces, and the bytes of its entries."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        byte = {c: b for b, c in enumerate(_BYTE_CHARS)}
        size = t.get_vocab_size(with_added_tokens=True)
        self.entry = [bytes(byte[c] for c in (t.id_to_token(i) or "") if c in byte) for i in range(size)]
        self.tokenizer = t

    def ids(self, pieces):
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


class PieceSide:
    """A sentence-piece BPE: ids of pieces, and the bytes of its entries."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.entry = []
        for i in range(m.vocab_size()):
            if m.is_byte(i):
                self.entry.append(bytes([int(m.id_to_piece(i)[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i):
                self.entry.append(b"")
            else:
                self.entry.append(m.id_to_piece(i).replace("▁", " ").encode())
        self.model = m
        self.blank = m.piece_to_id("▁")

    def ids(self, pieces):
        """The model puts a blank in front by itself (none for an empty text): for a
        piece with a blank it stands for that one, before a line feed it is taken off."""
        got = self.model.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        return [[self.blank] if p == " " else ids if p[0] == " " else ids[1:] for p, ids in zip(pieces, got)]


class Aligner:
    """Aligned pieces, kept in a memo: per piece (n_a, n_b, n_groups, groups as
    text, linked pairs as bytes), or None if its bytes do not come back."""

    def __init__(self, a_path: str, b_path: str, memo_bytes: int = MEMO_BYTES):
        self.a, self.b = ByteSide(a_path), PieceSide(b_path)
        self.a_len = np.array([len(x) for x in self.a.entry], np.int64)
        self.b_len = np.array([len(x) for x in self.b.entry], np.int64)
        self.text_of = [str(i) for i in range(max(len(self.a.entry), len(self.b.entry)))]
        self.marked = [c + i for c in ",|;" for i in self.text_of]  # an id behind each mark
        self.memo_bytes, self.memo, self.used = memo_bytes, {}, 0

    @staticmethod
    def pieces(text: str) -> list[str] | None:
        """Pieces of a blank and the text, or None where the cuts are not certain."""
        if _ODD.search(text) or text[:1] == " " or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return None
        return [p if p[:1] == "\n" else " " + p for p in text.replace("\n", " \n").split(" ")]

    def align(self, pieces: list[str], a_ids: list[list[int]], b_ids: list[list[int]]) -> list:
        """Coalesces the tokens of all pieces at once; joined, the pieces are the line
        on which the tokens lie."""
        raw = [p.encode() for p in pieces]
        (a, a_n), (b, b_n) = _flat(a_ids), _flat(b_ids)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        base = np.cumsum(size) - size
        if not self._same(raw, size, a, a_n, b, b_n):
            good = [self._same([r], size[k:k + 1], *_flat([a_ids[k]]), *_flat([b_ids[k]])) for k, r in enumerate(raw)]
            if not any(good):
                return [None] * len(pieces)
            found = iter(self.align(*([x for x, g in zip(y, good) if g] for y in (pieces, a_ids, b_ids))))
            return [next(found) if g else None for g in good]
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        a_start, b_start = a_end - self.a_len[a], b_end - self.b_len[b]
        na, ids = len(a), np.concatenate([a, b])
        order, group = coalesce_intervals(np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end]),
                                          np.repeat([0, 1], [na, len(b)]))
        # in a group all of A, then all of B
        by_group = np.lexsort((order >= na, group))
        token, group = order[by_group], group[by_group]
        side_b = token >= na
        new_group, new_side = np.empty(len(token), bool), np.empty(len(token), bool)
        new_group[0], new_side[0] = True, False
        new_group[1:], new_side[1:] = group[1:] != group[:-1], side_b[1:] & ~side_b[:-1]
        kind = np.where(new_group, 2 * len(self.text_of), np.where(new_side, len(self.text_of), 0))
        words = list(map(self.marked.__getitem__, (kind + ids[token]).tolist()))
        tokens = np.cumsum(a_n + b_n)
        groups = np.add.reduceat(new_group.astype(np.int64), tokens - a_n - b_n)
        x, y = overlapping_pairs(a_start, a_end, b_start, b_end)
        ends = a_end[x] == b_end[y]
        x, y = x[ends], y[ends]
        links = (a[x] * B_SPAN + b[y]).tobytes()
        at = (8 * np.searchsorted(a_end[x], np.append(base, base[-1] + size[-1]), side="right")).tolist()
        out, first = [], 0
        for k, (n_a, n_b, n_groups, last) in enumerate(zip(a_n.tolist(), b_n.tolist(), groups.tolist(), tokens.tolist())):
            out.append((n_a, n_b, n_groups, "".join(words[first:last])[1:], links[at[k]:at[k + 1]]))
            first = last
        return out

    def _same(self, raw, size, a, a_n, b, b_n) -> bool:
        """Whether the tokens of both sides are the bytes of each piece."""
        line = b"".join(raw)
        for entry, lens, ids, n in ((self.a.entry, self.a_len, a, a_n), (self.b.entry, self.b_len, b, b_n)):
            if b"".join(map(entry.__getitem__, ids.tolist())) != line or not n.all():
                return False
            if (np.add.reduceat(lens[ids], np.cumsum(n) - n) != size).any():
                return False
        return True

    def _learn(self, seen: set) -> None:
        """Align what the memo lacks. Over its bound in bytes the half that came
        first stays; frequent pieces come early."""
        if self.used > self.memo_bytes:
            self.memo = dict(islice(self.memo.items(), len(self.memo) // 2))
            self.used = sum(map(self._cost, self.memo.items()))
        new = list(seen.difference(self.memo))
        for k in range(0, len(new), 20_000):
            part = new[k:k + 20_000]
            got = list(zip(part, self.align(part, self.a.ids(part), self.b.ids(part))))
            self.memo.update(got)
            self.used += sum(map(self._cost, got))

    @staticmethod
    def _cost(item) -> int:
        piece, got = item
        return 250 + 2 * len(piece) + (0 if got is None else 120 + len(got[3]) + len(got[4]))

    def __call__(self, texts: list[str]) -> list:
        """Per text (n_a, n_b, n_groups, groups as text, linked pairs), or None."""
        cut = [self.pieces(t) if t else None for t in texts]
        seen: set = set()
        for pieces in cut:
            if pieces is not None:
                seen.update(pieces)
        self._learn(seen)
        out = []
        for text, pieces in zip(texts, cut):
            if not text:
                out.append(None)
            elif pieces is None:
                out.append(self._whole(text))
            else:
                parts = list(map(self.memo.__getitem__, pieces))
                if None in parts:
                    out.append(None)
                    continue
                n_a, n_b, n_groups, groups, pairs = zip(*parts)
                out.append((sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), b"".join(pairs)))
        return out

    def _whole(self, text: str):
        return self.align([" " + text], self.a.ids([" " + text]), [self.b.model.encode(text, num_threads=1)])[0]


def load_aligner(a_path: str, b_path: str) -> Aligner:
    key = (a_path, b_path)
    if key not in _LOADED:
        _LOADED[key] = Aligner(*key)
    return _LOADED[key]


def max_pairs(a_path: str, b_path: str) -> int:
    """How many id pairs can be linked at all: entries whose bytes end with those
    of an entry of the other side."""
    sides = [[e for e in side.entry if e] for side in (ByteSide(a_path), PieceSide(b_path))]
    total = 0
    for long, short in (sides, sides[::-1]):
        count: dict = {}
        for e in short:
            count[e] = count.get(e, 0) + 1
        total += sum(count.get(e[k:], 0) for e in long for k in range(len(e)))
    return total


def aligned_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row: ``row`` (its number), doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, and ``pairs`` / ``counts``: the linked id pairs and how often."""
    ship(docs.sparkSession)

    def run(batches):
        align = load_aligner(a_path, b_path)
        for batch in text_batches(batches):
            cols = {f.name: [] for f in _STATS}
            for got in align([t or "" for t in batch.column(2).to_pylist()]):
                n_a, n_b, n_groups, groups, linked = got or (0, 0, 0, "", b"")
                pairs, counts = np.unique(np.frombuffer(linked, np.int64), return_counts=True)
                cols["n_a"].append(n_a)
                cols["n_b"].append(n_b)
                cols["n_groups"].append(n_groups)
                cols["n_links"].append(len(linked) // 8)
                cols["groups_sha256"].append(hashlib.sha256(groups.encode()).hexdigest() if got else "")
                cols["pairs"].append(pairs)
                cols["counts"].append(counts.astype(np.int32))
            cols["row"], cols["doc_id"] = batch.column(0), batch.column(1)
            yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x, _STATS.field(c).type)
                                   for c, x in cols.items()], schema=_STATS)

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
                         F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, _STATS_DDL)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Rows (pair, n, best): links of the corpus that hold the id pair, and whether
    no pair with the same id of B has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("x.pairs", "x.counts")
    n = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n"))
    b = F.col("pair") % B_SPAN
    most = n.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return n.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_rows(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links
    whose pair is the most frequent of its id of B), count_sum (over its links, the
    count of the pair), groups_sha256."""
    aligned = materialize(aligned_documents(docs, a_path, b_path), "aligned")
    counts = materialize(pair_counts(aligned), "pair-counts")  # at most max_pairs() rows
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("row", "x.pairs", "x.counts")
    sums = (each.join(F.broadcast(counts), F.col("pairs") == F.col("pair"))
            .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("counts")).otherwise(0)).alias("n_best"),
                                F.sum(F.col("counts").cast("bigint") * F.col("n")).alias("count_sum")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return (aligned.drop("pairs", "counts").join(sums, "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"))


def document_alignment(text: str, a_path: str, b_path: str) -> list[tuple[int, int, list[int], list[int]]]:
    """The groups of one text: (start, end, ids of A, ids of B), byte offsets in a
    blank and the text. For use inside a job's own function."""
    align = load_aligner(a_path, b_path)
    got = align([text])[0]
    out, at = [], 0
    for group in got[3].split(";") if got else []:
        a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
        size = int(align.a_len[a].sum())
        out.append((at, at + size, a, b))
        at += size
    return out
