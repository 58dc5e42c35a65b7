"""Operator 9: byte-level BPE encoding and decoding without regex.

Pre-tokenisation is vectorised. Each code point becomes one of a few symbols
through a class array; a small automaton over those symbols knows whether a
character stands inside a contraction. Its run is an associative scan:
transition functions of fixed-width blocks are composed column by column for
all blocks at once, the blocks' functions are combined by doubling, and the
states then follow from each block's entry state. Token starts are array
comparisons on symbols and states. The slices feed a memo of merged pieces;
byte offsets are kept, so that ids decode back piece by piece.

The pattern whose matches this reproduces (``public_tokenizers.PATTERN``):
contractions ``'s 't 're 've 'm 'll 'd``; an optional blank with letters, with
numbers, or with other characters; white space, of which the last character
before a word is left over.

Defined results: null and empty texts have no tokens (the digests of empty
strings); repeated rows each get a row; an empty table gives an empty result;
other columns are ignored. Very long pieces merge with a heap in n log n.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkup.llm.common import ship, text_batches

OTHER, LETTER, NUMBER, BLANK, SPACE, SHORT, LONG = range(7)  # symbols; the last two are apostrophes
FIRST = 7  # added to the symbol of a text's first character
PLAIN, MARKS, AFTER_BLANK, ONE_LEFT, TWO_LEFT, ENDED = range(6)  # states
N_STATES = 6
WIDTH = 128
NEVER = 1 << 60  # rank of a pair that does not merge
_MEMO: dict = {}


def class_table() -> bytes:
    """A class for each code point (OTHER, LETTER, NUMBER or SPACE), as the
    tokenizer library itself sees letters, numbers and white space."""
    import tiktoken

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    everything = "".join(map(chr, points))
    table = np.zeros(0x110000, np.uint8)
    single = {bytes([i]): i for i in range(256)}
    for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        own = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = own.decode_bytes(own.encode_ordinary(everything)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = cls
    table[0x20] = BLANK
    return zlib.compress(table.tobytes())


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _transitions() -> np.ndarray:
    """The automaton, flat: state after symbol ``s`` in state ``q`` at
    ``s * N_STATES + q``. Symbols from FIRST on begin a text."""
    t = np.zeros((2 * FIRST, N_STATES), np.uint8)
    plain = {OTHER: MARKS, LETTER: PLAIN, NUMBER: PLAIN, BLANK: AFTER_BLANK, SPACE: PLAIN}
    for s in range(FIRST):
        for q in range(N_STATES):
            fresh = {SHORT: ONE_LEFT, LONG: TWO_LEFT} if q not in (MARKS, AFTER_BLANK) else {SHORT: MARKS, LONG: MARKS}
            after = (plain | fresh)[s]
            t[s, q] = ENDED if q == ONE_LEFT else ONE_LEFT if q == TWO_LEFT else after
        t[FIRST + s, :] = t[s, PLAIN]
    return t.ravel()


_FLAT = _transitions()


def scan_states(symbols: np.ndarray) -> np.ndarray:
    """The automaton's state before each symbol."""
    n = len(symbols)
    blocks = -(-n // WIDTH)
    padded = np.zeros(blocks * WIDTH, np.uint8)
    padded[:n] = symbols * N_STATES
    columns = np.ascontiguousarray(padded.reshape(blocks, WIDTH).T)
    # each block's transition function, for all entry states
    func = np.tile(np.arange(N_STATES, dtype=np.uint8), (blocks, 1))
    for col in columns:
        func = _FLAT[col[:, None] + func]
    # inclusive scan of the functions by doubling; composition is associative
    step = 1
    while step < blocks:
        func[step:] = np.take_along_axis(func[step:], func[:-step].astype(np.intp), axis=1)
        step *= 2
    state = np.full(blocks, PLAIN, np.uint8)
    state[1:] = func[:-1, PLAIN]
    before = np.empty((WIDTH, blocks), np.uint8)
    for j, col in enumerate(columns):
        before[j] = state
        state = _FLAT[col + state]
    return before.T.ravel()[:n]


def piece_starts(points: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Indices of the code points that begin a piece. ``points`` are the texts'
    code points one after the other, ``lengths`` the (positive) text lengths."""
    n = len(points)
    cls = table[points]
    ends = np.cumsum(lengths)
    first = np.zeros(n, bool)
    first[0] = True
    first[ends[:-1]] = True
    last = np.zeros(n, bool)
    last[ends - 1] = True
    symbols = cls.copy()
    marks = np.flatnonzero((points == 0x27) & ~last)
    if len(marks):
        one = points[marks + 1]
        room = ~last[marks + 1]
        two = np.where(room, points[np.minimum(marks + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long_ = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | (
            (one == ord("l")) & (two == ord("l")))
        symbols[marks[short]] = SHORT
        symbols[marks[long_]] = LONG
    symbols[first] += FIRST
    before = scan_states(symbols)
    white = cls >= BLANK
    prev, next_white = np.empty(n, np.uint8), np.ones(n, bool)
    prev[0], prev[1:] = OTHER, cls[:-1]
    next_white[:-1] = white[1:]
    next_white[last] = True
    prev_white = prev >= BLANK
    start = np.where(white, ~prev_white | ~next_white, (prev != BLANK) & (prev != cls))
    start[(before == ONE_LEFT) | (before == TWO_LEFT)] = False
    start[(before == ENDED) | first] = True
    return np.flatnonzero(start)


class Codec:
    """Encoder and decoder of one rank file; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int], table: bytes, max_entries: int = 300_000):
        self.ranks, self.max_entries = ranks, max_entries
        self.table = np.frombuffer(zlib.decompress(table), np.uint8)
        self.pieces = _Pieces(self)
        self.vocabulary = {v: k for k, v in ranks.items()}

    def merge(self, piece: bytes) -> tuple:
        """Ids of one piece: the adjacent pair of lowest rank merges first,
        the leftmost of equals."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) > 96:
            return self._merge_long(piece)
        parts = [piece[i:i + 1] for i in range(len(piece))]
        get = ranks.get
        pairs = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == NEVER:
                break
            at = pairs.index(best)  # only the two neighbouring pairs change
            joined = parts[at] + parts.pop(at + 1)
            parts[at] = joined
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + joined, NEVER)
            if at < len(pairs):
                pairs[at] = get(joined + parts[at + 1], NEVER)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple:
        """The same with a heap of pairs over a linked list of parts."""
        n, ranks = len(piece), self.ranks
        end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(i):
            j = nxt[i]
            if j < n:
                r = ranks.get(piece[i:end[j]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[i], end[j]))

        for i in range(n - 1):
            push(i)
        gone = bytearray(n)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if gone[i] or end[i] != mid or nxt[i] >= n or end[nxt[i]] != stop:
                continue
            j = nxt[i]
            gone[j] = 1
            end[i], nxt[i] = stop, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            push(i)
            if prv[i] >= 0:
                push(prv[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = nxt[i]
        return tuple(out)

    def split(self, texts: list[str]) -> list[list[bytes]]:
        """The pieces of each text, as UTF-8."""
        full = [t for t in texts if t]
        if not full:
            return [[] for _ in texts]
        joined = "".join(full)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        lengths = np.array([len(t) for t in full], np.int64)
        starts = piece_starts(points, lengths, self.table)
        raw = joined.encode()
        if len(raw) == len(points):
            at = starts
        else:
            width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
            at = (np.cumsum(width, dtype=np.int64) - width)[starts]
        cuts = [*at.tolist(), len(raw)]
        pieces = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        bounds = [0, *np.searchsorted(starts, np.cumsum(lengths)).tolist()]
        parts = iter([pieces[a:b] for a, b in zip(bounds, bounds[1:])])
        return [next(parts) if t else [] for t in texts]

    def encode(self, texts: list[str]) -> list[list[int]]:
        if len(self.pieces) > self.max_entries:
            self.pieces.clear()
        get = self.pieces.__getitem__
        return [list(chain.from_iterable(map(get, pieces))) for pieces in self.split(texts)]

    def offsets(self, ids: list[int]) -> list[int]:
        """Byte offset at which each token begins."""
        out, at = [], 0
        for i in ids:
            out.append(at)
            at += len(self.vocabulary[i])
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


class _Pieces(dict):
    """Merged pieces; long ones are not kept."""

    def __init__(self, codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece):
        ids = self.codec.merge(piece)
        if len(piece) <= 48:
            self[piece] = ids
        return ids


def codec(path: str, table: bytes) -> Codec:
    if path not in _MEMO:
        _MEMO[path] = Codec(load_ranks(path), table)
    return _MEMO[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, offsets``: token ids and the byte where each begins."""
    table = class_table()
    ship(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64()))])

    def run(batches):
        c = codec(path, table)
        for b in text_batches(batches, 1 << 20):
            ids = c.encode([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, out.field(1).type),
                 pa.array([c.offsets(x) for x in ids], out.field(2).type)],
                schema=out)

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, ids array<int>, offsets array<long>"))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids`` (bytes that are no UTF-8, as after
    a cut through a character, become replacement characters)."""
    table = class_table()
    ship(encoded.sparkSession)

    def run(batches):
        c = codec(path, table)
        for b in batches:
            texts = [None if x is None else c.decode(x).decode(errors="replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the ids and
    of what they decode to, in one pass, without moving the ids."""
    table = class_table()
    ship(docs.sparkSession)

    def run(batches):
        c = codec(path, table)
        for b in text_batches(batches, 1 << 20):
            n, ids_hash, text_hash = [], [], []
            for ids in c.encode([t or "" for t in b.column(1).to_pylist()]):
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
