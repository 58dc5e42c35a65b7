"""Operator 5: secret scans with a recursive decoding worklist.

A worklist starts with the text itself. Every layer is scanned for secrets and
for encodings: percent escapes, Unicode escapes, base64 runs and, inside those,
compressed data. Decoded layers join the worklist until nothing new comes up;
a layer already seen at the same place is not taken again, so cycles end. Each
layer keeps, for every character, the place in the original text it stems from,
and secrets found in it are reported at those places. A layer decoded from a
base64 run maps to the four-character groups that hold it; one that was
compressed maps to all of the packed data. Compressed data is unpacked and
scanned in windows of about ``WINDOW`` characters that end only where neither a
secret nor an encoded run can go on, so that a small run that unpacks to a huge
text is scanned whole; memory grows with the longest stretch without such a place.

Secrets (leftmost, non-overlapping per kind): ``assign``, a secret-like name
with a value of six or more characters; ``access``, an access key id of 20 or
more characters; ``hex``, a run of 24 or more lower-case hex digits. A span is
the whole match, in code points, its end exclusive.

Defined results: null and empty texts have no spans (the digest of the empty
string); repeated rows each get a row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checkup.llm.common import ship, text_batches

KINDS = ("assign", "access", "hex")
WINDOW, LOOK, HEAD = 1 << 20, 1 << 12, 16
MASK = "[REDACTED]"
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
_ESCAPED = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
_DIGIT, _NEXT = "[A-Za-z0-9+/_-]", r"\r?\n\x20*"
_BASE64 = re.compile(rf"{_DIGIT}{{16,}}+(?:{_NEXT}{_DIGIT}++)*+={{0,2}}"
                     rf"|(?<!{_DIGIT}){_DIGIT}{{4,15}}+(?:{_NEXT}{_DIGIT}{{4,15}}+){{3,}}+(?:{_NEXT}{_DIGIT}++)?={{0,2}}")
_BETWEEN = re.compile(r"[\r\n\x20=]+")
_NO_DIGITS = np.frombuffer(b"\r\n =", np.uint8)
_STANDARD = str.maketrans("-_", "+/")
# heads of gzip, bzip2, xz and zlib, as bytes and in base64
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|x[\x01\x5e\x9c\xda]")
_MAGIC64 = re.compile(r"H4sI|Qlpo[MNO]|/Td6WFoA|e(?:A[E-H]|F[4-7]|J[w-z]|N[o-r])")
# no secret, however encoded, takes fewer bytes
_TELLING = re.compile(rb"[\x20-\x7e\r\n]{11}")
# what neither a secret nor an encoded run goes on behind
_CUT = re.compile(r"[^\x20-\x7e\r\n]|(?<![A-Za-z0-9+/_-])\r\n|(?<![A-Za-z0-9+/_\r-])\n"
                  r"|\n(?=\x20*[^\x20A-Za-z0-9+/_%\\-])")
_WORD = re.compile(r"[!-~]*%[0-9A-Fa-f]{2}[!-~]*")
_LINE = re.compile(r"[\x20-~]*\\x[0-9A-Fa-f]{2}[\x20-~]*")
_ONE_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_ONE_ESCAPE = re.compile(r"\\(?:x[0-9A-Fa-f]{2}|[0abfnrtv\\'\"])")
_SHORT = dict(zip("0abfnrtv\\'\"", b"\0\a\b\f\n\r\t\v\\'\""))


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secrets that stand in ``text`` as it is."""
    found = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(n in low for n in _NAMES):
            found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


class Layer:
    """A text whose character k stems from ``start[k]:end[k]`` of the original."""
    __slots__ = ("text", "start", "end", "depth")

    def __init__(self, text, start, end, depth):
        self.text, self.start, self.end, self.depth = text, start, end, depth

    def key(self):
        return (hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest(),
                int(self.start[0]), int(self.end[-1]))


def _replaced(layer: Layer, matches, decode) -> Layer | None:
    """The layer with each match replaced by what ``decode`` makes of it:
    a list of (character, from, to), offsets within the match; None: as it is."""
    text, starts, ends, at, changed = [], [], [], 0, False
    for m in matches:
        got = decode(m.group())
        if got is None:
            continue
        changed = True
        a, b = m.span()
        text.append(layer.text[at:a])
        starts.append(layer.start[at:a])
        ends.append(layer.end[at:a])
        text.append("".join(c for c, _, _ in got))
        starts.append(layer.start[[a + f for _, f, _ in got]])
        ends.append(layer.end[[a + t - 1 for _, _, t in got]])
        at = b
    if not changed:
        return None
    text.append(layer.text[at:])
    starts.append(layer.start[at:])
    ends.append(layer.end[at:])
    return Layer("".join(text), np.concatenate(starts), np.concatenate(ends), layer.depth + 1)


def _characters(raw: bytes, width: int, errors: str = "strict"):
    """(character, from, to) of UTF-8 bytes of which each takes ``width``."""
    out, at = [], 0
    for c in raw.decode("utf-8", errors):
        n = len(c.encode("utf-8", "surrogateescape"))
        out.append((c, at * width, (at + n) * width))
        at += n
    return out


def _unpercent(run: str):
    raw = bytes.fromhex(run.replace("%", ""))
    return _characters(raw, 3, "surrogateescape") if any(raw) else None


def _unescape(run: str):
    out = []
    for m in _ESCAPED.finditer(run):
        code = int(m[1] or m[2] or m[3], 16)
        if code > 0x10FFFF:
            return None
        if out and 0xDC00 <= code < 0xE000 and 0xD800 <= ord(out[-1][0]) < 0xDC00:
            high, a, _ = out.pop()
            out.append((chr(0x10000 + ((ord(high) - 0xD800) << 10) + code - 0xDC00), a, m.end()))
        else:
            out.append((chr(code), m.start(), m.end()))
    return out or None


def _readable(text: str) -> bool:
    bad = sum(1 for c in text if not (c.isprintable() or c in "\n\r\t"))
    return bool(text) and bad * 10 <= len(text)


def _box(head: bytes):
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78":
        return zlib.decompressobj()
    return bz2.BZ2Decompressor() if head[:3] == b"BZh" else lzma.LZMADecompressor()


def _inflated(chunks, left: list | None = None):
    """What the members of compressed data hold, in parts of ``WINDOW`` bytes at
    most. ``left`` gets the number of bytes behind the last member."""
    chunks, rest, box = iter(chunks), b"", None
    while True:
        if box is None:
            behind = len(rest)
            rest = rest.lstrip(b"\0")  # padding between members
            while len(rest) < HEAD and (more := next(chunks, None)) is not None:
                behind += len(more)
                rest = (rest + more).lstrip(b"\0")
            if not _MAGIC.match(rest):
                if left is not None:
                    left.append(behind)
                return
            box = _box(rest)
        try:
            part = box.decompress(rest, WINDOW)
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            return
        if part:
            yield part
        if box.eof:
            rest, box = box.unused_data, None
            continue
        rest = getattr(box, "unconsumed_tail", b"")
        if rest or (part if not hasattr(box, "needs_input") else not box.needs_input):
            continue
        rest = next(chunks, None)
        if rest is None:
            return


def _extent(raw: bytes) -> int:
    """How many bytes the compressed data at the head of ``raw`` takes; 0: none
    that yields anything."""
    left, some = [], False
    for _ in _inflated([raw], left):
        some = True
    return len(raw) - sum(left) if some else 0


def _windows(chunks):
    """The text of a stream of bytes, cut only where no secret and no encoded
    run, in whatever layer, can go on."""
    decoder, held, size = codecs.getincrementaldecoder("utf-8")("replace"), [], 0
    tail = ""
    for chunk in chunks:
        text = decoder.decode(chunk)
        looked = tail + text
        held.append(text)
        size += len(text)
        tail = looked[-LOOK:]
        if size < WINDOW:
            continue
        cut = 0
        for stop in range(len(looked), 0, -LOOK):
            for m in _CUT.finditer(looked, max(stop - 2 * LOOK, 0), stop):
                cut = m.end()
            if cut:
                break
        back = len(looked) - cut
        if not cut or back >= size:
            continue
        whole = "".join(held)
        yield whole[:size - back]
        held, size = [whole[size - back:]], back
    whole = "".join(held) + decoder.decode(b"", True)
    if whole:
        yield whole


def _unpacked(raw: bytes):
    """Windows of the text in compressed data, and in data compressed in it."""
    seen, head, digest = {hashlib.sha256(raw).digest()}, raw, None

    def noted(chunks):
        nonlocal head
        for part in chunks:
            if len(head) < HEAD:
                head += part[:HEAD]
            digest.update(part)
            yield part

    level = 0
    while _MAGIC.match(head):
        level += 1
        chunks, head, digest = [raw], b"", hashlib.sha256()
        for _ in range(level):
            chunks = _inflated(chunks)
        try:
            yield from _windows(noted(chunks))
        except RecursionError:  # data that unpacks to ever new packed data
            return
        if digest.digest() in seen:  # data that unpacks to itself
            return
        seen.add(digest.digest())


def _packed_layers(layer: Layer, raw: bytes, first: int, last: int):
    """Layers of what ``raw``, which stems from ``first`` to ``last``, unpacks to."""
    for text in _unpacked(raw):
        n = len(text)
        yield Layer(text, np.broadcast_to(layer.start[first], n), np.broadcast_to(layer.end[last], n), layer.depth + 1)


def _raw64(run: str) -> bytes:
    run = run[:-1] if len(run) % 4 == 1 else run  # a stray last character
    return binascii.a2b_base64(run + "=" * (-len(run) % 4))


def _unbase64(layer: Layer):
    """Layers for each base64 run, its lines joined: of packed data that begins
    anywhere in it, and of its text at each of the four alignments."""
    for m in _BASE64.finditer(layer.text):
        whole, a = m.group(), m.start()
        points = np.frombuffer(whole.encode(), np.uint8)
        at = a + np.flatnonzero(~np.isin(points, _NO_DIGITS))
        run = _BETWEEN.sub("", whole).translate(_STANDARD)
        done = 0
        for h in _MAGIC64.finditer(run):
            first = h.start()
            if first < done:
                continue
            head = _raw64(run[first:first + 64])
            try:
                if not _MAGIC.match(head):
                    continue
                _box(head).decompress(head, 1)
            except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
                continue
            raw = _raw64(run[first:])
            size = _extent(raw)
            if size:
                done = min(first + -(-size * 4 // 3), len(run))
                yield from _packed_layers(layer, raw[:size], at[first], at[done - 1])
        for first in range(4):
            raw = _raw64(run[first:])
            if first and not _TELLING.search(raw):
                continue
            text = raw.decode("utf-8", "surrogateescape")
            if not (_readable(text) or _may_decode(text) or scan(text)):
                continue
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            size = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            size[(points >= 0xDC80) & (points < 0xDD00)] = 1
            stop = np.cumsum(size)
            group = first + (stop - size) // 3 * 4
            last = np.minimum(first + ((stop - 1) // 3 + 1) * 4, len(run)) - 1
            yield Layer(text, layer.start[at[group]], layer.end[at[last]], layer.depth + 1)


def _unescaped_packed(layer: Layer, escapes: re.Pattern, stretch: re.Pattern, value):
    """Layers of packed data that is written with escapes among plain ASCII."""
    for s in stretch.finditer(layer.text):
        raw, at, pos = bytearray(), [], s.start()
        for m in escapes.finditer(layer.text, *s.span()):
            raw += layer.text[pos:m.start()].encode()
            at += range(pos, m.start())
            raw.append(value(m.group()))
            at.append(m.start())
            pos = m.end()
        raw += layer.text[pos:s.end()].encode()
        at += [*range(pos, s.end()), s.end()]
        raw, done = bytes(raw), 0
        for h in _MAGIC.finditer(raw):
            first = h.start()
            if first < done or not (size := _extent(raw[first:])):
                continue
            done = first + size
            yield from _packed_layers(layer, raw[first:done], at[first], at[done] - 1)


def _children(layer: Layer):
    if "%" in layer.text:
        got = _replaced(layer, _PERCENT.finditer(layer.text), _unpercent)
        if got:
            yield got
        yield from _unescaped_packed(layer, _ONE_PERCENT, _WORD, lambda e: int(e[1:], 16))
    if "\\" in layer.text:
        got = _replaced(layer, _ESCAPE.finditer(layer.text), _unescape)
        if got:
            yield got
        yield from _unescaped_packed(layer, _ONE_ESCAPE, _LINE,
                                     lambda e: int(e[2:], 16) if e[1] == "x" else _SHORT[e[1]])
    yield from _unbase64(layer)


def _may_decode(text: str) -> bool:
    return "%" in text or "\\" in text or _BASE64.search(text) is not None


def find_secrets(text: str | None) -> tuple[list, list, int]:
    """(base spans, all spans, layers decoded); spans are (start, end, kind),
    ordered by start, then kind as in ``KINDS``, then end."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    text = text or ""
    base = sorted(scan(text), key=order)
    spans, layers = set(base), 0
    if text and _may_decode(text):
        root = Layer(text, np.arange(len(text)), np.arange(1, len(text) + 1), 0)
        seen, work = {root.key()}, deque([root])
        while work:
            for child in _children(work.popleft()):
                if not child.text or (key := child.key()) in seen:
                    continue
                seen.add(key)
                layers += 1
                work.append(child)
                spans.update((int(child.start[a]), int(child.end[b - 1]), kind) for a, b, kind in scan(child.text))
    return base, sorted(spans, key=order), layers


def redact(text: str | None, spans: list) -> str | None:
    """The text with each maximal run of overlapping spans replaced."""
    if not text or not spans:
        return text
    out, at, stop = [], 0, -1
    for a, b, _ in sorted(spans):
        if a >= stop:
            out.append(text[at:max(a, at)])
            out.append(MASK)
        stop = at = max(stop, b)
    return "".join(out) + text[at:]


def written(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


SPAN_ROWS = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
             "n_layers long")


def secret_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its base counts, digest and all spans."""
    ship(docs.sparkSession)

    def run(batches):
        for b in text_batches(batches):
            found = [find_secrets(t) for t in b.column(1).to_pylist()]
            cols = [[sum(1 for s in base if s[2] == kind) for base, _, _ in found] for kind in KINDS]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols),
                 pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _, _ in found], pa.string()),
                 pa.array([written(spans) for _, spans, _ in found], pa.string()),
                 pa.array([n for _, _, n in found], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, SPAN_ROWS))


def with_redacted(docs: DataFrame, text_col: str = "text", out: str = "n_secrets") -> DataFrame:
    """``docs`` with every secret in ``text_col`` masked, and the number of its
    spans in ``out``; all other columns pass through."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])

    def run(batches):
        for b in text_batches(batches):
            texts, counts = [], []
            for t in b.column(at).to_pylist():
                spans = find_secrets(t)[1]
                texts.append(redact(t, spans))
                counts.append(len(spans))
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], names=[*b.schema.names, out])

    return docs.mapInArrow(run, schema)
