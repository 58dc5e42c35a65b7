import base64
import bz2
import gzip
import hashlib
import lzma
import random
import urllib.parse
import zlib

import pytest

from checkup.llm.secrets import MASK, WINDOW, _windows, find_secrets, redact, secret_rows, with_redacted, written
from tests.llm.helpers import docs_of

SECRET = "password = hunter2hunter2"
KEY = "AKIA" + "Q" * 16


def b64(data) -> str:
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def test_base_spans_by_hand():
    text = f"é Token: 'abcdef' {KEY} {'0af' * 8}! api_key=short AKIA1 secret: token: abcdefg"
    base, spans, _ = find_secrets(text)
    # a failing match (a value of five characters) uses up its text
    assert written(base) == "assign:2:16,access:18:38,hex:39:63"
    assert base == spans
    assert find_secrets("ſecret=abcdefg paſſword=abcdefg TOKEN=ABCDEF")[0] == [(32, 44, "assign")]


def test_kinds_share_a_start_in_order():
    text = "a" * 30 + " x"
    assert written(find_secrets("token=" + "a" * 30)[0]) == "assign:0:36,hex:6:36"
    assert written(find_secrets(text)[0]) == "hex:0:30"


@pytest.mark.parametrize("wrap", [
    lambda s: b64(s), lambda s: b64("xx " + b64(s) + " yy"), lambda s: b64(gzip.compress(s.encode())),
    lambda s: b64(zlib.compress(s.encode())), lambda s: b64(bz2.compress(s.encode())),
    lambda s: urllib.parse.quote(s, safe="").replace("p", "%70", 1),
    lambda s: urllib.parse.quote(urllib.parse.quote(s.replace("=", "%3D"))),
    lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"\\x{ord(c):02x}" for c in s),
    lambda s: urllib.parse.quote(b64(gzip.compress(b64(s).encode()))),
])
def test_nested_layers_map_into_the_original(wrap):
    hidden = wrap(SECRET)
    text = f"😀 before {hidden} after"
    base, spans, layers = find_secrets(text)
    assert base == [] and layers >= 1
    at = text.index(hidden)
    assert any(k == "assign" and at <= a < b <= at + len(hidden) for a, b, k in spans)
    clean = redact(text, spans)
    assert MASK in clean and clean.startswith("😀 before ") and clean.endswith(" after")
    assert not [s for s in find_secrets(clean)[1] if s[2] == "assign"]


def test_worklist_ends_on_cycles_and_bombs():
    text = "%2525" * 50 + " " + b64("A" * 40)
    assert find_secrets(text)[1] == []
    bomb = b64(zlib.compress(b"\0" * 3_000_000 + SECRET.encode()))
    assert [k for _, _, k in find_secrets("x " + bomb)[1]] == ["assign"]


def test_clean_text_is_left_alone():
    for t in ["100%% sure, 5% off", "C:\\users\\name", "averylongordinarywordwithoutmeaning", "token ring", "the secret: no"]:
        assert find_secrets(t)[1] == [] and redact(t, []) == t


def test_rows_and_masking(spark):
    texts = [None, "", SECRET, "nothing", b64(SECRET), SECRET, "x" * 200_000 + " " + SECRET]
    rows = {r.doc_id: r for r in secret_rows(docs_of(spark, texts)).collect()}
    assert rows[0].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[0].spans == ""
    assert rows[2].n_assign == 1 and rows[4].n_assign == 0 and rows[4].spans.startswith("assign:")
    assert rows[6].spans == f"assign:200001:{200001 + len(SECRET)}"
    assert secret_rows(docs_of(spark, [])).collect() == []
    clash = docs_of(spark, texts).withColumnRenamed("lang", "spans").withColumnRenamed("source", "n_hex")
    out = with_redacted(clash, out="__n")
    assert out.columns == [*clash.columns, "__n"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[0] is None and got[1] == "" and got[2] == MASK and got[3] == "nothing"


def wrapped(data, columns=76) -> str:
    s = b64(data)
    return "\n".join(s[i:i + columns] for i in range(0, len(s), columns))


LONG = f"some text before it, {SECRET}, and words of all kinds behind it " + " ".join(f"w{i * i}" for i in range(60))


@pytest.mark.parametrize("hidden", [
    b64(gzip.compress(gzip.compress(SECRET.encode()))), b64(lzma.compress(gzip.compress(SECRET.encode()))),
    b64(gzip.compress(bz2.compress(zlib.compress(SECRET.encode())))),
    b64(gzip.compress(b"nothing here") + gzip.compress(SECRET.encode())),
    b64(bz2.compress(b"nothing here") + bz2.compress(SECRET.encode())),
    b64(lzma.compress(b"nothing here") + b"\0" * 4 + lzma.compress(SECRET.encode())),
    b64(gzip.compress(gzip.compress(b"nothing")) + gzip.compress(gzip.compress(SECRET.encode()))),
    wrapped(LONG, 64), wrapped(gzip.compress(LONG.encode())), wrapped(LONG).replace("\n", "\r\n"),
    wrapped(gzip.compress(LONG.encode()), 64), wrapped(gzip.compress(wrapped(LONG).encode()), 12),
    "path/to/" + b64(SECRET), "v1-" + b64(SECRET), "k_" + b64(gzip.compress(SECRET.encode())),
    "a/" + b64(zlib.compress(SECRET.encode())), "abc" + b64(b"\xff\xfe" + SECRET.encode()),
    urllib.parse.quote(gzip.compress(SECRET.encode())), "".join(f"%{c:02X}" for c in zlib.compress(SECRET.encode())),
    repr(gzip.compress(SECRET.encode(), mtime=0))[2:-1], "".join(f"\\x{c:02x}" for c in bz2.compress(SECRET.encode())),
])
def test_packed_wrapped_and_prefixed_layers(hidden):
    text = f"é before: {hidden} after"
    at = text.index(hidden)
    _, spans, _ = find_secrets(text)
    assert any(k == "assign" and at <= a < b <= at + len(hidden) for a, b, k in spans)
    clean = redact(text, spans)
    assert clean.startswith("é before: ") and clean.endswith(" after") and MASK in clean
    assert not [s for s in find_secrets(clean)[1] if s[2] == "assign"]


@pytest.mark.parametrize("inner", [
    lambda s: b64(gzip.compress(s)), lambda s: wrapped(bz2.compress(s)), lambda s: wrapped(zlib.compress(s), 64),
    lambda s: "".join(f"%{c:02x}" for c in lzma.compress(s)), lambda s: b64(wrapped(gzip.compress(s)).encode()),
])
@pytest.mark.parametrize("shift", [2_000, 9_000, 13_000])
def test_layers_across_a_window_edge(inner, shift):
    rnd = random.Random(shift)
    noise = " ".join("".join(rnd.choices("BCDEFGHIJKLMNOP", k=9)) for _ in range(2_500)).encode()
    payload = inner(noise + b" " + SECRET.encode() + b" " + noise).encode()
    plain = b"ordinary words, and a line end.\n" * (WINDOW // 32 + 1)
    data = plain[:WINDOW - shift] + b" " + payload + b" " + plain[:WINDOW]
    text = "x " + b64(gzip.compress(data)) + " y"
    assert len(payload) > 14_000 and "assign" in [k for _, _, k in find_secrets(text)[1]]


def test_windows_hold_the_whole_text():
    lines = b"".join(b"line %d of many, \xc3\xa9 too\r\n" % i for i in range(200_000)) + b"QUJD" * 400_000
    chunks = [lines[i:i + 65_537] for i in range(0, len(lines), 65_537)]
    got = list(_windows(iter(chunks)))
    assert "".join(got) == lines.decode() and len(got) > 3
    assert all(w.endswith(("\n", "é")) for w in got[:-1]) and len(got[-1]) >= 1_600_000
