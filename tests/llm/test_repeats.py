"""Operator 11 against brute force: repeated windows, maximal repeats, groups."""

import hashlib
import random

import numpy as np
import pytest

from checkup.llm import suffix_repeats as R
from tests.llm.helpers import SCHEMA, docs_of


def repeated_windows(texts, length):
    seen = {}
    for k, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p:p + length], []).append((k, p))
    return {w: at for w, at in seen.items() if len(at) > 1}


def brute_rows(texts, length):
    masks = [bytearray(len(t)) for t in texts]
    for at in repeated_windows(texts, length).values():
        for k, p in at:
            masks[k][p:p + length] = b"\1" * length
    out = []
    for t, m in zip(texts, masks):
        kept = bytes(c for c, gone in zip(t, m) if not gone)
        out.append((len(t), sum(m), sum(1 for x in bytes(m).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=40, alphabet="ab é", passage=60):
    rnd = random.Random(seed)
    shared = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(10, passage))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [rnd.choice(shared) if rnd.random() < 0.4 else "".join(rnd.choice("abcdefgh \n") for _ in range(rnd.randrange(0, 25)))
                 for _ in range(rnd.randrange(0, 7))]
        out.append("".join(parts))
    return out + [None, "", "x", out[3], out[3], "zz" * 40, "z" * 300, "é" * 30]


@pytest.mark.parametrize("split", [10_000, 3, 0])
def test_removed_bytes_equal_brute_force(spark, split):
    for seed, length, gram in ((1, 16, 8), (2, 21, 4), (3, 40, 32)):
        texts = corpus(seed)
        rows = R.without_repeats(docs_of(spark, texts), length, gram, split).collect()
        got = {r.doc_id: (r.n_bytes, sum(s.hi - s.lo for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows}
        assert [got[i] for i in range(len(texts))] == brute_rows([(t or "").encode() for t in texts], length)


def brute_maximal(strings, n_starts, least):
    """{substring: occurrences} that cannot be made longer on either side."""
    out = {}
    places = {}
    for s, t in enumerate(strings):
        for p in range(n_starts[s]):
            for e in range(p + least, len(t) + 1):
                places.setdefault(t[p:e], []).append((s, p))
    for w, at in places.items():
        if len(at) < 2:
            continue
        after = {strings[s][p + len(w):p + len(w) + 1] or (s, p) for s, p in at}
        before = {(s, p) if p == 0 else strings[s][p - 1:p] for s, p in at}
        # a stretch's first start counts as a difference
        if len(after) > 1 and (len(before) > 1 or any(p == 0 for _, p in at)):
            out[w] = sorted(at)
    return out


def test_interval_tree_gives_all_maximal_repeats():
    rnd = random.Random(4)
    for trial in range(60):
        strings = list({bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(6, 30))) for _ in range(rnd.randrange(1, 9))})
        n_starts = np.array([rnd.randrange(1, len(s) + 1) for s in strings])
        least = rnd.randrange(2, 6)
        string, place, node, length, above = R.maximal_repeats(strings, n_starts, least)
        want = brute_maximal(strings, n_starts, least)
        members = {}
        for s, p, v in zip(string.tolist(), place.tolist(), node.tolist()):
            while v >= 0:
                members.setdefault(v, []).append((s, p))
                v = int(above[v])
        got = {strings[at[0][0]][at[0][1]:at[0][1] + int(length[v])]: sorted(at) for v, at in members.items()}
        assert got == want, trial


def test_groups_list_every_occurrence(spark):
    rnd = random.Random(9)
    passage = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(500))
    noise = lambda: "".join(rnd.choice("qrstuvwxyz") for _ in range(150))
    texts = [noise() + passage[:260] + noise(), noise() + passage[100:] + noise(), passage, noise()]
    rows = R.repeat_groups(docs_of(spark, texts)).collect()
    up = {r.group_id: (r.parent_id, r.length) for r in rows}
    members = {}
    for r in rows:
        g = r.group_id
        while g is not None:
            members.setdefault(g, set()).add((r.doc_id, r.start))
            g = up[g][0] if g in up else None
    data = [t.encode() for t in texts]
    for g, at in members.items():
        if g in up:
            assert len({data[d][s:s + up[g][1]] for d, s in at}) == 1 and len(at) > 1
    hit = {(d, p) for g, at in members.items() if g in up for d, s in at for p in range(s, s + up[g][1])}
    want = {(k, q) for at in repeated_windows(data, 200).values() for k, p in at for q in range(p, p + 200)}
    assert hit == want


def test_repeated_rows_null_ids_and_more_columns(spark):
    long = "".join(random.Random(2).choice("abcdefg ") for _ in range(400))
    rows = [(1, long, "x"), (1, long, "y"), (None, long[:250], "z"), (None, None, "z"), (2, "short", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in R.repeat_rows(docs).collect()))
    assert got == [(0, 0, 0, 0), (0, 250, 250, 1), (1, 400, 400, 1), (1, 400, 400, 1), (2, 5, 0, 0)]
    assert R.repeat_rows(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text_cut_into_segments(spark, monkeypatch):
    rnd = random.Random(5)
    a = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    texts = [a + "tail", "head" + a[500:2500], a[:900]]
    data = [t.encode() for t in texts]
    from checkup.llm import anchors
    monkeypatch.setattr(anchors, "SEGMENT", 700)
    h, c, text, lo, n = anchors.stretches(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data]), 200, 64)
    starts = sorted((int(t), p) for t, x, k in zip(text, lo, n) for p in range(int(x), int(x + k)))
    assert starts == [(k, p) for k, d in enumerate(data) for p in range(len(d) - 199)]
    by_window = {}
    for t, x, k, hh in zip(text, lo, n, h):
        for p in range(int(x), int(x + k)):
            by_window.setdefault(data[t][p:p + 200], set()).add(int(hh))
    assert all(len(v) == 1 for v in by_window.values())  # equal windows have equal anchors
