"""Operators 12 and 13 against brute force on small fixtures."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from checkup.llm import source_audit as S
from checkup.llm import token_alignment as T
from tests.llm.helpers import docs_of

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
BITS = ["a", "é", "é", " ", "  ", "\n", ".", "<|endoftext|>", "'s", "1", "½", "\t", " ", "ß", "中", " foo", "!!!",
        "\r\n", "😀", " the", " alignment", "ing", "tion", "​", "ﬁ", " über", "<s>", "<0x0A>"]


def brute_alignment(texts):
    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in shown)}
    docs = []
    for text in texts:
        a = lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        a_bytes = [bytes(byte[c] for c in lib.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            docs.append(None)
            continue
        a_at = dict(zip(np.cumsum([len(x) for x in a_bytes]).tolist(), a))
        b_at = dict(zip(np.cumsum([len(x) for x in b_bytes]).tolist(), b))
        groups, lo = [], 0
        for hi in sorted(set(a_at) & set(b_at)):
            groups.append("|".join(",".join(str(at[p]) for p in range(lo + 1, hi + 1) if p in at) for at in (a_at, b_at)))
            lo = hi
        docs.append((len(a), len(b), groups, [(a_at[p], b_at[p]) for p in a_at if p in b_at]))
    count = collections.Counter(x for d in docs if d for x in d[3])
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else
            (d[0], d[1], len(d[2]), len(d[3]), sum(count[x] == best[x[1]] for x in d[3]), sum(count[x] for x in d[3]),
             hashlib.sha256(";".join(d[2]).encode()).hexdigest()) for d in docs]


def some_texts(n=300, seed=7):
    rnd = random.Random(seed)
    out = ["".join(rnd.choice(BITS) for _ in range(rnd.randrange(0, 30))) for _ in range(n)]
    return out + [None, "", " ", "a ", " a", "\n", "a\n", "\nb", "▁a b", "a▁", "word " * 500, "x" * 3000, out[1], out[1]]


def test_alignment_equals_brute_force(spark):
    texts = some_texts()
    docs = docs_of(spark, texts).selectExpr("*", "1 AS row", "'x' AS pairs")
    got = {r.doc_id: tuple(r)[1:] for r in T.alignment_rows(docs, A, B).collect()}
    assert [got[i] for i in range(len(texts))] == brute_alignment([t or "" for t in texts])
    assert sum(v[0] == 0 for v in got.values()) < len(texts) / 4
    assert T.alignment_rows(docs_of(spark, []), A, B).collect() == []
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b")], "doc_id long, text string")
    rows = T.alignment_rows(twice, A, B).collect()
    assert len(rows) == 3 and {r.count_sum for r in rows} == {6} and {r.n_best for r in rows} == {2}


def test_memo_that_is_emptied_changes_nothing():
    texts = [t or "" for t in some_texts(80, 3)]
    small, large = T.Aligner(A, B, memo_bytes=2000), T.Aligner(A, B)
    assert [x for t in texts for x in small([t])] == large(texts)


def test_groups_overlaps_and_bound():
    groups = T.document_alignment("Alignment of überlange words", A, B)
    raw = " Alignment of überlange words".encode()
    align = T.load_aligner(A, B)
    for lo, hi, a, b in groups:
        assert b"".join(align.a.entry[i] for i in a) == raw[lo:hi] == b"".join(align.b.entry[i] for i in b)
    assert groups[0][0] == 0 and groups[-1][1] == len(raw)
    a = np.array([0, 2, 5, 6]), np.array([2, 5, 6, 9])
    b = np.array([0, 1, 6]), np.array([1, 6, 9])
    want = [(i, j) for i in range(4) for j in range(3) if a[0][i] < b[1][j] and b[0][j] < a[1][i]]
    assert list(zip(*(x.tolist() for x in T.overlapping_pairs(*a, *b)))) == want
    order, group = T.coalesce_intervals(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.repeat([0, 1], [4, 3]))
    assert dict(zip(order.tolist(), group.tolist())) == {0: 0, 1: 0, 2: 0, 4: 0, 5: 0, 3: 1, 6: 1}
    assert 0 < T.max_pairs(A, B) < 1_000_000


def brute_audit(rows, min_docs):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    docs = [(lang or "", src or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(t))) for t, lang, src in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = collections.Counter(t for x, _, ts in docs if x == lang for t in set(ts))
        kept = {t for t, n in df.items() if n >= min_docs}
        count = {s: collections.Counter() for x, s, _ in docs if x == lang}
        for x, s, ts in docs:
            if x == lang:
                count[s].update(t for t in ts if t in kept)
        whole = sum(count.values(), collections.Counter())

        def weight(c, t):
            return 1 + (10**9 * (c[t] + 5)) // (sum(c.values()) + 5 * len(kept))

        for s, c in count.items():
            pair = [(o, sum(abs(weight(c, t) - weight(count[o], t)) for t in kept)) for o in count if o != s]
            term = [(t, weight(c, t) - weight(whole, t)) for t in kept if c[t] > 0 and weight(c, t) > weight(whole, t)]
            for part, found, most in (("pair", pair, None), ("term", term, 50)):
                found.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def audit_fixture():
    rnd = random.Random(11)
    words = ["Éa", "b", "中文", "don't", "C3PO", "ÄB", "x" * 40] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    rows = []
    for i in range(150):
        weights = [1 + (k * (i % 5 + 1)) % 7 for k in range(len(words))]
        text = " ".join(rnd.choices(words, weights, k=rnd.randrange(0, 40)))
        rows.append((text, rnd.choice(["en", "en", "en", "de", None]), rnd.choice(["hot", "hot", "hot", "s1", "s2", "é", None])))
    return rows + [(None, "fr", "s1"), ("", "fr", "s2"), ("once", "en", "lonely"), (" 12 \x00 . ", "en", "blank"), rows[0], rows[0]]


def test_audit_equals_brute_force_and_sql(spark, monkeypatch):
    rows = audit_fixture()
    docs = spark.createDataFrame([(i, *r, "q") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string")
    for block, table, chunk in ((50, 7, 16), (10**6, 10**6, 1 << 20)):  # many blocks and many parts of texts, then one
        monkeypatch.setattr(S, "BLOCK_POSTINGS", block)
        monkeypatch.setattr(S, "TABLE_ENTRIES", table)
        monkeypatch.setattr(S, "CHUNK", chunk)
        for least in (30, 3):
            assert sorted(map(tuple, S.audit_rows(docs, min_docs=least).collect())) == brute_audit(rows, least)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(con.execute(S.ORACLE_SQL).fetchall()) == brute_audit(rows, 30)
    assert S.audit_rows(docs.limit(0)).collect() == []


def test_text_terms_in_parts(monkeypatch):
    text = ("Ab  cD1e é中 " + "y" * 50 + " z").encode()
    whole = [t for part in S.text_terms(text) for t in part]
    for chunk in range(1, 30):
        monkeypatch.setattr(S, "CHUNK", chunk)
        assert [t for part in S.text_terms(text) for t in part] == whole
