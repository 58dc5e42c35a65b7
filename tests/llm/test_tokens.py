import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from checkup.llm import byte_bpe
from checkup.llm.chunk_tokenizer import ChunkEncoder, load_tokenizer
from checkup.llm.packing import BestFit, pack, pack_documents, token_pieces
from checkup.llm.token_counts import count_tokens, read_cache, tokenizer_version
from tests.llm.helpers import docs_of

BITS = ["a", "B", "é", "e\u0301", " ", "  ", "\n", ".", "<|endoftext|>", "'s", "'re", "'l", "'", "1", "½", "\t",
        "\u00a0", "\x1c", "İ", "ß", "中", " foo", "!!!", "\r\n", "😀", "_"]


def texts(n=400, seed=5):
    rnd = random.Random(seed)
    out = ["".join(rnd.choice(BITS) for _ in range(rnd.randrange(0, 40))) for _ in range(n)]
    return out + [None, "", "a" * 9000, "ab" * 4000 + " c", "word " * 3000, out[0]]


@pytest.mark.parametrize("name,mode", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_memo_equals_library(name, mode):
    lib, some = Tokenizer.from_file(P.path(name)), [t or "" for t in texts(1500)]
    memo = ChunkEncoder(load_tokenizer(P.path(name)), mode, "ids", max_entries=200)  # so small that it evicts
    got = [np.frombuffer(g, "<u4").tolist() for k in range(0, len(some), 60) for g in memo(some[k:k + 60])]
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in some]


@pytest.mark.parametrize("mark_first", [False, True])
def test_word_memo_in_every_order_of_pieces(mark_first):
    """A word alone and before a mark, in both orders, for all letters that the memo takes from the model."""
    path = P.path("word_bpe_49k.json")
    lib, memo = Tokenizer.from_file(path), ChunkEncoder(load_tokenizer(path), "word", "ids")
    words = [w for c in map(chr, range(0x41, 0x180)) if c.isalpha() for w in (c, f"AB{c}D", f"{c}{c.lower()}")] + ["ŞEHRİ"]
    for w in words:
        some = [w + mark for mark in ("", ".", ",", "!", "?", ";", ":")]
        for text in reversed(some) if mark_first else some:
            got = np.frombuffer(memo([text])[0], "<u4").tolist()
            assert got == lib.encode(text, add_special_tokens=False).ids, text


def test_counts_and_cache(spark, workdir):
    path, some, cache = P.path("byte_bpe_50k.json"), texts(), f"{workdir}/cache"
    lib = Tokenizer.from_file(path)
    want = {i: (len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(some)}
    half = docs_of(spark, some).where("doc_id < 200")
    count_tokens(half, path, cache).count()
    before = spark.read.parquet(cache).count()
    rows = count_tokens(docs_of(spark, some), path, cache).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == want and len(rows) == len(some)
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows) and any(r.over_limit for r in rows)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for t in some}) > before
    count_tokens(docs_of(spark, some), path, cache).count()
    assert spark.read.parquet(cache).count() == stored.count()  # nothing is encoded twice
    assert read_cache(spark, cache, "another version").count() == 0 and len(tokenizer_version(path)) == 64
    assert count_tokens(docs_of(spark, []), path, f"{workdir}/empty").collect() == []


def packed_ok(rows, want, capacity):
    spans, seqs = {}, {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, parts in spans.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(parts)):
            assert (piece, start) == (k, at)
            at += length
        assert at == want[doc]
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def test_packing_round_trip(spark):
    some, path = texts(300), P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(some)}
    rows = pack_documents(docs_of(spark, some), path, capacity=64, open_bins=8, rows_per_task=40).collect()
    n = packed_ok(rows, {i: len(x) for i, x in ids.items()}, 64)
    assert n <= 1.15 * sum(map(len, ids.values())) / 64 + 1
    for r in rows:
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32
    assert pack_documents(docs_of(spark, []), path).collect() == []


def test_open_bins_are_bounded_and_the_fullest_closes():
    fit, closed = BestFit(100, 3), []
    for k, size in enumerate([60, 70, 80, 90]):
        closed += fit.place(size, k)
    assert closed == [[3]] and fit.n_open == 3
    assert fit.place(20, "x") == [[2, "x"]]  # best fit fills the 80 up


def test_levels_end_even_when_all_bins_stay_open(spark):
    rows = [(i, 0, 0, 1, 0) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(12)
    out = pack(pieces, capacity=1000, open_bins=4, rows_per_task=100).collect()
    assert packed_ok(out, {i: 1 for i in range(3000)}, 1000) == 3
    assert token_pieces(docs_of(spark, [None]), P.path("word_bpe_49k.json")).first().length == 1


@pytest.fixture(scope="module")
def bpe():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.load_ranks(path)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return path, own, byte_bpe.Codec(ranks, byte_bpe.class_table())


def test_bpe_equals_tiktoken(bpe):
    _, own, codec = bpe
    some = [t or "" for t in texts(3000, 11)] + ["=" * 10001, "é" * 4000, "x1" * 500, "中文" * 900, "'s's 'll'", " 's", "\n't"]
    got = [g for k in range(0, len(some), 64) for g in codec.encode(some[k:k + 64])]
    assert got == [own.encode_ordinary(t) for t in some]
    assert [codec.decode(g).decode() for g in got] == some
    at = codec.offsets(got[0])
    assert at == [len(codec.decode(got[0][:k])) for k in range(len(got[0]))]


def test_bpe_queries(spark, bpe):
    path, own, _ = bpe
    some = texts(120)
    df = docs_of(spark, some)
    encoded = byte_bpe.encode_documents(df, path)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: own.encode_ordinary(t or "") for i, t in enumerate(some)}
    back = {r.doc_id: r.text for r in byte_bpe.decode_documents(encoded, path).collect()}
    assert back == {i: t or "" for i, t in enumerate(some)}
    import hashlib

    for r in byte_bpe.round_trip(df, path).collect():
        ids, t = own.encode_ordinary(some[r.doc_id] or ""), (some[r.doc_id] or "").encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t).hexdigest())
    assert byte_bpe.round_trip(docs_of(spark, []), path).collect() == []


def test_scan_equals_stepping():
    rnd = np.random.default_rng(2)
    s = rnd.integers(0, 7, 5000).astype(np.uint8)
    s[0] += byte_bpe.FIRST
    q, want = byte_bpe.PLAIN, []
    for x in s.tolist():
        want.append(q)
        q = byte_bpe._FLAT[x * byte_bpe.N_STATES + q]
    assert byte_bpe.scan_states(s).tolist() == want


def test_pieces_do_not_depend_on_what_a_worker_remembers(spark, monkeypatch):
    from checkup.llm import packing

    docs = docs_of(spark, [" ".join(f"word{i * j % 97} Other{j}," for j in range(60)) for i in range(30)])
    want = sorted(map(tuple, token_pieces(docs, P.path("word_bpe_49k.json")).collect()))
    monkeypatch.setattr(packing, "MEMO_ENTRIES", 5)
    monkeypatch.setattr(packing, "TEXT_BYTES", 100)
    assert sorted(map(tuple, token_pieces(docs, P.path("word_bpe_49k.json")).collect())) == want
