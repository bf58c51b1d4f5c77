"""Byte-level BPE by a transducer against the library, and the UTF-8 machine against Python's decoder."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from loregrid.llm import byte_bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
OWN = [None, "", " ", "the", "  two  blanks ", "<|endoftext|> it's  1234 été 中文字😀\n\n x", "a" * 5000, "ab" * 4000, "zqx" * 3000]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_equals_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op13_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_any_table(spark, library):
    docs = spark.createDataFrame([(i % 7, t, "x", 1) for i, t in enumerate(OWN + OWN[4:6])], "doc_id int, text string, ids string, c0 int")
    encoded = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    want = sorted((i % 7, library.encode_ordinary(t or "")) for i, t in enumerate(OWN + OWN[4:6]))
    assert sorted((r.doc_id, r.ids) for r in encoded.collect()) == want
    assert sorted((r.doc_id, r.text) for r in byte_bpe.decode(encoded, PATH).collect()) == sorted((i % 7, t or "") for i, t in enumerate(OWN + OWN[4:6]))
    assert byte_bpe.digests(byte_bpe.encode(docs.filter("false"), PATH, public_tokenizers.PATTERN), PATH).collect() == []
    other = spark.createDataFrame([("k", "the", 2)], "`a.b` string, `text` string, id int")
    assert [tuple(r)[0] for r in byte_bpe.encode(other, PATH, public_tokenizers.PATTERN, id_col="a.b").collect()] == ["k"]


def test_unknown_ids_and_halves_of_characters(spark):
    token = byte_bpe.load_ranks(PATH)
    euro = spark.createDataFrame([(1, [token[b"\xe2"], token[b"\x82"]]), (2, [token[b"\xe2"], token[b"\x82"], token[b"\xac"]])], "doc_id long, ids array<int>")
    assert {r.doc_id: (r.text, r.broken) for r in byte_bpe.decode(euro, PATH).collect()} == {1: ("�", 1), 2: ("€", 0)}
    with pytest.raises(Exception, match="no token has the id"):
        byte_bpe.decode(euro.select("doc_id", F.array(F.lit(10**6)).alias("ids")), PATH).collect()


def test_fuzzed_texts(ranks, library):
    rng, parts = random.Random(7), ["a", "e", " ", "  ", "th", "ing", "\n", "é", "中", "0", "12", "'s", "'", "aaaa", "--", "　", "ह", "😀", "́"]
    matches = byte_bpe.Matches(byte_bpe.Transducer(ranks, states=500), public_tokenizers.PATTERN, most=200)  # both start anew many times
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 50)))
        assert list(matches.ids(text)) == library.encode_ordinary(text)


def test_every_character(ranks, library):
    matches = byte_bpe.Matches(byte_bpe.Transducer(ranks), public_tokenizers.PATTERN)
    for low in range(0, 0x110000, 64):
        text = "".join(f"a{chr(c)}b 1{chr(c)}  {chr(c)}" for c in range(low, low + 64) if not 0xD800 <= c < 0xE000)
        assert list(matches.ids(text)) == library.encode_ordinary(text), hex(low)


def test_small_vocabularies_against_plain_merging():
    """Random merges: also tokens that no merge reaches and tokens that rank before their parts."""
    rng = random.Random(5)
    for trial in range(60):
        tokens = [bytes([b]) for b in range(256)]
        pool = [b"a", b"b", b"c"]
        for _ in range(rng.randint(3, 14)):
            new = rng.choice(pool) + rng.choice(pool)
            if new not in tokens and len(new) < 9:
                tokens.append(new)
                pool.append(new)
        if trial % 2:
            tail = tokens[256:]
            rng.shuffle(tail)
            tokens[256:] = tail
        ranks = {t: i for i, t in enumerate(tokens)}
        library = tiktoken.Encoding("small", pat_str=r"[a-c]+|[^a-c]+", mergeable_ranks=ranks, special_tokens={})
        transducer = byte_bpe.Transducer(ranks)
        for _ in range(40):
            text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 24)))
            assert list(transducer.encode(text.encode())) == library.encode_ordinary(text), (trial, text, tokens[256:])


def test_long_matches_are_emitted_on_the_way(ranks, library):
    transducer, rng = byte_bpe.Transducer(ranks), random.Random(3)
    for text in ("".join(rng.choice("abcdefgh") for _ in range(20000)), "中文" * 5000, "-=" * 9000):
        parts = list(transducer.stream(text.encode()))
        assert len(parts) > 10 and [x for p in parts for x in p] == library.encode_ordinary(text)


def test_utf8_machine():
    rng, some = random.Random(2), [0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF, 0xF4, 0x90, 0xC0]
    for _ in range(5000):
        data = bytes(rng.choice(some) for _ in range(rng.randint(0, 12)))
        machine, cuts = byte_bpe.Utf8Machine(), sorted(rng.randint(0, len(data)) for _ in range(3))
        parts = [machine.feed(data[a:b]) for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
        assert "".join([*parts, machine.end()]) == data.decode("utf-8", "replace")
