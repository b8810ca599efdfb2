import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterloom.llm import bpe, counts, texts

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = st.sampled_from(["'", "s", "t", "re", "ll", "ve", " ", "  ", "\n", "\t", "the", "A", "é", "中", "1", "²", "!", " ", "😀", "́", "<|endoftext|>"])


@pytest.fixture(scope="module")
def library():
    with open(MULTI, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows_of(codec, held, size=200):
    out = []
    for first, last, data, offsets in texts.text_blocks(pa.array(held, pa.string()), size):
        ids, parts = codec.encode_block(data, offsets)
        back, places = codec.decode_flat(ids, parts)
        assert np.array_equal(back, data) and np.array_equal(places, offsets)
        out += [ids[parts[i] : parts[i + 1]].tolist() for i in range(last - first)]
    return out


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=25).map("".join), max_size=8))
def test_ids_are_the_librarys(library, held):
    assert rows_of(bpe.codec(MULTI), held) == [library.encode_ordinary(t) for t in held]


def test_every_code_point(library):
    held = [f"a{chr(c)}1{chr(c)}! {chr(c)}" for c in range(1, 0x20000, 3) if not 0xD800 <= c < 0xE000]
    assert rows_of(bpe.codec(MULTI), held, 1 << 20) == [library.encode_ordinary(t) for t in held]


def test_long_matches(library):
    held = ["a" * 5000, "x" + " " * 3000 + "y", "ab" * 700, "the" * 400, "!" * 999, "\n" * 500]
    assert rows_of(bpe.codec(MULTI), held, 1 << 20) == [library.encode_ordinary(t) for t in held]


@settings(max_examples=60, deadline=None)
@given(st.lists(PIECES, max_size=25).map("".join))
def test_json_vocabulary_with_its_special_token(text):
    own = bpe.worker_cache(("test", JSON), lambda: Tokenizer.from_file(JSON))
    assert rows_of(bpe.codec(JSON), [text]) == [own.encode(text, add_special_tokens=False).ids]


def test_hash_collisions_of_pieces_do_no_harm(library, monkeypatch):
    monkeypatch.setattr(texts, "span_hashes", lambda data, starts, ends, table: (ends - starts).astype(np.uint64))
    held = ["the cat sat", "one two six"]
    assert rows_of(bpe.codec(MULTI), held) == [library.encode_ordinary(t) for t in held]


def test_encode_and_decode_tables(spark, library):
    held = [(1, None, 7), (2, "", 7), (2, "", 7), (3, "the cat's 12 hats\n\n x", 8)]
    df = spark.createDataFrame(held, "doc_id long, text string, ids long")
    encoded = bpe.encode(df, MULTI, ["doc_id"])
    got = {r["doc_id"]: r for r in bpe.digests(encoded, MULTI, ["doc_id"]).collect()}
    ids = library.encode_ordinary(held[3][1])
    assert got[3]["n_tokens"] == len(ids)
    assert got[3]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[3]["decoded_sha256"] == hashlib.sha256(held[3][1].encode()).hexdigest()
    assert got[1]["n_tokens"] == 0 and got[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert encoded.count() == 4
    back = {bytes(r["decoded"]) for r in bpe.decode(encoded, MULTI, ["doc_id"]).collect()}
    assert back == {b"", held[3][1].encode()}
    assert bpe.digests(bpe.encode(df.limit(0), MULTI, ["doc_id"]), MULTI, ["doc_id"]).count() == 0


def count(df, cache):
    return counts.count_tokens(df, str(cache), JSON, public_tokenizers.PATTERN, ["doc_id"])


def test_counts_come_from_the_cache(spark, tmp_path):
    own, cache = Tokenizer.from_file(JSON), tmp_path / "cache"
    held = [(1, "one two"), (2, "one two"), (3, None), (4, ""), (5, "x <|endoftext|> y " * 300), (5, " " * 200_000)]
    df = spark.createDataFrame(held, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    want = sorted((i, len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in held)
    got = count(df, cache).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    version = counts.tokenizer_digest(JSON)
    stored = counts.stored_counts(spark, str(cache), version)
    assert stored.count() == 4
    assert counts.stored_counts(spark, str(cache), "other").count() == 0
    more = spark.createDataFrame([(9, "one two"), (10, "three")], "doc_id long, text string")
    count(more, cache).collect()
    assert spark.read.parquet(str(cache)).count() == 5  # only the new text was encoded
    digest = hashlib.sha256(b"four").digest()
    spark.createDataFrame([(digest, 77, version)], counts.SCHEMA).write.mode("append").parquet(str(cache))
    told = count(spark.createDataFrame([(1, "four")], "doc_id long, text string"), cache).collect()
    assert told[0]["n_tokens"] == 77  # a stored count is believed


def test_counts_of_an_empty_table(spark, tmp_path):
    assert count(spark.createDataFrame([], "doc_id long, text string"), tmp_path / "none").count() == 0
