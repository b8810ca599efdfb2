import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF
from rasterloom.llm import alignment, bpe, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    plain = bpe._plain_bytes()
    pieces = [
        bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
        for i in range(second.get_piece_size())
    ]
    return first, second, plain, pieces


def ends(parts):
    return {int(p): i for i, p in enumerate(np.cumsum([len(x) for x in parts]))}


def by_hand(rows, libraries):
    first, second, plain, pieces = libraries
    counts, held = Counter(), []
    for key, text in rows:
        if not text:
            held.append((key, None))
            continue
        whole = (" " + text).encode()
        ids_a, ids_b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        parts_a = [bytes(plain[c] for c in first.id_to_token(i)) for i in ids_a]
        parts_b = [pieces[i] for i in ids_b]
        if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            held.append((key, None))
            continue
        end_a, end_b = ends(parts_a), ends(parts_b)
        links, groups, a, b = [], [], 0, 0
        for at in sorted(end_a.keys() & end_b.keys()):
            links.append((ids_a[end_a[at]], ids_b[end_b[at]]))
            groups.append(
                ",".join(map(str, ids_a[a : end_a[at] + 1])) + "|" + ",".join(map(str, ids_b[b : end_b[at] + 1]))
            )
            a, b = end_a[at] + 1, end_b[at] + 1
        counts.update(links)
        held.append((key, (len(ids_a), len(ids_b), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for key, found in held:
        if found is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, links, said = found
        best = sum(counts[x] == top[x[1]] for x in links)
        out.append((key, n_a, n_b, len(links), len(links), best, sum(counts[x] for x in links), said))
    return sorted(out, key=repr), counts


def odd_rows():
    rng = np.random.default_rng(5)
    signs = ["the ", "a", "  ", "\n", "é", "日本", "\U0001f600", "1234", " token", "\t", "s", "\x00", "ß", "   "]
    rows = [(i, "".join(rng.choice(signs, rng.integers(1, 40)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " "), (103, "x▁y"), (104, "<|endoftext|> <s> </s>"), (105, "a" * 20_000)]
    return rows + [(None, "the the the"), (5, rows[5][1]), (5, rows[5][1]), (106, "the " * 9_000)]


def test_alignment_against_brute_force(spark, libraries):
    rows = odd_rows()
    want, _ = by_hand(rows, libraries)
    for parts, chunk_docs in ((1, 65_536), (5, 7)):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("clash")).repartition(parts)
        got = alignment.align(df, A, B, ["doc_id", "chunk"], chunk_docs)
        assert got.columns[:2] == ["doc_id", "chunk"]
        assert {r["chunk"] for r in got.collect()} == {"clash"}
        assert sorted((tuple(r) for r in got.drop("chunk").collect()), key=repr) == want


def test_pairs_have_documents_and_links(spark, libraries):
    rows = odd_rows()
    _, counts = by_hand(rows, libraries)
    _, postings = alignment.scanned(spark.createDataFrame(rows, "doc_id long, text string"), A, B, ["doc_id"], 11)
    found = {(r["a"], r["b"]): r for r in alignment.pair_counts(postings).collect()}
    assert {k: r["n_links"] for k, r in found.items()} == dict(counts)
    for r in postings.collect():
        planes = [set(alignment.unpacked(bytes(p)).tolist()) for p in r["planes"]]
        assert r["n_docs"] == len(set().union(*planes))
        assert r["n_links"] == sum(alignment.popcount(bytes(p)) << k for k, p in enumerate(r["planes"]))


def test_bitmaps_come_back():
    rng = np.random.default_rng(2)
    for n in (0, 1, 4_095, 4_096, 60_000, 65_536):
        places = np.sort(rng.permutation(alignment.CHUNK)[:n])
        held = alignment.packed(places)
        assert len(held) <= 8_193 and alignment.popcount(held) == n
        assert np.array_equal(alignment.unpacked(held), places)


def test_alignment_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none, A, B, ["doc_id"]).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in alignment.align(blank, A, B, ["doc_id"]).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_op13_columns(spark, libraries):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_alignment(spark, SF).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(rows, libraries)[0]
