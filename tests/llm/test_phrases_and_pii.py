import hashlib
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import SF
from rasterloom.checks.harness import run_sql, same
from rasterloom.llm import collocations, pii, queries

PIECES, WORDS = re.compile(r"[.,;:!?\n-\r]"), re.compile(r"[^ \t]+")
LOWER = {a: a + 32 for a in range(65, 91)}
DOCS = "doc_id long, lang string, text string"


def phrases_by_hand(rows, most, least):
    counts, totals = defaultdict(Counter), Counter()
    for _, lang, text in rows:
        for piece in PIECES.split((text or "").translate(LOWER)):
            words = WORDS.findall(piece)
            totals[lang or "und" if lang is None else lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    counts["und" if lang is None else lang][" ".join(words[i : i + k])] += 1
    return {g: {p: n for p, n in c.items() if n >= least} for g, c in counts.items()}, totals


def collocations_by_hand(rows, top, most, least):
    found, totals = phrases_by_hand(rows, most, least)
    out = []
    for lang, held in found.items():
        kept = []
        for phrase, a in held.items():
            words = phrase.split(" ")
            if len(words) < 2:
                continue
            cuts = []
            for k in range(1, len(words)):
                x, y = held[" ".join(words[:k])], held[" ".join(words[k:])]
                cuts.append((1000 * a * totals[lang] // (x * y), k, x, y))
            longer = [b for q, b in held.items() if q != phrase and f" {phrase} " in f" {q} "]
            if not any(100 * b >= 100 * a for b in longer):
                score, _, x, y = min(cuts)
                kept.append((-score, -a, phrase.encode(), phrase, a, x, y, totals[lang], score))
        for i, (*_, phrase, a, x, y, n, score) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, i, phrase, a, x, y, n, score))
    return sorted(out)


def small_corpus():
    rng = np.random.default_rng(3)
    words = ["a", "B", "cc", "Ä", "d-d", "\x0b", "eé", "long" * 30, "\x00", "　"]
    glue = [" ", " ", " ", "\t", "  ", ". ", ",", "\n"]
    rows = []
    for i in range(120):
        n = int(rng.integers(0, 60))
        text = "".join(str(rng.choice(words[: 3 + i % 7])) + str(rng.choice(glue)) for _ in range(n))
        rows.append((i, [None, "en", "de", ""][i % 4], text))
    rows += [(900, "en", None), (901, "en", ""), (902, "fr", None), (None, "en", "a b a b a b"), (3, "en", rows[3][2])]
    rows += [(903, "en", "a a " * 2000)]
    return rows


def test_collocations_against_brute_force(spark):
    rows = small_corpus()
    df = spark.createDataFrame(rows, DOCS).withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(1))
    for top, least, bits, parts in ((2000, 5, 64, 3), (4, 8, 64, 1), (2000, 6, 7, 4), (2000, 300, 64, 2)):
        got = collocations.collocations(df.repartition(parts), top, 5, least, bits).collect()
        assert sorted(map(tuple, got)) == collocations_by_hand(rows, top, 5, least)


def test_phrases_have_counts_and_a_place(spark):
    rows = small_corpus()
    found = collocations.frequent_phrases(spark.createDataFrame(rows, DOCS), 3, 4).collect()
    counts, totals = phrases_by_hand(rows, 3, 4)
    assert {(r["lang"], r["phrase"]): r["n"] for r in found if r["words"]} == {
        (g, p): n for g, c in counts.items() for p, n in c.items()
    }
    assert {r["lang"]: r["n"] for r in found if not r["words"]} == dict(totals)
    texts = defaultdict(list)
    for doc_id, _, text in rows:
        texts[doc_id].append(" ".join(WORDS.findall((text or "").translate(LOWER).replace("\x0b", " "))))
    for r in found:
        if r["words"]:
            assert any(r["phrase"] in t for t in texts[r["doc_id"]])


def test_phrases_of_an_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert collocations.collocations(none).count() == 0
    assert collocations.frequent_phrases(none).count() == 0


def test_colliding_fingerprints_are_told_by_their_words(spark):
    rows = [(i, "en", f"w{i % 50} x{i % 50} y") for i in range(600)]
    df = spark.createDataFrame(rows, DOCS)
    held = [sorted(map(tuple, collocations.collocations(df, 9, 3, 10, bits).collect())) for bits in (64, 5, 1)]
    assert held[0] == held[1] == held[2] == collocations_by_hand(rows, 9, 3, 10)


def test_tasks_get_and_hold_little_at_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, "en", " ".join(f"w{k}" for k in rng.integers(0, 500, 4000))) for i in range(100)]  # 1.9 MB
    rows += [(900, "en", "x y " * (1 << 18))]
    most = 1 << 18
    monkeypatch.setattr(collocations, "BATCH", most)

    def limited(made):
        def with_limit(*given):
            run = made(*given)

            def checked(batches):
                for batch in batches:
                    # the row that passes the limit is the last
                    assert batch.nbytes - len(batch.column("text")[-1].as_py()) < 1.1 * most, len(batch)
                    yield from run(iter([batch]))

            return checked

        return with_limit

    for name in ("_counted", "_materialised", "_differing"):
        monkeypatch.setattr(collocations, name, limited(getattr(collocations, name)))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.createDataFrame(rows, DOCS).coalesce(1)
    found = {r["phrase"]: r["n"] for r in collocations.frequent_phrases(df, 2, 100).collect()}
    assert found["x y"] == 1 << 18 and found["y x"] == (1 << 18) - 1 and found[""] == 100 * 4000 + (1 << 19)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_counting_holds_few_arrays():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 10**6, 4000)) for _ in range(300)]
    columns = {"doc_id": pa.array(range(300)), "lang": pa.array(["en"] * 300), "text": pa.array(texts)}
    batch, peaks = pa.RecordBatch.from_pydict(columns), []
    tracemalloc.start()
    counts = 0
    for sent in collocations._counted(range(1, 3), None, 0, 64)(iter([batch])):
        counts += sum(sent.column("n").to_pylist())
        peaks.append(tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert counts == 300 * (4000 + 3999)
    assert max(peaks) < 100e6, max(peaks)


def test_op11_equals_sql(spark):
    got = queries.op11_collocations(spark, SF).toPandas()
    assert same(got, run_sql(queries.oracles()["op11_collocations"], SF)) == ""


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_hand(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                odd = [int(d) for d in digits[::-1]]
                total = sum(odd[0::2]) + sum(sum(divmod(2 * d, 10)) for d in odd[1::2])
                if not 16 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            found.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(found)


def test_base_spans_against_plain_patterns():
    rng = np.random.default_rng(8)
    signs = list("aZ0195.@@+- ()_%é:4242") + ["1.2.3.4", "a@b.co", "+1 (488) 555-2485", "4242424242424242", "255.255"]
    for _ in range(4000):
        text = "".join(rng.choice(signs, rng.integers(0, 40)))
        got = ",".join(f"{k}:{a}:{b}" for k, a, b in pii.base_spans(text))
        assert got == base_by_hand(text), text


def test_base_spans_of_very_long_texts():
    for text in ("a" * 2 * 10**5, "1" * 2 * 10**5, "1 " * 2 * 10**5, "@" * 2 * 10**5, "+" * 2 * 10**5, "+1" + " " * 2 * 10**5, "1." * 2 * 10**5, "a@" * 2 * 10**5):
        pii.candidate_spans(text, pii.base_spans(text))


def spoken(i, number):
    return f"name{i} said please call my mobile {number} today thanks{i % 9}"


def test_patterns_learned_from_seeds_find_unseen_numbers(spark):
    rows = [(i, spoken(i, f"+1 (212) 555-{1000 + i}")) for i in range(12)]
    rows += [(100 + i, spoken(i, f"0171 555 {2000 + i}")) for i in range(3)]
    rows += [(200, "elsewhere stands 0171 555 2001 again"), (201, "write to jane [at] mail [dot] org soon")]
    rows += [(202, "order number 0171 555 9999 shipped"), (203, "jane@mail.org"), (204, None), (205, ""), (100, rows[12][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("clash")).withColumn("uid", F.lit(1))
    found = pii.find(df.repartition(3), ["doc_id", "kind", "uid"])
    got = {}
    for r in found.collect():
        text = dict(rows)[r["doc_id"]] or ""
        got.setdefault(r["doc_id"], []).append(([(s["kind"], text[s["start"] : s["end"]]) for s in r["added"]], r["kind"], r["uid"]))
    assert len(got[100]) == 2 and got[100][0] == got[100][1]
    for i in range(3):
        assert got[100 + i][0] == ([("phone", f"0171 555 {2000 + i}")], "clash", 1)
    assert got[200][0][0] == [("phone", "0171 555 2001")]  # a value that is known stands for itself
    assert got[201][0][0] == [("email", "jane [at] mail [dot] org")]
    assert got[202][0][0] == [] and got[204][0][0] == [] and got[205][0][0] == []
    assert all(not found for i in range(12) for found, *_ in got[i])
    patterns, _ = pii.bootstrapped(pii.scanned(df, ["doc_id"]).select(F.inline("seen")))
    assert {r["pattern"] for r in patterns.collect()} >= {"my mobile _", "mobile _ today"}


def test_mixed_contexts_are_no_patterns(spark):
    rows = [(i, f"the value is {v} here") for i, v in enumerate(
        [f"+1 212 555 {k}" for k in range(1000, 1010)] + [f"10.0.0.{k}" for k in range(10)] + ["555 1234567"]
    )]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    assert found.where(F.size("added") > 0).count() == 0


def test_op12_columns(spark):
    got = {r["doc_id"]: r for r in queries.op12_pii(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        base = base_by_hand(text)
        assert got[doc_id]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert got[doc_id]["n_added"] or got[doc_id]["spans"] == base
        for kind in PLAIN:
            assert got[doc_id][f"n_{kind}"] == sum(s.startswith(kind) for s in base.split(","))


def test_pii_of_an_empty_table(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0
