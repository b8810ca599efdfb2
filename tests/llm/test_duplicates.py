import itertools
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.llm import components, jaccard, linededup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def dedup(spark, rows, min_words):
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("at", F.lit("clash"))
    got = linededup.dedup_lines(df, ["doc_id", "at"], min_words).collect()
    assert {r["at"] for r in got} <= {"clash"}
    return sorted([(r["doc_id"], r["text"], r["n_lines"], r["n_deleted"]) for r in got], key=repr), got


def test_a_passage_is_kept_once_and_clean_text_left_alone(spark):
    passage = "\n".join(" ".join(f"p{i}w{j}" for j in range(20)) for i in range(4))
    short = "a line that many share"
    rows = [(i, f"{short}\nonly {i} here\n{passage}\nand the end of {i}") for i in range(300)]
    got, full = dedup(spark, rows, 30)
    assert [g[3] for g in sorted(got)] == [0] + [4] * 299
    assert all(short in g[1] for g in got)
    assert all(r["runs"][0].asDict() == {"first": 2, "last": 5} for r in full if r["doc_id"])


def test_repeated_rows_leave_one(spark):
    text = " ".join(f"w{i}" for i in range(40))
    got, _ = dedup(spark, [(7, text)] * 50 + [(None, "x")], 30)
    assert sorted(g[3] for g in got) == [0, 0] + [1] * 49
    assert dedup(spark, [], 30)[0] == []


def whole_runs_by_hand(rows, min_words):
    """Every earlier place with the same line is followed on as far as lines are the same."""
    texts = [(t or "").split("\n") for _, t in rows]
    full = [[i for i, line in enumerate(lines) if WORD.search(line)] for lines in texts]
    spots = [(k, a) for k in range(len(rows)) for a in range(len(full[k]))]
    gone = defaultdict(set)
    for n, (k, a) in enumerate(spots):
        for j, b in spots[:n]:
            size = words = 0
            while a + size < len(full[k]) and b + size < len(full[j]):
                line = texts[k][full[k][a + size]]
                if line != texts[j][full[j][b + size]]:
                    break
                words, size = words + len(WORD.findall(line)), size + 1
            if words >= min_words:
                gone[k].update(full[k][a : a + size])
    for k, at in enumerate(full):
        for i, j in itertools.pairwise(at):
            if {i, j} <= gone[k]:
                gone[k].update(range(i, j))
    return [sorted(gone[k]) for k in range(len(rows))]


def test_lines_against_brute_force(spark):
    rng = np.random.default_rng(5)
    lines = ["a b", "c", "d e f", "", " ", "g", "h i j k l m", "n"]
    rows = [(i, "\n".join(rng.choice(lines, rng.integers(0, 14)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, rows[5][1]), (64, rows[5][1])]
    for min_words in (1, 4, 9):
        got, full = dedup(spark, rows, min_words)
        runs = {r["doc_id"]: [i for s in r["runs"] for i in range(s["first"], s["last"] + 1)] for r in full}
        gone = whole_runs_by_hand(rows, min_words)
        assert [runs[k] for k, _ in rows] == gone
        for (k, text), own in zip(rows, gone, strict=True):
            left = "\n".join(t for i, t in enumerate((text or "").split("\n")) if i not in own)
            assert (k, left if own or text is not None else None, len((text or "").split("\n")), len(own)) in got


def test_many_runs_in_one_document(spark):
    part = [" ".join(f"r{i}w{j}" for j in range(30)) for i in range(3000)]
    long = "\n".join(line for i, p in enumerate(part) for line in (f"own {i}", p))
    rows = [(1, "\n".join(part)), (2, long)]
    _, full = dedup(spark, rows, 30)
    assert {r["doc_id"]: len(r["runs"]) for r in full} == {1: 0, 2: 3000}
    assert next(r["text"] for r in full if r["doc_id"] == 2) == "\n".join(f"own {i}" for i in range(3000))


def test_the_last_lines_of_a_passage_go_too(spark):
    for sizes in ((40, 15), (12, 12, 12, 12, 3)):
        passage = "\n".join(" ".join(f"p{i}w{j}" for j in range(n)) for i, n in enumerate(sizes))
        rows = [(i, f"only {i} here\n{passage}\nand the end of {i}") for i in range(3)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = linededup.dedup_lines(df, ["doc_id"], 30).orderBy("doc_id").collect()
        assert [r["n_deleted"] for r in got] == [0, len(sizes), len(sizes)]
        assert got[2]["text"] == "only 2 here\nand the end of 2"


def shingle_set(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def components_by_hand(rows, n, percent):
    sets, parent = [shingle_set(t, n) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = doc_id if least[root(i)] is None else min(least[root(i)], doc_id)
    return sorted(((rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows))), key=repr)


def near(spark, rows, n, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("set", F.lit("clash"))
    got = jaccard.near_duplicates(df.repartition(3), n, percent).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr)


def copies(rng, base, count, most):
    for _ in range(count):
        words = list(base)
        for _ in range(rng.integers(0, most + 1)):
            words[rng.integers(len(words))] = f"n{rng.integers(1 << 30)}"
        yield " ".join(words)


def corpus(rng):
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 4000, rng.integers(1, 120))) for _ in range(60)]
    for size in (1, 2, 5, 12, 40, 150, 600):
        base = [f"b{size}x{k}" for k in range(size)]
        texts += copies(rng, base, 40, max(1, size // 25))
        texts += [" ".join(base[: size - size // 8]), " ".join(base).upper()]
    texts += [None, "", " \n", "one", "ONE", "one two", texts[3], texts[3]]
    return [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]


def test_links_against_all_pairs(spark):
    rows = corpus(np.random.default_rng(6))
    for n, percent in ((3, 90), (5, 80)):
        assert near(spark, rows, n, percent) == components_by_hand(rows, n, percent)


def test_tiles_cut_into_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    rng = np.random.default_rng(8)
    base = [f"q{k}" for k in range(200)]
    rows = list(enumerate(copies(rng, base, 150, 9)))
    assert near(spark, rows, 3, 80) == components_by_hand(rows, 3, 80)


def test_no_rows_and_one_text(spark):
    assert near(spark, [], 5, 80) == []
    assert near(spark, [(4, "x y z a b c d")] * 9 + [(2, "x y z a b c d")], 5, 80) == [(2, 3, 2)] + [(4, 3, 2)] * 9


@settings(max_examples=100, deadline=None)
@given(st.data(), st.sampled_from([80, 90, 95]))
def test_linked_sets_share_a_part_and_pass_the_bound(data, percent):
    a = data.draw(st.sets(st.integers(0, 1 << 60), min_size=1, max_size=150))
    b = set(a)
    for x in data.draw(st.lists(st.sampled_from(sorted(a)), max_size=len(a) // 8)):
        b.discard(x)
    b |= data.draw(st.sets(st.integers(1 << 61, 1 << 62), max_size=max(1, len(a) // 10)))
    edges = jaccard.band_edges(1 << 20)
    one, two = (np.array(sorted(s), np.uint64) for s in (a, b))
    if not b or not jaccard.linked(len(a & b), len(a), len(b), percent):
        return
    if a != b:
        parts = [set(jaccard.part_signatures(s, edges, percent).tolist()) for s in (one, two)]
        assert parts[0] & parts[1]
    maps = [jaccard.bitmap(s) for s in (one, two)]
    width = min(map(len, maps))
    x, y = (jaccard.folded([m], width) for m in maps)
    assert jaccard.may_link(x, y, np.array([len(a)]), np.array([len(b)]), percent).all()


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300, 302: 300}
    assert got == want
    assert components.components(df.limit(0)).count() == 0


def test_a_run_over_many_batches():
    rows = pa.RecordBatch.from_pydict(
        {
            "tile": [1] * 6,
            "one": [0] * 6,
            "two": [0] * 6,
            "block": [0] * 6,
            "node": list(range(6)),
            "component": list(range(6)),
            "size": [1] * 6,
            "bits": [jaccard.bitmap(np.array([5], np.uint64))] * 6,
        }
    )
    parts = [rows.slice(i, 1) for i in range(6)]
    whole = [b.to_pydict() for b in jaccard._across(90)(iter([rows]))]
    cut = [b.to_pydict() for b in jaccard._across(90)(iter(parts))]
    pairs = lambda found: {p for b in found for p in zip(b["a"], b["b"], strict=True)}
    assert len(pairs(whole)) == 15 and pairs(whole) == pairs(cut)


def test_rows_without_an_id_and_repeated_ids_keep_their_links(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in rng.integers(0, 10**9, 300)]
    near_copy = " ".join([*words[:150], "other", *words[151:]])
    longer = " ".join([*words, "more"])
    apart = " ".join(f"z{i}" for i in range(40))
    rows = [(5, " ".join(words)), (None, near_copy), (7, longer), (7, apart), (None, apart + " z40"), (None, "quite alone here")]
    got = sorted(near(spark, rows, 3, 90), key=repr)
    want = sorted([(5, 298, 5), (None, 298, 5), (7, 299, 5), (7, 38, 7), (None, 39, 7), (None, 1, None)], key=repr)
    assert got == want
