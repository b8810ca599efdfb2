import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.llm import quality, texts, trees

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SIGNS = st.text(st.sampled_from("aAbé中😀 \t\n\r\v\f#*|<0!.  "), max_size=60)


def spans(found, data):
    return [data[a:b].tobytes().decode() for a, b in zip(found.starts, found.ends, strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), SIGNS), max_size=8), st.integers(1, 40))
def test_words_and_lines_of_blocks(held, size):
    words, lines = [], []
    for first, last, data, offsets in texts.text_blocks(pa.array(held, pa.string()), size):
        found, split = texts.words(data, offsets), texts.lines(data, offsets)
        all_words, all_lines = spans(found, data), spans(split, data)
        for i in range(last - first):
            words.append(all_words[found.bounds[i] : found.bounds[i + 1]])
            lines.append(all_lines[split.bounds[i] : split.bounds[i + 1]])
        for hashed, said in ((found.hashes, all_words), (split.hashes, all_lines)):
            assert len({(h, s) for h, s in zip(hashed.tolist(), said, strict=True)}) == len(set(said))
    assert words == [WORD.findall(t or "") for t in held]
    assert lines == [(t or "").split("\n") for t in held]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abA"), max_size=12), min_size=1, max_size=5), st.integers(1, 5))
def test_windows_stay_in_documents(documents, n):
    _, _, data, offsets = next(texts.text_blocks(pa.array([" ".join(d) for d in documents])))
    found = texts.words(data, offsets, lower=True)
    first, hashed = texts.windows(found, n)
    want = [tuple(w.lower() for w in d[i : i + n]) for d in documents for i in range(len(d) - n + 1)]
    assert len(first) == len(want)
    assert len(set(zip(hashed.tolist(), want, strict=True))) == len(set(want)) == len(set(hashed.tolist()))


@settings(max_examples=150, deadline=None)
@given(st.lists(SIGNS, min_size=1, max_size=5))
def test_statistics_by_brute_force(held):
    _, _, data, offsets = next(texts.text_blocks(pa.array(held)))
    got = quality._statistics(data, offsets)
    for row, text in zip(got.tolist(), held, strict=True):
        counts = dict(zip(quality.COUNTS, row, strict=True))
        words, seen, again = WORD.findall(text), set(), 0
        full = [line for line in text.split("\n") if WORD.search(line)]
        for line in full:
            again += line in seen
            seen.add(line)
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
        assert counts["n_words"] == len(words)
        assert counts["word_chars"] == sum(map(len, words))
        assert counts["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert counts["n_dup_lines"] == again
        assert counts["n_repeat_words"] == len(covered)
        assert counts["n_lines"] == len(full)
        assert counts["n_distinct"] == len(set(words))


def test_trees_learn_and_keep_to_their_directions():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.2 * rng.standard_normal(3000)) > 0.5).astype(float)
    forest = trees.fit(x, y, [1, 0, -1])
    fresh = rng.random((500, 3))
    truth = (fresh[:, 0] + 0.3 * np.sin(9 * fresh[:, 1])) > 0.5
    assert ((forest.probability(fresh) > 0.5) == truth).mean() > 0.85
    grid = np.linspace(0, 1, 80)
    for point in fresh[:40]:
        for f, way in ((0, 1), (2, -1)):
            line = np.repeat(point[None], len(grid), 0)
            line[:, f] = grid
            assert (way * np.diff(forest.margin(line)) >= -1e-12).all()


def test_flat_nodes_score_as_a_walk_does():
    rng = np.random.default_rng(5)
    x = rng.random((400, 4))
    forest = trees.fit(x, (x.sum(1) > 2).astype(float), [0, 0, 0, 0], trees=7)

    def walk(row):
        total = forest.base
        for at in forest.roots:
            while forest.feature[at] >= 0:
                down = row[forest.feature[at]] <= forest.threshold[at]
                at = forest.left[at] if down else forest.right[at]
            total += forest.value[at]
        return total

    assert np.allclose(forest.margin(x), [walk(r) for r in x])


def test_one_class_gives_no_trees():
    assert len(trees.fit(np.ones((5, 2)), np.ones(5), [0, 0]).roots) == 0
