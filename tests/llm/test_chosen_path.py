"""The chosen-path join against all pairs, read literally."""

import itertools
import random

import numpy as np
import pytest

from cohortry.llm import chosen_path

SPACE = " \t\n\x0b\x0c\r"


def literal(docs, percent=80):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text), by all pairs of sets of word pairs."""

    def words(text):
        plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in SPACE else c for c in text or "")
        return [w for w in plain.split(" ") if w]

    sets = [{" ".join(p) for p in itertools.pairwise(w)} or set(w) for w in (words(t) for _, t in docs)]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[root(j)] = root(i)
    low: dict = {}
    for k, (i, _) in enumerate(docs):
        known = [x for x in (low.get(root(k)), i) if x is not None]
        low[root(k)] = min(known, default=None)
    return sorted(map(str, ((i, len(sets[k]), low[root(k)], i == low[root(k)]) for k, (i, _) in enumerate(docs))))


def corpus(n, seed, bases=12, pool=60):
    """Near copies of some texts at all distances around the bound, and others of the same words."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 6))) for _ in range(pool)]
    texts = [[rng.choice(words) for _ in range(rng.randint(30, 120))] for _ in range(bases)]
    out = []
    for _ in range(n):
        text = list(rng.choice(texts))
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 8, 30])):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append(rng.choice([" ", "  ", "\t"]).join(text).title() if rng.random() < 0.3 else " ".join(text))
    return out


@pytest.mark.parametrize(("how", "n"), [({}, 300), ({"small": 25, "pivots": 2, "few": 25}, 300), ({"small": 5, "pivots": 1, "few": 5, "most_levels": 1}, 150)])
def test_components_equal_all_pairs(spark, how, n):
    texts = corpus(n, 1)
    ids = random.Random(2).sample(range(10_000), n)
    docs = list(zip(ids, texts, strict=True))
    table = spark.createDataFrame([(*d, "clash", 0, "clash") for d in docs], "doc_id long, text string, rec string, node int, comp string").repartition(5)
    assert sorted(str(tuple(r)) for r in chosen_path.near_duplicates(table, **how).collect()) == literal(docs)


def test_a_large_group_of_near_copies_is_one(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    docs = []
    for k in range(400):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 6, 14])):
            text[rng.randrange(200)] = f"x{rng.randrange(1000)}"
        docs.append((k, " ".join(text)))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted(str(tuple(r)) for r in chosen_path.near_duplicates(table, small=40, pivots=4).collect()) == literal(docs)


def test_odd_rows(spark):
    texts = [None, "", " \t", "a", "A", "a\x0bb", "a b", "b a", "é", "İstanbul x", "a\x1cb", "x " * 5000, "x " * 4000, "one two three four five six", "one two three four five six seven"]
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, "a"), (None, "lonely words"), (3, "a"), (3, "other text"), (None, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in chosen_path.near_duplicates(table).collect()) == literal(docs)
    assert chosen_path.near_duplicates(table.limit(0)).count() == 0


def test_sizes_on_the_bound_are_linked(spark):
    """Four of five shared shingles are 0.8 exactly."""
    docs = [(1, "a b c d e f"), (2, "a b c d e"), (3, "q r s t u v w"), (4, "q r s t u")]
    got = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), trees=8).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_tokens_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(4)
    agree = []
    for _ in range(50):
        x = rng.integers(0, 1 << 63, 180, np.uint64)
        a, b = (np.frombuffer(chosen_path.tokens_of(s), np.uint8)[: chosen_path.SKETCH] for s in (x[:160], x[20:]))
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - 140 / 180) < 0.03


def test_shared_hashes_are_counted_alike():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, 30, np.uint64) if k % 2 else rng.integers(0, 4_000, 300, np.uint64)) for k in range(120)]
    x, y = np.triu_indices(120, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y)]
    assert chosen_path._shared(sets, x, y).tolist() == want and chosen_path._shared(sets, y[:3], x[:3]).tolist() == want[:3]
