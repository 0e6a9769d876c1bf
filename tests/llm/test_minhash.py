import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from helpers import LONG, ODD, docs

from docparity.llm import minhash as mh

M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    out = {}
    for x in parent:
        out.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in out.values()}


def mix(h):
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & M64
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & M64
    return h ^ h >> 33


def word_hash(word):
    raw = word.encode()
    h = mix(len(raw) + 0x9E3779B97F4A7C15 & M64)
    for i in range(0, len(raw), 8):
        h = mix(h ^ int.from_bytes(raw[i : i + 8].ljust(8, b"\0"), "little"))
    return h


def signature(text):
    """The signature by its definition, one shingle and coordinate at a time."""
    words = [word_hash(w) for w in (text or "").lower().split()]
    if not words:
        return None
    rolled = [mix(a + b * 3 & M64) for a, b in zip(words, words[1:])] if len(words) > 1 else [words[0] * 3 & M64]
    out = []
    for seed, mult in zip(mh._SEEDS.tolist(), mh._MULTS.tolist()):
        best = M32
        for x in {mix(r) >> 32 for r in rolled}:
            y = (x ^ seed) * mult & M32
            y ^= y >> 16
            best = min(best, y * 0x85EBCA6B & M32)
        out.append(best)
    return tuple(out)


def brute(texts, similarity=mh.SIMILARITY):
    """Agreeing coordinates of all linked pairs of places in ``texts``, signatures by :func:`signature`."""
    known = {}
    sig = [known[t] if t in known else known.setdefault(t, signature(t)) for _, t in texts]
    least = similarity * mh.K
    return {(i, j): n for (i, a), (j, b) in combinations(enumerate(sig), 2) if a and b and (n := sum(map(int.__eq__, a, b))) >= least}


def expected(texts):
    """Rows of ``near_duplicates`` by brute force."""
    links = brute(texts)
    n = Counter(i for p in links for i in p)
    named = {i: min((texts[j][0] for j in g if texts[j][0] is not None), default=None) for g in groups(links) for i in g}
    return Counter((d, named.get(i, d), n[i]) for i, (d, _) in enumerate(texts))


def rows(df):
    return Counter((r["doc_id"], r["class_id"], r["links"]) for r in df.collect())


def corpus(seed, n=250):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    base = [rng.choices(words, k=rng.randrange(3, 120)) for _ in range(n // 5)]
    out = []
    for i in range(n):
        t = list(rng.choice(base)) if rng.random() < 0.7 else rng.choices(words, k=80) + passage
        for _ in range(rng.choice([0, 0, 1, 3, 10])):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append((i, " ".join(t)))
    return out


def test_signatures():
    texts = [*(t for _, t in corpus(4, 20)), "one", "Two WORDS", "", None, "  \n", "ein längeres Wort größer als acht Bytes", "x y"]
    sig, n = mh.signatures(pa.array(texts, pa.string()))
    assert [tuple(s) if k else None for s, k in zip(sig.tolist(), n)] == [signature(t) for t in texts]


@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(spark, seed):
    texts = corpus(seed)
    assert rows(mh.near_duplicates(docs(spark, texts))) == expected(texts)


def test_every_pair_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(mh, "BLOCK", 16)
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = [(i, " ".join(base[:60] + [f"own{i}"] + base[60:])) for i in range(100)]
    got = {(r["doc_a"], r["doc_b"]): round(r["similarity"] * mh.K) for r in mh.near_duplicate_pairs(docs(spark, texts)).collect()}
    first = {b: a for (a, b), n in got.items() if n == mh.K}
    whole = {(i, j): got[min(a, b), max(a, b)] if a != b else mh.K for i, j in combinations(range(100), 2) for a, b in [(first.get(i, i), first.get(j, j))]}
    assert len(whole) == 4950 and whole == brute(texts)
    assert rows(mh.near_duplicates(docs(spark, texts))) == Counter((i, 0, 99) for i in range(100))


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(mh, "BLOCK", 3)
    texts = corpus(9, 150)
    assert rows(mh.near_duplicates(docs(spark, texts))) == expected(texts)


def test_pairs_name_each_copy_once(spark):
    texts = [(i, "the very same text for all of them") for i in range(500)] + [(1000 + i, f"text number {i} has words q{i} r{i} s{i} of its own") for i in range(50)]
    assert mh.near_duplicate_pairs(docs(spark, texts)).count() == 499
    got = rows(mh.near_duplicates(docs(spark, texts)))
    assert all(got[i, 0, 499] == 1 for i in range(500)) and all(got[1000 + i, 1000 + i, 0] == 1 for i in range(50))


def test_signature_estimates_similarity():
    a = [f"a{i}" for i in range(2000)]
    b = a[:1500] + [f"b{i}" for i in range(500)]
    sig, _ = mh.signatures(pa.array([" ".join(a), " ".join(b)]), k=mh.K)
    assert abs((sig[0] == sig[1]).mean() - 1500 / 2500) < 0.2


def test_odd_rows(spark):
    texts = [*ODD, (8, LONG), (9, "short  TEXT."), (10, "short"), (11, "short"), (None, "short")]
    assert rows(mh.near_duplicates(docs(spark, texts))) == expected(texts)
    assert rows(mh.near_duplicates(docs(spark, [(None, "a b"), (None, "a b"), (None, None)]))) == Counter({(None, None, 1): 2, (None, None, 0): 1})
    assert mh.near_duplicates(docs(spark, [])).collect() == [] and mh.near_duplicate_pairs(docs(spark, [])).collect() == []


@pytest.mark.parametrize("most", [mh.BROADCAST_GONE, 0])
def test_dropped(spark, monkeypatch, most):
    monkeypatch.setattr(mh, "BROADCAST_GONE", most)
    key = lambda xs: sorted(((r[0], r[1]) for r in xs), key=str)
    given = docs(spark, [*ODD, (8, LONG), (9, "short  TEXT."), (5, "another text altogether"), (None, "a text without number.")])
    out = mh.near_duplicates_dropped(given)
    assert out.columns == given.columns
    gone = [(8, LONG), (9, "short  TEXT.")]
    left = key(out.select("doc_id", "text").collect())
    # of the two rows without doc_id that differ in case the one with the less hash stays
    assert [x for x in left if x[1] is None or x[1].lower() != "a text without number."] == key([*(x for x in ODD if x[1] != "A text without number."), (5, "another text altogether")])
    assert sum(x[1] is not None and x[1].lower() == "a text without number." for x in left) == 1 and not set(gone) & set(left)
    clash = spark.createDataFrame([(1, "a b c", 1, 2), (2, "a b c", 2, 2)], "doc_id long, text string, __dp_id long, __DP_h long")
    assert [r["doc_id"] for r in mh.near_duplicates_dropped(clash).collect()] == [1]


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_edges(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]
    got = {}
    for r in mh.components(spark.createDataFrame(edges, "doc_a long, doc_b long")).collect():
        got.setdefault(r["group_id"], set()).add(r["doc_id"])
    assert {frozenset(g) for g in got.values()} == {g for g in groups(edges) if len(g) > 1} and all(k == min(g) for k, g in got.items())


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "doc_a long, doc_b long")
    assert {r["group_id"] for r in mh.components(edges).collect()} == {0} and mh.components(edges).count() == 61


def test_collisions():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3, (50, mh.K)).astype(np.uint32), rng.integers(0, 3, (70, mh.K)).astype(np.uint32)
    assert (mh._collisions(a, b) == (a[:, None] == b[None]).sum(-1)).all()
