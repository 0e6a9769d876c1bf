import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import ODD, docs

from docparity.llm import ngram_lm as lm
from docparity.llm.elias_fano import EliasFano, pack_bits, unpack_bits


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000, 5000])
@pytest.mark.parametrize("top", [1, 5, 1000, 10**12])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n))
    seq = EliasFano(EliasFano.build(values))
    assert len(seq) == n and (seq.get(np.arange(n)) == values).all()
    keys = rng.integers(0, top + 1, 50)
    found = seq.successor(keys, np.zeros(50, np.int64), np.full(50, n))
    assert (found == np.searchsorted(values, keys)).all()


def test_bits():
    v = np.array([5, 0, 7, 1, 3])
    assert (unpack_bits(pack_bits(v, 3), np.arange(5), 3) == v).all()


class Slow:
    """Interpolated Kneser-Ney by dictionaries."""

    def __init__(self, texts):
        n = lm.ORDER
        counts = {n: Counter()}
        for t in texts:
            if t:
                s = [lm.EDGE] * (n - 1) + list(t.encode()) + [lm.EDGE]
                counts[n].update(tuple(s[i - n + 1 : i + 1]) for i in range(n - 1, len(s)))
        for k in range(n - 1, 0, -1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        self.counts, self.total, self.kinds, self.d = counts, {}, {}, {}
        for k, c in counts.items():
            ones, twos = (sum(1 for x in c.values() if x == m) for m in (1, 2))
            self.d[k] = ones / (ones + 2 * twos) if ones else 0.5
            self.total[k], self.kinds[k] = defaultdict(int), defaultdict(int)
            for g, x in c.items():
                self.total[k][g[:-1]] += x
                self.kinds[k][g[:-1]] += 1

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / lm.SYMBOLS
        h = gram[:-1]
        if not self.total[k].get(h):
            return self.p(gram[1:])
        return max(self.counts[k].get(gram, 0) - self.d[k], 0) / self.total[k][h] + self.d[k] * self.kinds[k][h] / self.total[k][h] * self.p(gram[1:])

    def score(self, text):
        s = [lm.EDGE] * (lm.ORDER - 1) + list(text.encode()) + [lm.EDGE]
        return sum(math.log10(self.p(tuple(s[i - lm.ORDER + 1 : i + 1]))) for i in range(lm.ORDER - 1, len(s)))


def texts(seed, n=60):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(["the", "cat", "sat", "on", "ä", "mat", "日本", "dog"], k=rng.randrange(1, 25)))) for i in range(n)]


def test_against_brute_force(spark):
    given = texts(1)
    slow = Slow([t for _, t in given])
    meta = lm.train(docs(spark, given))
    other = [*given, (100, "zebra quits 123"), (101, "the catalogue"), (102, "é")]
    for r in lm.score(docs(spark, other), meta).collect():
        text = dict(other)[r["doc_id"]]
        assert r["n_symbols"] == len(text.encode()) + 1
        # a probability is off by at most half a step of its level, and the weights of a few back-offs with it
        assert r["log10_prob"] == pytest.approx(slow.score(text), abs=0.03 * r["n_symbols"] + 0.05)
        assert r["perplexity"] == pytest.approx(10 ** (-r["log10_prob"] / r["n_symbols"]))


def test_probabilities_are_exact_before_quantising(spark):
    given = texts(2, 20)
    slow = Slow([t for _, t in given])
    tables, _ = lm.probabilities(docs(spark, given))
    for n, table in tables.items():
        for r in table.where("p is not null").collect():
            gram = tuple(r["code"] >> (lm.BITS * (n - 1 - i)) & 511 for i in range(n))
            assert r["p"] == pytest.approx(slow.p(gram), rel=1e-9)


def test_probabilities_add_up():
    slow = Slow(["abab", "abc", "cab"])
    for h in [(97,), (97, 98), (256, 256, 256, 256), (120, 121)]:
        assert sum(slow.p((*h, s)) for s in range(lm.SYMBOLS)) == pytest.approx(1.0)


def test_many_files(spark, monkeypatch):
    given = texts(3, 30)
    one = {r["doc_id"]: r["log10_prob"] for r in lm.score(docs(spark, given), lm.train(docs(spark, given))).collect()}
    monkeypatch.setattr(lm, "SHARD_NODES", 50)
    meta = lm.train(docs(spark, given))
    assert len(set(meta["shard_of"])) > 3
    assert {r["doc_id"]: r["log10_prob"] for r in lm.score(docs(spark, given), meta).collect()} == pytest.approx(one)


def test_odd_rows(spark):
    given = docs(spark, ODD)
    rows = lm.score(given, lm.train(given)).collect()
    assert sorted(((r["doc_id"], r["n_symbols"]) for r in rows), key=str) == sorted(((d, len(t.encode()) + 1 if t else 0) for d, t in ODD), key=str)
    assert all((r["log10_prob"] is None) == (r["n_symbols"] == 0) and (r["log10_prob"] or -1) < 0 for r in rows)


def test_model_of_nothing(spark):
    meta = lm.train(docs(spark, [(1, None), (2, "")]))
    row = lm.score(docs(spark, [(1, "ab")]), meta).first()
    assert row["perplexity"] == pytest.approx(lm.SYMBOLS)
    assert lm.score(docs(spark, []), meta).collect() == []
