import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, docs

from docparity.llm import queries, word_lm as lm
from docparity.llm.elias_fano import EliasFano, Small


class Slow:
    """Interpolated Kneser-Ney over words by dictionaries."""

    def __init__(self, texts):
        n = lm.ORDER
        self.known = {w for t in texts for w in lm._WORD.findall(t)}
        counts = {n: Counter()}
        for t in texts:
            counts[n].update(self.grams(t))
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

    def grams(self, text):
        s = ["<e>"] * (lm.ORDER - 1) + [w if w in self.known else "<unk>" for w in lm._WORD.findall(text)] + ["<e>"]
        return [tuple(s[i - lm.ORDER + 1 : i + 1]) for i in range(lm.ORDER - 1, len(s))]

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (len(self.known) + 2)
        h = gram[:-1]
        if not self.total[k].get(h):
            return self.p(gram[1:])
        return max(self.counts[k].get(gram, 0) - self.d[k], 0) / self.total[k][h] + self.d[k] * self.kinds[k][h] / self.total[k][h] * self.p(gram[1:])

    def score(self, text):
        return sum(math.log10(self.p(g)) for g in self.grams(text))


def texts(seed, n=60):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(["the", "cat", "sat,", "on", "ä", "mat.", "日本", "dog \n", "(x)"], k=rng.randrange(1, 25)))) for i in range(n)]


@pytest.mark.parametrize("grams", [2_000_000, 40])
def test_against_brute_force(spark, monkeypatch, grams):
    monkeypatch.setattr(lm, "PART_GRAMS", grams)
    given = texts(1)
    slow = Slow([t for _, t in given])
    meta = lm.train(docs(spark, given))
    assert meta["grams"] == [len(slow.counts[n]) for n in range(1, lm.ORDER + 1)] and (meta["parts"] > 3) == (grams == 40)
    other = [*given, (100, "zebra quits 123"), (101, "the catalogue sat, on the cat"), (102, "é"), (103, " \n")]
    for r in lm.score(docs(spark, other), meta).collect():
        text = dict(other)[r["doc_id"]]
        assert r["n_symbols"] == len(lm._WORD.findall(text)) + 1
        assert r["log10_prob"] == pytest.approx(slow.score(text), rel=1e-9)
        assert r["perplexity"] == pytest.approx(10 ** (-r["log10_prob"] / r["n_symbols"]))


def test_order_of_words_counts(spark, tmp_path):
    """What the registered query gathers goes over words: the same words in another order are less likely. Bytes could not tell them apart by a context of four."""
    rng = random.Random(5)
    words = ["alphabets", "blueberry", "chocolate", "dangerous", "elephants", "furniture"]
    rows = [(i, " ".join(words)) for i in range(30)]
    rows += [(100 + i, " ".join(rng.sample(words, len(words)))) for i in range(1)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op9_lm_scoring(spark, str(tmp_path)).collect()}
    assert got[0]["n_symbols"] == len(words) + 1
    assert got[0]["perplexity"] < 0.5 * got[100]["perplexity"]


def test_odd_rows(spark):
    given = docs(spark, ODD)
    rows = lm.score(given, lm.train(given)).collect()
    assert sorted(((r["doc_id"], r["n_symbols"]) for r in rows), key=str) == sorted(((d, len(lm._WORD.findall(t)) + 1 if t else 0) for d, t in ODD), key=str)
    assert all((r["log10_prob"] is None) == (r["n_symbols"] == 0) and (r["log10_prob"] or -1) < 0 for r in rows)


def test_model_of_nothing(spark):
    meta = lm.train(docs(spark, [(1, None), (2, "")]))
    assert lm.score(docs(spark, [(1, "ab")]), meta).first()["perplexity"] == pytest.approx(2)
    assert lm.score(docs(spark, []), meta).collect() == []


def test_quantised():
    rng = np.random.default_rng(1)
    few = rng.choice(rng.random(256), 5000)
    codes, book = lm.quantised(few)
    assert codes.dtype == np.uint8 and (book[codes] == few).all()
    many = 10 ** rng.uniform(-7, 0, 50_000)
    codes, book = lm.quantised(many)
    assert np.abs(np.log10(book[codes] / many)).max() <= 7 / 255 + 1e-9 and abs(np.log10(book[codes] / many).mean()) < 1e-9


def test_elias_fano_with_far_gaps():
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 65, 3000):
        for top, jump in ((1, 0), (10**6, 0), (10**6, 10**9), (10**12, 1)):
            v = np.sort(rng.integers(0, top, n))
            v[n // 2 :] += jump * 1000
            e, i = EliasFano(EliasFano.build(v)), rng.permutation(n)
            assert (e.get(i) == v[i]).all()
            k, z = np.concatenate([v, v + 1]), np.zeros(2 * n, np.int64)
            at = e.find(k, z, z + n)
            assert ((at >= 0) == np.isin(k, v)).all() and (v[at[at >= 0]] == k[at >= 0]).all() and (e.successor(k, z, z + n) == np.searchsorted(v, k)).all()


def test_folder_of_a_model_is_small(spark):
    """Only the model stays, below 6 bytes an n-gram: no second files of counts or probabilities, and words of long contexts by their place among those of the shorter one."""
    rng = np.random.default_rng(3)
    given = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 200) % 20_000)) for i in range(600)]
    meta = lm.train(docs(spark, given))
    size = sum(f.stat().st_size for f in Path(meta["folder"].removeprefix("file://")).iterdir() if f.suffix != ".words")
    assert size < 6 * sum(meta["grams"][1:])


def test_small_numbers_and_whole_sequences():
    rng = np.random.default_rng(4)
    for n in (0, 1, 31, 32, 33, 3000):
        v, i = np.minimum(rng.geometric(0.5, n) - 1, 200), rng.permutation(n)
        assert (Small(Small.build(v, lm.quantised)).get(i) == v[i]).all()
        for width in (0, 1, 21, 40):
            v = np.cumsum(rng.integers(0, 1 << width, n)) if n else np.zeros(0, np.int64)
            e = EliasFano(EliasFano.build(v))
            assert (e.all() == v).all() and (e.sampled() == v[::64]).all()
            if n > 1:
                a, b = e.both(i % (n - 1))
                assert (a == v[i % (n - 1)]).all() and (b == v[i % (n - 1) + 1]).all()


def test_look_ups_one_by_one_and_decoded_agree(spark, monkeypatch):
    given = docs(spark, texts(6, 300))
    model = lm.Model(lm.train(given))
    w, _ = lm._grams(pa.array([t for _, t in texts(7, 80)]), model.vocabulary)
    decoded = model.probability(w)
    monkeypatch.setattr(lm, "DECODED", 0)
    assert (model.probability(w) == decoded).all()


@pytest.mark.parametrize("grams", [2_000_000, 40])
def test_scores_of_the_corpus_itself(spark, monkeypatch, grams):
    """What the registered query runs gives the scores by dictionaries and those by look-ups, over parts and slices of any number."""
    monkeypatch.setattr(lm, "PART_GRAMS", grams)
    monkeypatch.setattr(lm, "SLICE", 400)
    given = [*texts(8, 120), (7, "the cat sat,"), (7, "the cat sat,"), (None, "dog"), (500, None), (501, ""), (502, " \n")]
    slow = Slow([t for _, t in given if t])
    table = docs(spark, given).repartition(3)
    key = lambda r: (str(r["doc_id"]), r["n_symbols"], r["log10_prob"] or 0)
    got, searched = (sorted(x.collect(), key=key) for x in (lm.own_scores(table), lm.score(table, lm.train(table))))
    want = sorted(((d, len(lm._WORD.findall(t)) + 1 if t else 0, slow.score(t) if t else None) for d, t in given), key=lambda r: (str(r[0]), r[1], r[2] or 0))
    assert len(got) == len(searched) == len(given)
    for g, s, (d, n, p) in zip(got, searched, want):
        assert (g["doc_id"], g["n_symbols"]) == (s["doc_id"], s["n_symbols"]) == (d, n)
        assert (g["log10_prob"] is None) == (g["perplexity"] is None) == (n == 0)
        if n:
            assert g["log10_prob"] == pytest.approx(p, rel=1e-9) and s["log10_prob"] == pytest.approx(p, rel=1e-9)
            assert g["perplexity"] == pytest.approx(10 ** (-p / n))


def test_own_scores_of_nothing(spark):
    assert lm.own_scores(docs(spark, [])).collect() == []
    assert [tuple(r) for r in lm.own_scores(docs(spark, [(1, None), (2, "")])).orderBy("doc_id").collect()] == [(1, 0, None, None), (2, 0, None, None)]
