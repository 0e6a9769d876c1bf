import random

import pytest
from helpers import LONG, ODD, docs

from docparity.llm import token_counts as tc

ENC, LENGTHS = tc.encoding(tc.VOCABULARY)
ALPHABETS = ["ab ", "abc123 .,'s\n", " \t\n", "é日🙂a ", "'", "_-", "don't we'll 12", "a"]


def spliced(text, chunk, overlap):
    parts, n = tc.encode_long(ENC, LENGTHS, text, chunk, overlap)
    return [int(t) for p in parts for t in p], n


@pytest.mark.parametrize("seed", range(120))
def test_same_tokens_as_the_whole(seed):
    rng = random.Random(seed)
    letters = rng.choice([*ALPHABETS, "".join(ALPHABETS)])
    text = "".join(rng.choices(letters, k=rng.randrange(0, 900)))
    chunk = rng.randrange(8, 120)
    assert spliced(text, chunk, rng.randrange(1, chunk))[0] == ENC.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 5000, "日" * 3000, "x " + "." * 4000 + " y", "ab" + " " * 3000 + "cd", "🙂" * 1500])
def test_overlaps_that_never_align(text):
    tokens, n = spliced(text, 256, 16)
    assert tokens == ENC.encode_ordinary(text) and n > 1


def test_long_prose_takes_one_pass():
    tokens, n = spliced(LONG[:200_000], tc.CHUNK, tc.OVERLAP)
    assert tokens == ENC.encode_ordinary(LONG[:200_000]) and n <= 14


def test_odd_rows(spark):
    rows = tc.token_counts(docs(spark, ODD)).collect()
    want = sorted(((d, None if t is None else len(ENC.encode_ordinary(t))) for d, t in ODD), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in rows), key=str) == want
    assert {r["n_chunks"] for r in rows if r["n_tokens"] == 0} == {0} and max(r["n_chunks"] or 0 for r in rows) > 1
    assert tc.token_counts(docs(spark, [])).collect() == []


def test_special_token_strings_are_text(spark):
    assert tc.token_counts(docs(spark, [(1, "<|endoftext|>")])).first()["n_tokens"] > 1


def test_bad_overlap(spark):
    with pytest.raises(ValueError):
        tc.token_counts(docs(spark, []), chunk=10, overlap=10)


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"]: len(ENC.encode_ordinary(r["text"])) for r in table.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in tc.token_counts(table, chunk=512, overlap=32).collect()}
    assert got == want
