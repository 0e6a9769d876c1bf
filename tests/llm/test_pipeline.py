"""The pipeline, stage by stage, against brute force."""

from collections import Counter

import corpus_pipeline
import duckdb
import pandas as pd
import pytest
import slow_pii
from helpers import ODD, docs
from test_minhash import brute, groups
from test_packing import check

from docparity.llm import packing, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at = spark.read.parquet(f"{SF}/documents.parquet")
    out = [at]
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        folder = str(tmp_path_factory.mktemp("stages") / str(i))
        f(spark, out[-1], SF).write.parquet(folder)
        out.append(spark.read.parquet(folder))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "personal data", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality_stage(stages):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r["doc_id"], r["text"]) for r in stages[0].collect()], columns=["doc_id", "text"]))
    keep = {d for (d,) in con.execute(f"SELECT doc_id FROM ({quality.report_sql()}) WHERE keep").fetchall()}
    assert set(rows(stages[1])) == keep and 0 < len(keep) < stages[0].count()


def test_dedup_stage(stages):
    before = rows(stages[1])
    texts = [(d, r["text"]) for d, r in before.items()]
    gone = {texts[i][0] for g in groups(brute(texts)) for i in g if texts[i][0] != min(texts[j][0] for j in g)}
    assert set(rows(stages[2])) == set(before) - gone and gone


def test_pii_stage(stages):
    before, after = rows(stages[2]), rows(stages[3])
    assert set(before) == set(after) and any(before[d]["text"] != after[d]["text"] for d in before)
    for d, r in after.items():
        assert r["n_chars"] in (before[d]["n_chars"], len(r["text"]))
        if len(before[d]["text"]) < 20_000:
            assert r["text"] == slow_pii.redacted(before[d]["text"])


def test_packing_stage(stages):
    check(stages[4].collect(), [(d, r["text"]) for d, r in rows(stages[3]).items()], packing.CAPACITY)


def test_run_is_its_stages(spark, stages):
    key = lambda df: Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[4])


def test_odd_rows(spark):
    at = docs(spark, ODD)
    for _, f in corpus_pipeline.STAGES:
        at = f(spark, at, SF)
    # nulls, empty texts and the sentence repeated 20,000 times break a rule; of the two rows of document 5 both stay
    assert Counter(r["doc_id"] for r in at.collect()) == Counter([5, 5, None, 6, 7])


def test_empty(spark):
    at = docs(spark, [])
    for _, f in corpus_pipeline.STAGES:
        at = f(spark, at, SF)
    assert at.collect() == []


