import duckdb
import pandas as pd
from helpers import ODD, docs

from docparity.llm import quality

TEXTS = [
    *ODD, (20, "Of of of of of of of of of of of of"), (21, "### $$$ %%% &&& *** ~~~"), (22, "ALL CAPITALS SHOUTED AT YOU FROM HERE TO THE END OF IT ALL"), (23, "same line\n" * 30), (24, "the cat and the dog are in the house of a friend " * 12),
    (25, "kx " * 60), (26, "  leading and trailing  "), (27, "one\ttwo\x0bthree\x0cfour\r\nfive"), (28, "to the of, and. in; by: the! a? the"), (29, "ÄÖÜ ÉÈ Ñ straße"), (30, "of the and to in that was"), (31, "of,the of.the\u00a0of the-of the"),
]


def test_matches_sql(spark):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(TEXTS, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    want = sorted(con.execute(quality.report_sql()).fetchall(), key=str)
    got = sorted((tuple(r) for r in quality.quality_report(docs(spark, TEXTS)).collect()), key=str)
    assert [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in got] == [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in want]


def test_rules(spark):
    got = {r["doc_id"]: r for r in quality.quality_report(docs(spark, TEXTS)).collect() if r["doc_id"] is not None}
    assert got[1]["broken"] == got[2]["broken"] == "empty,length" and got[3]["broken"] == "empty" and "repeated_words_short" in got[20]["broken"] and "symbols" in got[21]["broken"]
    assert "shouting" in got[22]["broken"] and "repeated_lines" in got[23]["broken"] and "few_stop_words" in got[25]["broken"] and got[26]["keep"]


def test_stop_words_in_a_row(spark):
    got = {r["doc_id"]: r for r in quality.quality_report(docs(spark, TEXTS)).collect()}
    assert got[30]["stop_word_ratio"] == 1.0 and got[31]["stop_word_ratio"] == 0.75 and got[28]["stop_word_ratio"] == 1.0


def test_filter(spark):
    given = docs(spark, TEXTS)
    kept = quality.quality_filter(given)
    report = quality.quality_report(given).where("keep")
    assert kept.columns == given.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r["doc_id"] for r in report.collect()), key=str)
    assert quality.quality_filter(docs(spark, [])).collect() == [] == quality.quality_report(docs(spark, [])).collect()
    clash = spark.createDataFrame([(1, "a few words", 1, 2)], "doc_id long, text string, __dp_m int, __dp_broken int")
    assert tuple(quality.quality_filter(clash).first()) == (1, "a few words", 1, 2)


def test_no_user_functions(spark):
    plan = quality.quality_report(docs(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
