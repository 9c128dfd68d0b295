"""Expensive expressions stand once in a plan, and edges of texts."""

from pyspark.sql import functions as F

from quartermill.functions import text as S
from quartermill.plans.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_attachment_choice_reads_names_once(spark):
    assert plan(QUERIES["attachment_choice"](spark, SMALL)).count("regexp_replace(") < 200


def test_chunks_keep_digits_at_lines_edges(spark):
    texts = ["0 first 0\n1 second 1\n\u00a02 third 2\u3000", "00 a\n\n11 b\n\n 22 c"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(S.chunks(F.col("t"))).collect()
    assert [r[0] for r in rows] == [["0 first 0 1 second 1 2 third 2"], ["00 a", "11 b", "22 c"]]


def test_company_narrative_searches_once_a_pattern(spark):
    assert plan(QUERIES["company_narrative"](spark, SMALL)).count("regexp_extract_all(") <= 2


def test_issuers_look_back_nowhere(spark):
    for name in ("issuer_visa", "issuer_jpm"):
        assert "(?<=(" not in plan(QUERIES[name](spark, SMALL)), name


def test_table_headings_are_read_once(spark):
    for name in ("html_statement_metric", "table_geographies"):
        assert plan(QUERIES[name](spark, SMALL)).count("three months|quarter") <= 1, name


def test_texts_are_spread(spark):
    for name in ("company_narrative", "html_statement_metric", "issuer_visa", "quote_cards"):
        assert "RepartitionByExpression" in plan(QUERIES[name](spark, SMALL)), name


def test_quotes_search_once_a_pattern(spark):
    assert plan(QUERIES["quote_cards"](spark, SMALL)).count("regexp_extract_all(") <= 3
