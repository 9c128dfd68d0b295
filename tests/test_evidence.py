"""Headline drivers by the company's names."""

from pyspark.sql import functions as F

from quartermill.operators.evidence import summary_driver

CASES = [
    ("云业务需求持续走强，Acme 2024Q1 收入 3.1B", "云业务需求持续走强"),  # six characters and more ahead of the name
    ("Acme 2024Q1 需求持续走强。", "需求持续走强"),  # ahead nothing, behind no figures
    ("Acme 2024Q1 收入 3.1B，同比 +4.0%，表现稳健而且超出预期", "Acme 2024Q1 收入 3.1B，同比 +4.0%，表现稳健而且超出预期"),  # neither: the whole text
    ("Acme 收入 3.1B", None),  # a short line of figures
    ("  ，。 ", None),
    (None, None),
    ("没有  名字 的一句话。", "没有 名字 的一句话"),
]


def test_summary_driver(spark):
    rows = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(CASES)], "n int, text string")
    got = rows.select("n", summary_driver(F.col("text"), F.lit("Acme"), F.lit("艾克美"), F.lit("2024Q1")).alias("d")).orderBy("n").collect()
    assert [r["d"] for r in got] == [w for _, w in CASES]
