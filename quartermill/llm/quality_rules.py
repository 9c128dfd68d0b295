"""Quality rules (operator 8): adaptive thresholds from mergeable quantile sketches per language and source.

DataFrame functions alone. A sketch is a histogram over integer buckets whose width grows with the value (an eighth of a power of
two), so sketches merge by adding counts and don't depend on the order of rows; a language's sketch is the sum of its sources',
the corpus' the sum of all. A group's fences lie RANGES times its quartile range beyond its quartiles. Groups with few documents
take the language's fences, languages with few the corpus'. Documents meet the fences by a join on language and source.

A rate is a count over a base, and a short text's count is subject to chance. So a document fails a fence only if its count is
beyond what the fence says for its base by RANGES standard deviations of a Poisson count, taken by Anscombe's transform
2 * sqrt(count + 3/8), whose deviation is 1. There are no cutoffs besides: what a rate allows comes from the sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartermill.llm._common import Scratch, table

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Documents a group needs for fences of its own; quartile ranges beyond the quartile, and deviations of a count beyond the fence.
ENOUGH = 100
RANGES = 3
#: Rates in sketch units: name, count, base, units to one, and whether low values fail too. A repeat has six words at least.
RATES = (
    ("word_length", "word_chars", "n_words", 100, True),
    ("symbols", "n_symbols", "n_words", 1000, False),
    ("dup_lines", "n_dup_lines", "greatest(n_lines, 1)", 1000, False),
    ("repeats", "n_repeat_words / 6", "n_words", 6000, False),
    ("capitals", "n_capitals", "greatest(word_chars, 1)", 1000, False),
)


def _rate(count: str, base: str, units: int) -> str:
    """The integer that a sketch takes."""
    name, _, part = count.partition(" / ")
    return f"{name} * {units // int(part or 1)} div {base}"


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row, though later functions refer to it many times."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _without(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, and the counts of every row; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("text"))
    bare = F.btrim("text", F.lit(WHITE))
    rows = held(rows, "words", F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    rows = held(rows, "lines", F.struct(F.size(lines).alias("n"), F.size(F.array_distinct(lines)).alias("distinct")))
    word = lambda i: F.get("words", i)
    starts = F.when(F.size("words") >= 3, F.sequence(F.lit(0), F.size("words") - 3)).otherwise(F.array().cast("array<int>"))
    rows = held(rows, "hashes", F.transform(starts, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))))
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    windows = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), placed).otherwise(none)  # most texts repeat nothing: no sort
    rows = rows.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - _without(F.col("text"), WHITE)).cast("long").alias("word_chars"),
        _without(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        _without(F.col("text"), LETTERS).cast("long").alias("n_capitals"),
        F.col("lines.n").cast("long").alias("n_lines"),
        (F.col("lines.n") - F.col("lines.distinct")).cast("long").alias("n_dup_lines"),
        F.explode(F.array(windows)).alias("windows"),
    )
    twin = lambda x, k: (x["h"] == F.get("windows", k - 1)["h"]) | (x["h"] == F.get("windows", k + 1)["h"])
    repeated = F.sort_array(F.transform(F.filter("windows", lambda x, k: F.coalesce(twin(x, k), x["h"] == F.get("windows", k + 1)["h"], x["h"] == F.get("windows", k - 1)["h"], F.lit(False))), lambda x: x["i"]))
    covered = F.aggregate(
        repeated,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return rows.withColumn("n_repeat_words", covered.cast("long")).drop("windows")


def bucket(x: Column) -> Column:
    """Values under 16 for themselves, above that eight buckets to a power of two."""
    e = F.length(F.bin(x)) - 1
    return F.when(x < 16, x).otherwise(16 + (e - 4) * 8 + F.call_function("shiftright", x, (e - 3).cast("int")).bitwiseAND(F.lit(7))).cast("long")


def bucket_floor(b: Column) -> Column:
    """The least value of a bucket."""
    return F.when(b < 16, b).otherwise(F.call_function("shiftleft", 8 + (b - 16) % 8, (F.floor((b - 16) / 8) + 1).cast("int"))).cast("long")


def fences(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, metric, low and high of each sketch with enough documents; `sketch` has keys, metric, b, n."""
    merged = sketch.groupBy(*keys, "metric", "b").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*keys, "metric")
    upto = F.sum("n").over(own.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = merged.withColumns({"upto": upto, "total": F.sum("n").over(own)})
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("b")))
    found = ranked.groupBy(*keys, "metric").agg(quartile(1).alias("b1"), quartile(3).alias("b3"), F.max("total").alias("total")).where(F.col("total") >= (ENOUGH if keys else 0))
    q1, q3 = bucket_floor(F.col("b1")), bucket_floor(F.col("b3") + 1)
    return found.select(*keys, F.struct("metric", (q1 - RANGES * (q3 - q1)).alias("low"), (q3 + RANGES * (q3 - q1)).alias("high")).alias("f")).groupBy(*keys).agg(F.sort_array(F.collect_list("f")).alias(name))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed (names of rates beyond their fences) of every row.

    A null or empty text has no words, fails the base rules and isn't kept. Null languages and sources are groups of their own.
    Rows with the same doc_id, or the same row twice, each give a row and count in the sketches. Columns besides doc_id, text,
    lang and source aren't read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality-rules")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = measures(docs).withColumn("base_failed", base)
    rates = F.when(F.col("n_words") > 0, F.array(*(F.expr(_rate(count, base, units)) for _, count, base, units, _ in RATES)))
    counts = F.array(*(F.struct(F.expr(count).cast("double").alias("count"), F.expr(base).cast("double").alias("base")) for _, count, base, _, _ in RATES))
    group = {"lang_key": F.struct(F.col("lang").isNull(), F.coalesce("lang", F.lit(""))), "source_key": F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))}
    counted = counted.withColumns({"rates": rates, "counts": counts}).withColumns({k: F.to_json(v) for k, v in group.items()})
    rows = scratch.keep(counted.drop("lang", "source", "n_lines", "n_capitals"))
    sketch = rows.where("rates IS NOT NULL").select("lang_key", "source_key", F.posexplode("rates").alias("metric", "x")).withColumn("b", bucket(F.col("x")))
    sketch = scratch.keep(sketch.groupBy("lang_key", "source_key", "metric", "b").agg(F.count("*").alias("n")))
    by_group, by_lang = fences(sketch, ["lang_key", "source_key"], "own"), fences(sketch, ["lang_key"], "of_lang")
    of_all = fences(sketch, [], "of_all").first()  # one row: two numbers a rate
    whole = F.array(*(F.struct(F.lit(f["metric"]).alias("metric"), F.lit(f["low"]).cast("long").alias("low"), F.lit(f["high"]).cast("long").alias("high")) for f in (of_all["of_all"] if of_all else ())))
    whole = whole if of_all else F.lit(None).cast("array<struct<metric:int,low:bigint,high:bigint>>")
    groups = sketch.select("lang_key", "source_key").distinct().join(by_group, ["lang_key", "source_key"], "left").join(by_lang, "lang_key", "left").withColumn("of_all", whole)
    fence = scratch.keep(groups.select("lang_key", "source_key", F.coalesce("own", "of_lang", "of_all").alias("fence")))
    met = rows.join(fence, ["lang_key", "source_key"], "left")
    tests = []
    root = lambda x: F.sqrt(x + F.lit(0.375))
    for k, (name, _, _, units, both) in enumerate(RATES):
        own, f = F.get("counts", F.lit(k)), F.get("fence", F.lit(k))
        said = lambda side: F.greatest(f[side], F.lit(0)).cast("double") * own["base"] / F.lit(float(units))  # noqa: B023, E731
        beyond = root(own["count"]) - root(said("high")) > RANGES / 2
        tests.append(F.when(F.col("rates").isNotNull() & ((beyond | (root(said("low")) - root(own["count"]) > RANGES / 2)) if both else beyond), F.lit(name)))
    failed = F.array_join(F.array_compact(F.array(*tests)), ",")
    met = met.withColumn("failed", F.coalesce(failed, F.lit("")))
    return met.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("failed") == "")).alias("kept"), "failed")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents."""
    return judge(table(spark, sf_dir, "documents"))


_RATE_SQL = ", ".join(f"({_rate(count, base, units).replace(' div ', ' // ')}) AS r{k}, ({count})::DOUBLE AS c{k}, ({base})::DOUBLE AS b{k}" for k, (_, count, base, units, _) in enumerate(RATES))
_BUCKET_SQL = "CASE WHEN x < 16 THEN x ELSE 16 + (length(bin(x)) - 5) * 8 + ((x >> (length(bin(x)) - 4)) & 7) END"


def _floor_sql(b: str) -> str:
    return f"(CASE WHEN {b} < 16 THEN {b} ELSE (8 + ({b} - 16) % 8) << (({b} - 16) // 8 + 1) END)"


def _fence_sql(name: str, keys: str, least: int) -> str:
    by = f"{keys}, " if keys else ""
    q1, q3 = _floor_sql("b1"), _floor_sql("(b3 + 1)")
    return f"""
{name}0 AS (SELECT {by}metric, b, sum(n) AS n FROM sketch GROUP BY ALL),
{name}1 AS (SELECT *, sum(n) OVER (PARTITION BY {by}metric ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {by}metric) AS total FROM {name}0),
{name}2 AS (SELECT {by}metric, min(CASE WHEN upto * 4 >= total THEN b END) AS b1, min(CASE WHEN upto * 4 >= total * 3 THEN b END) AS b3 FROM {name}1 GROUP BY {by}metric HAVING max(total) >= {least}),
{name} AS (SELECT {by}metric, {q1} - {RANGES} * ({q3} - {q1}) AS low, {q3} + {RANGES} * ({q3} - {q1}) AS high FROM {name}2)"""


_UNITS_SQL = "CASE metric " + " ".join(f"WHEN {k} THEN {units}" for k, (_, _, _, units, _) in enumerate(RATES)) + " END::DOUBLE"
_TEST_SQL = f"sqrt(c + 0.375::DOUBLE) - sqrt(greatest(high, 0)::DOUBLE * base / {_UNITS_SQL} + 0.375::DOUBLE) > {RANGES / 2}::DOUBLE"
_TEST_SQL += f" OR (metric IN ({', '.join(str(k) for k, r in enumerate(RATES) if r[4])}) AND sqrt(greatest(low, 0)::DOUBLE * base / {_UNITS_SQL} + 0.375::DOUBLE) - sqrt(c + 0.375::DOUBLE) > {RANGES / 2}::DOUBLE)"
_NAME_SQL = "CASE " + " ".join(f"WHEN metric = {k} THEN '{name}'" for k, (name, *_) in enumerate(RATES)) + " END"
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
v AS (SELECT k, unnest(range(1, len(words) - 1)) AS i, words FROM w),
t AS (SELECT k, i, count(*) OVER (PARTITION BY k, words[i], words[i + 1], words[i + 2]) AS n FROM v),
p AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM t, (VALUES (0), (1), (2)) AS s(j) WHERE n >= 2 GROUP BY k),
m AS (SELECT w.k, doc_id, lang, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN p USING (k)),
r AS (SELECT *, {_RATE_SQL} FROM m WHERE n_words > 0),
x AS (SELECT k, lang, source, unnest(range(0, {len(RATES)})) AS metric, {", ".join(f"unnest([{', '.join(f'{c}{k}' for k in range(len(RATES)))}]) AS {name}" for c, name in (("r", "x"), ("c", "c"), ("b", "base")))} FROM r),
sketch AS (SELECT lang, source, metric, {_BUCKET_SQL} AS b, count(*) AS n FROM x GROUP BY ALL),
{_fence_sql("own", "lang, source", ENOUGH)},
{_fence_sql("of_lang", "lang", ENOUGH)},
{_fence_sql("of_all", "", 0)},
f AS (SELECT x.k, x.metric, x.c, x.base, coalesce(own.low, of_lang.low, of_all.low) AS low, coalesce(own.high, of_lang.high, of_all.high) AS high
      FROM x LEFT JOIN own USING (lang, source, metric) LEFT JOIN of_lang USING (lang, metric) LEFT JOIN of_all USING (metric)),
z AS (SELECT k, string_agg({_NAME_SQL}, ',' ORDER BY metric) AS failed FROM f WHERE {_TEST_SQL} GROUP BY k),
y AS (SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(failed, '') AS failed FROM m LEFT JOIN z USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM y
"""
