"""Report quality: rules as conditional structs, scores, and audit roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points of an issue; the codes below are fixed values, too.
WEIGHTS = {"critical": 25, "major": 10, "minor": 4}
#: What evaluate() reads.
PAYLOAD = """revenue double, net_income double, gross_margin double, net_margin double, segments array<struct<value:double,scope:string>>,
geographies array<struct<value:double,scope:string>>, structure string, history_count int, history_window int, missing_revenue int, missing_net_income int,
segment_coverage double, geography_coverage double, qna int, management int, evidence int, quotes int,
materials array<struct<status:string,text_length:int,role:string>>, fallback_lines int"""


def _issue(when: Column, severity: str | Column, code: str) -> Column:
    own = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(F.coalesce(when, F.lit(False)), F.struct(own.alias("severity"), F.lit(code).alias("code")))


def issues(full_coverage: bool = False) -> Column:
    """The array of a payload's issues, in the order of the rules."""
    c = F.col
    n_segments, n_geographies = F.size("segments"), F.size("geographies")
    added = lambda name: F.aggregate(name, F.lit(0.0), lambda a, x: a + F.coalesce(x["value"], F.lit(0.0)))
    ratio = lambda name: F.when(F.size(name) > 0, added(name) / F.nullif(c("revenue"), F.lit(0.0)))
    by_mode = F.when(c("structure") == "management", "minor").otherwise("major")
    n, window = c("history_count"), F.coalesce("history_window", "history_count")
    best = F.greatest("segment_coverage", "geography_coverage")
    gaps = lambda name: c(name) > F.greatest(F.lit(1), F.floor(n / 5))
    severe = lambda name: F.when(c(name) > F.greatest(F.lit(2), F.floor(n / 3)), "critical").otherwise("major")
    extracted = F.filter("materials", lambda m: m["status"].isin("fetched", "cached") & (m["text_length"] > 0))
    failed = F.size(F.filter("materials", lambda m: m["status"] == "error"))
    disabled = F.size(F.filter("materials", lambda m: m["status"] == "disabled"))
    rules = [
        _issue(c("revenue").isNull(), "critical", "latest_kpi_missing_revenue"),
        _issue(c("net_income").isNull(), "critical", "latest_kpi_missing_net_income"),
        _issue(c("gross_margin").isNull() & c("net_margin").isNull(), "major", "latest_margin_missing"),
        _issue((n_segments == 0) & (n_geographies == 0), by_mode, "current_structure_missing"),
        _issue((c("structure") == "segment") & (n_segments == 0), "major", "segment_mode_without_segments"),
        _issue((c("structure") == "geography") & (n_geographies == 0), "major", "geography_mode_without_geographies"),
        _issue(~ratio("segments").between(0.35, 1.65), "major", "segment_ratio_outlier"),
        _issue(~ratio("geographies").between(0.35, 1.65), "major", "geography_ratio_outlier"),
        _issue(n == 0, "critical", "history_missing"),
        _issue((n > 0) & (window >= 4) & (n < window), "major", "history_window_short"),
        _issue((n > 0) & gaps("missing_revenue"), severe("missing_revenue"), "history_revenue_missing"),
        _issue((n > 0) & gaps("missing_net_income"), severe("missing_net_income"), "history_net_income_missing"),
        _issue((n > 0) & (best <= 0), by_mode, "history_structure_missing"),
        _issue((n > 0) & (best > 0) & (best < 0.35), by_mode, "history_structure_sparse"),
        _issue((n > 0) & (c("structure") == "segment") & (c("segment_coverage") < 0.6), "major", "segment_history_sparse"),
        _issue((n > 0) & (c("structure") == "geography") & (c("geography_coverage") < 0.6), "major", "geography_history_sparse"),
        _issue(c("qna") == 0, "major", "qna_missing"),
        _issue(c("qna") == 1, "major", "qna_sparse"),
        _issue(c("management") < 2, "minor", "management_theme_sparse"),
        _issue(c("evidence") < 2, "major", "evidence_sparse"),
        _issue((F.size("materials") > 0) & (F.size(extracted) == 0) & (disabled == 0), "critical", "source_material_not_extracted"),
        _issue((failed > 0) & (failed >= F.greatest(F.lit(2), F.floor(F.size("materials") / 2))), "major", "source_material_fail_ratio_high"),
    ]
    if full_coverage:
        has_s, has_g = n_segments >= 2, n_geographies >= 2
        proxy = F.exists("segments", lambda s: F.lower(s["scope"]) == "geo_proxy")
        roles = F.transform(extracted, lambda m: F.lower(m["role"]))
        has = lambda *names: F.arrays_overlap(roles, F.array(*map(F.lit, names)))
        dense = (c("qna") >= 3) & (c("management") >= 3) & (c("evidence") >= 3)
        s_cov, g_cov = c("segment_coverage"), c("geography_coverage")
        rules += [
            _issue(c("structure") == "management", "critical", "full_coverage_structure_mode_management"),
            _issue(~has_s, F.when(has_g, "major").otherwise("critical"), "full_coverage_segment_missing"),
            _issue(~has_g, F.when(has_s, "major").otherwise("critical"), "full_coverage_geography_missing"),
            _issue(F.exists("geographies", lambda g: F.lower(g["scope"]) == "annual_filing"), "critical", "full_coverage_geography_non_quarterly"),
            _issue(best < 0.95, "critical", "full_coverage_structure_history_incomplete"),
            _issue((s_cov < 0.95) & ~((g_cov >= 0.95) & proxy), F.when(g_cov >= 0.95, "major").otherwise("critical"), "full_coverage_segment_history_incomplete"),
            _issue(g_cov < 0.95, F.when(s_cov >= 0.95, "major").otherwise("critical"), "full_coverage_geography_history_incomplete"),
            _issue(c("qna") < 3, "critical", "full_coverage_qna_sparse"),
            _issue(c("management") < 3, "critical", "full_coverage_management_sparse"),
            _issue(c("evidence") < 3, "critical", "full_coverage_evidence_sparse"),
            _issue(~has("earnings_release") & ~(has("sec_filing", "investor_relations") & dense), "critical", "full_coverage_source_role_missing_earnings_release"),
            _issue(~has("sec_filing") & ~has("structured_financials"), "critical", "full_coverage_source_role_missing_sec_filing"),
            _issue(~has("earnings_commentary", "earnings_call", "earnings_presentation") & (c("qna") < 3) & (c("quotes") < 2), "critical", "full_coverage_source_role_missing_call_context"),
            _issue(c("fallback_lines") > 0, "critical", "full_coverage_fallback_detected"),
        ]
    return F.array_compact(F.array(*rules))


def evaluate(payloads: DataFrame, full_coverage: bool = False) -> DataFrame:
    """Adds issues, critical, major, minor, score and status. No shuffle: a payload's rules are a projection."""
    rated = payloads.select("*", F.explode(F.array(issues(full_coverage))).alias("issues"))
    count = lambda s: F.size(F.filter("issues", lambda i: i["severity"] == s))
    rated = rated.withColumns({s: count(s) for s in WEIGHTS})
    score = F.greatest(F.lit(0), 100 - sum((F.col(s) * w for s, w in list(WEIGHTS.items())[1:]), F.col("critical") * 25))
    rated = rated.withColumn("score", score)
    return rated.withColumn("status", F.when(F.col("critical") > 0, "fail").when((F.col("major") >= 3) | (F.col("score") < 82), "review").otherwise("pass"))


def coverage(name: str) -> Column:
    """Aggregate: the share of rows with a non-empty array."""
    return F.avg(F.when(F.size(name) > 0, 1.0).otherwise(0.0))


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("company").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pass", "review", "fail", "error")))


def issue_counts(issues_: DataFrame, most: int = 6) -> DataFrame:
    """The most frequent codes of each company, the first seen first among equals. issues_: company, seq, severity, code."""
    counts = issues_.groupBy("company", "code").agg(F.count("*").alias("n"), F.min("seq").alias("first_seen"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("company").orderBy(F.desc("n"), "first_seen", "code"))).where(F.col("rank") <= most)


def snapshots(results: DataFrame, supported: DataFrame) -> DataFrame:
    """A row for each company: cached and dynamic quarters with the first and last of each, quarters of the window, those excluded as not ready, audited ones and how they came out.

    supported: company, quarter_index, cached, dynamic, in_window, target (booleans). results: company, quarter_index, status.
    """
    at = F.col("quarter_index")
    of = lambda flag, agg: agg(F.when(F.col(flag), at))
    known = supported.groupBy("company").agg(
        *(f.alias(n) for k in ("cached", "dynamic") for n, f in ((f"{k}_count", F.count_if(F.col(k))), (f"{k}_first", of(k, F.min)), (f"{k}_last", of(k, F.max)))),
        F.count_if("in_window").alias("window_count"),
        F.greatest(F.lit(0).cast("long"), F.count_if("in_window") - F.count_if("target")).alias("excluded_count"),
    )
    audited = results.groupBy("company").agg(F.count("*").alias("audited_count"), *(F.count_if(F.col("status") == s).alias(s) for s in ("pass", "review", "fail", "error")))
    return known.join(audited, "company", "left").na.fill(0, ["audited_count", "pass", "review", "fail", "error"])


def pressure(companies: DataFrame, most: int = 10) -> DataFrame:
    """1000 a failure or error, 10 a review, 6 a critical and 2 a major issue; the highest, above 0."""
    score = 1000 * (F.col("fail") + F.col("error")) + 10 * F.col("review") + 6 * F.col("critical") + 2 * F.col("major")
    return companies.withColumn("pressure", score).where("pressure > 0").orderBy(F.desc("pressure"), "company").limit(most)


def worst_quarters(results: DataFrame, most: int = 5) -> DataFrame:
    """By status, then score. results: company, quarter_index, status, score."""
    rank = F.when(F.col("status") == "error", 3).when(F.col("status") == "fail", 2).when(F.col("status") == "review", 1).otherwise(0)
    own = Window.partitionBy("company").orderBy(F.desc(rank), "score", "quarter_index")
    return results.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= most)


def sampled(quarters: DataFrame, nth: int) -> DataFrame:
    """The nth, the middle and the last quarter of each company."""
    w = Window.partitionBy("company")
    k, n = F.row_number().over(w.orderBy("quarter_index")), F.count("*").over(w)
    return quarters.withColumns({"_k": k, "_n": n}).where((F.col("_k") == F.least(F.lit(nth), F.col("_n"))) | (F.col("_k") == F.floor(F.col("_n") / 2) + 1) | (F.col("_k") == F.col("_n"))).drop("_k", "_n")


def ready_map(results: DataFrame) -> DataFrame:
    """company and the sorted quarters that passed."""
    return results.groupBy("company").agg(F.sort_array(F.collect_list(F.when(F.col("status") == "pass", F.col("quarter_index")))).alias("ready"))


def material_scores(tokens: Column, sources: Column, transcript: Column) -> Column:
    """struct<release, presentation, call, extraction>: scores of what material a report has; fixed values.

    tokens: the report's own; sources: array<struct<kind, status, text_length>>; transcript: whether there is a summary of one.
    """
    read = lambda s: s["status"].isin("fetched", "cached")
    has = lambda kind: F.exists(sources, lambda s: read(s) & (s["kind"] == kind))
    named = lambda token: F.array_contains(tokens, token)
    extracted = F.size(F.filter(sources, lambda s: read(s) & (F.coalesce(s["text_length"], F.lit(0)) > 0)))
    return F.struct(
        F.when(has("official_release") | named("earnings_release"), 100).otherwise(32).alias("release"),
        F.when(has("presentation") | named("presentation"), 92).otherwise(36).alias("presentation"),
        F.when(transcript, 100).when(named("call_summary"), 42).otherwise(18).alias("call"),
        F.when(F.size(sources) == 0, 18).when(extracted == 0, 26).when(extracted == F.size(sources), 100).otherwise(74).alias("extraction"),
    )


def markdown(snapshots_: DataFrame, codes: DataFrame) -> DataFrame:
    """rank and line: the companies under pressure as lines of a list. snapshots_: pressure's rows with pass, review, fail, critical, major, minor; codes: issue_counts."""
    top = codes.where(F.col("rank") <= 4).groupBy("company").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code", "n"))), lambda c: F.format_string("%s(%d)", c["code"], c["n"])), ", ").alias("_top"))
    ranked = snapshots_.join(top, "company", "left").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("pressure"), "company")))  # ten rows at most
    line = F.format_string("%d. `%s` | pressure=%d | pass=%d review=%d fail=%d | issues(c/m/n)=%d/%d/%d", "rank", F.col("company").cast("string"), F.col("pressure").cast("long"), *(F.col(c).cast("long") for c in ("pass", "review", "fail", "critical", "major", "minor")))
    return ranked.select("rank", F.concat(line, F.coalesce(F.concat(F.lit(" | top: "), "_top"), F.lit(""))).alias("line"))
