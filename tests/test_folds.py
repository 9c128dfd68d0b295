"""Operators that SQL doesn't express, against plain loops; readers and streams over files."""

import json
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quartermill.functions import text as S
from quartermill.operators import selection as X
from quartermill.operators import series as Q
from quartermill.sources import readers as R
from quartermill.streaming import events as E

from .conftest import DATA


def test_spikes(spark):
    values = [(1, n, v) for n, v in enumerate([22.0, 23.0, 21.0, 24.0, 80.0, None, 25.0, 90.0, 26.0])] + [(2, n, v) for n, v in enumerate([1.0, 50.0, 2.0])] + [(3, n, v) for n, v in enumerate([-5.0, -6.0, -7.0, -4.0, 25.0])] + [(4, n, v) for n, v in enumerate([10.0, 11.0, 10.5, 11.2, 37.4])]
    got = {(r.company, r.quarter_index): r.roe_kept for r in Q.despiked(spark.createDataFrame(values, "company int, quarter_index int, roe double")).collect()}
    accepted, want = {}, {}
    for company, quarter, v in values:
        own = accepted.setdefault(company, [])
        recent = sorted(own[-4:])
        if v is not None and len(recent) == 4 and recent[2] > 0 and v > 20 and v > 2.2 * recent[2] and v > recent[2] + 10:
            v = None
        want[company, quarter] = v
        if v is not None:
            own.append(v)
    assert got == want and got[1, 4] is None and got[1, 7] is None and got[3, 4] == 25.0 and got[4, 4] is None


def test_fuzzy_names(spark):
    companies = spark.createDataFrame([("nvda", ["nvidia", "nvda"]), ("msft", ["microsoft", "msft"]), ("meta", ["meta", "facebook"])], "company_id string, aliases array<string>")
    rows = X.suggested(spark.createDataFrame([("Nvidea",), ("micro",), ("zzz",)], "reference string"), companies).collect()
    by = {(r.reference, r.company_id): r.score for r in rows}
    assert abs(by["Nvidea", "nvda"] - SequenceMatcher(None, "nvidea", "nvidia").ratio()) < 1e-9
    assert by["micro", "msft"] == 0.92 and not any(k[0] == "zzz" for k in by)


def test_resolution_is_the_plain_loop(spark):
    import random
    import re

    from pyspark.sql import functions as F

    rng = random.Random(8)
    make = lambda: "".join(rng.choice("abcdeen o.x1") for _ in range(rng.randint(1, 9)))
    companies = [(f"c{n:02}", [make() for _ in range(2)], 30 - n, f"{make()}, Inc.", f"T{n}") for n in range(30)]
    df = spark.createDataFrame(companies, "company_id string, names array<string>, display_order int, english_name string, ticker string")
    df = df.withColumn("aliases", X.company_aliases(F.concat(F.array("company_id", "ticker", "english_name"), F.col("names")), F.col("english_name")))
    token = lambda t: re.sub("[^0-9a-z\u4e00-\u9fff]+", "", t.strip().lower())
    names = {c[0]: {token(a) for a in (c[0], c[4], c[3], *c[1], c[3].replace(".", ""), c[3].replace(",", ""))} - {""} for c in companies}
    references = sorted({make() for _ in range(150)} | {"", " .", companies[3][3], "C07", "zzz", "英伟达"})

    def score(own, alias):
        r = SequenceMatcher(None, own, alias).ratio()
        return max(r, 0.92) if alias.startswith(own) or own.startswith(alias) else max(r, 0.84) if own in alias or alias in own else r

    want, listed = {}, {}
    for reference in references:
        own = token(reference)
        found = sorted(((-max(score(own, a) for a in names[c[0]]), c[0], c) for c in companies if own and names[c[0]]), key=lambda x: x[:2])
        found = [x for x in found if x[0] <= -0.55]
        listed[reference] = [(c, round(-s, 9)) for s, c, _ in found[:5]]
        exact = sorted((c[2], c[0]) for c in companies if own in names[c[0]])
        top = max((SequenceMatcher(None, own, a).ratio() for a in names[found[0][1]]), default=0) if found else 0
        hints = ", ".join(f"{c[3]} ({c[4]})" for _, _, c in found[:3])
        want[reference] = (None, "Company reference is empty.") if not own else (exact[0][1], None) if exact else (found[0][1], None) if top >= 0.82 else (None, f"Unknown company reference: {reference}" + (f". Closest matches: {hints}" if found else ""))
    own = spark.createDataFrame([(r,) for r in references], "reference string")
    assert {r.reference: (r.company_id, r.error) for r in X.resolved(own, df).collect()} == want
    got = {r: [] for r in references}
    for r in sorted(X.suggested(own, df).collect(), key=lambda r: r["rank"]):
        got[r.reference].append((r.company_id, round(r.score, 9)))
    assert got == listed


def test_two_keys_greedily(spark):
    rows = [(1, n, f, link) for n, (f, link) in enumerate([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "z"), ("d", "w"), ("e", "v")])]
    got = X.first_of_two_keys(spark.createDataFrame(rows, "report int, ordinal int, firm string, link string")).orderBy("ordinal").collect()
    assert [(r.firm, r.link) for r in got] == [("a", "x"), ("b", "y"), ("c", "z"), ("d", "w")]


def test_interpolation_equals_filling_in_place(spark):
    import random

    rng = random.Random(2)
    series = [[rng.choice([None, float(rng.randint(1, 99))]) for _ in range(8)] for _ in range(60)]
    rows = [(c, q, v) for c, s in enumerate(series) for q, v in enumerate(s)]
    got = {(r.company, r.quarter_index): r.v_filled for r in Q.interpolated(spark.createDataFrame(rows, "company int, quarter_index int, v double"), "v").collect()}
    for c, s in enumerate(series):
        own = list(s)
        for i in range(8):
            if own[i] is None:
                before = next(((k, own[k]) for k in range(i - 1, -1, -1) if own[k] is not None), None)
                after = next(((k, own[k]) for k in range(i + 1, 8) if own[k] is not None), None)
                if before and after:
                    own[i] = before[1] + (after[1] - before[1]) * (i - before[0]) / (after[0] - before[0])
                elif before:
                    own[i] = before[1]
                elif after and after[0] - i == 1:
                    own[i] = after[1]
        assert all((got[c, i] is None) == (own[i] is None) and (own[i] is None or abs(got[c, i] - own[i]) < 1e-9) for i in range(8)), (s, own)


def test_wrapped_dataset_and_history_files(spark, tmp_path):
    data = {"periods": ["2024Q1", "2024Q2"], "companies": {"a": {"revenue": {"2024Q1": 5, "2024Q2": None}, "earnings": {"2024Q1": 1.5}}}}
    (tmp_path / "d.js").write_text("window.DATA = " + json.dumps(data) + ";\n")
    rows = R.long_series(R.wrapped_json(spark, str(tmp_path / "d.js"))).collect()
    assert sorted(map(tuple, rows)) == [("a", "earnings", "2024Q1", 1.5), ("a", "revenue", "2024Q1", 5.0)]
    (tmp_path / "s.csv").write_text("quarter_end,x,x_share\n2024-03-31,1000,40\n2024-06-30,3000,60\n")
    got = R.segment_history(spark, str(tmp_path / "s.csv"), ["x"], spark.createDataFrame([(8095,), (8096,), (8097,)], "quarter_index int")).orderBy("quarter_index").collect()
    assert [tuple(r) for r in got] == [(8096, "x", 1.0, 40.0), (8097, "x", 3.0, 60.0)]


def test_anchor_labels_and_store(spark, tmp_path):
    links = spark.createDataFrame([(1, 0, "l", "Press release"), (1, 1, "l", "release"), (1, 2, "l", "PDF"), (1, 3, "m", "")], "page_id int, seq int, link string, label string")
    assert {r.link: r.label for r in R.anchors_by_link(links).collect()} == {"l": "Press release PDF", "m": ""}
    R.store(links, str(tmp_path / "t"), "page_id")
    R.store(links, str(tmp_path / "t"), "page_id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 8


def test_label_variants_and_stance(spark):
    r = spark.sql("SELECT 'Data & AI' AS n, 'Broker upgrades to buy, $120.5 target' AS t").select(S.label_variants(F.col("n")).alias("v"), S.stance(F.col("t")).alias("s"), S.price_target(F.col("t")).alias("p")).first()
    assert r.v == ["Data & AI", "Data and AI"] and r.s == "positive" and r.p == 120.5


def test_uploads_and_document_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.HTML").write_text("<p>rich <b>text</b></p>")
    (tmp_path / "c.exe").write_text("no")
    rows = R.uploads(spark.read.format("binaryFile").load(f"{tmp_path}/*")).collect()
    assert sorted((r.filename, r.text) for r in rows) == [("a.txt", "plain"), ("b.HTML", "rich text")]
    docs = spark.createDataFrame([("First line\nmore",), ("x" * 200,)], "text string")
    assert [r.title for r in R.plain_text(docs).collect()] == ["First line", ""]
    kinds = spark.createDataFrame([(".PDF", ""), ("", "text/html; x"), (".txt", None)], "s string, c string").select(R.by_format(F.col("s"), F.col("c")).alias("k")).collect()
    assert [r.k for r in kinds] == ["pdf", "html", "txt"]


def test_a_target_before_the_first_quarter_fails(spark):
    import pytest

    series = spark.createDataFrame([(1, 8000, 5.0)], "company int, quarter_index int, revenue double")
    assert Q.dense_window(series, spark.createDataFrame([(1, 8003)], "company int, target_index int"), 4).count() == 4
    with pytest.raises(Exception, match="as early as the target"):
        Q.dense_window(series, spark.createDataFrame([(1, 7999)], "company int, target_index int"), 4).collect()


def test_many_items_have_a_best_subset(spark):
    """Sixteen items: beyond what enumerating them all in a row would take; against all subsets."""
    import itertools

    from quartermill.operators import structure as T

    values = [3.0, 5.0, 7.0, 11.0, 13.0, 17.0, 19.0, 23.0, 2.0, 4.0, 6.0, 8.0]
    for n, revenue in ((12, 60.0), (3, 4.0), (1, 100.0), (12, None), (12, 118.0)):
        items = [(f"n{i}", v, i % 2 == 0, i % 5 == 4) for i, v in enumerate(values[:n])]
        best, kept = float("-inf"), items
        for size in range(1, n + 1):
            for own in itertools.combinations(items, size):
                total = sum(x[1] for x in own)
                if revenue and not 0.45 <= total / revenue <= 1.18:
                    continue
                b = sum(x[2] for x in own)
                score = round((1 - abs(revenue - total) / max(revenue, 1.0) if revenue else 0.6) + (0.06 if b in (0, size) else -0.08) + size * 0.03 + b * 0.015 - 0.09 * sum(x[3] for x in own), 9)
                if score > best:
                    best, kept = score, list(own)
        want = [x[0] for x in sorted(kept, key=lambda x: -x[1])] if best > float("-inf") else [x[0] for x in items]
        df = spark.createDataFrame([(1, 1, revenue, items, False)], "company int, quarter_index int, revenue double, items array<struct<name:string,value:double,business:boolean,aggregate:boolean>>, ordered boolean")
        assert [x.name for x in T.best_subset(df).first().kept] == want


def test_annual_less_three_quarters(spark):
    rows = [(1, 8000 + n, v) for n, v in enumerate([100.0, 110.0, 120.0])]
    series = spark.createDataFrame(rows, "company int, quarter_index int, revenue double")
    got = {r.quarter_index: (r.revenue, r.revenue_derived) for r in Q.annual_delta(series, spark.createDataFrame([(1, 8003, 460.0), (1, 8004, 380.0)], "company int, quarter_index int, annual double"), "revenue").collect()}
    assert got[8003] == (130.0, True) and got[8004] == (20.0, True)


def test_full_coverage_rules(spark):
    from quartermill.operators import quality as K

    names = [x.split()[0] for x in K.PAYLOAD.replace("\n", " ").split(", ") if " " in x]
    assert "revenue" in names
    good = dict(revenue=10.0, net_income=1.0, gross_margin=40.0, net_margin=10.0, segments=[(6.0, "segment"), (4.0, "segment")], geographies=[(5.0, ""), (5.0, "")], structure="segment", history_count=12, history_window=12, missing_revenue=0, missing_net_income=0, segment_coverage=1.0, geography_coverage=1.0, qna=3, management=3, evidence=3, quotes=2, materials=[("fetched", 900, "earnings_release"), ("fetched", 900, "sec_filing"), ("cached", 900, "earnings_call")], fallback_lines=0)
    thin = good | dict(segments=[], geographies=[(5.0, "annual_filing")], structure="management", segment_coverage=0.2, geography_coverage=0.96, qna=2, management=1, evidence=1, quotes=0, materials=[("fetched", 900, "investor_relations")], fallback_lines=2)
    schema = "revenue double, net_income double, gross_margin double, net_margin double, segments array<struct<value:double,scope:string>>, geographies array<struct<value:double,scope:string>>, structure string, history_count int, history_window int, missing_revenue int, missing_net_income int, segment_coverage double, geography_coverage double, qna int, management int, evidence int, quotes int, materials array<struct<status:string,text_length:int,role:string>>, fallback_lines int"
    a, b = K.evaluate(spark.createDataFrame([tuple(good.values()), tuple(thin.values())], schema), True).collect()
    assert a.status == "pass" and a.score == 100 and not a.issues
    assert {i.code for i in b.issues if i.code.startswith("full")} == {"full_coverage_structure_mode_management", "full_coverage_segment_missing", "full_coverage_geography_missing", "full_coverage_geography_non_quarterly", "full_coverage_segment_history_incomplete", "full_coverage_qna_sparse", "full_coverage_management_sparse", "full_coverage_evidence_sparse", "full_coverage_source_role_missing_earnings_release", "full_coverage_source_role_missing_sec_filing", "full_coverage_source_role_missing_call_context", "full_coverage_fallback_detected"}
    assert b.status == "fail"


def test_streams_equal_batches(spark, tmp_path):
    source = tmp_path / "in"
    table = spark.read.parquet(f"{DATA}/events.parquet")
    table.repartition(3).write.parquet(str(source))
    E.run_to_table(E.once(E.read_events(spark, str(source))), str(tmp_path / "once"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == table.count()
    E.run_to_table(E.once(E.read_events(spark, str(source))), str(tmp_path / "once"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == table.count()
    E.run_to_table(E.tumbling(E.read_events(spark, str(source))), str(tmp_path / "hours"), str(tmp_path / "c2"))
    stream = {(r.start, r.event_type): (r.n, r.total) for r in spark.read.parquet(str(tmp_path / "hours")).collect()}
    batch = {(r.start, r.event_type): (r.n, r.total) for r in E.tumbling(table).collect()}
    assert stream and all(batch[k] == v for k, v in stream.items())


def test_halves_meet_at_the_best_of_all():
    """Fifteen items against all subsets, ties and outer items included; forty items in a bounded time and memory."""
    import itertools
    import random
    import time

    from quartermill.functions import subsets as S

    def plain(v, b, a, target):
        best, kept = None, None
        for size in range(1, len(v) + 1):
            for own in itertools.combinations(range(len(v)), size):
                total, k = sum(v[i] for i in own), sum(b[i] for i in own)
                if target and not 0.45 <= total / target <= 1.18:
                    continue
                score = round((1 - abs(target - total) / max(target, 1.0) if target else 0.6) + (0.06 if k in (0, size) else -0.08) + size * 0.03 + k * 0.015 - 0.09 * sum(a[i] for i in own), 9)
                if best is None or score > best:
                    best, kept = score, list(own)
        return kept

    rng, half = random.Random(3), S.HALF
    for trial in range(40):
        n = 15 if trial == 0 else rng.randint(1, 10)
        v = [rng.choice([float(rng.randint(1, 9)), rng.random() * 20 + 0.1]) for _ in range(n)]
        b, a = [rng.random() < 0.5 for _ in v], [rng.random() < 0.2 for _ in v]
        target = rng.choice([None, sum(v) * rng.random() * 1.4 + 0.01, float(rng.randint(1, 40))])
        try:
            S.HALF = rng.choice([half, 3])  # more items than two halves hold
            assert S.best_of(v, b, a, target) == plain(v, b, a, target)
        finally:
            S.HALF = half
    v = [rng.random() * 30 + 0.1 for _ in range(40)]
    began = time.perf_counter()
    assert S.best_of(v, [i % 2 == 0 for i in range(40)], [i % 7 == 3 for i in range(40)], sum(v) / 2)
    assert time.perf_counter() - began < 10


def test_label_automaton_finds_first_places(spark):
    """First places of labels within one another, ignoring case and the kind of white space, as a pattern finds them."""
    import re

    from pyspark.sql import functions as F

    from quartermill.functions import issuers as I

    labels = ["Revenue", "Net  revenue", "Total net revenue", "İncome", "Sam’s Club", "absent"]
    texts = ["total NET revenue 5", "revenues\tnet\n revenue", "", None, "x İncome İncome Sam’s  Club REVENUE", "netrevenue é Net Revenue"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("flat", F.regexp_replace("text", r"\s+", " "))
    for r in df.select("flat", I.first_places(labels)(F.col("flat")).alias("places")).collect():
        for label, place in zip(labels, r.places):
            found = re.search(r"\s+".join(map(re.escape, label.split())), r.flat or "", re.I | re.A)
            assert place == (found.start() + 1 if found else 0), (label, r)
    assert set(I.labels_of(I.ISSUERS["apple"])) >= {"iPhone", "Services", "Total net sales"}
