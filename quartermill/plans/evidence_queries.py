"""Queries of what a report says from parsed facts, with their SQL. A part is a quarter; its columns choose which facts are there."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartermill.operators import evidence as E
from quartermill.plans.base import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(fn):
        QUERIES[name], ORACLES[name] = fn, oracle
        return fn

    return add


def _facts(spark, d):
    """Facts of every part. Revenue is a multiple of 7 and values of segments aren't, so that no share is a tie of its last digit."""
    e = F.expr
    segments = e("slice(array('Cloud', 'Devices', 'Ads'), 1, cast(k % 4 as int))")
    made = F.transform(segments, lambda n, i: F.struct(n.alias("name"), ((F.col("k") * (i + 1)) % 5 + 0.3).cast("double").alias("value"), F.when((F.col("k") + i) % 3 != 0, (F.col("k") * 7 + i * 11) % 80 - 30 + 0.1).cast("double").alias("yoy")))
    region = e("CASE WHEN k % 3 != 1 THEN array(named_struct('name', 'Asia', 'value', cast(s % 7 + 0.2 as double), 'yoy', cast(null as double)), named_struct('name', 'Europe', 'value', cast(s % 5 + 1.2 as double), 'yoy', cast(null as double))) END")
    number = lambda when, value: e(f"cast(CASE WHEN {when} THEN {value} END as double)")
    base = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("s"), "p_name", "p_type")
    return base.select(
        "k", number("k % 11 != 0", "s * 7").alias("revenue"), number("k % 4 != 0", "k % 61 - 25 + 0.2").alias("revenue_yoy"), number("k % 5 < 2", "s % 6 + 0.4").alias("operating_income"),
        number("k % 3 != 0", "s % 9 + 0.3").alias("net_income"), number("k % 5 != 0", "k % 37 - 18 + 0.4").alias("net_income_yoy"), number("k % 6 != 0", "k % 70 + 0.1").alias("gross_margin"),
        number("k % 8 != 0", "k % 9 + 0.25").alias("eps"), number("k % 3 = 1", "k % 21 - 9 + 0.6").alias("eps_yoy"), number("k % 7 > 1", "k % 13 + 0.2").alias("operating_cash"), number("k % 2 = 0", "k % 17 + 0.6").alias("free_cash"),
        made.alias("segments"), region.alias("geographies"), e("element_at(array('official', 'official_context', 'proxy'), cast(k % 3 + 1 as int))").alias("mode"),
        e("CASE k % 4 WHEN 1 THEN concat(' ', p_name, ' ') WHEN 2 THEN '   ' WHEN 3 THEN p_name END").alias("commentary"), e("CASE WHEN k % 5 = 0 THEN p_type END").alias("driver"),
        number("k % 7 != 3", "s % 11 - 5 + 0.3").alias("revenue_qoq"), e("CASE WHEN k % 9 = 0 THEN array(named_struct('label', '总量成长节奏', 'score', 90, 'note', 'given'), named_struct('label', '', 'score', 1, 'note', 'none')) END").alias("given"),
    )


#: One fact a column, the same as _facts; seg: place, name, value, yoy of each segment.
_FACTS_SQL = """WITH p AS (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s, p_name, p_type FROM part),
f AS (SELECT k, s, CAST(CASE WHEN k % 11 != 0 THEN s * 7 END AS DOUBLE) AS revenue, CAST(CASE WHEN k % 4 != 0 THEN k % 61 - 25 + 0.2 END AS DOUBLE) AS yoy, CAST(CASE WHEN k % 5 < 2 THEN s % 6 + 0.4 END AS DOUBLE) AS oi,
 CAST(CASE WHEN k % 3 != 0 THEN s % 9 + 0.3 END AS DOUBLE) AS ni, CAST(CASE WHEN k % 5 != 0 THEN k % 37 - 18 + 0.4 END AS DOUBLE) AS ny, CAST(CASE WHEN k % 6 != 0 THEN k % 70 + 0.1 END AS DOUBLE) AS gm,
 CAST(CASE WHEN k % 8 != 0 THEN k % 9 + 0.25 END AS DOUBLE) AS eps, CAST(CASE WHEN k % 3 = 1 THEN k % 21 - 9 + 0.6 END AS DOUBLE) AS ey, CAST(CASE WHEN k % 7 > 1 THEN k % 13 + 0.2 END AS DOUBLE) AS ocf, CAST(CASE WHEN k % 2 = 0 THEN k % 17 + 0.6 END AS DOUBLE) AS fcf,
 CASE WHEN k % 3 != 1 THEN CASE WHEN s % 7 + 0.2 >= s % 5 + 1.2 THEN 'Asia' ELSE 'Europe' END END AS geo, k % 3 = 0 AS official, k % 3 = 1 AS context, CASE k % 4 WHEN 1 THEN trim(p_name) WHEN 3 THEN trim(p_name) END AS said, CASE WHEN k % 5 = 0 THEN p_type END AS driver,
 CAST(CASE WHEN k % 7 != 3 THEN s % 11 - 5 + 0.3 END AS DOUBLE) AS qoq FROM p),
seg AS (SELECT k, i, (['Cloud', 'Devices', 'Ads'])[i + 1] AS name, CAST((k * (i + 1)) % 5 + 0.3 AS DOUBLE) AS value, CAST(CASE WHEN (k + i) % 3 != 0 THEN (k * 7 + i * 11) % 80 - 30 + 0.1 END AS DOUBLE) AS growth FROM p, (SELECT unnest([0, 1, 2]) AS i) WHERE i < k % 4),
tops AS (SELECT k, i AS ti, name AS tn, value AS tv FROM seg QUALIFY row_number() OVER (PARTITION BY k ORDER BY value DESC, i) = 1),
fasts AS (SELECT k, i AS fi, name AS fn, value AS fv, growth AS fg FROM seg WHERE growth IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY growth DESC, i) = 1),
a AS (SELECT *, tv / nullif(revenue, 0) * 100 AS share FROM f LEFT JOIN tops USING (k) LEFT JOIN fasts USING (k))"""


def _cash(x: str) -> str:
    return f"coalesce(printf('$%.1fB', {x}), '-')"


def _pct(x: str, sign: str = "+") -> str:
    return f"coalesce(printf('%{sign}.1f%%', {x}), '-')"


def _rows(kind: str, most: int, *themes: tuple[str, str, str, str]) -> str:
    """Candidates of a kind in order: condition, label, score and note of each."""
    own = " UNION ALL ".join(f"SELECT k, '{kind}' AS kind, {most} AS most, {n} AS spot, {label} AS label, CAST({score} AS DOUBLE) AS score, {note} AS note FROM a WHERE {when}" for n, (when, label, score, note) in enumerate(themes, 1))
    return own


_THEMES = " UNION ALL ".join((
    "SELECT k, 'management', 4, 0, '总量成长节奏', 90::DOUBLE, 'given' FROM a WHERE k % 9 = 0",
    _rows("management", 4,
        ("fn IS NOT NULL", "fn || ' 增长弹性'", "84 + least(greatest(fg * 0.12, 0), 10)", f"fn || ' 收入 ' || {_cash('fv')} || '，同比 ' || {_pct('fg')} || '。'"),
        ("share IS NOT NULL", "'结构重心'", "76", f"tn || ' 占当季收入 ' || {_pct('share', '')} || '，仍是阅读本季财报的第一锚点。'"),
        ("revenue IS NOT NULL AND yoy IS NOT NULL", "'总量成长节奏'", "72 + least(abs(yoy) * 0.2, 12)", f"'当季收入 ' || {_cash('revenue')} || '，同比 ' || {_pct('yoy')} || '。'"),
        ("gm IS NOT NULL", "'利润质量'", "74 + least(gm * 0.18, 12)", f"CASE WHEN ocf IS NULL THEN '官方材料对应毛利率 ' || {_pct('gm', '')} || '。' ELSE '毛利率 ' || {_pct('gm', '')} || '，经营现金流 ' || {_cash('ocf')} || '。' END"),
        ("ni IS NOT NULL AND ny IS NOT NULL", "'利润兑现'", "74 + least(abs(ny) * 0.12, 10)", f"'净利润 ' || {_cash('ni')} || '，同比 ' || {_pct('ny')} || '。'"),
        ("geo IS NOT NULL", "'地区需求重心'", "68", "'已披露地区结构中，' || geo || ' 是当前最大区域收入池，反映公司本季主要需求落点。'"),
        ("said IS NOT NULL", "'管理层展望'", "72", "said")),
    _rows("questions", 4,
        ("tn IS NOT NULL", "tn || ' 可持续性'", "78", "'头部业务 ' || tn || ' 体量最大，市场会追问其需求和收入贡献能否继续延续。'"),
        ("fn IS NOT NULL AND fi != ti", "fn || ' 加速来源'", "74", f"fn || ' 同比 ' || {_pct('fg')} || '，需要继续拆分增长来自 volume、pricing 还是新产品/AI 供给。'"),
        ("yoy IS NOT NULL", "'增长可持续性'", "70", f"'本季收入同比 ' || {_pct('yoy')} || '，市场会继续追问增长是阶段性抬升还是新中枢形成。'"),
        ("ocf IS NOT NULL OR fcf IS NOT NULL", "'现金兑现强度'", "70", f"CASE WHEN ocf IS NULL THEN '自由' ELSE '经营' END || '现金流达到 ' || {_cash('coalesce(ocf, fcf)')} || '，后续问答会继续围绕资本开支、现金回流和利润兑现展开。'"),
        ("geo IS NOT NULL", "'区域需求分化'", "66", "'地区披露显示 ' || geo || ' 贡献最高，后续问答会继续追踪不同区域的景气差异。'"),
        ("said IS NOT NULL", "CASE WHEN official THEN '指引兑现度' ELSE '官方展望与经营基线' END", "CASE WHEN official THEN 82 ELSE 72 END", "said")),
    _rows("risks", 3,
        ("share >= 40", "tn || ' 集中度风险'", "70", f"tn || ' 占收入约 ' || {_pct('share', '')} || '，一旦需求或供给节奏变化，会直接放大对整体收入与利润的影响。'"),
        ("yoy < 0", "'收入增速回落'", "68", f"'当季收入同比 ' || {_pct('yoy')} || '，若回落延续，会先体现在结构页和经营杠杆页。'"),
        ("gm < 25", "'利润率波动'", "68", f"'当前毛利率 ' || {_pct('gm', '')} || '，若价格、成本或产品结构承压，利润弹性会先受到影响。'"),
        ("ny < 0", "'利润兑现承压'", "66", f"'净利润同比 ' || {_pct('ny')} || '，意味着经营杠杆或费用控制仍需继续观察。'"),
        ("said IS NOT NULL AND official", "'指引下沿压力'", "66", "said")),
    _rows("catalysts", 3,
        ("fg > 0", "fn || ' 延续高增'", "84", f"fn || ' 本季达到 ' || {_cash('fv')} || '，若高增延续，会继续抬高整体结构质量。'"),
        ("yoy > 0", "'总量增长延续'", "76", f"'收入同比 ' || {_pct('yoy')} || '，若需求与订单节奏继续维持，TTM 增速有望进一步抬升。'"),
        ("ocf IS NOT NULL", "'现金流兑现'", "76", f"'经营现金流 ' || {_cash('ocf')} || '，意味着业绩改善更容易转化为估值韧性。'"),
        ("said IS NOT NULL", "CASE WHEN official THEN '官方指引支撑' ELSE '管理层积极语境' END", "CASE WHEN official THEN 78 ELSE 70 END", "said")),
))


@query("fact_themes", _FACTS_SQL + f""", t(k, kind, most, spot, label, score, note) AS ({_THEMES}), u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY k, kind, label ORDER BY spot) = 1),
v AS (SELECT *, row_number() OVER (PARTITION BY k, kind ORDER BY spot) AS place FROM u)
SELECT k AS p_partkey, kind, CAST(place AS INTEGER) AS place, label, CAST(greatest(32, least(98, round_even(score, 0))) AS INTEGER) AS score, note FROM v WHERE place <= most""")
def fact_themes(spark, d):
    kinds = ("management", "questions", "risks", "catalysts")
    made = E.with_themes(_facts(spark, d), "k", given={"management": "given"})
    every = F.array(*(F.struct(F.lit(n).alias("kind"), F.col(n).alias("themes")) for n in kinds))
    rows = made.select("k", F.explode(every).alias("e")).select("k", "e.kind", F.posexplode("e.themes").alias("place", "t"))
    return rows.select(F.col("k").alias("p_partkey"), "kind", (F.col("place") + 1).alias("place"), "t.label", "t.score", "t.note")


@query("fact_cards", _FACTS_SQL + f""", l AS (SELECT k, string_agg(name || ' ' || {_cash('value')} || CASE WHEN growth IS NOT NULL THEN '，同比 ' || {_pct('growth')} ELSE '' END, '；' ORDER BY value DESC, i) AS three,
 string_agg(CASE WHEN n <= 2 THEN name || ' ' || {_cash('value')} || CASE WHEN growth IS NOT NULL THEN '（同比 ' || {_pct('growth')} || '）' ELSE '' END END, '、' ORDER BY value DESC, i) AS two FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY value DESC, i) AS n FROM seg) GROUP BY k),
c AS (SELECT *, CASE WHEN ocf IS NOT NULL THEN '经营现金流 ' || {_cash('ocf')} WHEN fcf IS NOT NULL THEN '自由现金流 ' || {_cash('fcf')} END AS flow, '毛利率 ' || printf('%.1f%%', gm) AS m FROM a LEFT JOIN l USING (k)),
q AS (SELECT *, concat_ws('；', m, 'GAAP EPS ' || printf('%.2f', eps), flow) AS quality, concat_ws('；', m, 'EPS ' || printf('%.2f', eps) || coalesce('，同比 ' || printf('%+.1f%%', ey), ''), coalesce(flow, '经营利润 ' || printf('$%.1fB', oi))) AS how, '收入 ' || {_cash('revenue')} || '，同比 ' || {_pct('yoy')} AS total FROM c),
r AS (SELECT k, list_filter([CASE WHEN revenue IS NOT NULL THEN '季度结果|' || concat_ws('，', '当季收入 ' || {_cash('revenue')}, '经营利润 ' || printf('$%.1fB', oi), '净利润 ' || printf('$%.1fB', ni)) || '。' END, '结构与驱动|' || three || '。', '展望与管理层语境|' || said, CASE WHEN quality != '' THEN '盈利与现金质量|' || quality || '。' END], lambda x: x IS NOT NULL)[1:3] AS cards,
 list_filter([CASE WHEN revenue IS NOT NULL THEN total || coalesce('；核心结构由 ' || two || ' 支撑', '') || '。' END, CASE WHEN how != '' THEN how || '。' END, coalesce(said, driver)], lambda x: x IS NOT NULL) AS lines FROM q)
SELECT k AS p_partkey, array_to_string(cards, '/') AS cards, array_to_string(lines, '/') AS takeaways FROM r""")
def fact_cards(spark, d):
    made = E.with_cards(_facts(spark, d), "k")
    return made.select(F.col("k").alias("p_partkey"), F.array_join(F.transform("cards", lambda x: F.concat_ws("|", x["title"], x["text"])), "/").alias("cards"), F.array_join("takeaways", "/").alias("takeaways"))


@query("layered_takeaways", _FACTS_SQL + f""", b AS (SELECT *, CASE WHEN k % 5 != 0 THEN 91.0::DOUBLE END AS br, CASE WHEN k % 7 != 0 THEN 30.4::DOUBLE END AS bm, CASE WHEN k % 2 = 0 THEN 99.1::DOUBLE END AS guided, CASE WHEN k % 13 = 0 THEN 'Guided' END AS comparison FROM a),
n AS (SELECT *, concat_ws('；', '本季相对近四季收入中枢 ' || printf('%+.1f%%', (nullif(revenue, 0) / br - 1) * 100), CASE WHEN guided IS NOT NULL AND revenue != 0 THEN coalesce(comparison, CASE WHEN official THEN '下一季收入指引' ELSE '下一阶段收入参考' END) || '较本季 ' || {_pct('(guided / revenue - 1) * 100')} WHEN said IS NOT NULL THEN said END) AS nx FROM b)
SELECT k AS p_partkey, concat_ws('，', '收入 ' || {_cash('revenue')}, '净利润 ' || printf('$%.1fB', ni), CASE WHEN yoy IS NOT NULL OR qoq IS NOT NULL THEN '同比 ' || {_pct('yoy')} || ' / 环比 ' || {_pct('qoq')} END) || '。' AS happened,
 concat_ws('；', concat_ws('，', '毛利率 ' || {_pct('gm', '')}, '相对近四季中枢 ' || printf('%+.1f%%', gm - bm)), CASE WHEN tn IS NOT NULL AND revenue != 0 THEN tn || ' 占当季收入 ' || {_pct('share', '')} WHEN geo IS NOT NULL THEN '地区侧以 ' || geo || ' 为最大暴露' END) || '。' AS why,
 CASE WHEN nx = '' THEN '继续跟踪下一阶段收入基线、利润率方向与管理层语气是否同步改善。' ELSE nx || '。' END AS following, CASE WHEN official THEN '下一阶段收入口径与管理层语气' WHEN context THEN '官方展望语境与经营基线' ELSE '经营基线、收入中枢与利润率方向' END AS verification FROM n""")
def layered_takeaways(spark, d):
    e = F.expr
    facts = E.prepared(_facts(spark, d)).withColumns({"margin": F.col("gross_margin"), "margin_label": F.lit("毛利率"), "baseline_revenue": e("CASE WHEN k % 5 != 0 THEN 91.0D END"), "baseline_margin": e("CASE WHEN k % 7 != 0 THEN 30.4D END"), "guided": e("CASE WHEN k % 2 = 0 THEN 99.1D END"), "comparison": e("CASE WHEN k % 13 = 0 THEN 'Guided' END"), "commentary": F.col("said")})
    made = facts.select(F.col("k").alias("p_partkey"), E.layered_takeaways().alias("t"))
    return made.select("p_partkey", F.col("t")[0]["body"].alias("happened"), F.col("t")[1]["body"].alias("why"), F.col("t")[2]["body"].alias("following"), F.col("t")[2]["verification"].alias("verification"))
