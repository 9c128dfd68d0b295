"""What a report says from one quarter's parsed facts: themes with notes, evidence cards, takeaways in layers and their headline.

Facts are a row a quarter: revenue, revenue_yoy, operating_income, net_income, net_income_yoy, gross_margin, eps, eps_yoy,
operating_cash, free_cash (double); segments, geographies (array<struct<name, value, yoy>>, empty or null for none); mode,
commentary (of guidance), driver (string). Any of them may be null. Everything is an expression on a row, so no shuffle.
Scores, thresholds and words are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartermill.functions.numbers import clamped_score, money, percent
from quartermill.functions.text import excerpt

THEME = "struct<label:string, score:int, note:string>"
CARD = "struct<title:string, text:string, source:string>"
#: Characters that are cut off both ends of a phrase, and words that tell figures.
EDGES = " 。；;，,"
FIGURES = ("收入", "净利润", "经营利润", "同比", "EPS")


def ranked(items: Column, field: str = "value") -> Column:
    """Items by a field, largest first, equals in their order; a null counts as 0, a null array as empty."""
    keyed = F.transform(F.coalesce(items, F.array().cast("array<struct<name:string, value:double, yoy:double>>")), lambda x, i: F.struct((-F.coalesce(x[field], F.lit(0.0))).alias("by"), i.alias("at"), x.alias("item")))
    return F.transform(F.array_sort(keyed), lambda x: x["item"])


def text_of(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def theme(when: Column, label: Column | str, score: Column | float, note: Column) -> Column:
    """A theme where the condition holds, null elsewhere."""
    made = F.struct(text_of(label).alias("label"), clamped_score(F.lit(score) if isinstance(score, (int, float)) else score).alias("score"), F.trim(note).alias("note"))
    return F.when(when, made.cast(THEME))


def first_of_each_label(given: Column | None, own: list[Column], most: int) -> Column:
    """The given themes, then own ones; of equal labels the first, without empty ones, `most` at most."""
    every = F.array_compact(F.array(*own))
    every = every if given is None else F.concat(F.coalesce(given, F.array().cast(f"array<{THEME}>")), every)
    labels = F.transform(every, lambda x: F.coalesce(x["label"], F.lit("")))
    return F.slice(F.filter(every, lambda x, i: (F.coalesce(x["label"], F.lit("")) != "") & (F.array_position(labels, x["label"]) == i + 1)), 1, most)


def prepared(facts: DataFrame) -> DataFrame:
    """With the largest and fastest segment, the largest geography and trimmed guidance."""
    by_value = ranked(F.col("segments"))
    growing = ranked(F.filter(F.coalesce("segments", F.array().cast("array<struct<name:string, value:double, yoy:double>>")), lambda x: x["yoy"].isNotNull()), "yoy")
    made = facts.withColumns({"by_value": by_value, "fastest": F.get(growing, 0), "region": F.get(ranked(F.col("geographies")), 0), "said": F.nullif(F.trim(F.coalesce("commentary", F.lit(""))), F.lit(""))})
    top = made.withColumn("top", F.get("by_value", 0))
    return top.withColumn("share", F.col("top.value") / F.nullif(F.col("revenue"), F.lit(0.0)) * 100)


def with_themes(facts: DataFrame, *keys: str, symbol: str = "$", given: dict[str, str] | None = None) -> DataFrame:
    """keys, management, questions (4 at most), risks and catalysts (3 at most): arrays of label, score, note.

    given: for each of these names a column of themes that go first.
    """
    c, given = F.col, given or {}
    has = lambda *names: F.expr(" AND ".join(f"{n} IS NOT NULL" for n in names))
    between = lambda x, most: F.least(F.greatest(x, F.lit(0.0)), F.lit(float(most)))
    official, cash = F.coalesce(c("mode") == "official", F.lit(False)), lambda v: money(v, symbol)
    fast, top, yoy, said = c("fastest"), c("top"), c("revenue_yoy"), c("said")
    fast_yoy = percent(fast["yoy"], True)
    management = [
        theme(fast.isNotNull(), text_of(fast["name"], " 增长弹性"), 84 + between(fast["yoy"] * 0.12, 10), text_of(fast["name"], " 收入 ", cash(fast["value"]), "，同比 ", fast_yoy, "。")),
        theme(has("share"), "结构重心", 76, text_of(top["name"], " 占当季收入 ", percent(c("share")), "，仍是阅读本季财报的第一锚点。")),
        theme(has("revenue", "revenue_yoy"), "总量成长节奏", 72 + between(F.abs(yoy) * 0.2, 12), text_of("当季收入 ", cash(c("revenue")), "，同比 ", percent(yoy, True), "。")),
        theme(has("gross_margin"), "利润质量", 74 + between(c("gross_margin") * 0.18, 12), F.when(c("operating_cash").isNull(), text_of("官方材料对应毛利率 ", percent(c("gross_margin")), "。")).otherwise(text_of("毛利率 ", percent(c("gross_margin")), "，经营现金流 ", cash(c("operating_cash")), "。"))),
        theme(has("net_income", "net_income_yoy"), "利润兑现", 74 + between(F.abs(c("net_income_yoy")) * 0.12, 10), text_of("净利润 ", cash(c("net_income")), "，同比 ", percent(c("net_income_yoy"), True), "。")),
        theme(has("region"), "地区需求重心", 68, text_of("已披露地区结构中，", c("region.name"), " 是当前最大区域收入池，反映公司本季主要需求落点。")),
        theme(has("said"), "管理层展望", 72, said),
    ]
    flow = F.when(c("operating_cash").isNotNull(), "经营现金流").otherwise("自由现金流")
    questions = [
        theme(top.isNotNull(), text_of(top["name"], " 可持续性"), 78, text_of("头部业务 ", top["name"], " 体量最大，市场会追问其需求和收入贡献能否继续延续。")),
        theme(fast.isNotNull() & ~fast.eqNullSafe(top), text_of(fast["name"], " 加速来源"), 74, text_of(fast["name"], " 同比 ", fast_yoy, "，需要继续拆分增长来自 volume、pricing 还是新产品/AI 供给。")),
        theme(has("revenue_yoy"), "增长可持续性", 70, text_of("本季收入同比 ", percent(yoy, True), "，市场会继续追问增长是阶段性抬升还是新中枢形成。")),
        theme(c("operating_cash").isNotNull() | c("free_cash").isNotNull(), "现金兑现强度", 70, text_of(flow, "达到 ", cash(F.coalesce(F.nullif(c("operating_cash"), F.lit(0.0)), c("free_cash"))), "，后续问答会继续围绕资本开支、现金回流和利润兑现展开。")),
        theme(has("region"), "区域需求分化", 66, text_of("地区披露显示 ", c("region.name"), " 贡献最高，后续问答会继续追踪不同区域的景气差异。")),
        theme(has("said"), F.when(official, "指引兑现度").otherwise("官方展望与经营基线"), F.when(official, 82.0).otherwise(72.0), said),
    ]
    risks = [
        theme(c("share") >= 40, text_of(top["name"], " 集中度风险"), 70, text_of(top["name"], " 占收入约 ", percent(c("share")), "，一旦需求或供给节奏变化，会直接放大对整体收入与利润的影响。")),
        theme(yoy < 0, "收入增速回落", 68, text_of("当季收入同比 ", percent(yoy, True), "，若回落延续，会先体现在结构页和经营杠杆页。")),
        theme(c("gross_margin") < 25, "利润率波动", 68, text_of("当前毛利率 ", percent(c("gross_margin")), "，若价格、成本或产品结构承压，利润弹性会先受到影响。")),
        theme(c("net_income_yoy") < 0, "利润兑现承压", 66, text_of("净利润同比 ", percent(c("net_income_yoy"), True), "，意味着经营杠杆或费用控制仍需继续观察。")),
        theme(has("said") & official, "指引下沿压力", 66, said),
    ]
    catalysts = [
        theme(fast["yoy"] > 0, text_of(fast["name"], " 延续高增"), 84, text_of(fast["name"], " 本季达到 ", cash(fast["value"]), "，若高增延续，会继续抬高整体结构质量。")),
        theme(yoy > 0, "总量增长延续", 76, text_of("收入同比 ", percent(yoy, True), "，若需求与订单节奏继续维持，TTM 增速有望进一步抬升。")),
        theme(has("operating_cash"), "现金流兑现", 76, text_of("经营现金流 ", cash(c("operating_cash")), "，意味着业绩改善更容易转化为估值韧性。")),
        theme(has("said"), F.when(official, "官方指引支撑").otherwise("管理层积极语境"), F.when(official, 78.0).otherwise(70.0), said),
    ]
    made = {"management": (management, 4), "questions": (questions, 4), "risks": (risks, 3), "catalysts": (catalysts, 3)}
    return prepared(facts).select(*keys, *(first_of_each_label(F.col(given[n]) if n in given else None, own, most).alias(n) for n, (own, most) in made.items()))


def _share_text(items: Column, most: int, begin: str, end: str, between: str, symbol: str) -> Column:
    """Names with value and growth of the first items."""
    return F.array_join(F.transform(F.slice(items, 1, most), lambda x: text_of(x["name"], " ", money(x["value"], symbol), F.when(x["yoy"].isNotNull(), text_of(begin, percent(x["yoy"], True), end)).otherwise(""))), between)


def with_cards(facts: DataFrame, *keys: str, symbol: str = "$", source: str = "Official materials") -> DataFrame:
    """keys, cards (title, text, source; 3 at most) and takeaways (3 sentences at most)."""
    c, cash = F.col, lambda n: money(F.col(n), symbol)
    known = lambda n, *parts: F.when(F.col(n).isNotNull(), text_of(*parts))
    card = lambda when, title, text: F.when(when, F.struct(F.lit(title).alias("title"), text.alias("text"), F.lit(source).alias("source")).cast(CARD))
    margin = known("gross_margin", "毛利率 ", percent(c("gross_margin")))
    flow = F.coalesce(known("operating_cash", "经营现金流 ", cash("operating_cash")), known("free_cash", "自由现金流 ", cash("free_cash")))
    eps = F.format_string("%.2f", c("eps"))
    result = text_of(F.concat_ws("，", text_of("当季收入 ", cash("revenue")), known("operating_income", "经营利润 ", cash("operating_income")), known("net_income", "净利润 ", cash("net_income"))), "。")
    first = F.array_compact(F.array(
        card(c("revenue").isNotNull(), "季度结果", result),
        card(F.size("by_value") > 0, "结构与驱动", text_of(_share_text(c("by_value"), 3, "，同比 ", "", "；", symbol), "。")),
        card(c("said").isNotNull(), "展望与管理层语境", c("said")),
    ))
    quality = F.nullif(F.concat_ws("；", margin, known("eps", "GAAP EPS ", eps), flow), F.lit(""))
    cards = F.slice(F.concat(first, F.array_compact(F.array(card(quality.isNotNull(), "盈利与现金质量", text_of(quality, "。"))))), 1, 3)
    total = text_of("收入 ", cash("revenue"), "，同比 ", percent(c("revenue_yoy"), True))
    what = F.when(c("revenue").isNotNull(), F.when(F.size("by_value") > 0, text_of(total, "；核心结构由 ", _share_text(c("by_value"), 2, "（同比 ", "）", "、", symbol), " 支撑。")).otherwise(text_of(total, "。")))
    per_share = known("eps", F.concat_ws("，", text_of("EPS ", eps), known("eps_yoy", "同比 ", percent(c("eps_yoy"), True))))
    how = F.nullif(F.concat_ws("；", margin, per_share, F.coalesce(flow, known("operating_income", "经营利润 ", cash("operating_income")))), F.lit(""))
    lines = F.array_compact(F.array(what, F.when(how.isNotNull(), text_of(how, "。")), F.coalesce(c("said"), F.nullif(c("driver"), F.lit("")))))
    return prepared(facts).select(*keys, cards.alias("cards"), lines.alias("takeaways"))


def bare(text: Column) -> Column:
    """One space for white space, and no marks at the ends; null where nothing is left."""
    return F.nullif(F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(EDGES)), F.lit(""))


def _tells(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def summary_driver(text: Column, english: Column, name: Column, fiscal: Column) -> Column:
    """What a headline says besides the company and its figures; null for a short line of figures or for nothing.

    At the first of the company's names that stands in the text, what is ahead of it is taken if it has six characters or more,
    else what is behind it if that tells no figures; if neither, the next name is tried, and the whole text is taken at last.
    """
    whole = bare(text)
    found = F.lit(None).cast("string")
    for marker in (name, english, F.concat(name, F.lit(" "), fiscal), F.concat(english, fiscal), F.concat(english, F.lit(" "), fiscal)):
        at = F.call_function("locate", marker, whole)
        left = F.btrim(F.substring(whole, F.lit(1), at - 1), F.lit(EDGES))
        right = F.btrim(F.substring(whole, at + F.length(marker), F.length(whole)), F.lit(EDGES))
        own = F.when(F.length(left) >= 6, left).when((right != "") & ~_tells(right, (*FIGURES, "现金流")), right)
        found = F.coalesce(F.when((at > 0) & (marker != ""), own), found)
    picked = F.coalesce(found, whole)
    return F.when(~(_tells(picked, FIGURES) & (F.length(picked) < 18)), picked)


def layered_takeaways(symbol: str = "$") -> Column:
    """array<struct<title, body, verification>> of three layers: what happened, why it matters, what comes next.

    Reads revenue, revenue_yoy, revenue_qoq, net_income, margin, margin_label, baseline_revenue, baseline_margin (means of the
    last four quarters), top (the largest segment), region (the largest geography), mode, guided (revenue), commentary,
    comparison (a label of the guided revenue). A null figure leaves its clause out.
    """
    c, cash = F.col, lambda n: money(F.col(n), symbol)
    base = F.nullif(c("revenue"), F.lit(0.0))
    grown = F.when(c("revenue_yoy").isNotNull() | c("revenue_qoq").isNotNull(), text_of("同比 ", percent(c("revenue_yoy"), True), " / 环比 ", percent(c("revenue_qoq"), True)))
    happened = text_of(F.concat_ws("，", text_of("收入 ", cash("revenue")), F.when(c("net_income").isNotNull(), text_of("净利润 ", cash("net_income"))), grown), "。")
    level = F.concat_ws("，", text_of(c("margin_label"), " ", percent(c("margin"))), F.when(c("margin").isNotNull() & c("baseline_margin").isNotNull(), text_of("相对近四季中枢 ", percent(c("margin") - c("baseline_margin"), True))))
    weight = F.when(c("top").isNotNull() & base.isNotNull(), text_of(c("top.name"), " 占当季收入 ", percent(F.coalesce("top.value", F.lit(0.0)) / base * 100))).when(c("region").isNotNull(), text_of("地区侧以 ", c("region.name"), " 为最大暴露"))
    why = F.concat_ws("；", level, weight)
    stop = lambda x: F.when(x.endswith("。"), x).otherwise(F.concat(x, F.lit("。")))
    official = F.coalesce(c("mode") == "official", F.lit(False))
    against = F.when(base.isNotNull(), text_of("本季相对近四季收入中枢 ", percent((base / F.nullif(c("baseline_revenue"), F.lit(0.0)) - 1) * 100, True)))
    against = F.when(F.nullif(c("baseline_revenue"), F.lit(0.0)).isNotNull(), against)
    label = F.coalesce(F.nullif(c("comparison"), F.lit("")), F.when(official, "下一季收入指引").otherwise("下一阶段收入参考"))
    ahead = F.when(c("guided").isNotNull() & base.isNotNull(), text_of(label, "较本季 ", percent((c("guided") / base - 1) * 100, True))).when(F.coalesce("commentary", F.lit("")) != "", excerpt(c("commentary"), 84))
    following = F.nullif(F.concat_ws("；", against, F.nullif(ahead, F.lit(""))), F.lit(""))
    then = F.when(following.isNotNull(), stop(following)).otherwise("继续跟踪下一阶段收入基线、利润率方向与管理层语气是否同步改善。")
    checked = F.when(official, "下一阶段收入口径与管理层语气").when(c("mode") == "official_context", "官方展望语境与经营基线").otherwise("经营基线、收入中枢与利润率方向")
    layer = lambda title, body, by: F.struct(F.lit(title).alias("title"), body.alias("body"), by.alias("verification"))
    return F.array(layer("发生了什么", happened, F.lit("收入、净利润与同比/环比")), layer("为什么重要", stop(why), F.lit("利润率、头部结构占比与近四季中枢")), layer("接下来怎么看", then, checked))
