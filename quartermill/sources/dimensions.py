"""Static dimensions: the companies, their names, filers, calendars and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "company string, name string, ticker string, cik string, display_order int, currency string, money_symbol string, year_end_month int, quarter_mode string, release_forms array<string>, filing_forms array<string>, segments array<string>, aliases map<string,string>, former_filers array<struct<through:string,cik:string>>"
_US = (["8-K"], ["10-Q", "10-K"])
#: Id, name, ticker, filer, last month of the fiscal year, how quarters are labelled, forms of releases and filings, segments in order.
COMPANIES = (
    ("nvidia", "NVIDIA", "NVDA", "0001045810", 1, "natural", _US, ["Data Center", "Gaming", "Professional Visualization", "Automotive", "OEM and Other"]),
    ("apple", "Apple", "AAPL", "0000320193", 9, "natural", _US, ["iPhone", "Mac", "iPad", "Wearables, Home and Accessories", "Services", "Products"]),
    ("alphabet", "Alphabet", "GOOGL", "0001652044", 12, "natural", _US, ["Google properties", "Google Services", "Google Search & other", "YouTube ads", "Google Network", "Google other", "Google subscriptions, platforms, and devices", "Google Cloud", "Other Bets"]),
    ("microsoft", "Microsoft", "MSFT", "0000789019", 6, "natural", _US, ["Productivity and Business Processes", "Intelligent Cloud", "More Personal Computing"]),
    ("amazon", "Amazon", "AMZN", "0001018724", 12, "natural", _US, ["North America", "International", "AWS", "Online stores", "Third-party seller services", "Advertising services", "Subscription services", "Physical stores", "Other"]),
    ("tsmc", "TSMC", "TSM", "0001046179", 12, "natural", (["6-K"], ["6-K"]), ["HPC", "Smartphone", "Internet of Things", "Automotive", "DCE", "Others"]),
    ("meta", "Meta", "META", "0001326801", 12, "natural", _US, ["Family of Apps", "Reality Labs"]),
    ("avgo", "Broadcom", "AVGO", "0001730168", 11, "natural", _US, ["Semiconductor Solutions", "Infrastructure Software"]),
    ("tsla", "Tesla", "TSLA", "0001318605", 12, "natural", _US, ["Automotive", "Energy Generation and Storage", "Services and Other"]),
    ("berkshire", "Berkshire Hathaway", "BRK.B", "0001067983", 12, "natural", (["8-K"], ["10-K"]), ["Insurance underwriting", "Insurance investment income", "BNSF", "Berkshire Hathaway Energy", "Manufacturing, service and retailing"]),
    ("walmart", "Walmart", "WMT", "0000104169", 1, "by_period_end_majority", _US, ["Walmart U.S.", "Walmart International", "Sam's Club U.S."]),
    ("lly", "Eli Lilly", "LLY", "0000059478", 12, "natural", _US, ["Mounjaro", "Zepbound", "Verzenio", "Jardiance"]),
    ("jpm", "JPMorgan Chase", "JPM", "0000019617", 12, "natural", _US, ["Consumer & Community Banking", "Commercial & Investment Bank", "Asset & Wealth Management", "Commercial Banking"]),
    ("xom", "Exxon Mobil", "XOM", "0000034088", 12, "natural", _US, []),
    ("jnj", "Johnson & Johnson", "JNJ", "0000200406", 12, "natural", _US, ["Consumer Health", "Pharmaceutical", "Innovative Medicine", "MedTech"]),
    ("visa", "Visa", "V", "0001403161", 9, "natural", _US, ["Data processing revenue", "Service revenue", "International transaction revenue", "Other revenue"]),
    ("asml", "ASML", "ASML", "0000937966", 12, "natural", (["6-K"], ["6-K", "20-F"]), ["Net system sales", "Installed Base Management"]),
    ("micron", "Micron", "MU", "0000723125", 8, "by_period_end_majority", _US, ["Cloud Memory Business Unit", "Core Data Center Business Unit", "Mobile and Client Business Unit", "Automotive and Embedded Business Unit"]),
    ("costco", "Costco", "COST", "0000909832", 8, "by_period_end_majority", _US, ["Net sales", "Membership fees"]),
    ("oracle", "Oracle", "ORCL", "0001341439", 5, "by_period_end_majority", _US, ["Cloud", "Software", "Hardware", "Services"]),
)
#: Other names of segments, and filers of earlier quarters.
ALIASES = {
    "apple": {"Wearables, Home & Accessories": "Wearables, Home and Accessories"},
    "alphabet": {"Google subscriptions, platforms & devices": "Google subscriptions, platforms, and devices", "Google properties revenues": "Google properties", "Google other revenues": "Google other"},
    "microsoft": {"Productivity & Business Processes": "Productivity and Business Processes"},
    "jnj": {"Medical Devices": "MedTech"},
}
FORMER_FILERS = {"alphabet": [("2015Q3", "0001288776")]}


def companies(spark: SparkSession) -> DataFrame:
    """A row a company; small and of fixed size."""
    rows = [(key, name, ticker, cik, n, "EUR" if key == "asml" else "USD", "EUR " if key == "asml" else "$", month, mode, *forms, segments, ALIASES.get(key, {}), FORMER_FILERS.get(key, [])) for n, (key, name, ticker, cik, month, mode, forms, segments) in enumerate(COMPANIES, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def canonical_names(dimension: DataFrame) -> DataFrame:
    """company, names: for structure.name_profile."""
    return dimension.select("company", F.col("segments").alias("names"))


def filer(former: Column, cik: Column, index: Column) -> Column:
    """The filer for a quarter: the first former one whose last quarter isn't before it, else the present one."""
    from quartermill.functions.periods import index_of_label

    return F.coalesce(F.get(F.filter(former, lambda f: index <= index_of_label(f["through"])), F.lit(0))["cik"], cik)


def cards(dimension: DataFrame, supported: DataFrame) -> DataFrame:
    """company, name, ticker, currency, latest quarter and all supported ones: a selector's rows in display order. supported: company, quarter_index."""
    from quartermill.functions.periods import label

    own = supported.groupBy("company").agg(F.array_sort(F.collect_set("quarter_index")).alias("_q"))
    met = dimension.join(own, "company", "left").select("display_order", "company", "name", "ticker", "currency", F.transform("_q", label).alias("quarters"))
    return met.withColumn("latest", F.get("quarters", F.size("quarters") - 1)).orderBy("display_order")
