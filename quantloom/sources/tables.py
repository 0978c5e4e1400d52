"""Panel views of event and trade tables, canonical schema, readers and sinks."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.num import finite, percent, sdiv, security_code, truthy

# Names that columns of daily bars go by (fixed values): canonical name, then others.
ALIASES = {
    "date": ["日期", "交易日期", "交易日", "trade_date", "datetime"],
    "code": ["股票代码", "证券代码", "代码", "symbol", "ticker", "ts_code"],
    "open": ["开盘", "开盘价", "open_price"],
    "high": ["最高", "最高价", "high_price"],
    "low": ["最低", "最低价", "low_price"],
    "close": ["收盘", "收盘价", "close_price"],
    "volume": ["成交量", "成交股数", "volume_shares", "vol"],
    "amount": ["成交额", "成交金额", "turnover_amount", "turnover_value"],
    "turnover": ["换手率", "换手", "turnover_rate"],
    "pe": ["市盈率", "PE", "pe_ttm"],
    "pb": ["市净率", "PB"],
    "ps": ["市销率", "PS"],
    "roe": ["净资产收益率", "ROE"],
    "roic": ["投入资本回报率", "ROIC"],
    "revenue_growth": ["营业收入增长率", "营收增长率", "revenue_growth_rate"],
    "profit_growth": ["净利润增长率", "利润增长率", "profit_growth_rate"],
    "market_cap": ["总市值", "市值", "market_value", "total_mv"],
    "available_date": ["数据可用日期", "可用日期", "发布日期", "公告日期", "publish_date"],
    "is_tradeable": ["是否交易", "可交易", "tradeable"],
    "limit_up": ["涨停", "涨停状态"],
    "limit_down": ["跌停", "跌停状态"],
    "is_st": ["ST", "是否ST", "is_st_stock"],
    "suspended": ["停牌", "是否停牌"],
    "industry": ["行业", "所属行业", "sector"],
    "ipo_date": ["上市日期", "IPO日期"],
    "delist_date": ["退市日期"],
}
NUMBERS = ["open", "high", "low", "close", "volume", "amount", "turnover", "pe", "pb", "ps", "roe", "roic", "revenue_growth", "profit_growth", "market_cap"]
FLAGS = {"is_tradeable": True, "limit_up": False, "limit_down": False, "is_st": False, "suspended": False}
DATES = ["available_date", "ipo_date", "delist_date"]
REQUIRED = ["date", "code", "open", "high", "low", "close", "volume"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_panel(spark: SparkSession, path: str, fmt: str = "csv", order: str | None = None) -> DataFrame:
    """A normalized panel from csv, json or parquet files. order: a column by which the last of repeated rows is known."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return normalize(reader.format(fmt).load(path), order)


def normalize(df: DataFrame, order: str | None = None) -> DataFrame:
    """The canonical schema: names, types, defaults, one row a (date, code). Other columns pass through.

    Of repeated rows the last by `order` stays, or, without it, that which was read last (files in reading order).
    """
    known = {a: name for name, others in ALIASES.items() for a in others}
    lower = {c: known.get(c, known.get(c.lower(), c)) for c in df.columns}
    taken, names = set(), {}
    for c in df.columns:
        if lower[c] in df.columns and lower[c] != c or lower[c] in taken:
            continue  # the canonical name is there already
        taken.add(lower[c])
        names[lower[c]] = F.col(f"`{c}`")
    missing = [c for c in REQUIRED if c not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out: dict[str, Column] = dict(names)
    out["date"] = F.to_date(F.try_to_timestamp(names["date"].cast("string")))
    out["code"] = security_code(names["code"])
    for c in NUMBERS:
        out[c] = finite(percent(names[c])) if c in names else F.lit(None).cast("double")
    for c in DATES:
        out[c] = F.to_date(F.try_to_timestamp(names[c].cast("string"))) if c in names else F.lit(None).cast("date")
    out["available_date"] = F.coalesce(out["available_date"], out["date"])
    for c, default in FLAGS.items():
        out[c] = truthy(names[c]) if c in names else F.lit(default)
    out["is_tradeable"] = out["is_tradeable"] & ~out["suspended"]
    out["industry"] = names["industry"].cast("string") if "industry" in names else F.lit(None).cast("string")
    seq = F.col(f"`{order}`") if order else F.monotonically_increasing_id()
    rows = df.select(*[v.alias(k) for k, v in out.items()], seq.alias("__seq"))
    last = F.row_number().over(Window.partitionBy("date", "code").orderBy(F.desc("__seq")))
    return rows.withColumn("__nth", last).where("__nth = 1").drop("__nth", "__seq")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows that repeat the keys the first by `order`; rows without one of the keys go."""
    known = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return known.withColumn("__nth", first).where("__nth = 1").drop("__nth")


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """code: the codes of a csv with a column of that name (or another it goes by), or of a text file with one a line; each once."""
    names = {"code", *ALIASES["code"]}
    head = spark.read.option("header", True).csv(path)
    found = [c for c in head.columns if c.strip() in names]
    raw = head.select(F.col(f"`{found[0]}`").alias("code")) if found else spark.read.text(path).select(F.col("value").alias("code"))
    return raw.where("trim(code) != ''").select(security_code(F.trim("code")).alias("code")).distinct()


def read_lives(spark: SparkSession, path: str) -> DataFrame:
    """code, list_date, delist_date, is_st of a csv of listings."""
    raw = spark.read.option("header", True).csv(path)
    names = {c: next((k for k in ("code", "ipo_date", "delist_date", "is_st") if c == k or c in ALIASES[k]), c) for c in raw.columns}
    df = raw.toDF(*[names[c] for c in raw.columns])

    def day(c: str) -> Column:
        return F.to_date(F.try_to_timestamp(F.col(c))) if c in df.columns else F.lit(None).cast("date")

    return df.select(security_code("code").alias("code"), day("ipo_date").alias("list_date"), day("delist_date").alias("delist_date"), (truthy("is_st") if "is_st" in df.columns else F.lit(False)).alias("is_st"))


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """date, ordinal of a csv whose first column, or one named date, holds trading days."""
    raw = spark.read.option("header", True).csv(path)
    name = next((c for c in raw.columns if c in ("date", *ALIASES["date"])), raw.columns[0])
    days = raw.select(F.to_date(F.try_to_timestamp(F.col(f"`{name}`"))).alias("date")).where("date IS NOT NULL").distinct()
    return days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("ordinal"))  # a row a day


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file of a folder, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of a database; with a whole-number key and its bounds it is read in parts side by side."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def head_tail(panel: DataFrame, share: float = 0.8, by: str = "code", order: str = "date") -> DataFrame:
    """panel with `part`: head for the first `share` of each group's rows in order, tail for the others."""
    nth, n = F.row_number().over(Window.partitionBy(by).orderBy(order)), F.count(F.lit(1)).over(Window.partitionBy(by))
    return panel.withColumn("part", F.when(nth <= F.floor(n * share), "head").otherwise("tail"))


def violations(panel: DataFrame) -> DataFrame:
    """One row of counts of what a valid panel has not."""
    bad = {
        "null_date": F.col("date").isNull(),
        "null_code": F.col("code").isNull(),
        "bad_price": F.least("open", "high", "low", "close") <= 0,
        "bad_range": (F.col("high") < F.greatest("open", "low", "close")) | (F.col("low") > F.least("open", "close")),
        "future": F.col("available_date") > F.col("date"),
    }
    return panel.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in bad.items()])


def event_bars(events: DataFrame) -> DataFrame:
    """Daily bars of each user's event values."""
    at = F.struct("ts", "event_id")
    return (
        events.groupBy(security_code("user_id").alias("code"), F.to_date("ts").alias("date"))
        .agg(
            F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"),
            F.count(F.lit(1)).alias("volume"), F.sum("value").alias("amount"),
        )
    )


def brand_bars(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Weekly bars of each brand's unit prices, with an industry (five of them) and a market cap (of the week's amount).

    part is joined as the optimizer sees fit: broadcast only while it is below spark.sql.autoBroadcastJoinThreshold.
    """
    price = sdiv("l_extendedprice", "l_quantity")
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    number = F.regexp_extract("code", r"(\d+)$", 1).cast("int")
    return (
        lineitem.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("code"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"))
        .agg(
            F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
            F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"),
        )
        .withColumns({"industry": F.concat(F.lit("I"), (number % 5).cast("string")), "market_cap": F.col("amount") * (number % 7 + 1)})
    )


def fundamentals(orders: DataFrame) -> DataFrame:
    """A row an order as a company's report: code, report_period, available_date, and figures derived from keys and prices."""
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return orders.select(
        k.alias("fact_id"),
        F.concat(F.lit("Brand#"), (c % 25).cast("string")).alias("code"),
        F.to_date("o_orderdate").alias("report_period"),
        F.when(k % 11 != 0, F.date_add(F.to_date("o_orderdate"), (k % 45).cast("int"))).alias("available_date"),
        F.when(k % 3 == 0, F.date_add(F.to_date("o_orderdate"), (k % 20).cast("int"))).alias("announcement_date"),
        p.alias("revenue"),
        (p * ((k % 21) - 5) / 100.0).alias("net_profit"),
        F.when(k % 13 != 0, p * ((c % 9) + 1)).alias("total_assets"),
        (p * (k % 5)).alias("equity"),
        ((k % 50) - 5).cast("double").alias("pe"),
        ((c % 20) / 4.0).alias("pb"),
        ((k % 17) / 3.0).alias("ps"),
        ((k % 40) / 100.0 - 0.05).alias("roe"),
        ((c % 30) / 100.0).alias("roic"),
        ((k % 33) / 100.0 - 0.1).alias("revenue_growth"),
        ((k % 27) / 100.0 - 0.1).alias("profit_growth"),
        (p * 10).alias("market_cap"),
    )


def lifecycles(orders: DataFrame) -> DataFrame:
    """A customer's first order lists it, its last delists it (unless that is late); some are special treatment."""
    return (
        orders.groupBy(security_code("o_custkey").alias("code"))
        .agg(F.to_date(F.min("o_orderdate")).alias("list_date"), F.to_date(F.max("o_orderdate")).alias("last_date"), F.count(F.lit(1)).alias("n"))
        .select("code", "list_date", F.when(F.col("last_date") < F.lit("2001-06-01").cast("date"), F.col("last_date")).alias("delist_date"), (F.col("n") % 7 == 0).alias("is_st"))
    )


def trades(lineitem: DataFrame) -> DataFrame:
    side = F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy")
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sdiv("l_extendedprice", "l_quantity").alias("price"), F.col("l_quantity").alias("quantity"), side.alias("side"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Iterable[str] = (), mode: str = "overwrite") -> None:
    """Writes with Spark's commit protocol. With partitions, overwriting replaces only those that df has."""
    w = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        w = w.option("header", True)
    if by := list(partition_by):
        w = w.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    w.save(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, status: str | None = None, most: int | None = None, priority: dict[str, int] | None = None) -> DataFrame:
    """Rows of both, the last by `order` for each key. With `most`, the rest is evicted by status priority, then by age."""
    both = old.unionByName(new, allowMissingColumns=True)
    kept = both.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
    if most is None:
        return kept
    rank = []
    if status and priority:
        rank = [F.coalesce(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])[F.col(status)], F.lit(len(priority)))]
    return kept.orderBy(*rank, F.desc(order), *keys).limit(most)  # a stated size of the library


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows and an order-free checksum of all columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")), F.lit(0)).alias("checksum"))


def clear(spark: SparkSession, path: str, **equal: object) -> int:
    """Deletes the partitions of a partitioned table whose columns have the given values, files and folders; returns how many. Other partitions are not read.

    Columns that the table isn't partitioned by raise; without any column nothing goes.
    """
    if not equal:
        return 0
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    home = jvm.Path(path)
    fs = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    wanted = {k: "__HIVE_DEFAULT_PARTITION__" if v is None else str(v) for k, v in equal.items()}

    def walk(at, left: dict[str, str]) -> int:
        if not left:
            return int(fs.delete(at, True))
        gone = 0
        for f in fs.listStatus(at):
            name, eq, value = f.getPath().getName().partition("=")
            if f.isDirectory() and eq and left.get(name, unquote(value)) == unquote(value):
                gone += walk(f.getPath(), {k: v for k, v in left.items() if k != name})
        return gone

    known = {f.getPath().getName().partition("=")[0] for f in fs.globStatus(jvm.Path(path + "/*=*"))} | {f.getPath().getName().partition("=")[0] for f in fs.globStatus(jvm.Path(path + "/*=*/*=*"))}
    if missing := set(equal) - known:
        raise ValueError(f"the table is not partitioned by {', '.join(sorted(missing))}")
    return walk(home, wanted)
