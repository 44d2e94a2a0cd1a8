"""Sources, projections, joins and marts of the series pipeline."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import windows as X
from ..operators import series
from ..sources import bars, landing
from .registry import UNIVERSE, d, daily, query, r, strategies

EVENT_DAYS = "cast(ts as date)"


@query("select event_id, user_id, event_type, round(value, 8) as value from events")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.scan(spark, sf_dir, "events").select("event_id", "user_id", "event_type", r("value").alias("value"))


@query("select cast(date as varchar) as date, round(close, 8) as close, volume from prices where symbol = 'Brand#1' and date >= date '1998-01-01'", ("prices",))
def scan_table_filtered(spark, sf_dir):
    return bars.prices(spark, sf_dir).where("symbol = 'Brand#1' and date >= date '1998-01-01'").select(d().alias("date"), r("close").alias("close"), "volume")


@query("select symbol, cast(date as varchar) as date, round(close, 8) as close from prices where 1 = 0 union all select 'rows', '', cast(count(*) as double) from prices", ("prices",))
def missing_table_as_empty(spark, sf_dir):
    p = bars.prices(spark, sf_dir)
    absent = landing.table_or_empty(spark, "tidewheel_no_such_table", p.select("symbol", "date", "close").schema)
    n = p.agg(F.count(F.lit(1)).cast("double").alias("close")).select(F.lit("rows").alias("symbol"), F.lit("").alias("date"), "close")
    return absent.select("symbol", d().alias("date"), "close").unionByName(n)



@query(
    "select symbol, cast(date as varchar) as date, round(close, 8) as close from prices where close is not null",
    ("prices",),
)
def normalise_prices(spark, sf_dir):
    """Rows become parallel arrays by symbol and month, as a feed delivers them, and rows again."""
    p = bars.prices(spark, sf_dir)
    by_time = F.array_sort(F.collect_list(F.struct(F.unix_timestamp(F.col("date").cast("timestamp")).alias("t"), "open", "high", "low", "close", "volume")))
    feed = p.groupBy(F.concat("symbol", F.lit("-USD")).alias("symbol"), F.trunc("date", "month").alias("m")).agg(by_time.alias("b"))
    columns = {"timestamps": "t", "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume", "adjclose": "close"}
    feed = feed.select("symbol", *(F.col(f"b.{v}").alias(k) for k, v in columns.items()))
    return landing.flatten_bars(feed).select("symbol", d().alias("date"), r("close").alias("close"))


@query("select series_id, cast(date as varchar) as date, case when extract(day from date) = 1 then null else value end as value from macro", ("macro",))
def normalise_macro(spark, sf_dir):
    m = bars.macro(spark, sf_dir)
    text = F.when(F.dayofmonth("date") == 1, F.lit(".")).otherwise(F.col("value").cast("string"))
    payload = m.groupBy("series_id", F.trunc("date", "month").alias("m")).agg(F.to_json(F.collect_list(F.struct(d().alias("date"), text.alias("value")))).alias("observations"))
    return landing.flatten_observations(payload, "series_id", "observations", "array<struct<date:string,value:string>>").select("series_id", "date", "value")


@query("select indicator_id, coalesce(country, 'unknown') as country, year, value from annual", ("annual",))
def normalise_worldbank(spark, sf_dir):
    a = bars.annual(spark, sf_dir)
    item = F.struct(F.col("country"), F.col("year"), F.col("value").cast("string").alias("value"))
    page = F.concat(F.lit('[{"page":1,"pages":1},'), F.to_json(F.collect_list(item)), F.lit("]"))
    payload = a.groupBy("indicator_id").agg(page.alias("payload"))
    rows = landing.flatten_envelope(payload, "indicator_id", "payload", "array<struct<country:string,year:int,value:string>>")
    return rows.select("indicator_id", F.coalesce("country", F.lit("unknown")).alias("country"), "year", "value")


@query("select event_id, user_id from (select event_id, case when user_id % 7 = 0 then null else user_id end as user_id from events) e where user_id is not null")
def validate_required(spark, sf_dir):
    e = bars.scan(spark, sf_dir, "events").withColumn("user_id", F.when(F.col("user_id") % 7 != 0, F.col("user_id")))
    return landing.required(e, ["event_id", "user_id"]).select("event_id", "user_id")


@query(
    """select case when user_id % 5 = 0 then 'rejected' else 'good' end as kind, case when user_id % 5 = 0 then 'value is not double' else '' end as reason, count(*) as n
 from events group by 1, 2"""
)
def validate_rows(spark, sf_dir):
    e = bars.scan(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 5 == 0, F.lit("bad")).otherwise(F.lit("1.5")).alias("value"))
    good, bad = landing.validated(e, {"value": "double"}, ["event_id"])
    both = good.select(F.lit("good").alias("kind"), F.lit("").alias("reason")).unionByName(bad.select(F.lit("rejected").alias("kind"), "reason"))
    return both.groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    """select symbol, cast(date as varchar) as date, round(case when date >= date '2000-01-01' then close + 1 else close end, 8) as close, case when date >= date '2000-01-01' then '2020-01-02 00:00:00' end as loaded_at from prices
 union all select 'New', '2020-01-01', 1.0, '2020-01-02 00:00:00'""",
    ("prices",),
)
def upsert(spark, sf_dir):
    """Later rows replace those of their key, a row that comes twice counts once, and what comes in is stamped."""
    p = bars.prices(spark, sf_dir).select("symbol", "date", "close")
    batch = p.where("date >= date '2000-01-01'").withColumn("close", F.col("close") + 1)
    new = spark.sql("select 'New' as symbol, date '2020-01-01' as date, double(1) as close")
    existing = p.withColumn("loaded_at", F.lit(None).cast("string"))
    got = landing.upsert(existing, batch.unionByName(new).unionByName(new), ["symbol", "date"], F.lit("2020-01-02 00:00:00"))
    return got.select("symbol", d().alias("date"), r("close").alias("close"), "loaded_at")


@query("select symbol, cast(max(date) as varchar) as mark from prices group by symbol", ("prices",))
def high_water_mark(spark, sf_dir):
    return landing.high_water_mark(bars.prices(spark, sf_dir), "date", ["symbol"]).select("symbol", d("mark").alias("mark"))


@query(
    """select symbol, cast(date as varchar) as date from prices p where date > coalesce((select max(date) from prices q where q.symbol = p.symbol and q.date < date '2000-01-01' and q.symbol <> 'Brand#9'), date '1900-01-01')""",
    ("prices",),
)
def newer_than_mark(spark, sf_dir):
    p = bars.prices(spark, sf_dir)
    marks = landing.high_water_mark(p.where("date < date '2000-01-01' and symbol <> 'Brand#9'"), "date", ["symbol"])
    return landing.newer(p, marks, "date", ["symbol"]).select("symbol", d().alias("date"))


@query("select run_id, status, substr(message, 1, 500) as message from (select user_id as run_id, event_type as status, repeat(event_type, 100) as message, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) e where rn = 1")
def run_audit(spark, sf_dir):
    e = bars.scan(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("status"), F.expr("repeat(event_type, 100)").alias("message"), F.struct("ts", "event_id").alias("logged_at"))
    return landing.audit_latest(e).select("run_id", "status", "message")


@query(
    r"""select event_id, regexp_replace(regexp_replace('GET /v1?api_key=' || event_type || '&x=' || event_id || ' Bearer abc.' || event_id, '(?i)(api_?key|token|password|secret)=[^&\s]+', '\1=***', 'g'), '(?i)bearer\s+[a-z0-9._-]+', 'Bearer ***', 'g') as message from events"""
)
def redact_text(spark, sf_dir):
    m = F.concat(F.lit("GET /v1?api_key="), "event_type", F.lit("&x="), "event_id", F.lit(" Bearer abc."), "event_id")
    return bars.scan(spark, sf_dir, "events").select("event_id", landing.redact_text(m).alias("message"))


@query("select symbol, cast(date as varchar) as date, round(close, 8) as close, volume from prices where close is not null and not (coalesce(volume, 0) = 0 and asset_class <> 'fx')", ("prices",))
def stg_asset_prices_filter(spark, sf_dir):
    return series.staged(bars.prices(spark, sf_dir)).select("symbol", d().alias("date"), r("close").alias("close"), "volume")


@query("select indicator_id, country, cast(year as integer) as year, cast(value as double) as value from annual where value is not null", ("annual",))
def typed_projection(spark, sf_dir):
    return bars.annual(spark, sf_dir).where("value is not null").select("indicator_id", "country", F.col("year").cast("int").alias("year"), F.col("value").cast("double").alias("value"))


MACRO_AT = {"us_10y": "DGS10", "us_2y": "DGS2", "us_3m": "DGS3MO"}


def market_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's days with the macro values known then, and the two spreads."""
    spine = daily(spark, sf_dir).where("symbol = 'Brand#1'").select("date", F.col("close").alias("spy_close"), F.col("daily_return").alias("spy_return"), "vol_20d")
    values = {n: F.when(F.col("series_id") == s, F.col("value")) for n, s in MACRO_AT.items()}
    out = series.asof_multi(spine, bars.macro(spark, sf_dir), values)
    return out.withColumns({"yield_curve_10y_2y": F.col("us_10y") - F.col("us_2y"), "yield_curve_10y_3m": F.col("us_10y") - F.col("us_3m")})


ASOF = """
select d.date, d.close as spy_close, d.daily_return as spy_return, d.vol_20d, a.value as us_10y, b.value as us_2y, c.value as us_3m
 from (select * from daily where symbol = 'Brand#1') d
 asof left join (select * from macro where series_id = 'DGS10') a on a.date <= d.date
 asof left join (select * from macro where series_id = 'DGS2') b on b.date <= d.date
 asof left join (select * from macro where series_id = 'DGS3MO') c on c.date <= d.date
"""


@query(
    f"""select cast(date as varchar) as date, round(spy_close, 8) as spy_close, round(spy_return, 8) as spy_return, round(vol_20d, 8) as vol_20d, us_10y,
 us_2y, us_3m, us_10y - us_2y as yield_curve_10y_2y, us_10y - us_3m as yield_curve_10y_3m from ({ASOF}) x""",
    ("daily", "macro"),
)
def fct_market_macro(spark, sf_dir):
    names = ["spy_close", "spy_return", "vol_20d"]
    return market_macro(spark, sf_dir).select(d().alias("date"), *(r(n).alias(n) for n in names), *MACRO_AT, "yield_curve_10y_2y", "yield_curve_10y_3m")


@query(f"select cast(date as varchar) as date, us_10y, us_2y, us_3m from ({ASOF}) x", ("daily", "macro"))
def asof_multi(spark, sf_dir):
    return market_macro(spark, sf_dir).select(d().alias("date"), *MACRO_AT)


@query(
    """select p.symbol, cast(p.date as varchar) as date, m.value from (select *, case asset_class when 'fx' then 'DGS2' else 'DGS10' end as series_id from prices) p
 asof left join macro m on m.series_id = p.series_id and m.date <= p.date""",
    ("prices", "macro"),
)
def asof_join(spark, sf_dir):
    p = bars.prices(spark, sf_dir).select("symbol", "date", F.when(F.col("asset_class") == "fx", "DGS2").otherwise("DGS10").alias("series_id"))
    found = series.asof_multi(p, bars.macro(spark, sf_dir).withColumnRenamed("value", "v"), {"value": F.col("v")}, keys=["series_id"])
    return found.select("symbol", d().alias("date"), "value")


@query(f"select cast(date as varchar) as date, us_10y - us_2y as s2, us_10y - us_3m as s3 from ({ASOF}) x", ("daily", "macro"))
def spread_columns(spark, sf_dir):
    return market_macro(spark, sf_dir).select(d().alias("date"), F.col("yield_curve_10y_2y").alias("s2"), F.col("yield_curve_10y_3m").alias("s3"))


RISK = f"""
select date, coalesce(us_10y - us_3m, us_10y - us_2y) as spread, case when us_10y - us_3m is not null then '10y3m' else '10y2y' end as model from ({ASOF}) x
"""
PHI = """case when x >= 0 then 1 - u else u end"""
TAIL = """exp(-x * x / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))"""


def risk(spark, sf_dir):
    m = market_macro(spark, sf_dir)
    s3, s2 = F.col("yield_curve_10y_3m"), F.col("yield_curve_10y_2y")
    return m.select("date", F.coalesce(s3, s2).alias("spread"), F.when(s3.isNotNull(), "10y3m").otherwise("10y2y").alias("model"))


@query(f"select cast(date as varchar) as date, spread, model from ({RISK}) x", ("daily", "macro"))
def fallback_spread(spark, sf_dir):
    return risk(spark, sf_dir).select(d().alias("date"), "spread", "model")


@query(
    f"""select cast(date as varchar) as date, spread, round({PHI}, 8) as recession_prob, model
 from (select *, {TAIL} as u from (select *, 1 / (1 + 0.2316419 * abs(x)) as t from (select *, -0.5333 - 0.6629 * spread as x from ({RISK}) a where spread is not null) b) c) e""",
    ("daily", "macro"),
)
def recession_probit(spark, sf_dir):
    return risk(spark, sf_dir).where("spread is not null").select(d().alias("date"), "spread", r(S.recession_probability("spread")).alias("recession_prob"), "model")


@query(f"select symbol, cast(date as varchar) as date, round({PHI}, 8) as p from (select *, {TAIL} as u from (select *, 1 / (1 + 0.2316419 * abs(x)) as t from (select symbol, date, (close - 100) / 2 as x from prices) a) b) c", ("prices",))
def normal_cdf(spark, sf_dir):
    return bars.prices(spark, sf_dir).select("symbol", d().alias("date"), r(S.normal_cdf((F.col("close") - 100) / 2)).alias("p"))


@query("select case when max(s3) is not null then 's3' when max(s2) is not null then 's2' end as picked, count(*) as n_rows from (select us_10y - us_2y as s2, us_10y - us_3m as s3 from (" + ASOF + ") x) y", ("daily", "macro"))
def yield_curve_spread_pick(spark, sf_dir):
    m = market_macro(spark, sf_dir)
    some = lambda c: F.max(F.col(c).isNotNull())
    return m.agg(F.when(some("yield_curve_10y_3m"), "s3").when(some("yield_curve_10y_2y"), "s2").alias("picked"), F.count(F.lit(1)).alias("n_rows"))


@query(
    "select symbol, cast(date as varchar) as date, case when open > 0 and high > 0 and low > 0 and close > 0 then round(sqrt(greatest(0, 0.5 * power(ln(high / low), 2) - (2 * ln(2.0) - 1) * power(ln(close / open), 2))), 8) end as gk from prices",
    ("prices",),
)
def garman_klass_vol(spark, sf_dir):
    return bars.prices(spark, sf_dir).select("symbol", d().alias("date"), r(S.garman_klass("open", "high", "low", "close")).alias("gk"))


@query("select symbol, cast(date as varchar) as date, round((isodow(date) - 1) / 4.0, 8) as day_of_week, round(month(date) / 12.0, 8) as month_of_year from prices", ("prices",))
def calendar_features(spark, sf_dir):
    return bars.prices(spark, sf_dir).select("symbol", d().alias("date"), r(F.weekday("date") / F.lit(4.0)).alias("day_of_week"), r(F.month("date") / F.lit(12.0)).alias("month_of_year"))


@query("select symbol, cast(date as varchar) as date, round(vol_20d * daily_return, 8) as vol_x_ret, round(vol_20d * (close / ma_50 - 1), 8) as vol_x_trend from daily", ("daily",))
def interaction_features(spark, sf_dir):
    return daily(spark, sf_dir).select("symbol", d().alias("date"), r(F.col("vol_20d") * F.col("daily_return")).alias("vol_x_ret"), r(F.col("vol_20d") * (F.col("close") / F.col("ma_50") - 1)).alias("vol_x_trend"))


@query("select symbol, cast(date as varchar) as date, round(greatest(daily_return * 20, -1.0), 8) as clipped from daily where daily_return is not null", ("daily",))
def clip_returns(spark, sf_dir):
    return daily(spark, sf_dir).where("daily_return is not null").select("symbol", d().alias("date"), r(S.clip_return(F.col("daily_return") * 20)).alias("clipped"))


@query(
    """select p.preset, cast(case p.preset when 'YTD' then date_trunc('year', a.anchor)::date when 'Max' then date '1900-01-01' else a.anchor - cast(p.days as integer) end as varchar) as floor
 from (values ('1M', 30), ('6M', 182), ('1Y', 365), ('5Y', 1825), ('YTD', 0), ('Max', 0)) p(preset, days), (select max(date) as anchor from prices) a""",
    ("prices",),
)
def range_start(spark, sf_dir):
    presets = spark.createDataFrame([("1M", 30), ("6M", 182), ("1Y", 365), ("5Y", 1825), ("YTD", 0), ("Max", 0)], "preset string, days int")
    anchor = bars.prices(spark, sf_dir).agg(F.max("date").alias("anchor"))
    floor = F.when(F.col("preset") == "YTD", F.trunc("anchor", "year")).when(F.col("preset") == "Max", F.lit("1900-01-01").cast("date")).otherwise(F.date_sub("anchor", F.col("days")))
    return presets.crossJoin(F.broadcast(anchor)).select("preset", d(floor).alias("floor"))  # one row


@query("select symbol, cast(date as varchar) as date, case when vol_20d > 0.5 then 'above' when vol_20d < 0.4 then 'below' when vol_20d is not null then 'at' end as level from daily", ("daily",))
def threshold_classify(spark, sf_dir):
    return daily(spark, sf_dir).select("symbol", d().alias("date"), S.classify("vol_20d", 0.45, 0.05).alias("level"))


@query("select event_type, case when bool_and(coalesce(user_id % 2 = 0, false)) then 'sample' when bool_and(coalesce(user_id % 2 = 1, false)) then 'live' else 'mixed' end as origin from events group by event_type")
def provenance_flag(spark, sf_dir):
    even = F.coalesce(F.col("user_id") % 2 == 0, F.lit(False))
    odd = F.coalesce(F.col("user_id") % 2 == 1, F.lit(False))
    return bars.scan(spark, sf_dir, "events").groupBy("event_type").agg(F.when(F.bool_and(even), "sample").when(F.bool_and(odd), "live").otherwise("mixed").alias("origin"))


LAST = "select symbol, arg_max(daily_return, date) as pred, arg_max(vol_20d, date) as vol from daily where daily_return is not null group by symbol"


@query(
    f"select p.symbol, round(p.pred + 25 / 100.0 * coalesce(s.rate, -0.5) + 5 * coalesce(s.vix, -0.01), 8) as shocked from ({LAST}) p left join (values ('Brand#1', -0.1, -0.02), ('Brand#2', 0.2, 0.01)) s(symbol, rate, vix) on p.symbol = s.symbol",
    ("daily",),
)
def scenario_shock(spark, sf_dir):
    last = daily(spark, sf_dir).where("daily_return is not null").groupBy("symbol").agg(F.max_by("daily_return", "date").alias("pred"))
    sens = spark.createDataFrame([("Brand#1", -0.1, -0.02), ("Brand#2", 0.2, 0.01)], "symbol string, rate double, vix double")
    shocked = F.col("pred") + 25 / 100.0 * F.coalesce("rate", F.lit(-0.5)) + 5 * F.coalesce("vix", F.lit(-0.01))
    return last.join(F.broadcast(sens), "symbol", "left").select("symbol", r(shocked).alias("shocked"))  # two rows


@query(
    f"""select symbol, cast(k as integer) as step, round(pred * t, 8) as centre, round(pred * t + 1.645 * vol / sqrt(252.0) * sqrt(20.0) * sqrt(1 - greatest(0.0, least(1.0, r2))) * sqrt(t / 20), 8) as hi,
 round(pred * t - 1.645 * vol / sqrt(252.0) * sqrt(20.0) * sqrt(1 - greatest(0.0, least(1.0, r2))) * sqrt(t / 20), 8) as lo
 from (select p.*, q.r2, 20.0 * k / 20 as t, k from ({LAST}) p join (select symbol, power(coalesce(corr(daily_return, l), 0), 2) as r2 from (select *, lag(daily_return) over (partition by symbol order by date) as l from daily) z group by symbol) q on q.symbol = p.symbol, range(0, 21) g(k)) x""",
    ("daily",),
)
def forecast_fan(spark, sf_dir):
    """Bands around the forecast, narrower the better it has been: both sides, with R squared between 0 and 1."""
    x = daily(spark, sf_dir)
    fit = x.withColumn("l", F.lag("daily_return").over(X.by("symbol"))).groupBy("symbol").agg(F.pow(F.coalesce(F.corr("daily_return", "l"), F.lit(0.0)), F.lit(2.0)).alias("r2"))
    last = x.where("daily_return is not null").groupBy("symbol").agg(F.max_by("daily_return", "date").alias("pred"), F.max_by("vol_20d", "date").alias("vol")).join(fit, "symbol")
    rows = last.select("symbol", "pred", "vol", "r2", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("step"))
    t = F.lit(20.0) * F.col("step") / 20
    band = F.lit(1.645) * F.col("vol") / F.sqrt(F.lit(252.0)) * F.sqrt(F.lit(20.0)) * F.sqrt(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r2")))) * F.sqrt(t / 20)
    return rows.select("symbol", "step", r(F.col("pred") * t).alias("centre"), r(F.col("pred") * t + band).alias("hi"), r(F.col("pred") * t - band).alias("lo"))


@query(
    """select regexp_replace(metric, '^(feature_importance|direction_accuracy)_', '') as name, count(*) as n from
 (select case when user_id % 2 = 0 then 'feature_importance_' else 'direction_accuracy_' end || event_type as metric from events) e where metric like 'feature_importance_%' group by 1"""
)
def metric_name_split(spark, sf_dir):
    metric = F.concat(F.when(F.col("user_id") % 2 == 0, "feature_importance_").otherwise("direction_accuracy_"), "event_type")
    e = bars.scan(spark, sf_dir, "events").select(metric.alias("metric")).where(F.col("metric").startswith("feature_importance_"))
    return e.groupBy(F.regexp_replace("metric", "^(feature_importance|direction_accuracy)_", "").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """select cast(make_date(cast(split_part(stamp, '.', 1) as integer), cast(split_part(stamp, '.', 2) as integer), 1) as varchar) as month, round(dividend / nullif(price, 0), 8) as dp, round(earnings / nullif(price, 0), 8) as ep
 from (select strftime(date, '%Y.%m') as stamp, max(close) as price, min(close) / 30 as dividend, min(close) / 15 as earnings from prices group by 1) x""",
    ("prices",),
)
def cape_yields(spark, sf_dir):
    m = bars.prices(spark, sf_dir).groupBy(F.date_format("date", "yyyy.MM").alias("stamp")).agg(F.max("close").alias("price"), (F.min("close") / 30).alias("dividend"), (F.min("close") / 15).alias("earnings"))
    p = F.split("stamp", r"\.")
    return m.select(d(F.make_date(p[0].cast("int"), p[1].cast("int"), F.lit(1))).alias("month"), r(S.ratio("dividend", "price")).alias("dp"), r(S.ratio("earnings", "price")).alias("ep"))


# --- joins ---------------------------------------------------------------------------------------

BOUNDS = "(values ('calm', 0.0, 0.3), ('normal', 0.3, 0.5), ('wild', 0.5, 99.0)) b(band, lo, hi)"


@query("select p.symbol, cast(p.date as varchar) as date, round(p.close - q.close, 8) as gap from prices p join prices q on p.date = q.date and q.symbol = 'Brand#1' where p.symbol <> 'Brand#1'", ("prices",))
def equi_inner(spark, sf_dir):
    p = bars.prices(spark, sf_dir)
    q = p.where("symbol = 'Brand#1'").select("date", F.col("close").alias("base"))
    return p.where("symbol <> 'Brand#1'").join(q, "date").select("symbol", d().alias("date"), r(F.col("close") - F.col("base")).alias("gap"))


FIRST = "select symbol, min(date) as start_date from daily where daily_return <> 0 and date >= date '1997-01-01' group by symbol"


@query(f"select p.symbol, count(*) as n from daily p join ({FIRST}) f on p.symbol = f.symbol and p.date >= f.start_date group by p.symbol", ("daily",))
def equi_plus_range(spark, sf_dir):
    p = daily(spark, sf_dir)
    first = p.where("daily_return <> 0 and date >= date '1997-01-01'").groupBy("symbol").agg(F.min("date").alias("start_date"))
    return p.join(first, "symbol").where("date >= start_date").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query(f"select p.symbol, cast(p.date as varchar) as date, b.band from daily p join {BOUNDS} on p.vol_20d >= b.lo and p.vol_20d < b.hi", ("daily",))
def range_join(spark, sf_dir):
    b = F.broadcast(spark.createDataFrame([("calm", 0.0, 0.3), ("normal", 0.3, 0.5), ("wild", 0.5, 99.0)], "band string, lo double, hi double"))  # three rows
    p = daily(spark, sf_dir)
    return p.join(b, (p.vol_20d >= b.lo) & (p.vol_20d < b.hi)).select("symbol", d().alias("date"), "band")


@query(
    """select cast(p.date as varchar) as date, round(p.close, 8) as close, round(a.close, 8) as gld, round(b.close, 8) as tlt from (select * from prices where symbol = 'Brand#1') p
 left join (select * from prices where symbol = 'Brand#4') a on a.date = p.date left join (select * from prices where symbol = 'Brand#6') b on b.date = p.date""",
    ("prices",),
)
def left_join_on_date(spark, sf_dir):
    """One pass with conditional aggregates instead of a join for each series."""
    p = bars.prices(spark, sf_dir).where("symbol in ('Brand#1', 'Brand#4', 'Brand#6')")
    at = lambda s: F.max(F.when(F.col("symbol") == s, F.col("close")))
    wide = p.groupBy("date").agg(at("Brand#1").alias("close"), at("Brand#4").alias("gld"), at("Brand#6").alias("tlt")).where("close is not null")
    return wide.select(d().alias("date"), *(r(x).alias(x) for x in ("close", "gld", "tlt")))


@query(
    """select cast(s.date as varchar) as date, round(last_value(p.close ignore nulls) over (order by s.date rows between unbounded preceding and current row), 8) as close
 from (select distinct date from prices where symbol = 'Brand#1') s left join (select * from prices where symbol = 'Brand#5') p on p.date = s.date""",
    ("prices",),
)
def calendar_reindex(spark, sf_dir):
    p = bars.prices(spark, sf_dir)
    spine = p.where("symbol = 'Brand#1'").select("date").distinct()
    other = p.where("symbol = 'Brand#5'").select(F.col("date").alias("at"), F.col("close").alias("v"))
    # only rows on the spine count: reindex, then carry forward
    on = other.join(spine, F.col("at") == F.col("date"), "left_semi").withColumnRenamed("at", "date")
    return series.asof_multi(spine, on, {"close": F.col("v")}).select(d().alias("date"), r("close").alias("close"))


@query(
    """select coalesce(a.symbol, b.symbol) as symbol, cast(coalesce(a.date, b.date) as varchar) as date from (select symbol, date from prices where extract(day from date) <> 5) a
 full outer join (select symbol, date from prices where extract(day from date) <> 6) b on a.symbol = b.symbol and a.date = b.date where a.date is null or b.date is null""",
    ("prices",),
)
def full_outer_diff(spark, sf_dir):
    p = bars.prices(spark, sf_dir).select("symbol", "date")
    a, b = p.where("day(date) <> 5").withColumn("ina", F.lit(1)), p.where("day(date) <> 6").withColumn("inb", F.lit(1))
    return a.join(b, ["symbol", "date"], "full_outer").where("ina is null or inb is null").select("symbol", d().alias("date"))


@query("select symbol, cast(date as varchar) as date from prices p where not exists (select 1 from daily q where q.symbol = p.symbol and q.date = p.date)", ("prices", "daily"))
def left_anti(spark, sf_dir):
    p = bars.prices(spark, sf_dir)
    return p.join(series.staged(p).select("symbol", "date"), ["symbol", "date"], "left_anti").select("symbol", d().alias("date"))


@query("select symbol, count(*) as n from prices where symbol in ('Brand#1', 'Brand#2', 'Brand#3') group by symbol", ("prices",))
def left_semi(spark, sf_dir):
    universe = spark.createDataFrame([(s,) for s in UNIVERSE["equal_weight"]], "symbol string")
    return bars.prices(spark, sf_dir).join(F.broadcast(universe), "symbol", "left_semi").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))  # three rows


@query("select distinct series_id from macro where series_id not in ('DGS10', 'DGS2', 'DGS3MO')", ("macro",))
def not_in_allowlist(spark, sf_dir):
    allowed = spark.createDataFrame([("DGS10",), ("DGS2",), ("DGS3MO",)], "series_id string")
    return bars.macro(spark, sf_dir).select("series_id").distinct().join(allowed, "series_id", "left_anti")


@query("select a.strategy as a, b.strategy as b, count(*) as n, round(sum(a.daily_return - b.daily_return), 8) as diff from strat a join strat b on a.date = b.date and a.strategy < b.strategy group by 1, 2", ("strat",))
def self_pair_join(spark, sf_dir):
    return series.pairs(strategies(spark, sf_dir), "strategy", "date", "daily_return").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("x") - F.col("y"))).alias("diff"))


@query("select cast(a.date as varchar) as date, round(a.close / nullif(b.close, 0), 8) as ratio from prices a join prices b on a.date = b.date where a.symbol = 'Brand#2' and b.symbol = 'Brand#1'", ("prices",))
def inner_dates_ratio(spark, sf_dir):
    p = bars.prices(spark, sf_dir).where("symbol in ('Brand#1', 'Brand#2')")
    return series.pairs(p, "symbol", "date", "close").select(d().alias("date"), r(S.ratio("y", "x")).alias("ratio"))


@query("select cast(date as varchar) as date from (select date from prices where symbol = 'Brand#1' intersect select date from prices where symbol = 'Brand#5') x", ("prices",))
def coalesced_dates_intersection(spark, sf_dir):
    p = bars.prices(spark, sf_dir)
    return p.where("symbol = 'Brand#1'").select("date").intersect(p.where("symbol = 'Brand#5'").select("date")).select(d().alias("date"))


@query(
    """select a.event_type, a.n, round(a.mean, 6) as mean, b.verdict from (select event_type, count(*) as n, avg(value) as mean from events group by event_type) a
 left join (select event_type, case when max(value) > 100 then 'fragile' else 'robust' end as verdict from events where user_id % 2 = 0 group by event_type) b on a.event_type = b.event_type"""
)
def merge_table_summaries(spark, sf_dir):
    e = bars.scan(spark, sf_dir, "events")
    a = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value"), 6).alias("mean"))
    b = e.where("user_id % 2 = 0").groupBy("event_type").agg(F.when(F.max("value") > 100, "fragile").otherwise("robust").alias("verdict"))
    return a.join(b, "event_type", "left")
