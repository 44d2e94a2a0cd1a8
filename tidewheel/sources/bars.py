"""Keyed series from the driver's star tables: prices, macro, annual."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One text for both engines: order-free integer sums, so results are bit-identical.
PRICES = """
select symbol, case cast(substr(symbol, 7) as int) % 5 when 0 then 'crypto' when 1 then 'equities' when 2 then 'bonds' when 3 then 'commodities' else 'fx' end as asset_class, date,
 100 + ((lo + hi) / 2 - 50000) / 5000 as open, 100 + (hi - 50000) / 5000 as high, 100 + (lo - 50000) / 5000 as low,
 100 + (cast(cents as double) / cast(n * 100 as double) - 50000) / 5000 as close,
 cast(case when extract(day from date) = 13 then 0 else q end as bigint) as volume, 'sample' as source
from (select p.p_brand as symbol, cast(l.l_shipdate as date) as date, min(l.l_extendedprice) as lo, max(l.l_extendedprice) as hi,
 sum(cast(round(l.l_extendedprice * 100) as bigint)) as cents, count(*) as n, sum(cast(l.l_quantity as bigint)) as q
 from lineitem l join part p on l.l_partkey = p.p_partkey group by p.p_brand, cast(l.l_shipdate as date)) b
"""
MACRO = """
select case o_orderpriority when '1-URGENT' then 'DGS10' when '2-HIGH' then 'DGS2' when '3-MEDIUM' then 'DGS3MO' when '4-NOT SPECIFIED' then 'VIXCLS' else 'NFCI' end as series_id,
 cast(o_orderdate as date) as date, cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / cast(count(*) * 10000000 as double) as value, 'sample' as source
from orders group by o_orderpriority, cast(o_orderdate as date)
"""
#: Stand-ins for the series of the wide macro table, by priority and customer: the first is T10Y2Y.
MARKET_SERIES = (
    "T10Y2Y", "DGS10", "DGS2", "DGS3MO", "FEDFUNDS", "VIXCLS", "DCOILWTICO", "DTWEXBGS", "ICSA", "NFCI", "INDPRO", "CPIAUCSL", "PCEPILFE", "UNRATE", "PAYEMS",
    "M2SL", "WALCL", "UMCSENT", "SAHMREALTIME", "recession_prob", "cape", "excess_cape_yield", "div_yield", "earn_yield",
)
MARKET = f"""
select case k {' '.join(f"when {i} then '{s}'" for i, s in enumerate(MARKET_SERIES))} else 'OTHER' end as series_id, date, cast(sum(cents) as double) / cast(count(*) * 10000000 as double) as value
from (select cast(o_custkey % 25 as int) as k, cast(o_orderdate as date) as date, cast(round(o_totalprice * 100) as bigint) as cents from orders ) o group by k, date
"""
ANNUAL = """
select c.c_mktsegment as indicator_id, n.n_name as country, cast(extract(year from o.o_orderdate) as int) as year,
 cast(sum(cast(round(o.o_totalprice * 100) as bigint)) as double) / cast(count(*) * 100 as double) as value, 'sample' as source
from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey
group by c.c_mktsegment, n.n_name, extract(year from o.o_orderdate)
"""
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; columns and filters used later reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _from_sql(spark: SparkSession, sf_dir: str, text: str, tables: tuple[str, ...]) -> DataFrame:
    return spark.sql(_named(text, tables), **{t: scan(spark, sf_dir, t) for t in tables})


def _named(text: str, tables: tuple[str, ...]) -> str:
    for t in tables:
        text = text.replace(f"from {t} ", f"from {{{t}}} ").replace(f"join {t} ", f"join {{{t}}} ")
    return text


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_sql(spark, sf_dir, PRICES, ("lineitem", "part"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_sql(spark, sf_dir, MACRO, ("orders",))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_sql(spark, sf_dir, MARKET, ("orders",))


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_sql(spark, sf_dir, ANNUAL, ("orders", "customer", "nation"))
