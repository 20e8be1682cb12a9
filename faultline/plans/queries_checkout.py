"""Registered queries: checkout requests out of order lines, request logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import checkout, request_logs
from faultline.plans import log_view as lv


def catalog(spark, sf_dir):
    return lv.table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("product_id"),
        F.col("p_retailprice").alias("unit_price"), F.col("p_size").alias("stock"),
    )


def requests(spark, sf_dir):
    """Order lines as requests; some without user, quantity or known product."""
    return lv.table(spark, sf_dir, "lineitem").select(
        F.concat(
            F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("-"),
            F.lpad(F.col("l_partkey").cast("string"), 10, "0"), F.lit("-"), F.lpad(F.col("l_suppkey").cast("string"), 10, "0"),
            F.lit("-"), F.lpad(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), 12, "0"),
        ).alias("seq"),
        F.when(F.col("l_suppkey") % 50 == 0, "").otherwise(F.concat(F.lit("u"), F.col("l_suppkey").cast("string"))).alias("user_id"),
        F.when(F.col("l_partkey") % 101 == 0, F.concat(F.lit("x"), F.col("l_partkey").cast("string")))
        .otherwise(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("product_id"),
        F.when(F.col("l_suppkey") % 40 == 0, 0).otherwise(F.col("l_quantity").cast("int")).alias("quantity"),
    )


REQUESTS_SQL = """
cat as (select 'p' || p_partkey as product_id, p_retailprice as unit_price, p_size as stock from part),
req as (select lpad(l_orderkey::varchar, 12, '0') || '-' || l_linenumber || '-' || lpad(l_partkey::varchar, 10, '0') || '-' ||
    lpad(l_suppkey::varchar, 10, '0') || '-' || lpad(cast(round(l_extendedprice * 100) as bigint)::varchar, 12, '0') as seq, case when l_suppkey % 50 = 0 then '' else 'u' || l_suppkey end as user_id,
  case when l_partkey % 101 = 0 then 'x' else 'p' end || l_partkey as product_id,
  case when l_suppkey % 40 = 0 then 0 else cast(l_quantity as int) end as quantity from lineitem),
cr as (select req.*, unit_price, stock, user_id <> '' and quantity > 0 as is_valid from req left join cat using (product_id))"""

_PRICE_SQL = """case when quantity >= 10 then unit_price * quantity * 0.9::double
    when {stock} <> quantity then unit_price * quantity * (1.0::double - 0.05::double / ({stock} - quantity)::double) end"""


def checkout_price(spark, sf_dir):
    """K-02, K-04: price of every request for a known product, NULL where it divides by zero."""
    rows = requests(spark, sf_dir).join(catalog(spark, sf_dir), "product_id")
    return rows.select(
        "seq", "product_id", "quantity",
        checkout.total_price(F.col("unit_price"), F.col("quantity"), F.col("stock")).alias("total_price"),
    )


def checkout_outcome(spark, sf_dir):
    """K-01..K-05: outcome code of every request against the opening stock."""
    return checkout.outcomes(requests(spark, sf_dir), catalog(spark, sf_dir))


OUTCOME = "with " + REQUESTS_SQL + f""",
o as (select *, {_PRICE_SQL.format(stock='stock')} as price from cr),
s as (select *, case when not is_valid then 422 when stock is null then 404 when stock < quantity then 409 when price is null then 500 else 200 end as status from o)
select seq, user_id, product_id, quantity, status, case when status = 200 then price end as total_price from s"""


def stock_ledger(spark, sf_dir):
    """K-06: outcome of every request against the stock it met."""
    # a million order keys a block
    return checkout.ledger(requests(spark, sf_dir), catalog(spark, sf_dir), block=F.substring("seq", 1, 6))


LEDGER = "with recursive " + REQUESTS_SQL + f""",
q as (select *, row_number() over (partition by product_id order by seq) as pos from cr where is_valid and stock is not null),
w(product_id, pos, remaining) as (
  select product_id, cast(0 as bigint), stock from cat
  union all
  select q.product_id, q.pos, case when (quantity >= 10 and remaining >= quantity) or (quantity < 10 and remaining > quantity)
    then remaining - quantity else remaining end
  from w join q on q.product_id = w.product_id and q.pos = w.pos + 1),
m as (select cr.*, w.remaining from cr left join q on q.seq = cr.seq left join w on w.product_id = q.product_id and w.pos = q.pos - 1),
o as (select *, {_PRICE_SQL.format(stock='remaining')} as price,
  case when not is_valid then 422 when stock is null then 404 when remaining < quantity then 409
    when quantity < 10 and remaining = quantity then 500 else 200 end as status from m)
select seq, user_id, product_id, quantity, status, case when status = 200 then price end as total_price from o"""


def _lines(spark, sf_dir):
    k = F.col("k")
    return lv.view(spark, sf_dir).select(
        "seq", "ts", "severity", F.concat(F.lit("Request for "), F.coalesce("endpoint", F.lit("/"))).alias("message"),
        F.expr("concat('r-', seq div 2)").alias("request_id"), F.lit("POST").alias("http_method"), "endpoint",
        F.when(k % 5 == 0, 500).when(k % 5 == 1, 404).otherwise(200).alias("http_status"),
        F.col("value").alias("latency_ms"), "error_type", F.lit("t-1").alias("token"), F.col("user_id").alias("user"),
    )


def log_records(spark, sf_dir):
    """K-07: one JSON line per record, allow-listed fields only."""
    return request_logs.log_records(_lines(spark, sf_dir), "checkout-api")


_LINES_SQL = lv.VIEW_SQL + """,
ln as (select *, 'r-' || (seq // 2) as rid, case k % 5 when 0 then 500 when 1 then 404 else 200 end as status from v)"""

RECORDS = "with " + _LINES_SQL + """
select seq, '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z","severity":"' || severity ||
  '","service":"checkout-api","environment":"development","version":"local","message":"Request for ' || coalesce(endpoint, '/') ||
  '","request_id":"' || rid || '","http_method":"POST"' || coalesce(',"endpoint":"' || endpoint || '"', '') || ',"http_status":' || status ||
  ',"latency_ms":' || value || coalesce(',"error_type":"' || error_type || '"', '') || '}' as payload from ln"""


def request_rollup(spark, sf_dir):
    """K-08: one row per request out of its log lines."""
    return request_logs.request_rollup(_lines(spark, sf_dir))


ROLLUP = "with " + _LINES_SQL + """
select rid as request_id, count(*) as lines, max(status) as http_status, max(value) as latency_ms, min(ts) as started_at,
  count(*) filter (where severity in ('ERROR', 'CRITICAL')) as error_lines from ln group by 1"""

QUERIES = {
    "checkout_price": (checkout_price, "with " + REQUESTS_SQL + f"""
select seq, product_id, quantity, {_PRICE_SQL.format(stock='stock')} as total_price from cr where stock is not null"""),
    "checkout_outcome": (checkout_outcome, OUTCOME),
    "stock_ledger": (stock_ledger, LEDGER),
    "log_records": (log_records, RECORDS),
    "request_rollup": (request_rollup, ROLLUP),
}
