"""Checkout requests against a catalog: outcome codes, prices, stock ledger.

Requests: ``seq, user_id, product_id, quantity``. Catalog: ``product_id,
unit_price, stock``, one row per product.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import fixed_values as fv
from faultline.functions.text import is_empty
from faultline.operators.running import Running, arrival_block, with_running
from faultline.session import stored

OK, UNPROCESSABLE, NOT_FOUND, CONFLICT, SERVER_ERROR = 200, 422, 404, 409, 500
SPREAD = 64


def is_valid_request() -> Column:
    return ~is_empty(F.col("user_id")) & ~is_empty(F.col("product_id")) & F.coalesce(
        F.col("quantity") > 0, F.lit(False)
    )


def total_price(unit_price: Column, quantity: Column, stock: Column) -> Column:
    """Unrounded price, NULL where the clearance rate divides by zero."""
    full = unit_price * quantity
    bulk = full * F.lit(1 - fv.BULK_RATE)
    clearance = full * (F.lit(1.0) - F.try_divide(F.lit(fv.CLEARANCE_RATE), (stock - quantity).cast("double")))
    return F.when(quantity >= fv.BULK_QUANTITY, bulk).otherwise(clearance)


def _with_catalog(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    # No broadcast hint: the optimizer broadcasts the catalog if it is small.
    known = catalog.select("product_id", "unit_price", "stock", F.lit(True).alias("_known"))
    return requests.join(known, "product_id", "left")


def outcomes(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each request by itself against the opening stock: ``status, total_price``."""
    priced = _with_catalog(requests, catalog).withColumn(
        "_price", total_price(F.col("unit_price"), F.col("quantity"), F.col("stock"))
    )
    status = (
        F.when(~is_valid_request(), UNPROCESSABLE)
        .when(F.col("_known").isNull(), NOT_FOUND)
        .when(F.col("stock") < F.col("quantity"), CONFLICT)
        .when(F.col("_price").isNull(), SERVER_ERROR)
        .otherwise(OK)
    )
    return (
        priced.withColumn("status", status)
        .withColumn("total_price", F.when(F.col("status") == OK, F.col("_price")))
        .select(*requests.columns, "status", "total_price")
    )


def _fits(quantity: Column, left: Column) -> Column:
    """Whether an order goes through: enough is left, and the price exists."""
    return F.when(quantity >= fv.BULK_QUANTITY, quantity <= left).otherwise(quantity < left)


def _unbroken(valid: DataFrame, block: Column) -> DataFrame:
    """``valid`` with ``before`` and ``whole``: what orders before and up to it ask for, of those that the opening stock allows.

    A product's orders are cut into blocks by ``seq``. A block whose orders all fit takes its sum from any stock that is
    left, so sums of blocks are added up first, and each block's orders on their own.
    """
    allowed = valid.filter(_fits(F.col("quantity"), F.col("stock")))
    ran = with_running(allowed, ["product_id"], F.col("seq"), block, {"whole": Running("sum", F.col("quantity"))})
    return ran.withColumn("before", F.col("whole") - F.col("quantity"))


def _order_block(requests: DataFrame) -> Column:
    """Blocks of the order of requests; one for an order by texts, which tells nothing of its ranges."""
    return F.lit(0) if isinstance(requests.schema["seq"].dataType, T.StringType) else arrival_block(requests)


def _candidates(valid: DataFrame, spread: int) -> DataFrame:
    """The orders that can be accepted at all, few per product where the stock is small.

    Stock only falls, so once an order of a quantity is refused all later ones
    of that quantity are: the accepted ones are among the first ``stock / quantity``
    of each part of that quantity's orders. The salt keeps the parts small.
    """
    salted = Window.partitionBy("product_id", "quantity", "_salt").orderBy("seq")
    return (
        valid.filter(F.col("quantity") <= F.col("stock"))
        .withColumn("_salt", F.pmod(F.xxhash64("seq"), F.lit(spread)))
        .withColumn("_rank", F.row_number().over(salted))
        .filter(F.col("_rank") <= F.floor(F.col("stock") / F.col("quantity")))
    )


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Orders that go through among rows sorted by product and ``seq``, with the stock each meets.

    One pass that holds the stock left of one product, also from batch to batch.
    """
    product, left = None, 0
    for batch in batches:
        kept, before = [], []
        rows = zip(*(batch.column(c).to_pylist() for c in ("product_id", "quantity", "stock")), strict=True)
        for i, (name, quantity, stock) in enumerate(rows):
            if name != product:
                product, left = name, stock
            # enough is left, and the price exists
            if left >= quantity if quantity >= fv.BULK_QUANTITY else left > quantity:
                kept.append(i)
                before.append(left)
                left -= quantity
        names = ["seq", "product_id", "unit_price", "quantity"]
        columns = [batch.column(c).take(pa.array(kept, pa.int64())) for c in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64())], [*names, "stock_before"])


def accepted_orders(requests: DataFrame, catalog: DataFrame, spread: int = SPREAD, block: Column | None = None) -> DataFrame:
    """Orders that went through, each with the stock before and after it.

    Up to a product's first refusal every order goes through, so those are found from running sums over blocks, whatever
    their number. What is left then is less than the quantity refused. Of the later orders only those that may still fit
    into that stream through the greedy pass: their number is bounded by that quantity, not by stock or orders.
    ``block`` is a column that grows with ``seq``; for numbers and arrival orders there is one.
    """
    return _accepted(stored(_with_catalog(requests, catalog), "opened-requests", compression="zstd"), spread, block)


def _accepted(opened: DataFrame, spread: int, block: Column | None) -> DataFrame:
    """``accepted_orders`` of requests that have their product's catalog row beside them. ``opened`` is read twice."""
    valid = opened.filter(is_valid_request() & F.col("_known")).select(
        "seq", "product_id", "unit_price", F.col("quantity").cast("long").alias("quantity"), F.col("stock").cast("long").alias("stock"))
    ran = stored(_unbroken(valid, _order_block(opened) if block is None else block), "running-orders", compression="zstd")
    # sums only rise, and a refused order is in the sum of every later one: the fitting ones are the first
    fits = _fits(F.col("quantity"), F.col("stock") - F.col("before"))
    first = ran.filter(fits).select("seq", "product_id", "unit_price", "quantity", (F.col("stock") - F.col("before")).alias("stock_before"))
    used = ran.filter(fits).groupBy("product_id").agg(F.max("whole").alias("used"))
    later = ran.filter(~fits).join(used, "product_id", "left").withColumn("stock", F.col("stock") - F.coalesce("used", F.lit(0)))
    rows = _candidates(later, spread).select("seq", "product_id", "unit_price", "quantity", "stock")
    dealt = rows.repartition("product_id").sortWithinPartitions("product_id", "seq")
    schema = dealt.drop("stock").schema.add("stock_before", "long")
    return first.unionByName(dealt.mapInArrow(_taken, schema)).select(
        "seq", "product_id", "quantity", "stock_before",
        (F.col("stock_before") - F.col("quantity")).alias("stock_after"),
        total_price(F.col("unit_price"), F.col("quantity"), F.col("stock_before")).alias("total_price"),
    )


def ledger(requests: DataFrame, catalog: DataFrame, spread: int = SPREAD, block: Column | None = None) -> DataFrame:
    """Every request in order against the stock it met: ``status, total_price``.

    A refused small order is a server error exactly while the stock equals its
    quantity (the price then divides by zero), else a conflict. Each stock level
    of a product lasts one interval of ``seq``, so that is an equi-join on
    (product, level) with a table the catalog bounds. No level is above the
    opening stock, so an order of more than that is a conflict without a join.
    """
    # Read four times below; the catalog is joined once.
    opened = stored(_with_catalog(requests, catalog), "opened-requests", compression="zstd")
    # Read three times below, and no larger than the catalog's stock.
    orders = stored(_accepted(opened, spread, block), "accepted-orders", compression="zstd")
    by_order = Window.partitionBy("product_id").orderBy("seq")
    reached = orders.select(
        "product_id", F.col("stock_after").alias("quantity"), F.col("seq").alias("level_from"),
        F.lead("seq").over(by_order).alias("level_to"),
    )
    none = F.lit(None).cast(requests.schema["seq"].dataType)
    first = orders.groupBy("product_id").agg(F.min("seq").alias("level_to"))
    opening = catalog.join(first, "product_id", "left").select(
        "product_id", F.col("stock").cast("bigint").alias("quantity"), none.alias("level_from"), "level_to"
    )
    levels = reached.unionByName(opening).withColumn("_level", F.lit(True))
    priced = orders.select("seq", "total_price", F.lit(True).alias("_accepted"))
    reachable = F.coalesce(F.col("quantity") <= F.col("stock"), F.lit(False))
    joined = (
        opened.filter(reachable)
        .join(priced, "seq", "left")
        .join(levels, ["product_id", "quantity"], "left")
    )
    beyond = opened.filter(~reachable)
    at_level = (
        F.col("_level").isNotNull()
        & (F.col("level_from").isNull() | (F.col("seq") > F.col("level_from")))
        & (F.col("level_to").isNull() | (F.col("seq") < F.col("level_to")))
    )
    refused = F.when(~is_valid_request(), UNPROCESSABLE).when(F.col("_known").isNull(), NOT_FOUND)
    status = (
        refused.when(F.col("_accepted").isNotNull(), OK)
        .when(at_level & (F.col("quantity") < fv.BULK_QUANTITY), SERVER_ERROR)
        .otherwise(CONFLICT)
    )
    return joined.select(*requests.columns, status.alias("status"), "total_price").unionByName(
        beyond.select(*requests.columns, refused.otherwise(CONFLICT).alias("status"), F.lit(None).cast("double").alias("total_price")))
