"""The linkage tables that the driver's star-schema tables stand for, by arithmetic alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import merchant_branch, merchant_city, merchant_dictionary
from ledgerloom.scratch import written


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card transactions: one per order, of the customer's nation as client, at a merchant named after a part."""
    orders, customer, part = (load(spark, sf_dir, t) for t in ("orders", "customer", "part"))
    parts = part.agg(F.count("*").alias("parts"))  # one row
    city = F.element_at(F.array(*map(F.lit, ("RUH", "JED", "DMM", "MED"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    joined = (
        orders.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .crossJoin(F.broadcast(parts)).withColumn("p_partkey", F.col("o_orderkey") % F.col("parts"))
        .join(part.select("p_partkey", "p_name"), "p_partkey"))
    key = F.col("o_orderkey")
    return joined.select(
        key.alias("tx_id"), F.col("c_nationkey").cast("long").alias("client_id"),
        F.concat(F.lit("+"), (F.lit(966500000000) + F.col("o_custkey")).cast("string")).alias("driver_phone"),
        F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0").alias("tx_card"),
        F.concat(F.upper("p_name"), F.lit(" ST 0"), (key % 9 + 1).cast("string"), F.lit(" "), city).alias("tx_merchant"),
        F.when(key % 7 == 0, F.concat(F.lit("3000000"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0"))).alias("tx_vat"),
        F.when(key % 6 == 0, F.concat(F.lit("INV-"), key.cast("string"))).alias("tx_invoice"),
        F.when(key % 11 == 0, F.concat(F.lit("A"), key.cast("string"))).alias("tx_auth"),
        F.when(key % 5 == 0, "CAFE").alias("tx_category"), F.floor(F.col("o_totalprice") * 100 + F.lit(0.5)).cast("long").alias("tx_amount"),
        F.lit("SAR").alias("tx_currency"), F.col("o_orderdate").cast("timestamp").alias("tx_at"), F.col("p_name").alias("part_name"), F.col("o_custkey").alias("cust"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of every third transaction, with amounts, dates, cards and names off in known ways."""
    tx = ledger(spark, sf_dir).where("tx_id % 3 = 0")
    key = F.col("tx_id")
    kind = F.floor(key / 3) % 10
    amount = F.col("tx_amount").cast("double")
    off = F.when(kind == 5, amount * 1.001).when(kind == 6, amount * 0.91).when(kind == 7, amount * 1.015).when(kind == 8, amount * 0.6).otherwise(amount)
    date = F.when(key % 13 != 0, F.col("tx_at") + F.make_interval(days=(key % 6).cast("int")))
    received = F.col("tx_at") + F.make_interval(days=F.lit(7))
    return tx.select(
        key.alias("doc_id"), F.lit("EMAIL").alias("source"), F.concat(F.lit("OPS@nation"), F.col("client_id").cast("string"), F.lit(".example")).alias("sender_identifier"),
        F.when(key % 2 == 0, "RECEIPT").otherwise("TAX_INVOICE").alias("doc_type"), F.floor(off + F.lit(0.5)).cast("long").alias("doc_amount"),
        F.when(kind == 9, "USD").otherwise("sar ").alias("doc_currency"), F.coalesce(date, received).alias("doc_date"),
        F.when(date.isNull(), "RECEIVED_AT").otherwise("PRINTED").alias("doc_date_source"), F.when(key % 4 != 0, F.col("tx_card")).alias("doc_card"),
        F.concat(F.col("part_name"), F.lit(" Station")).alias("doc_merchant"), F.when(key % 7 == 0, F.col("tx_vat")).alias("doc_vat"),
        F.when(key % 12 == 0, F.col("tx_invoice")).alias("doc_invoice"), F.when(key % 11 == 0, F.col("tx_auth")).alias("doc_auth"), received.alias("received_at"),
        F.when(key % 7 < 3, 0.9).alias("conf_amount"), F.when(key % 7 == 3, 0.5).alias("conf_date"), F.when(key % 7 == 4, 0.75).alias("conf_merchant"),
        F.when(key % 7 == 5, 0.6).alias("conf_card"), F.when(key % 2 == 0, 0.95).alias("conf_currency"), F.lit(None).cast("double").alias("conf_vat"),
        F.lit(None).cast("double").alias("conf_invoice"), F.lit(None).cast("double").alias("conf_auth"), F.when(key % 50 == 0, 0.2).otherwise(0.9).alias("extraction_confidence"))


def client_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("long")
    return nation.select(key.alias("id"), key.alias("client_id"), F.concat(F.lit("ops@nation"), key.cast("string"), F.lit(".example")).alias("email"))


def with_names(rows: DataFrame, side: str) -> DataFrame:
    """Rows with the normalised core, city and branch of their merchant; each distinct name is looked at once.

    The names are written, so that Spark knows their size before it joins: where they are few, no row moves.
    """
    name = f"{side}_merchant"
    known = written(merchant_dictionary(rows, name).select(
        F.col("name").alias(name), F.col("normalized").alias(f"{side}_core"), merchant_city("name").alias(f"{side}_city"), merchant_branch("name").alias(f"{side}_branch")), "names")
    return rows.join(known, name, "left")


DOC_COLUMNS = [
    "doc_id", "doc_type", "doc_amount", "doc_currency", "doc_date", "doc_date_source", "doc_card", "doc_merchant", "doc_vat", "doc_invoice", "doc_auth",
    "conf_amount", "conf_date", "conf_merchant", "conf_card", "conf_currency", "conf_vat", "conf_invoice", "conf_auth"]
TX_COLUMNS = ["tx_id", "tx_card", "tx_merchant", "tx_vat", "tx_invoice", "tx_auth", "tx_category", "tx_amount", "tx_currency", "tx_at"]
