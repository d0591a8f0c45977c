"""Identity of incoming documents: owners, content hashes, fingerprints, and who is a duplicate of whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import normalize_phone
from ledgerloom.scratch import drop, written


def owner_keys(docs: DataFrame, client_email: DataFrame, ledger: DataFrame) -> DataFrame:
    """``docs`` with owner_key: the client behind an allowed sender or a phone of one client, else the sender itself."""
    emails = client_email.select(F.lower("email").alias("mail"), F.col("client_id").alias("mail_client"))
    phones = ledger.where("driver_phone is not null").groupBy(F.col("driver_phone").alias("phone")).agg(
        F.count_distinct("client_id").alias("owners"), F.min("client_id").alias("phone_client")).where("owners = 1")
    mail, phone = F.lower("sender_identifier"), normalize_phone("sender_identifier")
    keyed = docs.withColumn("mail", F.when(F.col("source") == "EMAIL", mail)).withColumn("phone", F.when(F.col("source") == "WHATSAPP", phone))
    client = F.coalesce("mail_client", "phone_client")
    return keyed.join(emails, "mail", "left").join(phones, "phone", "left").withColumn(
        "owner_key", F.when(client.isNotNull(), F.concat(F.lit("client:"), client)).when(F.col("mail").isNotNull(), F.concat(F.lit("email:"), "mail")).otherwise(F.concat(F.lit("phone:"), "phone"))
    ).drop("mail", "phone", "mail_client", "phone_client", "owners")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def fingerprint(auth: Column, invoice: Column, vat: Column, merchant_core: Column, qr: Column) -> Column:
    """Hash of what names a purchase: its authorization, else seller and invoice, else the QR code; null without any.

    ``merchant_core`` is the normalised name, as ``text.with_normalized`` gives it.
    """
    plain = lambda c: F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), r"[^A-Z0-9؀-ۿ]", "")
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    seller = F.when(plain(vat) != "", plain(vat)).otherwise(F.coalesce(merchant_core, F.lit("")))
    identity = (
        F.when(has(auth), F.concat(F.lit("AUTH:"), plain(auth)))
        .when(has(invoice), F.concat(F.lit("INVOICE:"), seller, F.lit(":"), plain(invoice)))
        .when(has(qr), F.concat(F.lit("QR:"), F.trim(qr))))
    return F.sha2(identity, 256)


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``rows`` with duplicate_of: the first row's id where the key came before; null keys never collide.

    ``order`` names columns that tell rows of one key apart. The first row of a key is an aggregate, combined in each
    task; only rows with a key that others share look it up. A key that a third of all rows share is one row there, so
    the join can be split.
    """
    place = F.struct(*[F.col(c) for c in order], F.col("id").alias("_id"))
    firsts = rows.dropna(subset=key).groupBy(*key).agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    # Rows of null keys meet nothing; they are dealt by their id, not all to one task.
    known = F.least(F.lit(True), *[F.col(k).isNotNull() for k in key])
    salted = rows.withColumn("_salt", F.when(known, F.lit(0).cast("long")).otherwise(F.xxhash64("id")))
    met = salted.join(firsts.withColumn("_salt", F.lit(0).cast("long")), [*key, "_salt"], "left")
    first = F.col("_first")["_id"]
    return met.select(*rows.columns, F.when(first != F.col("id"), first).alias("duplicate_of"))


def survivors(rows: DataFrame, keys: list[list[str]], order: str = "id") -> DataFrame:
    """``(id, survives)``: a row is a duplicate if it shares a key with an earlier row that survives.

    That isn't transitive: rows are decided in rounds. A row that is first among the undecided on all its keys survives;
    one that shares a key with an earlier survivor falls. Each round decides the first undecided row at least, and in
    practice nearly all; keys are grouped with their earliest row only.
    """
    state = written(rows.select("id", F.col(order).alias("order"), *[
        F.when(F.greatest(*[F.col(c).isNull() for c in key], F.lit(False)), F.lit(None)).otherwise(F.concat_ws("\u0001", *key)).alias(f"k{i}")
        for i, key in enumerate(keys)]).withColumn("survives", F.lit(None).cast("boolean")), "survivors")
    place = F.struct("order", "id")
    while not state.where("survives is null").isEmpty():
        marked = state
        for i in range(len(keys)):
            own = state.where(f"k{i} is not null").groupBy(f"k{i}").agg(
                F.min(F.when(F.col("survives").isNull(), place)).alias("open"), F.min(F.when(F.col("survives"), place)).alias("kept"))
            marked = marked.join(own.select(f"k{i}", F.col("open").alias(f"open{i}"), F.col("kept").alias(f"kept{i}")), f"k{i}", "left")
        falls = F.greatest(F.lit(False), *[F.coalesce(F.col(f"kept{i}") < place, F.lit(False)) for i in range(len(keys))])
        first = F.least(F.lit(True), *[F.col(f"k{i}").isNull() | (F.col(f"open{i}") == place) for i in range(len(keys))])
        decided = F.when(F.col("survives").isNotNull(), F.col("survives")).when(falls, False).when(first, True)
        step = written(marked.select("id", "order", *[f"k{i}" for i in range(len(keys))], decided.alias("survives")), "survivors")
        drop(state)
        state = step
    return state.select("id", "survives")


def unseen(rows: DataFrame, stored: DataFrame, keys: list[list[str]]) -> DataFrame:
    """Rows that share no key with stored documents: an anti join for each key."""
    for key in keys:
        rows = rows.join(stored.select(*key).dropna().distinct(), key, "left_anti")
    return rows
