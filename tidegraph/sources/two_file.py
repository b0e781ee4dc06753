"""Adapter of the external two-file source: a transaction file and an identity file."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.functions.normal import trimmed
from tidegraph.operators.attach import one_to_one_left
from tidegraph.operators.quality import validate_transactions
from tidegraph.schema import CANONICAL_COLUMNS
from tidegraph.session import path_exists

# File names and columns of the external format.
TRANSACTION_FILE, IDENTITY_FILE = "train_transaction.csv", "train_identity.csv"
CARD_PARTS = tuple(f"card{i}" for i in range(1, 7))
DEVICE_PARTS = ("DeviceType", "DeviceInfo", "id_30", "id_31")
TRANSACTION_COLUMNS = ("TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "ProductCD", *CARD_PARTS, "addr1", "addr2", "P_emaildomain", "R_emaildomain")
IDENTITY_COLUMNS = ("TransactionID", *DEVICE_PARTS)
REQUIRED = ("TransactionID", "isFraud", "TransactionDT", "TransactionAmt")


def files_available(spark: SparkSession, folder: str | Path) -> bool:
    return all(path_exists(spark, f"{folder}/{f}") for f in (TRANSACTION_FILE, IDENTITY_FILE))


def pruned_csv(spark: SparkSession, path: str | Path, wanted: Sequence[str], max_rows: int | None = None) -> DataFrame:
    """The wanted columns that the header has, read as text; other columns are pruned at the scan.

    ``max_rows`` keeps the first rows in file order and is meant for small slices: it reads one
    file with a single task.
    """
    header = spark.read.option("header", True).csv(str(path)).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    df = spark.read.option("header", True).schema(schema).csv(str(path)).select(*(c for c in wanted if c in header))
    if max_rows is not None:
        if max_rows <= 0:
            raise ValueError("max_rows must be positive")
        df = df.coalesce(1).limit(max_rows)
    return df


def key_part(c: Column) -> Column:
    """A key's part: trimmed, lower-cased, whole numbers without fraction; NULL if empty."""
    text = F.lower(trimmed(c.cast("string")))
    whole = F.regexp_extract(text, r"^(-?\d+)\.0+$", 1)
    return F.nullif(F.when(whole != "", whole).otherwise(text), F.lit(""))


def entity_key(prefix: str, *parts: Column) -> Column:
    """``prefix:`` and 16 hex digits of the SHA-256 of the parts; NULL if all parts are absent."""
    clean = [key_part(p) for p in parts]
    payload = F.concat_ws("|", *(F.coalesce(p, F.lit("<missing>")) for p in clean))
    return F.when(F.coalesce(*clean).isNotNull(), F.concat(F.lit(prefix + ":"), F.left(F.sha2(payload, 256), F.lit(16))))


def load_two_file(spark: SparkSession, folder: str | Path, *, max_rows: int | None = None, strict_recipient: bool = False) -> DataFrame:
    """The canonical table from both files, validated and in causal order.

    A missing recipient domain still gives a recipient key per product, as the source format has
    it; ``strict_recipient`` leaves it NULL instead. Source columns are kept with prefix ``raw_``.
    """
    absent = [f for f in (TRANSACTION_FILE, IDENTITY_FILE) if not path_exists(spark, f"{folder}/{f}")]
    if absent:
        raise FileNotFoundError(", ".join(absent))
    txns = pruned_csv(spark, f"{folder}/{TRANSACTION_FILE}", TRANSACTION_COLUMNS, max_rows)
    lacking = sorted(set(REQUIRED) - set(txns.columns))
    if lacking:
        raise ValueError(f"transaction file lacks {', '.join(lacking)}")
    identity = pruned_csv(spark, f"{folder}/{IDENTITY_FILE}", IDENTITY_COLUMNS)
    both = one_to_one_left(txns, identity, "TransactionID", reduce_first=True)
    col = lambda c: F.col(c) if c in both.columns else F.lit(None).cast("string")
    domain = lambda c: F.lower(trimmed(col(c)))
    shaped = both.select(
        F.concat(F.lit("ieee:"), F.col("TransactionID")).alias("transaction_id"), F.col("TransactionDT").alias("transaction_time"), F.col("TransactionAmt").alias("amount"),
        F.coalesce(col("ProductCD"), F.lit("unknown")).alias("product_code"), entity_key("card", *map(col, CARD_PARTS)).alias("card_id"),
        entity_key("device", *map(col, DEVICE_PARTS)).alias("device_id"), entity_key("address", col("addr1"), col("addr2")).alias("address_id"),
        domain("P_emaildomain").alias("payer_email_domain"), domain("R_emaildomain").alias("recipient_email_domain"),
        F.col("isFraud").alias("is_fraud"), F.lit("ieee_cis").alias("source"),
        *(F.col(c).alias(f"raw_{c}") for c in both.columns if c not in REQUIRED),
        col("addr1").alias("__addr1"),
    )
    recipient = entity_key("recipient_proxy", F.col("product_code"), F.col("recipient_email_domain"))
    keyed = shaped.withColumns(
        {
            "customer_id": entity_key("customer_proxy", F.col("card_id"), F.col("__addr1"), F.col("payer_email_domain")),
            "recipient_id": F.when(F.col("recipient_email_domain").isNotNull(), recipient) if strict_recipient else recipient,
        }
    )
    raw = [c for c in keyed.columns if c.startswith("raw_")]
    return validate_transactions(keyed.select(*CANONICAL_COLUMNS, *raw))
