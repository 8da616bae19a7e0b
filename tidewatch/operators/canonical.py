"""Raw datasets to the canonical transaction table. Pure projections (one join for the identity table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalars import (
    blank_to_null,
    device_text,
    enum_map,
    hmac_sha256,
    number_or_null,
    text_or_blank,
    to_cents,
    ulid,
)
from tidewatch.schema import CANONICAL, RAW, SCHEMA_VERSION

# Start of the data (UTC seconds) and the meaning of the payment types.
IEEE_CIS_EPOCH = 1_512_086_400  # 2017-12-01
PAYSIM_EPOCH = 1_514_764_800  # 2018-01-01
PAYSIM_CHANNELS = {
    "PAYMENT": "transfer",
    "TRANSFER": "transfer",
    "CASH_OUT": "atm",
    "CASH_IN": "atm",
    "DEBIT": "card_present",
    "PAY_SALARY": "transfer",
}

#: Columns that name a person; they never go into the attribute bag.
DIRECT_IDENTIFIERS = ("cc_num", "first", "last", "street", "dob")


def to_canonical(df: DataFrame, source: str, columns: dict[str, Column]) -> DataFrame:
    """The canonical columns in order, with the given expressions and nulls for the rest."""
    given = {"dataset_source": F.lit(source), "schema_version": F.lit(SCHEMA_VERSION), **columns}
    return df.select(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CANONICAL.fields]
    )


def attribute_bag(columns: dict[str, Column], kind: str | None = None) -> Column:
    """The columns as texts under their names. Where all are of one ``kind``, one loop makes the texts: an expression for
    each of many columns would be more code than the JVM compiles."""
    if kind is None:
        return F.create_map(*[x for name, c in columns.items() for x in (F.lit(name), c.cast("string"))])
    texts = F.transform(F.array(*[c.cast(kind) for c in columns.values()]), lambda c: c.cast("string"))
    return F.map_from_arrays(F.array(*[F.lit(name) for name in columns]), texts)


def _one_kind(df: DataFrame, names: list[str]) -> str | None:
    """The type that all these columns have, if they have one."""
    kinds = {df.schema[name].dataType.simpleString() for name in names}
    return kinds.pop() if len(kinds) == 1 else None


def label_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(0))


def canonicalize_ieee_cis(
    transactions: DataFrame, identity: DataFrame | None, key: str, epoch: int = IEEE_CIS_EPOCH
) -> DataFrame:
    """Card transactions with an optional identity row each; a missing identity table yields nulls."""
    if identity is None:
        identity = transactions.sparkSession.createDataFrame([], RAW["ieee_cis_identity"])
    joined = transactions.join(identity.select("TransactionID", "DeviceInfo", "id_31"), "TransactionID", "left")
    ts_ms = (F.col("TransactionDT").cast("long") + epoch) * 1000
    email = blank_to_null(F.col("P_emaildomain"))
    return to_canonical(
        joined,
        "ieee_cis",
        {
            "tx_id": ulid(ts_ms, F.lit("ieee_cis"), F.col("TransactionID")),
            "user_id": hmac_sha256(F.concat(F.lit("card1="), text_or_blank(F.col("card1"))), key),
            "ts_ms": ts_ms,
            "amount_minor": to_cents(F.col("TransactionAmt")),
            "currency": F.lit("USD"),
            "channel": F.lit("ecommerce"),
            "device_fp": hmac_sha256(device_text(F.col("DeviceInfo"), F.col("id_31")), key),
            "email_domain_hash": F.when(email.isNotNull(), hmac_sha256(email, key)),
            "card_bin": F.col("card2").cast("long").cast("string"),
            "merchant_id": F.lit("vesta"),
            "mcc": text_or_blank(F.col("ProductCD")),
            "label": label_of("isFraud"),
            "attributes": attribute_bag({"addr1_zip_prefix": F.col("addr1").cast("long")}),
        },
    )


def canonicalize_ulb(df: DataFrame, key: str, anchor_ts: int, index: str = "row_index") -> DataFrame:
    """Anonymous card transactions: each row is its own pseudo-user, numbered by a stable row index from 0."""
    i = F.col(index)
    ts_ms = (F.col("Time").cast("long") + anchor_ts) * 1000
    kept = ["Time", "Amount", *[f"V{n}" for n in range(1, 29)]]
    return to_canonical(
        df,
        "ulb",
        {
            "tx_id": ulid(ts_ms, F.lit("ulb"), i),
            "user_id": hmac_sha256(F.concat(F.lit("ulb-row-"), i.cast("string")), key),
            "ts_ms": ts_ms,
            "amount_minor": to_cents(F.col("Amount")),
            "currency": F.lit("EUR"),
            "channel": F.lit("card_present"),
            "card_bin": ((i % 9 + 1) * 100000 + (i * 37) % 99999).cast("string"),
            "label": label_of("Class"),
            "attributes": attribute_bag({c: F.col(c) for c in kept}, _one_kind(df, kept)),
        },
    )


def canonicalize_sparkov(df: DataFrame, key: str, row_key: list[str] | None = None) -> DataFrame:
    """Simulated card transactions with places. ``row_key`` names the columns that identify a row (default: all)."""
    ts_ms = F.unix_millis(F.to_timestamp(F.concat(F.col("trans_date_trans_time"), F.lit("Z"))))
    kept = [c for c in df.columns if c != "is_fraud" and c not in DIRECT_IDENTIFIERS]
    return to_canonical(
        df,
        "sparkov",
        {
            "tx_id": ulid(ts_ms, F.lit("sparkov"), *[F.col(c) for c in row_key or df.columns]),
            "user_id": hmac_sha256(F.concat(F.lit("cc="), text_or_blank(F.col("cc_num"))), key),
            "ts_ms": ts_ms,
            "amount_minor": to_cents(F.col("amt")),
            "currency": F.lit("USD"),
            "channel": F.lit("card_present"),
            "device_fp": hmac_sha256(device_text(F.col("cc_num"), F.col("first")), key),
            "card_bin": F.substring(F.col("cc_num").cast("string"), 1, 6),
            "merchant_id": hmac_sha256(F.concat(F.lit("merch="), text_or_blank(F.col("merchant"))), key),
            "mcc": text_or_blank(F.col("category")),
            "country": F.lit("US"),
            "ip_country": F.lit("US"),
            "lat": number_or_null(F.col("lat")),
            "lon": number_or_null(F.col("long")),
            "label": label_of("is_fraud"),
            "attributes": attribute_bag({c: F.col(c) for c in kept}),
        },
    )


def canonicalize_paysim(df: DataFrame, key: str, row_key: list[str] | None = None) -> DataFrame:
    """Mobile-money transfers in hourly steps; the payee plays the merchant."""
    ts_ms = (F.col("step").cast("long") * 3600 + PAYSIM_EPOCH) * 1000
    # columns of their own, because each is used twice and should be hashed once
    hashed = df.withColumns(
        {
            "_payer": hmac_sha256(F.concat(F.lit("orig="), text_or_blank(F.col("nameOrig"))), key),
            "_payee": hmac_sha256(F.concat(F.lit("dest="), text_or_blank(F.col("nameDest"))), key),
        }
    )
    payer, payee = F.col("_payer"), F.col("_payee")
    before, after = number_or_null(F.col("oldbalanceOrg")), number_or_null(F.col("newbalanceOrig"))
    return to_canonical(
        hashed,
        "paysim",
        {
            "tx_id": ulid(ts_ms, F.lit("paysim"), *[F.col(c) for c in row_key or df.columns]),
            "user_id": payer,
            "ts_ms": ts_ms,
            "amount_minor": F.when(F.col("amount").isNotNull(), F.greatest(to_cents(F.col("amount")), F.lit(0))),
            "currency": F.lit("USD"),
            "channel": enum_map(F.col("type"), PAYSIM_CHANNELS, "other"),
            "merchant_id": payee,
            "mcc": F.col("type"),
            "label": label_of("isFraud"),
            "attributes": attribute_bag(
                {
                    "orig_hash": payer,
                    "dest_hash": payee,
                    "oldbalanceOrg": before,
                    "newbalanceOrig": after,
                    "oldbalanceDest": number_or_null(F.col("oldbalanceDest")),
                    "newbalanceDest": number_or_null(F.col("newbalanceDest")),
                    "balance_delta": after - before,
                    "isFlaggedFraud": label_of("isFlaggedFraud"),
                }
            ),
        },
    )
