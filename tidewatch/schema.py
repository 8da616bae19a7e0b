"""Schemas and fixed values of the canonical transaction table and its raw inputs."""

from __future__ import annotations

from pyspark.sql import types as T

# They must equal the published data contract.
SCHEMA_VERSION = 1
DATASET_SOURCES = ["ieee_cis", "ulb", "sparkov", "paysim", "synthetic"]
CHANNELS = ["card_present", "ecommerce", "mobile", "transfer", "atm", "other"]
LABELS = [0, 1, -1]
HEX64 = "^[a-f0-9]{64}$"
HEX64_ANY_CASE = "^[a-fA-F0-9]{64}$"
ULID = "^[0-9A-HJKMNP-TV-Z]{26}$"

_S, _L, _D, _I = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


CANONICAL = _struct(
    ("tx_id", _S, False),
    ("user_id", _S, False),
    ("dataset_source", _S, False),
    ("schema_version", _I, False),
    ("ts_ms", _L, False),
    ("amount_minor", _L, False),
    ("currency", _S, False),
    ("channel", _S, False),
    ("device_fp", _S, True),
    ("ip_hash", _S, True),
    ("email_domain_hash", _S, True),
    ("card_bin", _S, True),
    ("merchant_id", _S, True),
    ("mcc", _S, True),
    ("country", _S, True),
    ("ip_country", _S, True),
    ("lat", _D, True),
    ("lon", _D, True),
    ("label", T.ByteType(), True),
    ("attributes", T.MapType(_S, _S), True),
)

#: What a transaction looks like on the wire (JSON value of the topic).
STREAM_EVENT = T.StructType().add("tx_id", _S).add("user_id", _S).add("amount_minor", _L).add("mcc", _S).add("ts_ms", _L)

#: The twelve model inputs, in the order the model expects. The label-derived rate is left out on purpose.
MODEL_FEATURES = [
    "tx_count_30d",
    "amt_mean_30d",
    "amt_std_30d",
    "amt_max_30d",
    "amt_min_30d",
    "distinct_mcc_30d",
    "distinct_merchant_30d",
    "distinct_country_30d",
    "pct_ecommerce",
    "pct_card_present",
    "pct_mobile",
    "avg_seconds_between_tx",
]

_RAW_IEEE_CIS = _struct(
    ("TransactionID", _L, True),
    ("TransactionDT", _L, True),
    ("TransactionAmt", _D, True),
    ("ProductCD", _S, True),
    ("card1", _L, True),
    ("card2", _D, True),
    ("addr1", _D, True),
    ("P_emaildomain", _S, True),
    ("isFraud", _I, True),
)
_RAW_IDENTITY = _struct(("TransactionID", _L, True), ("DeviceInfo", _S, True), ("id_31", _S, True))
_RAW_ULB = _struct(
    ("Time", _D, True),
    *[(f"V{i}", _D, True) for i in range(1, 29)],
    ("Amount", _D, True),
    ("Class", _I, True),
)
_RAW_SPARKOV = _struct(
    ("trans_date_trans_time", _S, True),
    ("cc_num", _S, True),
    ("merchant", _S, True),
    ("category", _S, True),
    ("amt", _D, True),
    ("first", _S, True),
    ("lat", _S, True),
    ("long", _S, True),
    ("is_fraud", _I, True),
)
_RAW_PAYSIM = _struct(
    ("step", _L, True),
    ("type", _S, True),
    ("amount", _D, True),
    ("nameOrig", _S, True),
    ("oldbalanceOrg", _S, True),
    ("newbalanceOrig", _S, True),
    ("nameDest", _S, True),
    ("oldbalanceDest", _S, True),
    ("newbalanceDest", _S, True),
    ("isFraud", _I, True),
    ("isFlaggedFraud", _I, True),
)

#: Columns that the mappings read. Files may carry more: the reader matches them by header name.
RAW = {
    "ieee_cis": _RAW_IEEE_CIS,
    "ieee_cis_identity": _RAW_IDENTITY,
    "ulb": _RAW_ULB,
    "sparkov": _RAW_SPARKOV,
    "paysim": _RAW_PAYSIM,
}
