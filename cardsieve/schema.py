"""Column names and types of a card transaction, before and after feature work."""

from pyspark.sql.types import StructType


def _schema(types: dict[str, str]) -> StructType:
    schema = StructType()
    for name, kind in types.items():
        schema.add(name, kind)
    return schema


# Names, order and types of the raw transaction record.
RAW_SCHEMA = _schema(
    {
        "transaction_id": "string",
        "customer_id": "string",
        "card_number": "string",
        "timestamp": "string",
        "merchant_category": "string",
        "merchant_type": "string",
        "merchant": "string",
        "amount": "double",
        "currency": "string",
        "country": "string",
        "city": "string",
        "city_size": "string",
        "card_type": "string",
        "card_present": "boolean",
        "device": "string",
        "channel": "string",
        "device_fingerprint": "string",
        "ip_address": "string",
        "distance_from_home": "integer",
        "high_risk_merchant": "boolean",
        "transaction_hour": "integer",
        "weekend_transaction": "boolean",
        "velocity_last_hour": "string",
        "is_fraud": "boolean",
    }
)

# Columns that identify a person, card or device.
IDENTIFIER_COLUMNS = (
    "transaction_id",
    "customer_id",
    "card_number",
    "merchant",
    "device_fingerprint",
    "ip_address",
    "timestamp",
    "city",
)

# yes/no columns that become 0/1 integers, the label last.
FLAG_COLUMNS = ("card_present", "high_risk_merchant", "weekend_transaction", "is_fraud")

# Keys of the velocity text and the types they unpack to.
VELOCITY_TYPES = {
    "num_transactions": "int",
    "total_amount": "double",
    "unique_merchants": "int",
    "unique_countries": "int",
    "max_single_amount": "double",
}

ID_COLUMN = "transaction_id"
LABEL_COLUMN = "is_fraud"
VELOCITY_COLUMN = "velocity_last_hour"

ENGINEERED_SCHEMA = _schema(
    {
        "merchant_category": "string",
        "merchant_type": "string",
        "amount": "double",
        "currency": "string",
        "country": "string",
        "city_size": "string",
        "card_type": "string",
        "card_present": "integer",
        "device": "string",
        "channel": "string",
        "distance_from_home": "integer",
        "high_risk_merchant": "integer",
        "transaction_hour": "integer",
        "weekend_transaction": "integer",
        "is_fraud": "integer",
        "velocity_num_transactions": "integer",
        "velocity_total_amount": "double",
        "velocity_unique_merchants": "integer",
        "velocity_unique_countries": "integer",
        "velocity_max_single_amount": "double",
    }
)


def as_text(schema: StructType) -> StructType:
    """The same columns, all of them strings: for scans that type the cells later."""
    return _schema(dict.fromkeys(schema.names, "string"))
