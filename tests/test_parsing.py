"""Cells, flags and velocity text, row by row."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardsieve.functions import (
    parse_bool_lenient,
    parse_bool_strict,
    parse_float,
    parse_int,
    velocity_columns,
    velocity_struct,
)
from cardsieve.operators.features import cast_flags, engineer_features, extract_velocity
from cardsieve.operators.ingest import typed_ingest
from cardsieve.schema import ENGINEERED_SCHEMA, RAW_SCHEMA, VELOCITY_TYPES, as_text


def apply(spark, function, texts):
    rows = [(place, text) for place, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "place INT, text STRING")
    out = df.select("place", function(F.col("text")).alias("out")).collect()
    return [row.out for row in sorted(out, key=lambda row: row.place)]


def test_bool_strict(spark):
    texts = ["true", "True", "false", "False", "garbage", "TRUE", "", None, "1", "yes"]
    assert apply(spark, parse_bool_strict, texts) == [True, True, False, False] + [None] * 6


def test_bool_lenient(spark):
    texts = ["true", "True", "false", "False", "garbage", "TRUE", "", None, " true ", "\ttrue\n"]
    expected = [True, True, False, False, False, True, None, None, True, True]
    assert apply(spark, parse_bool_lenient, texts) == expected


def test_int(spark):
    texts = ["5", " -7 ", "+3", "1_000", "5.0", "x", "", None, "99999999999", "1__0", "_1", "0x1"]
    expected = [5, -7, 3, 1000] + [None] * 8
    assert apply(spark, parse_int, texts) == expected


def test_float(spark):
    texts = ["1.5", "1e5", ".5", "5.", "-2", "1_0.5", "x", "", None, "1.5d", "2f", "1e", "inf"]
    expected = [1.5, 1e5, 0.5, 5.0, -2.0, 10.5] + [None] * 6 + [float("inf")]
    assert apply(spark, parse_float, texts) == expected


@settings(max_examples=15, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-(2**31), 2**31 - 1).map(str),
                          st.floats(allow_nan=False).map(repr),
                          st.text("0123456789+-._eE x", max_size=8)), min_size=1, max_size=60))
def test_numbers_parse_as_in_python(spark, texts):
    def python(convert, text):
        try:
            return convert(text)
        except ValueError:
            return None

    whole = [python(int, text) for text in texts]
    whole = [n if n is not None and -(2**31) <= n < 2**31 else None for n in whole]
    assert apply(spark, parse_int, texts) == whole
    assert apply(spark, parse_float, texts) == [python(float, text) for text in texts]


VELOCITY_CASES = [
    (None, [None] * 5),
    ("{'num_transactions': 3}", [3, None, None, None, None]),
    ("{'num_transactions': 3, 'x': None}", [None] * 5),
    ("{'x': None, 'num_transactions': 3}", [None] * 5),
    ("not json", [None] * 5),
    ("", [None] * 5),
    ("{'a': 'O'Neil', 'num_transactions': 2}", [None] * 5),
    ("{'a': \"O'Neil\", 'num_transactions': 2}", [None] * 5),
    ("{'num_transactions': 3", [None] * 5),
    ("{'num_transactions': 3.0, 'unique_merchants': 3.7}", [3, None, 3, None, None]),
    ("{'num_transactions': 12345678901, 'total_amount': 1e5}", [None, 1e5, None, None, None]),
    ("{'num_transactions': 1, 'total_amount': 2.5, 'unique_merchants': 3,"
     " 'unique_countries': 4, 'max_single_amount': 5.25}", [1, 2.5, 3, 4, 5.25]),
    ("{'total_amount': NaN, 'num_transactions': 1}", [None] * 5),
    ("{'num_transactions': '4', 'total_amount': '12.5'}", [4, 12.5, None, None, None]),
    ("{'num_transactions': 'x', 'total_amount': 5}", [None, 5.0, None, None, None]),
    ("{'num_transactions': true, 'total_amount': {'a': 1}, 'unique_merchants': [1],"
     " 'unique_countries': null, 'max_single_amount': -1}", [None, None, None, None, -1.0]),
    ("[{'num_transactions': 3}]", [None] * 5),
    ("{'num_transactions': 3} trailing", [3, None, None, None, None]),
    ("{}", [None] * 5),
]


@pytest.mark.parametrize("text, expected", VELOCITY_CASES)
def test_velocity(spark, text, expected):
    df = spark.createDataFrame([(text,)], "velocity_last_hour STRING")
    assert list(extract_velocity(df).first()) == expected


def test_velocity_unreplaced_form_reads_apostrophes(spark):
    text = "{'a': \"O'Neil\", 'num_transactions': 2}"
    df = spark.createDataFrame([(text,)], "velocity_last_hour STRING")
    assert extract_velocity(df, requote=False).first().velocity_num_transactions == 2


def test_velocity_agrees_with_single_lookups(spark):
    """One parse for all keys gives what a path lookup per key gives."""
    df = spark.createDataFrame([(text,) for text, _ in VELOCITY_CASES], "text STRING")
    quoted = F.replace("text", F.lit("'"), F.lit('"'))
    struct = velocity_struct(F.col("text"))
    for key, column in zip(VELOCITY_TYPES, velocity_columns(F.col("s"), "text").values()):
        number = F.get_json_object(quoted, f"$.{key}").try_cast("double")
        both = df.withColumn("s", struct).select(
            column.alias("ours"), number.try_cast(VELOCITY_TYPES[key]).alias("lookup")
        )
        assert both.where(~F.col("ours").eqNullSafe(F.col("lookup"))).count() == 0


@settings(max_examples=10, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.fixed_dictionaries(
    {}, optional={"num_transactions": st.integers(0, 10**6), "unique_merchants": st.integers(0, 99),
                  "unique_countries": st.integers(0, 99),
                  "total_amount": st.floats(0, 1e9), "max_single_amount": st.floats(0, 1e9)}),
    min_size=1, max_size=30))
def test_velocity_of_any_dict(spark, dicts):
    rows = [(place, json.dumps(d).replace('"', "'")) for place, d in enumerate(dicts)]
    df = spark.createDataFrame(rows, "place INT, velocity_last_hour STRING")
    out = sorted(extract_velocity(df).collect())
    assert [list(row)[1:] for row in out] == [[d.get(key) for key in VELOCITY_TYPES] for d in dicts]


def test_missing_columns_are_no_error(spark):
    df = spark.createDataFrame([("A", True, None)], "country STRING, is_fraud BOOLEAN,"
                               " velocity_last_hour STRING")
    out = engineer_features(df)
    assert out.columns == ["country", "is_fraud"] + [f"velocity_{key}" for key in VELOCITY_TYPES]
    assert out.first().is_fraud == 1


def test_engineered_schema(spark):
    out = engineer_features(spark.createDataFrame([], RAW_SCHEMA))
    assert [(f.name, f.dataType) for f in out.schema] == [
        (f.name, f.dataType) for f in ENGINEERED_SCHEMA
    ]


def test_flags_from_text_go_through_boolean(spark):
    df = spark.createDataFrame([("true",), ("False",), ("1",), (None,)], "is_fraud STRING")
    assert [row.is_fraud for row in cast_flags(df).collect()] == [1, 0, None, None]


@pytest.mark.parametrize("on_garbage, expected", [("false", False), ("null", None)])
def test_typed_ingest(spark, on_garbage, expected):
    cells = dict.fromkeys(RAW_SCHEMA.names, "")
    cells |= {"amount": "12.50", "transaction_hour": "7", "distance_from_home": "5.0",
              "is_fraud": "garbage", "card_present": "true", "country": "X"}
    df = spark.createDataFrame([tuple(cells.values())], as_text(RAW_SCHEMA))
    row = typed_ingest(df, on_garbage=on_garbage).first()
    assert (row.amount, row.transaction_hour, row.distance_from_home) == (12.5, 7, None)
    assert (row.is_fraud, row.card_present, row.weekend_transaction) == (expected, True, None)
    assert typed_ingest(df).schema == RAW_SCHEMA
