"""Reports: edge rows, and the one-pass form against the plain one."""

import pytest

from cardsieve.operators import features as feature_steps
from cardsieve.operators import profile, stats
from cardsieve.plans import risk_report
from cardsieve.schema import ENGINEERED_SCHEMA, RAW_SCHEMA

COLUMNS = "merchant_category STRING, country STRING, channel STRING, device STRING, amount DOUBLE," \
    " is_fraud INT, velocity_num_transactions INT, velocity_total_amount DOUBLE," \
    " velocity_unique_merchants INT, velocity_max_single_amount DOUBLE"

ROWS = [
    ("food", "DE", "web", "phone", 10.0, 1, 1, 10.0, 1, 5.0),
    ("food", "DE", "web", "phone", 20.0, 0, 3, 30.5, 2, 7.0),
    ("food", None, "pos", "card", None, None, None, None, None, None),
    ("travel", None, "pos", "card", 5.5, 0, None, 1.0, None, 2.0),
    ("unlabelled", "FR", "web", "card", 1.0, None, 5, 2.0, 3, 4.0),
    (None, "FR", "web", "phone", 2.0, 1, 7, 8.0, 9, 10.0),
]


@pytest.fixture(scope="module")
def features(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def test_rate_by_category(features):
    assert [tuple(row) for row in stats.rate_by_category(features).collect()] == [
        (None, 1, 1, 100.0, 2.0, 2.0),
        ("food", 3, 1, 50.0, 15.0, 30.0),
        ("travel", 1, 0, 0.0, 5.5, 5.5),
        ("unlabelled", 1, None, None, 1.0, 1.0),
    ]


def test_null_country_is_a_group(features):
    rows = {row.country: row for row in stats.rate_by_country(features).collect()}
    assert rows[None].total_txns == 2 and rows[None].fraud_rate_pct == 0.0


def test_velocity_by_label(features):
    rows = {row.is_fraud: tuple(row)[1:] for row in stats.velocity_by_label(features).collect()}
    assert rows == {
        1: (4.0, 9.0, 5.0, 7.5),
        0: (3.0, 15.75, 2.0, 4.5),
        None: (5.0, 2.0, 3.0, 4.0),
    }


def test_ties_are_broken_by_the_keys(spark):
    rows = [("c", f"{n:02}", "x", "y", 1.0, 1, 1, 1.0, 1, 1.0) for n in range(30)]
    df = spark.createDataFrame(rows, COLUMNS)
    for parts in (1, 5):
        found = [row.country for row in stats.rate_by_country(df.repartition(parts), limit=20).collect()]
        assert found == [f"{n:02}" for n in range(20)]
    assert stats.rate_by_country(df).count() == 30


def test_one_pass_report_equals_the_single_ones(features):
    report = risk_report(features)
    pairs = [
        (report.by_category, stats.rate_by_category(features)),
        (report.by_country, stats.rate_by_country(features)),
        (report.by_channel_device, stats.rate_by_channel_device(features)),
        (report.velocity, stats.velocity_by_label(features)),
    ]
    for one_pass, single in pairs:
        assert one_pass.dtypes == single.dtypes
        assert sorted(one_pass.collect(), key=repr) == sorted(single.collect(), key=repr)
    report.release()


def test_sql_text_equals_the_dataframe(spark, features):
    text = stats.label_rate_sql("channel", "device", average=True)
    by_sql = stats.run_sql(spark, text, features=features).collect()
    assert by_sql == stats.label_rate(features, "channel", "device", average=True).collect()
    features.createOrReplaceTempView("risk_features")
    named = spark.sql(text.replace("{features}", "risk_features")).collect()
    assert named == by_sql


def test_counts(features):
    rows = stats.count_present(features, "merchant_category", is_fraud="labelled").collect()
    assert {tuple(row) for row in rows} == {
        ("food", 3, 2), ("travel", 1, 1), ("unlabelled", 1, 0), (None, 1, 1)
    }
    assert stats.row_count(features).first().total_rows == 6


def test_project(features):
    wide = features.selectExpr("*", "1 AS other")
    assert stats.project_aggregate_inputs(wide).columns == list(stats.AGGREGATE_INPUTS)
    assert len(stats.AGGREGATE_INPUTS) == 10


def test_null_counts(features):
    counts = dict(profile.null_counts(features).collect())
    assert counts["is_fraud"] == 2 and counts["amount"] == 1 and counts["channel"] == 0
    assert list(counts) == features.columns


def test_schema_profile(spark):
    before = spark.createDataFrame([], RAW_SCHEMA)
    audit = profile.schema_profile(before, feature_steps.engineer_features)
    assert audit._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    rows = audit.collect()
    rows.sort()
    assert [row.column_name for row in rows[:24]] == RAW_SCHEMA.names
    fates = {row.column_name: row.status for row in rows}
    assert [n for n in ENGINEERED_SCHEMA.names if fates[n] == "added"] == [
        row.column_name for row in rows[24:]
    ]
    assert sum(fate == "dropped" for fate in fates.values()) == 9
    assert {row.status for row in profile.schema_profile(before).collect()} == {"kept"}


def test_velocity_quality(spark):
    rows = [(None,), ("not json",), ("{'num_transactions': 1}",), ("{}",)]
    df = spark.createDataFrame(rows, "velocity_last_hour STRING")
    assert tuple(profile.velocity_quality(df).first()) == (4, 1, 2)
