"""Splits: disjoint, exhaustive, repeatable, of the right size, and safe under skew."""

from hashlib import md5

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardsieve.operators import copies, split
from cardsieve.operators import packed as packing


def ids(df):
    return sorted(row.transaction_id or "" for row in df.select("transaction_id").collect())


@pytest.fixture(scope="module")
def numbered(spark):
    return spark.range(5000).select(
        F.concat(F.lit("T"), "id").alias("transaction_id"), F.col("id").alias("value")
    )


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows are copies of one row, a sixth share an id but not their content,
    and some have no id."""
    plain = spark.range(3000).selectExpr("concat('T', id) AS transaction_id", "id AS value")
    hot = spark.range(2000).selectExpr("'HOT' AS transaction_id", "0L AS value")
    shared = spark.range(1000).selectExpr("'SHARED' AS transaction_id", "id AS value")
    none = spark.range(50).selectExpr("CAST(NULL AS STRING) AS transaction_id", "id AS value")
    return plain.union(hot).union(shared).union(none).repartition(7)


def test_hash_split_is_disjoint_exhaustive_and_repeats(numbered):
    train, test = split.hash_split(numbered)
    assert sorted(ids(train) + ids(test)) == ids(numbered)
    assert not set(ids(train)) & set(ids(test))
    assert abs(len(ids(train)) - 3750) < 150
    assert ids(split.hash_split(numbered.repartition(13))[0]) == ids(train)
    assert ids(split.complement(numbered, train)) == ids(test)


def test_hash_split_keeps_rows_without_id(skewed):
    train, test = split.hash_split(skewed)
    assert train.count() + test.count() == skewed.count() == 6050
    assert split.complement(skewed, train).count() == test.count()


def test_hash_rule(numbered):
    rule = {
        row.transaction_id: int(md5(f"42:{row.transaction_id}".encode()).hexdigest()[:8], 16)
        for row in numbered.collect()
    }
    train = split.hash_split(numbered)[0]
    assert set(ids(train)) == {name for name, number in rule.items() if number % 100 < 75}


def labels(df):
    return dict(df.groupBy("split").count().collect())


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.5, 0.75, 0.9, 1.0])
def test_exact_split_size_under_skew(skewed, fraction):
    out = split.exact_split(skewed, fraction=fraction)
    train = labels(out).get("train", 0)
    assert train == int(6050 * fraction)
    assert sorted(out.drop("split").collect(), key=repr) == sorted(skewed.collect(), key=repr)


def test_exact_split_cuts_inside_copies(spark):
    """All rows alike: the cut can only be made by numbering them."""
    df = spark.range(1000).selectExpr("'X' AS transaction_id", "1 AS value")
    assert labels(split.exact_split(df)) == {"train": 750, "test": 250}


def test_exact_split_cuts_inside_one_id(spark):
    df = spark.range(1000).selectExpr("'X' AS transaction_id", "id AS value")
    out = split.exact_split(df)
    assert labels(out) == {"train": 750, "test": 250}
    assert labels(split.exact_split(df.repartition(5))) == labels(out)


@pytest.mark.parametrize("value", [
    "timestamp_micros(id)",
    "CAST(timestamp_micros(id) AS TIMESTAMP_NTZ)",
    "CAST(id AS DECIMAL(38, 18)) / 1000000000",
    "CAST(concat('x', id) AS BINARY)",
    "CASE WHEN id > 500 THEN id END",
    "named_struct('a', CASE WHEN id % 2 = 0 THEN id END, 'b', CASE WHEN id % 2 = 1 THEN id END)",
    "map('a', timestamp_micros(id))",
])
def test_exact_split_tells_any_content_apart(spark, value):
    df = spark.range(1000).selectExpr("'X' AS transaction_id", f"{value} AS value")
    assert labels(split.exact_split(df)) == {"train": 750, "test": 250}


def test_exact_split_follows_the_hash_order(numbered):
    out = {row.transaction_id: row.split for row in split.exact_split(numbered).collect()}
    order = sorted(out, key=lambda name: md5(f"42:{name}".encode()).hexdigest())
    assert all(out[name] == "train" for name in order[:3750])
    assert all(out[name] == "test" for name in order[3750:])


def test_exact_split_of_nothing(numbered):
    assert split.exact_split(numbered.where("false")).count() == 0
    assert labels(split.exact_split(numbered.limit(1))) == {"test": 1}


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(0, 2)),
                min_size=1, max_size=40), st.sampled_from([0.25, 0.5, 0.75]))
def test_exact_split_of_any_rows(spark, rows, fraction):
    df = spark.createDataFrame(rows, "transaction_id STRING, value INT")
    out = split.exact_split(df, fraction=fraction).collect()
    assert sum(row.split == "train" for row in out) == int(len(rows) * fraction)
    assert sorted([(r[0], r[1]) for r in out], key=repr) == sorted(rows, key=repr)


def test_split_parts(numbered):
    train, test = split.split_parts(split.exact_split(numbered))
    assert train.columns == numbered.columns
    assert (train.count(), test.count()) == (3750, 1250)


def test_random_split_of_stored_rows(spark, numbered, tmp_path):
    numbered.write.parquet(str(tmp_path / "t"))
    train, test = split.random_split(spark.read.parquet(str(tmp_path / "t")))
    assert sorted(ids(train) + ids(test)) == ids(numbered)
    assert not set(ids(train)) & set(ids(test))
    assert abs(train.count() - 3750) < 150


def test_random_filter(numbered):
    kept = split.random_filter(numbered)
    assert abs(kept.count() - 3750) < 150
    assert ids(kept) == ids(split.random_filter(numbered))


def test_row_index(numbered):
    index = [row["_idx"] for row in split.with_row_index(numbered).collect()]
    assert sorted(index) == list(range(5000))


def test_row_index_keeps_the_order(skewed):
    shuffled = split.seeded_shuffle(skewed)
    placed = sorted(split.with_row_index(shuffled).collect(), key=lambda row: row["_idx"])
    assert [row["_idx"] for row in placed] == list(range(6050))
    assert [tuple(row)[:2] for row in placed] == [tuple(row) for row in shuffled.collect()]


def test_shuffle_rank(skewed):
    names = [row.transaction_id for row in skewed.collect()]
    order = sorted(names, key=lambda n: (md5(f"42:{n or ''}".encode()).hexdigest(), n or ""))
    ranks = {row.transaction_id: row for row in split.shuffle_rank(skewed).collect()}
    assert ranks.keys() == set(names)
    for name, row in ranks.items():
        assert row.copies == names.count(name)
        assert row.first_rank == order.index(name) + 1


def test_seeded_shuffle(spark, skewed):
    out = split.seeded_shuffle(skewed)
    rows = [tuple(row) for row in out.collect()]
    assert sorted(rows, key=repr) == sorted(map(tuple, skewed.collect()), key=repr)
    keys = [md5(f"42:{row[0] or ''}".encode()).hexdigest() for row in rows]
    assert keys == sorted(keys)
    # The copies are cut apart by the sort: no task holds all of them.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        placed = split.seeded_shuffle(skewed).withColumn("task", F.spark_partition_id())
        tasks = [row.task for row in placed.collect() if row.transaction_id == "HOT"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(set(tasks)) > 2


def test_repeat_rows(spark, monkeypatch):
    """Rows are repeated in chunks that several tasks write."""
    monkeypatch.setattr(copies, "_CHUNK", 64)
    counted = spark.createDataFrame([("a", 1), ("b", 64), ("c", 1000), ("d", 65)], "name STRING, n INT")
    out = copies.repeat_rows(counted, "n")
    assert out.columns == ["name"]
    assert dict(out.groupBy("name").count().collect()) == {"a": 1, "b": 64, "c": 1000, "d": 65}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        hot = copies.repeat_rows(counted, "n").where("name = 'c'")
        assert hot.select(F.spark_partition_id().alias("t")).distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


ODD = """
    SELECT 'a' AS transaction_id, CAST(0.0 AS DOUBLE) AS x, map('k', 1) AS m UNION ALL
    SELECT 'a', -CAST(0.0 AS DOUBLE), map('k', 1) UNION ALL
    SELECT 'a', -CAST(0.0 AS DOUBLE), map('k', 1) UNION ALL
    SELECT 'a', CAST('NaN' AS DOUBLE), map('k', CAST(NULL AS INT)) UNION ALL
    SELECT 'b', CAST('-Infinity' AS DOUBLE), NULL UNION ALL
    SELECT NULL, NULL, map() UNION ALL SELECT NULL, NULL, map()
"""


def odd_rows(df):
    return sorted(repr(row) for row in df.collect())


def test_rows_come_back_as_they_were(spark):
    """-0.0, NaN, maps and nulls pass through the shuffle, the complement and the splits."""
    df = spark.sql(ODD)
    assert sum("x=-0.0" in row for row in odd_rows(df)) == 2
    assert odd_rows(split.seeded_shuffle(df)) == odd_rows(df)
    assert odd_rows(split.exact_split(df).drop("split")) == odd_rows(df)
    one, two = split.random_split(df)
    assert odd_rows(one.union(two)) == odd_rows(df)
    part = df.where("x = 0.0").limit(1)
    assert odd_rows(split.complement(df, part).union(part)) == odd_rows(df)


def test_shuffle_moves_the_rows_once(spark, skewed):
    """One exchange; the same order however the input is dealt."""
    out = split.seeded_shuffle(skewed)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == plan.count("Exchange") == 1
    again = split.seeded_shuffle(skewed.repartition(3))
    assert [tuple(r) for r in out.collect()] == [tuple(r) for r in again.collect()]


def test_complement_counts_copies(spark):
    """Ids do not matter, nor that a part holds one of two rows under an id."""
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), (None, None)], "transaction_id STRING, v INT")
    part = spark.createDataFrame([("a", 1), (None, None), ("z", 9)], "transaction_id STRING, v INT")
    assert sorted(map(tuple, split.complement(rows, part).collect())) == [("a", 1), ("a", 2), ("b", 1)]
    assert odd_rows(split.complement(rows, rows.limit(0))) == odd_rows(rows)
    assert split.complement(rows, rows).count() == 0
    assert odd_rows(split.without_ids(rows, part)) == odd_rows(rows.where("transaction_id = 'b'"))


@pytest.mark.parametrize("weights", [(0.75, 0.25), (1, 1, 2), (0, 1), (1,)])
def test_random_sides_and_their_complement(skewed, weights):
    """With repeated ids and copies, a side and its complement are every row."""
    sides = split.random_split(skewed, weights)
    assert odd_rows(sides[0].union(split.complement(skewed, sides[0]))) == odd_rows(skewed)
    for side, weight in zip(sides, weights):
        assert abs(side.count() - 6050 * weight / sum(weights)) < 250
    assert sum(side.count() for side in sides) == 6050


def test_random_sides_need_no_sort_and_stay(spark, numbered):
    placed = split.placed_rows(numbered)
    side = split.random_side((0.75, 0.25))
    first = ids(placed.where(side == 0))
    assert ids(placed.repartition(7).where(side == 0)) == first
    assert ids(placed.where(split.random_side((0.75, 0.25), seed=1) == 0)) != first
    plan = split.random_split(numbered)[0]._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan
    for wrong in ((), (0, 0), (1, -1)):
        with pytest.raises(ValueError):
            split.random_split(numbered, wrong)


def test_report_and_estimate(numbered):
    report = {row.split: row for row in split.split_report(split.with_split(numbered)).collect()}
    train = split.hash_split(numbered)[0].count()
    assert report["train"].n_rows == train and report["test"].n_rows == 5000 - train
    assert report["train"].share_pct == round(train / 50, 1)
    assert tuple(split.split_estimate(numbered).first()) == (5000, 3750, 1250)
    assert tuple(split.split_estimate(numbered.where("false")).first()) == (0, 0, 0)


def test_anti_join_splits_a_hot_id(spark, tmp_path):
    """Rows of a hot id outside of the part are spread over several tasks by AQE."""
    cold = spark.range(20000).selectExpr("concat('T', id) AS transaction_id", "uuid() AS value")
    hot = spark.range(20000).selectExpr("'HOT' AS transaction_id", "uuid() AS value")
    cold.union(hot).repartition(16).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": -1,
        "spark.sql.adaptive.autoBroadcastJoinThreshold": -1,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.coalescePartitions.enabled": False,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": 2,
    }
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        rest = split.without_ids(rows, rows.where("transaction_id LIKE '%7'"))
        assert len(rest.collect()) == 38000
        assert "SortMergeJoin(skew=true)" in rest._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in conf:
            spark.conf.unset(name)


def test_anti_join_moves_few_rows(spark, skewed, monkeypatch):
    """Where ids are many, rows are only joined where the bits of their id do not settle them."""
    moved, outside = [], split._outside
    monkeypatch.setattr(split, "_FEW_IDS", 0)
    monkeypatch.setattr(split, "_outside", lambda df, *more: moved.append(df) or outside(df, *more))
    part = skewed.where("transaction_id LIKE '%7' OR transaction_id = 'HOT'")
    rest = split.without_ids(skewed, part)
    assert odd_rows(rest) == odd_rows(skewed.where("transaction_id IS NULL OR NOT (transaction_id LIKE '%7' OR transaction_id = 'HOT')"))
    assert moved[0].count() < 500
    assert "LeftAnti" not in rest._jdf.queryExecution().optimizedPlan().toString()
    assert split.without_ids(skewed, skewed).count() == 0
    assert odd_rows(split.without_ids(skewed, part.limit(0))) == odd_rows(skewed)
    assert split.without_ids(skewed, skewed.where("transaction_id IS NULL")).count() == 6000


@pytest.mark.parametrize("bits", (8, 1 << 15))
def test_anti_join_by_odd_ids(spark, monkeypatch, bits):
    """Zeros of both signs are one id, and so are all NaN; other types are compared as before."""
    monkeypatch.setattr(split, "_FEW_IDS", 0)
    monkeypatch.setattr(copies, "_MAP_BITS", bits)
    monkeypatch.setattr(copies, "_MOST_BITS", bits)
    values = [0.0, -0.0, float("nan"), float("nan"), None, *map(float, range(1, 40))]
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(values)], "`a b` DOUBLE, place INT")
    part = spark.createDataFrame([(-0.0,), (float("nan"),), (7.0,), (99.0,)], "`a b` DOUBLE")
    kept = lambda part: sorted(row.place for row in split.without_ids(rows, part, "a b").collect())
    assert kept(part) == [i for i in range(4, len(values)) if values[i] != 7]
    assert kept(part.selectExpr("CAST(`a b` AS FLOAT) AS `a b`")) == kept(part)
    assert kept(part.union(part.selectExpr("CAST(NULL AS DOUBLE)"))) == kept(part)[1:]


def test_complement_moves_few_rows(skewed, monkeypatch):
    """Rows are only brought together where the bits of their hash do not settle them."""
    moved, repeat = [], split.repeat_rows
    monkeypatch.setattr(split, "repeat_rows", lambda df, n: moved.append(df) or repeat(df, n))
    part = skewed.where("transaction_id LIKE '%7' OR transaction_id = 'HOT'")
    rest = split.complement(skewed, part)
    assert odd_rows(rest.union(part)) == odd_rows(skewed)
    assert rest.count() > 3500 and moved[0].count() < 500


def test_complement_where_all_hashes_share_a_few_bits(skewed, monkeypatch):
    monkeypatch.setattr(copies, "_MAP_BITS", 8)
    monkeypatch.setattr(copies, "_MOST_BITS", 8)
    for part in (skewed.where("value % 3 = 0"), skewed.limit(0), skewed):
        assert odd_rows(split.complement(skewed, part).union(part)) == odd_rows(skewed)


def test_key_marks(spark):
    """A mark is never missed, and seldom set for a key that lacks it."""
    keys = spark.range(40000).withColumn("even", F.col("id") % 2 == 0)
    marks = {"even": F.col("even"), "third": F.when(F.col("id") % 3 == 0, True), "none": F.lit(False)}
    found = copies.key_marks(keys, "id", marks)(keys.select("id"))
    assert found.count() == 40000
    assert found.where("id % 2 = 0 AND NOT even OR id % 3 = 0 AND NOT third OR none").count() == 0
    assert found.where("id % 2 = 1 AND even").count() < 3000


def test_seeded_shuffle_of_some_columns(skewed, monkeypatch):
    """The order of the whole rows, for which only the columns asked for are moved."""
    wide, stored = skewed.withColumn("more", F.lit("x")), []
    keep = split.store
    monkeypatch.setattr(split, "store", lambda df, name: stored.append(df.columns) or keep(df, name))
    out = split.seeded_shuffle(wide, columns=["value"])
    assert out.columns == ["value"]
    assert not {"more"} & set(stored[0])
    assert out.collect() == split.seeded_shuffle(wide).select("value").collect()


def test_seeded_shuffle_without_storing(spark, skewed, tmp_path, monkeypatch):
    """Files are read twice instead; copies of different tasks are still cut apart."""
    skewed.write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(split, "store", None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4KB")
    spark.conf.set("spark.sql.files.openCostInBytes", "4KB")
    try:
        rows = spark.read.parquet(str(tmp_path / "t"))
        out = split.seeded_shuffle(rows, stored=False)
        placed = out.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for name in ("adaptive.coalescePartitions.enabled", "files.maxPartitionBytes", "files.openCostInBytes"):
            spark.conf.unset(f"spark.sql.{name}")
    assert len({row.task for row in placed if row.transaction_id == "HOT"}) > 2
    monkeypatch.undo()
    assert [tuple(row)[:2] for row in placed] == [tuple(r) for r in split.seeded_shuffle(skewed).collect()]


def shuffled_bytes(plan):
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled_bytes(plan.executedPlan())
    if kind == "ResultQueryStageExec":
        return shuffled_bytes(plan.plan())
    if kind == "ShuffleQueryStageExec":
        return plan.shuffle().metrics().apply("shuffleBytesWritten").value()
    return sum(shuffled_bytes(plan.children().apply(i)) for i in range(plan.children().size()))


def test_seeded_shuffle_moves_columns_packed(spark, tmp_path):
    """A hash printed in hex moves in little more than its 16 bytes, numbers in their digits."""
    spark.range(20000).selectExpr(
        "concat('T', id) AS transaction_id", "md5(string(id)) AS `a.b`", "md5(concat(id, 'x')) AS c",
        "'{''total'': 1, ''unique'': ' || id % 7 || '}' AS d", "IF(id % 3 = 0, NULL, id * 0.5D) AS e",
    ).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    out = split.seeded_shuffle(rows, stored=False)
    assert out.schema == rows.schema
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert 32 * 20000 < shuffled_bytes(out._jdf.queryExecution().executedPlan()) < 55 * 20000
    assert split.seeded_shuffle(rows.limit(0)).collect() == []


def test_texts_are_packed_without_loss(spark, monkeypatch):
    texts = ["", None, '"', "\\", "\r\n", "\x00\x1f", "null", " a ", "\U0001f600 ", "[]", "y" * 50]
    rows = [(str(i), a, b, -0.0) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)]
    df = spark.createDataFrame(rows, "transaction_id STRING, `a.b` STRING, c STRING, x DOUBLE")
    broken = df.limit(3).withColumn("c", F.unhex(F.lit("61FF62")).cast("string"))
    df = df.union(broken)
    exact = lambda found: sorted(
        tuple(row) for row in found.select(*[F.hex(F.col(f"`{c}`").cast("string")) for c in df.columns]).na.fill("none").collect()
    )
    packed = df.select(*packing.pack_texts(df.schema, ("transaction_id",)))
    assert packed.columns == ["transaction_id", "x", "_texts", "_loose"]
    assert packed.where("_loose IS NOT NULL").count() == 3
    assert exact(split.seeded_shuffle(df)) == exact(df)
    monkeypatch.setattr(packing, "_LONG", 50)
    assert df.select(*packing.pack_texts(df.schema)).where("_loose IS NOT NULL").count() == 24
    assert exact(split.seeded_shuffle(df)) == exact(df)
