"""CSV dialect and scans, tables, named data sets, and round trips through the sinks."""

import time
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import __spark_entry__ as entry_point
from cardsieve import scratch
from cardsieve.operators import features, profile, split
from cardsieve.plans import run_cached, run_to_table
from cardsieve.schema import ENGINEERED_SCHEMA, RAW_SCHEMA
from cardsieve.sinks import (
    drop_table,
    table_versions,
    write_csv,
    write_json,
    write_split_tables,
    write_table,
)
from cardsieve.sources import driver_tables
from cardsieve.sources.registry import TIERS
from cardsieve.sources import (
    CsvSource,
    TableSource,
    check_registry,
    csv_registry,
    ensure_schema,
    land_files,
    landed_rows,
    normalize_names,
    read_dataset,
    read_manifest,
    rejected_by_typing,
    rejected_cells,
    scan_inferred,
    scan_overrides,
    scan_positional,
    scan_table,
    scan_text,
    scan_typed,
    stored_rows,
    table_registry,
    use_schema,
)

VELOCITY = (
    "{'num_transactions': 3, 'total_amount': 7.5, 'unique_merchants': 2,"
    " 'unique_countries': 1, 'max_single_amount': 4.25}"
)


def line(**cells):
    values = {
        "transaction_id": "TX_1", "timestamp": "2024-09-30 00:00:01", "amount": "12.5",
        "country": "DE", "card_present": "True", "distance_from_home": "1",
        "high_risk_merchant": "false", "transaction_hour": "7", "weekend_transaction": "False",
        "velocity_last_hour": f'"{VELOCITY}"', "is_fraud": "true",
    } | cells
    return ",".join(values.get(name, "") for name in RAW_SCHEMA.names)


@pytest.fixture
def csv(tmp_path):
    lines = [
        ",".join(RAW_SCHEMA.names),
        line(),
        line(transaction_id="TX_2", merchant='"Smith, ""Bob"" & Co"', amount="bad", country=""),
        line(transaction_id="TX_3", is_fraud="garbage", velocity_last_hour="", distance_from_home="x"),
    ]
    path = tmp_path / "in.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def by_id(df):
    return {row.transaction_id: row for row in df.collect()}


@pytest.mark.parametrize("scan", [scan_typed, scan_overrides])
def test_typed_scans(spark, csv, scan):
    df = scan(spark, csv)
    rows = by_id(df)
    assert df.schema == RAW_SCHEMA
    assert rows["TX_1"].velocity_last_hour == VELOCITY
    assert (rows["TX_1"].amount, rows["TX_1"].card_present, rows["TX_1"].transaction_hour) == (12.5, True, 7)
    assert rows["TX_2"].merchant == 'Smith, "Bob" & Co'
    assert rows["TX_2"].amount is None and rows["TX_2"].country is None
    assert rows["TX_3"].is_fraud is None and rows["TX_3"].distance_from_home is None
    assert rows["TX_3"].velocity_last_hour is None


def test_text_and_positional_scans(spark, csv):
    for df in (scan_text(spark, csv), scan_positional(spark, csv)):
        assert df.columns == RAW_SCHEMA.names
        assert set(dict(df.dtypes).values()) == {"string"}
        assert by_id(df)["TX_2"].amount == "bad"
    assert scan_positional(spark, csv, ["a", "b"]).columns == ["a", "b"]


def test_inferred_scan(spark, csv):
    df = scan_inferred(spark, csv)
    types = dict(df.dtypes)
    assert types["timestamp"] == "timestamp" and types["transaction_hour"] == "int"
    assert types["card_present"] == "boolean" and types["amount"] == "string"
    assert by_id(df)["TX_1"].timestamp == datetime(2024, 9, 30, 0, 0, 1)


def test_header_in_another_order_is_refused(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text(",".join(reversed(RAW_SCHEMA.names)) + "\n" + line() + "\n")
    with pytest.raises(Exception, match="header"):
        scan_typed(spark, str(path)).collect()
    assert scan_positional(spark, str(path)).count() == 1


def test_csv_scan_reads_only_what_is_asked(spark, csv):
    plan = scan_typed(spark, csv).groupBy("country").agg(F.sum("amount"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<amount:double,country:string>" in text


@pytest.fixture
def schema(spark, tmp_path):
    name = ensure_schema(spark, f"s_{abs(hash(tmp_path))}", str(tmp_path / "schema"))
    yield name
    use_schema(spark, "default")


def test_tables(spark, csv, schema, tmp_path):
    raw = scan_typed(spark, csv)
    upper = raw.toDF(*[name.upper() for name in raw.columns])
    write_table(upper, f"{schema}.raw")
    assert scan_table(spark, f"{schema}.raw").columns == RAW_SCHEMA.names
    assert normalize_names(upper).columns == RAW_SCHEMA.names
    use_schema(spark, schema)
    assert scan_table(spark, "raw").count() == 3
    write_table(raw.limit(2), "raw")
    assert scan_table(spark, "raw").count() == 2
    write_table(spark.table("raw").where("transaction_id <> 'TX_1'"), "raw")
    assert scan_table(spark, f"{schema}.raw").count() == 1
    ensure_schema(spark, schema)


def names(spark, schema):
    return {row.tableName for row in spark.sql(f"SHOW TABLES IN {schema}").collect()}


def test_a_failed_write_leaves_the_old_rows(spark, schema, tmp_path):
    name = write_table(spark.range(5), f"{schema}.t")
    before = names(spark, schema)
    bad = spark.table(name).withColumn("id", F.expr("IF(id = 4, raise_error('lost'), id)"))
    with pytest.raises(Exception, match="lost"):
        write_table(bad, name)
    assert spark.table(name).count() == 5 and names(spark, schema) == before
    with pytest.raises(AnalysisException):
        write_table(spark.sql("SELECT 1 AS a, 2 AS A"), name)
    assert spark.table(name).count() == 5 and names(spark, schema) == before


def test_replacing_leaves_readers_their_rows(spark, schema):
    """A frame that was opened before the switch still reads what it was opened on; columns,
    types and partitions may change; only so many versions stay."""
    name = write_table(spark.range(5), f"{schema}.t")
    opened = spark.table(name)
    write_table(spark.sql("SELECT 'x' AS id, 1 AS `odd ``name`, 2 AS p"), name, partition_by=("p",))
    assert opened.count() == 5
    assert spark.table(name).columns == ["id", "odd `name", "p"]
    assert len(table_versions(spark, name)) == 2
    write_table(spark.table(name).limit(0), name)
    assert spark.table(name).count() == 0
    assert len(table_versions(spark, name)) == 2 and len(names(spark, schema)) == 3
    write_table(spark.range(2), name, keep_versions=0)
    assert len(names(spark, schema)) == 2
    drop_table(spark, name)
    assert names(spark, schema) == set()


def test_a_plain_table_becomes_a_version(spark, schema):
    spark.range(5).write.saveAsTable(f"{schema}.plain")
    write_table(spark.table(f"{schema}.plain").where("id < 2"), f"{schema}.plain")
    assert spark.table(f"{schema}.plain").count() == 2
    old = table_versions(spark, f"{schema}.plain")[1]
    assert spark.table(old).count() == 5
    spark.sql(f"CREATE VIEW {schema}.other AS SELECT 1 AS a")
    with pytest.raises(ValueError, match="other"):
        write_table(spark.range(1), f"{schema}.other")
    assert spark.table(f"{schema}.other").first().a == 1


def test_files_at_a_path_outlive_the_entry(spark, schema, tmp_path):
    name = write_table(spark.range(3), f"{schema}.t", str(tmp_path / "out"))
    drop_table(spark, name)
    assert spark.read.parquet(f"{tmp_path}/out/*").count() == 3


def test_split_tables_are_replaced_together(spark, schema):
    labelled = lambda n: spark.sql(f"SELECT {n} AS v, explode(array('train', 'test')) AS split")
    train, test = write_split_tables(labelled(1), f"{schema}.eng")
    # One step of the table is one step of both views.
    write_table(labelled(2), f"{schema}.eng", partition_by=("split",))
    assert spark.table(train).first().v == spark.table(test).first().v == 2


def test_registry_is_checked_against_its_sources(spark, csv, schema, tmp_path):
    raw = scan_typed(spark, csv)
    upper = write_table(raw.toDF(*[n.upper() for n in raw.columns]), f"{schema}.upper")
    good = dict.fromkeys(TIERS, CsvSource(csv)) | {"big": TableSource(upper)}
    assert check_registry(spark, good) == good
    other = tmp_path / "other.csv"
    other.write_text("a,b\n1,2\n")
    short = write_table(raw.drop("city").withColumn("amount", F.lit(1)), f"{schema}.short")
    for bad, message in (
        ({t: s for t, s in good.items() if t != "1mio"}, "1mio: not registered"),
        (good | {"huge": CsvSource(csv)}, "huge: unknown"),
        (good | {"500k": CsvSource(str(tmp_path / "none"))}, "500k: cannot be read, PATH_NOT_FOUND"),
        (good | {"medium": TableSource(f"{schema}.none")}, "medium: cannot be read"),
        (good | {"small": CsvSource(str(other))}, "small: a for transaction_id.*2 columns for 24"),
        (good | {"big": TableSource(short)}, "big: amount int for double, city missing for string"),
    ):
        with pytest.raises(ValueError, match=message):
            check_registry(spark, bad)


def test_registry(spark, csv, schema):
    write_table(scan_typed(spark, csv).limit(1), f"{schema}.big")
    folder, name = csv.rsplit("/", 1)
    registry = csv_registry(folder, {"small": name}) | table_registry(schema, {"big": "big"})
    assert registry == {"small": CsvSource(csv), "big": TableSource(f"{schema}.big")}
    assert read_dataset(spark, registry).count() == 3
    assert read_dataset(spark, registry, "BIG").count() == 1
    with pytest.raises(KeyError, match="huge"):
        read_dataset(spark, registry, "huge")


def ledger(df, *columns):
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=repr)


def test_rejected_cells(spark, csv, tmp_path):
    found = rejected_cells(spark, csv)
    assert ledger(found, "column_name", "cell") == [
        ("amount", "bad"), ("distance_from_home", "x"), ("is_fraud", "garbage")
    ]
    assert {row.file.rsplit("/", 1)[1] for row in found.collect()} == {"in.csv"}
    assert ledger(found.where("column_name = 'amount'"), "record")[0][0].startswith("TX_2,")
    typed = rejected_by_typing(scan_text(spark, csv), keys=("transaction_id",))
    assert ledger(typed, "transaction_id", "column_name", "cell") == [
        ("TX_2", "amount", "bad"), ("TX_3", "distance_from_home", "x"), ("TX_3", "is_fraud", "garbage")
    ]
    lenient = rejected_by_typing(scan_text(spark, csv), lenient=True)
    assert ledger(lenient, "column_name") == [("amount",), ("distance_from_home",)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan csv") == 1


def test_rejected_cells_of_odd_records(spark, tmp_path):
    """Cells with separators, quotes and line breaks; too few and too many cells; no loss."""
    schema = StructType().add("n", "integer").add("t", "string").add("d", "double")
    path = tmp_path / "odd.csv"
    path.write_bytes(b'n,t,d\n1,"a, ""b""\nc",x\n"7 ",,1.5\n2\n3,t,4.5,more\n,,\n"",t,\n99999999999,t,1\n')
    rows = scan_typed(spark, str(path), schema, multi_line=True)
    found = rejected_cells(spark, str(path), schema, multi_line=True)
    assert rows.count() == 7
    assert ledger(found, "column_name", "cell") == [
        ("d", "x"), ("n", "7 "), ("n", "99999999999"), (None, None), (None, None)
    ]
    clean = tmp_path / "clean.csv"
    clean.write_text("n,t,d\n1,a,2.5\n,,\n")
    assert rejected_cells(spark, str(clean), schema).count() == 0


def test_unmatched_rows_are_counted(spark, tmp_path):
    for name in ("nation", "customer", "part", "orders", "lineitem"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "lineitem":
            first = rows.limit(1)
            rows = rows.union(first.withColumn("l_partkey", F.lit(-1).cast("long")))
            rows = rows.union(first.withColumn("l_orderkey", F.lit(None).cast("long")))
        if name == "customer":
            rows = rows.where("c_custkey % 50 <> 1")
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    found = {r.partner: r.n_rows for r in driver_tables.unmatched(spark, str(tmp_path)).collect()}
    assert (found["part"], found["orders"], found["nation"]) == (1, 1, 0) and found["customer"] > 0
    kept = driver_tables.join_transactions(spark, str(tmp_path)).count()
    assert kept + sum(found.values()) == spark.read.parquet(f"{tmp_path}/lineitem.parquet").count()


def test_rows_counted_from_footers(spark, tmp_path):
    rows = spark.range(1000, numPartitions=4).withColumn("p", F.col("id") % 3)
    rows.write.partitionBy("p").parquet(str(tmp_path / "t"))
    counted = stored_rows(spark, str(tmp_path / "t"))
    assert counted.first().total_rows == 1000
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
    assert tuple(split.estimate_from(counted, 0.5).first()) == (1000, 500, 500)
    assert "PushedAggregation" not in str(
        spark.read.parquet(str(tmp_path / "t")).groupBy().count()._jdf.queryExecution().executedPlan().toString()
    )


def test_only_changed_files_land_again(spark, tmp_path):
    folder, target, asked = tmp_path / "in", str(tmp_path / "landed"), []
    folder.mkdir()

    def put(name, *values):
        (folder / name).write_text("n\n" + "".join(f"{v}\n" for v in values))

    def read(spark, files):
        asked.append(sorted(f.rsplit("/", 1)[1] for f in files))
        return scan_typed(spark, files, StructType().add("n", "integer"))

    def landed():
        return sorted(r.n for r in land_files(spark, f"{folder}/*.csv", target, read).collect())

    put("a b.csv", 1, 2)
    put("b.csv", 3)
    put("c.csv")
    assert landed() == landed() == [1, 2, 3]
    assert asked == [["a b.csv", "b.csv", "c.csv"]]
    put("b.csv", 30, 31)
    assert landed() == [1, 2, 30, 31] and asked[1:] == [["b.csv"]]
    (folder / "a b.csv").unlink()
    put("d.csv", 4)
    assert landed() == [4, 30, 31] and asked[2:] == [["d.csv"]]
    (folder / "d.csv").unlink()
    assert landed() == [30, 31] and len(asked) == 3
    versions = {r.file.rsplit("/", 1)[1]: r.batch for r in read_manifest(spark, target).collect()}
    assert versions == {"b.csv": 2, "c.csv": 1}
    put("e.csv", "x")

    def fail(spark, files):
        return read(spark, files).withColumn("n", F.expr("raise_error('broken')"))

    with pytest.raises(Exception, match="broken"):
        land_files(spark, f"{folder}/*.csv", target, fail)
    assert sorted(r.n for r in landed_rows(spark, target).collect()) == [30, 31]
    assert len(land_files(spark, f"{folder}/*.csv", target, read).collect()) == 3


def parts(path):
    return len(list(Path(path).glob("part-*")))


@pytest.mark.parametrize("files", [1, 4])
def test_csv_round_trip(spark, csv, tmp_path, files):
    out = features.engineer_features(scan_typed(spark, csv)).repartition(3)
    path = write_csv(out, str(tmp_path / "out"), files)
    write_csv(out, path, files)
    back = scan_typed(spark, path, ENGINEERED_SCHEMA)
    assert sorted(back.collect(), key=repr) == sorted(out.collect(), key=repr)
    assert parts(path) <= files


def test_csv_file_counts(spark, tmp_path):
    rows = spark.range(1000, numPartitions=8)
    assert parts(write_csv(rows, str(tmp_path / "one"), 1)) == 1
    assert parts(write_csv(rows, str(tmp_path / "four"), 4)) == 4
    assert parts(write_csv(rows, str(tmp_path / "free"))) == 8
    assert parts(write_csv(rows, str(tmp_path / "many"), 1, max_records_per_file=100)) == 10


def test_csv_gives_back_any_text(spark, tmp_path):
    texts = [None, "", " ", " pad ", "two\nlines", "cr\r\nlf", 'a "quote", and', "\\N", "null", "\t", "\\"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n INT, text STRING")
    path = write_csv(rows, str(tmp_path / "any"), max_records_per_file=3)
    back = scan_typed(spark, path, rows.schema, multi_line=True)
    assert {r.n: r.text for r in back.collect()} == dict(enumerate(texts))


def test_release_deletes_what_the_session_made(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scratch, "_handed_out", {})
    monkeypatch.setattr(scratch, "_made", {})
    monkeypatch.setattr(scratch, "scratch_root", lambda spark: str(tmp_path / "own"))
    path = scratch.made_once(spark, "a", "b", lambda path: spark.range(3).write.parquet(path))
    assert scratch.store(spark.range(2), "kept").count() == 2 and Path(path).exists()
    scratch.release_scratch(spark)
    assert list((tmp_path / "own").iterdir()) == []
    again = scratch.made_once(spark, "a", "b", lambda path: spark.range(3).write.parquet(path))
    assert again != path


def test_json_keeps_nulls(spark, tmp_path):
    path = write_json(spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b"), str(tmp_path / "j"))
    text = next(Path(path).glob("part-*")).read_text()
    assert text == '{"a":1,"b":null}\n'


def test_split_tables(spark, csv, schema):
    labelled = features.engineer_features(split.with_split(scan_typed(spark, csv)))
    train, test = write_split_tables(labelled, f"{schema}.engineered")
    assert spark.table(train).count() + spark.table(test).count() == 3
    assert spark.table(train).columns == ENGINEERED_SCHEMA.names
    plan = spark.table(train)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_split_tables_of_two_schemas(spark, schema, tmp_path):
    other = ensure_schema(spark, f"{schema}_other", str(tmp_path / "other"))
    for name, value in ((schema, 1), (other, 2)):
        rows = spark.sql(f"SELECT {value} AS v, explode(array('train', 'test')) AS split")
        assert write_split_tables(rows, f"{name}.eng") == (f"{name}.eng_train", f"{name}.eng_test")
    assert spark.table(f"{schema}.eng_train").first().v == 1
    assert spark.table(f"{other}.eng_train").first().v == 2


def test_whole_job(spark, csv, schema, tmp_path):
    raw = scan_typed(spark, csv)
    out = str(tmp_path / "features")
    cached = run_cached(raw, lambda df, rows: write_csv(df, out))
    stored = run_to_table(raw, f"{schema}.features")
    assert cached.total_rows == stored.total_rows == 3
    assert cached.split_rows == stored.split_rows
    written = spark.table(f"{schema}.features")
    assert stored.null_counts == {
        r.column_name: r.null_count for r in profile.null_counts(written).collect()
    }
    assert stored.null_counts["amount"] == 1 and not cached.null_counts
    assert cached.seconds.keys() == stored.seconds.keys()
    ours, theirs = (
        sorted(result.report.combined().collect(), key=repr) for result in (cached, stored)
    )
    assert ours == theirs
    assert scan_typed(spark, out, ENGINEERED_SCHEMA).count() == 3
    assert spark.table(f"{schema}.features").columns == ENGINEERED_SCHEMA.names + ["split"]
    for result in (cached, stored):
        result.report.release()
        assert result.report.by_category.count() == 1


def test_made_once_while_it_is_there(spark, tmp_path):
    calls = []

    def write(path):
        calls.append(path)
        spark.range(1).write.parquet(path)

    first = scratch.made_once(spark, "once", str(tmp_path), write)
    assert scratch.made_once(spark, "once", str(tmp_path), write) == first
    scratch._made[(spark.sparkContext.applicationId, "once", str(tmp_path))] = "/nowhere"
    assert scratch.made_once(spark, "once", str(tmp_path), write) not in (first, "/nowhere")
    assert len(calls) == 2


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {name for name in names if name.startswith("shuffle_")}


def test_stored_steps_leave_no_shuffle_files(spark, tmp_path):
    """Nor do files made once; the session's own setting stays as it was."""
    dealt, setting = spark.range(1000).repartition(3), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = shuffle_files(spark), spark.conf.get(setting, None)
    scratch.store(dealt, "dealt")
    scratch.made_once(spark, "dealt", str(tmp_path), dealt.write.parquet)
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and spark.conf.get(setting, None) == was


def test_changed_input_is_landed_again(spark, tmp_path):
    folder = str(tmp_path)
    spark.range(5).write.parquet(f"{folder}/t.parquet")
    build = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/t.parquet")
    first = driver_tables.landed_path(spark, folder, "t", build)
    assert driver_tables.landed_path(spark, folder, "t", build) == first
    spark.range(3).write.mode("overwrite").parquet(f"{folder}/t.parquet")
    assert spark.read.parquet(driver_tables.landed_path(spark, folder, "t", build)).count() == 3


def test_only_what_the_record_is_made_of_is_landed(spark, tmp_path):
    """Copies and nulls too; the texts are those of the join."""
    for name in ("nation", "customer", "part", "orders", "lineitem"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "lineitem":
            first = rows.limit(1)
            rows = rows.union(first).union(first.withColumn("l_suppkey", F.lit(None).cast("long")))
        if name in ("orders", "part"):
            rows = rows.union(rows.limit(2))
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    before = spark.conf.get(driver_tables._HASH_BELOW)
    found = driver_tables.transactions(spark, str(tmp_path))
    assert spark.conf.get(driver_tables._HASH_BELOW) == before
    joined = driver_tables.join_transactions(spark, str(tmp_path))
    assert found.count() > 0 and found.schema.names == RAW_SCHEMA.names
    assert found.exceptAll(joined).count() == joined.exceptAll(found).count() == 0
    assert all(field.nullable for field in found.schema)
    files = {row.path for row in found.select(F.col("_metadata.file_path").alias("path")).distinct().collect()}
    stored = spark.read.parquet(*files)
    assert stored.schema.names == list(driver_tables.RECORD_COLUMNS)
    assert all(file.endswith(".zstd.parquet") for file in files)


def test_the_widest_join_sorts_no_line_items(spark):
    broadcast = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(broadcast)
    spark.conf.set(broadcast, "-1")
    try:
        frame = driver_tables.join_records(spark, "/root/testdata/sf0.001")
        # What the frame runs when it is landed, under the same setting.
        with driver_tables.hashing_small_sides(spark):
            frame.collect()
    finally:
        spark.conf.set(broadcast, old)
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ShuffledHashJoin") == 4 and "SortMergeJoin" not in plan


def test_stored_rows_are_packed(spark, csv, schema, tmp_path):
    """Tables, stored frames and landed files."""
    write_table(spark.range(10), f"{schema}.packed", str(tmp_path / "table"))
    assert list((tmp_path / "table").rglob("*.zstd.parquet"))
    land_files(spark, csv, str(tmp_path / "landed"), scan_typed)
    assert list((tmp_path / "landed" / "rows").rglob("*.zstd.parquet"))
    assert all(f.endswith(".zstd.parquet") for f in scratch.store(spark.range(10), "packed").inputFiles())


def test_packed_csv_in_bounded_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, text) for i in range(4) for text in ("a,\"b", "", " c ", None)], "n INT, t STRING")
    path = write_csv(rows.coalesce(1), str(tmp_path / "any"), max_records_per_file=5, compression="gzip")
    assert len(list(Path(path).glob("part-*.csv.gz"))) == 4
    assert scan_typed(spark, path, rows.schema).exceptAll(rows).count() == 0
    assert scan_typed(spark, path, rows.schema).count() == 16


def test_csv_inputs_are_packed(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    for path in (entry_point._csv(spark, folder), entry_point._dirty_csv(spark, folder)):
        names = [file.name for file in Path(path.removeprefix("file:")).glob("part-*")]
        assert names and all(name.endswith(".csv.gz") for name in names)
    tiers = []
    monkeypatch.setattr(
        entry_point, "check_registry", lambda spark, registry: tiers.extend(registry.values())
    )
    assert entry_point.dataset_registry(spark, folder).count() == 5
    for source in tiers[:2]:
        assert list(Path(source.path.removeprefix("file:")).glob("part-*.csv.gz"))


def test_store_without_a_shared_folder(spark, monkeypatch):
    rows = spark.range(3)
    assert not scratch.store(rows, "kept").is_cached
    monkeypatch.setattr(scratch, "scratch_root", lambda spark: None)
    kept = scratch.store(rows, "kept")
    assert kept.is_cached and kept.count() == 3
    kept.unpersist()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_path(spark, "x")


def test_scratch_is_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch.scratch_root(spark) == root
    first, second = scratch.scratch_path(spark, "a"), scratch.scratch_path(spark, "a")
    assert first != second and first.startswith(f"{root}/a-")
