"""The transaction record, run logs and raw text cells, derived from star-schema tables."""

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardsieve.scratch import made_once, scratch_root

# Expressions that Spark and other SQL engines read alike; decimals are put together from
# integers, so that they print the same everywhere.
_VELOCITY = (
    "concat('{''num_transactions'': ', l_orderkey % 40,"
    " ', ''total_amount'': ', l_partkey*13 % 90000, '.',"
    " lpad(CAST(l_suppkey*7 % 100 AS STRING), 2, '0'),"
    " ', ''unique_merchants'': ', l_partkey % 25,"
    " ', ''unique_countries'': ', l_suppkey % 9,"
    " ', ''max_single_amount'': ', l_partkey*11 % 40000, '.',"
    " lpad(CAST(l_orderkey*3 % 100 AS STRING), 2, '0'), '}')"
)

TRANSACTION_COLUMNS = {
    "transaction_id": "concat('TX_', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey)",
    "customer_id": "concat('CUST_', o_custkey)",
    "card_number": "CAST(4000000000000000 + o_custkey*7919 AS STRING)",
    "timestamp": (
        "concat(CAST(CAST(l_shipdate AS DATE) AS STRING), ' ',"
        " lpad(CAST(l_orderkey % 24 AS STRING), 2, '0'), ':00:00')"
    ),
    "merchant_category": "p_type",
    "merchant_type": "p_brand",
    "merchant": "p_name",
    "amount": "l_extendedprice",
    "currency": (
        "CASE n_regionkey WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP'"
        " WHEN 3 THEN 'JPY' ELSE 'BRL' END"
    ),
    "country": "n_name",
    "city": "concat('City_', o_custkey % 50)",
    "city_size": "CASE WHEN o_custkey % 2 = 0 THEN 'large' ELSE 'medium' END",
    "card_type": (
        "CASE l_returnflag WHEN 'A' THEN 'Basic Debit' WHEN 'N' THEN 'Gold Credit'"
        " ELSE 'Premium Debit' END"
    ),
    "card_present": "l_linestatus = 'F'",
    "device": (
        "CASE l_suppkey % 4 WHEN 0 THEN 'iOS App' WHEN 1 THEN 'Android App'"
        " WHEN 2 THEN 'Chrome' ELSE 'Chip Reader' END"
    ),
    "channel": "CASE l_partkey % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'mobile' ELSE 'pos' END",
    "device_fingerprint": "md5(concat('dev', o_custkey, '_', l_suppkey))",
    "ip_address": "concat(10, '.', o_custkey % 256, '.', l_partkey % 256, '.', l_suppkey % 256)",
    "distance_from_home": "CAST(l_quantity AS INT) * 10",
    "high_risk_merchant": "p_size > 40",
    "transaction_hour": "CAST(l_orderkey % 24 AS INT)",
    "weekend_transaction": "l_orderkey % 7 >= 5",
    "velocity_last_hour": f"CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE {_VELOCITY} END",
    "is_fraud": (
        "(l_orderkey*31 + l_partkey*17 + l_suppkey*7 + l_linenumber) % 100 <"
        " CASE l_returnflag WHEN 'A' THEN 30 WHEN 'N' THEN 15 ELSE 22 END"
    ),
}

# The table columns that those expressions read.
RECORD_COLUMNS = (
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
    "o_custkey",
    "p_name",
    "p_type",
    "p_brand",
    "p_size",
    "n_name",
    "n_regionkey",
)

# What a careless export makes of some cells: when, and the text that stands there then.
# Texts of the first three columns do not fit their types.
DIRTY_CELLS = {
    "amount": ("transaction_hour % 7 = 3", "concat('EUR ', distance_from_home)"),
    "distance_from_home": ("transaction_hour % 7 = 4", "concat(distance_from_home, '.5')"),
    "is_fraud": ("transaction_hour % 5 = 1", "'maybe'"),
    "velocity_last_hour": ("transaction_hour % 6 = 2", "'{broken'"),
    "merchant_category": ("transaction_hour % 11 = 5", "CAST(NULL AS STRING)"),
    "country": ("transaction_hour % 12 = 6", "CAST(NULL AS STRING)"),
}
UNREADABLE = ("amount", "distance_from_home", "is_fraud")

# Each size tier holds the transactions before an hour of the day.
TIER_HOURS = {"small": 4, "500k": 8, "1mio": 12, "medium": 16, "big": 24}

# Run logs: one run per order, seven runs to a comparison, one line per line item.
RUN_LABELS = tuple(f"engine_{letter}" for letter in "abcdefg")

RUN_COLUMNS = {
    "run": "concat('run_', o_orderkey)",
    "comparison": "CAST(floor(o_orderkey / 7) AS BIGINT)",
    "label": "concat('engine_', substr('abcdefg', CAST(o_orderkey % 7 AS INT) + 1, 1))",
    "success": "o_orderkey % 10 <> 3",
    "wall_time": "CAST(o_custkey % 500 AS DOUBLE) + 0.25",
}

_STEP_SECONDS = "concat(l_partkey % 400, '.', lpad(CAST(l_suppkey*7 % 100 AS STRING), 2, '0'))"
_STEP_SHARE = "concat('(', lpad(CAST(l_suppkey % 100 AS STRING), 3, ' '), '.5%)  ')"
_RUN_SECONDS = "concat(o_custkey % 500, '.', lpad(CAST(o_orderkey % 100 AS STRING), 2, '0'))"
_RUN_ROWS = (
    "CASE WHEN o_custkey < 1000 THEN CAST(o_custkey AS STRING) ELSE"
    " concat(CAST(floor(o_custkey / 1000) AS INT), ',',"
    " lpad(CAST(o_custkey % 1000 AS STRING), 3, '0')) END"
)


def _step_line(name: str) -> str:
    return (
        f"concat('  {name:<16}: ', lpad({_STEP_SECONDS}, 8, ' '), 's  ', {_STEP_SHARE})"
    )


STEP_LINE_COLUMNS = {
    "run": "concat('run_', l_orderkey)",
    "line_no": "100 + l_linenumber + 10 * (l_suppkey + 1000000 * l_partkey)",
    "value": (
        "CASE l_linenumber"
        f" WHEN 1 THEN {_step_line('session_init')}"
        f" WHEN 2 THEN {_step_line('data_load')}"
        f" WHEN 3 THEN {_step_line('feature_eng')}"
        f" WHEN 4 THEN {_step_line('split')}"
        f" WHEN 5 THEN {_step_line('aggregations')}"
        f" WHEN 6 THEN {_step_line('write_back')}"
        f" ELSE concat('       Done in ', {_STEP_SECONDS}, 's') END"
    ),
}

# One message and three summary lines per order: (line number, text).
SUMMARY_LINES = (
    ("1", (
        "CASE o_orderkey % 3 WHEN 0 THEN '24/01/01 WARN Utils: low disk'"
        " WHEN 1 THEN '24/01/01 INFO Executor: started'"
        " ELSE concat('error: task ', o_custkey, ' lost') END"
    )),
    ("2", (
        "CASE WHEN o_orderkey % 11 = 0 THEN '  Total duration : unknown'"
        f" ELSE concat('  Total duration : ', {_RUN_SECONDS}, 's') END"
    )),
    ("3", f"concat('  Total rows     : ', {_RUN_ROWS})"),
    ("4", f"concat('  TOTAL           : ', lpad({_RUN_SECONDS}, 8, ' '), 's  (100.0%)')"),
)

# Cells as a careless export would hold them, one of each kind per line item.
CELL_COLUMNS = {
    "cell": (
        "concat('C_', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey)"
    ),
    "flag_text": (
        "CASE l_partkey % 9 WHEN 0 THEN 'true' WHEN 1 THEN 'True' WHEN 2 THEN 'false'"
        " WHEN 3 THEN 'False' WHEN 4 THEN 'garbage' WHEN 5 THEN 'TRUE' WHEN 6 THEN ''"
        " WHEN 7 THEN ' true ' ELSE NULL END"
    ),
    "number_text": (
        "CASE l_suppkey % 8 WHEN 0 THEN CAST(l_partkey AS STRING)"
        " WHEN 1 THEN concat(l_partkey, '.', l_linenumber) WHEN 2 THEN concat('x', l_orderkey)"
        " WHEN 3 THEN '' WHEN 4 THEN concat(' -', l_orderkey, ' ') WHEN 5 THEN '1e5'"
        " WHEN 6 THEN concat(l_partkey % 9 + 1, '0000000000') ELSE NULL END"
    ),
}


# Largest partition of a join's side that AQE hashes; a Spark setting, 0 unless set.
_HASH_BELOW = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content_key(spark: SparkSession, sf_dir: str) -> str:
    """Changes whenever a file of the input folder does: names, sizes and times in one row."""
    files = spark.read.format("binaryFile").load(f"{sf_dir}/*.parquet")
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(28,0)")
    found = files.agg(F.count("*").alias("n"), F.sum(mark).alias("mark")).first()
    return f"{sf_dir}:{found.n}:{found.mark}"


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{text} AS `{name}`" for name, text in columns.items()])


def join_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table columns that the 24-column record is made of, one row per line item.

    Only these narrow columns are shuffled: part's texts and the nation come last, and no
    text of the record is made before it is read. No side is broadcast by hint: Catalyst does
    so where the size statistics allow, and AQE splits a partition that one hot key makes too
    large.
    """
    line, order, part, customer, nation = (
        read_table(spark, sf_dir, name)
        for name in ("lineitem", "orders", "part", "customer", "nation")
    )
    buyers = order.join(customer, order.o_custkey == customer.c_custkey)
    joined = (
        line
        .join(buyers, line.l_orderkey == buyers.o_orderkey)
        .join(part, line.l_partkey == part.p_partkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
    )
    return joined.select(*RECORD_COLUMNS).withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


def join_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24-column record as a join over the tables."""
    return _select(join_records(spark, sf_dir), TRANSACTION_COLUMNS)


@contextmanager
def hashing_small_sides(spark: SparkSession) -> Iterator[None]:
    """A join run inside hashes a side that AQE finds small in every partition, instead of
    sorting both: the wide side streams past and never spills."""
    before = spark.conf.get(_HASH_BELOW)
    spark.conf.set(_HASH_BELOW, "64m")
    try:
        yield
    finally:
        spark.conf.set(_HASH_BELOW, before)


def write_landed(df: DataFrame, path: str) -> None:
    with hashing_small_sides(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)


def landed_path(
    spark: SparkSession,
    sf_dir: str,
    name: str = "transactions",
    build: Callable[[SparkSession, str], DataFrame] = join_transactions,
) -> str:
    """Path of a derived input as Parquet, written once per session and state of the input.

    Readers then prune columns and skip the joins; the shared folder keeps the table when
    executors are lost.
    """
    return made_once(
        spark,
        name,
        content_key(spark, sf_dir),
        lambda path: write_landed(build(spark, sf_dir), path),
    )


def _landed_frame(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]
) -> DataFrame:
    """The landed input, or the plain plan where no shared folder is named."""
    if scratch_root(spark) is None:
        return build(spark, sf_dir)
    return spark.read.parquet(landed_path(spark, sf_dir, name, build))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transaction record to query.

    What is landed are the columns it is made of, a third of its size; its texts are put
    together as they are read.
    """
    if scratch_root(spark) is None:
        return join_transactions(spark, sf_dir)
    landed = spark.read.parquet(landed_path(spark, sf_dir, "records", join_records))
    # Any column may be null, as in stored rows, also where its expression never is.
    return _select(
        landed, {name: f"IF(false, NULL, {text})" for name, text in TRANSACTION_COLUMNS.items()}
    )


def dirty_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record as text, with cells that do not fit their types, null keys and labels."""
    clean = transactions(spark, sf_dir)
    columns = {name: f"CAST({name} AS STRING)" for name in clean.columns}
    for name, (when, text) in DIRTY_CELLS.items():
        columns[name] = f"CASE WHEN {when} THEN {text} ELSE CAST({name} AS STRING) END"
    return _select(clean, columns)


def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(partner, n_rows): how many line items the record leaves out, by the first partner
    that is missing. A line item needs its part, its order, and the order's customer with
    its nation."""
    line, order, part, customer, nation = (
        read_table(spark, sf_dir, name)
        for name in ("lineitem", "orders", "part", "customer", "nation")
    )
    buyers = (
        order.select("o_orderkey", "o_custkey")
        .join(
            customer.select("c_custkey", "c_nationkey"),
            F.col("o_custkey") == F.col("c_custkey"),
            "left",
        )
        .join(nation.select("n_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    )
    joined = line.select("l_partkey", "l_orderkey").join(
        part.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left"
    ).join(buyers, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    partners = {"part": "p_partkey", "orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey"}
    counts, earlier = [], F.lit(True)
    for name, key in partners.items():
        missing = F.col(key).isNull()
        counts.append(
            F.struct(F.lit(name).alias("partner"), F.count_if(earlier & missing).alias("n_rows"))
        )
        earlier = earlier & ~missing
    return joined.agg(F.array(*counts).alias("found")).select(F.inline("found"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run: which comparison and label it belongs to, and how it ended."""
    return _select(read_table(spark, sf_dir, "orders"), RUN_COLUMNS)


def print_run_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all runs, with their order inside the run, as text expressions."""
    steps = _select(read_table(spark, sf_dir, "lineitem"), STEP_LINE_COLUMNS)
    lines = ", ".join(f"({number}L, {text})" for number, text in SUMMARY_LINES)
    summary = read_table(spark, sf_dir, "orders").selectExpr(
        f"{RUN_COLUMNS['run']} AS run", f"inline(array({lines})) AS (line_no, value)"
    )
    return steps.unionByName(summary)


def run_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (run, line_no, value) lines to query."""
    return _landed_frame(spark, sf_dir, "run-log-lines", print_run_log_lines)


def text_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(read_table(spark, sf_dir, "lineitem"), CELL_COLUMNS)
