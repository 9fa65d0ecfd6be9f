"""Run logs: parsing, error lines, and comparing runs."""

import pytest

from cardsieve.operators import runlog
from cardsieve.sources import read_run_logs

FAST = """\
  Started at  : 2024-01-01
       Done in 0.16s
  Total duration : 32.44s
  Total rows     : 500,000
  feature_eng     :     0.16s  (  0.5%)  
  split           :     8.40s  ( 25.9%)  ############
  TOTAL           :    32.44s  (100.0%)
24/01/01 WARN Utils: low disk
24/01/01 INFO Executor: up
error: lost
"""
SLOW = """\
  split           :     1.00s  (  0.5%)  
  split           :    16.80s  ( 25.9%)  
  Total rows     : 7
  Total duration : soon
"""


@pytest.fixture
def lines(spark, tmp_path):
    (tmp_path / "fast.log").write_text(FAST)
    (tmp_path / "slow.log").write_text(SLOW)
    return read_run_logs(spark, str(tmp_path))


@pytest.fixture
def parsed(lines):
    return runlog.parse_run_log(lines)


def test_parse(parsed):
    assert sorted(map(tuple, parsed.collect()), key=repr) == sorted(
        [
            ("fast", "feature_eng", 0.16, None, None),
            ("fast", "split", 8.4, None, None),
            ("fast", None, None, 32.44, 500000),
            ("slow", "split", 16.8, None, None),
            ("slow", None, None, None, 7),
        ],
        key=repr,
    )
    assert runlog.step_times(parsed).count() == 3
    assert runlog.run_totals(parsed).count() == 2


def test_equal_file_names_in_two_folders_are_two_runs(spark, tmp_path):
    for folder in ("a", "b.c"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.log").write_text(FAST)
    (tmp_path / "x.log").write_text(SLOW)
    lines = read_run_logs(spark, str(tmp_path))
    assert {r.run for r in lines.collect()} == {"a/x", "b.c/x", "x"}
    alone = read_run_logs(spark, str(tmp_path / "a" / "x.log"))
    assert alone.first().run.endswith("/a/x")


def test_later_lines_count_even_in_small_blocks(spark, tmp_path):
    """A log cut into many blocks keeps the order of its lines."""
    text = "".join(f"  split           : {n:>8.2f}s  (  0.5%)  \n" for n in range(2000))
    (tmp_path / "long.log").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        lines = read_run_logs(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 10
        assert runlog.parse_run_log(lines).first().seconds == 1999.0
        last = runlog.error_lines(lines, last=3).collect()
        assert sorted(row.value[20:28] for row in last) == [" 1997.00", " 1998.00", " 1999.00"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_are_combined_before_the_shuffle(parsed):
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "SortAggregate" not in plan


def test_error_lines(lines):
    loud = runlog.error_lines(lines, last=None)
    assert not [r for r in loud.collect() if "WARN" in r.value or "INFO" in r.value]
    assert loud.count() == len(FAST.splitlines()) - 2 + len(SLOW.splitlines())
    newest = {r.value for r in runlog.error_lines(lines, last=1).collect()}
    assert newest == {"error: lost", "  Total duration : soon"}
    plan = runlog.error_lines(lines, last=20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_step_share(parsed):
    assert {tuple(row) for row in runlog.step_share(parsed).collect()} == {
        ("fast", "feature_eng", 0.16, 0.5),
        ("fast", "split", 8.4, 25.9),
    }


RUN_COLUMNS = "run STRING, comparison BIGINT, label STRING, success BOOLEAN, wall_time DOUBLE"


def runs(spark, *rows):
    return spark.createDataFrame(rows, RUN_COLUMNS)


def test_compare(spark, parsed):
    all_runs = runs(
        spark,
        ("fast", 1, "a", True, 40.0), ("slow", 1, "b", True, 64.88), ("gone", 1, "c", False, 1.0),
        ("silent", 2, "a", True, 5.0), ("dead", 2, "b", False, 1.0),
        ("lone", 3, "a", True, 3.0),
    )
    found = runlog.compare_runs(all_runs, parsed, ["a", "b", "c"]).collect()
    assert {r.other for r in found} == {None}
    table = {(r.comparison, r.step): tuple(r)[2:5] for r in found}
    assert table == {
        (1, "feature_eng"): (0.16, None, None),
        (1, "split"): (8.4, 16.8, None),
        (1, "TOTAL"): (32.44, 64.88, None),
        (3, "TOTAL"): (3.0, None, None),
    }
    speed = {r.comparison: tuple(r)[1:] for r in runlog.speedup(all_runs, parsed).collect()}
    assert speed == {1: ("a", "b", 2.0, 32.44), 3: ("a", "a", 1.0, 0.0)}


def test_compare_keeps_labels_that_are_not_listed(spark, parsed):
    two = runs(spark, ("fast", 1, "a", True, 40.0), ("slow", 1, "b", True, 64.88))
    found = {r.step: (r.a, r.other) for r in runlog.compare_runs(two, parsed, ["a"]).collect()}
    assert found == {"feature_eng": (0.16, None), "split": (8.4, 16.8), "TOTAL": (32.44, 64.88)}


def test_fallback_to_wall_time_is_per_run(spark, parsed):
    """One run of a label tells its total, a slower one does not."""
    three = runs(spark, ("fast", 1, "a", True, 1.0), ("x", 1, "a", True, 50.0),
                 ("y", 1, "b", True, 2.0))
    total = runlog.compare_runs(three, parsed, ["a", "b"]).where("step = 'TOTAL'").first()
    assert (total.a, total.b) == (50.0, 2.0)
    assert runlog.speedup(three, parsed).first().slowest == "a"


def test_speedup_ties_go_to_the_first_label(spark, parsed):
    tied = runs(spark, *[(f"x{n}", 1, label, True, 2.0) for n, label in enumerate("cab")])
    assert tuple(runlog.speedup(tied, parsed).first()) == (1, "a", "a", 1.0, 0.0)
    zero = runs(spark, ("x", 1, "a", True, 0.0), ("y", 1, "b", True, 2.0))
    assert runlog.speedup(zero, parsed).count() == 0
