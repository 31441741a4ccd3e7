"""Numbering by ranges, order of the input, switched tables, quarantined lines."""

import random

import pytest
from pyspark.sql import functions as F

from stepframe import sources as S
from stepframe.operators import ordered as W
from stepframe.operators import ranges as R
from stepframe.sources import writers


def _table(spark, n=6000):
    rng = random.Random(4)
    data = [(7 if i % 3 == 0 else rng.choice([None, *range(200)]), rng.choice([None, "", "a", "b"]), i) for i in range(n)]
    return data, spark.createDataFrame(data, "v int, s string, i int").repartition(7)


def _sorted(data, columns):
    return sorted(data, key=lambda r: tuple((r[c] is not None, r[c] if r[c] is not None else 0) for c in columns))


@pytest.mark.parametrize("per_range", [100, 1500, 10_000])
def test_numbers_by_ranges_follow_the_order(spark, per_range):
    data, df = _table(spark)
    got = {r["i"]: r["id"] for r in W.dense_row_id(df, ["v", "i"], 5, rows_per_range=per_range).collect()}
    assert got == {r[2]: 5 + k for k, r in enumerate(_sorted(data, (0, 2)))}


def test_a_hot_value_is_split_by_the_tie_break_and_equal_rows_are_numbered_too(spark):
    data, df = _table(spark)
    cuts = R.order_cuts(df, ["v", "i"], 100)
    sizes = [r["count"] for r in R.with_range(df, ["v", "i"], cuts).groupBy(R.RANGE).count().collect()]
    assert len(sizes) > 40 and max(sizes) < 500, "a third of the rows have one value"
    same = df.select(F.lit(1).alias("a"), "s").unionByName(spark.range(50).selectExpr("2 AS a", "'z' AS s"))
    numbers = W.dense_row_id(same, ["a"], out="n", rows_per_range=100).collect()
    assert sorted(r["n"] for r in numbers) == list(range(1, 6051))
    assert {r["n"] for r in numbers if r["a"] == 2} == set(range(6001, 6051))


def test_numbering_stores_no_copy_and_is_alike_after_another_run(spark, monkeypatch):
    _, df = _table(spark)
    stored = []
    real = R.materialize
    monkeypatch.setattr(R, "materialize", lambda d, label: stored.append(d.columns) or real(d, label))
    monkeypatch.setattr(W, "materialize", lambda d, label: pytest.fail("the rows are copied"))
    first = {r["i"]: r["id"] for r in W.dense_row_id(df, ["v"], rows_per_range=900).collect()}
    again = {r["i"]: r["id"] for r in W.dense_row_id(df.orderBy(F.rand(3)), ["v"], rows_per_range=900).collect()}
    assert first == again and all("i" not in c for c in stored)


def test_cuts_are_no_column_of_the_rows(spark):
    _, df = _table(spark)
    plan = R.with_range(df, ["v", "i"], R.order_cuts(df, ["v", "i"], 100))._jdf.queryExecution().executedPlan().toString()
    assert "_sf_cuts" not in plan


def test_numbering_of_empty_and_single_rows_and_odd_names(spark):
    _, df = _table(spark, 10)
    assert W.dense_row_id(df.limit(0), ["v"]).collect() == []
    assert W.dense_row_id(df.limit(1), ["v"]).collect()[0]["id"] == 1
    odd = df.withColumnsRenamed({"v": "a.b", "s": "k0"})
    assert sorted(r["id"] for r in W.dense_row_id(odd, ["a.b", "k0"], rows_per_range=2).collect()) == list(range(1, 11))


def _in_order(spark, folder, values, files):
    at = f"{folder}/t-{len(values)}-{files}"
    frame = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v string, i int")
    frame.repartitionByRange(files, "i").sortWithinPartitions("i").write.parquet(at)
    return S.read_in_order(spark, at)


def test_equal_keys_stay_in_the_order_of_the_input(spark, tmp_path):
    rng = random.Random(1)
    values = [rng.choice([None, "a", "b", "c"]) for _ in range(500)]
    df = _in_order(spark, tmp_path, values, 6)
    want = sorted(range(500), key=lambda i: (values[i] is not None, values[i] or ""))
    assert [r["i"] for r in S.stable_sort(df, ["v"]).collect()] == want
    assert all(r["_n_"] == r["i"] + 1 for r in S.observation_numbers(df).collect())
    few = S.observation_numbers(df.where("i % 3 = 1")).collect()
    assert {r["i"]: r["_n_"] for r in few} == {i: k + 1 for k, i in enumerate(range(1, 500, 3))}
    first = {r["v"]: r["i"] for r in S.first_in_input(df, ["v"]).collect()}
    assert first == {v: values.index(v) for v in (None, "a", "b", "c")}
    assert S.first_in_input(df.select("v", "input_file", "input_row"), ["v"]).count() == 4
    assert S.observation_numbers(df.limit(0)).count() == 0


def test_merge_by_position(spark, tmp_path, as_rows):
    left = _in_order(spark, tmp_path, ["a", "b", "c", "d", "e"], 2)
    right = _in_order(spark, tmp_path, ["x", None, "z"], 3).withColumnRenamed("i", "j")
    got = as_rows(S.merge_by_position(left, right).select("i", "j", "v"))
    assert got == [(0, 0, "x"), (1, 1, None), (2, 2, "z"), (3, None, "d"), (4, None, "e")]
    other = as_rows(S.merge_by_position(right, left).select("i", "j", "v"))
    assert other == [(0, 0, "a"), (1, 1, "b"), (2, 2, "c"), (3, None, "d"), (4, None, "e")]


def test_no_line_is_lost(spark):
    lines = ["1,2.5,x", "2,,", "3,x,y", "4,1.0", "5,1,a,b", "", None, '6,7,"a,b"', " 7 , 8 ,  z ", "x,y,z", "8,9,\"\"", "1,2,z,", "1,,", '1,2,"z']
    got = S.lines_with_status(spark.createDataFrame([(x,) for x in lines], "value string"), "id int, v double, t string").collect()
    assert [r["value"] for r in got] == lines
    assert [r["reason"] for r in got] == [None, None, "not a double: v", "too few fields", "too many fields", "too few fields",
                                          "too few fields", None, None, "not a int: id", None, "too many fields", None, "open quote"]
    kept = [(r["id"], r["v"], r["t"]) for r in got if r["status"] == "accepted"]
    assert kept == [(1, 2.5, "x"), (2, None, None), (6, 7.0, "a,b"), (7, 8.0, "  z "), (8, 9.0, None), (1, None, None)]
    assert (got[2]["id"], got[2]["v"], got[2]["t"]) == (3, None, "y")


def test_fixed_width_lines_that_do_not_fit(spark):
    lines = [" 12abc", "  .ab ", "   x", "1x 2", "1", "", None]
    got = S.fixed_width_with_status(spark.createDataFrame([(x,) for x in lines], "value string"),
                                    [("n", "num", 1, 3), ("t", "char", 4, 6)]).collect()
    assert [(r["n"], r["t"], r["reason"]) for r in got[:4]] == [
        (12.0, "abc", None), (None, "ab", None), (None, "x", None), (None, "2", "not a number: n")]
    assert [r["reason"] for r in got[4:]] == ["too few fields"] * 3


def test_switched_tables_keep_readers_and_survive_failures(spark, tmp_path, monkeypatch, as_rows):
    place, name = str(tmp_path / "t"), "stepframe_switch_test"
    assert S.switch_table(spark.range(3), name, place) is None
    begun = spark.table(name)
    begun.count()
    before = S.switch_table(spark.table(name).selectExpr("id + 10 AS id"), name, place)
    assert as_rows(spark.table(name)) == [(10,), (11,), (12,)]
    assert as_rows(spark.read.parquet(before)) == [(0,), (1,), (2,)], "the old rows stay for those that read them"

    real = writers._change

    def failing(part):
        def change(session, statement):
            if part in statement:
                raise OSError(part)
            real(session, statement)
        return change

    monkeypatch.setattr(writers, "_change", failing("SET LOCATION"))
    with pytest.raises(OSError):
        S.switch_table(spark.range(1), name, place)
    monkeypatch.setattr(writers, "_change", real)
    with pytest.raises(Exception):
        S.switch_table(spark.range(1).selectExpr("raise_error('no') AS id"), name, place)
    assert as_rows(spark.table(name)) == [(10,), (11,), (12,)]
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_a_table_with_other_columns_or_partitions_is_replaced_or_comes_back(spark, tmp_path, monkeypatch, as_rows):
    name = "stepframe_switch_wide"
    spark.range(4).selectExpr("id", "id % 2 AS p").write.partitionBy("p").saveAsTable(name)
    S.switch_table(spark.table(name).where("p = 1"), name, str(tmp_path / "w"))
    assert as_rows(spark.table(name)) == [(1, 1), (3, 1)]
    real = writers._change

    def change(session, statement):
        if "_new_" in statement and "RENAME" in statement:
            raise OSError("second step")
        real(session, statement)

    monkeypatch.setattr(writers, "_change", change)
    with pytest.raises(OSError):
        S.switch_table(spark.range(1), name, str(tmp_path / "w"))
    assert as_rows(spark.table(name)) == [(1, 1), (3, 1)]
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith(name)] == [name]
    monkeypatch.setattr(writers, "_change", real)
    S.switch_table(spark.range(1), name, str(tmp_path / "w"))
    assert as_rows(spark.table(name)) == [(0,)]
    spark.sql(f"DROP TABLE {name}")
