"""Loads, readers, writers and row operators."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe import session
from stepframe import sources as S
from stepframe.operators import load as D
from stepframe.operators import rows as R


def test_scale_conf():
    assert session.scale_conf(10 ** 9)["spark.sql.shuffle.partitions"] == "200"
    assert session.scale_conf(1 << 40)["spark.sql.shuffle.partitions"] == "4096"


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


def test_scratch_lies_in_a_shared_folder(spark):
    class Conf:
        def get(self, key, *_):
            return "hdfs://name/warehouse/" if key == "spark.sql.warehouse.dir" else None

    class Context:
        def getCheckpointDir(self):
            return None

    class Cluster:
        conf, sparkContext = Conf(), Context()

    assert session.scratch_root(Cluster()) == "hdfs://name/warehouse/_stepframe_scratch"
    a, b = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert a != b and a.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_fixed_width(spark, folder, as_rows):
    lines = [".                        .", "Pan Am                 123", "Very long airline name x4", "  padded                1.5  ", ""]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(folder + "/in")
    got = S.fixed_width_read(spark, folder + "/in", [("name", "char", 1, 20), ("n", "num", 22, 28)])
    assert as_rows(got) == [("", None), ("", None), ("Pan Am", 123.0), ("Very long airline na", None), ("padded", 1.5)]


def test_sheets(spark, folder, as_rows):
    df = spark.createDataFrame([(1, "a, b", 2.5), (2, "c", None)], "id int, t string, v double")
    df.coalesce(1).write.option("header", True).csv(folder + "/sheet")
    got = S.sheet_import(spark, folder + "/sheet")
    assert got.dtypes == [("id", "int"), ("t", "string"), ("v", "double")]
    assert as_rows(got) == as_rows(df)
    typed = S.sheet_import(spark, folder + "/sheet", "id bigint, t string, v double")
    assert typed.dtypes[0] == ("id", "bigint")
    assert S.csv_scan(spark, folder + "/sheet").columns == ["_c0", "_c1", "_c2"]


def test_library_round_trip(spark, folder):
    df = spark.range(5)
    S.library_write(df, folder, "t")
    S.library_write(df.where("id < 3"), folder, "t")
    assert S.library_read(spark, folder, "t").count() == 3
    S.library_write(df, "default", "stepframe_lib_t")
    assert S.library_read(spark, "default", "stepframe_lib_t").count() == 5


def test_labelled_export(spark, folder):
    df = spark.createDataFrame([(1, "x", "gone")], "id int, naam string, d string")
    df = S.with_labels(df, {"id": "Age id", "naam": "Classe d'âge"}, {"naam": 24})
    S.labelled_export(df, folder + "/out", drop=["d"])
    S.labelled_export(df, folder + "/out", drop=["d"])
    assert S.sheet_import(spark, folder + "/out").columns == ["Age id", "Classe d'âge"]
    assert S.sheet_import(spark, folder + "/out").count() == 1


def test_labels_cut_text(spark):
    df = S.with_labels(spark.createDataFrame([("abcdef",)], "t string"), {"t": "T"}, {"t": 3})
    assert df.first().t == "abc"
    assert df.schema["t"].metadata == {"length": 3, "label": "T"}


def test_append_force(spark, as_rows):
    base = S.with_labels(spark.createDataFrame([("ab", 1)], "t string, n int"), {}, {"t": 3})
    data = spark.createDataFrame([("abcdef", "x")], "t string, extra string")
    got = D.append_force(base, data)
    assert got.columns == ["t", "n"] and as_rows(got) == [("ab", 1), ("abc", None)]


def test_script_ingest(spark):
    files = [("a.sas", b"data x; run;"), ("b.txt", b"data"), ("c.sas", b" \n\t "), ("d.sas", b"\xff\xfe"),
             (None, b"x"), ("e.sas", "é".encode()),
             ("f.sas", "\u00a0\u3000\x1f".encode())]
    got = S.script_ingest(spark.createDataFrame(files, "name string, content binary"))
    assert {r.name: r.status for r in got.collect()} == {
        "a.sas": "accepted", "b.txt": "rejected_name", "c.sas": "skipped_blank", "d.sas": "rejected_encoding",
        None: "rejected_name", "e.sas": "accepted",
        "f.sas": "skipped_blank"}


def test_read_scripts(spark, folder):
    (open(folder + "/one.sas", "w")).write("data a; run;")
    got = S.script_ingest(S.read_scripts(spark, folder)).collect()
    assert [(r.name, r.status, r.text) for r in got] == [("one.sas", "accepted", "data a; run;")]


def test_loops(spark, as_rows):
    df = spark.createDataFrame([(1, 3), (5, 4), (2, 2)], "a int, b int")
    assert as_rows(S.expand_loop(df, F.col("a"), F.col("b"), "i")) == [(1, 3, 1), (1, 3, 2), (1, 3, 3), (2, 2, 2)]
    assert S.generate_series(spark, 0, 150, "age").agg(F.count("age"), F.max("age")).first()[:] == (151, 150)


def test_audit_log(spark, folder, as_rows):
    writes = spark.sql("""SELECT * FROM VALUES
        (TIMESTAMP_NTZ '2024-01-01 10:00:00', 'a1', '/o/jobs/j/tasks/007/f.json'),
        (TIMESTAMP_NTZ '2024-01-01 10:00:00', 'a1', '/o/elsewhere/f.json') AS t(at, agent, path)""")
    for _ in range(2):
        log = S.audit_log_append(spark, writes, "at", "agent", "path", folder + "/log")
    assert as_rows(log.select("job", "step", "line")) == [
        ("j", "007", "[2024-01-01 10:00:00] [a1] Wrote: /o/jobs/j/tasks/007/f.json")] * 2


def test_align_and_replace(spark, folder, as_rows):
    schema = T.StructType([T.StructField("id", T.LongType(), True, {"label": "Id"}),
                           T.StructField("t", T.StringType(), True, {"length": 2}),
                           T.StructField("more", T.DoubleType())])
    df = spark.createDataFrame([("1", "abc", 9), ("x", "d", 9)], "id string, t string, extra int")
    for _ in range(2):
        got = D.table_load_replace(df, schema, folder + "/t")
    assert as_rows(got) == [(None, "d", None), (1, "ab", None)]
    assert got.schema["id"].metadata == {"label": "Id"}


def test_delete_insert_update(spark, as_rows):
    df = spark.createDataFrame([(1, "a"), (2, None), (-1, "old")], "id int, t string")
    assert as_rows(D.delete_where(df, F.col("t") == "a")) == [(-1, "old"), (2, None)]
    assert as_rows(D.update_set(df, {"t": F.lit("z")}, F.col("t") == "a")) == [(-1, "old"), (1, "z"), (2, None)]
    assert {r.t for r in D.update_set(df, {"t": F.lit("q")}).collect()} == {"q"}
    members = [{"id": -1, "t": "none"}, {"id": -2}]
    once = D.sentinel_members(df, "id", members)
    assert as_rows(once) == [(-2, None), (-1, "none"), (1, "a"), (2, None)]
    assert as_rows(D.sentinel_members(once, "id", members)) == as_rows(once)
    with pytest.raises(ValueError):
        D.insert_values(df, [{"nope": 1}])


def test_upsert_status(spark):
    now = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
    current = spark.sql(f"""SELECT * FROM VALUES (1, 'pending', 'c0', 1, {now}), (2, 'pending', 'c0', 1, {now})
                            AS t(id, status, code, version, updated_at)""")
    later = "TIMESTAMP_NTZ '2024-02-01 00:00:00'"
    changes = spark.sql(f"""SELECT * FROM VALUES (1, 1, 'converting', NULL, {now}), (1, 2, '', 'c1', {now}),
        (1, 3, NULL, '', {later}), (9, 1, 'converted', 'x', {later}) AS t(id, seq, status, code, at)""")
    options = dict(key="id", order_by=["seq"], fields=["status", "code"], blank_ignored=["status"],
                   version_on="code", at="at")
    got = {r.id: tuple(r)[1:4] for r in D.upsert_status(current, changes, **options).collect()}
    assert got == {1: ("converting", "", 3), 2: ("pending", "c0", 1)}
    more = {r.id: tuple(r)[1:4] for r in D.upsert_status(current, changes, insert_new=True, **options).collect()}
    assert more[9] == ("converted", "x", 2)


def test_cascade_delete(spark, as_rows):
    parent = spark.createDataFrame([(1,), (2,)], "p int")
    tasks = spark.createDataFrame([(10, 1), (20, 2)], "t int, p int")
    comments = spark.createDataFrame([(100, 10), (200, 20)], "c int, t int")
    steps = spark.createDataFrame([(7, 1), (8, 2)], "s int, p int")
    left = D.cascade_delete(parent, parent.where("p = 1"), "p", [
        ("tasks", tasks, "t", "p"), ("comments", comments, "c", "t"), ("steps", steps, "s", "p")])
    assert as_rows(left["parent"]) == [(2,)]
    assert as_rows(left["tasks"].select("t")) == [(20,)]
    assert as_rows(left["comments"].select("c")) == [(200,)]
    assert as_rows(left["steps"].select("s")) == [(8,)]
    with pytest.raises(ValueError):
        D.cascade_delete(parent, parent, "p", [("x", comments, "c", "t")])


def test_counters(spark, as_rows):
    counters = spark.createDataFrame([("u", 2024, 1, 5), ("w", 2024, 1, 9)], "user string, y int, m int, request_count int")
    events = spark.createDataFrame([("u", 2024, 1)] * 3 + [("n", 2024, 1)] + [("w", 2024, 1)] * 5, "user string, y int, m int")
    by = ["user", "y", "m"]
    assert [r[3] for r in as_rows(D.counter_upsert(counters, events, by))] == [1, 8, 14]
    assert [r[3] for r in as_rows(D.counter_upsert(counters, events, by, limit=7))] == [1, 7, 9]


def test_route_and_domains(spark):
    df = spark.createDataFrame([("REFERENTIAL", "a"), ("foreign key", "b"), (None, "c"), ("index", "d")], "type string, name string")
    routed = R.route_rows(df, F.col("type") == "REFERENTIAL", {
        "fk": (F.upper("type") == "FOREIGN KEY", F.concat(F.lit("ic delete "), "name"))})
    assert {r.name: (r.route, r.command) for r in routed.collect()} == {
        "b": ("fk", "ic delete b"), "c": ("main", None), "d": ("main", None)}
    checked = R.enum_domain_check(df, {"name": ["b", "c", "d"], "type": ["index"]})
    assert {r.name: (r.valid, r.reason) for r in checked.collect()} == {
        "a": (False, "invalid name"), "b": (False, "invalid type"), "c": (False, "invalid type"), "d": (True, None)}


def test_declared_defaults(spark):
    df = spark.createDataFrame([("abcdef",), (None,)], "t string")
    got = R.declare_defaults(df, {"t": (3, "-"), "u": (2, "xyz")})
    assert sorted(tuple(r) for r in got.collect()) == [("", "xy"), ("abc", "xy")]
