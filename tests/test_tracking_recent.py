"""Recent activity per owner."""

import random

from stepframe.operators.tracking import recent_activity


def test_recent_tasks_of_each_owner(spark):
    rnd = random.Random(2)
    projects = [(p, f"u{p % 4}", f"name{p}") for p in range(12)]
    tasks = [(0 if i % 3 == 0 else rnd.randrange(14), i, rnd.randrange(50)) for i in range(400)]
    got = recent_activity(spark.createDataFrame(tasks, "project_id int, task_id int, updated_at int").repartition(5),
                          spark.createDataFrame(projects, "project_id int, user_id string, project_name string"),
                          ["task_id"], n=10)
    owner = {p: u for p, u, _ in projects}
    want = set()
    for u in set(owner.values()):
        mine = sorted((-at, t, p) for p, t, at in tasks if owner.get(p) == u)[:10]
        want |= {(u, t, rank + 1) for rank, (_, t, _) in enumerate(mine)}
    assert {(r.user_id, r.task_id, r["rank"]) for r in got.collect()} == want


def test_tasks_are_cut_before_the_join(spark):
    tasks = spark.range(1000).selectExpr("id % 300 AS project_id", "id AS task_id", "id AS updated_at")
    projects = spark.range(300).selectExpr("id AS project_id", "CAST(id % 2 AS STRING) AS user_id")
    plan = recent_activity(tasks, projects, ["task_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4
