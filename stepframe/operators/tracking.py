"""Job-tracking summaries: status boards, recent activity, usage metering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepframe.operators.ordered import top_n_per_group

# Which states count as active, completed, pending and converted.
ACTIVE_PROJECTS = ("ready", "converting")
COMPLETED_PROJECTS = ("completed",)
PENDING_TASKS = ("pending",)
CONVERTED_TASKS = ("converted", "reviewed", "approved")
RECENT_TASKS = 10
MONTHLY_LIMIT = 1000


def _hits(states: Sequence[str]) -> Column:
    return F.count(F.when(F.col("status").isin(list(states)), 1)).cast("bigint")


def status_dashboard(owners: DataFrame, projects: DataFrame, tasks: DataFrame,
                     owner: str = "user_id", project: str = "project_id") -> DataFrame:
    """One row per owner with project and task counts; owners without any get zeros.

    ``failed_tasks`` is total minus pending minus converted, so it includes tasks in work.
    Tasks are counted per project before they are joined to the projects.
    """
    per_project = tasks.groupBy(project).agg(
        F.count(F.lit(1)).alias("_t"), _hits(PENDING_TASKS).alias("_p"),
        _hits(CONVERTED_TASKS).alias("_c"))
    per_owner = projects.select(owner, project, "status").join(per_project, project, "left")
    counted = per_owner.groupBy(owner).agg(
        F.count(F.lit(1)).cast("bigint").alias("total_projects"),
        _hits(ACTIVE_PROJECTS).alias("active_projects"),
        _hits(COMPLETED_PROJECTS).alias("completed_projects"),
        F.sum("_t").alias("total_tasks"), F.sum("_p").alias("pending_tasks"),
        F.sum("_c").alias("converted_tasks"))
    names = counted.columns[1:]
    board = owners.select(owner).join(counted, owner, "left").select(
        owner, *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])
    failed = F.col("total_tasks") - F.col("pending_tasks") - F.col("converted_tasks")
    return board.withColumn("failed_tasks", failed)


def recent_activity(tasks: DataFrame, projects: DataFrame, tie_break: Sequence[str],
                    owner: str = "user_id", project: str = "project_id",
                    updated: str = "updated_at", n: int = RECENT_TASKS) -> DataFrame:
    """The ``n`` most recently updated tasks of each owner with their project.

    ``tie_break`` names task columns.  Tasks are first cut to ``n`` per project, in the same
    order: that needs no shuffle beyond the one of the join, and a project with very many
    tasks sends only a few rows per map task into it.
    """
    order = [F.col(updated).desc(), *[F.col(c).asc() for c in tie_break]]
    few = top_n_per_group(tasks, [project], order, n, "_sf_rank").drop("_sf_rank")
    return top_n_per_group(few.join(projects, project, "inner"), [owner], order, n)


def monthly_usage(requests: DataFrame, limits: DataFrame | None = None, user: str = "user_id",
                  at: str = "ts", default_limit: int = MONTHLY_LIMIT) -> DataFrame:
    """Requests per user and month with the limit and what remains of it (never below 0).

    ``limits`` has (user, monthly_request_limit), one row per user.
    """
    used = requests.groupBy(user, F.year(at).alias("year"), F.month(at).alias("month")).agg(
        F.count(F.lit(1)).cast("bigint").alias("request_count"))
    if limits is None:
        used = used.withColumn("monthly_limit", F.lit(default_limit).cast("bigint"))
    else:
        known = limits.select(user, F.col("monthly_request_limit").alias("monthly_limit"))
        used = used.join(known, user, "left")
        used = used.withColumn("monthly_limit", F.coalesce(
            F.col("monthly_limit"), F.lit(default_limit)).cast("bigint"))
    left = F.col("monthly_limit") - F.col("request_count")
    return used.withColumn("remaining", F.greatest(F.lit(0).cast("bigint"), left))


def file_count(files: DataFrame, project: str = "project_id") -> DataFrame:
    """Accepted files per project over all uploads (see ``script_ingest`` for the status)."""
    accepted = F.count(F.when(F.col("status") == "accepted", 1)).cast("bigint")
    return files.groupBy(project).agg(accepted.alias("file_count"))
