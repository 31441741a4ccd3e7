"""DataFrame operators; each takes and returns DataFrames."""

from stepframe.operators.joins import (
    enrich_by_key,
    full_outer_merge,
    in_target,
    match_merge,
    merge_with_presence,
    nest_children,
    not_in_target,
    owner_scoped_join,
    range_join,
)
from stepframe.operators.load import (
    align_to_schema,
    append_force,
    cascade_delete,
    counter_upsert,
    delete_where,
    insert_values,
    sentinel_members,
    table_load_replace,
    update_set,
    upsert_status,
)
from stepframe.operators.ordered import (
    dense_row_id,
    first_last_flags,
    first_match,
    group_remerge,
    having_remerge,
    latest_version,
    positions,
    retain_counter,
    running,
    surrogate_keys,
    top_n_per_group,
    usage_limit_flag,
    versions,
)
from stepframe.operators.rows import declare_defaults, enum_domain_check, route_rows
from stepframe.operators.sets import compare_verdict, dataset_compare, set_concat, union_distinct
from stepframe.operators.summary import (
    class_means,
    column_profile,
    conversion_time_stats,
    freq_oneway,
    overall_means,
    progress_percent,
    return_code_rollup,
)
from stepframe.operators.tracking import monthly_usage, recent_activity, status_dashboard

__all__ = [n for n in dir() if not n.startswith("_")]
