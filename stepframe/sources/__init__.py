"""Readers and writers for libraries of tables, fixed-width text, sheets and scripts."""

from stepframe.sources.readers import (
    csv_scan,
    expand_loop,
    first_in_input,
    fixed_width_read,
    fixed_width_with_status,
    generate_series,
    library_read,
    lines_with_status,
    merge_by_position,
    observation_numbers,
    parse_fixed_width,
    preview_rows,
    read_in_order,
    read_scripts,
    script_ingest,
    sheet_import,
    stable_sort,
)
from stepframe.sources.writers import (
    audit_log_append,
    audit_log_lines,
    create_table_as,
    create_view,
    labelled_export,
    library_write,
    switch_table,
    with_labels,
)

__all__ = [n for n in dir() if not n.startswith("_")]
