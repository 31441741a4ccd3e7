"""Column-level functions: missing-value rules, conditionals, text and number formats."""

from stepframe.functions.missing import (
    is_blank,
    is_missing,
    missing_ge,
    missing_gt,
    missing_le,
    missing_lt,
    not_blank,
)
from stepframe.functions.rules import (
    band_ladder,
    binary_branch,
    clamp,
    has_text,
    ifc,
    in_domain,
    strictly_between,
)
from stepframe.functions.scalars import (
    cats,
    catx,
    coalesce_zero,
    compress,
    concat_bars,
    datetime_iso,
    datetime_text,
    dollar_format,
    input_numeric,
    json_field,
    left_trim,
    missing_all,
    path_extension,
    path_segment_after,
    path_stem,
    put_best,
    put_numeric,
    scan_token,
    strip,
    substr,
    text_head,
    text_length,
    trim_trailing,
    upcase,
)

__all__ = [n for n in dir() if not n.startswith("_")]
