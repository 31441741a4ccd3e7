"""Text, number and date functions as plain Column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe.functions.missing import _col, _val


def substr(c, start: int, length: int) -> Column:
    """Part of a text by 1-based start and length."""
    return F.substring(_col(c), start, length)


def strip(c) -> Column:
    return F.trim(_col(c))


def trim_trailing(c) -> Column:
    return F.rtrim(_col(c))


def left_trim(c) -> Column:
    return F.ltrim(_col(c))


def upcase(c) -> Column:
    return F.upper(_col(c))


def compress(c) -> Column:
    """All blanks removed."""
    return F.translate(_col(c), " ", "")


def text_length(c) -> Column:
    """Length without trailing blanks; 0 for a missing text."""
    return F.length(F.coalesce(F.rtrim(_col(c)), F.lit("")))


def put_numeric(c, width: int, align: str = "right") -> Column:
    """Number as text of a fixed width, rounded to an integer; missing shows as a period.

    ``align="left"`` gives the text without leading blanks.  A number that needs more than
    ``width`` characters shows as asterisks.
    """
    number = F.round(_col(c))
    small = F.abs(number) < 1e18
    text = F.coalesce(F.when(small, number).cast("bigint").cast("string"), F.lit("."))
    text = F.when(~small | (F.length(text) > width), F.lit("*" * width)).otherwise(text)
    return text if align == "left" else F.lpad(text, width, " ")


def put_best(c) -> Column:
    """Shortest plain text of a number: whole numbers without decimals, missing as a period."""
    c = _col(c).cast("double")
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    # Plain notation where 38 digits hold the number: doubles between 1e-15 and 1e15 have 17 at most.
    plain = F.regexp_replace(F.when((F.abs(c) < 1e15) & (F.abs(c) >= 1e-6), c).cast("decimal(38,22)").cast("string"), r"\.?0+$", "")
    text = F.when(whole, F.when(whole, c).cast("bigint").cast("string")).otherwise(F.coalesce(plain, c.cast("string")))
    return F.coalesce(text, F.lit("."))


def input_numeric(c) -> Column:
    """Text to number; blank or unreadable text becomes missing.

    Only digits, sign, point and exponent count as a number: Spark alone would also read
    ``NaN``, ``Infinity`` or ``1d``.
    """
    text = F.trim(_col(c))
    return F.when(F.translate(text, "0123456789+-.eE", "") == "", text.try_cast("double"))


def catx(separator: str, *parts) -> Column:
    """Parts stripped and joined by ``separator``; blank and missing parts are left out.

    Give numbers as text by ``put_numeric`` or ``put_best``, here and in ``cats``.
    """
    kept = [F.nullif(F.trim(_col(p).cast("string")), F.lit("")) for p in parts]
    return F.concat_ws(separator, *kept)


def cats(*parts) -> Column:
    """Parts stripped and put together without a separator; missing text adds nothing."""
    return F.concat(*[F.coalesce(F.trim(_col(p).cast("string")), F.lit("")) for p in parts])


def concat_bars(*parts) -> Column:
    """Plain concatenation; a missing part counts as empty."""
    return F.concat(*[F.coalesce(_val(p).cast("string"), F.lit("")) for p in parts])


def scan_token(c, n: int, delimiter: str) -> Column:
    """The n-th token (1-based); neighbouring delimiters count as one, no token gives ''."""
    pieces = F.filter(F.split(_col(c), "\\Q" + delimiter + "\\E"), lambda x: x != "")
    return F.coalesce(F.get(pieces, F.lit(n - 1)), F.lit(""))


def dollar_format(c, width: int = 9, decimals: int = 2) -> Column:
    """Currency text, right-aligned: ``$1,234.50``.

    When it does not fit, first the dollar sign goes, then the commas, then the decimals one
    by one; a number that still does not fit shows as asterisks.  Missing shows as a period.
    """
    c = _col(c)
    shown = lambda d: F.format_number(F.round(c, d), d)  # noqa: E731  (halves go up)
    plain = shown(decimals)
    shapes = [F.concat(F.lit("$"), plain), plain]
    shapes += [F.translate(shown(d), ",", "") for d in range(decimals, -1, -1)]
    text = F.when(c.isNull(), F.lit("."))
    for shape in shapes:
        text = text.when(F.length(shape) <= width, shape)
    return F.lpad(text.otherwise(F.lit("*" * width)), width, " ")


def datetime_text(ts, width: int = 20) -> Column:
    """``ddMONyyyy:hh:mm:ss`` right-aligned to ``width``; missing shows as a period."""
    text = F.upper(F.date_format(_col(ts), "ddMMMyyyy:HH:mm:ss"))
    return F.lpad(F.coalesce(text, F.lit(".")), width, " ")


def datetime_iso(ts) -> Column:
    """ISO text; microseconds appear only when they are not zero."""
    ts = _col(ts)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))


def missing_all(fields: list[T.StructField]) -> list[Column]:
    """One typed missing value per field."""
    return [F.lit(None).cast(f.dataType).alias(f.name) for f in fields]


def json_field(c, field: str, default: str | None = None) -> Column:
    """One field of a JSON text; a bad document or an absent field gives the default."""
    value = F.get_json_object(_col(c), f"$.{field}")
    return value if default is None else F.coalesce(value, F.lit(default))


def text_head(c, n: int = 2000) -> Column:
    """The first ``n`` characters, for a bounded preview next to the whole text."""
    return F.substring(_col(c), 1, n)


def path_stem(c) -> Column:
    """Last path segment without its suffix."""
    return F.regexp_extract(_col(c), r"([^/]+?)(\.[^./]*)?$", 1)


def path_extension(c) -> Column:
    """Suffix with its dot, or ''."""
    return F.regexp_extract(_col(c), r"[^/](\.[^./]*)$", 1)


def path_segment_after(c, marker: str) -> Column:
    """The path segment that follows the first segment ``marker``, or ''."""
    return F.regexp_extract(_col(c), rf"(?:^|/){marker}/([^/]+)", 1)


def coalesce_zero(c) -> Column:
    return F.coalesce(_col(c), F.lit(0))
