"""Text-to-value parsers as Column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts that stand for "no value" in the landed files.
UNTRADED_CLOSE = ("", "--", "---")
CODE_PATTERN = r"^\d{4,6}[A-Z]?$"
ROC_YEAR_OFFSET = 1911

_FINITE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _finite_double(text: Column) -> Column:
    """The text is read once: what is no number extracts as the empty text, which is not cast (a failed cast costs more than
    the rest), and infinity times 0 is no number."""
    value = F.nullif(F.regexp_extract(text, _FINITE, 0), F.lit("")).try_cast("double")
    return value + F.nanvl(value * F.lit(0.0), F.lit(None).cast("double"))


def parse_num(x: Column) -> Column:
    """Number with thousands commas; anything that is not a finite number is NULL."""
    return _finite_double(F.trim(F.translate(x.cast("string"), ",", "")))


def parse_bigint(x: Column) -> Column:
    """``parse_num`` rounded half-even to a whole number."""
    return F.rint(parse_num(x)).try_cast("bigint")


def to_num(x: Column) -> Column:
    """Like ``parse_num`` but also ignores quotes and the no-trade marks."""
    return _finite_double(F.trim(F.translate(x.cast("string"), ',"', "")))


def _date_of(year: Column, month: Column, day: Column) -> Column:
    parts = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_date(parts, "yyyy-MM-dd")


def _roc_year(text: Column) -> Column:
    return (text.try_cast("int") + F.lit(ROC_YEAR_OFFSET)).cast("string")


def iso_date(x: Column) -> Column:
    """First ten characters as a date, ``/`` or ``-`` separated, zero-padded."""
    head = F.regexp_replace(F.substring(F.trim(x.cast("string")), 1, 10), "/", "-")
    return F.when(head.rlike(r"^.{4}-.{5}$"), F.try_to_date(head, "yyyy-MM-dd"))


def roc_date(x: Column) -> Column:
    """``112/03/16`` (Republic-of-China year) to a date, else NULL."""
    text = F.trim(F.regexp_replace(x.cast("string"), '"', ""))
    shape = r"^(\d{2,3})/(\d{1,2})/(\d{1,2})$"
    parts = [F.regexp_extract(text, shape, i) for i in (1, 2, 3)]
    return F.when(text.rlike(shape), _date_of(_roc_year(parts[0]), parts[1], parts[2]))


def roc_month(x: Column) -> Column:
    """``11506`` (or the six-digit ``115006``) to the first day of that month."""
    text = F.trim(x.cast("string"))
    month = F.when(F.length(text) == 5, F.substring(text, 4, 2)).otherwise(F.substring(text, 5, 2))
    return F.when(text.rlike(r"^\d{5,6}$"), _date_of(_roc_year(F.substring(text, 1, 3)), month, F.lit("01")))


def ymd_date(x: Column) -> Column:
    """Eight digits ``yyyyMMdd`` to a date."""
    text = F.trim(x.cast("string"))
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def any_date(x: Column) -> Column:
    """Seven-digit ROC, eight-digit, dashed or slashed date."""
    text = F.regexp_replace(F.trim(x.cast("string")), "/", "-")
    compact_roc = _date_of(_roc_year(F.substring(text, 1, 3)), F.substring(text, 4, 2), F.substring(text, 6, 2))
    return (
        F.when(text.rlike(r"^\d{7}$"), compact_roc)
        .when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))
        .otherwise(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    )


def clean_code(x: Column) -> Column:
    """Security code without the spreadsheet ``="..."`` wrapping."""
    text = F.trim(x.cast("string"))
    bare = F.trim(F.regexp_replace(text, r"^=+", ""))
    wrapped = F.contains(text, F.lit("=")) | F.contains(text, F.lit('"'))
    return F.when(wrapped, F.trim(F.regexp_replace(bare, r'^"+|"+$', ""))).otherwise(text)


def is_security_code(x: Column) -> Column:
    """Four to six digits with an optional capital letter, after cleaning."""
    return clean_code(x).rlike(CODE_PATTERN)


def traded(close: Column) -> Column:
    """False for the marks that say a security did not trade that day."""
    return ~F.trim(close).isin(*UNTRADED_CLOSE)


def to_lots(x: Column) -> Column:
    """Shares to thousands as text: whole numbers plain, else up to three decimals."""
    text = F.trim(F.regexp_replace(x, ",", ""))
    scaled = F.round(text.try_cast("decimal(30,6)") / F.lit(1000).cast("decimal(10,0)"), 3)
    plain = F.regexp_replace(F.regexp_replace(scaled.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("0")).otherwise(plain)


def signed_change(sign: Column, magnitude: Column) -> Column:
    """Price change with its sign cell prefixed only if that is ``+`` or ``-``."""
    mark = F.trim(sign)
    return F.when(mark.isin("+", "-"), F.concat(mark, F.trim(magnitude))).otherwise(F.trim(magnitude))


def strip_tags(x: Column) -> Column:
    """Remove markup tags."""
    return F.regexp_replace(x, r"<[^>]+>", "")


def parse_rfc822(x: Column) -> Column:
    """Feed timestamps such as ``Tue, 07 Jul 2026 08:00:00 GMT``; no zone means UTC."""
    text = F.regexp_replace(F.trim(x), r"^[A-Za-z]{3},\s*", "")
    shapes = ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(shape)) for shape in shapes])


_CSV_CELL = r',((?:[^,"]++|"[^"]*+"|")*+)'
# A line of quoted cells only, with no quote inside them; a last comma opens an empty cell.
_ALL_QUOTED = r'^"[^"\r\n\u0085\u2028\u2029]*+"(?:,"[^"\r\n\u0085\u2028\u2029]*+")*+,?+\z'


def csv_cells(line: Column) -> Column:
    """One CSV line to its cells: commas inside quotes kept, quotes removed.

    A cell is a run of plain characters and quoted strings; an unpaired quote stands for itself. The patterns never
    go back, so the work grows with the line. Lines in which all cells are quoted, or none is, are split where their
    cells meet; only others are taken apart cell by cell.
    """
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CSV_CELL), 1)
    open_end = F.endswith(line, F.lit(","))
    inside = F.substring(line, F.lit(2), F.length(line) - F.when(open_end, 3).otherwise(2))
    quoted = F.split(inside, '","')
    return (
        F.when(~F.contains(line, F.lit('"')), F.split(line, ","))
        .when(line.rlike(_ALL_QUOTED), F.when(open_end, F.concat(quoted, F.array(F.lit("")))).otherwise(quoted))
        .otherwise(F.transform(raw, _unquoted)))


def first_csv_cell(line: Column) -> Column:
    """The first of ``csv_cells``; the rest of the line is not looked at."""
    return _unquoted(F.regexp_extract(F.concat(F.lit(","), line), _CSV_CELL, 1))


def _unquoted(c: Column) -> Column:
    bare = F.trim(c)
    inside = F.when(F.endswith(bare, F.lit('"')), F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(F.regexp_replace(bare, r'^"|"$', ""))
    quoted = F.startswith(bare, F.lit('"')) & bare.rlike(r'^".*"$')
    return F.when(quoted, F.replace(inside, F.lit('""'), F.lit('"'))).otherwise(c)


def first_of(*columns: Column) -> Column:
    """First value that is present."""
    return F.coalesce(*columns)


TABLE_PAYLOAD = "struct<tables:array<struct<data:array<array<string>>>>, data:array<array<string>>>"


def payload_rows(json_text: Column) -> Column:
    """Rows of ``tables[0].data`` (or of a top-level ``data``) as an array of string arrays."""
    return table_rows(F.from_json(json_text, TABLE_PAYLOAD))


def table_rows(parsed: Column) -> Column:
    """``payload_rows`` of a payload that is parsed already, as a column that can be looked at several times."""
    first_table = F.get(parsed["tables"], F.lit(0))["data"]
    return F.coalesce(F.when(F.size(parsed["tables"]) > 0, first_table), parsed["data"])

