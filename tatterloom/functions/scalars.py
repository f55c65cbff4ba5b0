"""Column functions on cells: classification, parsing, checks and slugs, all inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets of a cell's type, in the order that settles ties (fixed values).
BUCKETS = ("date", "integer", "float", "text", "empty")
DELIMITERS = (",", ";", "\t", "|")
#: Patterns of the cell types (fixed values).
DATE_IN = r"\b\d{1,4}[./-]\d{1,2}[./-]\d{1,4}\b"
INTEGER = r"^[+-]?\d+$"
FLOAT = r"^[+-]?(?:\d+\.\d+|\d+\.\d*|\d*\.\d+)$"
NUMBER = r"^[+-]?((\d+(_\d+)*)?\.?\d+(_\d+)*|\d+(_\d+)*\.)([eE][+-]?\d+)?$"
_BLANK = r"[\s\x1c-\x1f]"


def _ascii(v: Column) -> Column:
    return F.octet_length(v) == F.char_length(v)


def _either(v: Column, f: Callable[[str], Column]) -> Column:
    """f with ASCII character classes for ASCII cells, which are fast, and with Unicode ones for others."""
    return F.when(_ascii(v), f("")).otherwise(f("(?U)"))


def strip(v: Column) -> Column:
    """Without white space of any kind at both ends; cells that plainly have none cost one match."""
    return F.when(v.rlike("^[!-~]([ -~]*[!-~])?$"), v).otherwise(F.regexp_replace(v, f"(?U)^{_BLANK}+|{_BLANK}+$", ""))


def clean_cell(v: Column) -> Column:
    """strip(), then without double quotes, then without single quotes at the ends."""
    return F.regexp_replace(F.regexp_replace(strip(v), '^"+|"+$', ""), "^'+|'+$", "")


def classify(v: Column) -> Column:
    """A cell's bucket; a date anywhere in it makes it a date, so versions and addresses are dates too. Null is empty."""
    return kind_of(strip(v))


def kind_of(s: Column) -> Column:
    """classify() of a stripped cell."""
    kind = _either(
        s,
        lambda u: F.when(s.rlike(u + DATE_IN), "date").when(s.rlike(u + INTEGER), "integer").when(F.translate(s, ",", ".").rlike(u + FLOAT), "float").otherwise("text"),
    )
    return F.when(s.isNull() | (s == ""), "empty").otherwise(kind)


def to_number(v: Column) -> Column:
    """The cell as a double: spaces dropped, comma as decimal point; null if it isn't one."""
    s = F.translate(strip(v), ", ", ".")
    return F.when(s.rlike(NUMBER), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))


#: Date forms, tried in this order; with slashes the month comes first (fixed values).
DATES = ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"))


def to_iso_date(v: Column) -> Column:
    """yyyy-MM-dd of a cell in one of the known forms, else null."""
    s = strip(v)
    plain = F.when(s.rlike(r"^\d{4}-\d\d-\d\d$"), s.try_cast("date").cast("string"))
    return F.coalesce(plain, *[F.when(s.rlike(p), F.date_format(F.try_to_date(s, f), "yyyy-MM-dd")) for p, f in DATES], F.when(s.rlike(r"^\d{8}$"), F.date_format(F.try_to_date(s, "yyyyMMdd"), "yyyy-MM-dd")), F.when(s.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d(:\d\d(:\d\d(\.\d+)?)?)?$"), F.date_format(F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"), "yyyy-MM-dd")))


def count_of(v: Column, char: str) -> Column:
    return F.char_length(v) - F.char_length(F.replace(v, F.lit(char), F.lit("")))


def detect_delimiter(line: Column) -> Column:
    """The delimiter that occurs most; of equals, and where there is none, the first in their order."""
    n = [count_of(line, d) for d in DELIMITERS]
    most = F.greatest(*n)
    out = F.lit(DELIMITERS[-1])
    for d, k in reversed(list(zip(DELIMITERS[:-1], n[:-1], strict=True))):
        out = F.when(k == most, d).otherwise(out)
    return F.when(line.isNull() | (strip(line) == ""), ",").otherwise(out)


def split_line(line: Column, delimiter: Column | str) -> Column:
    """The cells of a line, trailing empty ones too; quotes mean nothing. A blank line has one cell."""
    d = F.lit(delimiter) if isinstance(delimiter, str) else delimiter
    return F.split(F.regexp_replace(line, r"[\r\n]+$", ""), F.concat(F.lit(r"\Q"), d, F.lit(r"\E")), -1)


def looks_numeric(v: Column) -> Column:
    return F.translate(strip(v), ",", ".").rlike(NUMBER) | F.lower(strip(v)).rlike(r"^[+-]?(nan|inf|infinity)$")


def looks_bool(v: Column) -> Column:
    return F.lower(strip(v)).isin("true", "false", "0", "1", "yes", "no")


def looks_date(v: Column) -> Column:
    return v.rlike("[-/.]")


def inferred_type(maybe_numeric: Column, maybe_date: Column, maybe_bool: Column, seen: Column) -> Column:
    """bool, decimal, date or string from what all samples may be."""
    return (
        F.when(~seen, "string").when(maybe_bool, "bool").when(maybe_numeric & ~maybe_date, "decimal").when(maybe_date & ~maybe_numeric, "date").otherwise("string")
    )


# Names


def compact_slug(v: Column) -> Column:
    """Lower case; only ASCII letters and digits."""
    return F.regexp_replace(F.lower(v), "[^a-z0-9]", "")


def synonym_key(v: Column) -> Column:
    return compact_slug(strip(v))


def snake_slug(v: Column) -> Column:
    """For schema columns: spaces become underscores, other signs go; `column` if nothing is left."""
    s = F.regexp_replace(F.translate(F.lower(strip(v)), " ", "_"), "[^a-z0-9_]", "")
    return F.when(s == "", "column").otherwise(s)


def unicode_slug(v: Column) -> Column:
    """For file and table names and contract columns: runs of what isn't a letter or digit become one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(v), r"(?U)[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def output_name(v: Column) -> Column:
    return F.concat(F.regexp_replace(F.lower(v), r"(?U)[^\p{L}\p{N}_-]", "_"), F.lit(".csv"))


def skeleton(slug: Column) -> Column:
    return F.translate(slug, " aeiouy", "")


def ngrams(v: Column, n: int = 3) -> Column:
    """Distinct n-grams; a string of at most n is its own."""
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(v) - (n - 1), F.lit(1))), lambda i: F.substring(v, i, F.lit(n)))
    return F.array_distinct(F.when(F.char_length(v) <= n, F.array(v)).otherwise(parts))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; 1 if both are empty, 0 if one is."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.when(both == 0, 1).otherwise(both))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / F.when(longest == 0, 1).otherwise(longest))


def similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The header score; a and b hold slug, grams and tokens."""
    return 0.5 * levenshtein_ratio(a["slug"], b["slug"]) + 0.3 * overlap(a["grams"], b["grams"]) + 0.2 * overlap(a["tokens"], b["tokens"])


# Checks against a contract


def is_int(v: Column) -> Column:
    return strip(v).rlike(r"^[+-]?\d+(_\d+)*$")


def is_float(v: Column) -> Column:
    s = strip(v)
    return s.rlike(NUMBER) | F.lower(s).rlike(r"^[+-]?(nan|inf|infinity)$")


def number_value(v: Column) -> Column:
    s = F.lower(strip(v))
    return F.when(s.rlike(r"^[+-]?nan$"), F.lit(float("nan"))).when(s.rlike(r"^[+]?inf(inity)?$"), F.lit(float("inf"))).when(s.rlike(r"^-inf(inity)?$"), F.lit(float("-inf"))).when(s.rlike(NUMBER), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))


def is_bool(v: Column) -> Column:
    return F.lower(strip(v)).isin("true", "false", "1", "0", "yes", "no")


def is_date(v: Column) -> Column:
    s = strip(v)
    return (s.rlike(r"^\d{4}-\d\d-\d\d$") & F.try_to_date(s, "yyyy-MM-dd").isNotNull()) | (s.rlike(r"^\d{8}$") & F.try_to_date(s, "yyyyMMdd").isNotNull())


def is_datetime(v: Column) -> Column:
    s = strip(v)
    return is_date(v) | (s.rlike(r"^\d{4}-\d\d-\d\d[T ]([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d(\.\d{1,6})?)?)?(Z|[+-]\d\d:?\d\d)?$") & F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd").isNotNull())


def is_json(v: Column) -> Column:
    s = strip(v)
    return F.try_parse_json(s).isNotNull() | s.isin("NaN", "Infinity", "-Infinity")
