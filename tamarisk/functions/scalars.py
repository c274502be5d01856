"""Scalar expressions: similarity, templates, fallbacks, formats, identifiers and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, in code points; 1 for two empty strings, null if either is null."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(a.isNull() | b.isNull(), None).when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def fill_template(template: str, **values: Column) -> Column:
    """A template with {name} places, filled with columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value)
    return out


def citation_label(source: Column, page: Column) -> Column:
    """`source (p.N)` with pages from 1, or the bare source without a page."""
    return F.when(page.isNotNull(), F.format_string("%s (p.%d)", source, page + 1)).otherwise(source)


def falsy_or(value: Column, default: Column) -> Column:
    """The value unless it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), default)


def is_filled(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def percent(x: Column) -> Column:
    return F.format_string("%.0f%%", x.cast("double") * 100)


def two_decimals(x: Column) -> Column:
    return F.format_number(x, 2)


def display_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM/dd HH:mm")


def minutes_before(now: Column, minutes: Column) -> Column:
    """Null minutes give null."""
    return now - F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def new_inquiry_id() -> Column:
    """inq_ and 12 hexadecimal digits; another for every row and run."""
    return F.concat(F.lit("inq_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12))


def new_thread_id() -> Column:
    """32 hexadecimal digits; another for every row and run."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def now_utc() -> Column:
    return F.current_timestamp()


def json_record(*columns: str, nulls: bool = True) -> Column:
    """The columns of a row as a JSON object; nulls are written unless left out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": str(not nulls).lower()})


def unescaped(text: Column) -> Column:
    """Text with the escapes of a JSON string read; what isn't one stays as it is."""
    return F.coalesce(F.from_json(F.concat(F.lit('["'), text, F.lit('"]')), "array<string>")[0], text)


def document_key(*columns: str) -> Column:
    """A key of a document with its metadata: equal exactly where all columns are."""
    return F.sha2(json_record(*columns), 256)


def random_integer(low: int, high: int, seed: int | None = None) -> Column:
    """Uniform, both ends included."""
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("int")


def first_name_of_requirement(spec: Column) -> Column:
    """The package name before any version condition."""
    return F.split(spec, r"[\s<>=!~]+")[0]


def split_list(text: Column) -> Column:
    """Comma-separated values, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def integer_or(text: Column, default: int) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(default))


def characters(text: Column) -> Column:
    """Code points of a string, in order."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def prefixed(prefix: str, path: Column) -> Column:
    return F.concat(F.lit(prefix), path)


def light_state(on: Column) -> Column:
    return F.when(on, "on").otherwise("off")


def current_weather(location: Column, unit: str = "celsius") -> Column:
    """A constant answer, as a tool would give it."""
    return F.struct(location.alias("location"), F.lit("25").alias("temperature"), F.lit(unit).alias("unit"))


def label_lookup(value: Column, labels: dict[str, str]) -> Column:
    """The display label of a code; null for others."""
    return F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[value]
