"""Fields of semi-structured rows (VARIANT), salaries and times as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelode.functions.text import let, or_null


def get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def known(v: Column) -> Column:
    """Whether a value says something: not null, false, zero, or an empty string, array or object."""
    return v.isNotNull() & ~F.coalesce(F.to_json(v), F.lit("null")).isin("null", '""', "0", "0.0", "-0.0", "false", "[]", "{}")


def pick(v: Column, *keys: str) -> Column:
    """The first known of some fields, as VARIANT; a key may name a path."""
    each = [get(v, f"$.{k}" if k[0] != "[" else f"${k}") for k in keys]
    return F.get(F.filter(F.array(*each), lambda x: known(x)), F.lit(0))


def text(v: Column) -> Column:
    """The value if it's a string."""
    return get(F.get(F.filter(F.array(v), lambda x: kind_of(x) == "STRING"), F.lit(0)), "$", "string")


def anything(v: Column) -> Column:
    """The value as a string: strings as they are, others as their JSON."""
    return let(v, lambda x: F.when(kind_of(x) == "STRING", get(x, "$", "string")).otherwise(F.to_json(x)))


def text_or_null(*values: Column) -> Column:
    """Whether each value is a string or null: others break a row."""
    out = F.lit(True)
    for v in values:
        out = out & (v.isNull() | F.coalesce(kind_of(v).isin("STRING", "VOID"), F.lit(True)))
    return out


def is_object(v: Column) -> Column:
    return F.coalesce(kind_of(v).startswith("OBJECT"), F.lit(False))


def items(v: Column, *paths: str) -> Column:
    """The first known array of VARIANT among some paths."""
    return F.coalesce(*(get(v, p, "array<variant>") for p in paths))


def number(v: Column, path: str) -> Column:
    return get(v, path, "double")


def _thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def pay_range(currency: Column, low: Column, high: Column, interval: Column | None = None) -> Column:
    """`CUR a - b`, `CUR a+` or `CUR up to b`, and the interval; null without either bound."""
    span = F.when(low.isNotNull() & high.isNotNull(), F.concat(_thousands(low), F.lit(" - "), _thousands(high)))
    span = F.coalesce(span, F.concat(_thousands(low), F.lit("+")), F.concat(F.lit("up to "), _thousands(high)))

    def joined(known_span: Column) -> Column:
        parts = [or_null(currency), known_span] + ([or_null(interval)] if interval is not None else [])
        return F.when(known_span.isNotNull(), F.concat_ws(" ", *parts))

    return let(span, joined)


def base_salary(v: Column) -> Column:
    """A structured-data salary as `$a–$b/unit`, `$a/unit` or `$a`; currencies but USD are named."""
    return let(v, _base_salary)


def _base_salary(v: Column) -> Column:
    currency = F.coalesce(get(v, "$.currency", "string"), F.lit(""))
    sign = F.when(currency == "USD", "$").when(currency == "", "").otherwise(F.concat(currency, F.lit(" ")))
    unit = F.lower(F.coalesce(get(v, "$.value.unitText", "string"), F.lit("")))
    unit = F.when(unit == "", "").otherwise(F.concat(F.lit("/"), unit))
    low, high, one = number(v, "$.value.minValue"), number(v, "$.value.maxValue"), number(v, "$.value.value")
    plain = F.when(~is_object(get(v, "$.value")) & (kind_of(get(v, "$.value")) != "STRING"), number(v, "$.value"))
    ranged = F.concat(sign, _thousands(low), F.lit("–"), sign, _thousands(high), unit)
    return F.when(is_object(v), F.coalesce(F.concat(sign, _thousands(plain)), ranged, F.concat(sign, _thousands(one), unit)))


def schema_salary(currency: Column, low: Column, high: Column) -> Column:
    """`CUR a–b` or `CUR a+` of an extraction schema's numbers; the currency is USD by default."""
    cur = F.coalesce(or_null(currency), F.lit("USD"))
    return F.coalesce(F.concat(cur, F.lit(" "), _thousands(low), F.lit("–"), _thousands(high)), F.concat(cur, F.lit(" "), _thousands(low), F.lit("+")))


def iso_time(c: Column) -> Column:
    """A timestamp of ISO text that begins with a whole date, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_timestamp(c))


def millis_time(v: Column) -> Column:
    """A timestamp of a number of milliseconds, else null."""
    return F.when(kind_of(v).isin("BIGINT", "DOUBLE", "DECIMAL") | kind_of(v).startswith("DECIMAL"), F.timestamp_millis(get(v, "$", "long")))


def odata_time(c: Column) -> Column:
    """A timestamp of /Date(ms)/, with or without an offset, or of ISO text."""
    ms = or_null(F.regexp_extract(c, r"^/Date\((\d+)(?:[+-]\d+)?\)/", 1)).try_cast("long")
    return F.coalesce(F.timestamp_millis(ms), iso_time(c))


def remote_location(primary: Column, remote: Column) -> Column:
    """The place, marked as remote unless it says so itself."""
    return let(or_null(primary), lambda named: _remote(named, remote))


def _remote(named: Column, remote: Column) -> Column:
    return F.when(remote & named.isNull(), "Remote").when(remote & ~F.lower(named).contains("remote"), F.concat(named, F.lit(" (Remote)"))).otherwise(named)


def leaf_department(departments: Column) -> Column:
    """The name of the first department without children, else of the first one with a name."""
    return let(F.filter(departments, lambda d: get(d, "$.name").isNotNull()), _leaf)


def _leaf(named: Column) -> Column:
    leaf = F.filter(named, lambda d: ~known(get(d, "$.child_ids")))
    return F.coalesce(anything(get(F.get(leaf, F.lit(0)), "$.name")), anything(get(F.get(named, F.lit(0)), "$.name")))
