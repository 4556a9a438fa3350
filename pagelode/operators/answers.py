"""Model answers held to a schema of any shape: nested structs, arrays, choices and ranges, as one expression compiled from a StructType.

A field that isn't nullable is required. Its metadata may hold `enum` (the texts that it may have), `minimum` and `maximum` (of numbers, or of the
sizes of arrays), and `pattern` (of texts). An answer is an object, an array of objects, or an envelope with `items`; with or without fences.

Defined cases: an answer that is null or no JSON breaks the schema at "$"; so does one that is neither object nor array. A null value is an absent
one. Numbers, booleans and times may stand in texts, as models write them, but a text is no number; a fraction is no whole number; times are ISO.
Fields that the schema doesn't name are ignored. The first violation is in the order of items, then of fields, from the outside in. All
or nothing: an answer with a violation has no rows; an empty array has none and breaks nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType, TimestampType

from pagelode.functions.text import let, without_fences
from pagelode.functions.values import get, iso_time, kind_of, text

_WHOLE = (ByteType, ShortType, IntegerType, LongType)
_NUMBER = (*_WHOLE, FloatType, DoubleType, DecimalType)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(kind_of(value).startswith(kind), F.lit(False))


def _absent(value: Column) -> Column:
    return F.coalesce(kind_of(value) == "VOID", F.lit(True))


def _scalar(value: Column, kind: DataType) -> Column:
    """The value as its type, null if it can't be."""
    if isinstance(kind, StringType):
        return text(value)
    plain = F.when(~_is(value, "OBJECT") & ~_is(value, "ARRAY"), get(value, "$", "string"))
    if isinstance(kind, TimestampType):
        return iso_time(plain)
    if isinstance(kind, DateType):
        return F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}$"), plain.try_cast("date"))
    if isinstance(kind, BooleanType):
        return F.when(F.lower(plain).isin("true", "false"), F.lower(plain) == "true")
    if isinstance(kind, _NUMBER):
        number = F.when(plain.rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"), F.trim(plain).try_cast("double" if not isinstance(kind, DecimalType) else kind))
        if isinstance(kind, _WHOLE):
            number = F.when(number == F.floor(number.cast("double")), F.coalesce(F.trim(plain).try_cast(kind), number.try_cast(kind)))
        return number.try_cast(kind)
    raise ValueError(f"no answer has values of {kind.simpleString()}")


def _first(violations: list[Column]) -> Column:
    return F.coalesce(*violations) if violations else F.lit(None).cast("string")


def _at(path: Column, name: str) -> Column:
    return F.concat(path, F.lit(f".{name}"))


def violation(value: Column, kind: DataType, path: Column, rules: dict | None = None) -> Column:
    """The path of the first place in a value (VARIANT) that breaks its type, or null; the value is there."""
    rules = rules or {}
    if isinstance(kind, StructType):
        def field(f: StructField) -> Column:
            inner = lambda v: F.when(
                _absent(v), F.lit(None).cast("string") if f.nullable else _at(path, f.name)
            ).otherwise(violation(v, f.dataType, _at(path, f.name), f.metadata))
            return let(get(value, f"$['{f.name}']"), inner)

        return F.when(~_is(value, "OBJECT"), path).otherwise(_first([field(f) for f in kind.fields]))
    if isinstance(kind, ArrayType):
        def element(v: Column, i: Column) -> Column:
            here = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
            return F.when(_absent(v), F.lit(None).cast("string") if kind.containsNull else here).otherwise(violation(v, kind.elementType, here))

        listed = get(value, "$", "array<variant>")
        size = F.size(listed)
        wrong = F.lit(False)
        if "minimum" in rules:
            wrong = wrong | (size < rules["minimum"])
        if "maximum" in rules:
            wrong = wrong | (size > rules["maximum"])
        return F.when(~_is(value, "ARRAY") | wrong, path).otherwise(F.get(F.array_compact(F.transform(listed, element)), F.lit(0)))
    read = _scalar(value, kind)
    wrong = read.isNull()
    if "enum" in rules:
        wrong = wrong | ~read.isin(list(rules["enum"]))
    if "pattern" in rules:
        wrong = wrong | ~read.rlike(rules["pattern"])
    if "minimum" in rules:
        wrong = wrong | (read < rules["minimum"])
    if "maximum" in rules:
        wrong = wrong | (read > rules["maximum"])
    return F.when(F.coalesce(wrong, F.lit(True)), path)


def nullable(kind: DataType) -> DataType:
    """The type with all of its parts nullable, as rows have it."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, nullable(f.dataType), True, f.metadata) for f in kind.fields])
    return ArrayType(nullable(kind.elementType)) if isinstance(kind, ArrayType) else kind


def value_of(value: Column, kind: DataType) -> Column:
    """A value that breaks nothing, as its type; absent parts are null."""
    if isinstance(kind, StructType):
        return F.struct(*(let(get(value, f"$['{f.name}']"), lambda v, f=f: F.when(~_absent(v), value_of(v, f.dataType)).cast(nullable(f.dataType))).alias(f.name) for f in kind.fields))
    if isinstance(kind, ArrayType):
        return F.transform(get(value, "$", "array<variant>"), lambda v: F.when(~_absent(v), value_of(v, kind.elementType)).cast(nullable(kind.elementType)))
    return _scalar(value, kind)


def items_of(answer: Column) -> Column:
    """The items of an answer as an array of VARIANT: those of its envelope or array, or the one object itself; null if it is neither."""
    def listed(v: Column) -> Column:
        one = F.when(_is(v, "OBJECT"), F.coalesce(get(v, "$.items", "array<variant>"), F.array(v)))
        return F.when(_is(v, "ARRAY"), get(v, "$", "array<variant>")).otherwise(one)

    return let(F.try_parse_json(without_fences(answer)), listed)


def checked(answers: DataFrame, schema: StructType, answer: str = "answer") -> DataFrame:
    """answers with rows (array of the schema's structs; null where it's broken) and violation (path of the first break, or null)."""
    found = answers.withColumn("_items", items_of(F.col(answer)))
    path = lambda i: F.concat(F.lit("$["), i.cast("string"), F.lit("]"))
    first = F.get(F.array_compact(F.transform("_items", lambda v, i: F.when(_absent(v), path(i)).otherwise(violation(v, schema, path(i))))), F.lit(0))
    found = found.withColumn("violation", F.when(F.col("_items").isNull(), F.lit("$")).otherwise(first))
    rows = F.when(F.col("violation").isNull(), F.transform("_items", lambda v: value_of(v, schema)))
    return found.withColumn("rows", rows.cast(ArrayType(nullable(schema)))).drop("_items")
