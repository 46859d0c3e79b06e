"""Column builders over JSON as VARIANT, for inputs whose shape isn't known."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# White space around a JSON text, and what closes the array that it is parsed in.
SPACE = " \t\r\n\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_END = "end of the line"


def allow_repeated_keys(spark: SparkSession) -> None:
    """Of a key that repeats in an object the last value counts, from now on in this session."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def parsed_line(text: Column) -> Column:
    """A JSON text as VARIANT; null unless it is exactly one value.

    The parser stops after a whole value, so the text is put into an array
    before a closing mark, and must be all that stands before it.
    """
    whole = F.try_parse_json(F.concat(F.lit("["), F.btrim(text, F.lit(SPACE)), F.lit(f', "{_END}"]')))
    # The parts of an array are copies, so they are made once.
    return let(F.try_variant_get(whole, "$", "array<variant>"), lambda x: F.when((F.size(x) == 2) & (F.try_variant_get(F.get(x, F.lit(1)), "$", "string") == _END), F.get(x, F.lit(0))))


def part(value: Column, path: str) -> Column:
    """What stands at a path, null if nothing does."""
    return F.try_variant_get(value, path, "variant")


def parts(value: Column, path: str) -> Column:
    """The items of an array at a path, null if there is none."""
    return F.try_variant_get(value, path, "array<variant>")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once: a lambda's variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_object(value: Column) -> Column:
    """Whether a value is a JSON object; unlike its schema, this doesn't look at what it holds."""
    return F.try_variant_get(value, "$", "struct<name:variant>").isNotNull()


def fields(value: Column, *names: str) -> Column:
    """A struct of an object's fields, null for anything else."""
    return F.try_variant_get(value, "$", f"struct<{','.join(f'{n}:variant' for n in names)}>")


def string(value: Column) -> Column:
    """The text of a JSON string; null for anything else, numbers included."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
