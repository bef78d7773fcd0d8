"""Strict JSON on top of Spark's lenient readers.

The helpers that take and give SQL text are for the inside of larger
expressions: one text is parsed at once, where a hundred column calls would
take longer than a small query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordwood.session import require_settings

_STRICT = "map('allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false')"

# Fields of the JSON object without any.
NO_FIELDS = "from_json('{}', 'map<string,variant>')"


def fields_of(value: str) -> str:
    """Top-level fields of an object VARIANT as ``map<string,variant>``, else NULL."""
    return f"try_variant_get({value}, '$', 'map<string,variant>')"


def kind(value: str) -> str:
    """``STRING``, ``BIGINT``, ``VOID`` …; ``VOID`` too when the field is absent."""
    return f"coalesce(schema_of_variant({value}), 'VOID')"


def text_of(value: str) -> str:
    """A scalar VARIANT as text. Turns 42 into ``'42'``, so look at its kind first."""
    return f"try_variant_get({value}, '$', 'string')"


# An escape that is half of a surrogate pair whose other half is missing. It is looked for
# where escaped backslashes are masked by a character that no JSON text holds, so that none
# of them is read as the beginning of an escape.
_HIGH, _LOW = r"\\u[dD][89abAB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"
_LONE = rf"{_HIGH}(?!{_LOW})|(?<!{_HIGH}){_LOW}"


def _may_hold_surrogates(text: str) -> str:
    # The u of an escape is lower case.
    return rf"(contains({text}, '\\ud') OR contains({text}, '\\uD')) AND NOT contains({text}, char(1))"


def replace_lone_surrogates(text: str) -> str:
    """SQL: half surrogate escapes of a JSON text as U+FFFD."""
    masked = rf"regexp_replace(replace({text}, r'\\', char(1)), r'{_LONE}', r'\\ufffd')"
    return rf"if({_may_hold_surrogates(text)}, replace({masked}, char(1), r'\\'), {text})"


def without_lone_surrogates(text: str) -> str:
    """SQL: the JSON text, or NULL if it has half a surrogate pair."""
    return rf"if({_may_hold_surrogates(text)} AND replace({text}, r'\\', char(1)) RLIKE r'{_LONE}', NULL, {text})"


def with_fields(df: DataFrame, name: str, text: str, null_fields: str = "NULL") -> DataFrame:
    """Add the fields of a text that is exactly one JSON object, else NULL.

    Raises where the session doesn't let the last of repeated keys win.

    ``text`` is SQL. The fields come as ``map<string,variant>``; a repeated key
    keeps its last value. A JSON ``null`` gives ``null_fields``.

    Spark stops reading after the first value. Inside brackets a second value
    is either a syntax error or a second element. The one way left to smuggle
    text in is to close the bracket early (``{}],[``); only texts where a
    bracket follows an object or a null can do that, and those are read once
    more inside braces, where that bracket is a syntax error.

    Text and parse are columns of their own, so each is computed once.
    """
    require_settings(df.sparkSession)
    parsed = f"""from_json(concat('[', _json_text, ']'), 'array<map<string,variant>>', {_STRICT})"""
    fields = f"""CASE
 WHEN coalesce(size(_json_parsed), 0) <> 1 THEN NULL
 WHEN _json_text RLIKE r'[}}l]\\s*\\]'
  AND try_parse_json(concat('{{"v":', _json_text, '}}')) IS NULL THEN NULL
 WHEN _json_parsed[0] IS NULL THEN {null_fields}
 WHEN size(array_distinct(map_keys(_json_parsed[0]))) < size(_json_parsed[0])
  THEN {fields_of('try_parse_json(_json_text)')}
 ELSE _json_parsed[0] END"""
    return (
        df.withColumn("_json_text", F.expr(text))
        .withColumn("_json_parsed", F.expr(parsed))
        .withColumn(name, F.expr(fields))
        .drop("_json_text", "_json_parsed")
    )
