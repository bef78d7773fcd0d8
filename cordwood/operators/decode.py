"""Strict decoding of JSON events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordwood.functions.strict_json import NO_FIELDS, fields_of, kind, replace_lone_surrogates, text_of, with_fields
from cordwood.functions.times import parse_rfc3339
from cordwood.schemas import EVENT_FIELDS

_TEXTS = ("id", "service", "level", "message")
_NAMES = ", ".join(f"'{name}'" for name in EVENT_FIELDS)


def event_fields(value: str) -> str:
    """Fields of an object VARIANT; a JSON null counts as an object without fields."""
    return f"coalesce({fields_of(value)}, if(is_variant_null({value}), {NO_FIELDS}, NULL))"


def open_fields(fields: str) -> str:
    """First half of decoding: what the second half refers to more than once."""
    kinds = ", ".join(f"{kind(f'{fields}.{name}')} AS {name}_kind" for name in EVENT_FIELDS)
    moment = f"{fields}.`timestamp`"
    return f"""struct({fields} AS fields, {kinds},
 {fields_of(f'{fields}.attributes')} AS attributes,
 {fields_of(f'{fields}.source')} AS source,
 if({kind(moment)} = 'STRING', {parse_rfc3339(text_of(moment))}, NULL) AS moment)"""


def decode_fields(opened: str) -> str:
    """``struct(ok, <event fields>)`` from :func:`open_fields`.

    ``ok`` is false for an unknown field name or a value of the wrong JSON
    type; an absent field and a JSON null both leave the field empty. Field
    names must match in case.
    """
    o = opened
    texts_fit = " AND ".join(f"{o}.{name}_kind IN ('STRING', 'VOID')" for name in _TEXTS)
    texts = ", ".join(
        f"if({o}.{name}_kind = 'STRING', {text_of(f'{o}.fields.{name}')}, '') AS {name}"
        for name in _TEXTS
    )
    return f"""struct(
 coalesce(size(array_except(map_keys({o}.fields), array({_NAMES}))) = 0
  AND {o}.schema_version_kind IN ('BIGINT', 'VOID') AND {texts_fit}
  AND ({o}.timestamp_kind = 'VOID' OR {o}.moment IS NOT NULL)
  AND ({o}.attributes_kind = 'VOID' OR {o}.attributes IS NOT NULL)
  AND ({o}.source_kind = 'VOID' OR {o}.source IS NOT NULL)
  AND coalesce(forall(map_values({o}.source), v -> {kind('v')} IN ('STRING', 'VOID')), true),
  false) AS ok,
 coalesce(try_variant_get({o}.fields.schema_version, '$', 'long'), 0L) AS schema_version,
 {texts},
 {o}.moment AS `timestamp`,
 if({o}.attributes IS NULL, NULL, {o}.fields.attributes) AS attributes,
 transform_values({o}.source, (k, v) -> coalesce({text_of('v')}, '')) AS source)"""


def decode_strict(records: DataFrame, value: str = "value") -> DataFrame:
    """Add ``event`` (struct) and ``decode_ok`` to records with a JSON payload."""
    text = replace_lone_surrogates(f"make_valid_utf8(cast(`{value}` AS string))")
    opened = with_fields(records, "_fields", text, NO_FIELDS)
    opened = opened.withColumn("_opened", F.expr(open_fields("_fields")))
    decoded = opened.withColumn("_decoded", F.expr(decode_fields("_opened")))
    event = ", ".join(f"_decoded.`{name}`" for name in EVENT_FIELDS)
    return decoded.select(
        *records.columns,
        F.expr(f"struct({event})").alias("event"),
        F.expr("_decoded.ok AND _fields IS NOT NULL").alias("decode_ok"),
    )
