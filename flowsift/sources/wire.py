"""JSON messages of feature rows: key and value columns, defaults, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.functions.bind import bind
from flowsift.schema import FLOW_COLUMNS, FLOW_SCHEMA, FLOW_TYPES, RESULT_COLUMNS, WIRE_DEFAULTS

REQUIRED = [c for c in FLOW_COLUMNS if c not in WIRE_DEFAULTS]
RAW_CHARS = 200


def encode(rows: DataFrame, columns: list[str] = FLOW_COLUMNS) -> DataFrame:
    """(key, value): UTF-8 of the source address, JSON of the row with nulls written out."""
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return rows.select(F.col("src_ip").cast("binary").alias("key"), body.cast("binary").alias("value"))


def encode_results(results: DataFrame) -> DataFrame:
    return encode(results, RESULT_COLUMNS)


def decode(messages: DataFrame) -> DataFrame:
    """One row per message: `row` (the parsed struct) or `error_class`, never both.

    Error classes: unicode_decode, json_decode, schema_mismatch.
    """
    raw = F.col("value").cast("binary")
    body = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    # each message is parsed once for its field names and once for its values
    parsed = F.struct(
        body.alias("body"),
        F.from_json(body, "map<string,string>").alias("fields"),
        F.from_json(body, FLOW_SCHEMA).alias("row"),
    )
    judged = bind(parsed, _judge)
    return messages.select("*", judged.alias("_d")).select(
        *messages.columns, F.col("_d.error_class").alias("error_class"), F.col("_d.row").alias("row")
    )


def _judge(message: Column) -> Column:
    fields, parsed = message["fields"], message["row"]
    names = F.map_keys(fields)

    def value(name: str) -> Column:
        default = WIRE_DEFAULTS.get(name)
        if default is None:
            return parsed[name]
        # a field that is there but null stays null
        absent = ~F.array_contains(names, F.lit(name))
        return F.coalesce(parsed[name], F.when(absent, F.lit(default).cast(FLOW_TYPES[name])))

    # a message that lacks required fields or holds a value of another type does not fit
    lacking = F.size(F.array_except(F.array(*[F.lit(c) for c in REQUIRED]), names)) > 0
    empty = F.array(*[F.when(parsed[c].isNull(), F.lit(c)) for c in FLOW_COLUMNS])
    filled = F.map_keys(F.map_filter(fields, lambda _, v: v.isNotNull()))
    mistyped = F.size(F.array_intersect(F.filter(empty, lambda c: c.isNotNull()), filled)) > 0
    error = (
        F.when(message["body"].isNull(), "unicode_decode")
        .when(fields.isNull(), "json_decode")
        .when(lacking | mistyped, "schema_mismatch")
    )
    row = F.struct(*[value(c).alias(c) for c in FLOW_COLUMNS])
    return bind(error, lambda e: F.struct(e.alias("error_class"), F.when(e.isNull(), row).alias("row")))


def good_rows(decoded: DataFrame) -> DataFrame:
    return decoded.filter("error_class is null").select("row.*")


def dead_letters(decoded: DataFrame) -> DataFrame:
    """Rejected messages: whole binary key and value, offset when there is one, and a preview `raw`."""
    offset = F.col("offset") if "offset" in decoded.columns else F.lit(None).cast("bigint")
    raw = F.substring(F.make_valid_utf8(F.col("value").cast("string")), 1, RAW_CHARS)
    return decoded.filter("error_class is not null").select(
        "error_class", offset.alias("offset"), F.col("key").cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"), raw.alias("raw"),
    )
