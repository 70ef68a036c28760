"""Undecodable records, error categories, retry plans and dead-letter envelopes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

CORRUPT = "_corrupt_record"

# Client error names by category, and the retry limits.
SERIALIZATION_CODES = (
    "_VALUE_SERIALIZATION", "_KEY_SERIALIZATION", "_VALUE_DESERIALIZATION", "_KEY_DESERIALIZATION",
)
AUTHORIZATION_CODES = (
    "TOPIC_AUTHORIZATION_FAILED", "GROUP_AUTHORIZATION_FAILED", "CLUSTER_AUTHORIZATION_FAILED",
)
TIMEOUT_CODES = (
    "_TIMED_OUT", "_MSG_TIMED_OUT", "REQUEST_TIMED_OUT", "NOT_LEADER_FOR_PARTITION", "LEADER_NOT_AVAILABLE",
)
MAX_RETRIES = 3
BASE_BACKOFF_SECONDS = 1
MESSAGE_LIMIT = 1024


def decode_json(df: DataFrame, schema: T.StructType, value: str = "value", out: str = "decoded") -> DataFrame:
    """Parse JSON text to typed columns; text that does not fit is kept in the corrupt column.

    Fields that a registered schema gives a logical type are read by it: a time as the number of milli- or
    microseconds that is sent, a date as the number of days, either also as ISO text. A record is corrupt as well if
    such a value is neither, if a field without default that must not be null is, and if an enumeration has a foreign
    symbol. This holds for the fields of the record itself, not for those of records inside it.

    The one-element explode makes the parsed value a column of its own. Otherwise the optimizer merges
    the projections and parses the text again for every field that is read from it.
    """
    sent = [T.StructField(f.name, T.StringType() if "wire" in f.metadata else f.dataType) for f in schema.fields]
    wide = T.StructType([*sent, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = df.withColumn(out, F.explode(F.array(F.from_json(value, wide, options))))
    special = [f for f in schema.fields if f.metadata]
    if not any({"wire", "required", "symbols"} & f.metadata.keys() for f in special):
        return parsed
    whole = F.col(out)
    typed = {f.name: _from_wire(whole[f.name], f.metadata["wire"]) if "wire" in f.metadata else whole[f.name] for f in schema.fields}
    wrong = F.lit(False)
    for f in special:
        if f.metadata.get("required"):
            wrong = wrong | whole[f.name].isNull()
        if "symbols" in f.metadata:
            wrong = wrong | ~F.coalesce(whole[f.name].isin(f.metadata["symbols"]), F.lit(True))
        if "wire" in f.metadata:
            wrong = wrong | (whole[f.name].isNotNull() & typed[f.name].isNull())
    corrupt = F.coalesce(whole[CORRUPT], F.when(wrong, F.col(value).cast("string")))
    fields = [c.alias(n) for n, c in typed.items()]
    return parsed.withColumn(out, F.when(whole.isNotNull(), F.struct(*fields, corrupt.alias(CORRUPT))))


def _from_wire(text: Column, logical: str) -> Column:
    """The value of a logical type from its number or from ISO text; null if it is neither."""
    number = F.when(text.rlike(r"\A-?[0-9]{1,18}\z"), text).try_cast("bigint")
    if logical == "timestamp-millis":
        return F.coalesce(F.timestamp_millis(number), F.when(number.isNull(), text.try_cast("timestamp")))
    if logical == "timestamp-micros":
        return F.coalesce(F.timestamp_micros(number), F.when(number.isNull(), text.try_cast("timestamp")))
    if logical == "date":
        return F.coalesce(F.date_from_unix_date(number.try_cast("int")), F.when(number.isNull(), text.try_cast("date")))
    return text


def split_decodable(
    df: DataFrame, schema: T.StructType, value: str = "value", out: str = "decoded"
) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows by whether ``value`` decodes. Null values are tombstones and count as good."""
    tried = decode_json(df, schema, value, out)
    failed = F.col(value).isNotNull() & (F.col(out).isNull() | F.col(f"{out}.{CORRUPT}").isNotNull())
    good = tried.filter(~failed).withColumn(out, F.col(out).dropFields(CORRUPT))
    return good, tried.filter(failed).drop(out)


def classify_error(code: Column | str, message: Column | str) -> Column:
    """SERIALIZATION, AUTH_DENIED, BROKER_TIMEOUT, SCHEMA_INCOMPATIBLE or UNKNOWN; first match wins."""
    c = F.col(code) if isinstance(code, str) else code
    m = F.lower(F.col(message) if isinstance(message, str) else message)
    return (
        F.when(c.isin(*SERIALIZATION_CODES), "SERIALIZATION")
        .when(c.isin(*AUTHORIZATION_CODES), "AUTH_DENIED")
        .when(c.isin(*TIMEOUT_CODES), "BROKER_TIMEOUT")
        .when(m.contains("schema") & (m.contains("incompatible") | m.contains("compatibility")), "SCHEMA_INCOMPATIBLE")
        .otherwise("UNKNOWN")
    )


def plan_retry(code: Column | str, attempt: Column | str) -> Column:
    """Struct of ``action`` (``retry`` or ``dead_letter``) and ``backoff_s``, without jitter."""
    c = F.col(code) if isinstance(code, str) else code
    n = F.col(attempt) if isinstance(attempt, str) else attempt
    hopeless = F.coalesce(c.isin(*SERIALIZATION_CODES, *AUTHORIZATION_CODES), F.lit(False))
    again = ~hopeless & (n < MAX_RETRIES)
    backoff = F.when(again, F.lit(float(BASE_BACKOFF_SECONDS)) * F.pow(F.lit(2.0), n))
    return F.struct(F.when(again, "retry").otherwise("dead_letter").alias("action"), backoff.alias("backoff_s"))


def with_jitter(backoff: Column, attempt: Column) -> Column:
    """Random jitter of up to a tenth of the step; kept apart because it is not deterministic."""
    return backoff + F.rand() * F.lit(0.1) * F.pow(F.lit(2.0), attempt)


def dlq_envelope(
    df: DataFrame, topic: Column, code: Column, message: Column, at: Column, retries: Column, client: str
) -> DataFrame:
    """Add ``dlq_topic`` and the ``headers`` map of a dead-letter record."""
    headers = F.create_map(
        F.lit("dlq.original.topic"), topic.cast("string"),
        F.lit("dlq.error.type"), classify_error(code, message),
        F.lit("dlq.error.message"), F.substring(message, 1, MESSAGE_LIMIT),
        F.lit("dlq.timestamp"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"),
        F.lit("dlq.retry.count"), retries.cast("string"),
        F.lit("dlq.producer.client.id"), F.lit(f"{client}-dlq"),
    )
    return df.withColumns({"dlq_topic": F.concat(topic, F.lit(".dlq")), "headers": headers})


def foreach_record(
    df: DataFrame, handler: Callable[[object, object], None], key: str = "key", value: str = "value"
) -> DataFrame:
    """Call ``handler(key, value)`` for every record; failures become rows and do not stop the job.

    Adds ``handled`` and ``error``. This is the one operator that runs user code in Python.
    """
    schema = T.StructType([
        *df.schema.fields, T.StructField("handled", T.BooleanType()), T.StructField("error", T.StringType()),
    ])

    def attempt(k, v) -> str | None:
        try:
            handler(k, v)
        except Exception as failure:  # noqa: BLE001 - any handler failure is reported as a row
            return f"{type(failure).__name__}: {failure}"
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = pd.Series([attempt(k, v) for k, v in zip(batch[key], batch[value])], index=batch.index, dtype=object)
            yield batch.assign(handled=errors.isna(), error=errors)

    return df.mapInPandas(run, schema)


def dlq_increase(df: DataFrame, pattern: str, lookback: str, span: str, time: str = "ts", value: str = "value") -> DataFrame:
    """Dead-lettered records per time span, over topics whose whole name matches ``pattern``.

    The counter's step from the sample before, if that is less than ``lookback`` old, counts once, in the span in which
    it ends; a value below the one before it counts from zero. ``per_second`` is the sum over the span's length.
    """
    from tidemark.functions.slices import with_neighbours
    from tidemark.functions.units import micros
    from tidemark.operators.routing import match_labels

    chosen = match_labels(df, regex={"topic": pattern}).filter(F.col(time).isNotNull()).select("topic", time, value)
    us = F.unix_micros(time)
    rows = with_neighbours(chosen.withColumn("_us", us), ["topic"], time, previous={"_before": value, "_before_us": "_us"})
    rows = rows.filter(F.col("_before_us") + F.lit(micros(lookback)) > us)
    step = F.when(F.col(value) >= F.col("_before"), F.col(value) - F.col("_before")).otherwise(F.col(value))
    return rows.withColumn("_step", step).groupBy(F.window(time, span).start.alias("since")).agg(
        F.count("*").alias("samples"), F.sum("_step").alias("records"),
        (F.sum("_step").cast("double") / F.lit(micros(span) / 1e6)).alias("per_second"),
    )
