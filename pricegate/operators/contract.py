"""The row contract: accepted rows, and quarantined rows with one stable reason each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bound
from ..functions.calendar import ZONE, hours_in_local_day
from ..sources.feeds import HUBS, UNIT

FIELDS = ["hub", "day", "hour", "price_da", "price_rt", "unit", "status"]


@dataclass(frozen=True)
class Contract:
    """Limits of a published row."""

    hubs: tuple[str, ...] = tuple(HUBS)
    low: float = -500.0
    high: float = 5000.0
    last_hour: int = 25
    unit: str = UNIT
    statuses: tuple[str, ...] = ("preliminary", "verified")
    zone: str = ZONE
    fields: tuple[str, ...] = field(default=tuple(FIELDS))


def _range(price: Column, c: Contract) -> Column:
    """NaN compares above every number, so it is out of range too."""
    return F.when((price < c.low) | (price > c.high), "price_out_of_range")


def _hour(hour: Column, c: Contract) -> Column:
    return F.when(hour < 1, "hour_before_day").when((hour > c.last_hour) | (hour != F.floor(hour)), "hour_beyond_day")


def _rules(day: Column, hour: Column, hub: Column, c: Contract) -> list[Column]:
    return [F.when(hour > hours_in_local_day(day, c.zone), "hour_beyond_day"), F.when(~hub.isin(*c.hubs), "unknown_hub")]


def quarantine_reason(c: Contract = Contract()) -> Column:
    """First failure of a typed row in the order of fields, then of the two row rules; null if it passes."""
    col = F.col
    bad = lambda name: F.when(col(name).isNull(), "bad_type")
    return F.coalesce(
        bad("hub"), bad("day"), bad("hour"), _hour(col("hour"), c), bad("price_da"), _range(col("price_da"), c), _range(col("price_rt"), c),
        F.when(~col("unit").eqNullSafe(c.unit), "unit_not_usd_mwh"), F.when(~F.coalesce(col("status").isin(*c.statuses), F.lit(False)), "unknown_status"),
        *_rules(col("day"), col("hour"), col("hub"), c),
    )


#: Texts that stand for a number, a whole number, a day, and a day with a time and perhaps a zone.
NUMBER, WHOLE = r"(?i)^\s*[+-]?((\d+(_\d+)*\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$", r"^\s*[+-]?\d+(_\d+)*(\.0+)?\s*$"
DAY, TIME = r"^\d{4}-\d{2}-\d{2}", r"[Tt _]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d([.,]\d{1,9})?)?([Zz]|[+-][0-2]\d:?[0-5]\d)?$"
MIDNIGHT = r"[Tt _]00:00(:00([.,]0+)?)?([Zz]|[+-][0-2]\d:?[0-5]\d)?$"
#: Seconds since 1970 up to this size; larger numbers are milliseconds.
SECONDS = 2e10


def with_payload(rows: DataFrame, payload: str, c: Contract = Contract()) -> DataFrame:
    """Rows with what their JSON text holds: whether it is an object, its keys, and for each field its JSON type (__kind_) and its
    value, null where it has none of the field's type.

    Types are JSON's own, as VARIANT keeps them: a number is no text, while texts of numbers,
    and true for 1, are taken as numbers. A day is a text of a day, or of one with a time, or
    a number of seconds since 1970. A text with a key twice is no object.
    """
    parsed = bound(rows, {"__v": F.try_parse_json(payload), "__keys": F.json_object_keys(payload)})
    field = lambda f, kind: F.try_variant_get("__v", f"$.{f}", kind)
    parts = {f"__kind_{f}": F.schema_of_variant(field(f, "variant")) for f in c.fields} | {f"__text_{f}": field(f, "string") for f in c.fields}
    rows = bound(parsed, {"__whole": F.schema_of_variant("__v").startswith("OBJECT")} | parts).drop("__v")
    kind, text = (lambda f: F.col(f"__kind_{f}")), (lambda f: F.col(f"__text_{f}"))
    numeric = lambda f: kind(f).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")

    def number(f: str, pattern: str) -> Column:
        plain = F.regexp_replace(F.trim(text(f)), "_", "").try_cast("double")
        return F.when(numeric(f), text(f).try_cast("double")).when(kind(f) == "BOOLEAN", (text(f) == "true").cast("double")).when((kind(f) == "STRING") & text(f).rlike(pattern), plain)

    day = F.try_to_date(F.substr(text("day"), F.lit(1), F.lit(10)), "yyyy-MM-dd")
    stamp = F.when(numeric("day") | ((kind("day") == "STRING") & text("day").rlike(r"^[+-]?\d+(\.\d+)?$")), text("day").try_cast("double"))
    of_text = F.when((kind("day") == "STRING") & text("day").rlike(DAY + f"($|{TIME})"), day)
    rows = bound(rows, {"__day": of_text, "__seconds": F.when(F.abs(stamp) > SECONDS, stamp / 1000).otherwise(stamp)})
    seconds = F.col("__seconds")
    late = F.when(F.col("__day").isNotNull(), (F.length(text("day")) > 10) & ~text("day").rlike(DAY + MIDNIGHT)).otherwise(seconds % 86400 != 0)
    values = {
        "hub": F.when(kind("hub") == "STRING", text("hub")), "day": F.coalesce("__day", F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))), "hour": number("hour", WHOLE), "price_da": number("price_da", NUMBER),
        "price_rt": number("price_rt", NUMBER), "unit": F.when(kind("unit") == "STRING", text("unit")), "status": F.when(kind("status") == "STRING", text("status")),
    }
    found = bound(rows, {"__late": late} | {f"__value_{f}": values[f] for f in c.fields})
    return found.drop("__day", "__seconds", *[f"__text_{f}" for f in c.fields])


def payload_reason(c: Contract = Contract()) -> Column:
    """The reason of rows of ``with_payload``: absent keys, unknown keys and values of another type count too."""
    p = lambda f: F.col(f"__value_{f}")
    absent = lambda f: F.when(F.col(f"__kind_{f}").isNull(), "missing_field")
    bad = lambda f: F.when(p(f).isNull(), "bad_type")
    return F.coalesce(
        F.when(~F.coalesce(F.col("__whole"), F.lit(False)), "bad_type"),
        absent("hub"), bad("hub"),
        absent("day"), bad("day"), F.when(F.col("__late"), "date_from_datetime_inexact"),
        absent("hour"), bad("hour"), _hour(p("hour"), c),
        absent("price_da"), bad("price_da"), _range(p("price_da"), c),
        F.when(F.col("__kind_price_rt") != "VOID", F.coalesce(bad("price_rt"), _range(p("price_rt"), c))),
        absent("unit"), F.when(~p("unit").eqNullSafe(c.unit), "unit_not_usd_mwh"),
        absent("status"), F.when(~F.coalesce(p("status").isin(*c.statuses), F.lit(False)), "unknown_status"),
        F.when(F.size(F.array_except("__keys", F.array(*[F.lit(x) for x in c.fields]))) > 0, "unexpected_field"),
        *_rules(p("day"), p("hour"), p("hub"), c),
    )


def typed_payload() -> list[Column]:
    """Columns of an accepted row of ``with_payload``."""
    return [(F.col("__value_hour").cast("int") if f == "hour" else F.col(f"__value_{f}")).alias(f) for f in FIELDS]


def with_reason(rows: DataFrame, c: Contract = Contract(), payload: str | None = None) -> DataFrame:
    """Rows with their reason, null if they pass: of typed columns, or of a column of JSON texts, whose typed values stay beside it (``with_payload``)."""
    if payload:
        return with_payload(rows, payload, c).withColumn("reason", payload_reason(c))
    return rows.withColumn("reason", quarantine_reason(c))


def validate(rows: DataFrame, c: Contract = Contract()) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): every row is in one of them, the second with its reason."""
    marked = with_reason(rows, c)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def reason_counts(quarantined: DataFrame) -> DataFrame:
    return quarantined.groupBy("reason").agg(F.count("*").alias("n"))


def quarantine_rate(marked: DataFrame, *by: str) -> DataFrame:
    """published, quarantined and their rate, over all rows or by some columns."""
    bad = F.count("reason")
    return marked.groupBy(*by).agg(F.count("*").alias("published"), bad.alias("quarantined"), (bad / F.greatest(F.count("*"), F.lit(1))).alias("rate"))
