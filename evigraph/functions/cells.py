"""Numbers with units from table cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Currency signs and units; letters and factors.
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
SCALES = {"k": 1e3, "m": 1e6, "b": 1e9, "t": 1e12}


_HEAD = r"(?s)^([+-]?)([$€£¥]?)(.*)$"
_BODY = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*([KkMmBbTt]?)\s*(%?)$"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def metric_cell(c: Column) -> Column:
    """struct(value, unit) of a cell such as $1.2M, 12.5% or -3,400; null if it is no number.

    In this order: one sign, one currency sign, a percent sign at the end (the currency is then left out) or one letter for a factor; commas do not
    count. What remains must be a decimal number, with a sign of its own and an exponent if it likes."""
    part = lambda x, pattern, k: F.regexp_extract(x, pattern, k)

    def parsed(head: Column) -> Column:
        body = F.trim(F.replace(head["body"], F.lit(","), F.lit("")))
        fields = F.struct(*[part(body, _BODY, k).alias(n) for k, n in ((1, "number"), (2, "letter"), (3, "percent"))], head["sign"].alias("sign"), head["currency"].alias("currency"))
        return let(fields, result)

    def result(x: Column) -> Column:
        scale, unit = F.lit(1.0), F.lit("Count")
        for mark, factor in SCALES.items():
            scale = F.when(F.lower(x["letter"]) == mark, F.lit(factor)).otherwise(scale)
        for mark, name in CURRENCIES.items():
            unit = F.when(x["currency"] == mark, F.lit(name)).otherwise(unit)
        unit = F.when(x["percent"] != "", F.lit("Percent")).otherwise(unit)
        value = F.nullif(x["number"], F.lit("")).try_cast("double") * F.when(x["sign"] == "-", -scale).otherwise(scale)
        ok = value.isNotNull() & (F.abs(value) < float("inf")) & ((x["letter"] == "") | (x["percent"] == ""))
        return F.when(ok, F.struct(value.alias("value"), unit.alias("unit")))

    text = F.trim(c)
    return let(F.struct(*[part(text, _HEAD, k).alias(n) for k, n in ((1, "sign"), (2, "currency"), (3, "body"))]), parsed)
