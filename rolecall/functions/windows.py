"""Rules that look around each match: degrees as columns, pay in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall import vocabulary as v

_NEAR = re.compile(v.PAY_NEAR)
_PAY = tuple((kind, re.compile(p)) for kind, p in (("month", v.PAY_MONTHLY), ("lpa", v.PAY_LPA), ("year", v.PAY_ANNUAL)))

_PAID = T.StructType().add("pay_min", "long").add("pay_max", "long").add("currency", "string").add("period", "string").add("label", "string")


# Characters looked at before and after a match, and the bounds of a plausible pay.
DEGREE_WINDOW = 160
PAY_BEFORE, PAY_AFTER = 120, 40
LEAST_PAY, LEAST_LAKHS, MOST_LAKHS, LAKH = 1000, 1, 200, 100_000


def needs_advanced_degree(title: Column, description: Column) -> Column:
    """An advanced degree in the title, or in the text with no bachelor's within ``DEGREE_WINDOW`` characters of it; false without either."""
    text, pattern = F.coalesce(description, F.lit("")), F.lit(v.ADVANCED_DEGREE)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, v.ADVANCED_DEGREE)
    pairs = F.slice(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), F.lit(1), F.size(hits))

    def step(seen: Column, pair: Column) -> Column:
        begin = seen["at"] + F.char_length(pair["gap"])
        end = begin + F.char_length(pair["hit"])
        low = F.greatest(begin - DEGREE_WINDOW, F.lit(0))
        return F.struct(end.alias("at"), (seen["asked"] | ~F.substr(text, low + 1, end + DEGREE_WINDOW - low).rlike(v.BACHELOR_OK)).alias("asked"))

    asked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.lit(False).alias("asked")), step)["asked"]
    return F.coalesce(title.rlike(v.ADVANCED_DEGREE), F.lit(False)) | F.when(text.rlike(v.ADVANCED_DEGREE), asked).otherwise(F.lit(False))


def _amount(text: str | None) -> int | None:
    """The whole number in front; fractions are cut off."""
    try:
        return int(float((text or "").replace(",", "").rstrip(".")))
    except ValueError:
        return None


def pay(text: str | None) -> dict | None:
    """The first plausible pay near a pay word: monthly, then lakhs a year, then yearly; with the label that a card shows."""
    text = text or ""
    for kind, pattern in _PAY:
        for m in pattern.finditer(text):
            if not _NEAR.search(text[max(0, m.start() - PAY_BEFORE) : m.end() + PAY_AFTER]):
                continue
            low, high = _amount(m.group(1)), _amount(m.group(2))
            lakhs = kind == "lpa"
            if low is None or (not LEAST_LAKHS <= low <= MOST_LAKHS if lakhs else low < LEAST_PAY):
                continue
            dollars = not lakhs and re.search(r"(?i)usd|\$", m.group())
            shown = ("$" if dollars else "₹") + m.group(1) + (f"-{m.group(2)}" if m.group(2) else "")
            times = LAKH if lakhs else 1
            return {
                "pay_min": low * times, "pay_max": high * times if high is not None and (high or not lakhs) else None, "currency": "USD" if dollars else "INR",
                "period": "month" if kind == "month" else "year", "label": shown + (" LPA" if lakhs else "/month" if kind == "month" else "/year"),
            }
    return None


@F.pandas_udf(_PAID)
def extract_pay(text: pd.Series) -> pd.DataFrame:
    rows = [pay(t) or dict.fromkeys(_PAID.names) for t in text]
    return pd.DataFrame(rows, columns=_PAID.names).astype({"pay_min": "Int64", "pay_max": "Int64"})
