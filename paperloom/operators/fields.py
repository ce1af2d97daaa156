"""Key fields: patterns on the full text, labels on lines, and heuristics on the first lines."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.scalars import title_case
from paperloom.operators.layout import full_text, line_text, once

#: What follows the name of an amount.
_MONEY = r"\s*[:\-]?\s*(?:rs\.?|inr|\$|₹|€|eur|usd)?\s*([\d,]+\.\d{2}|[\d]+,\d{2}|[\d,]+)"
#: A pattern for each field.
PATTERNS = {
    "invoice_no": r"(?:\b(?:invoice\s*(?:no\b\.?|number\b|#)\s*[:\-]?\s*)([A-Za-z0-9\-\/]+)|\b(INV-[A-Za-z0-9\-\/]+)\b)",
    "receipt_no": r"\b(?:receipt|recibo|ticket|fatura[\/\-]recibo|bill)\s*(?:no\b\.?|number\b|#|n[º°.]?|id\b)?\s*[:\-]?\s*([A-Za-z0-9\-\/]+)",
    "certificate_id": r"\b(?:certificate\s*(?:no\b\.?|id\b|number\b|#)\s*[:\-]?\s*)([A-Za-z0-9\-\/]+)",
    "date": r"\b(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}|\d{4}[\/\-\.]\d{1,2}[\/\-\.]\d{1,2})\b",
    "subtotal": r"(?:sub\s*total|subtotal)" + _MONEY,
    "tax": r"(?:tax|vat|gst|iva)" + _MONEY,
    "total": r"(?:grand\s*total|total\s*amount|amount\s*due|total\s*paid|valor\s*total|\btotal\b)" + _MONEY,
    "gstin": r"\b(\d{2}[A-Z]{5}\d{4}[A-Z]{1}\d[Z]{1}[A-Z\d]{1})\b",
    "pan": r"\b([A-Z]{5}\d{4}[A-Z])\b",
    "email": r"([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})",
    "phone": r"(?:\+?\d{1,3}[-.\s]?)?(\d{10})",
    "issuer": r"(?:issued\s*by|issuer)\s*[:\-]?\s*([A-Za-z0-9\s.,&'\-]+?)(?:\s+(?:date|total|invoice|receipt)|\s*$)",
    "payment_method": r"(?:payment\s*(?:method)?\s*[:\-]?\s*|(?:paid\s*(?:by|with)|via)\s*[:\-]?\s*)([A-Za-z0-9\s]+?)(?:\s+(?:date|total|subtotal|tax|thank)|\s*$)",
}
#: What a text without other than ASCII characters must hold, in lower case, for a pattern to match; the others have no such parts.
NEEDED = {
    "invoice_no": ("inv",), "receipt_no": ("receipt", "recibo", "ticket", "bill"), "certificate_id": ("certificate",), "subtotal": ("total",),
    "tax": ("tax", "vat", "gst", "iva"), "total": ("total", "amount"), "gstin": ("z",), "email": ("@",), "issuer": ("issue",),
    "payment_method": ("payment", "paid", "via"),
}
#: What such a text must have somewhere, of fields whose patterns begin with what is everywhere.
SHAPES = {"date": r"\d[/.\-]\d", "pan": r"[A-Za-z]\d{4}[A-Za-z]", "phone": r"\d{10}"}
#: Labels and their fields, in the order in which they are tried.
LABELS = {
    "vendor name": "vendor", "vendor": "vendor", "bill to": "customer", "customer name": "customer",
    "applicant name": "applicant_name", "name": "name", "issued by": "issuer", "awarded to": "awarded_to",
    "date of birth": "date_of_birth", "address": "address", "payment method": "payment_method", "merchant": "merchant",
}
#: Words of titles, words that no vendor has, means of payment.
TITLES = ("certificate", "form", "checklist")
NOT_VENDORS = ("invoice", "receipt", "date", "subtotal", "tax", "total")
PAYMENTS = ("visa card", "mastercard", "credit card", "debit card", "cash", "apple pay")
CONFIDENCE = 0.9
FIELD = "map<string,struct<value:string,conf:double,bbox:array<double>>>"


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def by_pattern(text: Column, field: str, low: Column | None = None, plain: Column | None = None) -> Column:
    """The first match of the field's pattern, NULL without one; a decimal comma becomes a point.

    Texts of ASCII alone are sought without Unicode's classes, which say the same there, and only if they hold what
    every match does. low, plain: the text in lower case and ``is_ascii``, where these are columns already.
    """
    low, plain = F.lower(text) if low is None else low, is_ascii(text) if plain is None else plain
    groups = 2 if field == "invoice_no" else 1

    def first(flags):
        return F.coalesce(*(F.nullif(F.regexp_extract(text, flags + PATTERNS[field], g), F.lit("")) for g in range(1, groups + 1)))

    # an address begins where a run of its first part's characters begins: starts within runs needn't be tried
    at_run = r"(?<![a-zA-Z0-9._%+\-])" if field == "email" else ""
    some = reduce(or_, (F.contains(low, F.lit(x)) for x in NEEDED[field])) if field in NEEDED else F.lit(True)
    if field in SHAPES:
        some &= text.rlike(SHAPES[field])
    ahead = r"(?=\d)" if field == "date" else at_run  # a digit is told sooner than a word's edge
    value = F.trim(F.when(~plain, first("(?iU)")).when(some, first("(?i)" + ahead)))
    if field in ("subtotal", "tax", "total"):
        point = lambda v: F.when(v.rlike(r"^\d+,\d{2}$"), F.replace(v, F.lit(","), F.lit("."))).otherwise(v)
        value = once(value, point)
    return value


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def _said(low: Column, words: Iterable[str]) -> Column:
    """Whether one of the words occurs, also within another."""
    return reduce(or_, (F.contains(low, F.lit(x)) for x in words))


#: Labels that have no other label in them: a line with any label has one of these.
_SHORTEST = [x for x in LABELS if not any(y in x for y in LABELS if y != x)]


def labelled_lines(lines: Column) -> Column:
    """Lines with a label as array<struct<low, texts, lows, bares>>: what labels are sought in, made once for all of them.

    low: the line in lower case; lows: its texts in lower case; bares: these without colons and hyphens at their ends.
    """

    def bare(t):
        marked = F.contains(t, F.lit(":")) | F.contains(t, F.lit("-"))
        return F.when(marked, F.regexp_replace(t, r"[:\-]+$", "")).otherwise(t)

    def line(texts, lows):
        return F.struct(
            F.lower(F.array_join(texts, " ")).alias("low"), texts.alias("texts"), lows.alias("lows"),
            F.transform(lows, bare).alias("bares"),
        )

    some = F.filter(lines, lambda l: once(F.lower(line_text(l)), lambda low: _said(low, _SHORTEST)))
    return F.transform(some, lambda l: once(l["text"], lambda texts: once(F.transform(texts, F.lower), lambda lows: line(texts, lows))))


def _after(line: Column, at: Column) -> Column:
    """The line's texts from position ``at`` (from 1) on, but for lone colons and hyphens; NULL if none."""
    rest = F.filter(F.slice(line["texts"], at, F.size(line["texts"]) + 1), lambda t: ~t.isin(":", "-"))
    return F.when(F.size(rest) > 0, F.array_join(rest, " "))


def by_label(line: Column, label: str) -> Column:
    """What stands after the label on a line of ``labelled_lines``, NULL if nothing does."""

    def single(bare, i):
        low, text = F.get(line["lows"], i), F.get(line["texts"], i)
        inner = F.trim(F.regexp_replace(text, "(?i)^" + re.escape(label) + r"[:\-]\s*", ""))
        joined = F.trim(F.concat_ws(" ", inner, F.coalesce(_after(line, i + 2), F.lit(""))))
        inside = F.startswith(low, F.lit(label + ":")) | F.startswith(low, F.lit(label + " -"))
        return F.when(inside, F.nullif(joined, F.lit(""))).when(bare == label, _after(line, i + 2))

    n = len(label.split())

    def window(bare, i):
        text = F.array_join(F.slice(line["bares"], i + 1, n), " ")
        return F.when((bare == label.split()[0]) & (i + n <= F.size(line["bares"])) & (text == label), _after(line, i + n + 1))

    value = _first(F.transform(line["bares"], single))
    if n > 1:  # a window of one word is what single() has tried
        value = F.coalesce(value, _first(F.transform(line["bares"], window)))
    return F.when(F.contains(line["low"], F.lit(label)), value)


def _on_line(labels: list[str]):
    return lambda line: F.coalesce(*(by_label(line, x) for x in labels))


def label_values(found: Column, low: Column | None = None) -> dict[str, Column]:
    """Field to value, from ``labelled_lines``: the first line wins, on a line the first label.

    low: the whole text in lower case, if there is one: fields of which it holds no label's longest word aren't sought.
    """
    out = {}
    for field in dict.fromkeys(LABELS.values()):
        labels = [x for x, f in LABELS.items() if f == field]
        some = F.filter(found, lambda l: _said(l["low"], labels))  # noqa: B023
        value = _first(F.transform(some, _on_line(labels)))
        out[field] = value if low is None else F.when(_said(low, dict.fromkeys(max(x.split(), key=len) for x in labels)), value)
    return out


def title(lines: Column) -> Column:
    said = lambda first: F.when(F.lower(first).rlike("|".join(TITLES)), title_case(first))
    return once(F.trim(line_text(F.get(lines, F.lit(0)))), said)


def vendor_guess(lines: Column) -> Column:
    """The first of the top three lines that may be a name."""

    def named(t, low):
        generic = F.when(_said(low, NOT_VENDORS), low.rlike(r"(?U)\b(" + "|".join(NOT_VENDORS) + r")\b")).otherwise(False)
        return (F.length(t) > 3) & ~F.startswith(low, F.lit("inv-")) & ~F.startswith(low, F.lit("issued by")) & ~generic

    fits = lambda t: once(F.lower(t), lambda low: F.when(named(t, low), t))
    return F.coalesce(*(once(F.trim(line_text(F.get(lines, F.lit(i)))), fits) for i in range(3)))


def payment_guess(text: Column, low: Column | None = None) -> Column:
    def named(low):
        return F.coalesce(*(F.when(F.contains(low, F.lit(p)), F.lit(p.title())) for p in PAYMENTS))

    return once(F.lower(text), named) if low is None else named(low)


def _truthy(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def extract_fields(docs: DataFrame) -> DataFrame:
    """docs (ocr, lines) with ``fields``: every standard name, NULL where nothing was found.

    Labels override patterns. Confidence is 0.9 for a value, 0.0 without.
    """
    made = docs.withColumn("_text", full_text(F.col("ocr")))
    made = made.withColumns({"_low": F.lower("_text"), "_plain": is_ascii(F.col("_text"))})
    made = made.withColumn("_found", labelled_lines(F.col("lines")))
    labelled = label_values(F.col("_found"), F.col("_low"))
    names = list(dict.fromkeys([*PATTERNS, *labelled]))
    made = made.withColumns({f"_l_{n}": v for n, v in labelled.items()})
    base = {}
    for n in names:
        pattern = by_pattern(F.col("_text"), n, F.col("_low"), F.col("_plain")) if n in PATTERNS else F.lit(None).cast("string")
        base[f"_f_{n}"] = F.coalesce(F.col(f"_l_{n}"), pattern) if n in labelled else pattern
    base |= {"_title": title(F.col("lines")), "_guess": vendor_guess(F.col("lines")), "_pay": payment_guess(F.col("_text"), F.col("_low"))}
    made = made.withColumns(base)
    f = {n: F.col(f"_f_{n}") for n in names}
    vendor = F.coalesce(_truthy(f["vendor"]), F.col("_guess"), _truthy(f["merchant"]), f["vendor"])
    merchant = F.coalesce(_truthy(f["merchant"]), F.col("_guess"), _truthy(f["vendor"]), f["merchant"])
    f |= {"vendor": vendor, "merchant": merchant, "payment_method": F.coalesce(_truthy(f["payment_method"]), F.col("_pay"), f["payment_method"])}
    f |= {"issued_by": _truthy(f["issuer"]), "title": F.col("_title")}
    pairs = {}
    for n, v in f.items():
        conf = F.when(_truthy(v).isNotNull(), CONFIDENCE).otherwise(0.0)
        pairs[n] = F.struct(F.lit(n).alias("k"), F.struct(v.alias("value"), conf.alias("conf"), F.lit(None).cast("array<double>").alias("bbox")).alias("v"))
    late = [F.when(f[n].isNotNull(), pairs.pop(n)) for n in ("issued_by", "title")]
    # the fields that are always there stay out of the filter: what a lambda filters isn't compiled
    made = made.withColumn("fields", F.map_from_entries(F.concat(F.array(*pairs.values()), F.filter(F.array(*late), lambda p: p.isNotNull()))).cast(FIELD))
    return made.drop("_text", "_low", "_plain", "_found", "_title", "_guess", "_pay", *(f"_l_{n}" for n in labelled), *(f"_f_{n}" for n in names))
