"""Business rules and review routing, as Column factories over fields and tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.scalars import amount_of, parse_amount, parse_date, plain_number, strip
from paperloom.operators.layout import once

#: The live rules' required fields, and those of the fuller, optional set.
REQUIRED = {"invoice": ("invoice_no", "date", "total"), "receipt": ("total", "date"), "form": ("date",), "certificate": ("date",)}
REQUIRED_FULL = {
    "invoice": ("invoice_no", "date", "total"), "receipt": ("receipt_no", "date", "total"),
    "form": ("name", "date_of_birth"), "certificate": ("certificate_id", "awarded_to", "date"),
}
GSTIN = r"^\d{2}[A-Z]{5}\d{4}[A-Z]\d[Z][A-Z\d]$"
LOW_CONFIDENCE = 0.6
#: Messages of the fuller set's sum.
UNREAD = "Could not parse all values in table column '%s'; sum check skipped"
UNEQUAL = "Line items sum to %.2f but extracted total is %.2f (difference: %.2f)"
RESULTS = "array<struct<rule:string,passed:boolean,message:string>>"


def value(name: str) -> Column:
    return F.try_element_at("fields", F.lit(name))["value"]


def failed(when: Column, rule: str, message: Column) -> Column:
    """A failed result where ``when`` holds, else NULL."""
    return F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(False).alias("passed"), message.alias("message")))


def required(table: dict[str, tuple[str, ...]] = REQUIRED) -> list[Column]:
    """One column for each required field of a type, in order."""
    out = []
    for kind, names in table.items():
        for n in names:
            missing = (F.coalesce("doc_type", F.lit("invoice")) == kind) & (F.coalesce(value(n), F.lit("")) == "")
            out.append(failed(missing, "required_fields", F.lit(f"Missing required field: '{n}'")))
    return out


def future_date(as_of: Column) -> Column:
    v = value("date")
    return failed(parse_date(v) > as_of, "date_validity", F.concat(F.lit("Field 'date' value '"), v, F.lit("' is in the future")))


def _table() -> Column:
    return F.get("tables", F.lit(0))


def _amounts(at: Column) -> Column:
    stripped = F.transform(_table()["rows"], lambda r: strip(F.try_element_at(r, at)))
    return F.transform(stripped, amount_of)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def line_items_sum(tolerance: float = 1.0) -> Column:
    """The first column called amount or total must sum to the total."""
    flags = F.transform(_table()["headers"], lambda h: F.lower(h).isin("amount", "total"))
    at = F.nullif(F.array_position(flags, True), F.lit(0)).cast("int")
    total = parse_amount(value("total"))

    def result(made):
        message = F.format_string("Line items sum to %.2f but extracted total is %.2f", made, total)
        return failed(at.isNotNull() & (F.abs(made - total) > tolerance), "line_items_sum", message)

    return once(_sum(_amounts(at)), result)


def low_confidence(threshold: float = LOW_CONFIDENCE) -> Column:
    return F.exists(F.map_values("fields"), lambda f: f["value"].isNotNull() & (F.coalesce(f["conf"], F.lit(1.0)) < threshold))


def both_dates_valid(as_of: Column) -> list[Column]:
    """date and date_of_birth: unparsable and future values both fail."""
    out = []
    for n in ("date", "date_of_birth"):
        v, d = value(n), parse_date(value(n))
        unread = F.concat(F.lit(f"Field '{n}' value '"), v, F.lit("' is not a recognizable date"))
        future = F.concat(F.lit(f"Field '{n}' value '"), v, F.lit("' is in the future"))
        bad = (F.coalesce(v, F.lit("")) != "") & (d.isNull() | (d > as_of))
        out.append(failed(bad, "date_format", F.when(d.isNull(), unread).otherwise(future)))
    return out


def gstin_format() -> Column:
    v = value("gstin")
    return failed((v != "") & ~v.rlike(GSTIN), "gstin_format", F.concat(F.lit("GSTIN '"), v, F.lit("' does not match expected format")))


def line_items_complete(tolerance: float = 1.0) -> Column:
    """As line_items_sum, for amount, else total, else price; a cell that isn't a number fails."""
    headers = _table()["headers"]
    at = F.coalesce(*(F.nullif(F.array_position(headers, F.lit(h)), F.lit(0)) for h in ("amount", "total", "price"))).cast("int")
    total = parse_amount(value("total"))

    def result(cells):
        unread, off = F.exists(cells, lambda x: x.isNull()), F.abs(_sum(cells) - total)
        bad = at.isNotNull() & total.isNotNull() & (unread | (off > tolerance))
        message = F.when(unread, F.format_string(UNREAD, F.element_at(headers, at))).otherwise(F.format_string(UNEQUAL, _sum(cells), total, off))
        return failed(bad, "line_items_complete", message)

    return once(_amounts(at), result)


def total_matches() -> Column:
    """subtotal + tax = total within a cent; a missing operand fails."""
    a, b, c = (plain_number(value(n)) for n in ("subtotal", "tax", "total"))
    ok = F.coalesce(F.abs(a + b - c) < 0.01, F.lit(False))
    message = F.when(a.isNull() | b.isNull() | c.isNull(), F.lit("missing subtotal/tax/total")).otherwise(
        F.concat_ws("", a.cast("string"), F.lit("+"), b.cast("string"), F.lit("!="), c.cast("string"))
    )
    return failed(~ok, "total_matches", message)


def full_rules(as_of: Column) -> list[Column]:
    """The optional, fuller rule set; GSTIN and sums concern invoices alone."""
    invoice = lambda c: F.when(F.col("doc_type") == "invoice", c)
    return [*required(REQUIRED_FULL), *both_dates_valid(as_of), invoice(gstin_format()), invoice(line_items_complete())]


def live_rules(as_of: Column, compat: bool = False) -> list[Column]:
    """The rules that route documents. compat: without the sum of line items, which never fires there."""
    return [*required(), future_date(as_of), *([] if compat else [line_items_sum()])]


def validate(docs: DataFrame, as_of: str | Column, rules: Callable[..., list[Column]] = live_rules, **options) -> DataFrame:
    """docs (doc_type, fields, tables) with ``validation`` (failed results only) and ``needs_review``."""
    at = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    found = F.filter(F.array(*rules(at, **options)), lambda r: r.isNotNull()).cast(RESULTS)
    out = docs.withColumn("validation", found)
    return out.withColumn("needs_review", (F.size("validation") > 0) | F.coalesce(low_confidence(), F.lit(False)))
