"""Column factories: amounts, dates, text normalisation, error rates, comparisons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the contract.
AMOUNT_FIELDS = ("total", "subtotal", "tax", "balance", "amount_due", "net_amount")
DATE_FIELDS = ("date", "due_date", "invoice_date", "issued_date")
FIELD_NAME = "^[a-z][a-z0-9_]*$"
MAX_VALUE_CHARS = 500


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(x: Column, result: Callable[[Column], Column]) -> Column:
    """result of x, which is computed once however often result names it."""
    return F.get(F.transform(F.array(x), result), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space (Unicode) at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def parse_amount(value: Column | str) -> Column:
    """A printed amount as double, NULL if it isn't one.

    Of a dot and a comma the later is the decimal mark; a lone comma is one before one or two final
    digits, else it groups thousands. Currency signs and all else but digits, dots and minus go.
    """
    return once(strip(_col(value)), amount_of)


def amount_of(s: Column) -> Column:
    """``parse_amount`` of a text without white space at its ends."""
    from_end = lambda mark: F.locate(mark, F.reverse(s))
    decimal_comma = F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", ".")
    plain = F.regexp_replace(s, ",", "")
    both = F.when(from_end(",") < from_end("."), decimal_comma).otherwise(plain)
    lone = F.when(s.rlike(r",\d{1,2}$"), F.regexp_replace(s, ",", ".")).otherwise(plain)
    has = lambda mark: F.contains(s, F.lit(mark))
    t = F.when(has(",") & has("."), both).when(has(","), lone).otherwise(s)
    return F.regexp_replace(t, r"[^0-9.\-]", "").try_cast("double")  # of an empty text NULL


def plain_number(value: Column | str) -> Column:
    """Commas dropped, nothing else: NULL for anything but a number."""
    return F.regexp_replace(_col(value), ",", "").try_cast("double")


def _date(s: Column, *formats: str) -> Column:
    return F.coalesce(*(F.try_to_date(s, f) for f in formats))


def parse_date(value: Column | str) -> Column:
    """Dates of validation: d/m/y and y-m-d forms; two-digit years from 69 on are of the 1900s."""
    s = _col(value)
    short = F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_date(s, "d/M/yy"))
    century = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    long = F.when(
        s.rlike(r"^(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{4}|\d{4}[/\-]\d{1,2}[/\-]\d{1,2})$"),
        _date(s, "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d", "yyyy/M/d"),
    )
    return F.coalesce(long, century)


def index_date(value: Column | str) -> Column:
    """Dates of the index, as ISO text: y-m-d, d/m/y, d-m-y, d Mon y and d Month y."""
    return once(F.regexp_replace(strip(_col(value)), r"\s+", " "), _index_date)


def _index_date(s: Column) -> Column:
    digits = F.when(
        s.rlike(r"^(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[/\-]\d{1,2}[/\-]\d{4})$"), _date(s, "yyyy-M-d", "d/M/yyyy", "d-M-yyyy")
    )
    named = F.when(s.rlike(r"^\d{1,2} [A-Za-z]+ \d{4}$"), _date(s, "d MMM yyyy", "d MMMM yyyy"))
    return F.date_format(F.coalesce(digits, named), "yyyy-MM-dd")


def normalize_text(value: Column | str) -> Column:
    """Trimmed, lower case, white space collapsed; empty for NULL."""
    return normal_of(strip(F.coalesce(_col(value), F.lit(""))))


def normal_of(s: Column) -> Column:
    """``normalize_text`` of a text without white space at its ends."""
    return F.regexp_replace(F.lower(s), r"(?U)\s+", " ")


def title_case(value: Column | str) -> Column:
    """Every run of letters begins with a capital, whatever stands before it."""
    runs = F.regexp_extract_all(_col(value), F.lit(r"(?U)(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def _rate(distance: Column, reference: Column, hypothesis: Column) -> Column:
    """Errors a unit of the reference; the hypothesis' size if the reference is empty."""
    return F.when(reference == 0, hypothesis.cast("double")).otherwise(distance / reference)


def cer(reference: Column | str, hypothesis: Column | str) -> Column:
    """Character error rate."""
    a, b = (strip(F.coalesce(_col(x), F.lit(""))) for x in (reference, hypothesis))
    return _rate(F.levenshtein(a, b), F.length(a), F.length(b))


def wer(reference: Column | str, hypothesis: Column | str) -> Column:
    """Word error rate: each distinct word of the pair becomes one character, then edit distance.

    Characters from U+1000 on, without the surrogates: room for a million distinct words.
    """
    def words(x):
        return F.filter(F.split(strip(F.coalesce(_col(x), F.lit(""))), r"(?U)\s+"), lambda w: w != "")

    a, b = words(reference), words(hypothesis)
    known = F.array_union(a, b)

    def code(w):
        at = F.array_position(known, w) + 0x1000
        at = F.when(at >= 0xD800, at + 0x800).otherwise(at)
        return F.decode(F.unhex(F.lpad(F.hex(at), 8, "0")), "UTF-32")

    text = lambda x: F.array_join(F.transform(x, code), "")
    return _rate(F.levenshtein(text(a), text(b)), F.size(a), F.size(b))


def comparable(value: Column | str, normalized: bool = True, name: Column | None = None) -> Column:
    """What ``agree`` compares of a field's value, parsed once: struct<text, amount, date>; with a name, amount and date where it calls for them."""
    v = _col(value)
    if not normalized:
        return F.struct(strip(v).alias("text"), F.lit(None).cast("double").alias("amount"), F.lit(None).cast("string").alias("date"))
    of = lambda names, x: x if name is None else F.when(name.isin(*names), x)
    amount, date = of(AMOUNT_FIELDS, parse_amount(v)), of(DATE_FIELDS, index_date(v).cast("string"))
    return F.struct(normalize_text(v).alias("text"), amount.alias("amount"), date.alias("date"))


def agree(name: Column, a: Column, b: Column) -> Column:
    """Whether two ``comparable`` values, not NULL, agree: as amount, date or text by the field's name."""
    return (
        F.when(name.isin(*AMOUNT_FIELDS) & a["amount"].isNotNull() & b["amount"].isNotNull(), F.abs(a["amount"] - b["amount"]) <= 0.01)
        .when(name.isin(*DATE_FIELDS) & a["date"].isNotNull() & b["date"].isNotNull(), a["date"] == b["date"])
        .otherwise(a["text"] == b["text"])
    )


def fields_match(name: Column | str, truth: Column | str, predicted: Column | str, normalized: bool = True) -> Column:
    """Whether two values of a field agree: both NULL, or equal as amount, date or text by its name."""
    a, b = _col(truth), _col(predicted)
    same = agree(_col(name), comparable(a, normalized), comparable(b, normalized))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(same)


def valid_field(name: Column | str, value: Column | str) -> Column:
    return _col(name).rlike(FIELD_NAME) & (F.length(_col(value)) <= MAX_VALUE_CHARS)
