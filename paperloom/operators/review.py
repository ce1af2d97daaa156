"""What a review screen shows: fields by relevance, their status, changed and confirmed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.store import field_rows

#: The fields that matter for each type.
RELEVANT = {
    "invoice": ("invoice_no", "date", "vendor", "customer", "subtotal", "tax", "total", "gstin", "payment_method"),
    "receipt": ("receipt_no", "date", "merchant", "vendor", "total", "subtotal", "tax", "payment_method"),
    "certificate": ("certificate_id", "title", "awarded_to", "issuer", "date"),
    "form": ("name", "applicant_name", "date_of_birth", "date", "address", "phone", "email"),
}


def status(value: Column, conf: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", "empty").when(conf < 0.6, "low").otherwise("ok")


def review_fields(results: DataFrame) -> DataFrame:
    """(doc_id, name, value, status, rank): relevant or filled fields, relevant ones first, then by name.

    merchant is left out where it equals vendor.
    """
    rows = field_rows(results).join(results.select("doc_id", "doc_type", F.col("fields")["vendor"]["value"].alias("v")), "doc_id")
    relevant = F.lit(False)
    for kind, names in RELEVANT.items():
        relevant = relevant | ((F.col("doc_type") == kind) & F.col("name").isin(*names))
    filled = F.coalesce("value", F.lit("")) != ""
    same = (F.col("name") == "merchant") & F.col("value").eqNullSafe(F.col("v")) & F.col("v").isNotNull()
    rows = rows.withColumn("relevant", relevant).where((F.col("relevant") | filled) & ~same)
    order = F.struct((~F.col("relevant")).cast("int").alias("a"), F.col("name").alias("b"))
    rows = rows.withColumn("o", order)
    ranked = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("o", "name", "value", "confidence"))).alias("f"))
    return ranked.select("doc_id", F.posexplode("f").alias("rank", "x")).select(
        "doc_id", F.col("x.name").alias("name"), F.col("x.value").alias("value"), status(F.col("x.value"), F.col("x.confidence")).alias("status"), "rank"
    )


def changed(before: Column, after: Column) -> Column:
    """Of a map of edited values, those that differ from the stored fields' values."""
    return F.map_filter(after, lambda k, v: ~v.eqNullSafe(F.coalesce(F.try_element_at(before, k)["value"], F.lit(""))))


def confirm(results: DataFrame) -> DataFrame:
    """(doc_id, name, value): a correction of every shown, filled field to its own value."""
    return review_fields(results).where("value <> ''").select("doc_id", "name", "value")


def filter_state(doc_type: str, review: str, min_amount: float, max_amount: float, page: int, limit: int) -> dict:
    """Search parameters of the screen's controls: "(all)" and amounts up to 0 don't filter."""
    return {
        "doc_type": None if doc_type == "(all)" else doc_type,
        "needs_review": {"(all)": None, "yes": True, "no": False}[review],
        "min_amount": min_amount if min_amount > 0 else None, "max_amount": max_amount if max_amount > 0 else None,
        "limit": limit, "offset": (page - 1) * limit,
    }


def list_label(vendor: Column, filename: Column, amount: Column) -> Column:
    return F.concat_ws(" - ", F.coalesce(vendor, filename), F.format_string("%,.2f", amount))
