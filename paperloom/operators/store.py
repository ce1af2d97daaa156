"""Results as tables: index rows, field rows, line items, upsert, corrections, search and analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.scalars import index_date, parse_amount, valid_field
from paperloom.operators.validate import validate

SEARCH_COLUMNS = ("doc_id", "filename", "doc_type", "vendor", "doc_date", "total_amount", "needs_review", "created_at")
MAX_PAGE = 100


def index_rows(results: DataFrame) -> DataFrame:
    """The summary row of each result: vendor (merchant only where there is no vendor key), date, amount, JSON."""
    entry = lambda n: F.try_element_at("fields", F.lit(n))["value"]
    vendor = F.when(F.map_contains_key("fields", F.lit("vendor")), entry("vendor")).otherwise(entry("merchant"))
    body = F.struct(*(c for c in results.columns if c not in ("created_at", "lines", "file_path", "content_type")))
    return results.withColumns({
        "vendor": vendor, "doc_date": index_date(entry("date")), "total_amount": F.round(parse_amount(entry("total")), 2),
        "result_json": F.to_json(body, {"ignoreNullFields": "false"}),
    })


def field_rows(results: DataFrame) -> DataFrame:
    """(doc_id, name, value, confidence). Outer generators, here and below: the others repeat their input's expressions in filters."""
    return results.select("doc_id", F.explode_outer("fields").alias("name", "f")).where("name is not null").select(
        "doc_id", "name", F.col("f.value").alias("value"), F.col("f.conf").alias("confidence")
    )


def line_item_rows(results: DataFrame) -> DataFrame:
    """(doc_id, table_index, row_index, data): cells by header, the last of equal headers; the shorter side decides."""
    tables = results.select("doc_id", F.posexplode_outer("tables").alias("table_index", "t")).where("table_index is not null")
    apart = F.size(F.array_compact(F.array_distinct("t.headers"))) == F.size("t.headers")  # the rule: no header twice, none NULL
    tables = tables.select("doc_id", "table_index", F.col("t.headers").alias("h"), apart.alias("apart"), F.col("t.rows").alias("rows"))
    rows = tables.select("doc_id", "table_index", "h", "apart", F.posexplode_outer("rows").alias("row_index", "r")).where("row_index is not null")
    n = F.least(F.size("h"), F.size("r"))
    first = lambda c: F.when(F.size(c) == n, F.col(c)).otherwise(F.slice(c, 1, n)).alias(c)
    rows = rows.select("doc_id", "table_index", "row_index", "apart", first("h"), first("r"))
    last = F.filter(
        F.arrays_zip("h", "r"), lambda c, i: ~F.array_contains(F.slice(F.col("h"), i + 2, F.size("h") + 1), c["h"])
    )
    return rows.select("doc_id", "table_index", "row_index", F.when(F.col("apart"), F.map_from_arrays("h", "r")).otherwise(F.map_from_entries(last)).alias("data"))


def upsert(stored: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """stored with the rows of new in place of those with the same key; created_at and unset file columns are kept."""
    kept = [c for c in ("created_at", "file_path", "content_type") if c in stored.columns]
    old = stored.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in kept))
    merged = new.join(old, new[key] == old["_k"], "left")
    pick = {
        c: (F.coalesce(f"_{c}", c) if c == "created_at" else F.coalesce(c, f"_{c}")) if c in new.columns else F.col(f"_{c}")
        for c in kept
    }
    merged = merged.withColumns(pick).select(*stored.columns)
    return stored.join(new.select(key), key, "left_anti").select(*stored.columns).unionByName(merged)


def correct(results: DataFrame, corrections: DataFrame, as_of: str, compat: bool = False) -> DataFrame:
    """Corrected and re-validated results; corrections: (doc_id, name, value), the last value of a name by text wins.

    Only results that have a correction are returned. Corrected values get confidence 1.0 and keep
    their box. Bad names or values raise when the result is computed. compat validates every
    document as an invoice without tables.
    """
    good = F.when(valid_field("name", "value"), F.col("value")).otherwise(F.raise_error(F.lit("bad field name or value")))
    per = corrections.groupBy("doc_id", "name").agg(F.max(good).alias("v"))
    per = per.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("_fix"))
    joined = results.join(per, "doc_id")
    fixed = F.transform_values(
        "_fix",
        lambda k, v: F.struct(v.alias("value"), F.lit(1.0).alias("conf"), F.try_element_at(F.col("fields"), k)["bbox"].alias("bbox")),
    )
    joined = joined.withColumn("_new", fixed)
    joined = joined.withColumn("fields", F.map_concat(F.map_filter("fields", lambda k, v: ~F.map_contains_key("_fix", k)), "_new"))
    out = joined.select(*results.columns)
    if not compat:
        return validate(out, as_of)
    kept = out.withColumns({"_type": F.col("doc_type"), "_tables": F.col("tables"), "doc_type": F.lit("invoice"), "tables": F.slice("tables", 1, 0)})
    return validate(kept, as_of).withColumns({"doc_type": F.col("_type"), "tables": F.col("_tables")}).drop("_type", "_tables")


def point_lookup(index: DataFrame, doc_id: str) -> DataFrame:
    return index.where(F.col("doc_id") == doc_id)


def _checked(limit: int, offset: int, dates: tuple, amounts: tuple) -> None:
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be 1 to {MAX_PAGE}, offset 0 or more")
    for low, high in (dates, amounts):
        if low is not None and high is not None and low > high:
            raise ValueError("a range ends before it begins")


def matching(
    index: DataFrame, q: str | None = None, doc_type: str | None = None, needs_review: bool | None = None,
    vendor: str | None = None, date_from: str | None = None, date_to: str | None = None,
    min_amount: float | None = None, max_amount: float | None = None,
) -> DataFrame:
    """The rows that pass all given filters; None and empty texts don't filter.

    vendor and q find parts, whatever their case, % and _ being wildcards; q looks into the whole
    JSON. Bounds are inclusive.
    """
    _checked(1, 0, (date_from or None, date_to or None), (min_amount, max_amount))
    tests: list[Column] = []
    if doc_type:
        tests.append(F.col("doc_type") == doc_type)
    if needs_review is not None:
        tests.append(F.col("needs_review") == needs_review)
    tests += [F.col(c).ilike(f"%{x}%") for c, x in (("vendor", vendor), ("result_json", q)) if x]
    tests += [F.col("doc_date") >= date_from] * bool(date_from) + [F.col("doc_date") <= date_to] * bool(date_to)
    tests += [F.col("total_amount") >= min_amount] if min_amount is not None else []
    tests += [F.col("total_amount") <= max_amount] if max_amount is not None else []
    for t in tests:
        index = index.where(t)
    return index


def search(index: DataFrame, limit: int = 20, offset: int = 0, **filters) -> DataFrame:
    """One page, newest first: a single top-k."""
    _checked(limit, offset, (None, None), (None, None))
    rows = matching(index, **filters).select(*SEARCH_COLUMNS)
    return rows.orderBy(F.desc("created_at"), F.desc("doc_id")).offset(offset).limit(limit)


def search_total(index: DataFrame, **filters) -> DataFrame:
    return matching(index, **filters).agg(F.count("*").alias("total"))


def kpis(index: DataFrame) -> DataFrame:
    """total, needs_review, stp, stp_rate (100.0 for an empty index) and volume, in one aggregation."""
    n, review = F.count("*"), F.count_if("needs_review")
    rate = F.when(n == 0, 100.0).otherwise(F.round(100.0 * (n - review) / n, 2))
    return index.agg(
        n.alias("total"), review.alias("needs_review"), (n - review).alias("stp"), rate.alias("stp_rate"),
        F.round(F.coalesce(F.sum(F.col("total_amount").cast("double")), F.lit(0.0)), 2).alias("volume"),
    )


def type_distribution(index: DataFrame) -> DataFrame:
    return index.groupBy("doc_type").agg(F.count("*").alias("n"))


def top_vendors(index: DataFrame, k: int = 5) -> DataFrame:
    """The k vendors with most documents, empty names dropped afterwards; ties by name."""
    per = index.where("vendor is not null").groupBy("vendor").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("total_amount").cast("double")), 2).alias("volume")
    )
    return per.orderBy(F.desc("n"), "vendor").limit(k).where("vendor <> ''")
