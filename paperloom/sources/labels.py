"""Folders of label files: the library's own format and three public ones, a row a file, bad files as rows of their own.

Files are read by Spark's text source, many small ones a task. ``names`` is a filter on ``_metadata.file_name``, which
Spark applies to its list of files: what it leaves out is never opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.fields import FIELD
from paperloom.operators.layout import TOKENS
from paperloom.operators.lineitems import TABLES
from paperloom.operators.validate import RESULTS
from paperloom.sources.documents import LABEL, from_cord, from_funsd, from_sroie

#: The types that a label may have.
TYPES = ("invoice", "receipt", "form", "certificate", "unknown")
ADAPTERS = {"sroie": from_sroie, "cord": from_cord, "funsd": from_funsd}
COLUMNS = ("doc_id", "filename", "doc_type", "doc_type_conf", "ocr", "fields", "tables", "validation", "needs_review")


def files(spark: SparkSession, folder: str, names: Column | None = None) -> DataFrame:
    """(file, stem, json) of the folder's JSON files. names: a condition on ``_metadata.file_name``."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    rows = rows.where(names) if names is not None else rows
    name = F.col("_metadata.file_name")
    return rows.select(name.alias("file"), F.regexp_replace(name, r"\.json$", "").alias("stem"), F.col("value").alias("json"))


def _own(rows: DataFrame) -> DataFrame:
    """rows with the parsed label as ``d``: what is missing gets its default."""
    made = rows.withColumn("d", F.from_json("json", LABEL + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    default = {
        "doc_id": F.lit(None).cast("string"), "filename": F.lit(""), "doc_type": F.lit("unknown"), "doc_type_conf": F.lit(0.0), "ocr": F.array().cast(TOKENS),
        "fields": F.create_map().cast(FIELD), "tables": F.array().cast(TABLES), "validation": F.array().cast(RESULTS), "needs_review": F.lit(False),
    }
    broken = F.col("d").isNull() | F.col("d._corrupt_record").isNotNull()
    return made.select("file", "stem", broken.alias("broken"), *(F.coalesce(F.col(f"d.{c}"), v).alias(c) for c, v in default.items()))


def _fault() -> Column:
    """Why a parsed label can't count, or NULL."""
    share = lambda x: x.isNotNull() & (x >= 0) & (x <= 1)
    box = F.forall("ocr", lambda t: F.coalesce((F.size(t["bbox"]) == 4) & F.forall(t["bbox"], lambda x: x.isNotNull()), F.lit(False)))
    sure = F.forall("ocr", lambda t: share(t["conf"])) & F.forall(F.map_values("fields"), lambda f: f["conf"].isNull() | share(f["conf"]))
    return (
        F.when(F.col("broken"), "not a label").when(F.col("doc_id").isNull(), "no doc_id").when(~F.col("doc_type").isin(*TYPES), "unknown type")
        .when(~F.forall("ocr", lambda t: t["text"].isNotNull()), "a token without text").when(~box, "a box without four numbers").when(~sure, "a confidence outside 0 to 1")
    )


def read(spark: SparkSession, folder: str, kind: str = "own", names: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels, rejected) of a folder. kind: ``own``, ``sroie``, ``cord`` or ``funsd``.

    labels: file, stem and the columns of a label. Public formats name no document: the stem is its doc_id, the file its
    filename. rejected: (file, reason); one bad file never spoils others. Files of no bytes hold no label and are in neither:
    Spark's scan leaves them out.
    """
    rows = files(spark, folder, names)
    if kind == "own":
        made = _own(rows).withColumn("reason", _fault())
    else:
        rows = rows.withColumn("reason", F.when(F.from_json("json", "map<string,string>").isNull() | ~F.col("json").rlike(r"^\s*\{"), "not an object"))
        good = rows.where("reason is null").select(F.col("stem").alias("doc_id"), F.col("file").alias("filename"), "json")
        made = ADAPTERS[kind](good).withColumns({"file": F.col("filename"), "stem": F.col("doc_id")})
        return made.select("file", "stem", *COLUMNS), rows.where("reason is not null").select("file", "reason")
    return made.where("reason is null").select("file", "stem", *COLUMNS), made.where("reason is not null").select("file", "reason")


def by_key(labels: DataFrame) -> DataFrame:
    """(key, label columns): each label under its file's stem and under its filename; of equal keys the last file counts."""
    keys = F.explode(F.array_distinct(F.array_compact(F.array("stem", F.nullif(F.col("filename"), F.lit(""))))))
    rows = labels.select(keys.alias("key"), "file", F.struct(*COLUMNS).alias("label"))
    return rows.groupBy("key").agg(F.max_by("label", "file").alias("label")).select("key", "label.*")
