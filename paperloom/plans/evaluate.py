"""Evaluation of the pipeline on a folder of labels: ``python -m paperloom.plans.evaluate --labels-dir DIR``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from paperloom.operators import metrics
from paperloom.plans.process import process
from paperloom.sources.documents import read_labels, read_uploads
from paperloom.sources.ocr import recognise


def predictions(spark: SparkSession, truth: DataFrame, samples: str | None, as_of: str) -> DataFrame:
    """Results for every label: its sample file's tokens where there is one, else its own."""
    docs = truth.select("doc_id", "filename", "ocr")
    if samples:
        files, _ = read_uploads(spark, samples)
        found = recognise(files).select("filename", "ocr").withColumnRenamed("ocr", "seen")
        docs = docs.join(found, "filename", "left").selectExpr("doc_id", "filename", "coalesce(seen, ocr) AS ocr")
    return process(docs, as_of)


def main(args: list[str] | None = None) -> str:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--labels-dir", required=True)
    parser.add_argument("--samples-dir")
    parser.add_argument("--as-of", required=True, help="dates after this day are in the future")
    parser.add_argument("--report", help="a Markdown file to write")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    truth = read_labels(spark, given.labels_dir)
    text = metrics.report(truth, predictions(spark, truth, given.samples_dir, given.as_of))
    if given.report:
        with open(given.report, "w", encoding="utf-8") as out:
            out.write(f"# Evaluation\n\n```\n{text}\n```\n")
    return text


if __name__ == "__main__":
    print(main())
