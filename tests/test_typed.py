from paperloom.plans import typed


def test_typed_documents_are_dealt_to_all_cores(spark):
    parts = typed.typed_text(spark, "/root/testdata/sf0.001").rdd.getNumPartitions()
    assert parts == 4 * spark.sparkContext.defaultParallelism
