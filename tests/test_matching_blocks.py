from pyspark.sql import functions as F

from tamarisk.operators import matching
from tamarisk.operators.name_join import candidates


def test_words_of_many_catalogue_rows_still_block(spark):
    ours = spark.range(2100).select(F.col("id").alias("our_id"), F.concat(F.lit("velvet amber "), F.col("id") + 100000).alias("name"))
    theirs = spark.createDataFrame([(1, "velvet amber")], "offer_id long, name string")
    got = candidates(matching.featured(theirs, "name"), matching.featured(ours, "name"))
    assert got.count() == matching.featured(ours, "name").select("bare").distinct().count()
