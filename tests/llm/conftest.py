import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def documents(spark):
    """The documents, with a null text, an empty one, a null key and a repeated row besides, and a column of a clashing name."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "src0", 0), (None, "a b <|endoftext|>  c's", "en", None, 3), (-3, "word " * 3000, "en", "src0", 15000), (-4, " \t\n", "en", "src0", 3), (-4, " \t\n", "en", "src0", 3)], docs.schema)
    return docs.unionByName(more).withColumn("ids", docs["doc_id"].cast("string")).cache()
