"""Runs queries of the entry point in a session without any configured folder: ``plain_session.py SF_DIR QUERY...``."""

import sys

from pyspark.sql import SparkSession

import __spark_entry__ as contract

if __name__ == "__main__":
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    assert not spark.conf.get("spark.checkpoint.dir", None)
    for name in sys.argv[2:]:
        print(name, contract.queries()[name](spark, sys.argv[1]).count())
