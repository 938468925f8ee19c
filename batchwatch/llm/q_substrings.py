"""Query of the repeated-substring removal. Byte windows are out of SQL's reach; the tests compare with brute force."""

from batchwatch.llm import substrings
from batchwatch.llm.common import table
from pyspark.sql import functions as F


def op3_repeated_substrings(spark, sf_dir):
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op3_repeated_substrings": op3_repeated_substrings}
