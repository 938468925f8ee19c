"""Query of the external shuffle. Its order is random by design, so SQL cannot give it; the tests check the law."""

from batchwatch.llm import shards
from batchwatch.llm.common import table
from pyspark.sql import functions as F

SHARDS, SEED = 24, 20240101


def op4_external_shuffle(spark, sf_dir):
    rows = shards.external_shuffle(table(spark, sf_dir, "documents"), SHARDS, SEED)
    return rows.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op4_external_shuffle": op4_external_shuffle}
