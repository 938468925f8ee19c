"""Query of the benchmark search. SQL cannot express it; the tests hold it against shared word runs."""

from batchwatch.llm import decontaminate
from batchwatch.llm.common import table


def op7_benchmark_leaks(spark, sf_dir):
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_benchmark_leaks": op7_benchmark_leaks}
