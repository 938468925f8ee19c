"""Query of the n-gram Jaccard join. All pairs in SQL are too slow; the tests compare with brute force."""

from batchwatch.llm import jaccard_join
from batchwatch.llm.common import table


def op9_ngram_jaccard(spark, sf_dir):
    return jaccard_join.join(table(spark, sf_dir, "documents"))


QUERIES = {"op9_ngram_jaccard": op9_ngram_jaccard}
