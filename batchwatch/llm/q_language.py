"""Query of the language identification, a fitted model; the tests measure held-out accuracy."""

from batchwatch.llm import language
from batchwatch.llm.common import table


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


QUERIES = {"op5_language_id": op5_language_id}
