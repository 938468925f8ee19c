"""Query of the secret scan. Spans by position are not expressible in SQL; the tests hold it against a plain regex loop."""

from batchwatch.llm import secrets
from batchwatch.llm.common import table


def op2_secret_scan(spark, sf_dir):
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


QUERIES = {"op2_secret_scan": op2_secret_scan}
