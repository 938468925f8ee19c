"""Query of the BPE codec. SQL cannot express it; the tests hold it against the tokenizers library."""

from batchwatch.llm import bpe
from batchwatch.llm.common import table


def op10_bpe_codec(spark, sf_dir):
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents")))


QUERIES = {"op10_bpe_codec": op10_bpe_codec}
