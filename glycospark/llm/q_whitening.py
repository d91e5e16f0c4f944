"""Query 12: whitened embeddings."""

from .catalog import query
from .common import table
from .whitening import whiten


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark, folder):
    return whiten(table(spark, folder, "embeddings"))
