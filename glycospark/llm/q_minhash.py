"""Query 3: near-duplicate classes of the documents."""

from .catalog import query
from .common import table
from .minhash import near_classes


@query("op3_minhash_classes")
def op3_minhash_classes(spark, folder):
    return near_classes(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")
