"""Query 2: repeated passages of the documents."""

from .catalog import query
from .chunk_dedup import passage_report
from .common import table


@query("op2_chunk_dedup")
def op2_chunk_dedup(spark, folder):
    return passage_report(table(spark, folder, "documents"))
