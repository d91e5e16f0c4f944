"""Query 1: edit-embedding fingerprints of the documents."""

from .catalog import query
from .common import table
from .edit_embedding import fingerprints_in_order


@query("op1_edit_embedding")
def op1_edit_embedding(spark, folder):
    return fingerprints_in_order(table(spark, folder, "documents"))
