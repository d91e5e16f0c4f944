"""Query 9: byte strings of the documents that occur twice."""

from .catalog import query
from .common import table
from .substring_dedup import substring_report


@query("op9_substring_dedup")
def op9_substring_dedup(spark, folder):
    return substring_report(table(spark, folder, "documents"))
