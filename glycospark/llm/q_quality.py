"""Query 10: quality scores of the documents."""

from .catalog import query
from .common import table
from .quality import classify


@query("op10_quality_classifier")
def op10_quality_classifier(spark, folder):
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
