"""Query 4: main text of the pages."""

from .catalog import query
from .common import table
from .html_text import extract


@query("op4_html_extraction")
def op4_html_extraction(spark, folder):
    return extract(table(spark, folder, "pages"))
