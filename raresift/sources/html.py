"""Tables inside raw pages, extracted with JVM string functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from raresift.functions.text import clean_scalar


def list_cells(pages: DataFrame) -> DataFrame:
    """One row per link item of a page: position, target and cleaned text."""
    items = F.regexp_extract_all("html", F.lit(r"(?s)<li><a href=\"([^\"]*)\">(.*?)</a></li>"), F.lit(0))
    cells = pages.select("page_id", F.posexplode(items).alias("position", "cell"))
    return cells.select(
        "page_id",
        "position",
        F.regexp_extract("cell", r"href=\"([^\"]*)\"", 1).alias("target"),
        clean_scalar(F.regexp_replace(F.regexp_replace("cell", "<[^>]*>", ""), "&amp;", "&")).alias("text"),
    )


def largest_table(pages: DataFrame) -> DataFrame:
    """Rows and cells of the table with most rows on each page.

    Every table is a string of the page, so one row's work stays within the
    size of its own page.
    """
    tables = F.regexp_extract_all("html", F.lit(r"(?is)<table.*?</table>"), F.lit(0))
    rows_of = lambda table: F.regexp_extract_all(table, F.lit(r"(?is)<tr.*?</tr>"), F.lit(0))
    sized = F.transform(tables, lambda x: F.struct(F.size(rows_of(x)).alias("n"), rows_of(x).alias("rows")))
    biggest = F.try_element_at(F.sort_array(sized, asc=False), F.lit(1))
    picked = pages.select("page_id", F.posexplode(biggest["rows"]).alias("row_no", "row"))
    cells = picked.select(
        "page_id", "row_no",
        F.posexplode(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))).alias("col_no", "cell"),
    )
    text = clean_scalar(F.regexp_replace("cell", "<[^>]*>", ""))
    return cells.select("page_id", "row_no", "col_no", text.alias("text"), text.try_cast("double").alias("number"))


def page_version(pages: DataFrame, pattern: str) -> DataFrame:
    """Version string found by ``pattern``, 'unknown' where there is none."""
    found = F.nullif(F.regexp_extract("html", pattern, 0), F.lit(""))
    return pages.select(
        "page_id", F.coalesce(F.regexp_replace(found, r"\s+", " "), F.lit("unknown")).alias("version")
    )
