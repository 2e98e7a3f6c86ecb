"""Numbered headings of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import headings as H


def counters(headings: DataFrame, doc: str = "doc_id", order: str = "pos", level: str = "level", continuous: bool = True) -> DataFrame:
    """headings (doc, pos, level in section/subsection) with section and subsection numbers.

    Subsection numbers run on over sections, or start anew in each.
    """
    so_far = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = headings.withColumn("section", F.count_if(F.col(level) == "section").over(so_far).cast("int"))
    within = so_far if continuous else Window.partitionBy(doc, "section").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("subsection", F.count_if(F.col(level) == "subsection").over(within).cast("int"))


def styled(headings: DataFrame, options, xetex, title: str = "title", level: str = "level") -> DataFrame:
    """headings with their layout, title font, symbol, letter space and shown title under style options (map<string,string>)."""
    place = H.layout(options)
    shown = F.when(place == "inline", H.inline_title(F.col(title), options)).when(place == "evans", H.evans_title(F.col(title), F.col(level), options)).when(place == "centred", H.centred_title(F.col(title), F.col(level))).otherwise(F.col(title))
    return headings.select("*", place.alias("layout"), H.title_font(options, xetex).alias("font"), H.title_symbol(options).alias("symbol"), H.letter_space(options, xetex).alias("letter_space"), shown.alias("shown"))


def layout_rows(spark) -> DataFrame:
    """The four heading layouts as rows."""
    schema = "layout string, section_shape string, section_number string, section_font string, subsection_shape string, subsection_font string, continuous boolean"
    return spark.createDataFrame([(k, *v) for k, v in H.LAYOUTS.items()], schema)


def numbered(headings: DataFrame, layouts: DataFrame, section_font=None) -> DataFrame:
    """headings (layout, level, title, section, subsection) as their layouts show them; a font that is set takes the place of the layout's own."""
    met = headings.join(F.broadcast(layouts), "layout")
    section = F.when(F.col("section_number") == "Roman", H.roman(F.col("section"))).otherwise(F.col("section").cast("string"))
    number = F.when(F.col("level") == "section", F.when(F.col("layout").isin("newdisplay", "newhempel"), F.concat(section, F.lit("."))).otherwise(section)).otherwise(F.concat(F.col("subsection").cast("string"), F.lit(".")))
    runs_in = ((F.col("layout") == "newhempel") & (F.col("level") == "section")) | ((F.col("layout") == "newevanshempel") & (F.col("level") == "subsection"))
    font = F.when(F.col("level") == "section", F.coalesce(section_font if section_font is not None else F.lit(None).cast("string"), "section_font")).otherwise(F.col("subsection_font"))
    return met.select(*headings.columns, number.alias("number"), F.when(runs_in, H.heading_end(F.col("title"))).otherwise(F.col("title")).alias("shown"), font.alias("font"))
