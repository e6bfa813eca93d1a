"""Tags that tie a record to Thailand, by its texts, its places and its authors' institutions (CLS1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.functions import rules
from admitflow.functions.dialect import SPARK
from admitflow.plans.shared import free_name

#: The parts of a raw record that tell where it was published; all else is never parsed.
PLACES = """primary_location struct<landing_page_url: string, source: struct<host_organization_name: string, display_name: string>>,
  authorships array<struct<institutions: array<struct<country_code: string, display_name: string>>>>"""


def _venue(url: str, place: str) -> tuple[Column, Column]:
    """(lower-cased names of the record's places, whether an institution is in Thailand) of a column parsed by PLACES."""
    at = F.col(f"{place}.primary_location")
    homes = F.flatten(F.filter(F.transform(f"{place}.authorships", lambda a: a["institutions"]), lambda i: i.isNotNull()))
    names = F.array_join(F.transform(homes, lambda i: i["display_name"]), " ")
    blob = F.concat_ws(" ", url, at["landing_page_url"], at["source"]["host_organization_name"], at["source"]["display_name"], names)
    return F.lower(blob), F.coalesce(F.exists(homes, lambda i: F.upper(i["country_code"]) == "TH"), F.lit(False))


def tag(records: DataFrame, into: str = "tags") -> DataFrame:
    """records (title, abstract, url, raw_metadata as JSON) with an array `into` of up to four tags, in a fixed order.

    Null texts are empty; metadata that is null, broken or of another shape gives no place. A column that is called `into`
    already is an error; all other columns stay.
    """
    if into.lower() in (c.lower() for c in records.columns):
        raise ValueError(f"the table has a column {into} already")
    place, text, venue, home = (free_name(n, records.columns) for n in ("_place", "_text", "_venue", "_home"))
    read = records.withColumns({place: F.from_json("raw_metadata", PLACES), text: F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))})
    blob, thai = _venue("url", place)
    read = read.withColumns({venue: blob, home: thai})
    return read.withColumn(into, F.expr(rules.relevance_tags(SPARK, text, venue, home))).drop(place, text, venue, home)
