"""Raw records of the four sources, as JSON text or XML, to candidate rows (PRJ1 to PRJ5, SRC8, SRC9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPENALEX = "id string, title string, display_name string, publication_year int, doi string, authorships array<struct<author: struct<display_name: string>, institutions: array<struct<display_name: string, country_code: string>>>>, primary_location struct<landing_page_url: string, source: struct<display_name: string, host_organization_name: string, issn: array<string>>>, abstract_inverted_index map<string, array<int>>"
CROSSREF = "DOI string, title array<string>, author array<struct<given: string, family: string>>, issued struct<`date-parts`: array<array<int>>>, ISSN array<string>, URL string, abstract string"
PUBMED = "uid string, title string, authors array<struct<name: string>>, articleids array<struct<idtype: string, value: string>>, pubdate string, issn string, essn string"
DUBLIN_CORE = "identifier string, titles array<string>, creators array<string>, dates array<string>, identifiers array<string>, descriptions array<string>"

COLUMNS = ["source_adapter", "source_record_id", "title", "authors", "year", "doi", "pmid", "pmcid", "issn", "url", "abstract"]


def text_of_index(index: Column) -> Column:
    """PRJ2: an inverted index {word: [positions]} as text; of words at one position the last one counts."""
    spots = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(spots), lambda s: s["word"]), " ")


def index_of_text(text: str) -> Column:
    """The inverted index {word: [positions]} of a SQL expression's blank-separated words, made within its row; null for null."""
    starts = "filter(sequence(1, size(x)), i -> i = 1 OR x[i - 1].word <> x[i - 2].word)"
    places = "transform(slice(x, b, coalesce(get(s, j + 1), size(x) + 1) - b), w -> w.at)"
    entries = f"transform(array({starts}), s -> transform(s, (b, j) -> named_struct('word', x[b - 1].word, 'at', {places})))[0]"
    words = f"sort_array(transform(split({text}, ' '), (w, i) -> named_struct('word', w, 'at', i)))"
    return F.expr(f"CASE WHEN {text} IS NOT NULL THEN map_from_entries(transform(array({words}), x -> {entries})[0]) END")


def _full(value: Column) -> Column:
    return F.when(value != "", value)


def _read(raw: DataFrame, payload: str, schema: str, keep: Sequence[str]) -> DataFrame:
    return raw.select(*[F.col(c).alias(f"keep_{c}") for c in keep], F.from_json(payload, schema).alias("r")).select(*[f"keep_{c}" for c in keep], "r.*")


def _shape(frame: DataFrame, adapter: str, record: Column, **columns: Column) -> DataFrame:
    """Rows without a native id make no candidate (PRJ6, PRJ7); columns that were asked to be kept come first."""
    kept = [F.col(c).alias(c.removeprefix("keep_")) for c in frame.columns if c.startswith("keep_")]
    null = F.lit(None).cast("string")
    listed = {"source_adapter": F.lit(adapter), "source_record_id": record, **columns}
    return frame.filter(record.isNotNull() & (F.trim(record) != "")).select(*kept, *[listed.get(c, null).alias(c) for c in COLUMNS])


def openalex(raw: DataFrame, payload: str = "raw", keep: Sequence[str] = ()) -> DataFrame:
    r = _read(raw, payload, OPENALEX, keep)
    names = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: n != "")
    return _shape(
        r, "OPENALEX", F.col("id"), title=F.coalesce(_full(F.col("title")), F.col("display_name"), F.lit("")), authors=F.coalesce(names, F.array().cast("array<string>")),
        year=F.col("publication_year"), doi=F.regexp_replace("doi", r"^https://doi\.org/", ""), issn=F.get("primary_location.source.issn", F.lit(0)),
        url=F.coalesce(_full(F.col("primary_location.landing_page_url")), F.col("id")), abstract=text_of_index(F.col("abstract_inverted_index")),
    )


def crossref(raw: DataFrame, payload: str = "raw", keep: Sequence[str] = ()) -> DataFrame:
    r = _read(raw, payload, CROSSREF, keep)
    names = F.filter(F.transform("author", lambda a: F.concat_ws(" ", _full(a["given"]), _full(a["family"]))), lambda n: n != "")
    return _shape(
        r, "CROSSREF", F.col("DOI"), title=F.coalesce(F.get("title", F.lit(0)), F.lit("")), authors=F.coalesce(names, F.array().cast("array<string>")),
        year=F.get(F.get("issued.date-parts", F.lit(0)), F.lit(0)), doi=F.col("DOI"), issn=F.get("ISSN", F.lit(0)), url=F.col("URL"), abstract=F.col("abstract"),
    )


def pubmed(raw: DataFrame, payload: str = "raw", keep: Sequence[str] = ()) -> DataFrame:
    r = _read(raw, payload, PUBMED, keep)
    last = lambda kind: F.try_element_at(F.filter("articleids", lambda a: (a["idtype"] == kind) & (a["value"] != "")), F.lit(-1))["value"]
    names = F.filter(F.transform("authors", lambda a: a["name"]), lambda n: n != "")
    return _shape(
        r, "PUBMED", F.col("uid"), title=F.coalesce("title", F.lit("")), authors=F.coalesce(names, F.array().cast("array<string>")),
        year=F.expr(r"try_cast(regexp_extract(pubdate, '^\\s*(\\d+)(\\s|$)', 1) as int)"), doi=last("doi"), pmid=F.col("uid"), pmcid=last("pmc"),
        issn=F.coalesce(_full(F.col("issn")), F.col("essn")), url=F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "uid", F.lit("/")),
    )


def dublin_core(raw: DataFrame, payload: str = "raw", keep: Sequence[str] = ()) -> DataFrame:
    """Harvested records: the last DOI and the first other link of the identifiers count."""
    r = _read(raw, payload, DUBLIN_CORE, keep)
    is_doi = lambda x: F.contains(F.lower(x), F.lit("doi.org")) | F.startswith(F.lower(x), F.lit("10."))
    doi = F.try_element_at(F.filter("identifiers", is_doi), F.lit(-1))
    link = F.get(F.filter("identifiers", lambda x: F.startswith(F.lower(x), F.lit("http")) & ~is_doi(x)), F.lit(0))
    years = F.filter(F.transform("dates", lambda x: F.substring(x, 1, 4)), lambda y: y.rlike(r"^\d+$"))
    return _shape(
        r, "THAIJO", F.col("identifier"), title=F.coalesce(F.get("titles", F.lit(0)), F.lit("")), authors=F.coalesce("creators", F.array().cast("array<string>")),
        year=F.get(years, F.lit(0)).cast("int"), doi=F.when(F.contains(F.lower(doi), F.lit("doi.org")), F.substring_index(doi, "doi.org/", -1)).otherwise(doi),
        url=link, abstract=F.get("descriptions", F.lit(0)),
    )


#: An OAI-PMH page, with the fields of Dublin Core beneath the metadata or a wrapper of theirs; prefixes of names don't count.
_DC = ", ".join(f"{name} array<string>" for name in ("title", "creator", "date", "identifier", "description", "source"))
OAI_PAGE = f"error array<struct<_code: string, _VALUE: string>>, ListRecords struct<record: array<struct<header: struct<identifier: string>, metadata: struct<dc: struct<{_DC.replace(' array', ': array')}>, {_DC.replace(' array', ': array')}>>>, resumptionToken: string>, resumptionToken string, _corrupt string"


def oai_records(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """SRC8: the Dublin Core records of OAI-PMH pages, with each page's state and token; one row, without a record, for a page that has none.

    state is PARSER_ERROR for what isn't XML (or null), for a page without a list of records and for a protocol error, NOT_FOUND
    for noRecordsMatch, else null. Records without an identifier are left out; empty elements are empty texts; what follows the root element is ignored.
    """
    page = F.from_xml(F.coalesce(F.col(xml), F.lit("")), OAI_PAGE, {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreSurroundingSpaces": "true"})
    own = pages.withColumn("_page", page)
    code, bad = F.get("_page.error", F.lit(0))["_code"], F.col("_page._corrupt").isNotNull() | F.col("_page").isNull()
    state = F.when(bad, "PARSER_ERROR").when(code == "noRecordsMatch", "NOT_FOUND").when(F.col("_page.error").isNotNull() | F.col("_page.ListRecords").isNull(), "PARSER_ERROR")
    own = own.withColumn("state", state)
    good = lambda x: F.when(F.col("state").isNull(), x)
    listed = F.filter("_page.ListRecords.record", lambda r: F.coalesce(r["header"]["identifier"], F.lit("")) != "")
    token = F.trim(F.coalesce("_page.ListRecords.resumptionToken", "_page.resumptionToken"))  # some servers put it behind the list
    cut = own.select(*pages.columns, "state", good(F.when(token != "", token)).alias("token"), F.explode_outer(good(listed)).alias("_record"))
    part = lambda name: F.transform(F.coalesce(F.col(f"_record.metadata.dc.{name}"), F.col(f"_record.metadata.{name}"), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")))
    names = {"identifier": "identifiers", "title": "titles", "creator": "creators", "date": "dates", "description": "descriptions", "source": "sources"}
    return cut.select(*pages.columns, "state", "token", F.col("_record.header.identifier").alias("identifier"), *[F.when(F.col("_record").isNotNull(), part(k)).alias(v) for k, v in names.items()])


def http_state(status: Column, exception: Column, body: Column) -> Column:
    """SRC9: what a call's outcome says; null where it brought records."""
    return (
        F.when(exception.isin("timeout", "connection") | (status >= 500), "TIMEOUT").when(status == 429, "RATE_LIMITED").when(status.isin(401, 403), "ACCESS_DENIED")
        .when((status != 200) | body.isin("bad_json", "missing_field", "no_id"), "PARSER_ERROR").when(body == "empty", "NOT_FOUND")
    )
