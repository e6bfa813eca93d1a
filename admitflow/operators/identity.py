"""Exact identity: candidates with a common key are one work, directly or through others (R3, R4, AGG1 to AGG4, GAT1 to GAT5, GAT9)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from admitflow.functions import rules
from admitflow.functions.dialect import SPARK
from admitflow.plans.components import connected_components
from admitflow.plans.shared import materialise, skew_lookup

#: Identifiers that merge candidates when they are equal.
IDENTIFIERS = ("doi", "pmid", "pmcid", "arxiv_id")
#: Candidate columns that may be missing from a table, and their types.
OPTIONAL = {name: "string" for name in (*IDENTIFIERS, "issn", "url", "abstract", "raw_metadata")}


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility forms made one; Spark has no built-in for it."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def even(name: str) -> Column:
    """A text in NFKC; only texts beyond ASCII go to Python."""
    odd = F.col(name).rlike(r"[^\x00-\x7F]")
    return F.coalesce(nfkc(F.when(odd, F.col(name))), F.col(name))


def whole(cand: DataFrame) -> DataFrame:
    """cand with every column of a candidate: missing ones null, `authors` from `author` or the other way round."""
    missing = {name: F.lit(None).cast(kind) for name, kind in OPTIONAL.items() if name not in cand.columns}
    cand = cand.withColumns(missing) if missing else cand
    if "authors" not in cand.columns:
        cand = cand.withColumn("authors", F.when(F.col("author").isNotNull(), F.array("author")))
    if "author" not in cand.columns:
        cand = cand.withColumn("author", F.get("authors", F.lit(0)))
    return cand if "even_title" in cand.columns else cand.withColumns({"even_title": even("title"), "even_author": even("author")})


def _keys() -> Column:
    """A key per identifier, and a bibliographic one where issn, title, year and first surname all exist."""
    ids = [F.concat(F.lit(f"{name}:"), F.expr(rules.merge_id(SPARK, name))) for name in IDENTIFIERS]
    title, first = F.expr(rules.title_key(SPARK, "even_title")), F.expr(f"nullif({rules.surname(SPARK, 'even_author')}, '')")
    bib = F.concat(F.lit("bib:"), F.trim("issn"), F.lit("|"), title, F.lit("|"), F.col("year").cast("string"), F.lit("|"), first)
    return F.array_compact(F.array(*ids, F.when(F.trim("issn") != "", bib)))


def merge_keys(cand: DataFrame, ord_: str = "ord") -> DataFrame:
    """(ord, key) of every candidate."""
    return whole(cand).select(F.col(ord_), F.explode(_keys()).alias("key"))


def resolve(cand: DataFrame, ord_: str = "ord", scope: str | None = None) -> DataFrame:
    """cand with `work`: the smallest ord of its work. Keys link to their smallest member, so no pair is compared.

    With a scope column, candidates merge within its values only; ords are unique all the same.
    """
    keyed = whole(cand).select(F.col(ord_), *([F.col(scope)] if scope else []), F.explode(_keys()).alias("key"))
    by = ["key", scope] if scope else ["key"]
    named = F.to_json(F.struct(*by)).alias("named")
    keyed = materialise(keyed.select(ord_, named), "merge-keys")
    hubs = keyed.groupBy("named").agg(F.min(ord_).alias("hub"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    links = skew_lookup(keyed, materialise(hubs, "merge-hubs"), "named", "rows", ord_).filter("hub is not null")
    roots = connected_components(links.select(F.col(ord_).alias("src"), F.col("hub").alias("dst"))).withColumnRenamed("node", ord_)
    return cand.join(roots, ord_, "left").withColumn("work", F.coalesce("root", F.col(ord_))).drop("root")


def _full(x: str | Column) -> Column:
    return F.coalesce(F.trim(x) != "", F.lit(False))


def _placed(cand: DataFrame, ord_: str, scope: str | None) -> DataFrame:
    """All candidates with their work, keys, and the forms by which members are compared, in a kept table."""
    title_key = F.md5(F.expr(f"coalesce({rules.title_key(SPARK, 'even_title')}, '')"))  # compared only, so a digest will do
    placed = whole(resolve(cand, ord_, scope)).withColumnRenamed(ord_, "ord").withColumns({"keys": _keys(), "title_key": title_key, "who": F.lower(F.trim("author"))})
    return materialise(placed.drop("even_title", "even_author"), "placed")


def _beside_first(placed: DataFrame, told: list[str]) -> DataFrame:
    """placed with n_members and what the work's first member has in the columns `told` (f_...). Works of very many members are spread."""
    first = placed.filter("ord = work").select("work", *[F.col(c).alias(f"f_{c}") for c in told])
    counted = placed.groupBy("work").agg(F.count(F.lit(1)).alias("n_members"))
    return skew_lookup(placed, materialise(first.join(counted, "work"), "first-members"), "work", "n_members", "ord")


def members(cand: DataFrame, ord_: str = "ord", scope: str | None = None) -> DataFrame:
    """All candidates with their work, n_members, and what the work's first member says (f_...), without its texts.

    The first member is the one whose ord names the work.
    """
    return _beside_first(_placed(cand, ord_, scope), ["adapter", "record_id", "title", "title_key", "year", "author", "who", "keys"])


def _differs() -> dict[str, Column]:
    """Per field, whether a member contradicts the first one (AGG4)."""
    title = F.col("title").isNotNull() & F.col("f_title").isNotNull() & (F.col("title_key") != F.col("f_title_key"))
    who = (F.col("who") != "") & (F.col("f_who") != "") & (F.col("who") != F.col("f_who"))
    return {name: F.coalesce(test, F.lit(False)) for name, test in (("title", title), ("year", F.col("year") != F.col("f_year")), ("authors", who))}


def conflict_assertions(cand: DataFrame, ord_: str = "ord") -> DataFrame:
    """(work, field, ord, adapter, record_id, value): each contradicted field, by the first member and all that contradict it."""
    seen = members(cand, ord_)
    value = {"title": "title", "year": "year", "authors": "author"}
    each = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(field).alias("field"), F.col(value[field]).cast("string").alias("value"), F.col(f"f_{value[field]}").cast("string").alias("base"))) for field, test in _differs().items()]))
    found = seen.select("work", "ord", "adapter", "record_id", "f_adapter", "f_record_id", F.explode(each).alias("c"))
    theirs = found.select("work", "c.field", "ord", "adapter", "record_id", "c.value")
    base = found.select("work", "c.field", F.col("work").alias("ord"), F.col("f_adapter").alias("adapter"), F.col("f_record_id").alias("record_id"), F.col("c.base").alias("value")).distinct()
    return theirs.unionByName(base)


def works(cand: DataFrame, ord_: str = "ord", scope: str | None = None) -> DataFrame:
    """One row per work: the first member's columns, merged identifiers, conflicts, state, and g1 to g5 and g7.

    Members are folded by partial aggregates, so no list of them is ever built. Identifiers are the first in member
    order. G2 asks every member for a key in common with the first one, which merging through others doesn't promise.
    """
    placed = _placed(cand, ord_, scope)
    # members are compared by digests and flags; whole texts are read of the first ones alone
    given = F.when(F.col("title").isNotNull(), "").alias("title")
    flags = [(_full("adapter") & _full("record_id")).alias("g1"), (_full("doi") | _full("url")).alias("g4"), (_full("abstract") | _full("raw_metadata")).alias("g5")]
    seen = _beside_first(placed.select("work", "ord", given, "title_key", "year", "who", "keys", *IDENTIFIERS, *flags), ["title", "title_key", "year", "who", "keys"])
    differs = _differs()
    of_first = F.arrays_overlap("keys", "f_keys") | (F.col("ord") == F.col("work"))
    folded = seen.groupBy("work").agg(
        F.max("n_members").alias("n_members"), *[F.min_by(name, F.when(F.col(name).isNotNull(), F.col("ord"))).alias(f"m_{name}") for name in IDENTIFIERS],
        *[F.bool_or(test).alias(f"c_{name}") for name, test in differs.items()], F.bool_or("g1").alias("g1"),
        F.bool_and(F.coalesce(of_first, F.lit(False))).alias("g2"), F.bool_or("g4").alias("g4"), F.bool_or("g5").alias("g5"),
    )
    kept = ["adapter", "record_id", "title", "author", "authors", "year", "url", "abstract", *([scope] if scope else [])]
    first = placed.filter("ord = work").select("work", *kept, *[F.col(name).alias(f"p_{name}") for name in IDENTIFIERS])
    made = folded.join(first, "work").withColumn("conflicts", F.concat_ws(",", *[F.when(F.col(f"c_{name}"), name) for name in differs]))
    identified = (F.col("n_members") > 1) | F.coalesce(*[F.col(f"m_{name}") for name in IDENTIFIERS]).isNotNull()
    state = F.when(F.col("conflicts") != "", "CONFLICT").when(identified, "IDENTIFIED").otherwise("DISCOVERED")
    g3 = _full("title") & _full("author") & F.col("year").isNotNull() & (F.col("conflicts") == "")
    made = made.withColumns({"state": state, "g3": g3, "g7": F.col("conflicts") == "", **{name: F.col(f"m_{name}") for name in IDENTIFIERS}})
    return made.drop(*[f"m_{name}" for name in IDENTIFIERS], *[f"c_{name}" for name in differs])
