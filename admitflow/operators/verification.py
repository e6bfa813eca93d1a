"""From works to decisions: identity with a citation, relevance for a topic, states, reasons and admission
(TXT5, TXT8, TXT9, TXT14, GAT6 to GAT8, GAT10, GAT11, GAT14, GAT15)."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from admitflow.functions import rules
from admitflow.functions import vocab as V
from admitflow.functions.dialect import SPARK
from admitflow.operators import identity
from admitflow.plans.shared import free_name

#: Least title overlap, least similarity, least length of an embedded identifier.
LEAST_OVERLAP, LEAST_RATIO, LEAST_EMBEDDED = 0.5, 0.55, 6
#: Length of Thai character runs, and how many must be shared.
THAI_RUN, LEAST_THAI_RUNS = 4, 3
#: Fixed names of the gates, in the order in which reasons list them.
GATES = {
    "g1": "G1_source_exists", "g2": "G2_identity_real", "g3": "G3_metadata_consistent", "g4": "G4_resolvable_source", "g5": "G5_metadata_fetched",
    "g6": "G6_identity_match", "g6_discovery": "G6_discovery_relevance", "g6b": "G6b_context_relevance_signal_nongating", "g7": "G7_no_conflict",
}


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """TXT8: the matching-blocks ratio of two strings, null where either is; rows that need none pass nulls."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """At least the ratio of two strings: matching blocks can't share more of a character than the rarer side has; null where one is null.

    A distinct character costs one pass over each string, all in the JVM; two empty strings have ratio 1.
    """
    held = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    common = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(held(a, c), held(b, c))))
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * common / both)


def with_similarity(rows: DataFrame, a: str, b: str, into: str = "similarity") -> DataFrame:
    """TXT9, for ranking only: rows with the ratio of two titles in normal form, 0 if either is null or empty.

    Titles that are equal, or share no character, never reach Python.
    """
    left, right = free_name("_left", rows.columns), free_name("_right", rows.columns)
    ready = rows.withColumns({left: identity.even(a), right: identity.even(b)})
    ready = ready.withColumns({c: F.expr(rules.title_key(SPARK, c)) for c in (left, right)})
    same = F.when(F.col(left) == F.col(right), 1.0).when(ratio_bound(F.col(left), F.col(right)) == 0, 0.0)
    known = free_name("_known", ready.columns)
    ready = ready.withColumn(known, same)
    open_ = lambda c: F.when(F.col(known).isNull(), F.col(c))
    return ready.withColumn(into, F.coalesce(known, seq_ratio(open_(left), open_(right)), F.lit(0.0))).drop(left, right, known)


def gate_keywords(text: str) -> Column:
    """TXT3 of a SQL expression."""
    return F.expr(rules.keywords(SPARK, f"coalesce({rules.tokens(SPARK, text)}, cast(array() as array<string>))"))


def thai_runs(text: Column) -> Column:
    """TXT5: distinct runs of THAI_RUN Thai characters, all others dropped before."""
    thai = F.regexp_replace(text, r"[^\x{0E00}-\x{0E7F}]", "")
    spots = F.when(F.length(thai) >= THAI_RUN, F.sequence(F.lit(1), F.length(thai) - (THAI_RUN - 1)))
    return F.array_distinct(F.coalesce(F.transform(spots, lambda i: F.substring(thai, i, F.lit(THAI_RUN))), F.array().cast("array<string>")))


def embeds_identifier(query: Column, identifier: Column) -> Column:
    """The exact-identifier rule for normalised values: equal, or the first place of an identifier of six characters or more
    in the query has no letter or digit on either side."""
    at = F.instr(query, identifier)
    beside = F.concat(F.substring(query, at - 1, F.when(at > 1, 1).otherwise(0)), F.substring(query, at + F.length(identifier), F.lit(1)))
    inside = (F.length(identifier) >= LEAST_EMBEDDED) & (at > 0) & ~beside.rlike(r"[\p{L}\p{N}]")
    return F.coalesce((query != "") & (identifier != "") & ((query == identifier) | inside), F.lit(False))


def names_author(query: Column, authors: Column) -> Column:
    """TXT14: a surname of more than two characters is part of the lower-cased query."""
    last = lambda a: F.when(F.instr(a, ",") > 0, F.split_part(a, F.lit(","), F.lit(1))).otherwise(F.element_at(F.split(F.trim(a), r"\s+"), -1))
    surname = lambda a: F.lower(F.trim(last(a)))
    return F.coalesce(F.exists(authors, lambda a: (F.length(surname(a)) > 2) & F.contains(F.lower(query), surname(a))), F.lit(False))


def with_identity(works: DataFrame, query: str) -> DataFrame:
    """GAT6: works with matched_field, shared_tokens, title_ratio, author_match, seq and g6.

    The similarity is computed in Arrow batches, for the rows that nothing else decides and whose characters allow
    LEAST_RATIO; `seq` is null for all others. A blank query passes nothing.
    """
    asked = works.withColumn("_q", F.expr(rules.gate_id(SPARK, f"`{query}`")))
    fields = [("doi", "p_doi"), ("pmid", "p_pmid"), ("pmcid", "p_pmcid"), ("source_record_id", "record_id")]
    field = F.coalesce(*[F.when(embeds_identifier(F.col("_q"), F.expr(rules.gate_id(SPARK, c))), name) for name, c in fields])
    asked = asked.withColumns({"matched_field": field, "_k": gate_keywords(f"`{query}`"), "_t": gate_keywords("title"), "author_match": names_author(F.col(query), F.col("authors"))})
    shared, least = F.array_intersect("_k", "_t"), F.least(F.size("_k"), F.size("_t"))
    asked = asked.withColumns({"shared_tokens": F.array_sort(shared), "title_ratio": F.when(least > 0, F.size(shared) / least).otherwise(0.0)})
    n = F.size("shared_tokens")
    enough = (n >= 2) | F.col("author_match")
    passed = (F.col("title_ratio") >= LEAST_OVERLAP) | (F.col("author_match") & (n >= 1))
    blank = F.coalesce(F.trim(F.col(query)) == "", F.lit(True))
    decided = F.when(blank, False).when(F.col("matched_field").isNotNull(), True).when(~enough, False).when(passed, True)
    asked = asked.withColumn("g6_decided", decided)
    joined = lambda c: F.when(F.col("g6_decided").isNull(), F.array_join(F.array_sort(c), " "))
    asked = asked.withColumns({"_k": joined("_k"), "_t": joined("_t")})
    # rounding may differ by an ulp from the ratio's own division, so only what lies clearly below is ruled out
    able = ratio_bound(F.col("_k"), F.col("_t")) > LEAST_RATIO - 1e-9
    asked = asked.withColumn("_able", F.col("g6_decided").isNull() & able)
    only = lambda c: F.when(F.col("_able"), F.col(c))
    asked = asked.withColumn("seq", seq_ratio(only("_k"), only("_t")))
    return asked.withColumn("g6", F.coalesce("g6_decided", F.col("seq") >= LEAST_RATIO, F.lit(False))).drop("_q", "_k", "_t", "_able")


def with_relevance(works: DataFrame, context: str) -> DataFrame:
    """GAT7 and GAT8: works with matched_keywords, g6b (informative) and g6_discovery."""
    text = "concat_ws(' ', nullif(title, ''), coalesce(abstract, ''))"
    asked = works.withColumns({"_c": gate_keywords(f"`{context}`"), "_d": gate_keywords(text)})
    asked = asked.withColumn("matched_keywords", F.array_sort(F.array_intersect("_c", "_d")))
    blank = F.coalesce(F.trim(F.col(context)) == "", F.lit(True))
    n = F.size("matched_keywords")
    enough = n >= F.when(F.size("_c") >= V.MIN_SHARED, V.MIN_SHARED).otherwise(1)
    runs = F.size(F.array_intersect(thai_runs(F.col(context)), thai_runs(F.expr(text)))) >= LEAST_THAI_RUNS
    return asked.withColumns({"g6b": blank | (n > 0), "g6_discovery": ~blank & (enough | F.coalesce(runs, F.lit(False)))}).drop("_c", "_d")


def verify(works: DataFrame, query: str, context: str, mode: str = "identity") -> DataFrame:
    """GAT10: works with all gates, `state` VERIFIED, CONFLICT or REJECTED, and GAT14's `reason` where it isn't VERIFIED."""
    if mode not in ("identity", "discovery"):
        raise ValueError(f"not a mode: {mode}")
    judged = with_relevance(with_identity(works, query), context)
    required = ["g1", "g2", "g3", "g4", "g5", "g6" if mode == "identity" else "g6_discovery", "g7"]
    passed = F.lit(True)
    for gate in required:
        passed = passed & F.col(gate)
    judged = judged.withColumn("state", F.when(passed, "VERIFIED").when(F.col("state") == "CONFLICT", "CONFLICT").otherwise("REJECTED"))
    failed = F.concat_ws(", ", *[F.when(~F.col(gate), name) for gate, name in GATES.items()])
    conflict = F.concat(F.lit("METADATA_CONFLICT on field(s): "), F.replace("conflicts", F.lit(","), F.lit(", ")))
    reason = F.when(F.col("state") == "CONFLICT", conflict).when(F.col("state") == "REJECTED", F.concat(F.lit("failed gate(s): "), failed))
    return judged.withColumn("reason", reason)


def judgement(claim: str, passage: str, state: str, intended: str, g6: str = "true", g5: str = "true", relation: str | None = None) -> Column:
    """A struct (relation, statement_type, decision) for SQL names of texts, state and gates; each label is found once.

    Lambdas keep the optimizer from copying the labels' long expressions into each of the decision's branches.
    """
    none = "cast(array() as array<string>)"
    label = relation or rules.relation(SPARK, "w.ct", "w.pt")
    labels = SPARK.let("w", f"named_struct('ct', coalesce({rules.tokens(SPARK, claim)}, {none}), 'pt', {rules.tokens(SPARK, passage)}, 'x', lower({passage}))", f"named_struct('relation', {label}, 'kind', {rules.statement_type(SPARK, 'w.x')})")
    decision = rules.admission(SPARK, state, "t.relation", f"'{intended}'", "t.kind", g6, g5)
    return F.expr(SPARK.let("t", labels, f"named_struct('relation', t.relation, 'statement_type', t.kind, 'decision', {decision})"))


def admit(verified: DataFrame, claim: str, intended: str = "SUPPORTS", mode: str = "identity", relation=None) -> DataFrame:
    """GAT11: verified works with level, relation, statement_type and decision; the passage is the first member's abstract.

    `relation` may be a function of (claim, passage) columns that replaces the built-in reading.
    """
    told = verified.withColumn("_p", F.coalesce("abstract", F.lit("")))
    if relation:
        told = told.withColumn("_r", relation(F.col(claim), F.col("_p")))
    gate = "g6" if mode == "identity" else "g6_discovery"
    told = told.withColumn("_j", judgement(f"`{claim}`", "_p", "state", intended, gate, "g5", "_r" if relation else None))
    level = F.when(F.trim("_p") != "", "ABSTRACT").otherwise("METADATA")
    told = told.withColumns({"level": level, **{c: F.col(f"_j.{c}") for c in ("relation", "statement_type", "decision")}})
    return told.drop("_p", "_j", "_r")


def check_contract(contracts: DataFrame, strict: bool = True) -> DataFrame:
    """GAT15: contracts (mode, claim, intended_relation) that are legal. VERIFY needs a claim and a relation; illegal rows raise, or go."""
    legal = F.col("mode").isin("DISCOVER", "VERIFY") & (
        (F.col("mode") == "DISCOVER") | ((F.trim(F.coalesce("claim", F.lit(""))) != "") & F.coalesce(F.col("intended_relation").isin(*V.RELATIONS), F.lit(False)))
    )
    legal = F.coalesce(legal, F.lit(False))
    if not strict:
        return contracts.filter(legal)
    return contracts.filter(F.when(legal, True).otherwise(F.raise_error(F.concat(F.lit("illegal contract: "), F.to_json(F.struct("mode", "claim", "intended_relation"))))))
