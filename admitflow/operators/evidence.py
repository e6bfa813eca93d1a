"""What a passage says of a claim beside what a reader outside says of it, with reasons in order (GAT13, API5), and the
evidence behind a source's id (API4, JON8, SRT3).

Both take tables of any size and keep every row and column of the first one; their answer is one struct column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.functions import rules
from admitflow.functions import vocab as V
from admitflow.functions.dialect import SPARK
from admitflow.plans.shared import free_name

#: Fixed names of identifiers that no single source owns, and the candidate's column of each.
IDENTIFIERS = {"DOI": "doi", "PMID": "pmid"}


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _labels(claim: str, passage: str) -> Column:
    """A struct (statement_type, relation) of two columns; a null claim or passage is empty."""
    none = "cast(array() as array<string>)"
    text = lambda c: f"coalesce({_quoted(c)}, '')"
    tokens = lambda c: f"coalesce({rules.tokens(SPARK, text(c))}, {none})"
    read = f"named_struct('c', {tokens(claim)}, 'p', {tokens(passage)}, 'x', lower({text(passage)}))"
    told = f"named_struct('statement_type', {rules.statement_type(SPARK, 'w.x')}, 'relation', {rules.relation(SPARK, 'w.c', 'w.p')})"
    return F.expr(SPARK.let("w", read, told))


def _compared(name: str, proposed: Column, checked: Column) -> Column:
    """Fixed format: whether a legal proposal agrees; null without one."""
    head = F.concat(F.lit(f"ai_{name}="), proposed)
    agrees = F.concat(head, F.lit(f" agrees with checker_{name}="), checked)
    differs = F.concat(head, F.lit(f" vs checker_{name}="), checked, F.lit(" -- disagreement, routed to HOLD"))
    return F.when(proposed.isNull(), None).when(proposed == checked, agrees).otherwise(differs)


def _admission_reason(kind: Column, relation: Column, intended: Column) -> Column:
    """Fixed formats: why GAT12 decides as it does for a work whose identity is sure."""
    named = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (
        F.when(~kind.isin(*V.FINDINGS), named("statement_type=", kind, ", no finding reported to evaluate"))
        .when(relation == "QUALIFIES", "relation_QUALIFIES_narrower_scope_than_claim_needs_human_decision")
        .when(~relation.isin("SUPPORTS", "CHALLENGES"), named("relation_", relation, "_not_directional"))
        .when(relation == intended, "relation_matches_intended_use")
        .otherwise(named("relation_", relation, "_does_not_match_intended_", intended))
    )


def check_evidence(
    pairs: DataFrame, claim: str, passage: str, ai_type: str | None = None, ai_relation: str | None = None, intended: str | Column = "SUPPORTS", into: str = "evidence"
) -> DataFrame:
    """pairs with a struct `into`: decision, reasons, proposed, checked, agreement.

    The columns `ai_type` and `ai_relation` hold a reader's own labels. Illegal and null ones count as not given;
    `proposed` is null without a legal one. A label that differs from the checked one makes HOLD, `agreement` false and no
    further reason; without labels `agreement` is null, else true. Reasons come in order: type, relation, admission.
    `intended` is a relation or a column of relations (null: SUPPORTS). Null texts are empty: UNKNOWN and UNCLEAR, so
    HOLD. Repeated rows are answered alike; a column that is called `into` already is an error.
    """
    if into.lower() in (c.lower() for c in pairs.columns):
        raise ValueError(f"the table has a column {into} already")
    labels = free_name("_labels", pairs.columns)
    checked = F.col(labels)
    legal = lambda column, values: F.when(F.col(_quoted(column)).isin(*values), F.col(_quoted(column))) if column else F.lit(None).cast("string")
    own_type, own_relation = legal(ai_type, V.STATEMENT_TYPES), legal(ai_relation, V.RELATIONS)
    wanted = F.coalesce(intended, F.lit("SUPPORTS")) if isinstance(intended, Column) else F.lit(intended)
    differs = F.coalesce(own_type != checked.statement_type, F.lit(False)) | F.coalesce(own_relation != checked.relation, F.lit(False))
    given = own_type.isNotNull() | own_relation.isNotNull()

    read = pairs.withColumn(labels, _labels(claim, passage))
    wanted_name, told = free_name("_wanted", read.columns), f"{_quoted(labels)}.relation"
    read = read.withColumn(wanted_name, wanted)
    decision = F.expr(rules.admission(SPARK, "'VERIFIED'", told, wanted_name, f"{_quoted(labels)}.statement_type"))
    admission = F.when(~differs, _admission_reason(checked.statement_type, checked.relation, F.col(wanted_name)))
    reasons = F.array_compact(F.array(_compared("statement_type", own_type, checked.statement_type), _compared("relation", own_relation, checked.relation), admission))
    proposed = F.when(given, F.struct(own_type.alias("statement_type"), own_relation.alias("relation")))
    answer = F.struct(
        F.when(differs, "HOLD").otherwise(decision).alias("decision"), reasons.alias("reasons"), proposed.alias("proposed"),
        checked.alias("checked"), F.when(differs, False).when(given, True).alias("agreement"),
    )
    return read.withColumn(into, answer).drop(labels, wanted_name)


def _records(candidates: DataFrame, adapters: Sequence[str], order: str) -> DataFrame:
    """(kind, id, found): of all candidates under one name the best, those with an abstract first, then by adapter and `order`."""
    known = F.array(*[F.lit(a.upper()) for a in adapters])
    place = F.array_position(known, F.upper("source_adapter"))
    text = F.trim(F.coalesce("abstract", F.lit("")))
    whole = text != ""
    shown = F.struct(*[F.col(c) for c in ("title", "authors", "year", "doi", "pmid", "source_adapter", "source_record_id", "url")])
    found = F.struct(
        text.alias("evidence_text"), F.when(whole, "ABSTRACT").otherwise("METADATA").alias("evidence_level"),
        F.when(whole, "abstract").otherwise("metadata-only").alias("locator"), shown.alias("metadata"),
    )
    names = [F.struct(F.upper("source_adapter").alias("kind"), F.col("source_record_id").cast("string").alias("id"))]
    names += [F.struct(F.lit(kind).alias("kind"), F.expr(rules.gate_id(SPARK, column)).alias("id")) for kind, column in IDENTIFIERS.items()]
    ranked = candidates.filter(place > 0).select(F.struct((~whole).alias("bare"), place.alias("place"), F.col(order).alias("at")).alias("rank"), found.alias("found"), F.explode(F.array(*names)).alias("name"))
    ranked = ranked.filter("name.id <> ''").select("name.kind", "name.id", "rank", "found")
    return ranked.groupBy("kind", "id").agg(F.min_by("found", "rank").alias("found"))


def fetch(ids: DataFrame, candidates: DataFrame, adapters: Sequence[str], failures: DataFrame | None = None, source_id: str = "source_id", order: str = "ord", into: str = "evidence") -> DataFrame:
    """ids with a struct `into`: status, reason, evidence_text, evidence_level, locator, metadata (nulls where they don't apply).

    A source id is ADAPTER:native id (the adapter in any case, the native id as it is), DOI:doi or PMID:pmid, cut at its
    first colon. `candidates` has the columns of a projected record and `order`; those of `adapters` alone are looked at.
    Of several records the first with an abstract answers, else the first, adapters in their order. Identifiers that are
    empty once normalised match nothing. `failures` (adapter, state) lists sources that could not be asked: an id that
    found nothing, all of whose sources failed, says so. Null, malformed and unknown ids are UNAVAILABLE; repeated ids
    are answered each. Ids are matched in one join on unique names, which AQE may split where many ask for one record.
    """
    if into.lower() in (c.lower() for c in ids.columns):
        raise ValueError(f"the table has a column {into} already")
    raw = F.col(_quoted(source_id))
    kind_name, id_name = free_name("_kind", ids.columns), free_name("_id", ids.columns)
    found_name = free_name("_found", ids.columns)
    kind = F.nullif(F.upper(F.trim(F.split_part(raw, F.lit(":"), F.lit(1)))), F.lit(""))
    value = F.nullif(F.trim(F.substr(raw, F.instr(raw, ":") + 1)), F.lit(""))
    sound = F.coalesce((F.instr(raw, ":") > 0) & kind.isNotNull() & value.isNotNull(), F.lit(False))
    parsed = ids.withColumns({kind_name: F.when(sound, kind), id_name: F.when(sound, value)})
    shared = F.col(kind_name).isin(*IDENTIFIERS)
    parsed = parsed.withColumn(id_name, F.when(shared, F.expr(rules.gate_id(SPARK, id_name))).otherwise(F.col(id_name)))
    records = _records(candidates, adapters, order).toDF("_r_kind", "_r_id", "_r_found")
    met = parsed.join(records.withColumnRenamed("_r_found", found_name), (F.col(kind_name) == F.col("_r_kind")) & (F.col(id_name) == F.col("_r_id")), "left").drop("_r_kind", "_r_id")

    listed = [a.upper() for a in adapters]
    states = {}
    if failures is not None:
        # one row per source of `adapters` at most
        known = failures.select(F.upper("adapter").alias("adapter"), "state").filter(F.col("adapter").isin(*listed))
        states = dict(known.groupBy("adapter").agg(F.min("state").alias("state")).collect())
    failed = [a for a in listed if a in states]
    blame = lambda names: F.lit("every source asked failed: " + ", ".join(f"{a}={states[a]}" for a in names))
    reason = F.when(F.col(kind_name).isNull(), "malformed id: ADAPTER:native id, DOI:doi or PMID:pmid is expected")
    reason = reason.when(~shared & ~F.col(kind_name).isin(*listed), F.concat(F.lit("no such source here: "), kind_name))
    for name in failed:
        reason = reason.when(F.col(kind_name) == name, blame([name]))
    if failed and len(failed) == len(listed):
        reason = reason.when(shared, blame(failed))
    reason = reason.otherwise("no record has exactly this identifier")
    found = F.col(found_name)
    answer = F.struct(
        F.when(found.isNull(), "UNAVAILABLE").otherwise("OK").alias("status"), F.when(found.isNull(), reason).alias("reason"),
        *[found[c].alias(c) for c in ("evidence_text", "evidence_level", "locator", "metadata")],
    )
    return met.withColumn(into, answer).drop(kind_name, id_name, found_name)
