"""Text rules and classifiers as SQL expressions for either dialect.

Thai words are split by the JDK's break iterator through Spark's `sentences`, on rows with Thai letters only;
DuckDB has no word breaking, so oracles cover texts without Thai letters.
"""

from __future__ import annotations

from admitflow.functions import vocab as V
from admitflow.functions.dialect import DUCK, SPARK, Dialect

TOKEN = r"[a-zA-Z0-9\x{0E00}-\x{0E7F}]+"


def tokens(d: Dialect, text: str) -> str:
    """TXT1, and TXT2 for Spark: lower-cased runs of ASCII letters, digits and Thai; Thai texts are word-broken first."""
    plain = d.find_all(f"lower({text})", TOKEN)
    if not d.spark:
        return plain
    words = f"flatten(transform(flatten(sentences({text}, 'th', 'TH')), w -> {d.find_all('lower(w)', TOKEN)}))"
    return f"CASE WHEN {d.matches(text, '[\\x{0E00}-\\x{0E7F}]')} THEN {words} ELSE {plain} END"


def keywords(d: Dialect, toks: str, stop: list[str] = V.GATE_STOPWORDS) -> str:
    """TXT3 and TXT4: distinct tokens of more than two characters that aren't stopwords."""
    return d.filter(d.distinct(toks), "k", f"length(k) > 2 AND NOT {d.has(d.list(stop), 'k')}")


def few_tokens(d: Dialect, text: str) -> str:
    """Whether a text has fewer than MIN_PASSAGE_TOKENS tokens. Spark stops at the last that it needs, but for Thai texts."""
    count = f"({d.size(tokens(d, text))} < {V.MIN_PASSAGE_TOKENS})"
    if not d.spark:
        return count
    inside, outside = TOKEN[:-1], "[^" + TOKEN[1:-1]
    enough = d.matches(text, f"(?:{inside}+{outside}+){{{V.MIN_PASSAGE_TOKENS - 1}}}{inside}")
    return f"CASE WHEN {d.matches(text, '[\\x{0E00}-\\x{0E7F}]')} THEN {count} ELSE NOT {enough} END"


def phrase_at(d: Dialect, toks: str, phrases: list[str], among: str | None = None) -> str:
    """TXT15: positions at which any of the phrases starts; of those in `among`, if given."""
    tests = []
    for n in sorted({len(p.split()) for p in phrases}):
        own = d.list([p for p in phrases if len(p.split()) == n])
        tests.append(d.has(own, d.item(toks, "spot") if n == 1 else d.join(d.part(toks, "spot", n), " ")))
    return d.filter(among or d.positions(toks), "spot", "(" + " OR ".join(tests) + ")")


def surface_forms(words: list[str]) -> list[str]:
    """TXT17, turned round: every form whose regular English endings lead back to one of the words."""
    forms = set(words)
    for b in words:
        if not b.isascii():
            continue
        forms |= {b + "ed", b + "ing", b + "es"}
        if not b.endswith("s"):
            forms.add(b + "s")
        if b.endswith("e"):
            forms |= {b + "d", b[:-1] + "ing"}
    return sorted(forms)


def _shared(d: Dialect, claim: str, passage: str) -> str:
    return d.common(keywords(d, claim, V.RELATION_STOPWORDS), keywords(d, passage, V.RELATION_STOPWORDS))


def _told(d: Dialect, claim: str, passage: str, sides: list[tuple[list[str], list[str]]]) -> list[str]:
    """Close places in passage of the second words of a side, for each side of which the claim has one of the first words."""
    empty = d.filter("close", "spot", "spot < 0")
    by_other: dict[tuple[str, ...], list[str]] = {}
    for mine, other in sides:
        by_other.setdefault(tuple(other), []).extend(mine)
    return [f"CASE WHEN {d.size(phrase_at(d, claim, mine))} > 0 THEN {phrase_at(d, passage, list(other), 'close')} ELSE {empty} END" for other, mine in by_other.items()]


def _reversals(d: Dialect, claim: str, passage: str) -> str:
    """Close places of negations and of words opposite to the claim's (CLS8)."""
    pairs = [*V.DIRECTIONAL_PAIRS, *[(b, a) for a, b in V.DIRECTIONAL_PAIRS]]
    up, down = surface_forms(V.POSITIVE_WORDS) + V.POSITIVE_PHRASES, surface_forms(V.NEGATIVE_WORDS) + V.NEGATIVE_PHRASES
    sides = [([mine], [other]) for mine, other in pairs] + [(up, down), (down, up)]
    return d.concat(phrase_at(d, passage, V.NEGATION_TOKENS + V.NEGATION_PHRASES, "close"), *_told(d, claim, passage, sides))


def _echoes(d: Dialect, claim: str, passage: str) -> str:
    """Close places of the claim's own directional words and of others of their class."""
    up, down = surface_forms(V.POSITIVE_WORDS) + V.POSITIVE_PHRASES, surface_forms(V.NEGATIVE_WORDS) + V.NEGATIVE_PHRASES
    sides = [([x], [x]) for pair in V.DIRECTIONAL_PAIRS for x in pair] + [(up, up), (down, down)]
    return d.concat(*_told(d, claim, passage, sides))


def _with_shared(d: Dialect, claim: str, passage: str, body: str) -> str:
    """body with `shared`, the common keywords, and `close`, the places in passage within NEAR of one of them, each found once.

    Phrases are then looked for in close places alone, so a long passage that shares little costs little.
    """
    spots = d.filter(d.positions(passage), "spot", d.has("shared", d.item(passage, "spot")))
    close = d.filter(d.around(spots, V.NEAR), "spot", f"spot >= 1 AND spot <= {d.size(passage)}")
    return d.let("shared", _shared(d, claim, passage), d.let("close", close, body))


def relation(d: Dialect, claim: str, passage: str) -> str:
    """CLS8 to CLS11 for two token arrays (columns): the relation of passage to claim."""
    body = f"""CASE WHEN {d.size(claim)} = 0 OR {d.size(passage)} < {V.MIN_PASSAGE_TOKENS} OR {d.size('shared')} = 0 THEN 'UNCLEAR'
        WHEN {d.size(_reversals(d, claim, passage))} > 0 THEN 'CHALLENGES'
        WHEN {d.size(phrase_at(d, passage, V.SCOPE_PHRASES, 'close'))} > 0 THEN 'QUALIFIES'
        WHEN {d.size('shared')} >= {V.MIN_SHARED} THEN 'SUPPORTS' ELSE 'CONTEXT_ONLY' END"""
    return _with_shared(d, claim, passage, body)


def polarity(d: Dialect, claim: str, passage: str) -> str:
    """CLS7: what passage does with the claim's direction: NEGATIVE, POSITIVE or NEUTRAL."""
    body = f"""CASE WHEN {d.size(claim)} = 0 OR {d.size(passage)} < {V.MIN_PASSAGE_TOKENS} OR {d.size('shared')} = 0 THEN 'NEUTRAL'
        WHEN {d.size(_reversals(d, claim, passage))} > 0 THEN 'NEGATIVE'
        WHEN {d.size('shared')} >= {V.MIN_SHARED} OR {d.size(_echoes(d, claim, passage))} > 0 THEN 'POSITIVE' ELSE 'NEUTRAL' END"""
    return _with_shared(d, claim, passage, body)


def subject(d: Dialect, toks: str) -> str:
    """TXT23: the first four words that carry meaning, repeated ones too; null without any."""
    words = d.filter(toks, "k", f"length(k) > 2 AND NOT {d.has(d.list(V.RELATION_STOPWORDS), 'k')}")
    return f"nullif({d.join(d.part(words, '1', 4), ' ')}, '')"


def _contains(d: Dialect, text: str, cues: list[str]) -> str:
    """Whether text holds one of the cues; cues that hold another one say nothing more, and text is evaluated once."""
    least = [c for c in cues if not any(other != c and other in c for other in cues)]
    return d.let("held", text, "(" + " OR ".join(d.contains("held", d.text(c)) for c in least) + ")")


def _free_cue(d: Dialect, text: str, cues: list[str]) -> str:
    """CLS6: a cue whose first place isn't behind a suppressor in its sentence (up to . ! ?)."""
    front = lambda cue: f"substr({text}, 1, {d.at(text, cue)} - 1)"
    # Java tries the pattern from every character, so Spark cuts at the last stop instead
    before = lambda cue: f"substring_index(translate({front(cue)}, '!?', '..'), '.', -1)" if d.spark else f"regexp_extract({front(cue)}, {d.text('[^.!?]*$')})"
    return d.any(d.list(cues), "c", f"{d.contains(text, 'c')} AND NOT {d.any(d.list(V.SUPPRESSORS), 'm', d.contains(before('c'), 'm'))}")


def _found_by_splitting(d: Dialect, text: str) -> str:
    """Each match of FOUND_PATTERN with what stands before it in its sentence, in one pass: Java needs the square of a sentence's length otherwise."""
    marked = d.replace(f"translate({text}, '\x01', '\x02')", V.FOUND_PATTERN, "$0\x01")
    ends = f"split({marked}, '\x01', -1)"
    return d.map(f"slice({ends}, 1, size({ends}) - 1)", "e", "substring_index(translate(e, '!?', '..'), '.', -1)")


def telling_parts(text: str) -> str:
    """For Spark: the parts of a lower-cased text, between full stops, on which its statement type depends; null for null.

    No cue or pattern passes a full stop, and what stands before a cue counts within its sentence only. So parts without a cue say nothing but
    that the text has words. The first part stays, as a word put before the text may begin a cue in it. Put together, parts and
    whatever is put before them are of the same type as with the whole text, apart from its number of tokens.
    """
    cues = [*V.CONCLUSION_CUES, *V.RESULT_CUES, *V.HYPOTHESIS_CUES, *V.OBJECTIVE_CUES, *V.PRIOR_WORK_CUES, *V.LIMITATION_CUES, *V.METHOD_CUES, "according to "]
    least = sorted({c for c in cues if not any(other != c and other in c for other in cues)}) + ["found"]
    # few words that all cues hold show most texts to have none
    words = V.CUE_WORDS + [c for c in least if not any(w in c for w in V.CUE_WORDS)]
    some = lambda x, of: "(" + " OR ".join(SPARK.contains(x, SPARK.text(c)) for c in of) + ")"
    told = f"array_join(filter(split({text}, '[.]', -1), (part, i) -> i = 0 OR {some('part', least)}), '.')"
    return f"CASE WHEN {some(text, words)} THEN {told} ELSE substring_index({text}, '.', 1) END"


def tokens_enough(text: str) -> str:
    """For Spark: a text, or a few words in its place where it has tokens enough and no Thai letter, so that each is counted once."""
    thai = SPARK.matches(text, "[\\x{0E00}-\\x{0E7F}]")
    return f"CASE WHEN NOT {thai} AND NOT {few_tokens(SPARK, text)} THEN '{' a' * V.MIN_PASSAGE_TOKENS}' ELSE {text} END"


def statement_type(d: Dialect, text: str, whole: str | None = None) -> str:
    """CLS5: the kind of statement a passage makes; `text` is lower-cased already.

    Spark looks for cues in the telling parts of a text alone, found in one pass; with `whole`, `text` are those, and tokens are counted in `whole`.
    """
    if d.spark and whole is None:
        return d.let("told", telling_parts(text), statement_type(d, "told", text))
    found = _found_by_splitting(d, text) if d.spark else d.find_all(text, r"[^.!?]*?" + V.FOUND_PATTERN)
    free = d.any(found, "f", f"NOT {d.any(d.list(V.SUPPRESSORS), 'm', d.contains('f', 'm'))}")
    free = f"({d.matches(text, V.FOUND_PATTERN)} AND {free})" if d.spark else free
    all_ = whole or text
    return f"""CASE WHEN {all_} IS NULL OR trim({all_}) = '' OR {few_tokens(d, all_)} THEN 'UNKNOWN'
        WHEN {_free_cue(d, text, V.CONCLUSION_CUES)} THEN 'CONCLUSION'
        WHEN {_free_cue(d, text, V.RESULT_CUES)} OR {free} THEN 'RESULT'
        WHEN {_contains(d, text, V.HYPOTHESIS_CUES)} THEN 'HYPOTHESIS'
        WHEN {_contains(d, text, V.OBJECTIVE_CUES)} THEN 'OBJECTIVE'
        WHEN {_contains(d, text, V.PRIOR_WORK_CUES)} OR {d.matches(text, V.PRIOR_WORK_PATTERN)} THEN 'PRIOR_WORK'
        WHEN {_contains(d, text, V.LIMITATION_CUES)} THEN 'LIMITATION'
        WHEN {_contains(d, text, V.METHOD_CUES)} THEN 'METHOD' ELSE 'BACKGROUND' END"""


def is_thai_language(d: Dialect, text: str) -> str:
    thai = f"length({d.replace(text, '[^\\x{0E00}-\\x{0E7F}]', '')})"
    letters = f"length({d.replace(text, '[^\\p{L}]', '')})"
    return f"({letters} > 0 AND {thai} * 1.0 / {letters} >= {V.THAI_SHARE})"


def relevance_tags(d: Dialect, text: str, venue: str, home: str = "FALSE") -> str:
    """CLS1: tags of a record; `venue` holds its lower-cased url, host and publisher names, `home` whether an institution is Thai."""
    here = f"({home} OR {_contains(d, venue, V.THAI_HOSTS + V.THAI_PUBLISHERS)})"
    found = d.record(thai=is_thai_language(d, text), about=_contains(d, f"lower({text})", V.THAILAND_KEYWORDS), here=here)
    tags = [("w.thai", "THAI_LANGUAGE"), ("w.here", "PUBLISHED_IN_THAILAND"), ("w.about", "ABOUT_THAILAND"), ("w.about AND NOT w.thai AND NOT w.here", "FOREIGN_ABOUT_THAILAND")]
    listed = ", ".join(f"CASE WHEN {test} THEN '{tag}' END" for test, tag in tags)
    return d.let("w", found, d.filter(f"array({listed})" if d.spark else f"[{listed}]", "t", "t IS NOT NULL"))


def domain(d: Dialect, text: str) -> str:
    """CLS2 to CLS4: THAI_HEALTH, HEALTH, THAI or GENERAL."""
    thai = f"({is_thai_language(d, text)} OR {_contains(d, f'lower({text})', V.THAILAND_KEYWORDS)})"
    words = d.find_all(f"lower({text})", "[a-zA-Z]+")
    health = f"({_contains(d, f'lower({text})', V.HEALTH_PHRASES)} OR {d.size(d.common(words, d.list(V.HEALTH_WORDS)))} > 0)"
    return f"CASE WHEN {thai} AND {health} THEN 'THAI_HEALTH' WHEN {health} THEN 'HEALTH' WHEN {thai} THEN 'THAI' ELSE 'GENERAL' END"


def merge_id(d: Dialect, x: str) -> str:
    """TXT11: identifiers as merge keys; null if empty."""
    out = f"lower(trim({x}))"
    for prefix in ("https://doi.org/", "doi:", "pmid:", "pmcid:", "arxiv:"):
        out = d.replace(out, "^" + prefix.replace(".", r"\."), "")
    return f"nullif({out}, '')"


def gate_id(d: Dialect, x: str) -> str:
    """TXT12: identifiers in gates and fetches; '' if empty."""
    out = f"lower(trim({x}))"
    for prefix in ("https://doi.org/", "http://doi.org/", "doi:", "pmid:", "pmcid:"):
        out = d.replace(out, "^" + prefix.replace(".", r"\."), "")
    return f"coalesce(trim({out}), '')"


def title_key(d: Dialect, x: str) -> str:
    """TXT10 of a text in NFKC (operators/identity.py sees to that): lower-cased, trimmed, then without punctuation and
    symbols, blanks collapsed; null if empty."""
    return f"nullif({d.replace(d.replace(f'lower(trim({x}))', '[\\p{P}\\p{S}]', ''), '\\s+', ' ')}, '')"


def surname(d: Dialect, x: str) -> str:
    """TXT13: what stands before a comma, else the last blank-separated word, lower-cased."""
    last = f"regexp_extract(trim({x}), {d.text('[^ ]*$')}" + (", 0)" if d.spark else ")")
    return f"lower(trim(CASE WHEN {d.at(x, d.text(','))} > 0 THEN substr({x}, 1, {d.at(x, d.text(','))} - 1) ELSE {last} END))"


def admission(d: Dialect, state: str, relation_: str, intended: str, kind: str, g6: str = "TRUE", g5: str = "TRUE") -> str:
    """GAT11 with GAT12: ADMIT, REJECT or HOLD."""
    listed = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
    return f"""CASE WHEN {state} = 'CONFLICT' OR {state} IN {listed(V.ERROR_STATES)} OR {state} = 'NOT_FOUND' THEN 'HOLD'
        WHEN {state} = 'REJECTED' THEN CASE WHEN NOT {g6} THEN 'REJECT' WHEN NOT {g5} THEN 'HOLD' ELSE 'REJECT' END
        WHEN {kind} IS NOT NULL AND {kind} NOT IN {listed(V.FINDINGS)} THEN 'HOLD'
        WHEN {relation_} = 'QUALIFIES' THEN 'HOLD'
        WHEN {state} NOT IN ('VERIFIED', 'CONTENT_FETCHED') OR {relation_} NOT IN ('SUPPORTS', 'CHALLENGES') THEN 'HOLD'
        WHEN {relation_} = {intended} THEN 'ADMIT' ELSE 'REJECT' END"""


def clean_query(d: Dialect, x: str) -> str:
    """TXT19: blanks collapsed, trimmed, without trailing . ! ?"""
    return f"trim({d.replace(f'trim({d.replace(x, chr(92) + 's+', ' ')})', '[.!?]+$', '')})"


__all__ = ["DUCK", "SPARK", "admission", "clean_query", "domain", "gate_id", "keywords", "merge_id", "polarity", "relation", "relevance_tags", "statement_type", "subject", "surface_forms", "surname", "title_key", "tokens"]
