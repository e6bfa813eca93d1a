"""The registered queries of this subpackage, and DuckDB SQL for those that SQL expresses on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.llm import divergence, exact_dedup, jaccard_join, language_id, license_scan, mixing, packing, pii, quality, spelling, topk_search, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public tokenizer file that the packing query takes; files are found by their package, never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_repeat=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "part")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"), least=0.8)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.write_archive(_table(spark, sf_dir, "pages"), min_bytes=0)
    read = warc.read_records(folder, index)
    return read.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2, capacity=4096)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join.jaccard_join(_table(spark, sf_dir, "documents"), n=4, percent=85)
    return joined.select("doc_id", "n_shingles", "component_id", "n_links", "class_id")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"), least_docs=30, top=50)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [pii.count_of(base, kind).alias(f"n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(spelling.words_of(_table(spark, sf_dir, "documents")), ratio=10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py, which lies at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_source_mixing, op3_quality_classifier, op4_language_id, op5_exact_dedup, op6_license_scan, op7_warc, op8_packing, op9_jaccard_join, op10_topk_search,
        op11_divergence, op12_pii, op13_spelling, pipeline,
    )
}

_SPLIT = """
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
)
"""


def _license_sql() -> str:
    """Every template at every shared shingle of every text, without retrieval."""
    values = ", ".join("({}, '{}', '{}')".format(i, name.replace("'", "''"), text.replace("'", "''")) for i, (name, text) in enumerate(license_scan.TEMPLATES))
    words = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
    grams = "list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))"
    return f"""
WITH t AS (SELECT template, license, unnest(list_distinct({grams})) AS g, len(list_distinct({grams})) AS n FROM (SELECT template, license, {words.format('text')} AS w FROM (VALUES {values}) v(template, license, text))),
d AS (SELECT r, doc_id, unnest({grams}) AS g, unnest(range(0, len(w) - 4)) AS i FROM (SELECT row_number() OVER () AS r, doc_id, {words.format('text')} AS w FROM documents) WHERE len(w) >= 5),
hit AS (SELECT r, doc_id, template, license, n, i, d.g FROM d JOIN t ON d.g = t.g),
s AS (SELECT a.r, a.doc_id, a.template, a.license, a.n, a.i, count(DISTINCT b.g) AS c, max(b.i) AS last FROM hit a JOIN hit b ON a.r = b.r AND a.template = b.template AND b.i >= a.i AND b.i < a.i + a.n + a.n // 4 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY r, template ORDER BY c DESC, i) AS k FROM s)
SELECT doc_id, template, license, round(c / n, 6) AS containment, CAST(i AS INTEGER) AS first_word, CAST(last + 4 AS INTEGER) AS last_word FROM best WHERE k = 1 AND c / n >= 0.8
"""


#: Base32 of a SHA-1 in hex: each five hex digits are four letters.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(s, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '')"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: CRC-32 of the bytes of `s`, a byte at a time: eight shifts, with the polynomial wherever a one falls out.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(s)), 1), lambda i: CAST('0x' || hex(encode(s))[2 * i + 1 : 2 * i + 2] AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _spans_sql(kind: str, pattern: str) -> str:
    """Rows (r, kind, found, start, stop, before, after) of a pattern's matches, from left to right without overlap: marks are put around them, and pieces are measured."""
    quoted = pattern.replace("'", "''")
    return f"""
SELECT r, '{kind}' AS kind, found, start, start + length(found) AS stop, text FROM (
  SELECT r, text, split_part(piece, chr(57345), 1) AS found, nth,
    CAST(sum(length(piece) - CASE WHEN nth > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS start
  FROM (SELECT r, text, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS nth FROM (
    SELECT r, text, string_split(regexp_replace(text, '{quoted}', chr(57344) || '\\0' || chr(57345), 'g'), chr(57344)) AS pieces FROM d)))
WHERE nth > 1"""


def _pii_sql() -> str:
    """Proposals of every kind, their checks, the points of the added kinds, and the digests."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]", "iban": pii.IBAN, "ssn": pii.SSN,
    }
    proposed = " UNION ALL ".join(_spans_sql(k, p) for k, p in patterns.items())
    words = lambda kind: f"regexp_matches(near, '(?i)\\b({'|'.join(pii.FOR[kind])})\\b')"
    against = f"regexp_matches(near, '(?i)\\b({'|'.join(pii.AGAINST)})\\b')"
    points = "CASE kind " + " ".join(f"WHEN '{k}' THEN {pii.START[k]} + CASE WHEN {words(k)} THEN {pii.CONTEXT} ELSE 0 END" for k in pii.KINDS) + f" END - CASE WHEN {against} THEN {pii.CONTEXT} ELSE 0 END"
    luhn = "list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(digits[length(digits) + 1 - i] AS INT) ELSE (2 * CAST(digits[length(digits) + 1 - i] AS INT)) % 10 + (2 * CAST(digits[length(digits) + 1 - i] AS INT)) // 10 END)) % 10 = 0"
    mod97 = "list_reduce(list_prepend(0, list_transform(string_split(substr(bare, 5) || substr(bare, 1, 4), ''), lambda c: CASE WHEN c <= '9' THEN CAST(ascii(c) - 48 AS INT) ELSE CAST(ascii(c) - 55 AS INT) END)), lambda a, c: (a * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97) = 1"
    check = f"""CASE kind WHEN 'email' THEN true
      WHEN 'ip' THEN len(list_filter(string_split(found, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255)) = 0
      WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND {luhn}
      WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
      WHEN 'iban' THEN NOT regexp_matches(substr(text, start, 1), '[A-Za-z0-9]') AND NOT regexp_matches(substr(text, stop + 1, 1), '[A-Za-z0-9]') AND {mod97}
      ELSE regexp_full_match(found, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') AND substr(found, 1, 3) NOT IN ('000', '666') AND found < '9' AND substr(found, 5, 2) <> '00' AND substr(found, 8) <> '0000' END"""
    order = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(pii.KINDS))
    joined = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth) FILTER ({}), '')"
    base = "nth < 4"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT *, CASE kind {order} END AS nth, regexp_replace(found, '[^0-9]', '', 'g') AS digits, replace(found, ' ', '') AS bare,
  substr(text, greatest(1, start + 1 - {pii.NEAR}), least(start, {pii.NEAR})) || ' ' || substr(text, stop + 1, {pii.NEAR}) AS near FROM ({proposed})),
s AS (SELECT * FROM (SELECT *, {check} AS holds, {points} AS points FROM p) WHERE holds AND ({base} OR points >= {pii.LEAST})),
g AS (SELECT r, {counts}, sha256({joined.format(base)}) AS base_sha256, {joined.format('true')} AS spans FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""


SQL: dict[str, str] = {
    "op11_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  unnest(CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') END) AS term FROM documents),
k AS (SELECT lang, term FROM d GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
c AS (SELECT lang, source, term, count(*) AS c FROM d JOIN k USING (lang, term) GROUP BY lang, source, term),
full_c AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM full_c JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER (PARTITION BY lang) + 5 * v) AS q FROM (SELECT lang, term, sum(c) AS c FROM full_c GROUP BY lang, term) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(t.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) t ON t.lang = a.lang AND t.source = a.source AND t.item = b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
""",
    "op12_pii": _pii_sql(),
    "op13_spelling": f"""
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
hashed AS (SELECT run, {_CRC32} AS h FROM (SELECT run, k || ':' || run AS s FROM runs WHERE length(run) >= 7)),
typed AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
w AS (SELECT word, count(*) AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
x AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
exchanged AS (SELECT a.word, b.word AS other FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
fewer AS (SELECT DISTINCT x.word, w.word AS other FROM x JOIN w ON x.rest = w.word),
near AS (SELECT * FROM exchanged UNION ALL SELECT * FROM fewer UNION ALL SELECT other, word FROM fewer),
best AS (SELECT near.word, count(*) AS n_near, first(near.other ORDER BY o.n DESC, near.other) AS form, max(o.n) AS form_n FROM near JOIN w o ON o.word = near.other GROUP BY near.word),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM w LEFT JOIN best USING (word)),
walk(word, last) AS (SELECT word, word FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.last = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.last AS root, f.n, f.n_near, f.form_n FROM f JOIN walk USING (word) JOIN f e ON e.word = walk.last WHERE e.form IS NULL
""",
    "op7_warc": f"""
WITH h AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first FROM h)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f
""",
    "op9_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
c AS (SELECT s, min(doc_id) AS class_id FROM g WHERE len(s) > 0 GROUP BY s),
x AS (SELECT class_id, len(s) AS n, unnest(s) AS k FROM c),
p AS (SELECT a.class_id AS u, b.class_id AS v FROM x a JOIN x b ON a.k = b.k AND a.class_id <> b.class_id GROUP BY a.class_id, b.class_id, a.n, b.n HAVING count(*) * 100 >= 85 * (a.n + b.n - count(*))),
reach(u, v) AS (SELECT class_id, class_id FROM c UNION SELECT t.u, p.v FROM reach t JOIN p ON t.v = p.u),
m AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u), l AS (SELECT u, count(*) AS n_links FROM p GROUP BY u)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, coalesce(m.component_id, g.doc_id) AS component_id, CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links, coalesce(c.class_id, g.doc_id) AS class_id
FROM g LEFT JOIN c ON c.s = g.s LEFT JOIN m ON m.u = c.class_id LEFT JOIN l ON l.u = c.class_id
""",
    "op6_license_scan": _license_sql(),
    "op1_url_filter": _SPLIT
    + """
, judged AS (
  SELECT page_id, host, path,
    CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
    END AS rule
  FROM split
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
""",
    "op5_exact_dedup": """
WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY text_sha256),
n AS (SELECT doc_id, text_sha256, row_number() OVER (PARTITION BY text_sha256, doc_id) AS nth FROM h)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND nth = 1 AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
""",
    "op10_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS terms FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, 1 + least(len(q.terms), len(c.terms))), lambda i: q.terms[i] * c.terms[i])) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 20
""",
}
