"""Divergence audit, personal data and spelling variants: against SQL written apart from them, and against brute force."""

import collections
import os
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from admitflow.llm import divergence, pii, queries, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PERSONAL = [
    "write to a.b+c@mail.example.com or x@y or @z.com, a@b.c@d.e", "hosts 1.2.3.4 and 256.1.1.1 and 01.002.3.255.9 and 1.2.3", "card 4111 1111 1111 1111, card 4111-1111-1111-1112, 378282246310005",
    "call +1 (555) 010-9999 or +49 30 1234567 ( or +1 2", "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 and DE88370400440532013000 XDE89370400440532013000", "my ssn is 123-45-6789; number 123-45-6788, ssn 000-45-6789",
    "order no. GB82WEST12345698765432", "bank order DE89370400440532013000é 4111111111111111", "９ é@b.cc ü 4111111111111111 4111111111111111", "1" * 5000 + "." + "1" * 5000, "a" * 100_000 + "@", "1.1.1.1" * 50, "social security 123-45-6789 version",
]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    names = ["alpha", "Beta", "GAMMA", "délta", "epsilon", "z", "über", "zeta's", "日本", "x1y"]
    out = [(i, " ".join(draw.choices(names, range(1, 11), k=draw.choice([1, 5, 60]))), draw.choice(["en", "en", "de", None]), f"s{draw.choice([0, 0, 0, 1, 2, 3, 4, 5, 6, 7])}", 1) for i in range(160)]
    out += [(1000 + i, t, "en", None, None) for i, t in enumerate(PERSONAL)]
    return [*out, (2000, None, None, None, None), (2001, "", "fr", "s1", 0), (2001, "", "fr", "s1", 0), (2002, "alpha " * 40_000, "fr", "s2", 5), (2003, "lonely", "xx", "s1", 5), (None, "alphabet Alphabet", "en", "s0", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"term": F.lit(1), "key": F.lit("k"), "spans": F.lit("x"), "part": F.lit(2)}).repartition(3)


def by_sql(name, rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"}))
    found = con.execute(queries.SQL[name])
    return [c[0] for c in found.description], found.fetchall()


def same(got, name, rows):
    columns, want = by_sql(name, rows)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, ([r[c] for c in columns] for r in got.collect()))) == sorted(map(str, map(list, want)))


def test_divergence(spark, docs, rows):
    got = divergence.audit(docs)
    same(got, "op11_divergence", rows)
    # one group a block, three terms a segment: all rounds and sums of parts give the same
    small = divergence.audit(docs, block_bytes=1, blocks=7, segment=3)
    assert sorted(map(str, small.collect())) == sorted(map(str, got.collect()))
    assert divergence.audit(docs.limit(0)).count() == 0
    nothing = divergence.audit(docs, least_docs=10_000).collect()
    assert nothing and {(r["part"], r["value"]) for r in nothing} == {("pair", 0)}


def test_rounds_meet_every_pair_once(spark):
    for players in (2, 4, 6, 8):
        met = collections.Counter()
        for number in range(players - 1):
            blocks = spark.range(players).select(F.col("id").cast("int").alias("b"), F.lit(players).alias("n"))
            for r in blocks.select("b", divergence.opponent(F.col("b"), F.col("n"), number).alias("o")).collect():
                met[r["b"], r["o"]] += 1
        assert met == {(a, b): 1 for a in range(players) for b in range(players) if a != b}


def test_residents_stay(spark, docs):
    """The table that stays isn't shuffled again when guests come."""
    resident = docs.selectExpr("coalesce(lang, '') AS lang", "doc_id % 3 AS block", "doc_id % 2 AS segment", "text").repartition(8, "lang", "block", "segment").persist()
    resident.count()
    keys = ["lang", "block", "segment"]
    guests = resident.filter("block > 0").withColumn("block", F.col("block") - 1)
    guests = guests.select(*[F.col(c).alias(c) for c in guests.columns])
    met = resident.filter("block < 2").groupBy(*keys).cogroup(guests.groupBy(*keys)).applyInArrow(lambda a, b: a, resident.schema)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ENSURE_REQUIREMENTS") == 1, plan
    resident.unpersist()


def test_shares_are_exact():
    draw = random.Random(1)
    import numpy as np

    for _ in range(200):
        total, kept = draw.randrange(1, 8 * 10**15), draw.randrange(1, 10**6)
        counts = [draw.randrange(total), 0, total]
        assert divergence.shares(np.array(counts), total, kept).tolist() == [1 + (10**9 * (c + 5)) // (total + 5 * kept) for c in counts]
    with pytest.raises(OverflowError):
        divergence.shares(np.array([1]), 10**16, 1)
    ids, counts = np.array([0, 5, 1 << 40]), np.array([1, 1 << 50, 3])
    again = divergence.unpack_vector(divergence.pack_vector(ids, counts))
    assert again[0].tolist() == ids.tolist() and again[1].tolist() == counts.tolist()


def test_personal_data(spark, docs, rows):
    got = queries.op12_pii(_Tables(spark, docs), "")
    same(got, "op12_pii", rows)
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for text in PERSONAL:
        if len(text) < 1000:  # the patterns as they are written take the square of a long text
            want = {(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, text) if k == "email" or pii._holds(k, text, *m.span())}
            assert {s[:3] for s in pii.spans_of(text) if s[0] in pii.BASE} == want


def test_context_and_redaction(spark):
    kinds = lambda text: [(s[0], s[4]) for s in pii.spans_of(text)]
    assert kinds("ssn 123-45-6789") == [("ssn", 70)] and kinds("123-45-6789") == [] and kinds("ssn of order 123-45-6789") == []
    assert kinds("GB82WEST12345698765432") == [("iban", 80)] and kinds("order GB82WEST12345698765432") == []
    assert kinds("visa card 4111111111111111") == [("card", 100)] and kinds("serial 4111111111111111") == [("card", 40)]
    docs = spark.createDataFrame([("to a@b.cc, +1 234 567 8901 now",), (None,), ("clean text",), ("",)], "text string").withColumn("spans", F.lit(1))
    assert [tuple(r) for r in pii.redact(docs).collect()] == [("to [EMAIL], [PHONE] now", 1), (None, 1), ("clean text", 1), ("", 1)]
    assert pii.find(docs.limit(0), key="spans").count() == 0


def test_spelling(spark, docs, rows):
    same(spelling.group(spelling.words_of(docs)), "op13_spelling", rows)


def test_near_words_by_brute_force(spark):
    draw = random.Random(3)
    words = {"".join(draw.choices("abé", k=draw.choice([3, 4, 4, 5]))) for _ in range(150)} | {"", "ÿ", "abcdefgh", "abcdefg", "bacdefg"}
    table = spark.createDataFrame([(w, len(w) ** 3 + 1) for w in words], "word string, n long")

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    want = sorted((a, b) for a in words for b in words if a and b and near(a, b))
    for hot in (10_000, 4, 0):  # plain buckets, some by letters' order, all
        got = sorted(tuple(r) for r in spelling.near_pairs(table, hot).collect())
        assert [p for p in got if "" not in p] == want
    assert spelling.group(table).count() == len(words)
    with pytest.raises(ValueError):
        spelling.group(table, ratio=1)


def test_chains_of_forms(spark):
    words = [("aaaaaaa" + "b" * i, 10**i) for i in range(9)]
    got = {r["word"]: r["root"] for r in spelling.group(spark.createDataFrame(words, "word string, n long")).collect()}
    assert set(got.values()) == {words[-1][0]}
    assert spelling.group(spark.createDataFrame([], "word string, n long")).count() == 0


class _Tables:
    """A session whose tables are all the given one, for a registered query."""

    def __init__(self, spark, table):
        self.spark, self.table = spark, table
        self.read = self

    def parquet(self, path):
        assert os.path.basename(path) == "documents.parquet"
        return self.table
