"""A kept full-text index (SRC5, SNK1, TXT7, JON4, SRT1): postings are written with each batch, and a search reads few of them.

An upsert tokenises its own documents, and the old versions of those that it replaces; nothing else. It writes
- docs: each document's row, its length and its version (a bucket per key hash);
- blocks: postings of a column and token in a span of documents by hash, of about SPAN documents, with their largest
  tf and smallest length (a bucket per token hash). Texts are dealt by span, and postings are made and packed where they lie;
- lists: per column and token the change of its number of documents, and the same bounds over all its blocks;
- dead: versions that were replaced or deleted. A posting counts if its document's version isn't among them.

A document's postings stay at the level of its batch, compacted or not, so a span's blocks are all that its documents have.

A search goes by largest possible weights (MaxScore over blocks). A query's lists are ordered by their bound. The first
ones, of OPENING times k documents or so, give k scores that are sure to be reached. A span whose blocks' bounds together fall
short of the k-th of these is closed to the query, and so is a posting that can't reach it with all other lists' bounds. What is open
to any query is dealt by document once, whoever asks for it, and meets the queries there: pairs of queries and documents are
neither shuffled nor written, but for k a query and task. Results equal those of `search.top_k` over the live documents.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from admitflow.functions import rules
from admitflow.functions import vocab as V
from admitflow.functions.dialect import SPARK
from admitflow.plans.shared import free_name, materialise
from admitflow.sources.merge_store import Conflict, Pieces, added, replaced

#: Documents in a span on the mean (of LENGTH tokens each, longer ones count more), and how many documents the opening lists hold for each result that is asked for.
SPAN, LENGTH, OPENING = 8192, 256, 4
#: Bytes of a batch in one task that writes documents, spans in one that writes blocks (as powers of two), and pairs of queries and documents in one that scores.
DEALT_BYTES, SPANS, PAIRS = 32 << 20, 2, 1 << 20
#: Most tasks that a batch or a search is dealt to.
TASKS = 1 << 14
#: Scores are rounded to six digits, so a bound must fall this far short of a score.
SLACK = 1e-5
#: The span of a document at a level: level n has 2**n spans.
_SPAN = "pmod(xxhash64(doc), shiftleft(1L, level))"
#: Whether a posting beside its document's dead versions counts.
_ALIVE = "gone IS NULL OR NOT array_contains(gone, version)"


def _weight(idf: Column, tf: Column, length: Column, average: Column) -> Column:
    """Positive here: larger is better. Rises with tf, falls with length."""
    return idf * tf * (V.K1 + 1) / (tf + V.K1 * (1 - V.B + V.B * length / average))


class FullTextIndex:
    """An index in a folder, of documents with the key columns, text columns and further `stored` columns of the given types.

    The last written row of a key counts; of several in one batch, the last by `order`. Documents without tokens are
    documents; null texts have none.
    """

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], columns: list[str], stored: dict[str, str] | None = None, order: list[str] | None = None, buckets: int = 32):
        self.spark, self.keys, self.columns, self.stored, self.order = spark, list(keys), columns, list(stored or {}), order or []
        self.sortable = not any(part in t.lower() for t in (stored or {}).values() for part in ("map", "variant", "interval"))
        self.buckets, self.pieces = buckets, Pieces(spark, path)
        doc = f"struct<{', '.join(f'{k}: {t}' for k, t in keys.items())}>"
        fields = ", ".join(f"`{c}` {t}" for c, t in {**dict.fromkeys(columns, "string"), **(stored or {})}.items())
        self.doc_schema = f"doc {doc}, {fields}, length bigint, version bigint"
        self.block_schema = f"col string, token string, level int, span bigint, df bigint, max_tf bigint, min_length bigint, docs array<struct<doc: {doc}, version: bigint, tf: bigint, length: bigint>>"
        self.list_schema = "col string, token string, df bigint, max_tf bigint, min_length bigint"
        self.dead_schema = f"doc {doc}, version bigint"

    # -- writing

    def _by(self, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def _tokens(self, docs: DataFrame) -> DataFrame:
        """(doc, version, length, col, list)."""
        lists = F.map_from_arrays(F.array(*map(F.lit, self.columns)), F.array(*[F.expr(rules.tokens(SPARK, f"`{c}`")) for c in self.columns]))
        return docs.select("doc", "version", "length", F.explode(lists).alias("col", "list"))

    def _postings(self, docs: DataFrame) -> DataFrame:
        """(col, token, tf) of each row, whose texts are _0, _1 and so on, beside its other columns; counted within the row."""
        starts = "filter(sequence(1, size(x)), i -> i = 1 OR x[i - 2] <> x[i - 1])"
        counts = f"transform(array({starts}), s -> transform(s, (b, j) -> named_struct('token', x[b - 1], 'tf', cast(coalesce(get(s, j + 1), size(x) + 1) - b AS bigint))))[0]"
        counted = lambda c: F.expr(f"transform(array(sort_array({rules.tokens(SPARK, c)})), x -> CASE WHEN size(x) > 0 THEN {counts} END)[0]")
        texts = [f"_{i}" for i in range(len(self.columns))]
        lists = F.map_from_arrays(F.array(*map(F.lit, self.columns)), F.array(*map(counted, texts)))
        rest = [c for c in docs.columns if c not in texts]
        each = docs.select(*rest, F.explode(lists).alias("col", "list")).select(*rest, "col", F.explode("list").alias("p"))
        return each.select(*rest, "col", "p.*")

    def _level(self, n_docs: int, length: int) -> int:
        return math.ceil(math.log2(max(n_docs / SPAN, length / SPAN / LENGTH, 1)))

    def _placed(self, rows: DataFrame, now: int) -> DataFrame:
        """Rows of documents with a level, and their span there, each in one task; spans that documents of level `now` outgrew are cut."""
        cores = math.ceil(math.log2(self.spark.sparkContext.defaultParallelism))
        tasks = 1 << min(now, max(cores, now - SPANS), TASKS.bit_length() - 1)
        finer = F.when(F.col("level") < now, F.expr(f"pmod(xxhash64(doc), {1 << now}L)")).otherwise(F.lit(0))
        placed = rows.withColumn("span", F.expr(_SPAN)).withColumn("cut", finer)
        return placed.withColumn("part", F.expr(f"cast(pmod(xxhash64(doc), {tasks}L) AS int)")).repartitionById(tasks, F.col("part"))

    def _live(self, state: dict, buckets: list[str] | None = None) -> DataFrame:
        docs = self.pieces.load(state, "docs", self.doc_schema, buckets)
        return docs.join(self.pieces.load(state, "dead", self.dead_schema), ["doc", "version"], "left_anti") if state["pieces"].get("dead") else docs

    def live(self) -> DataFrame:
        """The documents that count: keys, texts, stored columns, length."""
        return self._live(self.pieces.state()).select("doc.*", *self.columns, *self.stored, "length")

    def upsert(self, rows: DataFrame, writer: str | None = None, batch: int | None = None, tries: int = 10) -> bool:
        """Whether the rows were taken: a writer's batch that is stored already changes nothing."""
        return self._change(rows, False, writer, batch, tries)

    def delete(self, rows: DataFrame, writer: str | None = None, batch: int | None = None, tries: int = 10) -> bool:
        """Remove the documents of the rows' keys; only these columns are read."""
        return self._change(rows, True, writer, batch, tries)

    def _last(self, rows: DataFrame) -> DataFrame:
        """The last row of each key with its length, dealt once, by parts of the key's bucket."""
        size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        # beyond 2**50 bytes the size is unknown
        parts = self.buckets * max(1, min(math.ceil((size if size < 1 << 50 else 1 << 30) / self.buckets / DEALT_BYTES), TASKS // self.buckets))
        doc = F.struct(*[F.col(f"`{k}`").alias(k) for k in self.keys])
        texts = [*self.columns, *self.stored]
        order = self.order or self.columns
        if self.sortable:  # texts are held once
            names = {c: f"_{i}" for i, c in enumerate(dict.fromkeys([*order, *texts]))}
            last, found = F.max("_row"), rows.select(doc.alias("doc"), F.struct(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).alias("_row"))
        else:
            last, names = F.max_by("_row", "_order"), {c: c for c in texts}
            found = rows.select(doc.alias("doc"), F.struct(*[F.col(f"`{c}`") for c in texts]).alias("_row"), F.struct(*[F.col(f"`{c}`") for c in order]).alias("_order"))
        part = F.pmod(F.xxhash64("doc"), F.lit(parts)).cast("int")
        found = found.withColumn("_part", part).repartitionById(parts, F.col("_part")).groupBy("_part", "doc").agg(last.alias("_row"))
        found = found.select("doc", *[F.col("_row")[names[c]].alias(c) for c in texts])
        # arrays of tokens are never kept: the length is all that later steps need
        length = sum(F.coalesce(F.size(F.expr(rules.tokens(SPARK, f"`{c}`"))), F.lit(0)) for c in self.columns).cast("long")
        return found.withColumn("length", length)

    def _change(self, rows: DataFrame, gone: bool, writer: str | None, batch: int | None, tries: int) -> bool:
        writer = writer or "batch"
        if self.pieces.done(writer, batch):
            return False
        entry, tables, totals = self.pieces.fresh_entry(), {}, (0, 0)
        if gone:
            doc = F.struct(*[F.col(f"`{k}`").alias(k) for k in self.keys]).alias("doc")
            new = materialise(rows.select(doc).distinct(), "batch")
            buckets = [str(r[0]) for r in new.select(self._by("doc")).distinct().collect()]  # as many as there are buckets
        else:
            # a number that no other writer draws: what is written here stays as it is, however many tries it takes
            docs = self._last(rows).withColumn("version", F.lit(uuid.uuid4().int >> 65))
            buckets = tables["docs"] = self.pieces.write(docs, entry, "docs", self._by("doc"), dealt=True)
            new = self._own(entry, "docs", self.doc_schema, tables["docs"])
            totals = new.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
            level = self._level(*totals)
            texts = new.select("doc", "version", "length", F.lit(level).alias("level"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(self.columns)])
            blocks = self._blocks(self._postings(self._placed(texts, level)))
            tables["blocks"] = self.pieces.write(blocks, entry, "blocks", self._by("token"), ["col", "token"], dealt=True)
        for _ in range(tries):
            if self.pieces.done(writer, batch):
                return False
            try:
                return self._commit(new.select("doc"), buckets, entry, tables, totals, writer, batch)
            except Conflict:
                continue  # another writer may have changed the same documents: what is replaced is looked up anew
        raise Conflict(f"no turn among the writers of {self.pieces.path}")

    def _own(self, entry: str, table: str, schema: str, buckets: list[str]) -> DataFrame:
        """What an entry holds of a table, whether a version names it or not."""
        return self.pieces.load({"pieces": {table: {b: [entry] for b in buckets}}}, table, schema)

    def _commit(self, new: DataFrame, buckets: list[str], entry: str, tables: dict[str, list[str]], totals: tuple[int, int], writer: str, batch: int | None) -> bool:
        """Make an entry's documents and blocks valid, and what they replace dead."""
        state, late = self.pieces.state(), self.pieces.fresh_entry()
        live = self._live(state, buckets)
        # the texts that are replaced are read again for their tokens, not written
        old = materialise(live.select("doc", "version", "length").join(new, "doc", "left_semi"), "replaced")
        less = old.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        change = {"docs": totals[0] - less[0], "length": totals[1] - less[1]}
        lists = self._lists(entry, tables.get("blocks", []))
        found = {}
        if less[0]:
            found["dead"] = self.pieces.write(old.select("doc", "version"), late, "dead", self._by("doc"))
            texts = self.pieces.load(state, "docs", self.doc_schema, buckets).join(old.select("doc", "version"), ["doc", "version"], "left_semi")
            removed = self._tokens(texts).select("col", F.explode(F.array_distinct("list")).alias("token")).groupBy("col", "token").agg((-F.count(F.lit(1))).alias("df"))
            lists = lists.unionByName(removed.select("col", "token", "df", F.lit(None).cast("long").alias("max_tf"), F.lit(None).cast("long").alias("min_length")))
        found["lists"] = self.pieces.write(lists, late, "lists", self._by("token"))

        def done(now: dict) -> dict:
            if now["seq"] != state["seq"]:
                raise Conflict
            return added(added(now, entry, tables), late, found, writer, batch, change)

        return self.pieces.commit(done)

    def _blocks(self, postings: DataFrame) -> DataFrame:
        """Blocks of postings that lie by span."""
        packed = [F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"), F.collect_list(F.struct("doc", "version", "tf", "length")).alias("docs")]
        return postings.groupBy("part", "level", "span", "cut", "col", "token").agg(*packed).drop("part", "cut")

    def _lists(self, entry: str, buckets: list[str]) -> DataFrame:
        """The lists of an entry's blocks, from these blocks' own sums."""
        blocks = self._own(entry, "blocks", self.block_schema, buckets)
        return blocks.groupBy("col", "token").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"))

    def compact(self, least: int = 4) -> int:
        """Cut the postings of token buckets with `least` pieces or more anew, without dead ones, and add up their lists; how many there were."""
        state = self.pieces.state()
        crowded = [b for b, e in state["pieces"].get("lists", {}).items() if len(e) >= least]
        if not crowded:
            return 0
        merged = {t: {b: e for b, e in state["pieces"].get(t, {}).items() if b in crowded} for t in ("blocks", "lists")}
        entry = self.pieces.fresh_entry()
        each = self.pieces.load(state, "blocks", self.block_schema, crowded).select("col", "token", "level", F.explode("docs").alias("d")).select("col", "token", "level", "d.*")
        alive = each.join(self._dead(state), "doc", "left").filter(_ALIVE).drop("gone")
        placed = self._placed(alive, self._level(*(int(state["totals"].get(t, 0)) for t in ("docs", "length"))))
        written = {"blocks": self.pieces.write(self._blocks(placed), entry, "blocks", self._by("token"), ["col", "token"], dealt=True)}
        written["lists"] = self.pieces.write(self._lists(entry, written["blocks"]), entry, "lists", self._by("token"))

        def change(now: dict) -> dict | None:
            for table in ("blocks", "lists"):
                if now is not None:
                    now = replaced(now, entry, table, merged[table], written[table])
            return now

        return len(crowded) if self.pieces.commit(change) else 0

    # -- reading

    def _dead(self, state: dict) -> DataFrame:
        """(doc, gone): the versions of each document that no longer count."""
        return self.pieces.load(state, "dead", self.dead_schema).groupBy("doc").agg(F.collect_set("version").alias("gone"))

    def is_empty(self) -> bool:
        return not self.pieces.state()["totals"].get("docs")

    def search(self, queries: DataFrame, query_key: str, query_text: str, k: int = 50, read: dict | None = None) -> DataFrame:
        """query_id, rank, the key columns, score: the k lowest scores of each query (the lower the better), ties by key.

        `read`, if given, gets the numbers of blocks that are open to the queries (of opening lists; of lists whose documents can reach
        the score that is sure without those before, called sources; of others; none are looked up by document) and of all in their lists.
        """
        state = self.pieces.state()
        names = [free_name(n, self.keys) for n in ("query_id", "rank", "score")]
        asked = queries.select(F.col(f"`{query_key}`").alias("query_id"), F.explode(F.array_distinct(F.expr(rules.tokens(SPARK, f"`{query_text}`")))).alias("token")).distinct()
        asked = materialise(asked, "asked")
        wanted = asked.select("token").distinct()
        buckets = [str(r[0]) for r in wanted.select(self._by("token")).distinct().collect()]  # as many as there are buckets
        n_docs, total = (float(state["totals"].get(t, 0)) for t in ("docs", "length"))
        average = F.lit(total / n_docs if n_docs and total else 1.0)
        lists = self.pieces.load(state, "lists", self.list_schema, buckets).join(wanted, "token", "left_semi")
        idf = F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        summed = lists.groupBy("col", "token").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length")).filter("df > 0")
        summed = summed.withColumn("idf", F.when(idf <= 0, F.lit(V.LEAST_IDF)).otherwise(idf))
        summed = summed.withColumn("bound", _weight(F.col("idf"), F.col("max_tf"), F.col("min_length"), average))
        # a number for each list, shorter than its name
        summed = materialise(summed.withColumn("list", F.monotonically_increasing_id()), "lists")
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "col", "token")
        listed = asked.join(summed.drop("max_tf", "min_length"), "token").withColumns({
            "before": F.coalesce(F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "behind": F.sum("bound").over(order.rowsBetween(0, Window.unboundedFollowing)),
            "all": F.sum("bound").over(Window.partitionBy("query_id")),
        })
        listed = materialise(listed, "listed")
        blocks = self.pieces.load(state, "blocks", self.block_schema, buckets).withColumnRenamed("df", "n")
        dead = self._dead(state) if state["pieces"].get("dead") else None
        size = summed.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
        pairs = n_docs * asked.select("query_id").distinct().count()
        tasks = max(self.spark.sparkContext.defaultParallelism, min(int(max(size, pairs)) // PAIRS, TASKS))
        weight = _weight(F.col("idf"), F.col("tf"), F.col("length"), average)
        most = _weight(F.col("idf"), F.col("max_tf"), F.col("min_length"), average)

        def sums(some: DataFrame, met: DataFrame, kept: Column) -> DataFrame:
            """(query_id, doc, weight, sure) over the `kept` postings of some blocks and the queries' lists that they meet.

            Postings lie by document from before they meet queries to the sums. Those below `least`, which no query can use, are left out before.
            """
            lists = met.groupBy("col", "token").agg(*[F.first(c).alias(c) for c in ("list", "idf", "df")], F.min("least").alias("least"))
            each = some.join(lists, ["col", "token"]).filter(most >= F.col("least")).select("list", "idf", "df", "least", F.explode("docs").alias("d"))
            each = each.select("list", "idf", "df", "least", "d.*").filter(weight >= F.col("least")).filter(kept)
            each = each.select("list", "doc", *(["version"] if dead is not None else []), "tf", "length").repartition(tasks, "doc")
            each = each.join(dead, "doc", "left").filter(_ALIVE).drop("gone") if dead is not None else each
            each = each.join(met.select("query_id", "list", "idf", "sure"), "list").select("query_id", "doc", weight.alias("weight"), "sure")
            return each.groupBy("query_id", "doc").agg(F.sum("weight").alias("weight"), F.max("sure").alias("sure"))

        opening = listed.filter(F.col("before") < OPENING * k).withColumns({"least": F.lit(0.0), "sure": F.lit(0.0)})
        # a part of a long list's documents is enough, by hash, so that lists keep the same ones: scores in a part of the lists are sure as well
        few = F.expr(f"pmod(xxhash64(doc), shiftleft(1L, cast(greatest(log2(df / {OPENING * k}D), 0D) AS int))) = 0")
        if read is not None:
            read["opening"] = blocks.join(opening, ["col", "token"]).count()
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight")))
        sure = sums(blocks, opening, few).withColumn("nth", nth).filter(F.col("nth") == k).select("query_id", (F.col("weight") - SLACK).alias("sure"))
        listed = listed.join(sure, "query_id", "left").fillna(0.0, ["sure"])
        # a posting of a list can't bring its document to the score which is sure with a weight below `least`
        listed = materialise(listed.withColumn("least", F.col("sure") - F.col("all") + F.col("bound")), "listed")
        # bounds of spans come from the blocks' own numbers, no posting is read
        bounds = blocks.drop("docs", "n").join(summed.select("col", "token"), ["col", "token"], "left_semi")
        if any(len(e) > 1 for e in state["pieces"].get("blocks", {}).values()):  # a document lies in one of a list's blocks
            bounds = bounds.groupBy("col", "token", "level", "span").agg(F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"))
        bounds = bounds.join(listed.select("query_id", "col", "token", "idf", "sure"), ["col", "token"])
        spans = bounds.groupBy("query_id", "level", "span").agg(F.sum(most).alias("most"), F.first("sure").alias("sure")).filter("most >= sure").select("query_id", "level", "span")
        if read is not None:
            spans = materialise(spans, "spans")
            each = blocks.join(listed, ["col", "token"]).join(spans, ["query_id", "level", "span"]).filter(most >= F.col("least"))
            source = F.col("behind") >= F.col("sure")
            read |= {"sources": each.filter(source).count(), "read": each.filter(~source).count(), "probed": 0, "all": blocks.join(listed, ["col", "token"]).count()}
        opened = blocks.join(materialise(spans.select("level", "span").distinct(), "open"), ["level", "span"], "left_semi")
        scores = sums(opened, listed, F.lit(True)).filter("weight >= sure").select("query_id", "doc", (-F.round("weight", 6)).alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "doc"))
        top = scores.withColumn("rank", rank).filter(F.col("rank") <= k)
        return top.select(F.col("query_id").alias(names[0]), F.col("rank").alias(names[1]), "doc.*", F.col("score").alias(names[2]))
