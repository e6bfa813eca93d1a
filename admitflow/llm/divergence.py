"""Source divergence audit: how far each source's terms lie from its peers' and from its language's, by systolic rotation.

A group is a source within a language, its vector the counts of the language's kept terms. Groups are dealt to blocks, which
stay where they are; their peers' vectors, compressed, go round: in each round of a round-robin tournament every block
meets one other, once in all rounds, as its guest or as its host, and the host works out both directions. The round
before the first is each block's own: its groups meet each other and their language's vector, against which
a heap of each group ranks the terms that it overuses.

Nothing grows without bound in a task: a block has BLOCK_GROUPS groups and BLOCK_BYTES of vectors or so, beyond which there are more blocks and
rounds; vectors are cut by SEGMENT terms, and distances, which are sums over terms, are added up over the segments.
A round's rows are written to the shared folder, so a lost executor repeats a round at most; residents that are lost are read
again from the table they came from. All numbers are integers and exact: the division takes three steps of a thousand.

Defined cases: null text, language and source count as empty ones; a group or a language without kept terms still takes part (with
no kept term at all, distances are 0); repeated rows count each; an empty table gives an empty result; only the
named columns are read; a sum of counts beyond 9 * 10**15 raises OverflowError.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from admitflow.plans.shared import bound_batches, fresh_path, materialise

#: Compressed bytes of vectors and groups that a block holds, and how many blocks a language has at least where it has the groups.
BLOCK_BYTES, BLOCK_GROUPS, BLOCKS = 4 << 20, 512, 6
#: Terms in a segment of the vocabulary.
SEGMENT = 1 << 20
#: Distinct terms that a task counts before it hands them on.
HELD = 200_000
#: Shares are parts of this number.
UNIT = 1_000_000_000

COUNTS = "lang string, source string, term string, count long, docs long"
MET = "lang string, source string, part string, item string, term_id long, value long"
_MET = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("term_id", pa.int64()), ("value", pa.int64())])

_KEPT = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in (_KEPT[i] for i in range(256)))


def terms_of(text: str) -> list[bytes]:
    """Runs of A-Z, a-z and characters beyond ASCII, with A-Z lower-cased: all other bytes part terms."""
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and documents of each (language, source, term), added up before they are shuffled."""
    counts: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            own = docs[lang, source]
            names = [t.decode("utf-8", "surrogatepass") for t in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array([source] * len(found), pa.string()), pa.array(names, pa.string()), pa.array(found.values(), pa.int64()), pa.array([own[t] for t in found], pa.int64())],
                names=["lang", "source", "term", "count", "docs"],
            )
        counts.clear()
        docs.clear()

    held = 0
    for batch in batches:
        for text, lang, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key, found = (lang, source), Counter(terms_of(text))
            own = counts.setdefault(key, Counter())
            held -= len(own)
            own.update(found)
            held += len(own)
            docs.setdefault(key, Counter()).update(found.keys())
            if held >= HELD:
                yield from flush()
                held = 0
    yield from flush()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, count, docs)."""
    bound_batches(docs.sparkSession)
    full = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    parts = docs.select(full(text).alias("text"), full(lang).alias("lang"), full(source).alias("source")).mapInArrow(_count, COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def numbered(terms: DataFrame, by: list[str], name: str = "term_id") -> DataFrame:
    """terms in a table of the shared folder, numbered from 0 in the order of `by` without a gap, by all tasks at once."""
    spark = terms.sparkSession
    parts = max(8, spark.sparkContext.defaultParallelism)
    # Spark's own ids rise along a sorted table and leave gaps between its partitions: the partition is in the upper bits
    own = materialise(terms.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = own.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))  # a row for each partition
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    return own.join(F.broadcast(starts), part == F.col("_part")).select(*terms.columns, (F.col("_start") + within).alias(name))


def pack_vector(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted ids, as steps, and counts: the bytes of equal weight stand together, which compresses well."""
    both = np.stack([np.diff(ids, prepend=0), counts]).astype("<u8")
    return zlib.compress(np.ascontiguousarray(both.reshape(-1).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_vector(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
    both = np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").reshape(2, -1).astype(np.int64)
    return np.cumsum(both[0]), both[1]


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 5) / (total + 5 * kept)), exactly: long division by three thousands."""
    below = total + 5 * kept
    if below > 9 * 10**15:
        raise OverflowError(f"{total} occurrences of {kept} terms are too many for 64 bits")
    above = counts.astype(np.int64) + 5
    out, rest = above // below, above % below
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // below, rest % below
    return out + 1


@F.arrow_udf(T.BinaryType())
def _packed(vectors: pa.Array) -> pa.Array:
    out = []
    for row in vectors:
        pairs = row.values
        out.append(pack_vector(pairs.field(0).to_numpy(), pairs.field(1).to_numpy()))
    return pa.array(out, pa.binary())


class _Block:
    """The vectors of some groups over one segment, decoded: shares of the terms that a group has, and of one it hasn't."""

    def __init__(self, rows: list[dict]):
        self.sources = [r["source"] for r in rows]
        self.width = rows[0]["width"] if rows else 0  # terms in the segment
        found = [unpack_vector(r["vector"]) for r in rows]
        self.ids, self.ends = [ids for ids, _ in found], np.cumsum([len(ids) for ids, _ in found])
        self.shares = [shares(counts, r["total"], r["kept"]) if r["kept"] else counts for r, (_, counts) in zip(rows, found, strict=True)]
        self.absent = np.array([int(shares(np.zeros(1, dtype=np.int64), r["total"], r["kept"])[0]) if r["kept"] else 0 for r in rows], dtype=np.int64)
        self.flat_ids = np.concatenate([*self.ids, np.zeros(0, dtype=np.int64)])
        self.flat_shares = np.concatenate([*self.shares, np.zeros(0, dtype=np.int64)])
        self.owner = np.repeat(np.arange(len(rows)), [len(i) for i in self.ids])

    def distances(self, guest: "_Block", g: int) -> np.ndarray:
        """Of each group here to the guest's g-th: over the terms of both, of one, and of neither."""
        ids, own, absent = guest.ids[g], guest.shares[g], guest.absent[g]
        # as if a group had no term: its share of an absent one against all of the guest's, by sums of the sorted ones
        ordered = np.sort(own)
        sums = np.concatenate([[0], np.cumsum(ordered)])
        below = np.searchsorted(ordered, self.absent)
        out = (self.width - len(ids)) * np.abs(self.absent - absent) + self.absent * (2 * below - len(own)) + sums[-1] - 2 * sums[below]
        if len(self.flat_ids):
            met = np.full(len(self.flat_ids), absent)
            if len(ids):
                at = np.minimum(np.searchsorted(ids, self.flat_ids), len(ids) - 1)
                met = np.where(ids[at] == self.flat_ids, own[at], absent)
            # then what its terms change
            change = np.abs(self.flat_shares - met) - np.abs(self.absent[self.owner] - met)
            sums = np.concatenate([[0], np.cumsum(change)])
            out = out + sums[self.ends] - sums[np.concatenate([[0], self.ends[:-1]])]
        return out


def _table(lang: str, part: str, source: list, item: list, term_id: list, value: np.ndarray | list) -> pa.Table:
    rows = len(source)
    return pa.Table.from_arrays([pa.array([lang] * rows, pa.string()), pa.array(source, pa.string()), pa.array([part] * rows, pa.string()), pa.array(item, pa.string()), pa.array(term_id, pa.int64()), pa.array(value, pa.int64())], schema=_MET)


def _meet(lang: str, home: _Block, guest: _Block) -> Iterator[pa.Table]:
    """Both directions of each pair; of a block with itself, each pair once."""
    for g, item in enumerate(guest.sources):
        ours = home.sources[:g] if guest is home else home.sources
        values = home.distances(guest, g)[: len(ours)]
        theirs = [item] * len(ours)
        yield _table(lang, "pair", ours + theirs, theirs + ours, [None] * (2 * len(ours)), np.tile(values, 2))


def _overused(lang: str, home: _Block, whole: _Block, top: int) -> Iterator[pa.Table]:
    """The heap of each group: its terms with a larger share than the language's, largest difference first, then smallest id."""
    for source, ids, own in zip(home.sources, home.ids, home.shares, strict=True):
        excess = own - whole.shares[0][np.searchsorted(whole.ids[0], ids)]
        at = np.flatnonzero(excess > 0)
        heap = heapq.nlargest(top, zip(excess[at].tolist(), (-ids[at]).tolist(), strict=True))
        yield _table(lang, "term", [source] * len(heap), [None] * len(heap), [-minus for _, minus in heap], [value for value, _ in heap])


def _round(top: int):
    """A block's meeting: with its guests, or, where the language's own vector came, with that and itself."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lang, home, guests = key[0].as_py(), _Block(left.to_pylist()), right.to_pylist()
        found = []
        if home.sources and guests:
            guest = _Block(guests)
            found = [*_overused(lang, home, guest, top), *_meet(lang, home, home)] if guest.sources == [None] else [*_meet(lang, home, guest)]
        return pa.concat_tables([_MET.empty_table(), *found])

    return run


def opponent(block: Column, players: Column, number: int) -> Column:
    """Whom a block meets in a round: the last player stands, all others turn by one place; `players` is even."""
    turning = players - 1
    other = F.pmod(F.lit(2 * number) - block, turning)
    return F.when(block == turning, F.pmod(F.lit(number), turning)).when(other == block, turning).otherwise(other)


def _vectors(kept: DataFrame, counts: DataFrame, groups: DataFrame, segment: int) -> DataFrame:
    """(lang, source, total, kept, segment, width, vector): every group of a language in every segment of its terms.

    The language itself is the row whose source is null; a language without kept terms has one segment of width 0.
    """
    ids = kept.select("lang", "term", "term_id", (F.col("term_id") / segment).cast("long").alias("segment"))
    own = counts.join(ids, ["lang", "term"]).select("lang", "source", "segment", "term_id", "count")
    whole = kept.select("lang", F.lit(None).cast("string").alias("source"), (F.col("term_id") / segment).cast("long").alias("segment"), "term_id", F.col("lang_count").alias("count"))
    both = own.unionByName(whole).withColumn("is_whole", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    # a segment bounds what one group collects
    held = both.groupBy("lang", "is_whole", "source", "segment").agg(F.sum("count").alias("part"), _packed(F.sort_array(F.collect_list(F.struct("term_id", "count")))).alias("vector"))
    held = materialise(held, "vectors")
    totals = held.groupBy("lang", "is_whole", "source").agg(F.sum("part").alias("total"))
    widths = ids.groupBy("lang", "segment").agg(F.count(F.lit(1)).alias("width"))
    kepts = widths.groupBy("lang").agg(F.sum("width").alias("kept"))
    names = groups.select("lang", F.lit(False).alias("is_whole"), "source").unionByName(groups.select("lang", F.lit(True).alias("is_whole"), F.lit("").alias("source")).distinct())
    frame = names.join(kepts, "lang", "left").join(widths, "lang", "left").fillna({"kept": 0, "segment": 0, "width": 0})
    full = frame.join(totals, ["lang", "is_whole", "source"], "left").join(held.drop("part"), ["lang", "is_whole", "source", "segment"], "left")
    nothing = F.lit(bytearray(pack_vector(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))))
    source = F.when(~F.col("is_whole"), F.col("source"))
    return full.select("lang", source.alias("source"), F.coalesce("total", F.lit(0)).alias("total"), "kept", "segment", "width", F.coalesce("vector", nothing).alias("vector"))


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30, top: int = 50, block_bytes: int = BLOCK_BYTES, blocks: int = BLOCKS, segment: int = SEGMENT
) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has each other source of the language, part `term` the `top` overused terms.

    value is the sum of the differences of shares over all kept terms (those in `least_docs` documents of the language), or the
    difference of one term's; rank counts from 1 per group and part, largest value first, then by item.
    """
    spark = docs.sparkSession
    groups = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]).distinct()
    counts = materialise(term_counts(docs, text, lang, source), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("lang_count")).filter(F.col("docs") >= least_docs)
    kept = numbered(kept.select("lang", "term", "lang_count"), ["lang", "term"])
    vectors = materialise(_vectors(kept, counts, groups, segment), "vectors")

    # as many blocks as the bytes need; an even number, one of which may be empty
    size = vectors.filter("source is not null").groupBy("lang").agg(F.countDistinct("source").alias("groups"), F.sum(F.length("vector")).alias("bytes"))
    needed = F.least(F.greatest(F.lit(blocks), F.ceil(F.col("bytes") / block_bytes), F.ceil(F.col("groups") / BLOCK_GROUPS)), F.col("groups")).cast("int")
    size = size.select("lang", needed.alias("blocks"), (needed + needed % 2).alias("players"))
    rounds = (size.agg(F.max("players")).first()[0] or 0) - 1
    dealt = vectors.join(size, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["lang", "block", "segment"]
    # a number of partitions that Spark may not change, so that residents stay where they are in all rounds
    resident = dealt.filter("source is not null").repartition(parts, *keys).persist()
    resident.count()  # only a plan that has run tells how it is partitioned
    whole = dealt.filter("source is null").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    path = fresh_path(spark, "rounds")
    for number in range(-1, rounds):
        if number < 0:
            homes, guests = resident, whole
        else:
            playing = resident.filter(F.col("players") > number + 1).withColumn("other", opponent(F.col("block"), F.col("players"), number))
            # the host of a pair is its smaller block, or its larger one where their sum is odd
            is_host = (F.col("block") < F.col("other")) == ((F.col("block") + F.col("other")) % 2 == 0)
            homes = playing.filter(is_host).drop("other")
            guests = playing.filter(~is_host).withColumn("block", F.col("other")).drop("other")
        guests = guests.select(*[F.col(c).alias(c) for c in guests.columns])  # columns of their own, as both come from one table
        met = homes.groupBy(*keys).cogroup(guests.groupBy(*keys)).applyInArrow(_round(top), MET)
        met.write.mode("overwrite").parquet(f"{path}/round={number}")
    resident.unpersist()
    if rounds < 0:
        return spark.createDataFrame([], "lang string, source string, part string, item string, value long, rank int")
    found = spark.read.schema(MET).parquet(path).drop("round").repartition("lang", "source")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = found.filter("part = 'term'").drop("item").join(kept.select("term_id", F.col("term").alias("item")), "term_id").select("lang", "source", "part", "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.unionByName(terms).withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top))
