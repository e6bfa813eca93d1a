"""Mixing sources to target weights by pivotal dependent rounding over a distributed reduction tree.

A source's target is its weight's share of the mix, at most `max_repeat` times its size; what a capped
source can't take is shared again by weight. Every document of a source expects target / size copies:
the whole part is certain, the fraction is decided by pivoting. A document and the rest of its bucket, taken as one
partner, pass mass (fraction times size, so words are conserved) at random until one of the two is integral: the
document is a copy or none, or all of the rest is. What the rest won or lost is spread over its fractions in
proportion, so means are kept. Leaves of the tree are hash buckets of a source, each walked from its longest document
to its shortest, as a long one can only be settled while there is much to settle it with; the `change` shortest
documents and the one left fractional go on, and each level above combines `fan_in` buckets. The root settles all
but one document of a source, commonly one of the shortest. That one goes to the nearer whole number; `mix` takes it
in part (`part` words of one more copy) where the whole document would miss the target by more than `tolerance`.

Defined cases: a null text has size 0, and documents of size 0 are taken 0 words (`copies` is their
certain part); a null source is a source of its own, after all others; repeated rows count each; an
empty table gives an empty result; only key, text and source are read, and a key named like a result column gets an
underscore. Buckets and draws hang on ids, sizes and sources alone, so reruns agree.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from admitflow.plans.shared import bound_batches, free_name, materialise, skew_lookup

WORD = r"[^\x20\x09-\x0D]+"
#: Sources are planned on the driver up to this many (tens of MB), beyond on the executors.
MAX_SOURCES = 200_000
RESULT = ("source", "size", "source_size", "target", "copies", "part", "taken")


def words_in(text: Column) -> Column:
    """Number of maximal runs of anything but space and \\x09-\\x0D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan_targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float], share: float, max_repeat: float) -> list[tuple[str | None, int, float]]:
    """(source, size, target) by code point, null last; `weights` repeat over the sources in that order."""
    order = sorted(sizes, key=lambda s: (s[0] is None, [ord(c) for c in s[0] or ""]))
    weight = [float(w) for _, w in zip(order, itertools.cycle(weights))]
    caps = [max_repeat * size for _, size in order]
    left = min(share * sum(size for _, size in order), math.fsum(caps))
    target, free = [0.0] * len(order), set(range(len(order)))
    while free:
        total = math.fsum(weight[i] for i in free)
        over = {i for i in free if left * weight[i] >= caps[i] * total} if total > 0 else free
        for i in over or free:
            target[i] = caps[i] if over else left * weight[i] / total
        left -= math.fsum(caps[i] for i in over)
        free = free - over if over else set()
    return [(source, size, t) for (source, size), t in zip(order, target)]


_PLAN = "source_index long, source string, source_size long, target double, rows long"


def _planned(per_source: DataFrame, weights: Sequence[float], share: float, max_repeat: float, most: int) -> tuple[DataFrame, bool]:
    """(_PLAN table, whether it is small enough to broadcast) of (source, size, rows)."""
    spark = per_source.sparkSession
    sums = per_source.limit(most + 1).collect()
    if len(sums) <= most:
        rows = {r["source"]: r["rows"] for r in sums}
        plan = plan_targets([(r["source"], r["size"]) for r in sums], weights, share, max_repeat)
        return spark.createDataFrame([(i, s, size, t, rows[s]) for i, (s, size, t) in enumerate(plan)], _PLAN), True
    return _planned_apart(per_source, weights, share, max_repeat), False


def _planned_apart(per_source: DataFrame, weights: Sequence[float], share: float, max_repeat: float) -> DataFrame:
    """The same plan for any number of sources: they are numbered by range partitions, and the driver holds sums only."""
    spark = per_source.sparkSession
    order = [F.col("source").isNull(), "source"]
    ranged = per_source.repartitionByRange(64, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    numbered = materialise(ranged.withColumn("range", F.shiftright(at, 33)).withColumn("nth", at.bitwiseAND(F.lit((1 << 33) - 1))), "sources")
    counts = {r["range"]: r["count"] for r in numbered.groupBy("range").count().collect()}
    starts = dict(zip(sorted(counts), itertools.accumulate([0, *(counts[k] for k in sorted(counts))])))
    base = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in starts.items() for x in pair]), F.col("range"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_index") % len(weights)).cast("int") + 1)
    plan = numbered.withColumn("source_index", base + F.col("nth")).withColumn("weight", weight).withColumn("cap", F.col("size") * F.lit(float(max_repeat)))
    size, caps = plan.agg(F.sum("size"), F.sum("cap")).first()
    left = min(share * size, caps)
    # Filling by the order of cap / weight, the capped sources are those below a level; the level only rises.
    level = 0.0
    while True:
        free, capped = plan.agg(F.sum(F.when(F.col("cap") > F.col("weight") * level, F.col("weight"))), F.sum(F.when(F.col("cap") <= F.col("weight") * level, F.col("cap")))).first()
        rises = (left - (capped or 0.0)) / free if free else math.inf
        if rises <= level * (1 + 1e-12):
            break
        level = rises
        if level == math.inf:
            break
    target = F.least("cap", F.col("weight") * F.lit(level)) if level != math.inf else F.col("cap")
    return materialise(plan.select("source_index", "source", F.col("size").alias("source_size"), target.alias("target"), "rows"), "source-plan")


class _Walk:
    """One bucket from its longest document to its shortest.

    The rest of the bucket is held as its size, its mass and the straight line (gain, base) that its documents'
    first fractions have gone through by now, so memory doesn't grow with the bucket.
    """

    def __init__(self, total: float, mass: float, keep: int, rows: int):
        self.total, self.mass, self.keep, self.rows = total, mass, keep, rows
        self.gain, self.base = 1.0, 0.0

    def next(self, size: float, fraction: float, luck: float) -> float:
        """The next document's fraction: 0 or 1, unless it is among the `keep` last or outlives the rest."""
        q = min(1.0, max(0.0, self.gain * fraction + self.base))
        self.rows -= 1
        self.total = max(0.0, self.total - size)
        self.mass = min(self.total, max(0.0, self.mass - q * size))
        if self.rows < self.keep or q in (0.0, 1.0):
            return q
        up, down = min((1 - q) * size, self.mass), min(q * size, self.total - self.mass)
        if up + down <= 0:
            return q
        if luck * (up + down) < down:  # the document gains `up` words with chance down / (up + down)
            settled = up >= (1 - q) * size * (1 - 1e-12)
            shrink = (self.mass - up) / self.mass if settled and self.mass > 0 else 0.0
            self.gain, self.base, self.mass = self.gain * shrink, self.base * shrink, self.mass * shrink
            return 1.0 if settled else q + up / size
        settled = down >= q * size * (1 - 1e-12)
        room = self.total - self.mass
        shrink = (room - down) / room if settled and room > 0 else 0.0
        self.gain, self.base = self.gain * shrink, self.base * shrink + 1 - shrink
        self.mass = self.total - room * shrink
        return 0.0 if settled else q - down / size


def _walk(keep: int):
    """Walk each (source_index, bucket) of a sorted stream; rows stay in place, their fraction changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, walk, nth = None, None, 0
        for batch in batches:
            names = batch.schema.names
            told = [batch.column(names.index(c)).to_pylist() for c in ("source_index", "bucket", "size", "fraction", "luck", "all_size", "all_mass", "all_rows")]
            out = []
            for index, bucket, size, fraction, luck, total, mass, rows in zip(*told, strict=True):
                if (index, bucket) != group:
                    group, walk, nth = (index, bucket), _Walk(float(total), mass, keep, rows), 0
                nth += 1
                out.append(walk.next(float(size), fraction, (luck + nth * 0.6180339887498949) % 1.0))
            at = names.index("fraction")
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.float64()))

    return run


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeat: float = 2.0, seed: int = 17, bucket_rows: int = 2_000, fan_in: int = 32,
    change: int = 32, tolerance: float = 0.002, text: str = "text", source: str = "source", key: str = "doc_id", max_sources: int = MAX_SOURCES,
) -> DataFrame:
    """One row per document: key, source, size, source_size, target, copies (whole times it is taken), part (words of one more,
    for one document of a source at most), taken (copies * size + part)."""
    bound_batches(docs.sparkSession)
    sized = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("string").alias("source"), words_in(F.col(f"`{text}`")).alias("size"))
    return _mix(sized, weights, share, max_repeat, seed, bucket_rows, fan_in, change, tolerance, max_sources).withColumnRenamed("key", free_name(key, RESULT))


def _mix(sized: DataFrame, weights, share, max_repeat, seed, bucket_rows, fan_in, change, tolerance, max_sources) -> DataFrame:
    """mix for (key, source, size)."""
    kind = sized.schema["key"].dataType.simpleString()
    # equal rows are counted and numbered, so that their number deals them to buckets like others
    sized = sized.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("equal"))
    sized = materialise(sized.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "equal"))).drop("equal"), "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    plan, small = _planned(per_source, weights, share, max_repeat, max_sources)
    named = lambda c: F.concat(F.when(F.col(c).isNull(), "n").otherwise("s"), F.coalesce(F.col(c), F.lit("")))
    plan, left = plan.withColumn("named", named("source")).drop("source"), sized.withColumn("named", named("source"))
    # at most max_sources rows are broadcast; more are joined, with hot sources spread
    met = left.join(F.broadcast(plan), "named") if small else skew_lookup(left, plan, "named", "rows", "key")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(0.0)
    met = met.withColumn("whole", F.floor(ratio).cast("long")).withColumn("fraction", ratio - F.floor(ratio))
    buckets = F.ceil(F.col("rows") / bucket_rows)
    met = met.withColumn("bucket", F.pmod(F.xxhash64("key", "size", "nth"), buckets)).drop("rows", "named")
    most = plan.agg(F.max("rows")).first()[0] or 1
    depth = 1 + max(0, math.ceil(math.log(max(1, math.ceil(most / bucket_rows)), fan_in) - 1e-9))
    columns = ["key", "nth", "source", "size", "source_size", "target", "whole", "fraction", "source_index", "bucket"]
    open_ = (F.col("size") > 0) & (F.col("fraction") > 0) & (F.col("fraction") < 1)
    done = [met.filter(~open_).select(columns)]
    met = met.filter(open_).select(columns)
    kinds = f"key {kind}, nth long, source string, size long, source_size long, target double, whole long, fraction double, source_index long, bucket long"
    for level in range(depth):
        group = Window.partitionBy("source_index", "bucket")
        luck = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), "key", "size", "nth"), 11) / F.lit(float(1 << 53))
        dealt = met.repartition("source_index", "bucket").withColumns(
            {"luck": luck, "all_size": F.sum("size").over(group), "all_mass": F.sum(F.col("size") * F.col("fraction")).over(group), "all_rows": F.count(F.lit(1)).over(group)}
        )
        sorted_ = dealt.sortWithinPartitions("source_index", "bucket", F.desc("size"), "luck", "key", "nth")
        last = level == depth - 1
        walked = sorted_.mapInArrow(_walk(0 if last else change), f"{kinds}, luck double, all_size long, all_mass double, all_rows long").select(columns)
        walked = materialise(walked, f"mix-{level}")
        done.append(walked if last else walked.filter(~open_))
        met = walked.filter(open_).withColumn("bucket", F.floor(F.col("bucket") / fan_in).cast("long"))
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    nearest = F.round("fraction")  # of all but one document a source, 0 or 1 already
    miss = F.abs(F.col("fraction") - nearest) * F.col("size")
    part = F.when(miss > F.col("target") * tolerance, F.round(F.col("fraction") * F.col("size"))).otherwise(0).cast("long")
    result = result.withColumn("part", part).withColumn("copies", F.col("whole") + F.when(F.col("part") > 0, 0).when(miss > F.col("target") * tolerance, 0).otherwise(nearest).cast("long"))
    taken = (F.col("copies") * F.col("size") + F.col("part")).alias("taken")
    rounded = F.col("whole") + nearest.cast("long")
    return result.select("key", "source", "size", "source_size", "target", "copies", "part", taken, rounded.alias("rounded"))


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The whole rows of docs, each as often as the mix takes it; rows aren't cut, so a source's last document is rounded.

    Equal rows are gathered as one with their number by a partial aggregate, and mixed as so many documents, so however many
    they are, none is a hot key.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    text, source = options.get("text", "text"), options.get("source", "source")
    marks = F.concat(F.hex(F.xxhash64(F.lit("a"), *names)), F.hex(F.xxhash64(F.lit("b"), *names)))
    marked = docs.select(marks.alias("mark"), F.col(f"`{text}`").alias("text"), F.col(f"`{source}`").alias("source"))
    mixed = mix(marked, **(options | {"key": "mark", "text": "text", "source": "source"}))
    copies = mixed.groupBy("mark").agg(F.sum("rounded").cast("int").alias("copies")).filter("copies > 0")
    rows = docs.select(marks.alias("mark"), F.struct(*names).alias("row")).groupBy("mark").agg(F.first("row").alias("row"))
    return rows.join(copies, "mark").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
