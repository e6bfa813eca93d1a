"""Spelling variants: words one letter apart meet by anagram hashing.

A word's key is the sum over its letters of a power of the letter's number, so anagrams share it and one letter more,
less or exchanged changes it by that letter's value or by the difference of two. Instead of trying all values of the alphabet
on every word, only values of its own letters are taken away: a word less one letter meets the whole words with that key
(addition, removal), and other words less another letter (exchange). The join key also holds one half of the word, from
its start or its end: a single difference leaves one of the two as it was. The pairs that meet are then verified by
their letters' order (edit distance 1). Keys are exact integers; other words on the same key only cost a check.

Buckets of over `hot` words (anagrams of each other, by the thousand) are met by letters' order itself: the word less the
letter at each of its places, so that all that meet there are near. Near words are counted and ranked from pairs, which
number at most a word's length times the alphabet for each word, whatever the table.

Defined cases: a null text holds no word; a null id stands for an empty text in the hash; repeated rows count each;
empty tables, and those without a word that occurs twice, give empty results; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.plans.shared import materialise

#: The letters of a word, all others part words.
LETTERS = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Power to which a letter's number (1 to 90) is raised: sums stay below 2**63 up to 1.5 billion letters, more than a text holds.
POWER = 5
#: Words of one bucket that meet all others there; more meet by their letters' order.
HOT = 256
#: Rounds that follow forms to their roots, each over twice the distance; n doubles at least with each form, so 64 forms are the most.
ROUNDS = 8


def value_of(letter: Column) -> Column:
    """The letter's number (a is 1, letters from U+00C0 on follow z), to the fifth power."""
    code = F.ascii(letter)
    number = F.when(code >= 192, code - 192 + 27).otherwise(code - 96).cast("long")
    out = number
    for _ in range(POWER - 1):
        out = out * number
    return out


def anagram_key(word: Column) -> Column:
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda total, letter: total + value_of(letter))


def words_of(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 7, least_count: int = 2, errors: int = 31) -> DataFrame:
    """(word, n): the runs of letters of at least `least_length` code points, and how often they occur.

    One run in `errors`, by hash of its row's key and itself, loses a letter, as a typing error would (0: none does).
    """
    runs = F.filter(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(LETTERS), F.lit(0)), lambda r: F.length(r) >= least_length)
    each = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.explode(runs).alias("run"))
    each = each.select("key", F.translate("run", _UPPER, _LOWER).alias("run"))
    if errors:
        hashed = each.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        each = hashed.select(F.when(F.col("h") % errors == 0, less).otherwise(F.col("run")).alias("run")).filter(F.length("run") >= least_length)
    return each.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _halves(word: Column, length: Column) -> Column:
    """What one difference can leave alone of a word: its start, or its end. `length` is the shorter word's."""
    half = F.floor(length / 2).cast("int")
    return F.array(F.concat(F.lit("<"), F.substring(word, F.lit(1), half)), F.concat(F.lit(">"), F.right(word, length - half)))


def _keyed(words: DataFrame) -> DataFrame:
    """(word, key, letter, half): each word whole (letter null), and less each of its distinct letters."""
    own = words.select("word", anagram_key(F.col("word")).alias("key"), F.length("word").alias("length"))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("letter"), F.col("key").alias("key"), _halves(F.col("word"), F.col("length")).alias("halves")))
    short = _halves(F.col("word"), F.col("length") - 1)
    less = F.transform(F.array_distinct(F.split("word", "")), lambda c: F.struct(c.alias("letter"), (F.col("key") - value_of(c)).alias("key"), short.alias("halves")))
    rows = own.select("word", F.explode(F.concat(whole, less)).alias("r")).select("word", "r.letter", "r.key", "r.halves")
    return rows.select("word", "letter", "key", F.explode("halves").alias("half"))


def _met(rows: DataFrame, on: list[str]) -> DataFrame:
    """Pairs (word, other) of words less a letter with whole words, and of two less different letters, each pair once or more."""
    short = rows.filter("letter is not null")
    one = short.select(*on, "word", "letter")
    other = rows.select(*on, F.col("word").alias("other"), F.col("letter").alias("other_letter"))
    met = one.join(other, on).filter("other_letter is null or other_letter < letter")
    return met.select("word", "other")


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, other), both ways and once each, of the words of `words` that differ by one letter more, less or exchanged."""
    rows = materialise(_keyed(words.select("word").distinct()), "keyed")
    size = rows.groupBy("key", "half").agg(F.count(F.lit(1)).alias("rows"))
    crowded = materialise(size.filter(F.col("rows") > hot).select("key", "half"), "crowded")
    plain = _met(rows.join(crowded, ["key", "half"], "left_anti"), ["key", "half"]).filter(F.levenshtein("word", "other", 1) == 1)
    # each place where the letter stands, and what is left without it; a whole word is left as it is
    packed = rows.join(crowded, ["key", "half"], "left_semi").select("word", "letter").distinct()
    places = F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", i, F.lit(1)) == F.col("letter"))
    each = packed.select("word", "letter", F.explode(F.when(F.col("letter").isNull(), F.array(F.lit(0))).otherwise(places)).alias("place"))
    left = F.when(F.col("place") == 0, F.col("word")).otherwise(F.concat(F.substring("word", F.lit(1), F.col("place") - 1), F.substring("word", F.col("place") + 1, F.length("word"))))
    each = each.withColumn("left", left)
    gone, whole = each.filter("place > 0"), each.filter("place = 0").select("left", F.col("word").alias("other"))
    exchanged = gone.select("left", "place", "word").join(gone.select("left", "place", F.col("word").alias("other")), ["left", "place"]).filter("word > other")
    pairs = plain.unionByName(gone.select("left", "word").join(whole, "left").select("word", "other")).unionByName(exchanged.select("word", "other"))
    both = pairs.select(F.explode(F.array(F.struct("word", "other"), F.struct(F.col("other").alias("word"), F.col("word").alias("other")))).alias("p"))
    return both.select("p.word", "p.other").distinct()


def roots(forms: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(word, root) of words with a form: the last one that forms lead to. Each round doubles the distance."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now
    raise RuntimeError(f"forms did not end in {rounds} rounds")


def group(words: DataFrame, ratio: int = 10, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of words (word, n; each word once).

    A word's form is its near word of largest n, ties to the smallest, if that has at least `ratio` times its own n; `ratio`
    is 2 or more, so that forms lead to ever more frequent words and end.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word: take a ratio of 2 or more")
    words = materialise(words.select("word", "n"), "words")
    counted = near_pairs(words, hot).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    # the least of (-n, word) is the largest n's smallest word
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    enough = -F.col("best.minus") >= ratio * F.col("n")
    form, form_n = F.when(enough, F.col("best.other")), F.when(enough, -F.col("best.minus"))
    found = materialise(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"), form_n.alias("form_n")), "near")
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
