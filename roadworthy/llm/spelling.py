"""Spelling variants: words one edit apart, found by pivotal grams.

Bigrams are ordered by rarity over the vocabulary.  A word's gram prefix is
its three rarest bigrams (and any more that tie with the third); its two
pivots are the cheapest pair of disjoint bigrams of the prefix, chosen by
dynamic programming.  One edit touches at most one of two disjoint bigrams, so
of two words one edit apart the one whose prefix ends earlier has a pivot that
stands, untouched, in the other's prefix.  Pivots are joined with prefixes
on that bigram under position limits: with one edit, everything on one side of
an untouched bigram is equal, and of the other side, whose lengths differ by
one at most, the first or the second half is.  The join key holds the equal
parts, so a bigram that many words share does not make them all meet; each
pair that meets is verified by its edit distance inside the join.

No join broadcasts: Spark sizes signatures by the file of the words, of which
each makes many, and other sides by compressed files.

The order of rarity counts bigrams in ``BUCKETS`` hash buckets, a table of
fixed size whatever the alphabet; bigrams of one bucket tie, and ties stay in
the prefix, so nothing is lost by it.

Defined results: null words and words without count take no part; a word given
several times has the sum of its counts; words shorter than ``length`` (at least four
code points, so that there are three bigrams) or rarer than ``least`` are
neither words nor neighbours; of near words of equal count the one first in
code-point order is the form; an empty table gives no rows; other columns are
ignored.  A word may be of any length; the signatures of a word of m code
points take space in proportion to m.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadworthy.llm.common import by_merge, setting, written
from roadworthy.session import remove_path, shared_dir

BUCKETS = 1 << 16
#: An equal side of so many code points is key enough; a shorter one is joined with half of the other side.
LONG_SIDE = 7


def _order(gram: str, counts: np.ndarray) -> int:
    """A gram's place in the order of rarity: its bucket's count, then its bucket."""
    bucket = zlib.crc32(gram.encode()) % BUCKETS
    return int(counts[bucket]) << 16 | bucket


def prefix(word: str, counts: np.ndarray) -> list[tuple[int, int]]:
    """(order, position) of the three rarest bigrams and of all that tie with the third, rarest first."""
    grams = sorted((_order(word[i:i + 2], counts), i) for i in range(len(word) - 1))
    return [g for g in grams if g[0] <= grams[2][0]]


def pivots(grams: list[tuple[int, int]]) -> list[int]:
    """Positions of two disjoint bigrams whose orders add up to the least.

    One step of the dynamic programme a bigram, by position: the cheapest
    bigram that ended before it, and the cheapest pair with it as second.
    """
    by_place = sorted((at, cost) for cost, at in grams)
    pair, free, first = None, 0, None
    for at, cost in by_place:
        while by_place[free][0] <= at - 2:
            first = min(first, by_place[free][::-1]) if first else by_place[free][::-1]
            free += 1
        if first and (pair is None or first[0] + cost < pair[0]):
            pair = (first[0] + cost, first[1], at)
    return list(pair[1:])


def _hash(*parts) -> int:
    value = xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode())
    return value - (1 << 64) if value >> 63 else value


def _sides(word: str, at: int) -> Iterator[tuple[str, str, int]]:
    """The word read from either end, with the length of the side that ends with the bigram."""
    yield "L", word, at + 2
    yield "R", word[::-1], len(word) - at


def prefix_keys(word: str, at: int) -> Iterator[int]:
    """Keys under which a word waits for pivots equal to its bigram at ``at``."""
    for side, text, k in _sides(word, at):
        if k >= LONG_SIDE:
            yield _hash(side, text[:k])
            continue
        rest = len(text) - k
        half = rest // 2
        yield _hash(side, 1, rest, text[:k + half])
        yield _hash(side, 2, rest, text[:k], text[k + half:])


def pivot_keys(word: str, at: int) -> Iterator[int]:
    """Keys under which words one edit away from ``word``, with its bigram at ``at`` untouched, wait."""
    for side, text, k in _sides(word, at):
        if k >= LONG_SIDE:
            yield _hash(side, text[:k])
            continue
        own = len(text) - k
        for rest in range(max(own - 1, 0), own + 2):
            half = rest // 2
            if half <= own:
                yield _hash(side, 1, rest, text[:k + half])
            if rest - half <= own:
                yield _hash(side, 2, rest, text[:k], text[len(text) - (rest - half):])


def _signatures(words: DataFrame, counts, pivotal: bool) -> DataFrame:
    """(key, last, word, n): one row a key; last is the order of the prefix's last bigram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            keys, lasts, at_row = [], [], []
            for row, word in enumerate(batch.column("word").to_pylist()):
                grams = prefix(word, table)
                places = pivots(grams) if pivotal else [at for _, at in grams]
                # Two bigrams of one word may share a key; the word waits there once.
                found = {key for at in places for key in (pivot_keys if pivotal else prefix_keys)(word, at)}
                keys.extend(found)
                lasts.extend([grams[-1][0]] * len(found))
                at_row.extend([row] * len(found))
            take = pa.array(at_row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(lasts, pa.int64()), batch.column("word").take(take), batch.column("n").take(take)],
                names=["key", "last", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, last long, word string, n long")


def vocabulary(words: DataFrame, length: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of the words of at least ``length`` code points with at least ``least`` occurrences."""
    if length < 4:
        raise ValueError("words have at least four code points")
    counted = words.where(F.length("word") >= length).groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    return counted.where(F.col("n") >= least)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of ``words`` (word, n; distinct) one edit apart."""
    spark = words.sparkSession
    bucket = F.crc32(F.substring("word", F.col("at"), F.lit(2)).cast("binary")) % BUCKETS
    places = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"))
    table = np.zeros(BUCKETS, np.int64)
    for r in places.groupBy(bucket.alias("bucket")).count().collect():  # at most BUCKETS rows
        table[r.bucket] = r["count"]
    counts = spark.sparkContext.broadcast(table)
    p, w = _signatures(words, counts, True).alias("p"), by_merge(_signatures(words, counts, False)).alias("w")
    met = p.join(w, (F.col("p.key") == F.col("w.key")) & (F.col("p.last") <= F.col("w.last")) & (F.col("p.word") != F.col("w.word"))
                 & (F.abs(F.length("p.word") - F.length("w.word")) <= 1)
                 & (F.levenshtein(F.col("p.word"), F.col("w.word"), 1) == 1))
    swap = F.col("p.word") > F.col("w.word")

    def side(name: str, first: bool):
        return F.when(swap == F.lit(first), F.col(f"w.{name}")).otherwise(F.col(f"p.{name}"))

    pairs = met.select(side("word", True).alias("a"), side("n", True).alias("a_n"),
                       side("word", False).alias("b"), side("n", False).alias("b_n")).distinct()
    return pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("pair")
    ).select("pair.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached from each word of ``forms`` (word, form).

    Pointer jumping: each round doubles the steps taken, so the rounds grow
    with the logarithm of the longest chain.
    """
    spark = forms.sparkSession
    path = shared_dir(spark, "roots")
    current = written(forms.select("word", F.col("form").alias("root")), "roots", path)
    while True:
        further = by_merge(current.select(F.col("word").alias("root"), F.col("root").alias("further")))
        if current.join(further, "root", "left_semi").isEmpty():
            return current
        done, path = path, shared_dir(spark, "roots")
        current = written(current.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots", path)
        remove_path(spark, done)  # nothing reads the round before


def variants(words: DataFrame, length: int = 5, least: int = 3, ratio: float = 2.0) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary of ``words`` (word, n).

    ``form`` is the near word of largest count, if that is at least ``ratio``
    times the word's; ``root`` the last word reached by following forms.
    """
    if ratio <= 1:
        raise ValueError("forms lead to more frequent words only with a ratio above one")
    with setting(words.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"):
        known = written(vocabulary(words, length, least), "words")
        best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form")))
        near = near_pairs(known).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
        near = written(near.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.rank")).alias("form_n")), "near-words")
    found = known.join(by_merge(near), "word", "left").withColumn("formed", F.col("form_n") >= F.col("n") * ratio)
    last = roots(found.where("formed").select("word", "form"))
    return found.join(by_merge(last), "word", "left").select(
        "word", F.when(F.col("formed"), F.col("form")).alias("form"), F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("formed"), F.col("form_n")).alias("form_n"))
