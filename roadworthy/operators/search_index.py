"""Substring search by an index of three-character pieces.

Every position of a lower-cased text starts a piece (short at the end, so a
term of one or two characters is found too).  The index holds the rows (piece,
key), each once, sorted by piece and spread by piece and key, so that a frequent piece
is many files and a term opens only the files of its own pieces.  A search
takes the keys that have all pieces of all terms and then verifies them
with the plain predicate, so its result is the scan's.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadworthy.operators.explore import multi_term_search

PIECE = 3


def search_terms(text: str) -> list[str]:
    """The lower-cased, space-separated terms of a search."""
    return [t for t in text.lower().split(" ") if t]


def build(view: DataFrame, keys: Sequence[str], columns: Sequence[str], path: str, files: int | None = None) -> DataFrame:
    """Write the index of ``columns`` and return it: (piece, keys...)."""
    def pieces(c: str) -> Column:
        text = F.lower(F.col(c).cast("string"))
        starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
        return F.coalesce(F.transform(starts, lambda i: F.substring(text, i, F.lit(PIECE))), F.array().cast("array<string>"))

    spark = view.sparkSession
    rows = view.select(F.explode(F.array_distinct(F.flatten(F.array(*[pieces(c) for c in columns])))).alias("piece"), *keys).distinct()
    order = ["piece", *keys]
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _wanted(term: str) -> tuple[Column, Column]:
    """(pieces the term can be found by, that a key has all it must)."""
    piece = F.col("piece")
    if len(term) < PIECE:
        return piece.startswith(term), F.max(piece.startswith(term))
    found = sorted({term[i:i + PIECE] for i in range(len(term) - PIECE + 1)})
    return piece.isin(*found), F.count_if(piece.isin(*found)) == len(found)


def candidates(index: DataFrame, text: str) -> DataFrame:
    """Keys with every piece of every term; the filter on pieces reaches the files."""
    keys = [c for c in index.columns if c != "piece"]
    wanted = [_wanted(t) for t in search_terms(text)]
    hit = index.where(reduce(lambda a, b: a | b, [w for w, _ in wanted]))
    all_of = reduce(lambda a, b: a & b, [F.coalesce(a, F.lit(False)) for _, a in wanted])
    return hit.groupBy(*keys).agg(all_of.alias("_all")).where("_all").select(*keys)


def search(index: DataFrame, view: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """The rows of ``view`` in which every term occurs in one of ``columns``."""
    if not search_terms(text):
        return view
    keys = [c for c in index.columns if c != "piece"]
    found = candidates(index, text).select(*[F.col(c).alias("_" + c) for c in keys])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col("_" + c)) for c in keys])
    return view.join(found, same, "left_semi").where(multi_term_search(columns, text))


def contains_ignoring_case(c: Column, term: str) -> Column:
    """Case-insensitive substring by collation, for text of any script."""
    return F.contains(F.collate(c, "UNICODE_CI"), F.collate(F.lit(term), "UNICODE_CI"))


def locale_order(c: Column, locale: str = "UNICODE") -> Column:
    """A text column that sorts as a reader expects (accents beside their letter, lower before upper case)."""
    return F.collate(c, locale)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """An index written earlier."""
    return spark.read.parquet(path)
