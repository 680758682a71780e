"""SimHash near-duplicates with pigeonring candidate filtering.

A text's fingerprint takes the majority of each bit over the XXH64 hashes of
its word shingles.  Texts whose fingerprints differ in at most ``distance``
bits are linked, and linked texts form components.

Pigeonring: the 64 bits lie in ``segments`` segments on a ring.  If two
fingerprints differ in at most t bits, some segment starts a chain in which,
for every length l, the first l segments together differ in at most
l * t / segments bits.  Hence:

* the chain's first segments, as far as the budget is below one bit, are
  equal: they are the join key (28 bits for t = 2 and 16 segments);
* along the chain, as far as the budget is below two bits, at most one bit
  differs: candidates are pruned by that before the full Hamming check;
* in a key shared by more than ``SMALL`` fingerprints, the same fact gives
  longer keys: one bit of the second part is blanked, for each of its bits in
  turn, so that the pair agrees on everything up to there.  For t = 2 only five
  bits of 64 stay open, so at most 32 different fingerprints share such a key.

Equal fingerprints are one node; nothing is ever paired within a group of copies.

Defined results: a text without words (null, empty, blanks) has fingerprint
zero and is linked like any other; with fewer words than a shingle the whole
sequence is one; a null id takes part but never names a component (null if
all ids of a component are null); repeated rows keep their number; an empty table
gives an empty result; input columns called fingerprint or component_id are replaced.
Of a very long text the words of about a megabyte are held at once, beside the text itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from roadworthy.llm.arrow import mapped, utf8
from roadworthy.llm.common import LOWER, UPPER, bounded_batches, written
from roadworthy.llm.components import components

SEED = 42
#: Fingerprints that may share a join key before longer keys are used.
SMALL = 64
#: Bytes of a text whose words are held at once.
_BLOCK = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of a text's UTF-8 bytes, as a signed 64-bit number."""
    ones, total = np.zeros(64, np.int64), 0
    words: list[bytes] = []
    for more in _words(text or b""):
        words += more
        if len(words) >= shingle:
            ones += _ones(words, shingle)
            total += len(words) - shingle + 1
            words = words[len(words) - shingle + 1:]  # begin the next part's shingles
    if not total and words:
        ones, total = _ones(words, len(words)), 1
    return int(np.packbits(2 * ones > total).view(">i8")[0])


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words of parts of about ``_BLOCK`` bytes that end between words."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + _BLOCK)
        end = blank.start() if blank else len(text)
        yield text[at:end].translate(_TO_LOWER).split()
        at = end


def _ones(words: list[bytes], shingle: int) -> np.ndarray:
    """How often each bit is set in the hashes of all shingles of at least ``shingle`` words."""
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(first, last)], np.uint64)
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """``docs`` with the text replaced by its fingerprint (``fp``, long)."""
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, "fp")]
    schema = StructType([*docs.select(*kept).schema, StructField("fp", LongType())])

    def columns(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        made = {c: batch.column(c) for c in kept}
        return made | {"fp": pa.array([fingerprint(t, shingle) for t in utf8(batch, text)], pa.int64())}

    return docs.select(*kept, text).mapInArrow(mapped(columns, to_arrow_schema(schema), text), schema)


class _Ring:
    """Bit masks of the chains of ``segments`` segments for a distance."""

    def __init__(self, distance: int, segments: int):
        if not 1 <= distance < segments <= 64:
            raise ValueError("1 <= distance < segments <= 64")
        edge = [64 * k // segments for k in range(segments + 1)]
        chain = lambda i, n: [b for s in range(n) for k in [(i + s) % segments] for b in range(edge[k], edge[k + 1])]
        reach = lambda errors: -(-(errors + 1) * segments // distance) - 1  # noqa: E731  segments with a budget below errors + 1
        self.keys, self.near, self.open_bits = [], [], []
        for i in range(segments):
            exact, one = chain(i, reach(0)), chain(i, min(segments, reach(1)))
            self.keys.append(self.mask(exact))
            self.near.append(self.mask(one))
            self.open_bits.append([self.mask([b]) for b in one if b not in set(exact)])

    @staticmethod
    def mask(bits: list[int]) -> int:
        value = sum(1 << b for b in bits)
        return value - (1 << 64) if value >= 1 << 63 else value


def _long_array(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _pairs(keyed: DataFrame, key: list[str], ring: _Ring, distance: int) -> DataFrame:
    """Links between the fingerprints that share a key: at most ``SMALL``, or as many as differ in the key's open bits.

    For a distance of 2 at most five bits are open in a long key.  A larger distance leaves 24 or more open, so that no useful
    bound holds there; the links are the same.
    """
    grouped = keyed.groupBy(*key).agg(F.array_sort(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    left = grouped.select("pos", "fps", F.posexplode("fps").alias("at", "u"))
    both = left.select("pos", "u", F.explode(F.slice("fps", F.lit(1), F.col("at"))).alias("v"))
    differ = F.col("u").bitwiseXOR(F.col("v"))
    near = F.element_at(_long_array(ring.near), F.col("pos") + 1)
    return both.where((F.bit_count(differ.bitwiseAND(near)) <= 1) & (F.bit_count(differ) <= distance)).select("u", "v")


def links(fps: DataFrame, distance: int = 2, segments: int = 16) -> DataFrame:
    """All pairs (u, v) of different fingerprints (column fp, distinct) at most ``distance`` bits apart."""
    if distance == 0:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where("false")
    ring = _Ring(distance, segments)
    keyed = fps.select("fp", F.posexplode(_long_array(ring.keys)).alias("pos", "mask"))
    keyed = keyed.select("fp", "pos", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = keyed.groupBy("pos", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(keyed.join(sizes, ["pos", "key"]), "simhash-keys")
    few = _pairs(shared.where(F.col("n") <= SMALL), ["pos", "key"], ring, distance)
    opened = F.array(*[_long_array(bits) for bits in ring.open_bits])
    many = shared.where(F.col("n") > SMALL).withColumn("bit", F.explode(F.element_at(opened, F.col("pos") + 1)))
    near = F.element_at(_long_array(ring.near), F.col("pos") + 1)
    many = many.withColumn("key", F.col("fp").bitwiseAND(near).bitwiseAND(F.bitwise_not(F.col("bit"))))
    return few.union(_pairs(many, ["pos", "bit", "key"], ring, distance)).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", shingle: int = 3, distance: int = 2, segments: int = 16) -> DataFrame:
    """Every row (without its text) with ``fp``, ``root`` (names the component) and ``component_id``, the least id that links reach."""
    marked = written(fingerprints(docs.drop("component_id", "root"), shingle), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min(doc_id).alias("least"))
    found = components(links(nodes.select("fp"), distance, segments))
    rooted = nodes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "simhash-roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp")


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row of ``docs`` for each component, all its columns: the one with the least id.

    Ids that are null come last; rows that share the least id are told apart by
    the hash of their text, and of rows equal in both any one stays.
    """
    key = F.xxhash64("text")
    found = near_duplicates(docs.select("doc_id", key.alias("_key"), "text"), shingle=shingle, distance=distance)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_key")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("_id"), F.col("first._key").alias("_kept"))
    rows = docs.withColumn("_key", key)
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_kept")), "left_semi")
    return rows.dropDuplicates(["doc_id", "_key"]).drop("_key")
