"""Removal of repeated byte strings by difference-cover blockwise suffix sorting.

Every byte covered by a ``width``-byte string that also starts in a document
with a smaller id is removed.  The suffixes (one a window of ``width`` bytes)
are sorted bucket by bucket; equal windows then lie side by side, and the
smallest id among them owns them.

1. A window's bucket is the least hash among its 16-byte strings, so equal
   windows share a bucket, and neighbouring windows mostly do too: runs of
   windows with one bucket travel as one fragment of text.  Of equal fragments
   in one piece of input only the smallest id's travels; the others are
   already known to be removed.
2. Buckets are dealt to tasks and ordered there by Spark's external sort.  Equal
   fragments meet side by side and are reduced to one before they are held.
3. A task takes whole buckets up to ``block`` bytes of different fragments and
   sorts their suffixes blockwise: ranks of the suffixes at the positions of a
   difference cover modulo 31 come first; then one range of leading bytes
   after the other is sorted by its first 32 bytes, and longer ties are
   resolved by the cover ranks: for any two positions some offset below 31
   puts both on the cover.  Sorting memory depends on the range, not on the block.
4. A bucket of more than ``block`` bytes of different fragments (a frequent line
   makes one) is held by no task: its fragments are passed on and dealt again by
   the least hash of their windows' 32-byte strings, and what is still too much
   by the windows themselves.  Equal windows share these keys too, so the split
   is exact; single windows need no sorting, the first row of equal ones has
   the owner, and nothing is held.
5. The windows owned by a smaller id become byte spans, which are gathered per
   document (at most as many as it has bytes) and cut out.

``passes`` cuts the buckets into groups that are handled one after the other,
each written before the next begins, which bounds shuffle space.

Defined results: a null text is empty; a text shorter than ``width`` keeps all
its bytes; a null id neither loses nor owns bytes; rows with equal ids never
remove each other's bytes (equal rows get equal results); repeats within a
document stay; an empty table gives an empty result; input columns named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from roadworthy.llm.arrow import joined, pieces
from roadworthy.llm.common import setting, written

WIDTH = 50
GRAM = 16
PASSES = 3
#: Bytes of text cut into fragments at a time, of different fragments sorted together, windows in a range.
PIECE, BLOCK, RANGE = 2 << 20, 1 << 20, 1 << 18
LONGEST = 256
#: Strings whose least hash deals a window: at first, and for buckets that were too large; the last is the window.
GRAMS = (GRAM, 32, WIDTH)
PERIOD = 31
#: A difference cover modulo 31: every residue is a difference of two of these.
COVER = (1, 5, 11, 24, 25, 27)
FRAGMENT = "mini long, frag binary, doc_id long, key long, pos long, end long"
SPAN = "doc_id long, key long, first long, end long"
#: Spans, and fragments that are dealt again.
PASSED = SPAN + ", frag binary"


def _offsets() -> np.ndarray:
    """For residues r, s: the least d with r + d and s + d both in the cover."""
    out = np.zeros((PERIOD, PERIOD), np.int64)
    for r in range(PERIOD):
        for s in range(PERIOD):
            out[r, s] = next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (s + d) % PERIOD in COVER)
    return out


_OFFSETS = _offsets()


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as a big-endian number (zeros beyond the end)."""
    w = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    for have in (1, 2, 4):
        w[:-have] = (w[:-have] << np.uint64(8 * have)) | w[have:]
    return w[: len(text)]


def _starts(new: np.ndarray) -> np.ndarray:
    """For each slot the slot at which its group starts; ``new`` marks the starts."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _open(group: np.ndarray) -> np.ndarray:
    """Slots in groups of more than one; a group is numbered by its first slot."""
    alone = np.concatenate((group[1:] != group[:-1], [True])) & (group == np.arange(len(group)))
    return np.flatnonzero(~alone)


def _split(order: np.ndarray, group: np.ndarray, todo: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Sort the slots ``todo`` by (group, key) in place and split their groups; returns the keys as sorted."""
    old = group[todo]
    s = np.lexsort((key, old))
    order[todo], key = order[todo][s], key[s]
    new = np.concatenate(([True], (old[1:] != old[:-1]) | (key[1:] != key[:-1])))
    group[todo] = todo[_starts(new)]
    return key


def _by_words(order: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their first 32 bytes, and their groups of equals."""
    first = words[order]
    s = np.argsort(first, kind="stable")
    order, first = order[s], first[s]
    group = _starts(np.concatenate(([True], first[1:] != first[:-1]))) if len(order) else order
    for at in (8, 16, 24):
        todo = _open(group)
        if len(todo):
            _split(order, group, todo, words[order[todo] + at])
    return order, group


class Suffixes:
    """Order of suffixes of one block of text."""

    def __init__(self, text: np.ndarray):
        self.n = len(text)
        self.words = np.concatenate((_words(text), np.zeros(2 * WIDTH, np.uint64)))
        self._rank()

    def _rank(self) -> None:
        """Ranks of the cover's suffixes by their first 62 bytes: names of 31 or more bytes, doubled once."""
        at = np.arange(self.n)
        sample = at[np.isin(at % PERIOD, COVER)]
        order, group = _by_words(sample, self.words)
        name = np.zeros(self.n + 4 * PERIOD, np.int64)
        name[order] = group + 1
        pair = name[order] * (len(sample) + 2) + name[order + PERIOD]
        s = np.argsort(pair, kind="stable")
        pair, order = pair[s], order[s]
        self.rank = np.zeros(self.n + 4 * PERIOD, np.int64)
        self.rank[order] = (_starts(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else pair) + 1

    def order(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in suffix order, and where each stretch of equal windows starts."""
        order, group = _by_words(positions, self.words)
        tied = group.copy()
        todo = _open(group)
        while len(todo):
            # Each tie is compared with the middle one of its group: below, equal or above.
            first = np.flatnonzero(np.concatenate(([True], group[todo[1:]] != group[todo[:-1]])))
            size = np.diff(np.append(first, len(todo)))
            p, q = order[todo], np.repeat(order[todo[first + size // 2]], size)
            d = _OFFSETS[p % PERIOD, q % PERIOD]
            side = _split(order, group, todo, np.sign(self.rank[p + d] - self.rank[q + d]))
            left = np.zeros(len(group), bool)
            left[_open(group)] = True
            todo = todo[(side != 0) & left[todo]]
        if not len(order):
            return order, order
        equal = tied[1:] == tied[:-1]
        pairs = np.flatnonzero(equal)
        a, b = order[pairs], order[pairs + 1]
        for at in [*range(32, WIDTH - 8, 8), WIDTH - 8]:
            equal[pairs] &= self.words[a + at] == self.words[b + at]
        return order, np.flatnonzero(np.concatenate(([True], ~equal)))


def owners(text: np.ndarray, positions: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For the window at each position: the least owner of an equal window."""
    suffixes = Suffixes(text)
    lead = suffixes.words[positions]
    ranges = -(-len(positions) // RANGE)
    some = np.sort(lead[:: max(1, len(lead) // 4096)])
    cuts = some[np.arange(1, ranges) * len(some) // ranges] if ranges > 1 else lead[:0]
    bucket = np.searchsorted(np.unique(cuts), lead, side="right")
    least = np.empty(len(positions), np.int64)
    slot_of = np.empty(len(text), np.int64)
    slot_of[positions] = np.arange(len(positions))
    for b in range(int(bucket.max(initial=-1)) + 1):  # one suffix bucket at a time
        order, starts = suffixes.order(positions[bucket == b])
        if len(order):
            slots = slot_of[order]
            found = np.minimum.reduceat(owner[slots], starts)
            least[slots] = np.repeat(found, np.diff(np.append(starts, len(order))))
    return least


def _buckets(text: np.ndarray) -> np.ndarray:
    """Each window's bucket: the least hash of its 16-byte strings."""
    w = text.astype(np.uint32)
    w = w[:-1] | (w[1:] << np.uint32(8))
    w = w[:-2] | (w[2:] << np.uint32(16))  # four bytes at each position
    h = w[:-4] * np.uint32(0x9E3779B1) + w[4:] * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(15)
    h = h[:-8] * np.uint32(0xC2B2AE3D) + h[8:] * np.uint32(0x27D4EB2F)
    h ^= h >> np.uint32(16)
    return _least(h * np.uint32(0x9E3779B1), WIDTH - GRAM + 1)


def _keys(text: np.ndarray, gram: int) -> np.ndarray:
    """Each window's least 64-bit hash of its ``gram``-byte strings."""
    words, n = _words(text), len(text) - gram + 1
    h = np.zeros(n, np.uint64)
    for at in [*range(0, gram - 8, 8), gram - 8]:
        h = (h ^ words[at:at + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return _least(h * np.uint64(0xBF58476D1CE4E5B9), WIDTH - gram + 1)


def _least(low: np.ndarray, reach: int) -> np.ndarray:
    """The least of each ``reach`` neighbours."""
    span = 1
    while 2 * span <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[: len(low) - (reach - span)], low[reach - span:])


def _runs(text: np.ndarray, ends: np.ndarray, turn: int, passes: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, bucket) of the runs of windows whose bucket has its turn.

    Every document has at least ``WIDTH`` bytes.
    """
    n = len(text) - WIDTH + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    low = _buckets(text) if gram == GRAM else _keys(text, gram)
    longest = 1 if gram == WIDTH else LONGEST
    inside = np.ones(n + 1, bool)
    inside[n] = False
    for end in ends[1:-1].tolist():  # windows across the end of a document
        inside[end - WIDTH + 1:end] = False
    other = low[1:] != low[:-1]
    first = np.flatnonzero(inside[:-1] & np.concatenate(([True], other | ~inside[:n - 1])))
    last = np.flatnonzero(inside[:-1] & np.concatenate((other | ~inside[1:n], [True])))
    bucket = low[first].astype(np.int64)
    # A hash of the bucket, not its low value, says whose turn it is.
    mine = (bucket * 0x9E3779B1 >> 16) % passes == turn
    first, last, bucket = first[mine], last[mine], bucket[mine]
    parts = -(-(last - first + 1) // longest)  # long runs travel in parts
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(first, parts) + nth * longest
    return first, np.minimum(np.repeat(last, parts), first + longest - 1), np.repeat(bucket, parts)


def _cut(turn: int, passes: int, gram: int = GRAM):
    """Texts (doc_id, key, first: where the text starts in its document) to fragments; equal ones of a larger id in a piece travel without text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            batch = batch.take(pc.sort_indices(batch.column("doc_id")))
            text, ends = joined(batch.column("text"))
            ids, keys, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "key", "first"))
            first, last, bucket = _runs(text, ends, turn, passes, gram)
            if not len(first):
                continue
            row = np.searchsorted(ends, first, side="right") - 1
            data = text.tobytes()
            seen: dict[bytes, int] = {}
            frags: list[bytes | None] = []
            for a, b, i in zip(first.tolist(), (last + WIDTH).tolist(), ids[row].tolist()):
                frag = data[a:b]
                frags.append(None if seen.setdefault(frag, i) < i else frag)
            pos, end = first - ends[row] + start[row], last + WIDTH - ends[row] + start[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.array(frags, pa.binary()), pa.array(ids[row]), pa.array(keys[row]), pa.array(pos), pa.array(end)],
                names=["mini", "frag", "doc_id", "key", "pos", "end"])

    return run


def _spans(ids: np.ndarray, keys: np.ndarray, first: np.ndarray, end: np.ndarray, frags: pa.Array | None = None) -> pa.RecordBatch:
    """Spans to remove, or, with ``frags``, fragments to be dealt again."""
    columns = [pa.array(x.astype(np.int64)) for x in (ids, keys, first, end)] + [pa.nulls(len(ids), pa.binary()) if frags is None else frags]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "first", "end", "frag"])


def _owned(frags: pa.Array, ids: np.ndarray, keys: np.ndarray, pos: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
    """Spans of the rows (code: number of the row's fragment) whose windows a smaller id owns.

    The rows of a fragment all have its least id.
    """
    text, ends = joined(frags)
    windows = np.diff(ends) - WIDTH + 1
    fragment = np.repeat(np.arange(len(windows)), windows)
    inside = np.arange(len(fragment)) - np.repeat(np.cumsum(windows) - windows, windows)
    owner = np.zeros(len(windows), np.int64)
    owner[code] = ids
    mine = owner[fragment]
    lost = np.flatnonzero(owners(text, ends[fragment] + inside, mine) < mine)
    if not len(lost):
        return _spans(*(np.zeros(0, np.int64),) * 4)
    new = np.concatenate(([True], (lost[1:] != lost[:-1] + 1) | (fragment[lost][1:] != fragment[lost][:-1])))
    of, a = fragment[lost][new], inside[lost][new]
    b = inside[lost][np.append(np.flatnonzero(new)[1:] - 1, len(lost) - 1)] + WIDTH
    count = np.bincount(of, minlength=len(windows))
    row = np.repeat(np.arange(len(code)), count[code])
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count[code]) - count[code], count[code])
    at = (np.cumsum(count) - count)[code[row]] + nth
    return _spans(ids[row], keys[row], pos[row] + a[at], pos[row] + b[at])


def _sort(block: int, windows: bool = False):
    """Fragments ordered by (mini, frag, doc_id) to spans owned by smaller ids.

    A bucket of more than ``block`` bytes of different fragments is passed on.  If the fragments are single
    ``windows``, equal ones side by side are all there is to find.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (different frags, ids, keys, pos, minis, number of the row's frag) not yet sorted
        size, count = 0, 0  # bytes and number of the different fragments held
        last, passed = None, None  # the last fragment seen and its least id; the bucket that is passed on

        def gathered() -> tuple:
            return pa.concat_arrays([h[0] for h in held]), *(np.concatenate([h[k] for h in held]) for k in range(1, 6))

        def flush(upto_last_bucket: bool) -> pa.RecordBatch | None:
            nonlocal held, size, count
            frags, ids, keys, pos, minis, number = gathered()
            cut = int(np.searchsorted(minis, minis[-1])) if upto_last_bucket else len(minis)
            if not cut:
                return None
            rest = frags[int(number[cut]):] if cut < len(minis) else frags[:0]
            held = [(pa.concat_arrays([rest]), ids[cut:], keys[cut:], pos[cut:], minis[cut:], number[cut:] - number[cut])] if cut < len(minis) else []
            size, count = pc.sum(pc.binary_length(rest)).as_py() or 0, len(rest)
            # A bucket whose fragments all have one id has nothing to remove.
            starts = np.flatnonzero(np.concatenate(([True], minis[1:cut] != minis[:cut - 1])))
            several = np.minimum.reduceat(ids[:cut], starts) < np.maximum.reduceat(ids[:cut], starts)
            some = np.repeat(several, np.diff(np.append(starts, cut)))
            if not some.any():
                return None
            used, code = np.unique(number[:cut][some], return_inverse=True)
            return _owned(frags.take(pa.array(used)), ids[:cut][some], keys[:cut][some], pos[:cut][some], code)

        for batch in batches:
            frags = batch.column("frag").cast(pa.binary())
            ids, keys, pos, end, minis = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "key", "pos", "end", "mini"))
            some = frags.is_valid().to_numpy(zero_copy_only=False)
            if not some.all():
                yield _spans(ids[~some], keys[~some], pos[~some], end[~some])
                if not some.any():
                    continue
                frags, ids, keys, pos, end, minis = frags.filter(pa.array(some)), ids[some], keys[some], pos[some], end[some], minis[some]
            coded = frags.dictionary_encode()
            code = coded.indices.to_numpy()
            new = np.concatenate(([True], code[1:] != code[:-1]))
            least = ids[_starts(new)]
            if last is not None and frags[0].as_py() == last[0]:
                least[code == code[0]] = last[1]
                new[0] = False
            last = (frags[len(frags) - 1].as_py(), int(least[-1]))
            later = ids > least
            if later.any():
                yield _spans(ids[later], keys[later], pos[later], end[later])
            if windows:
                continue
            keep = ~later
            if passed is not None:
                more = keep & (minis == passed)
                if more.any():
                    yield _spans(ids[more], keys[more], pos[more], end[more], frags.filter(pa.array(more)))
                    keep &= ~more
            if keep.any():
                kept = frags.filter(pa.array(keep & new))
                number = count - 1 + np.cumsum(new[keep])
                held.append((kept, ids[keep], keys[keep], pos[keep], minis[keep], number))
                size, count = size + (pc.sum(pc.binary_length(kept)).as_py() or 0), count + len(kept)
            if size >= block:
                out = flush(True)
                if out is not None:
                    yield out
                if size >= block:  # what is left belongs to one bucket
                    frags, ids, keys, pos, minis, number = gathered()
                    frags = frags.take(pa.array(number))
                    yield _spans(ids, keys, pos, pos + pc.binary_length(frags).to_numpy(), frags)
                    held, size, count, passed = [], 0, 0, minis[-1]
        out = flush(False) if held else None
        if out is not None:
            yield out

    return run


def repeated_spans(docs: DataFrame, passes: int = PASSES, block: int | None = None) -> DataFrame:
    """(doc_id, key, first, end): byte spans to remove, overlapping; key is xxhash64 of the text."""
    spark, block = docs.sparkSession, block or BLOCK
    rows = docs.where("doc_id is not null and octet_length(text) >= " + str(WIDTH)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.lit(0).cast("long").alias("first"), "text")
    found = []
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"):
        for turn in range(passes):
            left, of = rows, (turn, passes)
            for gram in GRAMS:
                sorted_ = left.mapInArrow(_cut(*of, gram), FRAGMENT).repartition("mini").sortWithinPartitions("mini", "frag", "doc_id")
                out = written(sorted_.mapInArrow(_sort(block, gram == WIDTH), PASSED), "spans")
                found.append(out.where("frag is null").drop("frag"))
                left, of = out.where("frag is not null").select("doc_id", "key", "first", F.col("frag").alias("text")), (0, 1)
                if gram == WIDTH or left.isEmpty():
                    break
    return reduce(DataFrame.unionByName, found)


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Disjoint spans, in order, that cover the same bytes; touching ones are one run."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["first"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def deduplicate(docs: DataFrame, passes: int = PASSES, keep_bytes: bool = True, block: int | None = None) -> DataFrame:
    """Every row without its text, with n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the ``kept`` bytes."""
    added = [StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()),
             StructField("kept_sha256", StringType())] + [StructField("kept", BinaryType())] * keep_bytes
    names = {f.name for f in added}
    fields = [f for f in docs.schema if f.name not in names | {"text"}]
    schema = StructType([*fields, *added])
    arrow_schema = to_arrow_schema(schema)
    spans = repeated_spans(docs.select("doc_id", "text"), passes, block)
    # A document's spans are no more than its bytes.
    lists = spans.groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "end")).alias("_spans")).select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "_spans")
    rows = docs.select(*[f.name for f in fields], "text").withColumn("_text_key", F.xxhash64("text"))
    rows = rows.join(lists, (F.col("doc_id").cast("long") == F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 8 << 20):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            out = []
            for text, spans in zip(texts, batch.column("_spans").to_pylist()):
                text, cut = text or b"", merged(spans or [])
                edges = [0, *(x for s in cut for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(text), len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept))
            made = [pa.array(list(c), f.type) for c, f in zip(zip(*out), list(arrow_schema)[len(fields):])]
            columns = [batch.column(f.name) for f in fields] + made
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema)

    return rows.select(*[f.name for f in fields], "text", "_spans").mapInArrow(run, schema)
