"""Benchmark decontamination with an Aho-Corasick automaton over words.

Items and documents are normalised to words.  The automaton holds every window
of ``WINDOW`` consecutive item words (an item with fewer words is one window)
as a sequence of word numbers; one pass over a document's words finds all
occurrences of all windows, overlapping ones included.  Words found are mapped
back to character offsets of the original text.

Texts are cut into words as UTF-8 bytes, and the pass is left out for a text
that cannot hold a window: see ``Sieve``.

The automaton is built once per Python worker from the items broadcast to it.
Equal items are reduced to one, measured, and sent in blocks of about
``block_bytes`` of text (dealt by hash; an item is never cut), one pass over the
documents a block, so neither the driver nor a worker holds much more; an
ordinary benchmark is one block.

Defined results: a null or empty text has no words; an item without words
matches nothing; items with equal ids count as one; a null item id counts as
the empty string; a document without words is clean; columns of the input that
are called like an output column are replaced; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from roadworthy.llm.arrow import pieces, utf8
from roadworthy.llm.common import LOWER, UPPER, bounded_batches, written

WINDOW = 13
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 6
BLOCK_BYTES = 2 << 20
_LOWER = str.maketrans(UPPER, LOWER)
#: For each byte itself, lower-cased, or a space if it is in no word; all bytes of a character above U+007F are in words.
_SPACED = bytes(ord(c) if b > 127 or re.fullmatch(WORD, c) else 32 for b, c in ((b, chr(b).translate(_LOWER)) for b in range(256)))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8, as ``WORD`` finds them in the lower-cased text."""
    return (text or b"").translate(_SPACED).split()


class Sieve:
    """Tells texts that hold none of the given word sequences, from a few of their words.

    Of the first n words of a sequence, n the length of the shortest one, any
    ``step`` neighbouring starts of ``size`` words include a multiple of
    ``step`` wherever the sequence lies in a text.  So a text that has none of
    these pieces at the multiples of ``step`` holds no sequence.
    """

    def __init__(self, sequences: Iterable[list[bytes]]):
        given = list(sequences)
        least = min(map(len, given), default=0)
        self.size = min(GRAM, least)
        self.step = least - self.size + 1
        self.pieces = {tuple(s[at:at + self.size]) for s in given for at in range(self.step)} if least else set()

    def may_hold(self, words: list[bytes]) -> bool:
        return bool(self.pieces) and not self.pieces.isdisjoint(zip(*(words[at::self.step] for at in range(self.size))))


class Windows:
    """Automaton of the items' word windows."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text.encode())]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[at:at + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, found in owners.items():
            self.automaton.add_word(key, (len(key), frozenset(found)))
        if owners:
            self.automaton.make_automaton()
        word = [b"", *self.number]
        keys = [[word[i] for i in key] for key in owners]
        # Short items have a sieve of their own, so that they do not widen that of the whole windows.
        self.sieves = [Sieve(k for k in keys if len(k) == window), Sieve(k for k in keys if len(k) < window)]

    def find(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """(word ranges [from, to) covered by windows, disjoint and in order; items found)."""
        ranges: list[list[int]] = []
        items: set[str] = set()
        if not any(s.may_hold(words) for s in self.sieves):
            return ranges, items
        ids = tuple([self.number.get(w, 0) for w in words])
        for last, (length, owners) in self.automaton.iter(ids):
            items |= owners
            first, end = last + 1 - length, last + 1
            while ranges and ranges[-1][1] >= first:
                first = min(first, ranges.pop()[0])
            ranges.append([first, end])
        return ranges, items


def offsets(text: str, ranges: list[list[int]]) -> list[tuple[int, int]]:
    """Character ranges [from, to) of the original text for ranges of words."""
    at = [m.span() for m in re.finditer(WORD, text.translate(_LOWER))]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def _windows(shared: dict, window: int) -> Windows:
    """The automaton of a broadcast value's items, kept with it for the worker's next tasks."""
    if window not in shared:
        shared[window] = Windows(shared["items"], window)
    return shared[window]


def _scan(docs: DataFrame, items: list[tuple[str, str]], window: int, text: str, first: bool) -> DataFrame:
    """``docs`` with n_words, words (ranges), spans and items found, added to what earlier blocks found."""
    found = "n_words long, words array<struct<first:int,end:int>>, spans array<struct<first:int,end:int>>, items array<string>"
    added = StructType.fromDDL(found)
    kept = [f for f in docs.schema if f.name not in added.names]
    plain = [f.name for f in kept]
    schema = StructType(kept + added.fields)
    arrow_schema = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast({"items": items})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(shared.value, window)
        for batch in pieces(batches, text, 8 << 20):
            out: dict[str, list] = {"n_words": [], "words": [], "spans": [], "items": []}
            before = [None] * batch.num_rows if first else list(zip(
                batch.column("words").to_pylist(), batch.column("items").to_pylist()))
            for value, old in zip(utf8(batch, text), before):
                words = words_of(value)
                ranges, got = windows.find(words)
                if old is not None:
                    ranges = merged(ranges + [[r["first"], r["end"]] for r in old[0]])
                    got = got | set(old[1])
                pair = lambda rs: [{"first": a, "end": b} for a, b in rs]
                out["n_words"].append(len(words))
                out["words"].append(pair(ranges))
                out["spans"].append(pair(offsets(value.decode(errors="replace"), ranges)) if ranges else [])
                out["items"].append(sorted(got))
            columns = [batch.column(c) for c in plain] + [pa.array(out[f.name], f.type) for f in list(arrow_schema)[len(plain):]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema)

    return docs.mapInArrow(run, schema)


def merged(ranges: list[list[int]]) -> list[list[int]]:
    """Disjoint ranges in order that cover the same words (touching ones joined)."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[int]:
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 64), F.lit(0))).first()[0]
    return list(range(max(1, -(-size // block_bytes))))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row of ``docs`` with n_words, the word ranges hit, their character spans and the items found.

    ``benchmark`` has item_id and text.
    """
    bounded_batches(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null")
    items = written(items.distinct(), "benchmark-items")
    blocks = _blocks(items, block_bytes)
    for b in blocks:
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(len(blocks))) == b)
        rows = [(r.item, r.text) for r in own.collect()]  # at most about block_bytes
        docs = _scan(docs, rows, window, text, first=b == 0)
        if len(blocks) > 1:
            docs = written(docs, "decontamination")
    return docs


def hit_words(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["first"]).cast("long"))


def contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """Hit words make up at least one word in ``share``."""
    return (n_hit > 0) & (share * n_hit >= n_words)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all their columns."""
    keys = [F.col(c).alias(f"in_{c}") for c in docs.columns]
    marked = scan(docs.select(*keys), benchmark, window, "in_text")
    kept = marked.where(~contaminated(hit_words(F.col("words")), F.col("n_words")))
    return kept.select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])


def sha256_of(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)

