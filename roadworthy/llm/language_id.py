"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are TF-IDF weights of hashed character n-grams (orders ``ORDERS`` of
the lower-cased text, ``BUCKETS`` hash buckets), scaled to length one.  Document
frequencies are counted over all learning texts.  The model is trained with
follow-the-regularised-leader (per-coordinate rates, elastic-net penalty, so
most weights are exactly zero) on at most ``FIT_ROWS`` learning texts, chosen
by the hash of the text; one in five of them is kept back to find the
temperature that calibrates the probabilities.  Every whole text is predicted.

Only text and label are ever used.  Defined results: a text that is null or
has no letter is ``und`` with score 0; so is every text if there is nothing to
learn from; rows with a null label teach nothing; a single label in the
learning rows is predicted everywhere; equal texts get equal predictions;
input columns called lang_pred or score are replaced; of equal probabilities the
label first in code-point order is predicted.  Of a very long text the n-grams
of about a million characters are held at once, beside the text itself.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from roadworthy.llm.arrow import pieces
from roadworthy.llm.common import bounded_batches

ORDERS = (2, 3)
BITS = 16
BUCKETS = 1 << BITS
#: Most texts that the model is fitted on; counts are over all texts.
FIT_ROWS = 3000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.001
UNKNOWN = "und"
_PIECE = 1 << 20
#: Characters of a text whose n-grams are held at once.
_PART = 1 << 20
_ODD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the n-grams of each text, by row and bucket; long texts part by part."""
    found, short = [], 0
    for i, text in enumerate(texts):
        if len(text) > _PART:
            found += [_counted(texts[short:i], short), _of_long(text, i)]
            short = i + 1
    found.append(_counted(texts[short:], short))
    return tuple(np.concatenate(c) for c in zip(*found))


def _of_long(text: str, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_grams``, of one text: parts of ``_PART`` characters, counted into one number a bucket."""
    lower, total = text.lower(), np.zeros(BUCKETS, np.int64)
    for at in range(0, len(lower), _PART):
        _, bucket, count = _counted([lower[at:at + _PART]], 0, str)
        total += np.bincount(bucket, count, minlength=BUCKETS).astype(np.int64)
        seam = at + _PART
        if seam < len(lower):  # grams that begin in this part and end in the next
            for n in ORDERS:
                for start in range(max(at, seam - n + 1), min(seam, len(lower) - n + 1)):
                    _, bucket, _ = _counted([lower[start:start + n]], 0, str, (n,))
                    total[bucket] += 1
    at = np.flatnonzero(total)
    return np.full(len(at), row), at, total[at]


def _counted(texts: list[str], start: int, lower=str.lower, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the n-grams of each text, by row and bucket; rows count from ``start``."""
    codes = [np.frombuffer(lower(t).encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(len(codes), dtype=np.uint64), sizes)
    keys = []
    for n in orders:
        if len(flat) < n:
            continue
        m = len(flat) - n + 1
        h = np.full(m, n, np.uint32)
        for j in range(n):
            h = (h ^ flat[j:j + m]) * _ODD[j]
            h ^= h >> np.uint32(15)
        inside = row[:m] == row[n - 1:]
        keys.append((row[:m][inside] << np.uint64(BITS)) | (h[inside] & np.uint32(BUCKETS - 1)))
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    both = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(both)))
    key = both[first]
    return (key >> np.uint64(BITS)).astype(np.int64) + start, (key & np.uint64(BUCKETS - 1)).astype(np.int64), count


def _features(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight): TF-IDF scaled to length one for each text."""
    row, bucket, count = _grams(texts)
    weight = (1 + np.log(count)) * idf[bucket] if len(row) else np.zeros(0)
    length = np.sqrt(np.bincount(row, weight * weight, minlength=len(texts)))
    return row, bucket, weight / np.where(length > 0, length, 1)[row] if len(row) else weight


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(texts that hold each bucket, number of texts), over all rows of ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in pieces(batches, "text", _PIECE):
            values = [t or "" for t in batch.column("text").to_pylist()]
            seen[:BUCKETS] += np.bincount(_grams(values)[1], minlength=BUCKETS)
            rows += len(values)
        seen[BUCKETS] = rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], names=["bucket", "n"])

    total = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in total.collect():  # at most one row a bucket
        out[r.bucket] = r.n
    return out[:BUCKETS], int(out[BUCKETS])


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # bucket x label
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        row, bucket, weight = _features(texts, self.idf)
        out = np.tile(self.bias, (len(texts), 1))
        for c in range(len(self.labels)):
            out[:, c] += np.bincount(row, weight * self.weights[bucket, c], minlength=len(texts))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [t if t is not None and any(map(str.isalpha, t)) else "" for t in texts]
        p = softmax(self.logits(known) / self.temperature) if self.labels else np.zeros((len(texts), 1))
        best, top = p.argmax(axis=1), p.max(axis=1)
        some = np.array([bool(t) for t in known], bool) & bool(self.labels)
        return [self.labels[b] if s else UNKNOWN for b, s in zip(best, some)], np.where(some, top, 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The regularised leader's weights for gradient sums z and squared sums n."""
    shrunk = np.sign(z) * L1 - z
    return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fit(texts: list[str], targets: list[str], idf: np.ndarray) -> Model:
    """Train on texts in the given order; every fifth calibrates the temperature."""
    labels = sorted(set(targets))
    y = np.array([labels.index(t) for t in targets], np.int64)
    held = np.arange(len(texts)) % 5 == 4
    k = len(labels)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    bags = []
    for text in texts:
        _, bucket, weight = _features([text], idf)
        bags.append((bucket.astype(np.int32), weight.astype(np.float32)))
    for _ in range(EPOCHS):
        for i in np.flatnonzero(~held):
            at = np.append(bags[i][0], BUCKETS)  # the last coordinate is the bias
            x = np.append(bags[i][1], 1.0)
            w = _leader(z[at], n[at])
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
            n[at] = new
    w = _leader(z, n)
    model = Model(labels, idf, w[:BUCKETS].astype(np.float32), w[BUCKETS], 1.0)
    if held.any():
        kept_back = np.concatenate([model.logits([texts[i]]) for i in np.flatnonzero(held)])
        model.temperature = temperature(kept_back, y[held])
    return model


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature in [1/20, 20] of least log-loss, by golden section on its logarithm."""
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    a, b = -np.log(20), np.log(20)
    ratio = (np.sqrt(5) - 1) / 2
    while b - a > 1e-3:
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def learn(rows: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from (text, label); rows without text or label teach nothing."""
    spark = rows.sparkSession
    bounded_batches(spark)
    rows = rows.where("text is not null and label is not null").select("text", F.col("label").cast("string").alias("label"))
    df, n = document_frequencies(rows.select("text"))
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0.0)
    # Half as many again as needed pass the hash test; copies of a text count once.
    share = min(1.0, 1.5 * fit_rows / max(n, 1))
    drawn = F.shiftrightunsigned("h", 11) < F.lit(int(share * 2**53))
    sample = rows.withColumn("h", F.xxhash64("text")).where(drawn).distinct().orderBy("h", "text", "label").limit(fit_rows)

    def train(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        targets: list[str] = []
        for batch in tables:
            texts += batch.column("text").to_pylist()
            targets += batch.column("label").to_pylist()
        model = fit(texts, targets, idf) if texts else Model([], idf, np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(
            (model.labels, model.weights, model.bias, model.temperature))], pa.binary())], names=["model"])

    # One task trains on the bounded sample; its order by hash is the order of training.
    found = sample.coalesce(1).sortWithinPartitions("h", "text", "label").select("text", "label").mapInArrow(train, "model binary").collect()
    labels, weights, bias, warmth = pickle.loads(found[0].model) if found else ([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    return Model(labels, idf, weights, bias, warmth)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without its text, with lang_pred and score."""
    bounded_batches(docs.sparkSession)
    # BUCKETS numbers and as many a label, whatever the input.
    sent = docs.sparkSession.sparkContext.broadcast((model.labels, model.idf, model.weights, model.bias, model.temperature))
    kept = [f for f in docs.schema if f.name not in (text, "lang_pred", "score")]
    schema = StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in pieces(batches, text, _PIECE):
            names, scores = own.predict(batch.column(text).to_pylist())
            columns = [batch.column(f.name) for f in kept] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema)

    return docs.select(*[f.name for f in kept], text).mapInArrow(run, schema)
