"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` characters.  Each passage is
encoded from character statistics (how often one class of character follows
another, the share of different 4-grams, word length, length) by one hidden
layer; gated attention weighs the passages, and a logistic unit scores the
weighted mean.  Only documents are labelled; the attention weights are learnt
from those labels together with the encoder.

The model is fitted on at most ``FIT_ROWS`` labelled documents, those with the
smallest hash of their id; every whole text is scored.

Defined results: a null or empty text is one empty passage and has a score;
equal texts have equal scores; a document labelled twice teaches twice, one
with a null label not at all; without labelled documents every score is
one half; input columns called score or passages are replaced.  A very long
text is encoded about 800,000 characters at a time; what is held of it beside the text are
about 150 numbers a passage.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from roadworthy.llm.arrow import pieces
from roadworthy.llm.common import bounded_batches

PASSAGE = 400
FIT_ROWS = 6000
STEPS, RATE, DECAY, SEED = 300, 0.01, 1e-4, 7
HIDDEN, GATE = 24, 12
_PIECE = 1 << 20
#: Passages of one text that are encoded at once.
_PART = 2048
_CLASSES = 8
_FEATURES = _CLASSES * _CLASSES + 4


def _character_classes() -> np.ndarray:
    """Class of each code below 129; 128 stands for all others."""
    table = np.full(129, 6, np.uint8)  # other symbols
    table[:32], table[127], table[128] = 4, 4, 7
    table[ord(" ")] = 3
    for c in ".,;:'\"()-?":
        table[ord(c)] = 5
    table[ord("0"):ord("9") + 1] = 2
    table[ord("A"):ord("Z") + 1] = 1
    table[ord("a"):ord("z") + 1] = 0
    return table


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, the passage's text number), in order; long texts are encoded part by part."""
    parts = np.array([max(1, -(-len(t or "") // PASSAGE)) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), parts)
    out, short = [], 0
    for i, text in enumerate(texts):
        if parts[i] > _PART:
            step = _PART * PASSAGE
            out += [_encoded(texts[short:i]), *(_encoded([text[at:at + step]]) for at in range(0, len(text), step))]
            short = i + 1
    out = np.concatenate([*out, _encoded(texts[short:])])
    out[:, -1] = np.log1p(parts)[owner]
    return out, owner


def _encoded(texts: list[str | None]) -> np.ndarray:
    """Features of every passage but the last, which is about the whole text."""
    codes = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    parts = np.maximum(1, -(-sizes // PASSAGE))
    total, first = int(parts.sum()), np.cumsum(parts) - parts
    flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    part = np.repeat(first, sizes) + inside // PASSAGE
    kind = _character_classes()[np.minimum(flat, 128)].astype(np.int64)
    out = np.zeros((total, _FEATURES))
    length = np.bincount(part, minlength=total)
    if len(flat) > 1:
        same = part[1:] == part[:-1]
        cell = part[1:] * _CLASSES**2 + kind[:-1] * _CLASSES + kind[1:]
        pairs = np.bincount(cell[same], minlength=total * _CLASSES**2).reshape(total, -1)
        out[:, :_CLASSES**2] = np.sqrt(pairs / np.maximum(1, length - 1)[:, None])
    if len(flat) > 3:
        h = (flat[:-3] * np.uint32(0x9E3779B1) ^ flat[1:-2]) * np.uint32(0x85EBCA77)
        h = (h ^ flat[2:-1]) * np.uint32(0xC2B2AE3D)
        h = (h ^ flat[3:]) * np.uint32(0x27D4EB2F)
        same = part[3:] == part[:-3]
        key = np.sort((part[3:][same].astype(np.uint64) << np.uint64(20)) | (h[same] >> np.uint32(12)))
        different = np.concatenate((key[:1] == key[:1], key[1:] != key[:-1]))
        out[:, -4] = np.bincount((key[different] >> np.uint64(20)).astype(np.int64), minlength=total) / np.maximum(1, length - 3)
    words = np.bincount(part[kind == 3], minlength=total) + 1
    out[:, -3] = np.log1p(length / words)
    out[:, -2] = np.log1p(length)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Encoder, gated attention and logistic unit; ``p`` holds the parameters."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def start(cls, x: np.ndarray, base: float) -> Network:
        rng = np.random.default_rng(SEED)
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        spread = x.std(axis=0)
        return cls({
            "mean": x.mean(axis=0), "scale": 1 / np.where(spread > 1e-6, spread, 1),
            "encode": draw(_FEATURES, HIDDEN), "shift": np.zeros(HIDDEN), "tanh": draw(HIDDEN, GATE), "gate": draw(HIDDEN, GATE),
            "attend": draw(GATE, 1)[:, 0], "score": draw(HIDDEN, 1)[:, 0], "base": np.array(np.log(base / (1 - base))),
        })

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> dict[str, np.ndarray]:
        p, v = self.p, {}
        v["x"] = np.clip((x - p["mean"]) * p["scale"], -8, 8)
        v["h"] = np.tanh(v["x"] @ p["encode"] + p["shift"])
        v["t"], v["s"] = np.tanh(v["h"] @ p["tanh"]), _sigmoid(v["h"] @ p["gate"])
        weight = np.exp((v["t"] * v["s"]) @ p["attend"])  # |t s| < 1, so the exponent is bounded by the weights
        v["a"] = weight / np.bincount(owner, weight, minlength=n)[owner]
        v["z"] = _by_owner(v["a"][:, None] * v["h"], owner, n)
        v["y"] = _sigmoid(v["z"] @ p["score"] + p["base"])
        return v

    def gradient(self, v: dict[str, np.ndarray], owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        d = (v["y"] - y) / n
        dz = d[:, None] * p["score"]
        da = (dz[owner] * v["h"]).sum(axis=1)
        de = v["a"] * (da - np.bincount(owner, v["a"] * da, minlength=n)[owner])
        dts = de[:, None] * p["attend"]
        dt, ds = dts * v["s"] * (1 - v["t"] ** 2), dts * v["t"] * v["s"] * (1 - v["s"])
        dh = v["a"][:, None] * dz[owner] + dt @ p["tanh"].T + ds @ p["gate"].T
        dx = dh * (1 - v["h"] ** 2)
        return {"encode": v["x"].T @ dx, "shift": dx.sum(axis=0), "tanh": v["h"].T @ dt, "gate": v["h"].T @ ds,
                "attend": (v["t"] * v["s"]).T @ de, "score": v["z"].T @ d, "base": d.sum()}

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[float]]]:
        """(score of each text, attention weight of each of its passages)."""
        x, owner = passages(texts)
        v = self.forward(x, owner, len(texts))
        return v["y"], [a.tolist() for a in np.split(v["a"], np.flatnonzero(np.diff(owner)) + 1)]


def _by_owner(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Column sums for each owner; owners are in order and each has a row."""
    return np.add.reduceat(values, np.searchsorted(owner, np.arange(n)), axis=0)


def fit(texts: list[str | None], labels: list[int], steps: int = STEPS) -> Network:
    """Train by Adam on the whole sample at each step."""
    encoded, owners, at = [], [], 0
    for i in range(0, len(texts), 256):
        x, o = passages(texts[i:i + 256])
        encoded.append(x)
        owners.append(o + at)
        at += len(texts[i:i + 256])
    x, owner, y = np.concatenate(encoded), np.concatenate(owners), np.array(labels, np.float64)
    net = Network.start(x, (y.sum() + 1) / (len(y) + 2))
    moved = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in net.p.items() if k not in ("mean", "scale")}
    for step in range(1, steps + 1):
        grad = net.gradient(net.forward(x, owner, len(y)), owner, y)
        for k, (m, v) in moved.items():
            g = grad[k] + DECAY * net.p[k] * (k != "base")
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            moved[k] = (m, v)
            net.p[k] = net.p[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Network | None:
    """A network from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1); None without labelled documents."""
    bounded_batches(docs.sparkSession)
    chosen = (
        labels.where("label is not null and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label"))
        .withColumn("h", F.xxhash64(F.col("doc_id").cast("string"))).orderBy("h", "doc_id", "label").limit(fit_rows)
    )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str | None] = []
        targets: list[int] = []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            targets += batch.column("label").to_pylist()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, targets).p)], pa.binary())], names=["model"])

    # At most fit_rows narrow rows go to every task; one task trains on their texts.
    bags = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    bags = bags.orderBy("h", "doc_id", "label", "text").limit(fit_rows).select("text", "label")
    found = bags.mapInArrow(train, "model binary").collect()
    return Network(pickle.loads(found[0].model)) if found else None


def score(docs: DataFrame, net: Network | None, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with score and the attention weight of each passage; without its text unless kept."""
    bounded_batches(docs.sparkSession)
    kept = [f for f in docs.schema if f.name not in ("score", "passages") and (keep_text or f.name != text)]
    schema = StructType([*kept, StructField("score", DoubleType()), StructField("passages", ArrayType(FloatType()))])
    arrow_schema = to_arrow_schema(schema)
    sent = docs.sparkSession.sparkContext.broadcast(net.p if net else None)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(sent.value) if sent.value else None
        for batch in pieces(batches, text, _PIECE):
            values = batch.column(text).to_pylist()
            scores, weights = own.score(values) if own else (np.full(len(values), 0.5), [[]] * len(values))
            columns = [batch.column(f.name) for f in kept] + [pa.array(scores, pa.float64()), pa.array(weights, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema)

    return docs.select(*[f.name for f in kept], *([] if keep_text else [text])).mapInArrow(run, schema)


def keep(docs: DataFrame, net: Network | None, least: float) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``least``, all their columns."""
    names = docs.columns
    scored = score(docs.select(*[F.col(c).alias(f"in_{c}") for c in names]), net, "in_text", keep_text=True)
    return scored.where(F.col("score") >= least).select(*[F.col(f"in_{c}").alias(c) for c in names])
