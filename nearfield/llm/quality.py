"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of WORDS words. A passage is encoded as the shares of its characters' classes (lower and
upper case, other letters, digits, blanks, every ASCII sign by itself), the shares of pairs of neighbouring classes,
hashed into PAIRS buckets, and some figures of its words; a learned layer makes HIDDEN numbers of it. Gated attention
gives every passage a weight, which sum to 1 over the document; the weighted sum of the passages is the document, and a
logistic layer scores it. Labels are known of documents only, so the weights are learned from these as well.

All layers are fitted together on a bounded sample of the labelled rows, at most about DOCUMENTS documents of CHARACTERS
characters in all (none longer than an eighth of that); every document is scored, whole texts block by
block with running sums, so a block's memory does not grow with a text.

Edge cases: null and empty texts, and those of blanks only, are one passage without words and get a score like all others;
a label counts for all rows with its id, several labels of an id by their mean; null ids and null labels teach nothing;
with labels of one kind only, or none, every document gets the same score, the smoothed share of label 1;
repeated rows get equal scores; an empty table gives no rows; extra columns are carried along, but for those with the
names of the new ones, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.runtime import prepare, thrifty

WORDS = 64  # of a passage
BLOCK = 1 << 19  # characters encoded together, and of one text in one piece
SIGNS = {c: 6 + i for i, c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")}
CLASSES = 6 + len(SIGNS) + 1
PAIRS = 128
FIGURES = 6
DIMS = CLASSES + PAIRS + FIGURES
HIDDEN, GATES = 32, 16
DOCUMENTS, CHARACTERS = 4096, 24 << 20
EPOCHS, BAGS, RATE = 12, 32, 0.005

_classes: np.ndarray | None = None


def class_table() -> np.ndarray:
    """Code point -> class: 0 lower case, 1 upper case, 2 other letters, 3 digits, 4 blanks, 5 line ends, signs, others."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, CLASSES - 1, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = 0 if c.islower() else 1 if c.isupper() else 2
            elif c.isdigit():
                table[i] = 3
            elif c.isspace():
                table[i] = 5 if c in "\n\r" else 4
        for c, k in SIGNS.items():
            table[ord(c)] = k
        _classes = table
    return _classes


def _shares(owner: np.ndarray, kind: np.ndarray, kinds: int, passages: int) -> np.ndarray:
    found = np.bincount(owner * kinds + kind, minlength=passages * kinds).reshape(passages, kinds)
    return np.sqrt(found / np.maximum(found.sum(1, keepdims=True), 1))


def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Passages x DIMS numbers, and the piece that each passage is of. A piece has one passage at least."""
    points = [np.frombuffer(p.encode("utf-32-le", "replace"), np.uint32) for p in pieces]
    sizes = np.array([len(p) for p in points])
    points = np.concatenate(points) if pieces else np.zeros(0, np.uint32)
    piece = np.repeat(np.arange(len(pieces)), sizes)
    kind = class_table()[points].astype(np.int64)
    inner = (kind != 4) & (kind != 5)
    first = np.concatenate(([True], piece[1:] != piece[:-1])) if len(piece) else np.zeros(0, bool)
    start = inner & (first | ~np.concatenate(([False], inner[:-1])))
    # Words are counted within their piece; blanks belong to the word before them.
    words = np.cumsum(start)
    before = np.concatenate(([0], words))[np.concatenate(([0], np.cumsum(sizes)[:-1]))] if len(pieces) else np.zeros(0, np.int64)
    per_piece = np.maximum(1, -(-np.bincount(piece[start], minlength=len(pieces)) // WORDS))
    base = np.concatenate(([0], np.cumsum(per_piece)[:-1])).astype(np.int64)
    owner = base[piece] + np.maximum(words - before[piece] - 1, 0) // WORDS
    passages = int(per_piece.sum())
    parts = [_shares(owner, kind, CLASSES, passages)]
    pair = ((kind[:-1] * CLASSES + kind[1:]) * 0x9E3779B1 >> 11) % PAIRS
    parts.append(_shares(owner[1:][~first[1:]], pair[~first[1:]], PAIRS, passages))
    # Words as sums of their characters' powers, so equal words have equal numbers.
    own = owner[start]
    at = words[inner] - 1
    n = np.bincount(own, minlength=passages)
    place = np.arange(len(points))[inner] - np.flatnonzero(start)[at] if len(own) else np.zeros(0, np.int64)
    mixed = (points[inner].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1))
    mixed ^= mixed >> np.uint64(29)
    word = np.add.reduceat(mixed, np.flatnonzero(start[inner])) if len(own) else np.zeros(0, np.uint64)
    order = np.lexsort((word, own))
    fresh = np.ones(len(word), bool)
    fresh[1:] = (word[order][1:] != word[order][:-1]) | (own[order][1:] != own[order][:-1])
    runs = np.diff(np.append(np.flatnonzero(fresh), len(word)))
    most = np.zeros(passages)
    np.maximum.at(most, own[order][fresh], runs)
    again = np.zeros(passages)
    if len(word) > 1:
        np.add.at(again, own[1:], (word[1:] == word[:-1]) & (own[1:] == own[:-1]))
    length = np.bincount(at, minlength=len(own)).astype(float)
    total, square = np.bincount(own, length, passages), np.bincount(own, length**2, passages)
    some = np.maximum(n, 1)
    mean = total / some
    spread = np.sqrt(np.maximum(square / some - mean**2, 0))
    parts.append(np.stack([np.bincount(own[order], fresh, passages) / some, most / some, again / some, np.log1p(mean), np.log1p(spread), np.log1p(n)], 1))
    return np.concatenate(parts, 1), np.repeat(np.arange(len(pieces)), per_piece)


@dataclass
class Model:
    """The layers, and the mean and spread of every number of a passage in the sample. Without layers a constant score."""

    constant: float
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    layers: dict[str, np.ndarray] | None = None

    def hidden(self, passages: np.ndarray) -> np.ndarray:
        return np.tanh((passages - self.mean) / self.spread @ self.layers["W"] + self.layers["b"])

    def weights(self, hidden: np.ndarray) -> np.ndarray:
        """The logarithm of each passage's attention, up to a document's constant."""
        return (np.tanh(hidden @ self.layers["V"]) * _sigmoid(hidden @ self.layers["U"])) @ self.layers["w"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _step(p: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss of some bags: passages x, where each bag starts, and labels between 0 and 1."""
    size = np.diff(np.append(starts, len(x)))
    bag = np.repeat(np.arange(len(starts)), size)
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * s) @ p["w"]
    a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a /= np.add.reduceat(a, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts)
    d = (_sigmoid(z @ p["c"] + p["k"][0]) - y) / len(y)
    dz = d[:, None] * p["c"]
    da = (h * dz[bag]).sum(1)
    de = a * (da - np.add.reduceat(a * da, starts)[bag])
    dg = de[:, None] * p["w"]
    dt, ds = dg * s * (1 - t**2), dg * t * s * (1 - s)
    dh = a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T
    du = dh * (1 - h**2)
    return {"W": x.T @ du, "b": du.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ d, "k": np.array([d.sum()])}


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> Model:
    """Adam over shuffled bags, with some decay of the weights; the same bags in the same order give the same model."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    if not len(labels) or labels.min() == labels.max():
        return Model(float(share))
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, spread = every.mean(0), every.std(0)
    spread = np.where(spread < 1e-6, 1.0, spread)
    scaled = [np.clip((b - mean) / spread, -8, 8) for b in bags]
    p = {"W": rng.normal(0, DIMS**-0.5, (DIMS, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), "w": rng.normal(0, GATES**-0.5, GATES), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "k": np.array([np.log(share / (1 - share))])}
    first, second = ({n: np.zeros_like(v) for n, v in p.items()} for _ in range(2))
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for i in range(0, len(order), BAGS):
            some = order[i : i + BAGS]
            sizes = [len(scaled[j]) for j in some]
            g = _step(p, np.concatenate([scaled[j] for j in some]), np.concatenate(([0], np.cumsum(sizes)[:-1])), labels[some])
            t += 1
            for n in p:
                first[n] = 0.9 * first[n] + 0.1 * g[n]
                second[n] = 0.999 * second[n] + 0.001 * g[n] ** 2
                p[n] = p[n] - rate * (first[n] / (1 - 0.9**t) / (np.sqrt(second[n] / (1 - 0.999**t)) + 1e-8) + (1e-3 * p[n] if n not in "bk" else 0))
    return Model(float(share), mean, spread, p)


def pieces(text: str | None) -> list[str]:
    """The text in pieces of bounded length. A seam ends a word and a passage."""
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] if text else [""]


def blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(passages, the text that each is of) of all texts, in blocks of bounded size."""
    held: list[str] = []
    owner: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        for piece in pieces(text):
            held.append(piece)
            owner.append(i)
            size += len(piece) + 64
            if size >= BLOCK:
                found, which = encode(held)
                yield found, np.array(owner)[which]
                held, owner, size = [], [], 0
    if held:
        found, which = encode(held)
        yield found, np.array(owner)[which]


def score(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, numbers of passages, and the passage with the largest weight of each text (the first of equal ones)."""
    n = np.zeros(len(texts), np.int64)
    focus = np.zeros(len(texts), np.int64)
    if model.layers is None:
        for _, owner in blocks(texts):
            n += np.bincount(owner, minlength=len(texts))
        return np.full(len(texts), model.constant), n, focus
    top, total, z = np.full(len(texts), -np.inf), np.zeros(len(texts)), np.zeros((len(texts), HIDDEN))
    for passages, owner in blocks(texts):
        passages = model.mean + np.clip((passages - model.mean) / model.spread, -8, 8) * model.spread
        h = model.hidden(passages)
        e = model.weights(h)
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        who, ends = owner[starts], np.append(starts[1:], len(owner))
        for a, b, i in zip(starts, ends, who):
            best = a + int(e[a:b].argmax())
            if e[best] > top[i]:
                focus[i] = n[i] + best - a
        new = np.maximum(top[who], np.maximum.reduceat(e, starts))
        shrink = np.exp(top[who] - new)
        a = np.exp(e - np.repeat(new, ends - starts))
        total[who] = total[who] * shrink + np.add.reduceat(a, starts)
        z[who] = z[who] * shrink[:, None] + np.add.reduceat(a[:, None] * h, starts)
        top[who] = new
        n[who] += ends - starts
    return _sigmoid(z / total[:, None] @ model.layers["c"] + model.layers["k"][0]), n, focus


def train(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", documents: int = DOCUMENTS, characters: int = CHARACTERS) -> Model:
    """Learns from the rows of df whose id has a label (0 or 1, or a share). At most about `documents` ids are taken, by a
    hash of the id, and their distinct texts are thinned by a hash to about as many documents and so many characters."""
    prepare(df.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    share = min(1.0, documents / max(known.count(), 1))
    low = lambda *c: F.pmod(F.xxhash64(*c, F.lit(3)), F.lit(1 << 30))
    picked = known.where(low("id") < share * (1 << 30)).limit(2 * documents)
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id").where(F.coalesce(F.char_length("text"), F.lit(0)) <= characters // 8).distinct()
    n, size = rows.agg(F.count("*"), F.sum(F.char_length("text"))).first()
    share = min(1.0, 2 * documents / max(n, 1), characters / max(size or 0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value, y in zip(*(batch.column(batch.schema.names.index(c)) for c in ("id", "text", "y"))):
                bag = np.concatenate([f for f, _ in blocks([value.as_py()])]).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([str(key.as_py())]), pa.array([y.as_py()]), pa.array([bag.tobytes()], pa.binary())], ["id", "y", "bag"])

    found = rows.where(low("id", "text") < share * (1 << 30)).mapInArrow(thrifty(run), "id string, y double, bag binary").toArrow()
    held = sorted(zip(found["id"].to_pylist(), found["y"].to_pylist(), found["bag"].to_pylist()))
    return fit([np.frombuffer(b, "<f4").reshape(-1, DIMS).astype(float) for _, _, b in held], np.array([y for _, y, _ in held]))


NAMES = ("score", "n_passages", "focus")


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score (between 0 and 1, higher where label 1 is likelier), n_passages, and focus, the number of the passage with the
    largest weight."""
    spark = prepare(df.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index(text))
            for i in range(0, max(batch.num_rows, 1), 256):
                part = batch.slice(i, 256)
                new = [pa.array(x) for x in score(column.slice(i, 256).to_pylist(), shared.value)]
                keep = [(n, c) for n, c in zip(part.schema.names, part.columns) if n not in NAMES]
                yield pa.RecordBatch.from_arrays([c for _, c in keep] + new, [n for n, _ in keep] + list(NAMES))

    kinds = (T.DoubleType(), T.LongType(), T.LongType())
    fields = [f for f in df.schema.fields if f.name not in NAMES]
    return df.mapInArrow(thrifty(run), T.StructType(fields + [T.StructField(n, k) for n, k in zip(NAMES, kinds)]))
