"""Language ID: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, every run of other characters becomes one space, and
n-grams of 1 to 3 characters are hashed into 2**16 buckets. The model is the
matrix of log-probabilities, buckets x languages, and the log of each language's share of the texts; it takes
256 KB a language, whatever the size of the corpus, and is broadcast. Texts are
scored in batches: the n-grams of many texts become one sparse matrix (text, bucket, count), whose product
with the model gives all their scores, some languages at a time.

Edge cases: a null text or one without a letter is `und` with score 0; texts of
any length are scored whole, in blocks; without training rows every text is
`und`; equal scores go to the language that sorts first; a null language is
never learned; all other rows are, repeated ones each time; an empty table gives no rows; extra columns are
carried along, but for those with the names of the two new ones, which are replaced.
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

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
BLOCK = 1 << 19  # characters scored at once, and of one text in one piece
LANGUAGES = 32  # scored at once
UNKNOWN = "und"

_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for what is no letter."""
    global _fold
    if _fold is None:
        table = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = ord(c.lower()[0])
        _fold = table
    return _fold


def folded(text: str) -> np.ndarray:
    points = fold_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    points = np.concatenate(([32], points, [32])).astype(np.uint64)
    space = points == 32
    return points[~(space & np.concatenate(([False], space[:-1])))]


def grams(points: np.ndarray) -> Iterator[np.ndarray]:
    """The buckets of the n-grams of one folded text, order by order."""
    hashed = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        hashed = hashed[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            mixed = hashed ^ (hashed >> np.uint64(29))
            yield ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)  # one of BUCKETS


def blocks(text: str) -> Iterator[np.ndarray]:
    """The text in folded pieces of bounded length. A seam counts like a blank."""
    for i in range(0, len(text), BLOCK):
        yield folded(text[i : i + BLOCK])


@dataclass
class Model:
    """Languages in order, the log of each one's share of the texts, and log-probabilities, buckets x languages."""

    names: list[str]
    prior: np.ndarray
    matrix: np.ndarray


def count(df: DataFrame, text: str, lang: str) -> DataFrame:
    """Rows (lang, bucket, n): n-gram counts of the given texts by language; bucket -1 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}  # the last place counts texts

        def out() -> Iterator[pa.RecordBatch]:
            for name, total in held.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(np.where(at == BUCKETS, -1, at), pa.int32()), pa.array(total[at], pa.int64())], ["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name not in held and len(held) >= 64:
                    yield from out()
                total = held.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                total[BUCKETS] += 1
                for piece in blocks(value):
                    for bucket in grams(piece):
                        np.add.at(total, bucket, 1)
        yield from out()

    found = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).mapInArrow(thrifty(run), "lang string, bucket int, n long")
    return found.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _column(group: pa.Table) -> pa.Table:
    """One language's counts as log-probabilities."""
    bucket, n = group["bucket"].to_numpy(), group["n"].to_numpy()
    total = np.full(BUCKETS, SMOOTHING)
    total[bucket[bucket >= 0]] += n[bucket >= 0]
    logs = np.log(total / total.sum()).astype("<f4")
    return pa.table({"lang": group["lang"][:1], "texts": pa.array([int(n[bucket < 0].sum())]), "logs": pa.array([logs.tobytes()], pa.binary())})


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Every row with a text and a language counts, and each copy of a text."""
    prepare(df.sparkSession)
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    found = sorted(count(rows, text, lang).groupBy("lang").applyInArrow(_column, "lang string, texts long, logs binary").collect())  # one row a language
    texts = np.array([r["texts"] for r in found], float)
    matrix = np.stack([np.frombuffer(r["logs"], "<f4") for r in found], 1) if found else np.zeros((BUCKETS, 0), np.float32)
    return Model([r["lang"] for r in found], np.log(texts / max(texts.sum(), 1)), matrix)


def sparse(pieces: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of all n-grams of folded pieces (text, points), in order."""
    keys = [bucket + (number << 16) for number, points in pieces for bucket in grams(points)]
    keys, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    return keys >> 16, keys & (BUCKETS - 1), n


def scores(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities, texts x languages, and which texts have a letter."""
    sums = np.tile(model.prior, (len(texts), 1))
    letters = np.zeros(len(texts), bool)
    held: list[tuple[int, np.ndarray]] = []

    def add() -> None:
        row, bucket, n = sparse(held)
        start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
        for a in range(0, len(model.names), LANGUAGES):
            part = model.matrix[:, a : a + LANGUAGES][bucket].astype(np.float64) * n[:, None]
            if len(start):
                sums[row[start], a : a + LANGUAGES] += np.add.reduceat(part, start, axis=0)
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        for piece in blocks(text or ""):
            letters[i] |= bool((piece != 32).any())
            held.append((i, piece))
            size += len(piece)
            if size >= BLOCK:
                add()
                size = 0
    add()
    return sums, letters


def predict(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the most likely language and its posterior probability, under the given names."""
    spark = prepare(df.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = batch.column(batch.schema.names.index(text))
            for i in range(0, max(batch.num_rows, 1), 256):
                part = batch.slice(i, 256)
                sums, known = scores(column.slice(i, 256).to_pylist(), model)
                known &= bool(model.names)
                best = sums.argmax(1) if model.names else np.zeros(len(sums), np.int64)
                own = sums.max(1, initial=-np.inf)
                share = np.zeros(len(sums))
                share[known] = 1.0 / np.exp(sums[known] - own[known, None]).sum(1)
                found = [model.names[b] if k else UNKNOWN for b, k in zip(best, known)]
                keep = [(n, c) for n, c in zip(part.schema.names, part.columns) if n not in names]
                yield pa.RecordBatch.from_arrays([c for _, c in keep] + [pa.array(found, pa.string()), pa.array(share, pa.float64())], [n for n, _ in keep] + list(names))

    fields = [f for f in df.schema.fields if f.name not in names]
    return df.mapInArrow(thrifty(run), T.StructType(fields + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))
