"""Alignment of two tokenizers' tokens by the bytes they cover, with segments deduplicated.

A is a byte-level BPE (tokenizers), B a BPE of pieces (sentencepiece). Texts are cut before runs of white space
where neither vocabulary has a token that goes on across the cut, which is looked up in both vocabularies and not assumed:
A's own pattern starts a new match at such a run whatever stands before it, and BPE can join across the cut only into a
token that B has. So the tokens of a text are those of its segments, one after the other.

Documents are read once, in blocks of bounded size: a block lists its distinct segments and keeps its texts as their
numbers. Segments of all blocks are sorted, so that equal ones lie together; each distinct one is tokenised and aligned once
and the alignment goes back to the blocks, where texts are put together from it. In between, links are counted by id pair.

A segment's alignment is a line `a1,a2|b1;a3|b2,b3`: groups between byte offsets at which tokens of both end. Where tokens
end together there is one link, of the last tokens of a group's sides.

Edge cases: texts that are null or empty, and those whose tokens' bytes are not the text's (such as with U+2581, which B reads as a blank),
have no tokens and their links count nowhere; texts of any length are read whole, one of them being held at a time with its
distinct segments; repeated rows count each time; an empty table gives no rows; columns other than the two named are not
read, so their names never clash.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.runtime import ROW_GROUPS, materialize, prepare, remove, thrifty, work_path

SEGMENTS = 1 << 19  # distinct segments of a block; a text that alone has more is a block by itself
TEXT = 1 << 26  # characters of a block
CODES = 1 << 20  # segment numbers in one row of a text's
PAIRS = 4 << 20  # id pairs with their counts that are broadcast, 64 MB; beyond it they are joined
BATCH = 4 << 20  # bytes of lines that leave a task together
#: What may be white space to any of the two, and of these the characters before which a text may be cut.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff\u2581"
CUTS = "\t\n\x0b\x0c\r "


def byte_of() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary_a(path: str) -> list[bytes]:
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    split = whole.get("pre_tokenizer") or {}
    if whole.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("a byte-level tokenizer without normalizer and without a blank added is needed")
    table = byte_of()
    entries = {i: bytes(table[c] for c in token) for token, i in whole["model"]["vocab"].items()}
    return [entries.get(i, b"") for i in range(max(entries) + 1)]


def vocabulary_b(model) -> list[bytes]:
    as_byte = lambda i: bytes([int(model.id_to_piece(i)[3:-1], 16)])
    return [as_byte(i) if model.is_byte(i) else b"" if model.is_control(i) else model.id_to_piece(i).replace("\u2581", " ").encode() for i in range(model.get_piece_size())]


def cuts(vocabularies: list[list[bytes]]) -> str:
    """The characters of CUTS before which no token has anything but white space."""
    found = set(CUTS)
    within = re.compile(f"[^{re.escape(BLANKS)}]([{re.escape(CUTS)}])", re.S)
    for entries in vocabularies:
        for token in entries:
            # A token may start or end inside a character, whose bytes then are no white space.
            found -= set(within.findall(token.decode("utf-8", "replace")))
    return "".join(c for c in CUTS if c in found)


def splitter(allowed: str) -> tuple[re.Pattern, re.Pattern]:
    """The pattern of one segment, and one that finds white space which forbids a cut behind it."""
    others = "".join(c for c in BLANKS if c not in allowed)
    s, e = re.escape(allowed), re.escape(others)
    if not allowed:
        return re.compile(r".+", re.S), re.compile("(?!)")
    return re.compile(rf"[{s}]+(?:[^{s}]*[{e}][{s}]+)*[^{s}]*|[^{s}]+(?:(?<=[{e}])[{s}]+[^{s}]*)*"), re.compile(f"[{e}]")


class Pair:
    """Both tokenizers, in one process."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.bytes_a, self.bytes_b = vocabulary_a(a), vocabulary_b(self.b)
        self.size_a, self.size_b = ([len(x) for x in v] for v in (self.bytes_a, self.bytes_b))
        allowed = cuts([self.bytes_a, self.bytes_b])
        # A letter before a segment is a token by itself, so B's own blank is not joined with the segment.
        self.lead = next(t for t in ("a", "e", "x", "1") if self.bytes_b[self.b.encode(t)[-1]] == f" {t}".encode())
        self.segment, self.odd = splitter(allowed)
        self.simple = re.compile(f"[{re.escape(allowed)}]+[^{re.escape(allowed)}]*") if allowed else self.segment

    def segments(self, text: str) -> list[str]:
        """The segments of a blank and the text."""
        whole = " " + text
        return (self.segment if not whole.isascii() and self.odd.search(whole) or "\r" in whole else self.simple).findall(whole)

    def lines(self, segments: list[str]) -> list[str | None]:
        """The alignment of each segment; None where the tokens' bytes are not the segment's."""
        first = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        second = [ids[1:] if ids and self.bytes_b[ids[0]] == f" {self.lead}".encode() else None for ids in self.b.encode([self.lead + s for s in segments], num_threads=1)]
        return [self.line(s.encode(), x, y) for s, x, y in zip(segments, first, second)]

    def line(self, whole: bytes, a: list[int], b: list[int] | None) -> str | None:
        if b is None or b"".join([self.bytes_a[i] for i in a]) != whole or b"".join([self.bytes_b[i] for i in b]) != whole:
            return None
        out, i, j, left, right, end_a, end_b = [], 0, 0, 0, 0, 0, 0
        while i < len(a):
            if end_a <= end_b:
                end_a += self.size_a[a[i]]
                i += 1
            else:
                end_b += self.size_b[b[j]]
                j += 1
            while end_b < end_a and j < len(b):
                end_b += self.size_b[b[j]]
                j += 1
            if end_a == end_b:
                out.append(f"{','.join(map(str, a[left:i]))}|{','.join(map(str, b[right:j]))}")
                left, right = i, j
        return ";".join(out)


@lru_cache(maxsize=1)
def pair(a: str, b: str) -> Pair:
    return Pair(a, b)


#: The signs of a line as half bytes, which take half the room in tables and shuffles.
HALVES = str.maketrans(",|;", "abc")
SIGNS = str.maketrans({"a": ",", "b": "|", "c": ";", "f": None})


def halved(line: str) -> bytes:
    found = line.translate(HALVES)
    return bytes.fromhex(found + "f" * (len(found) % 2))


def whole(data: bytes) -> str:
    return data.hex().translate(SIGNS)


def squeezed(codes: np.ndarray) -> bytes:
    """Numbers byte by byte, the lowest bytes first, compressed: most have few bits."""
    return len(codes).to_bytes(4, "little") + pa.compress(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def spread(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    flat = pa.decompress(data[4:], 4 * n, "zstd", asbytes=True) if n else b""
    return np.frombuffer(flat, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


#: Segments lie at their numbers, rows of documents from DOCUMENTS on.
DOCUMENTS = 1 << 30
BLOCKS = "part int, block long, place int, segment string, n int, data binary"
DEALT = ["block", "place", "data"]


def _blocks(a: str, b: str):
    """Rows of a block: its distinct segments (part 0: place, segment, n) and its documents (part 1: place, data). The
    data of a document are whether it starts here, its id, and numbers of segments; a long one takes several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, task, block = pair(a, b), TaskContext.get().partitionId(), 0
        number: dict[str, int] = {}
        docs: list[bytes] = []
        counts = np.zeros(0, np.int64)
        size = 0

        def rows(part: int, places: range, segments: list, n: list, data: list) -> pa.RecordBatch:
            m, key = len(places), task << 32 | block
            return pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int32()), pa.array([key] * m, pa.int64()), pa.array(places, pa.int32()), pa.array(segments, pa.string()), pa.array(n, pa.int32()), pa.array(data, pa.binary())], ["part", "block", "place", "segment", "n", "data"])

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal number, docs, counts, size, block
            words = iter(number)
            for i in range(0, len(number), 1 << 16):
                places = range(i, min(i + (1 << 16), len(number)))
                some = [w for _, w in zip(places, words)]  # the range first, so that no word is lost
                yield rows(0, places, some, counts[i : i + len(some)], [None] * len(some))
            for i in range(0, len(docs), 256):
                some = docs[i : i + 256]
                yield rows(1, range(DOCUMENTS + i, DOCUMENTS + i + len(some)), [None] * len(some), [None] * len(some), some)
            number, docs, counts, size = {}, [], np.zeros(0, np.int64), 0
            block += 1

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                codes = np.array([number.setdefault(s, len(number)) for s in tokenizers.segments(text)] if text else [], np.int32)
                if len(number) > len(counts):
                    counts = np.concatenate([counts, np.zeros(max(len(number), 2 * len(counts)) - len(counts), np.int64)])
                np.add.at(counts, codes, 1)
                for i in range(0, max(len(codes), 1), CODES):
                    docs.append(bytes([i == 0, key is not None]) + (key or 0).to_bytes(8, "little", signed=True) + squeezed(codes[i : i + CODES]))
                size += len(text or "") + 64
                if len(number) >= SEGMENTS or size >= TEXT:
                    yield from out()
        if docs:
            yield from out()

    return run


def _aligned(a: str, b: str):
    """Of rows (block, place, n, segment) in order of the segment: (block, place, n, data), each distinct segment tokenised once.
    data: the segment's line, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, line = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(batch.schema.names.index("segment")).dictionary_encode()
            distinct = words.dictionary.to_pylist()
            new = [w for w in distinct if w != last]
            found = {w: None if f is None else halved(f) for w, f in zip(new, pair(a, b).lines(new))}
            if last in distinct:
                found[last] = line
            last, line = distinct[-1], found[distinct[-1]]
            data = pa.array([found[w] for w in distinct], pa.binary()).take(words.indices)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in ("block", "place", "n")), data], ["block", "place", "n", "data"])

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, int | None, list[np.ndarray]]]:
    """(block, batches of its segments' rows, doc_id, its segment numbers) of every document, of rows in order of block and place."""
    block, words, held = None, [], []
    key = None
    for batch in batches:
        blocks, places = (batch.column(batch.schema.names.index(c)).to_numpy() for c in ("block", "place"))
        data = batch.column(batch.schema.names.index("data"))
        first = places < DOCUMENTS
        edges = np.flatnonzero(np.concatenate(([True], (blocks[1:] != blocks[:-1]) | (first[1:] != first[:-1]), [True]))) if len(blocks) else []
        for x, y in zip(edges[:-1], edges[1:]):
            if blocks[x] != block:
                if held:
                    yield block, words, key, held
                block, words, held = int(blocks[x]), [], []
            if first[x]:
                words.append(batch.slice(x, y - x))
                continue
            for i in range(x, y):
                row = data[i].as_py()
                if row[0] and held:
                    yield block, words, key, held
                    held = []
                key = int.from_bytes(row[2:10], "little", signed=True) if row[1] else None
                held.append(spread(row[10:]))
    if held:
        yield block, words, key, held


def _dealt(words: DataFrame, docs: DataFrame) -> DataFrame:
    """Segments and documents of a block side by side, segments first. There are as many tasks as blocks, so a task's share does not
    grow with the corpus."""
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.select("block").distinct().count())
    return words.unionByName(docs, allowMissingColumns=True).repartition(tasks, "block").sortWithinPartitions("block", "place")


def _refused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, place, less): how often segments stand in documents that hold one of the given segments."""
    last, bad = None, np.zeros(0, np.int32)
    for block, words, _, held in _documents(batches):
        if words is not last:
            last = words
            bad = np.concatenate([np.zeros(0, np.int32), *(w.column(w.schema.names.index("place")).to_numpy() for w in words)])
        if any(np.isin(codes, bad).any() for codes in held):
            number, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(number), pa.int64()), pa.array(number, pa.int32()), pa.array(n, pa.int64())], ["block", "place", "less"])


def _groups(lines: DataFrame, *keep: str) -> DataFrame:
    """Rows (*keep, a, b): the link of each group of each line."""
    line = F.translate(F.hex("data"), "ABCF", ",|;")
    side = lambda i: F.substring_index(F.substring_index("g", "|", i), ",", -1).cast("int")
    return lines.where("data is not null").select(*keep, F.explode(F.split(line, ";")).alias("g")).select(*keep, side(1).alias("a"), side(-1).alias("b"))


def link_counts(lines: DataFrame) -> DataFrame:
    """Rows (a, b, n) of rows (n, data): how many links hold each id pair linked."""
    return _groups(lines.where("n > 0"), "n").groupBy("a", "b").agg(F.sum("n").alias("n"))


def links(line: str) -> list[int]:
    """The id pairs of a line, as a << 32 | b."""
    out = []
    for group in line.split(";"):
        x, y = group.split("|")
        out.append(int(x.rpartition(",")[2]) << 32 | int(y.rpartition(",")[2]))
    return out


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _composed(counted: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
    """Documents from their segments' lines. counted: sorted id pairs, the count of each, and whether it is its B id's highest;
    else the segments bring both sums along."""
    fields = [(f.split()[0], {"long": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in ALIGNED.split(", ")]

    def numbers(words: list[pa.RecordBatch]) -> tuple[list[str | None], np.ndarray]:
        """The lines, and of each: its tokens of A and of B (-1: none), links, best links and their counts' sum."""
        lines = [None if d is None else whole(d) for w in words for d in w.column(w.schema.names.index("data")).to_pylist()]
        per = np.zeros((len(lines), 5), np.int64)
        if counted is None:
            for i, c in ((3, "best"), (4, "total")):
                per[:, i] = np.concatenate([w.column(w.schema.names.index(c)).fill_null(0).to_numpy(zero_copy_only=False) for w in words])
        for start in range(0, len(lines), 1 << 16):
            sizes, found = [], []
            for i, line in enumerate(lines[start : start + (1 << 16)], start):
                if line is None:
                    per[i, 1] = -1
                    sizes.append(0)
                    continue
                pairs = links(line)
                commas = line.count(",")
                left = sum(g.partition("|")[0].count(",") for g in line.split(";")) if commas else 0
                per[i, :3] = left + len(pairs), commas - left + len(pairs), len(pairs)
                sizes.append(len(pairs))
                found += pairs
            if counted is not None and found and len(counted[0]):
                # Pairs that stand only in documents without tokens are not counted; their lines are not used.
                keys, n, best = counted
                at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                there = keys[at] == np.array(found)
                owner = np.repeat(np.arange(start, start + len(sizes)), sizes)
                np.add.at(per[:, 3], owner, best[at] & there)
                np.add.at(per[:, 4], owner, np.where(there, n[at], 0))
        return lines, per

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, size = None, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])

        for _, words, key, held in _documents(batches):
            if words is not last:
                last = words
                lines, per = numbers(words) if words else ([], np.zeros((0, 5), np.int64))
            codes = held[0] if len(held) == 1 else np.concatenate(held)
            sums = per[codes]
            if len(codes) and (sums[:, 1] >= 0).all():
                n_a, n_b, n_links, n_best, total = sums.sum(0).tolist()
                rows.append((key, n_a, n_b, n_links, n_links, n_best, total, ";".join([lines[c] for c in codes])))
            else:
                rows.append((key, 0, 0, 0, 0, 0, 0, ""))
            size += len(rows[-1][-1]) + 64
            if size >= BATCH:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()

    return run


def align(df: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", pairs: int = PAIRS) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), one for each row of df. a, b: the files of
    both tokenizers, on a path that every worker has. pairs: so many id pairs are broadcast with their counts at most.

    Blocks and lines are written once and stay in the shared folder as long as the result is read; the result is not.
    """
    spark = prepare(df.sparkSession)
    path = work_path(spark, "segments")
    df.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(thrifty(_blocks(a, b)), BLOCKS).write.options(compression="zstd", **ROW_GROUPS).partitionBy("part").parquet(path)
    blocks = spark.read.schema(BLOCKS.replace("part int, ", "") + ", part int").parquet(path)
    docs = blocks.where("part = 1").select(*DEALT)
    words = blocks.where("part = 0").select("block", "place", "n", "segment").repartition("segment").sortWithinPartitions("segment")
    lines = materialize(words.mapInArrow(thrifty(_aligned(a, b)), "block long, place int, n int, data binary"), "lines", "zstd")
    remove(spark, [f"{path}/part=0"])  # nothing reads the segments any more
    counted = lines
    bad = lines.where("data is null").select(*DEALT)
    if bad.limit(1).count():
        within = docs.join(bad.select("block").distinct(), "block", "left_semi")
        less = _dealt(bad, within).mapInArrow(thrifty(_refused), "block long, place int, less long").groupBy("block", "place").agg(F.sum("less").alias("less"))
        counted = lines.join(less, ["block", "place"], "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0)))
    counts = materialize(link_counts(counted), "links")
    best = counts.groupBy("b").agg(F.max("n").alias("most"))  # at most one row an id of B
    counts = counts.join(best, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    lines = lines.select(*DEALT)
    if counts.count() <= pairs:
        found = counts.toArrow()
        key = found["a"].to_numpy().astype(np.int64) << 32 | found["b"].to_numpy()
        order = np.argsort(key)
        shared = spark.sparkContext.broadcast((key[order], found["n"].to_numpy()[order], found["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)))
        return _dealt(lines, docs).mapInArrow(thrifty(lambda batches: _composed(shared.value)(batches)), ALIGNED)
    sums = _groups(lines, "block", "place").join(counts, ["a", "b"]).groupBy("block", "place").agg(F.sum(F.col("best").cast("long")).alias("best"), F.sum("n").alias("total"))
    return _dealt(lines.join(sums, ["block", "place"], "left"), docs).mapInArrow(thrifty(_composed(None)), ALIGNED)
