"""Removal of byte strings that repeat across documents, by suffix arrays with bounded expansion.

A byte goes when a string of WINDOW bytes that covers it also starts in a document with
a smaller id. The corpus is far too large for one suffix array, so it is cut
where equal strings cannot be parted:

1. Documents are packed into batches. Every window of WINDOW bytes has an anchor, the
   leftmost gram of GRAM bytes in it with the least hash: equal windows have equal anchors.
   Each batch sends each distinct anchor hash once, in blobs by hash range; those of
   two documents or more come back. Windows with other anchors cannot repeat.
2. The other windows' contexts (runs of windows of one anchor) are sent to
   shards by anchor hash, each distinct context of a batch once, with its smallest document.
3. A shard sorts the suffixes of its distinct contexts, takes their
   Burrows-Wheeler transform and extends intervals backward, breadth first: level l sets all
   places where neighbours have a common prefix of l bytes. It stops at WINDOW; what lies
   between the places set is one string. The smallest document of each string goes back.
4. Batches mark the windows whose string starts in a smaller document.

An anchor of more than HOT places (a common phrase, a run of blanks) would gather in one shard whatever
stands around it. Its windows are dealt by SIDE more bytes, those before the anchor where
the window has so many, else those behind it: equal windows have equal ones, and so still meet.

Hot passages cost one context a batch, however many documents share them. Blobs hold one anchor or context at
least, so there are never more of them than anchors; the numbers of ranges, shards and tasks grow with the text, and each
range, shard and task is of bounded size. One string that is in all batches sends one context from each to its shard.
Every step is written before the next, and its shuffle files go then.

Edge cases: null and empty texts have no bytes and keep none; texts shorter than
WINDOW are kept whole; texts of any length are read whole, in chunks; rows without id
are left out; rows that share an id are one document, so they
do not remove each other's bytes; an empty table gives no rows; other columns
come along only in the struct `carried`, so their names never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm.grouping import contiguous
from nearfield.llm.rolling import BASE, BYTE_HASH, INVERSE, powers
from nearfield.runtime import ROW_GROUPS, discard, materialize, prepare, remove, scratch, swept, thrifty, work_path

WINDOW = 50
GRAM = 20
BATCH_BYTES = 1 << 20
CHUNK = 1 << 17  # windows hashed together
RANGE_BYTES = 16 << 20  # text bytes for each range of anchor hashes
SHARD_BYTES = 1 << 20  # context bytes for each shard
HOT = 8192  # places of an anchor from which on its windows are dealt by more bytes
SIDE = (WINDOW - GRAM) // 2
TASK_BYTES = 16 << 20  # context bytes, or half of the text bytes, for each task

SPREAD = np.uint64(0xFF51AFD7ED558CCD)

_powers: tuple[np.ndarray, np.ndarray] | None = None


def chunk_powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, enough for a chunk."""
    global _powers
    if _powers is None:
        _powers = powers(BASE, CHUNK + WINDOW), powers(INVERSE, CHUNK + WINDOW)
    return _powers


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Mixed hashes of the grams of at most a chunk of bytes."""
    up, down = chunk_powers()
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_HASH[raw] * up[: len(raw)], dtype=np.uint64, out=sums[1:])
    found = (sums[GRAM:] - sums[:-GRAM]) * down[: len(raw) - GRAM + 1]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0x9E3779B97F4A7C15)
    found ^= found >> np.uint64(29)
    return found * np.uint64(0xBF58476D1CE4E5B9)


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window its anchor's place; then the distinct places and the grams' hashes there."""
    n = len(raw) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    place, at, hashes = np.zeros(n, np.uint32), [], []
    grams = WINDOW - GRAM + 1
    for a in range(0, n, CHUNK):
        m = min(CHUNK, n - a)
        found = gram_hashes(raw[a : a + m + WINDOW - 1])
        key = (found >> np.uint64(32) << np.uint64(32)) | np.arange(len(found), dtype=np.uint64)
        width = 1
        while 2 * width <= grams:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < grams:
            key = np.minimum(key[: m + 0], key[grams - width : grams - width + m])
        own = (key[:m] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        place[a : a + m] = own + a
        own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        at.append(own + a)
        hashes.append(found[own])
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    new = np.concatenate(([True], at[1:] != at[:-1]))
    # Anchors are least hashes, so they crowd at the low end; spread anew, equal ranges hold equally many.
    return place, at[new].astype(np.uint32), hashes[new] * SPREAD


class Batch:
    """Some documents in a row: raw bytes, ids and where each starts."""

    def __init__(self, ids: bytes, sizes: bytes, packed: bytes):
        self.text = zstandard.ZstdDecompressor().decompress(packed)
        self.raw = np.frombuffer(self.text, np.uint8)
        self.ids = np.frombuffer(ids, "<i8")
        self.sizes = np.frombuffer(sizes, "<i8")
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, place, side="right")

    def inside(self) -> np.ndarray:
        """For every window, whether it lies within a document."""
        n = max(0, len(self.raw) - WINDOW + 1)
        change = np.zeros(n + 1, np.int32)
        long = self.sizes >= WINDOW
        np.add.at(change, self.starts[long], 1)
        np.add.at(change, self.ends[long] - WINDOW + 1, -1)
        return np.cumsum(change[:n]) > 0


BATCHES = "batch long, ids binary, sizes binary, packed binary, extra binary, n_bytes long"


def pack(docs: DataFrame, doc_id: str, text: str, carried: list[Column]) -> DataFrame:
    """Rows of BATCHES: documents in a row, and the carried columns as an Arrow stream."""
    more = len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, others, size, count = [], [], [], 0, 0
        first = TaskContext.get().partitionId() << 32
        compress = zstandard.ZstdCompressor(level=2).compress

        def out() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts], "<i8")
            extra = pa.BufferOutputStream()
            if more:
                table = pa.Table.from_batches(others)
                with pa.ipc.new_stream(extra, table.schema) as stream:
                    stream.write_table(table)
            row = (first + count, np.array(ids, "<i8").tobytes(), sizes.tobytes(), compress(b"".join(texts)), compress(extra.getvalue().to_pybytes()), int(sizes.sum()))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["batch", "ids", "sizes", "packed", "extra", "n_bytes"])

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                if texts and size > BATCH_BYTES:
                    yield out()
                    ids, texts, others, size, count = [], [], [], 0, count + 1
                ids += part.column(0).to_pylist()
                texts += [(t or "").encode() for t in part.column(1).to_pylist()]
                size = sum(map(len, texts))
                others.append(part.select(range(2, 2 + more)))
        if texts:
            yield out()

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), *carried)
    return rows.mapInArrow(thrifty(run), BATCHES)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """In which of so many equal ranges each hash lies."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def runs(sorted_parts: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, start, end) of each part that occurs; a batch's work does not depend on how many parts there are."""
    parts, start = np.unique(sorted_parts, return_index=True)
    return list(zip(parts.tolist(), start.tolist(), np.append(start[1:], len(sorted_parts)).tolist()))


def sent_anchors(packed: DataFrame, ranges: int) -> DataFrame:
    """Rows (part, batch, hashes, places, several): a batch's distinct anchor hashes in one of the
    ranges, at how many places each stands, and whether several of its documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            batch = Batch(row["ids"], row["sizes"], row["packed"])
            place, _, _ = found = anchors(batch.raw)
            used = np.zeros(len(batch.raw) + 1, bool)
            used[place[batch.inside()]] = True
            keep = used[found[1]]
            at, hashes = found[1][keep], found[2][keep]
            if not len(at):
                continue
            ids = batch.ids[batch.document(at)]
            order = np.argsort(hashes)
            hashes, ids = hashes[order], ids[order]
            start = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
            several = np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start)
            places = np.minimum(np.diff(np.append(start, len(hashes))), HOT + 1).astype("<u2")
            hashes = hashes[start]
            parts = runs(range_of(hashes, ranges))
            blobs = [pa.array([x[a:b].tobytes() for _, a, b in parts], pa.binary()) for x in (hashes, places, several)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in parts], pa.int32()), pa.array([row["batch"]] * len(parts), pa.int64()), *blobs], ["part", "batch", "hashes", "places", "several"])

    return packed.select("batch", "ids", "sizes", "packed").mapInArrow(thrifty(run), "part int, batch long, hashes binary, places binary, several binary")


def _repeated(group: pa.Table) -> pa.Table:
    """Of one range of hashes: for each batch those that several documents have, and those of them that are hot."""
    blobs = group["hashes"].to_pylist()
    counts = np.array([len(b) // 8 for b in blobs])
    hashes = np.frombuffer(b"".join(blobs), "<u8")
    del blobs
    several = np.frombuffer(b"".join(group["several"].to_pylist()), bool)
    places = np.frombuffer(b"".join(group["places"].to_pylist()), "<u2")
    order = np.argsort(hashes)
    ranked = hashes[order]
    start = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    size = np.diff(np.append(start, len(ranked)))
    again = np.zeros(len(hashes), bool)
    again[order] = np.repeat((size > 1) | np.logical_or.reduceat(several[order], start), size)
    hot = np.zeros(len(hashes), bool)
    hot[order] = np.repeat(np.add.reduceat(places[order].astype(np.int64), start) > HOT, size)
    hot &= again
    end = np.cumsum(counts)
    spans = list(zip(end - counts, end))
    out, hottest = ([hashes[a:b][which[a:b]].tobytes() for a, b in spans] for which in (again, hot))
    return pa.table({"batch": group["batch"], "hashes": pa.array(out, pa.binary()), "hot": pa.array(hottest, pa.binary())}).filter(pa.array([len(o) > 0 for o in out]))


def repeated_anchors(sent: DataFrame, ranges: int) -> DataFrame:
    """Rows (batch, hashes, hot) of sent_anchors(). One task a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in contiguous(batches, ["part"]):
            yield from _repeated(group).combine_chunks().to_batches()

    return sent.repartitionById(ranges, F.col("part")).sortWithinPartitions("part").mapInArrow(thrifty(run), "batch long, hashes binary, hot binary")


def contexts(batch: Batch, hashes: np.ndarray, hot: np.ndarray, shards: int) -> tuple[list[tuple[int, bytes]], bytes]:
    """A blob of distinct contexts for each shard, and the batch's own record of where they occur."""
    place, at, found = anchors(batch.raw)
    where = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
    good = np.zeros(len(batch.raw) + 1, bool)
    good[at[hashes[where] == found]] = True
    take = np.flatnonzero(good[place] & batch.inside())
    if not len(take):
        return [], b""
    anchor = place[take].astype(np.int64)
    new = np.concatenate(([True], (take[1:] != take[:-1] + 1) | (anchor[1:] != anchor[:-1])))
    new[1:] |= batch.document(take[1:]) != batch.document(take[:-1])
    if len(hot):  # windows with SIDE bytes before a hot anchor part from those with as many behind it
        near = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
        is_hot = np.zeros(len(batch.raw) + 1, bool)
        is_hot[at[hot[near] == found]] = True
        new[1:] |= is_hot[anchor[1:]] & ((anchor[1:] - take[1:] >= SIDE) != (anchor[:-1] - take[:-1] >= SIDE))
    first = np.flatnonzero(new)
    low, count = take[first], np.diff(np.append(first, len(take)))
    text, seen = batch.text, {}
    number = np.array([seen.setdefault(text[a:b], len(seen)) for a, b in zip(low.tolist(), (low + count + WINDOW - 1).tolist())])
    ids = np.full(len(seen), np.iinfo(np.int64).max)
    np.minimum.at(ids, number, batch.ids[batch.document(low)])
    _, once = np.unique(number, return_index=True)
    anchor = anchor[first][once]
    key = found[np.searchsorted(at, anchor)] >> np.uint64(8)
    if len(hot):
        for i in np.flatnonzero(is_hot[anchor]):
            p = int(anchor[i])
            begin = p - SIDE if p - low[once[i]] >= SIDE else p
            key[i] = xxhash.xxh3_64_intdigest(text[begin : begin + GRAM + SIDE])
    shard = (key % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    strings = list(seen)
    sizes = np.array([len(s) for s in strings], np.uint8)
    rank = np.zeros(len(order), np.int64)
    rank[order] = np.arange(len(order))
    blobs = []
    for s, a, b in runs(shard[order]):
        some = order[a:b]
        blobs.append((s, np.uint32(len(some)).tobytes() + sizes[some].tobytes() + ids[some].tobytes() + b"".join(strings[i] for i in some)))
    record = np.array([len(order), len(low)], "<i8").tobytes() + sizes[order].tobytes() + low.astype("<u4").tobytes() + rank[number].astype("<u4").tobytes()
    return blobs, record


def sent_contexts(packed: DataFrame, repeated: DataFrame, shards: int, tasks: int) -> DataFrame:
    """Rows (own, shard, batch, blob): contexts for the shards (own = 0) and the batches' own records (own = 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for row in _rows(batches):
            hashes, hot = (np.sort(np.frombuffer(b"".join(row[n]), "<u8")) for n in ("repeated", "hot"))
            blobs, record = contexts(Batch(row["ids"], row["sizes"], row["packed"]), hashes, hot, shards)
            if blobs:
                rows = [(0, s, row["batch"], compress(b)) for s, b in blobs] + [(1, -1, row["batch"], compress(record))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["own", "shard", "batch", "blob"])

    lists = repeated.repartition(tasks, "batch").groupBy("batch").agg(F.collect_list("hashes").alias("repeated"), F.collect_list("hot").alias("hot"))  # at most a batch's anchors
    return packed.select("batch", "ids", "sizes", "packed").repartition(tasks, "batch").join(lists, "batch").mapInArrow(thrifty(run), "own int, shard int, batch long, blob binary")


PLACE_BITS = 21  # a place in a shard's text, where three of them fit into one sort key


def _ranked(high: np.ndarray, low: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of (high, low, place), and whether each key differs from the one before.
    high and low are below 2**40 without low, else below 2**PLACE_BITS."""
    n = len(high)
    places = np.arange(n, dtype=np.uint64)
    shift = np.uint64(PLACE_BITS)
    if n <= 1 << PLACE_BITS:  # sorting whole keys is several times faster than sorting places by keys
        key = (high if low is None else high << shift | low) << shift | places
        key.sort()
        order = (key & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        key >>= shift
    else:
        key = high if low is None else high << np.uint64(32) | low
        order = np.argsort(key, kind="stable")
        key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    return order, new


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of text, by the first 80 bytes of each suffix and then by place."""
    n, width = len(text), 5
    padded = np.concatenate((text, np.zeros(width, np.uint8))).astype(np.uint64)
    first = np.zeros(n, np.uint64)
    for i in range(width):
        first = first << np.uint64(8) | padded[i : n + i]
    order, new = _ranked(first, None)
    while width < WINDOW:
        rank = np.zeros(n + width, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64) - np.uint64(1)
        order, new = _ranked(rank[:n], rank[width:])
        width *= 2
    return order


def expand(bwt: np.ndarray, least: int) -> np.ndarray:
    """Where in the suffix array neighbours have fewer than least bytes in common.

    Level by level: a place set at level l - 1 starts an interval; its backward extensions by the
    bytes in the interval start where the last-to-first mapping leads from their first occurrences.
    """
    n = len(bwt)
    first = np.argsort(bwt, kind="stable").astype(np.int32)  # the last-to-first mapping, inverted
    to_first = np.zeros(n, np.int32)
    to_first[first] = np.arange(n, dtype=np.int32)
    ranked = bwt[first]
    placed = np.ones(n, bool)
    placed[1:] = ranked[1:] != ranked[:-1]
    before = np.full(n, -1, np.int32)  # the same byte's place before
    before[first[1:]] = np.where(placed[1:], -1, first[:-1])
    begin = np.flatnonzero(placed).astype(np.int32)
    end = np.append(begin[1:], np.int32(n))
    start, ends = np.repeat(begin, end - begin), np.zeros(n, np.int32)  # of the interval around a place; by its start
    ends[begin] = end
    fresh = np.zeros(n, bool)
    for _ in range(1, least):  # begin and end: only the intervals set at the level before
        for i in range(0, len(begin), 1 << 18):  # blocks bound the memory
            low, length = begin[i : i + (1 << 18)], end[i : i + (1 << 18)] - begin[i : i + (1 << 18)]
            single = length == 1
            one = low[single]
            start[one] = one
            fresh[to_first[one]] = True
            low, length = low[~single], length[~single]
            origin = np.repeat(low, length)
            j = np.arange(len(origin), dtype=np.int32) + np.repeat(low - (np.cumsum(length, dtype=np.int32) - length), length)
            start[j] = origin
            fresh[to_first[j[before[j] < origin]]] = True
        found = np.flatnonzero(fresh)
        fresh[found] = False
        begin = found[~placed[found]].astype(np.int32)
        if not len(begin):
            break
        placed[begin] = True
        within = start[begin]
        same = within[1:] == within[:-1]
        end = ends[within]
        end[:-1][same] = begin[1:][same]
        ends[begin] = end
        head = np.concatenate(([True], ~same))
        ends[within[head]] = begin[head]
    return placed


def _answer(group: pa.Table) -> pa.Table:
    """Of one shard: for every batch, the smallest document that has each window of its contexts."""
    unpack, compress = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
    seen: dict[bytes, int] = {}
    numbers, smallest = [], []
    for packed in group["blob"]:
        blob = unpack(packed.as_py())
        count = int(np.frombuffer(blob, "<u4", 1)[0])
        sizes = np.frombuffer(blob, np.uint8, count, 4).astype(np.int64)
        smallest.append(np.frombuffer(blob, "<i8", count, 4 + count))
        end = 4 + 9 * count + np.cumsum(sizes)
        numbers.append(np.array([seen.setdefault(blob[a:b], len(seen)) for a, b in zip((end - sizes).tolist(), end.tolist())]))
    number = np.concatenate(numbers)
    ids = np.full(len(seen), np.iinfo(np.int64).max)
    np.minimum.at(ids, number, np.concatenate(smallest))
    sizes = np.array([len(s) for s in seen], np.int64)
    text = np.frombuffer(b"\0".join(seen) + b"\0", np.uint8)
    seen.clear()
    order = suffix_order(text)
    placed = expand(text[order - 1], WINDOW)
    begin = np.cumsum(sizes + 1) - sizes - 1
    windows = sizes - WINDOW + 1
    offset = np.cumsum(windows) - windows
    # For each place in the text that starts a window, its context and its place among all windows.
    context = np.repeat(np.arange(len(sizes)), windows)
    slot = np.full(len(text), -1, np.int32)
    slot[np.arange(len(context)) - offset[context] + begin[context]] = np.arange(len(context), dtype=np.int32)
    ranked = slot[order]
    is_window = ranked >= 0
    kind = np.cumsum(placed)[is_window]
    ranked = ranked[is_window]
    start = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    least = np.minimum.reduceat(ids[context[ranked]], start)
    answer = np.zeros(len(context), np.int64)
    answer[ranked] = np.repeat(least, np.diff(np.append(start, len(ranked))))
    out = []
    for own in numbers:
        n = windows[own]
        at = np.repeat(offset[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out.append(compress(answer[at].astype("<i8").tobytes()))
    return pa.table({"shard": group["shard"], "batch": group["batch"], "answer": pa.array(out, pa.binary())})


def _removed(batch: Batch, record: bytes | None, answers: list) -> np.ndarray:
    """Which bytes of the batch go."""
    n = len(batch.raw)
    change = np.zeros(n + 1, np.int32)
    if record:
        unpack = zstandard.ZstdDecompressor().decompress
        raw = unpack(record)
        contexts_, runs = np.frombuffer(raw, "<i8", 2)
        sizes = np.frombuffer(raw, np.uint8, contexts_, 16).astype(np.int64)
        low = np.frombuffer(raw, "<u4", runs, 16 + contexts_).astype(np.int64)
        number = np.frombuffer(raw, "<u4", runs, 16 + contexts_ + 4 * runs)
        smallest = np.frombuffer(b"".join(unpack(a["answer"]) for a in sorted(answers, key=lambda a: a["shard"])), "<i8")
        windows = sizes - WINDOW + 1
        offset = np.cumsum(windows) - windows
        count = windows[number]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = np.repeat(low, count) + step
        least = smallest[np.repeat(offset[number], count) + step]
        gone = place[least < batch.ids[batch.document(place)]]
        np.add.at(change, gone, 1)
        np.add.at(change, gone + WINDOW, -1)
    return np.cumsum(change[:n]) > 0


def answered(sent: DataFrame, tasks: int) -> DataFrame:
    """Rows (shard, batch, answer). Shards are dealt to the tasks in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in contiguous(batches, ["shard"]):
            yield from _answer(group).combine_chunks().to_batches(max_chunksize=64)

    dealt = sent.repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard")
    return dealt.mapInArrow(thrifty(run), "shard int, batch long, answer binary")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept), one for each row of docs with an id, and, if columns are named in
    carry, the struct `carried` of them. kept has the remaining bytes."""
    spark = prepare(docs.sparkSession)
    with scratch(spark) as keep, swept(spark):
        return keep(materialize(_removed_repeats(docs, doc_id, text, carry or []), "passages"))


def _removed_repeats(docs: DataFrame, doc_id: str, text: str, carry: list[str]) -> DataFrame:
    spark = docs.sparkSession
    carried = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    packed = materialize(pack(docs, doc_id, text, carried), "batches")
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = max(8, total // RANGE_BYTES)
    tasks = max(1, -(-total // (2 * TASK_BYTES)))
    repeated = materialize(repeated_anchors(sent_anchors(packed, ranges), ranges), "anchors")
    count = repeated.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    shards = max(8, int(count // 8 * (WINDOW + 16) // SHARD_BYTES))
    path = work_path(spark, "contexts")
    sent_contexts(packed, repeated, shards, tasks).write.options(**ROW_GROUPS).partitionBy("own").parquet(path)
    discard(repeated)
    read = lambda own: spark.read.schema("shard int, batch long, blob binary").parquet(f"{path}/own={own}")
    if not count:  # then neither folder is there
        for own in (0, 1):
            spark.createDataFrame([], "shard int, batch long, blob binary").write.parquet(f"{path}/own={own}")
    answers = materialize(answered(read(0), max(8, shards * SHARD_BYTES // TASK_BYTES)), "answers")
    remove(spark, [f"{path}/own=0"])  # the shards' contexts are answered
    lists = answers.repartition(tasks, "batch").groupBy("batch").agg(F.collect_list(F.struct("shard", "answer")).alias("answers"))  # at most a batch's contexts
    own = read(1).select("batch", F.col("blob").alias("record")).repartition(tasks, "batch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            batch = Batch(row["ids"], row["sizes"], row["packed"])
            gone = _removed(batch, row["record"], row["answers"] or [])
            extra = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["extra"])).read_all() if carry else None
            for first in range(0, len(batch.ids), 512):
                out = []
                for k in range(first, min(first + 512, len(batch.ids))):
                    a, b = int(batch.starts[k]), int(batch.ends[k])
                    cut = gone[a:b]
                    removed = int(cut.sum())
                    spans = int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum()) if removed else 0
                    out.append((int(batch.ids[k]), b - a, removed, spans, batch.raw[a:b][~cut].tobytes() if removed else batch.text[a:b]))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out), result)]
                if carry:
                    more = extra["carried"].slice(first, len(out)).combine_chunks()
                    columns.append(more.chunk(0) if isinstance(more, pa.ChunkedArray) else more)
                yield pa.RecordBatch.from_arrays(columns, result.names + (["carried"] if carry else []))

    result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    fields = [T.StructField(f.name, T.BinaryType() if f.name == "kept" else T.LongType()) for f in result]
    joined = packed.select("batch", "ids", "sizes", "packed", "extra").repartition(tasks, "batch").join(own, "batch", "left").join(lists, "batch", "left")
    return joined.mapInArrow(thrifty(run), T.StructType(fields + [T.StructField("carried", docs.select(*carried).schema["carried"].dataType)] if carry else fields))
