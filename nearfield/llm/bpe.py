"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece the table holds the one token that ends the
prefix's BPE encoding. The token for prefix i is the token t that ends at i,
encodes to itself, and may follow the token stored for prefix i - len(t): two
neighbours may stand together when BPE over their joined bytes gives those two
again. A prefix's entry never depends on later bytes, so bytes can be appended
exactly, and an edit invalidates only the entries from the edit on.

Edge cases: null and empty texts give no tokens and decode to no bytes; very
long pieces cost time in proportion to their length; repeated rows are encoded
alike; extra columns are carried along untouched; an empty table gives none.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nearfield.llm.rolling import BASE, BYTE_HASH, INVERSE, powers
from nearfield.runtime import prepare, thrifty

CACHE_ENTRIES = 50_000
LONG = 40  # bytes of a piece that is encoded together with others
BLOCK = 1 << 19  # characters encoded together
PAIR_BITS = 21  # the table of pairs already judged is emptied when half of its 2**PAIR_BITS slots are in use


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merge_encode(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE by its definition: join the pair of lowest rank, leftmost first, until none joins."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        joined = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        known = [r for r in joined if r is not None]
        if not known:
            break
        i = joined.index(min(known))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Vocabulary:
    """Tokens that encode to themselves, and which of them may stand next to each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.own = {token: rank for token, rank in ranks.items() if len(token) == 1 or merge_encode(token, ranks) == [rank]}
        self.longest = max(map(len, self.own), default=1)
        self.pairs: dict[int, bool] = {}

    def may_follow(self, before: int, token: int) -> bool:
        if len(self.pairs) > CACHE_ENTRIES:
            self.pairs.clear()
        both = self.bytes_of[before] + self.bytes_of[token]
        ok = self.pairs[before << 32 | token] = merge_encode(both, self.ranks) == [before, token]
        return ok


class PrefixTable:
    """The last token of every prefix of one piece. The piece can grow at its end or be edited."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary = vocabulary
        self.piece = b""
        self.last: list[int] = []
        self.append(piece)

    def append(self, more: bytes) -> None:
        voc, last, start = self.vocabulary, self.last, len(self.piece)
        self.piece = piece = self.piece + more
        own, known, longest = voc.own.get, voc.pairs.get, voc.longest
        for end in range(start + 1, len(piece) + 1):
            for begin in range(end - longest if end > longest else 0, end):
                token = own(piece[begin:end])
                if token is None:
                    continue
                if begin:
                    before = last[begin - 1]
                    ok = known(before << 32 | token)
                    if not (voc.may_follow(before, token) if ok is None else ok):
                        continue
                last.append(token)
                break
            else:
                raise ValueError("the vocabulary lacks a single byte")

    def edit(self, begin: int, end: int, new: bytes) -> None:
        """Replace piece[begin:end]; prefixes up to begin keep their entries."""
        tail = self.piece[end:]
        del self.last[begin:]
        self.piece = self.piece[:begin]
        self.append(new + tail)

    def tokens(self) -> list[int]:
        out, end, bytes_of = [], len(self.piece), self.vocabulary.bytes_of
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(bytes_of[token])
        return out[::-1]


class HashTable:
    """Vectorised open addressing from non-zero 64-bit keys to non-negative 32-bit values."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)
        self.used = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, or -1."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there != 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """The keys must be new and distinct."""
        slot, left = self._slot(keys), np.arange(len(keys))
        self.used += len(keys)
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]] = keys[won]
            self.values[slot[won]] = values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask


LETTER, NUMBER, SPACE, OTHER = range(4)
# The characters with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The pattern that split_points() reproduces, and its contractions.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_classes: np.ndarray | None = None


def character_classes() -> np.ndarray:
    global _classes
    if _classes is None:
        table = np.full(0x110000, OTHER, np.uint8)
        for i in range(0x110000):
            kind = unicodedata.category(chr(i))[0]
            if kind in "LN":
                table[i] = LETTER if kind == "L" else NUMBER
        table[WHITE_SPACE] = SPACE
        _classes = table
    return _classes


def split_points(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pieces of KNOWN_PATTERN start. points: the code points of several
    texts in a row; first: true where a text starts."""
    n = len(points)
    kind = character_classes()[points]
    space = kind == SPACE
    last = np.append(first[1:], True)
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last white space before other characters is a piece, or part of the next one if it is a blank.
    before = np.append(space[:-1] & ~space[1:], False) & ~last
    start |= before
    behind = np.flatnonzero(before & (points == 32)) + 1
    start[behind] = False
    # A lone apostrophe at which a match starts, before the letters of a contraction.
    quote = np.flatnonzero((points == 39) & start & ~last)
    if len(quote):
        quote = quote[kind[quote + 1] == LETTER]
        padded = np.append(points, [0, 0])
        ends = np.append(last, [True, True])
        second, third = padded[quote + 1], np.where(ends[quote + 1], 0, padded[quote + 2])
        size = np.zeros(len(quote), np.int64)
        for c in CONTRACTIONS:
            fits = second == ord(c[0])
            if len(c) == 2:
                fits &= third == ord(c[1])
            size[fits & (size == 0)] = len(c) + 1
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        after = quote + size
        start[after[after < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes many texts at once.

    Equal pieces of the texts are encoded once. The prefix tables of all
    distinct pieces are filled side by side, one byte position after another:
    tokens are found by the hash of their bytes, pairs of neighbours in a table
    of pairs already judged. Pieces of more than LONG bytes go one by one.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = voc = Vocabulary(ranks)
        self.split = regex.compile(pattern).findall
        self.known = pattern == KNOWN_PATTERN
        self.inverse = powers(INVERSE, LONG + 1)
        self.base = powers(BASE, LONG + 1)
        self.size = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        self.own = self._table(voc.own)
        self.longest = min(voc.longest, LONG)
        self.pairs = HashTable(PAIR_BITS)
        self.long: dict[bytes, bytes] = {}

    def _table(self, tokens: dict[bytes, int]) -> HashTable:
        table = HashTable(max(8, (8 * len(tokens)).bit_length()))
        short = [t for t in tokens if len(t) <= LONG]
        keys = np.array([self._key(t) for t in short], np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two tokens have one hash; choose another BASE")
        table.put(keys, np.array([tokens[t] for t in short], np.int32))
        return table

    def _key(self, piece: bytes) -> int:
        raw = np.frombuffer(piece, np.uint8)
        return int((BYTE_HASH[raw] * self.base[: len(raw)]).sum(dtype=np.uint64))

    def _keys(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """_key of many short pieces, byte by byte of all of them, so that nothing as wide as the text is made."""
        order = np.argsort(-size, kind="stable")
        at, key = begin[order], np.zeros(len(begin), np.uint64)
        longer = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")  # pieces with more than i bytes
        for i, n in enumerate(longer.tolist()):
            key[:n] += BYTE_HASH[raw[at[:n] + i]] * self.base[i]
        out = np.empty_like(key)
        out[order] = key
        return out

    def _follows(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        keys = (before.astype(np.uint64) << np.uint64(32)) | token.astype(np.uint64) | np.uint64(1 << 63)
        found = self.pairs.get(keys)
        if len(new := np.unique(keys[found < 0])):
            if self.pairs.used + len(new) > (self.pairs.mask >> 1):
                self.pairs = HashTable(max(PAIR_BITS, (4 * len(new)).bit_length()))
                new = np.unique(keys)
            ok = [self.vocabulary.may_follow(int(k >> 32) & 0x7FFFFFFF, int(k) & 0xFFFFFFFF) for k in new.tolist()]
            self.pairs.put(new, np.array(ok, np.int32))
            found = self.pairs.get(keys)
        return found == 1

    def _tables(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The prefix tables of pieces raw[begin : begin + size], which come longest first."""
        width = int(size[0])
        at = np.minimum(begin[:, None] + np.arange(width), len(raw) - 1)
        sums = np.zeros((width + 1, len(begin)), np.uint64)
        np.cumsum((BYTE_HASH[raw[at]] * self.base[:width]).T, axis=0, dtype=np.uint64, out=sums[1:])
        last = np.full((width, len(begin)), -1, np.int32)
        for end in range(1, width + 1):
            todo = np.arange(np.searchsorted(-size, -end, side="right"))
            for start in range(max(0, end - self.longest), end):
                token = self.own.get((sums[end, todo] - sums[start, todo]) * self.inverse[start])
                hit = np.flatnonzero(token >= 0)
                if start and len(hit):
                    hit = hit[self._follows(last[start - 1, todo[hit]], token[hit])]
                last[end - 1, todo[hit]] = token[hit]
                if len(hit):
                    keep = np.ones(len(todo), bool)
                    keep[hit] = False
                    todo = todo[keep]
                    if not len(todo):
                        break
            if len(todo):
                raise ValueError("the vocabulary lacks a single byte")
        return last

    def _distinct(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct short pieces, one after another; each piece's place and count there."""
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        counts = np.zeros(len(begin), np.int64)
        ids = np.zeros((len(begin), int(size[0])), np.int32)
        for i in range(0, len(begin), 10_000):  # bounds the memory of the tables
            some = slice(i, i + 10_000)
            last, left, rows = self._tables(raw, begin[some], size[some]), size[some].copy(), np.arange(len(begin[some]))
            while len(rows):  # the tokens from the last to the first
                token = last[left[rows] - 1, rows]
                ids[i + rows, counts[i + rows]] = token
                counts[i + rows] += 1
                left[rows] -= self.size[token]
                rows = rows[left[rows] > 0]
        column = counts[:, None] - 1 - np.arange(ids.shape[1])
        flat = np.take_along_axis(ids, np.maximum(column, 0), 1)[column >= 0]
        place = np.zeros(len(begin), np.int64)
        place[order] = np.cumsum(counts) - counts
        back = np.zeros(len(begin), np.int64)
        back[order] = counts
        return flat, place, back

    def _alone(self, piece: bytes) -> np.ndarray:
        packed = self.long.get(piece)
        if packed is None:
            whole = self.vocabulary.ranks.get(piece)
            ids = [whole] if whole is not None else PrefixTable(self.vocabulary, piece).tokens()
            packed = np.array(ids, "<u4").tobytes()
            if len(piece) <= 4 * LONG:
                if len(self.long) >= CACHE_ENTRIES:
                    self.long.clear()
                self.long[piece] = packed
        return np.frombuffer(packed, "<u4").astype(np.int32)

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes, where their pieces start, and the number of bytes before each text."""
        joined = "".join(texts)
        raw = np.frombuffer(joined.encode(), np.uint8)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        chars = np.cumsum([0] + [len(t) for t in texts])
        if self.known:
            first = np.zeros(len(points), bool)
            first[chars[:-1][np.diff(chars) > 0]] = True
            start = split_points(points, first)
        else:
            start = np.cumsum([0] + [len(p) for t in texts for p in self.split(t)])[:-1]
        place = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=place[1:])
        return raw, place[start], place[chars]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The texts' ids as packed little-endian unsigned 32-bit integers."""
        out, i = [], 0
        while i < len(texts):  # blocks of about BLOCK characters
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j] or "") <= BLOCK):
                size += len(texts[j] or "")
                j += 1
            out += self._encode_block([t or "" for t in texts[i:j]])
            i = j
        return out

    def _encode_block(self, texts: list[str]) -> list[bytes]:
        raw, begin, bounds = self._pieces(texts)
        if not len(raw):
            return [b""] * len(texts)
        size = np.diff(np.append(begin, len(raw)))
        short = np.flatnonzero(size <= LONG)
        place, count, flats, used = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64), [], 0
        if len(short):
            key = self._keys(raw, begin[short], size[short])
            _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            flat, at, n = self._distinct(raw, begin[short[first]], size[short[first]])
            place[short], count[short] = at[inverse], n[inverse]
            flats.append(flat)
            used = len(flat)
        for k in np.flatnonzero(size > LONG):
            ids = self._alone(raw[begin[k] : begin[k] + size[k]].tobytes())
            place[k], count[k] = used, len(ids)
            flats.append(ids)
            used += len(ids)
        flat = np.concatenate(flats)
        end = np.cumsum(count)
        ids = flat[np.repeat(place - (end - count), count) + np.arange(end[-1])].astype("<u4")
        cut = np.append(0, end)[np.searchsorted(begin, bounds)]
        return [ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder_for(vocabulary_path: str, pattern: str) -> Encoder:
    """The worker's encoder: tasks that follow each other in a worker share its tables."""
    key = (vocabulary_path, pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(load_ranks(vocabulary_path), pattern)
    return _encoders[key]


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.fromiter(map(len, tokens), np.int64, size)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, packed: bytes | None, block: int = 1 << 18) -> bytes:
        ids = np.frombuffer(packed or b"", "<u4").astype(np.int64)
        out = []
        for i in range(0, len(ids), block):
            some = ids[i : i + block]
            length = self.length[some]
            end = np.cumsum(length)
            shift = np.repeat(self.start[some] - (end - length), length)
            out.append(self.data[shift + np.arange(len(shift))].tobytes())
        return b"".join(out)


def _appended(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n not in columns]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + list(columns.values()), [n for n, _ in kept] + list(columns))


def _schema(df: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    new = {name for name, _ in more}
    return T.StructType([f for f in df.schema.fields if f.name not in new] + [T.StructField(n, t) for n, t in more])


def encode(df: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds n_tokens and the packed ids of every text, and in the column `decoded`, if one is named, the bytes that these ids stand
    for, by the same workers. The vocabulary file is read by each worker from vocabulary_path, which must exist on all of them."""
    prepare(df.sparkSession)
    more = [(decoded, T.BinaryType())] if decoded else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocabulary_path, pattern)
        decoder = Decoder(load_ranks(vocabulary_path)) if decoded else None
        for batch in batches:
            column = batch.column(batch.schema.names.index(text))
            for i in range(0, max(batch.num_rows, 1), 256):
                packed = encoder.encode_all(column.slice(i, 256).to_pylist())
                found = {"n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()), out: pa.array(packed, pa.binary())}
                if decoder is not None:
                    found[decoded] = pa.array([decoder.decode(p) for p in packed], pa.binary())
                yield _appended(batch.slice(i, 256), found)

    return df.mapInArrow(thrifty(run), _schema(df, ("n_tokens", T.LongType()), (out, T.BinaryType()), *more))


def decode(df: DataFrame, vocabulary_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that the packed ids stand for."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(load_ranks(vocabulary_path))
        for batch in batches:
            column = batch.column(batch.schema.names.index(ids))
            for i in range(0, max(batch.num_rows, 1), 256):
                found = [decoder.decode(p) for p in column.slice(i, 256).to_pylist()]
                yield _appended(batch.slice(i, 256), {out: pa.array(found, pa.binary())})

    return df.mapInArrow(thrifty(run), _schema(df, (out, T.BinaryType())))
