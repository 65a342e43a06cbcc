"""MinHash near-dedup: universal hash minima, banding, verification, connected components.

1. Each text becomes its set of word shingles (64-bit hashes), about 125 minima of
   universal hashes, keys of bands of some minima, and a fingerprint of the set.
2. Documents with equal sets are one class; only its smallest id goes on.
3. Band keys with more than one class are buckets; of buckets with the same
   members one is kept. layout() makes bands so narrow that a link at the
   threshold shares no bucket with a probability of at most 1e-6. A pair is looked at only in the first bucket that it shares.
4. A bucket of n members is dealt to n / BLOCK parts, and to each part go REPS members of the whole
   bucket besides. In a part first sizes and signatures are compared, then the full sets, and not where confirmed links join
   a pair already: the work is in proportion to n, and no part returns more edges than it has rows.
5. Connected components of these edges; each is a star from here on. In buckets of several parts only members of different components are left to
   compare. Those outside the bucket's largest component, mostly none or few, meet all others in
   blocks: by signatures alone, and texts are fetched only for rows with a pair that is left then.
6. Connected components of all edges.

Edge cases: null texts and texts without words have an empty set and link with
nothing; fewer words than a shingle has are one shingle; texts of any length
are used whole; rows without id are left out; rows that share an id are one node
of the link graph; an empty table gives no rows; columns other than the two named are not read, so their names never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.components import connected_components
from nearfield.llm.grouping import contiguous, matching
from nearfield.llm.rolling import BASE, BYTE_HASH, INVERSE, powers
from nearfield.runtime import few, materialize, prepare, scratch, thrifty

HASHES = 125
MISSED = 1e-6
#: Pairs whose signatures agree less than this much below the threshold are not compared further (5.3 standard deviations).
SLACK = 0.17
BLOCK = 300  # rows with texts compared in one go
TASK_ROWS = 4096  # rows compared in one task, if there are so many
SIGNATURE_BLOCK = 4096  # the same without texts
REPS = 4
CHUNK = 1 << 20  # bytes of text hashed together

_rng = np.random.Generator(np.random.PCG64(20240611))
FACTORS = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of some bytes, in order."""
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_HASH[raw] * powers(BASE, len(raw)), dtype=np.uint64, out=sums[1:])
    return mix((sums[end] - sums[begin]) * powers(INVERSE, len(raw) + 1)[begin])


def shingles(text: bytes, width: int) -> np.ndarray:
    """The sorted set of shingle hashes of a text in lower case."""
    words = word_hashes(np.frombuffer(text, np.uint8))
    if not len(words):
        return words
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    return np.unique(out)


def minima(found: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 512):
        np.minimum(least, (found[i : i + 512, None] * FACTORS + OFFSETS).min(0), out=least)
    return least


def layout(percent: int) -> tuple[int, int]:
    """The number of bands and the minima of each: as many as leave enough bands for the threshold."""
    for rows in range(16, 1, -1):
        if (1 - (percent / 100) ** rows) ** (HASHES // rows) <= MISSED:
            return HASHES // rows, rows
    return HASHES, 1


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + least[: bands * rows].reshape(bands, rows)[:, i])
    return keys.view(np.int64)


SIGNED = "doc_id long, n_shingles long, fingerprint binary, bands array<long>, signature binary, packed binary"


def sign(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    shape = layout(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                out = []
                for key, value in zip(batch.column(0).slice(i, 512).to_pylist(), batch.column(1).slice(i, 512).to_pylist()):
                    raw = (value or "").encode().lower()
                    found = shingles(raw, width)
                    if not len(found):
                        out.append((key, 0, None, None, None, None))
                        continue
                    least = minima(found)
                    low = (mix(least) & np.uint64(0xFFFF)).astype("<u2").tobytes()
                    out.append((key, len(found), xxhash.xxh3_128_digest(found.tobytes()), band_keys(least, *shape), low, pack(raw)))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "n_shingles", "fingerprint", "bands", "signature", "packed"])

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(thrifty(run), SIGNED)


class Forest(dict):
    """Union-find over ids that appear as they are asked for."""

    def find(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = self.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self[max(a, b)] = min(a, b)
        return True


def candidates(group: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The pairs of a block that sizes, signatures and components leave: for a left place, right places and how far they
    agree. A block may have millions, so they are never all there at once."""
    ids, sizes, component = (group[n].to_numpy() for n in ("doc_id", "n_shingles", "component"))
    band = group["band"][0].as_py()
    signatures = np.frombuffer(b"".join(group["signature"].to_pylist()), "<u2").reshape(len(ids), HASHES)
    bands = np.array(group["bands"].combine_chunks().flatten()).reshape(len(ids), -1)
    left, right = np.flatnonzero(group["is_left"].to_numpy()), np.flatnonzero(group["is_right"].to_numpy())
    both = np.intersect1d(left, right)
    for a in left:
        others = right[right > a] if len(both) == len(left) == len(right) else right
        small, large = np.minimum(sizes[a], sizes[others]), np.maximum(sizes[a], sizes[others])
        others = others[(100 * small >= percent * large) & (component[others] != component[a])]
        alike = (signatures[others] == signatures[a]).sum(1)
        near = alike >= HASHES * (percent / 100 - SLACK)
        others, alike = others[near], alike[near]
        if band and len(others):
            new = ~(bands[others, :band] == bands[a, :band]).any(1)
            others, alike = others[new], alike[new]
        if len(others):
            yield int(a), others, alike


def compare(group: pa.Table, width: int, percent: int) -> list[tuple[int, int]]:
    """Confirmed edges of one block, a forest over the components so far."""
    ids, component, packed = group["doc_id"].to_numpy(), group["component"].to_numpy(), group["packed"]
    sets: dict[int, frozenset] = {}
    unpack = zstandard.ZstdDecompressor().decompress

    def full(k: int) -> frozenset:
        if k not in sets:
            sets[k] = frozenset(shingles(unpack(packed[k].as_py()), width).tolist())
        return sets[k]

    forest, edges = Forest(), []
    pairs = [(-s, a, b) for a, others, alike in candidates(group, percent) for s, b in zip(alike.tolist(), others.tolist())]
    for _, a, b in sorted(pairs):
        if forest.find(int(component[a])) == forest.find(int(component[b])):
            continue
        common = len(full(a) & full(b))
        if 100 * common >= percent * (len(full(a)) + len(full(b)) - common):
            forest.join(int(component[a]), int(component[b]))
            edges.append((int(ids[a]), int(ids[b])))
    return edges


BLOCKS = ["band", "key", "kind", "i", "j"]
SIDES = "band int, key long, kind int, i int, j int, doc_id long, component long, is_left boolean, is_right boolean"


def _edges(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """rows: SIDES with the columns of signed. Confirmed edges (src, dst) within the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for group in contiguous(batches, BLOCKS):
            if len(group) > 1:
                found += compare(group, width, percent)
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["src", "dst"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["src", "dst"])

    return rows.repartition(*BLOCKS).sortWithinPartitions(*BLOCKS).mapInArrow(thrifty(run), "src long, dst long")


def _left_over(rows: DataFrame, percent: int) -> DataFrame:
    """rows: SIDES with the columns of signed but the texts. The rows of SIDES that have a pair left to confirm."""
    names = [f.split()[0] for f in SIDES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in contiguous(batches, BLOCKS):
            if len(group) > 1:
                paired = np.zeros(len(group), bool)
                for a, others, _ in candidates(group, percent):
                    paired[a] = paired[others] = True
                yield from group.select(names).filter(pa.array(paired)).combine_chunks().to_batches()

    return rows.repartition(*BLOCKS).sortWithinPartitions(*BLOCKS).mapInArrow(thrifty(run), SIDES)


def _smaller(left: DataFrame) -> DataFrame:
    """The blocks of signatures as blocks of at most about BLOCK rows a side."""
    at = ["band", "key", "kind", "i", "j"]
    sides = left.groupBy(*at).agg(*[F.greatest(F.lit(1), F.ceil(F.count(F.when(F.col(c), 1)) / BLOCK)).cast("int").alias(n) for c, n in (("is_left", "lefts"), ("is_right", "rights"))])
    same = (F.col("kind") == 2) & (F.col("i") == F.col("j"))
    hash_ = F.xxhash64("doc_id", F.lit(11))
    p, q = F.pmod(hash_, F.col("lefts").cast("long")).cast("int"), F.pmod(hash_, F.col("rights").cast("long")).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda a, b, x, y: F.struct(a.alias("a"), b.alias("b"), x.alias("x"), y.alias("y"))
    within = F.transform(each("lefts"), lambda o: place(F.least(p, o), F.greatest(p, o), p <= o, p >= o))
    as_left = F.transform(each("rights"), lambda o: place(p, o, F.lit(True), F.lit(False)))
    as_right = F.transform(each("lefts"), lambda o: place(o, q, F.lit(False), F.lit(True)))
    rows = left.join(sides, at).withColumn("at", F.explode(F.when(same, within).when(F.col("is_left"), as_left).otherwise(as_right)))
    # The parts' numbers go into i and j, which stay apart from those of other blocks.
    return rows.select("band", "key", "kind", (F.col("i") * 4096 + F.col("at.a")).alias("i"), (F.col("j") * 4096 + F.col("at.b")).alias("j"), "doc_id", "component", F.col("at.x").alias("is_left"), F.col("at.y").alias("is_right"))


def _across(members: DataFrame, component: DataFrame, signed: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Edges between members of buckets of several parts that are in different components (node, component) so far; None if none are."""
    component = component.withColumnRenamed("node", "doc_id")
    large = members.where(F.col("size") > BLOCK).join(component, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    counts = large.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    split = counts.groupBy("band", "key").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.count("*").alias("components"), (F.sum("n") - F.max("n")).alias("minor"), F.max("n").alias("major"))
    large = materialize(few(large.join(split.where("components > 1"), ["band", "key"]), members.count()), "large")
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / SIGNATURE_BLOCK).cast("int"))
    is_minor = F.col("component") != F.col("most")
    count = large.agg(F.sum(F.when(is_minor, parts("minor") + parts("major")).otherwise(parts("minor")))).first()[0]
    if not count:
        return None
    own = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.when(is_minor, parts("minor")).otherwise(parts("major")).cast("long")).cast("int")
    each = lambda n: F.sequence(F.lit(0), parts(n) - 1)
    block = lambda kind, i, j, left, right: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), left.alias("is_left"), right.alias("is_right"))
    yes, no, p = F.lit(True), F.lit(False), F.col("own")
    to_major = F.transform(each("major"), lambda j: block(1, p, j, yes, no))
    to_minor = F.transform(each("minor"), lambda q: block(2, F.least(p, q), F.greatest(p, q), p <= q, p >= q))
    from_major = F.transform(each("minor"), lambda i: block(1, i, p, no, yes))
    rows = large.withColumn("own", own).select("band", "key", "doc_id", "component", F.explode(F.when(is_minor, F.concat(to_major, to_minor)).otherwise(from_major)).alias("at"))
    rows = rows.select("band", "key", "at.kind", "at.i", "at.j", "doc_id", "component", "at.is_left", "at.is_right")
    left = _left_over(rows.join(signed.select("doc_id", "n_shingles", "bands", "signature"), "doc_id"), percent)
    left = materialize(few(left, count, TASK_ROWS), "left")
    found = _edges(_smaller(left).join(signed.select("doc_id", "n_shingles", "bands", "signature", "packed"), "doc_id"), width, percent)
    return materialize(few(found, left.count() * -(-SIGNATURE_BLOCK // BLOCK), TASK_ROWS), "links")


def links(classes: DataFrame, signed: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (src, dst) between classes (doc_id, bands), enough to join all that links join."""
    most = signed.count() * layout(percent)[0]
    banded = classes.select("doc_id", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("doc_id").alias("least"), F.bit_xor(F.xxhash64("doc_id")).alias("members"))
    kept = buckets.where("size > 1").groupBy("size", "least", "members").agg(F.min(F.struct("band", "key")).alias("bucket")).select("bucket.*", "size")
    members = materialize(few(banded.join(kept, ["band", "key"]), most), "buckets")
    count = members.count()
    signed = matching(signed, materialize(few(members.select("doc_id").distinct(), count), "members"), "doc_id")  # only they are compared
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    own = members.select("band", "key", F.pmod(F.xxhash64("doc_id", F.lit(7)), parts.cast("long")).cast("int").alias("i"), "doc_id")
    picked = [F.min_by("doc_id", F.xxhash64("doc_id", F.lit(100 + n))) for n in range(REPS)]
    reps = members.where(F.col("size") > BLOCK).groupBy("band", "key", "size").agg(F.array_distinct(F.array(*picked)).alias("reps"))
    reps = reps.select("band", "key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("i"), "reps").select("band", "key", "i", F.explode("reps").alias("doc_id"))
    rows = own.unionByName(reps).withColumns({"kind": F.lit(0), "j": F.col("i"), "component": F.col("doc_id"), "is_left": F.lit(True), "is_right": F.lit(True)})
    edges = _edges(rows.join(signed.select("doc_id", "n_shingles", "bands", "signature", "packed"), "doc_id"), width, percent)
    edges = materialize(few(edges, count, TASK_ROWS), "links")
    component = connected_components(edges, rows=edges.count())
    more = _across(members, component, signed, width, percent)
    stars = component.select(F.col("node").alias("src"), F.col("component").alias("dst"))
    return stars if more is None else stars.unionByName(more)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of docs with an id.

    Documents are linked whose shingle sets have a Jaccard similarity of at
    least percent/100; a component's smallest id is kept.
    """
    spark = prepare(docs.sparkSession)
    with scratch(spark) as keep:
        return keep(materialize(_grouped(docs, width, percent, doc_id, text), "near"))


def _grouped(docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    signed = materialize(sign(docs, doc_id, text, width, percent), "signed")
    classes = signed.where("n_shingles > 0").groupBy("fingerprint").agg(F.min("doc_id").alias("class"))
    keys = signed.select("doc_id", "fingerprint", "bands")  # the wide columns are joined only where they are compared
    first = keys.join(classes, "fingerprint").where("doc_id = class").select("doc_id", "bands")
    edges = links(first, signed, width, percent)
    component = connected_components(edges, rows=edges.count()).select(F.col("node").alias("class"), "component")
    whole = classes.join(component, "class", "left").select("fingerprint", F.coalesce("component", "class").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "fingerprint").join(whole, "fingerprint", "left")
    component_id = F.coalesce("component_id", "doc_id")
    return few(out.select("doc_id", "n_shingles", component_id.alias("component_id"), (F.col("doc_id") == component_id).alias("kept")), signed.count())
