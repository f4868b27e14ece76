"""Exact n-gram Jaccard join in the metric space of shingle sets (distance: 1 - similarity).

A document's set is that of its distinct five-word shingles, as 64-bit hashes. Two documents link at a similarity of
0.8 or more, that is within a distance of 0.2. Equal sets are one point of the space, with one 64-bit name.

* **Islands.** Most documents are at distance 1 from each other, where no pivot tells them apart. So all shingles are
  ordered by how many documents hold them, rarest first (each shingle is counted by itself, and two bounded tables tell
  its class; counts by hashed buckets decide within one; the order only has to be the same for all). Documents within 0.2 share one of the first ``n - ceil(0.8 n) + 1`` shingles of each, and
  what follows the first common one in either is enough for the overlap. Each such shingle is a cell; one pass over a
  cell's documents by size finds a forest of those that meet this bound, and the components of all forests together are
  islands, with no link between two of them.
* **Voronoi regions.** An island too large for one task gets pivots. Each document is assigned to the region of its
  nearest pivot and, by the triangle inequality, replicated to every region whose pivot is at most 2 * 0.2 farther.
  Documents within 0.2 of a pivot link to it. Regions whose documents have become one component are settled; the
  others are regions of the next round. Where windows reach nearly everything, as within a family whose members are all
  about 0.3 apart, the region is joined by pairs of blocks instead.
* **Join.** A region or pair of blocks that fits a task is joined there exactly: by sizes, by windows on the distances to
  a few pivots, then by the sets themselves. Pairs that are connected already aren't compared, and a task gives a forest
  of the links it finds, so no list of pairs arises.

Lower-cases A-Z only; words are runs of anything but ``\\x20`` and ``\\x09`` to ``\\x0D``. With fewer than five words the
whole sequence is the one shingle. Null and empty texts have no shingles and link with nothing. Each input row gives
one row; rows of the same doc_id are copies or different documents by their texts. A null doc_id stays null and is a
component's id only if all of its documents have none. Other columns are ignored. What is sent to the driver is bounded:
two bytes for each of 2**20 buckets, tables of 96 MB at most that say which shingles recur, and counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, shared_dir, sliced, written

WORDS = 5
#: Buckets by which shingles are counted: 2**BITS, in blocks of BLOCK. A task sends four bytes for each.
BITS, BLOCK = 20, 4096
SIGNED = "doc_id long, key long, n long, sig long, block int, counts binary"
#: Half of a window; distances are quotients of whole numbers, and the last part only keeps rounding from closing one.
REACH = 0.2 + 1e-9
#: Cells of buckets with so many documents (eight times the logarithm) are not gathered: all they hold is one island.
HOT = 8 * 20
#: Ranks of buckets are logarithms in such parts of an eighth. Coarser ones, of eighths, put a shingle of a hundred
#: documents among the unique ones where buckets hold a thousand, and chance neighbours then join most islands.
FINE = 256
#: Shingles are counted as numbers of so many bits, in ranges of equal width; a task sends some two bytes for each, sorted
#: in parts of PACK. By the buckets alone, at some gigabytes a shingle of fifty documents passes for a unique one, and
#: chance neighbours join most documents to one island.
PLACES, RANGES, PACK = 36, 1024, 4_000_000
#: Least and most bits of the table of recurring shingles; there are as many as half the shingles if that lies between.
LEAST_BITS, MOST_BITS = 20, 29
#: Classes of shingles: those not known to recur, then those in so many documents at least.
CLASSES = np.array([2, 3, 4, 5, 6, 7, 9, 12, 16, 24, 40, 80, 160, 500, 2000])
#: Most rows of a broadcast side, three long numbers each. More are joined in slices of so many, at most SLICES; beyond
#: that the same join is a shuffled one, which moves all texts.
FEW, SLICES = 500_000, 16
#: How often large islands are divided anew, as long as that frees a tenth of their documents.
AGAIN = 4


def shingles(text: bytes | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    import xxhash

    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(size, n)
    out = np.full(n - size + 1, 0x9E3779B97F4A7C15 + size, np.uint64)
    for j in range(size):
        out ^= each[j : j + len(out)]
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(31)
    return np.unique(out)


def name_of(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def bucket(found: np.ndarray, level: int = 0) -> np.ndarray:
    """Buckets of shingles; those of one do not stay together on another level."""
    return (mixed(found, level) >> np.uint64(64 - BITS)).astype(np.int64)


def mixed(found: np.ndarray, level: int) -> np.ndarray:
    return (found ^ (found >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15 + 2 * level) if level else found


def coded(numbers: np.ndarray) -> bytes:
    """Sorted numbers below 2**32, as differences in two bytes each or, where that is longer, in four bytes each."""
    step = np.diff(numbers, prepend=0)
    over = step // 65_535
    if 2 * (len(step) + int(over.sum())) > 4 * len(step):
        return b"4" + numbers.astype(np.uint32).tobytes()
    at = np.cumsum(over + 1) - 1
    out = np.full(int(at[-1]) + 1, 65_535, np.uint16)  # which only moves on
    out[at] = step - 65_535 * over
    return b"2" + out.tobytes()


def decoded(code: bytes) -> np.ndarray:
    if code[:1] == b"4":
        return np.frombuffer(code, np.uint32, offset=1).astype(np.int64)
    step = np.frombuffer(code, np.uint16, offset=1)
    return np.cumsum(step, dtype=np.int64)[step < 65_535]


def _packed(found: list[np.ndarray], level: int) -> pa.RecordBatch:
    """The numbers of shingles, range by range."""
    width = PLACES - (RANGES - 1).bit_length()
    number = (mixed(np.concatenate(found), level) >> np.uint64(64 - PLACES)).astype(np.int64)
    number.sort()
    ends = np.searchsorted(number, np.arange(RANGES + 1, dtype=np.int64) << width).tolist()
    rows = [(k, coded(number[a:b] - (k << width))) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], ["part", "codes"])


def _numbered(level: int):
    """The numbers of all shingles of some documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in sliced(batches, 256):
            for text in batch.column(0).to_pylist():
                held.append(shingles(text))
                n += len(held[-1])
                if n >= PACK:
                    yield _packed(held, level)
                    held, n = [], 0
        if n:
            yield _packed(held, level)

    return run


def _recurring(bits: int):
    """Of each range, a bit for each place of the first table: some shingle there is in two documents or more; and half a
    byte for each of the second, with an eighth of the places: the highest class of the shingles in three or more."""
    own = (1 << bits) // RANGES

    def tables(part: int, held: list[np.ndarray]) -> pa.RecordBatch:
        number, n = np.unique(np.concatenate(held), return_counts=True)
        number, n = number[n > 1], n[n > 1]
        place = number >> (PLACES - bits)
        once = np.zeros(own, bool)
        once[place] = True
        kind = np.zeros(own >> 3, np.uint8)
        np.maximum.at(kind, place[n > 2] >> 3, np.searchsorted(CLASSES, n[n > 2], "right").astype(np.uint8))
        many = np.packbits(once, bitorder="little").tobytes(), (kind[::2] | kind[1::2] << 4).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([m], pa.binary()) for m in many)], ["part", "recurs", "kinds"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = -1, []
        for batch in batches:
            for k, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != part and held:
                    yield tables(part, held)
                    held = []
                part = k
                held.append(decoded(code))
        if held:
            yield tables(part, held)

    return run


def classes(found: np.ndarray, level: int, bits: int, recurs: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """0 of shingles that do not recur, else one of CLASSES; too high a one where shingles share a place."""
    place = (mixed(found, level) >> np.uint64(64 - bits)).astype(np.int64)
    again = (recurs[place >> 3] >> (place & 7).astype(np.uint8)) & 1
    kind = (kinds[place >> 4] >> (4 * (place >> 3 & 1)).astype(np.uint8)) & 15
    return np.where(again, np.maximum(kind, 1), 0).astype(np.int64)


def _blocks_of(counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Numbers and counts of the blocks that aren't empty."""
    blocks = [(b, c.tobytes()) for b, c in enumerate(counts.reshape(-1, BLOCK)) if c.any()]
    return pa.array([b for b, _ in blocks], pa.int32()), pa.array([c for _, c in blocks], pa.binary())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and name of each document's set; at the end, in rows of their own, how many documents fill each bucket."""
    counts = np.zeros(1 << BITS, np.uint32)
    names = ["doc_id", "key", "n", "sig", "block", "counts"]
    for batch in sliced(batches):
        size, sig = [], []
        for text in batch.column(2).to_pylist():
            found = shingles(text)
            size.append(len(found))
            sig.append(name_of(found) if len(found) else None)
            np.add.at(counts, bucket(found), 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(sig, pa.int64()), pa.nulls(len(size), pa.int32()), pa.nulls(len(size), pa.binary())], names)
    block, held = _blocks_of(counts)
    if len(block):
        none = pa.nulls(len(block), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, block, held], names)


def _counted(level: int):
    """How many of some documents fill each bucket of a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, np.uint32)
        for batch in sliced(batches, 256):
            for text in batch.column(0).to_pylist():
                np.add.at(counts, bucket(shingles(text), level), 1)
        yield pa.RecordBatch.from_arrays([*_blocks_of(counts)], ["block", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the counts of each block and turns them into two-byte ranks."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            more = np.frombuffer(counts, np.uint32).astype(np.int64)
            total[block] = total[block] + more if block in total else more
    if total:
        ranks = [np.minimum(65_535, 8 * FINE * np.log2(1 + t)).astype(np.uint16).tobytes() for t in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(ranks, pa.binary())], ["block", "ranks"])


def _cells(ranks, hot: int, level: int = 0):
    """A row per document and cell: the cell, the document, its size and the place of the shingle in its order. Of a hot
    cell the two are exchanged and the place is -1: an edge already, dealt out by its document. Regions have cells of
    their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked, bits, *tables = ranks.value
        order, (recurs, kinds) = np.frombuffer(ranked, np.uint16), (np.frombuffer(t, np.uint8) for t in tables)
        last = None
        for batch in sliced(batches, 256):
            cells, points, places = [], [], []
            for text, region in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text == last:
                    continue
                last, found = text, shingles(text)
                n = len(found)
                if not n:
                    continue
                rank = order[bucket(found, level)]
                rare = classes(found, level, bits, recurs, kinds) << 16 | rank
                first = np.argsort(rare, kind="stable")[: n - (4 * n + 4) // 5 + 1]
                cell, common = found[first].view(np.int64) ^ np.int64(region), rank[first] >= FINE * hot
                point = np.full(len(first), name_of(found), np.int64)
                cells.append(np.where(common, point, cell))
                points.append(np.where(common, cell, point))
                places.append(np.where(common, -1, (n << 32) + np.arange(len(first), dtype=np.int64)))
            if cells:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (cells, points, places)], ["cell", "v", "at"])

    return run


def forest(cell: np.ndarray, v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, cell by cell, the documents that may be within 0.2; rows are sorted by cell and size.

    A document of n shingles with the cell's at place i overlaps another by at most ``n - i``, so the other has at most
    ``top = (5 n - 9 i) / 4`` shingles. Two fit if each one's size is at most the other's top. The smaller of a pair that
    fits has a top of at least its own size: such documents are intervals from size to top, which fit where they
    overlap, and a running maximum of tops connects them. Any other document fits only intervals that reach from its
    top to its size; all of those overlap, so one edge does.
    """
    n, i = at >> 32, at & 0xFFFFFFFF
    top = np.maximum(0, (5 * n - 9 * i) // 4)
    group = np.cumsum(np.r_[False, cell[1:] != cell[:-1]]).astype(np.int64) << 32  # tops stay below those of later cells
    low, high = group + n, group + top
    own = np.flatnonzero(top >= n)
    if not len(own):
        return v[:0], v[:0]
    most = np.maximum.accumulate(high[own])
    by = np.maximum.accumulate(np.where(high[own] == most, np.arange(len(own)), 0))
    k = np.flatnonzero(most[:-1] >= low[own[1:]])
    other = np.flatnonzero(top < n)
    place = np.searchsorted(low[own], high[other], "right") - 1
    fits = (place >= 0) & (most[place] >= low[other])
    a = np.concatenate([v[own[k + 1]], v[other[fits]]])
    b = np.concatenate([v[own[by[k]]], v[own[by[place[fits]]]]])
    return a[a != b], b[a != b]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forests of a partition that is sorted by cell, size and place."""
    held = [np.empty(0, np.int64)] * 3
    out = lambda u, v: pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
    for batch in batches:
        rows = [batch.column(k).to_numpy() for k in range(3)]
        edge = rows[2] < 0
        if edge.any():
            yield out(rows[0][edge], rows[1][edge])
            rows = [x[~edge] for x in rows]
        held = [np.concatenate([a, b]) for a, b in zip(held, rows, strict=True)]
        if len(held[0]):
            whole = int(np.searchsorted(held[0] == held[0][-1], True))
            if whole:
                yield out(*forest(*(x[:whole] for x in held)))
                held = [x[whole:].copy() for x in held]
    if len(held[0]):
        yield out(*forest(*held))


class Sets:
    """Documents of one region in the order of their sizes, their shingles numbered within the region."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n = np.array([len(s) for s in sets])
        self.ends = np.cumsum(self.n)
        self.starts = self.ends - self.n
        self.codes = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        self.held = np.zeros(int(self.codes.max()) + 1, bool)

    def common(self, one: int, others: np.ndarray) -> np.ndarray:
        """How many shingles of ``one`` each of ``others`` holds."""
        own = self.codes[self.starts[one] : self.ends[one]]
        self.held[own] = True
        if others[-1] - others[0] + 1 == len(others):
            codes = self.codes[self.starts[others[0]] : self.ends[others[-1]]]
        else:
            codes = np.concatenate([self.codes[self.starts[k] : self.ends[k]] for k in others.tolist()])
        found = np.add.reduceat(self.held[codes], np.cumsum(self.n[others]) - self.n[others], dtype=np.int64)
        self.held[own] = False
        return found


def distance(common, a, b):
    return 1 - common / (a + b - common)


def links_in(sets: list[np.ndarray], label: np.ndarray, home: np.ndarray, pivots: int = 4) -> list[tuple[int, int]]:
    """A forest of the links among documents sorted by size, beside what ``label`` connects already. Of each pair one at
    least must be at ``home``."""
    found, m = Sets(sets), len(sets)
    label, out = label.copy(), []

    def unite(one: int, others: np.ndarray) -> None:
        for k in others.tolist():
            if label[k] != label[one]:
                out.append((one, k))
                label[label == label[k]] = label[one]

    far = []
    for one in np.linspace(0, m - 1, pivots).astype(int).tolist() if m > 16 * pivots else []:
        everything = np.arange(m)
        common = found.common(one, everything)
        far.append(distance(common, found.n[one], found.n))
        unite(one, everything[5 * common >= 4 * (found.n[one] + found.n - common)])
    last = np.searchsorted(4 * found.n, 5 * found.n, "right")
    for one in range(m - 1):
        others = np.arange(one + 1, last[one])
        others = others[(label[others] != label[one]) & (home[others] | home[one])]
        for d in far:
            others = others[np.abs(d[others] - d[one]) <= REACH]
        if len(others):
            common = found.common(one, others)
            unite(one, others[5 * common >= 4 * (found.n[one] + found.n[others] - common)])
    return out


def _groups(batches: Iterator[pa.RecordBatch], key: list[int]) -> Iterator[list[list]]:
    """Columns, as lists, of the rows of one key after the other; the partition is sorted by it."""
    held: list[list] | None = None
    for batch in sliced(batches, 256):
        rows = [c.to_pylist() for c in batch.columns]
        at = 0
        while at < len(batch):
            here = [rows[k][at] for k in key]
            end = at + 1
            while end < len(batch) and all(rows[k][end] == x for k, x in zip(key, here, strict=True)):
                end += 1
            part = [c[at:end] for c in rows]
            if held is not None and [held[k][0] for k in key] == here:
                for a, b in zip(held, part, strict=True):
                    a += b
            else:
                if held is not None:
                    yield held
                held = part
            at = end
    if held is not None:
        yield held


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each region or pair of blocks: region, pair, v, component, home, text."""
    for _, _, v, component, home, text in _groups(batches, [0, 1]):
        once = list({x: k for k, x in enumerate(v)}.values())
        sets = [shingles(text[k]) for k in once]
        by_size = sorted(range(len(once)), key=lambda k: len(sets[k]))
        once, sets = [once[k] for k in by_size], [sets[k] for k in by_size]
        label = np.unique([component[k] for k in once], return_inverse=True)[1]
        if len(once) > 1 and label.any():
            found = links_in(sets, label, np.array([home[k] for k in once]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([v[once[a]] for a, _ in found], pa.int64()), pa.array([v[once[b]] for _, b in found], pa.int64())], ["u", "v"])


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The regions of each document: region, salt, pivot (first, as whole texts), v, text."""
    names = ["parent", "region", "v", "home", "linked"]
    key, pivots, parity = None, [], []
    for batch in sliced(batches, 256):
        out = [[], [], [], [], []]
        for region, salt, other, v, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (region, salt) != key:
                key, pivots, parity = (region, salt), [], []
            own = shingles(text)
            if not other:
                if v not in parity:
                    pivots.append(own)
                    parity.append(v)
                continue
            common = np.array([len(np.intersect1d(own, p, assume_unique=True)) for p in pivots])
            far = distance(common, len(own), np.array([len(p) for p in pivots]))
            nearest = int(far.argmin())
            for k in np.flatnonzero(far <= far[nearest] + 2 * REACH).tolist():
                both = len(own) + len(pivots[k])
                for column, x in zip(out, (region, parity[k], v, k == nearest, bool(5 * common[k] >= 4 * (both - common[k]))), strict=True):
                    column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


class _Space:
    """The points of a corpus and the tables that join them."""

    def __init__(self, docs: DataFrame, most: int, size: int, pivots: int, hot: int) -> None:
        self.spark, self.most, self.size, self.pivots, self.hot = docs.sparkSession, most, size, pivots, hot
        self.base = shared_dir(self.spark, "jaccard")
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.docs = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(cast(text as string)) key", "cast(cast(text as string) as binary) text")
        self.signed = written(self.docs.mapInArrow(_sign, SIGNED), f"{self.base}/signed")
        # Of equal sets the row with the smallest id stands for all; its text is found again by id and hash.
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")).alias("first")
        self.points = written(self.signed.where("sig is not null").groupBy(F.col("sig").alias("v")).agg(F.max("n").alias("n"), first).selectExpr("v", "n", "first.doc_id rep", "first.key key"), f"{self.base}/points")

    def _ranks(self, blocks: DataFrame) -> bytes:
        ranks = np.zeros(1 << BITS, np.uint16)
        for row in blocks.repartition(self.parts, "block").mapInArrow(_summed, "block int, ranks binary").toLocalIterator():
            ranks[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["ranks"], np.uint16)
        return ranks.tobytes()

    def _tables(self, texts: DataFrame, n: int, level: int) -> tuple[int, bytearray, bytearray]:
        """The tables of shingles that recur in ``texts``, which have ``n`` shingles, and the bits of the first one."""
        bits = min(MOST_BITS, max(LEAST_BITS, (n // 2).bit_length()))
        packed = texts.select("text").mapInArrow(_numbered(level), "part int, codes binary").repartition(self.parts, "part").sortWithinPartitions("part")
        found = written(packed.mapInArrow(_recurring(bits), "part int, recurs binary, kinds binary"), f"{self.base}/recurring{level}")
        tables = bytearray(1 << bits - 3), bytearray(1 << bits - 4)
        for row in found.toLocalIterator():
            for table, own in zip(tables, (row["recurs"], row["kinds"]), strict=True):
                table[row["part"] * len(own) : (row["part"] + 1) * len(own)] = own
        return bits, *tables

    def _islands(self, texts: DataFrame, blocks: DataFrame, n: int, level: int) -> DataFrame:
        """region, v, n of the documents that share an island with others; ``texts`` has text and the region before."""
        ranks = self.spark.sparkContext.broadcast((self._ranks(blocks), *self._tables(texts, n, level)))
        cells = texts.mapInArrow(_cells(ranks, self.hot, level), "cell long, v long, at long")
        edges = cells.repartition(self.parts, "cell").sortWithinPartitions("cell", "at", "v").mapInArrow(_edges, "u long, v long")
        edges = written(edges.distinct(), f"{self.base}/edges{level}")
        ranks.destroy()
        of = components(edges, "jaccard-islands")
        return written(of.select(F.col("component").alias("region"), F.col("id").alias("v")).join(self.points.select("v", "n"), "v").select("region", "v", "n"), f"{self.base}/islands{level}")

    def islands(self) -> DataFrame:
        """region, v, n. An island of more than three blocks is mostly chance neighbours in a row, so its documents are
        ordered anew by counts among such documents alone, in other buckets; what is within 0.2 stays together."""
        found = self._islands(self.docs.select("text", F.lit(0).cast("long").alias("region")), self.signed.where("block is not null").select("block", "counts"), self.signed.agg(F.sum("n")).first()[0] or 0, 0)
        before = None
        for level in range(1, AGAIN + 1):
            large = self.sizes(found).where("blocks > 3").select("region")
            rows = found.join(large, "region").select("region", "v")
            n, total = rows.join(self.points.select("v", "n"), "v").agg(F.count("*"), F.sum("n")).first()
            if not n or (before is not None and n > 0.9 * before):
                break
            before, texts = n, self.with_text(rows).select("text", "region")
            finer = self._islands(texts, texts.mapInArrow(_counted(level), "block int, counts binary"), total, level)
            found = found.join(large, "region", "left_anti").select("region", "v", "n").unionByName(finer)
        return found

    def with_text(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the text of their point ``v``."""
        side, docs = rows.join(self.points.select("v", "rep", "key"), "v").withColumnRenamed("key", "_key"), self.docs
        slices = -(-rows.count() // FEW)
        if slices > SLICES:
            parts = [side]
        else:
            parts = [F.broadcast(side.where(F.expr(f"pmod(xxhash64(v, 3), {slices}) = {k}") if slices > 1 else F.lit(True))) for k in range(max(1, slices))]
        return self._all([docs.join(p, (docs["key"] == p["_key"]) & docs["doc_id"].eqNullSafe(p["rep"])).select(*rows.columns, "text") for p in parts])

    def sizes(self, rows: DataFrame) -> DataFrame:
        """Blocks that each region takes, and the number of its documents."""
        found = rows.groupBy("region").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.min("v").alias("least"))
        return found.where("m > 1").selectExpr("region", "m", "least", f"cast(greatest(ceil(m / {self.most}), ceil(total / {self.size})) as int) blocks")

    def blocks(self, rows: DataFrame) -> DataFrame:
        """Links within regions: each pair of a region's blocks meets in one task."""
        own = F.expr("cast(pmod(xxhash64(v, 7), blocks) as int)")
        # One task for a region of one block; else one for each pair of them, a document going to those of its own block.
        pair = F.expr("transform(sequence(0, blocks - 1), x -> least(x, own) * blocks + greatest(x, own))")
        dealt = rows.withColumn("own", own).withColumn("pair", F.explode(pair)).select("region", "pair", "v", "component", "home")
        dealt = self.with_text(dealt).repartition(self.parts, "region", "pair").sortWithinPartitions("region", "pair")
        return dealt.select("region", "pair", "v", "component", "home", "text").mapInArrow(_joined, "u long, v long")

    def voronoi(self, rows: DataFrame, level: int) -> DataFrame:
        """parent, region, v, home, linked: the regions of new pivots that each document of a large region belongs to."""
        chosen = F.expr(f"v = least or pmod(xxhash64(v, {level}), m) < {self.pivots}")
        salts = F.expr(f"cast(ceil(m / {4 * self.most}) as int)")
        dealt = rows.withColumn("salts", salts).withColumn("own", F.expr("cast(pmod(xxhash64(v, 11), salts) as int)"))
        members = dealt.select("region", F.col("own").alias("salt"), F.lit(True).alias("other"), "v")
        pivots = dealt.where(chosen).select("region", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.lit(False).alias("other"), "v")
        both = self.with_text(members.unionByName(pivots)).repartition(self.parts, "region", "salt").sortWithinPartitions("region", "salt", "other", "v")
        return both.select("region", "salt", "other", "v", "text").mapInArrow(_assigned, "parent long, region long, v long, home boolean, linked boolean")

    def links(self) -> DataFrame:
        """A forest of links, as u and v."""
        rows = self.islands().withColumn("home", F.lit(True))
        known, links, level = None, [], 0
        while True:
            level += 1
            component = F.col("v")
            if known is not None:
                rows, component = rows.join(known.withColumnRenamed("id", "v"), "v", "left"), F.coalesce("component", "v")
            rows = rows.select("region", "v", "n", "home", component.alias("component"))
            sized = written(rows.join(self.sizes(rows), "region"), f"{self.base}/sized{level}")
            if known is not None:  # regions of one component are settled
                mixed = sized.groupBy("region").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("region")
                sized = sized.join(mixed, "region")
            links.append(written(self.blocks(sized.where("blocks <= 3")), f"{self.base}/links{level}"))
            large = sized.where("blocks > 3")
            if large.isEmpty():
                break
            parts = written(self.voronoi(large, level), f"{self.base}/voronoi{level}")
            near = parts.where("linked and v <> region").select(F.col("v").alias("u"), F.col("region").alias("v"))
            links.append(near)
            known = components(self._all(links), "jaccard-links")
            # Where windows reach so far that regions don't shrink, blocks of the parent are joined.
            spread = parts.groupBy("parent").agg((F.count("*") / F.count_if("home")).alias("spread"), F.countDistinct("region").alias("regions"))
            split = spread.where("spread <= 4 and regions > 1").select(F.col("parent").alias("region"))
            dense = large.join(split, "region", "left_anti").drop("component").join(known.withColumnRenamed("id", "v"), "v", "left")
            dense = dense.withColumn("component", F.coalesce("component", "v"))
            mixed = dense.groupBy("region").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("region")
            links.append(written(self.blocks(dense.join(mixed, "region")), f"{self.base}/dense{level}"))
            rows = parts.join(split.withColumnRenamed("region", "parent"), "parent", "left_semi").select("region", "v", "home").join(self.points.select("v", "n"), "v")
        return self._all(links)

    @staticmethod
    def _all(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def components(self) -> DataFrame:
        """v, component (the smallest v), component_id (the smallest doc_id)."""
        known = components(self.links(), "jaccard-components")
        of = self.points.join(known.withColumnRenamed("id", "v"), "v", "left").select("v", "rep", F.coalesce("component", "v").alias("component"))
        return of.join(of.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("v", "component", "component_id")


def space(docs: DataFrame, most: int = 1024, size: int = 2_000_000, pivots: int = 16, hot: int = HOT) -> _Space:
    """``most`` documents and ``size`` shingles are joined in one task; a larger region takes blocks or ``pivots``."""
    return _Space(docs, most, size, pivots, hot)


def link(docs: DataFrame, **sizes: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    made = space(docs, **sizes)
    of = made.components().select(F.col("v").alias("sig"), "component_id")
    empty = made.signed.where("sig is null and block is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return made.signed.where("sig is not null").join(of, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component stays: that with its smallest doc_id and, of several with this, the first by the name of
    its set, then by its text. Rows without shingles are components of their own; of equal rows of one id one stays."""
    made = space(docs)
    of = made.components().withColumnRenamed("v", "sig")
    rows = made.signed.where("block is null").join(of, "sig", "left").select("doc_id", "sig", "key", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component")
    rows = rows.where("doc_id <=> component_id").groupBy("doc_id", "component").agg(F.min(F.struct("sig", "key")).alias("first"))
    kept = rows.select(F.col("doc_id").alias("_kept"), F.col("first.key").alias("_key")).distinct()
    key = F.xxhash64(F.col("text").cast("string"))
    once = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]) & (key == kept["_key"]), "left_semi")
    # Only ids that occur more than once can leave equal rows.
    many = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_many"))
    return once.join(many, once["doc_id"].eqNullSafe(many["_many"]), "left_anti").unionByName(once.join(many, once["doc_id"].eqNullSafe(many["_many"]), "left_semi").dropDuplicates(["doc_id", "text"]))
