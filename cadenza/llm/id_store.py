"""A content-addressed store of token ids.

A rolling hash over the last ids cuts each document's stream into chunks, so equal passages give equal chunks wherever
they stand. A chunk is stored once, its ids in the narrowest width that holds the vocabulary, and named by the SHA-256
of what is stored. A recipe lists the names and lengths of a document's chunks and has their Merkle root; recipes stand
in ascending doc_id order in range partitions, and the manifest has each partition's base, length and the Merkle root
over its recipes with their documents' ids. Below the store's path lie the Parquet folders ``objects/kind=chunk``, ``recipes`` and ``manifest``.

Reading verifies every chunk against its name, every recipe against its root, lengths against both, and each partition's
recipes against the manifest, so that a lost, added, exchanged or renamed one is found; a difference is an error. A null text is empty: its stream is the end id. Null ids come first; repeated rows are documents of
their own, in a fixed order. Other columns are ignored. An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .word_ids import WordEncoder

LEAST, MEAN, MOST = 64, 256, 1024
WINDOW = 4
#: Names of chunks a task remembers, some 100 bytes each. They only spare repeats the shuffle.
SEEN = 100_000
#: Stretches a task remembers, some 200 bytes each: nearly all of those in its share of a table.
STRETCHES = 600_000


def marks(ids: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """Places after ids at which the hash of the last WINDOW ids is divisible by ``mean``, a power of two."""
    with np.errstate(over="ignore"):
        each = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        each ^= each >> np.uint64(29)
        rolling, factor = each.copy(), np.uint64(1)
        for back in range(1, WINDOW):
            factor *= np.uint64(0x100000001B3)
            rolling[back:] += each[:-back] * factor
        rolling ^= rolling >> np.uint64(33)
    return np.flatnonzero((rolling & np.uint64(mean - 1)) == 0) + 1


def cuts(places: list[int], n: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of ``n`` ids: the marked places, but no chunk is shorter than ``least`` (the last may be) or
    longer than ``most``. As ``least`` exceeds the hash's window, what stands before a document can't move its cuts."""
    out, last = [], 0
    for cut in [*places, n]:
        while cut - last > most:
            last += most
            out.append(last)
        if cut - last >= least or cut == n:
            if cut > last:
                out.append(cut)
            last = cut
    return out


class Merkle:
    """A binary Merkle tree that grows by a leaf at a time and holds only the roots of its full parts, at most one of each
    height. Leaves and inner nodes are hashed with different prefixes."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height, node = 0, hashlib.sha256(b"\0" + leaf).digest()
        while self.parts and self.parts[-1][0] == height:
            node = hashlib.sha256(b"\1" + self.parts.pop()[1] + node).digest()
            height += 1
        self.parts.append((height, node))

    def root(self) -> bytes:
        if not self.parts:
            return hashlib.sha256(b"").digest()
        node = self.parts[-1][1]
        for _, before in reversed(self.parts[:-1]):
            node = hashlib.sha256(b"\1" + before + node).digest()
        return node


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree over ``leaves``."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


OBJECTS = "kind string, key binary, doc_id long, n long, payload binary"


WIDTHS = {2: np.dtype("<u2"), 4: np.dtype("<u4")}
ENTRY = np.dtype([("name", "V32"), ("n", "<u4")])


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = WordEncoder(path, STRETCHES)
        width, last_id = made.kind.itemsize, np.array([end], made.kind).tobytes()
        seen: set[bytes] = set()  # of this task: what is repeated here is seldom sent again
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                kind, key, doc_id, n, payload = [], [], [], [], []
                streams = [ids + last_id for ids in made.encode(batch.column(1).to_pylist())]
                places = marks(np.frombuffer(b"".join(streams), made.kind))
                starts = np.cumsum([0, *(len(s) // width for s in streams)])
                bounds = np.searchsorted(places, starts, "right")
                for i, (doc, ids) in enumerate(zip(batch.column(0).to_pylist(), streams, strict=True)):
                    own = (places[bounds[i] : bounds[i + 1]] - starts[i]).tolist()
                    last, names, recipe = 0, [], []
                    for cut in cuts(own, len(ids) // width):
                        chunk = ids[width * last : width * cut]
                        name = hashlib.sha256(chunk).digest()
                        names.append(name)
                        recipe.append(name + (cut - last).to_bytes(4, "little"))
                        if name not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(name)
                            kind.append("chunk")
                            key.append(name)
                            doc_id.append(None)
                            n.append(cut - last)
                            payload.append(chunk)
                        last = cut
                    kind.append("recipe")
                    key.append(merkle(names))
                    doc_id.append(doc)
                    n.append(len(ids) // width)
                    payload.append(b"".join(recipe))
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(key, pa.binary()), pa.array(doc_id, pa.int64()), pa.array(n, pa.int64()), pa.array(payload, pa.binary())], ["kind", "key", "doc_id", "n", "payload"])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops chunks of the same name as the one before; the partition has all those of a name, sorted."""
    last = None
    for batch in batches:
        keep = []
        for kind, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keep.append(kind != "chunk" or key != last)
            last = key if kind == "chunk" else last
        yield batch.filter(pa.array(keep, pa.bool_()))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the ids before each document in it."""
    from pyspark import TaskContext

    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        start = np.cumsum(n) - n + total
        total += int(n.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(n), pa.int32()), pa.array(start, pa.int64())], [*batch.schema.names, "part", "local_start"])


RECIPES = "doc_id long, n_tokens long, names binary, root binary"


def write(docs: DataFrame, store: str, path: str, end: int = 2) -> None:
    """Encode ``docs`` and write them to ``store``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    objects = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_encode(path, end), OBJECTS)
    # Recipes go anywhere, chunks to the partition of their name; the payload is shuffled and written once.
    spread = F.when(F.col("kind") == "chunk", F.xxhash64("key")).otherwise(F.xxhash64("doc_id", "key"))
    objects = objects.repartition(parts, spread).sortWithinPartitions("kind", "key").mapInArrow(_once, OBJECTS)
    objects.write.option("compression", "snappy").partitionBy("kind").parquet(f"{store}/objects")
    found = docs.sparkSession.read.schema(OBJECTS).parquet(f"{store}/objects").where("kind = 'recipe'")
    found = found.selectExpr("doc_id", "n n_tokens", "payload names", "key root")
    found = found.repartitionByRange(parts, "doc_id", "root").sortWithinPartitions("doc_id", "root").mapInArrow(_placed, f"{RECIPES}, part int, local_start long")
    recipes = written(found, f"{store}/recipes", compression="zstd")
    totals, base = [], 0
    for part, n_docs, n_tokens, root in sums(recipes):
        totals.append((part, base, n_docs, n_tokens, root))
        base += n_tokens
    docs.sparkSession.createDataFrame(totals, MANIFEST).coalesce(1).write.parquet(f"{store}/manifest")


MANIFEST = "part int, base long, n_docs long, n_tokens long, root binary"


def sums(recipes: DataFrame) -> list[tuple[int, int, int, bytes]]:
    """Of each partition, in order: its number, documents, ids, and the Merkle root over its recipes in their order."""
    parts = int(recipes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = recipes.select("part", "local_start", "doc_id", "n_tokens", "root").repartition(parts, "part").sortWithinPartitions("part", "local_start")
    return [(r[0], r[1], r[2], bytes(r[3])) for r in rows.mapInArrow(_roots, "part int, n_docs long, n_tokens long, root binary").orderBy("part").collect()]


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n_docs, n_tokens, tree = None, 0, 0, Merkle()
    told = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n_docs]), pa.array([n_tokens]), pa.array([tree.root()], pa.binary())], ["part", "n_docs", "n_tokens", "root"])
    for batch in batches:
        for now, start, doc, n, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != part:
                if n_docs:
                    yield told()
                part, n_docs, n_tokens, tree = now, 0, 0, Merkle()
            if start != n_tokens:
                raise ValueError(f"partition {now} of the recipes has a gap or a repeat at {start}")
            tree.add(f"{doc},{n},".encode() + root)
            n_docs, n_tokens = n_docs + 1, n_tokens + n
    if n_docs:
        yield told()


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads chunks: compares each with its name and takes the CRC-32 of its ids as 32-bit numbers."""
    for batch in batches:
        crc = []
        for name, n, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if hashlib.sha256(payload).digest() != name:
                raise ValueError(f"chunk {name.hex()} is damaged")
            crc.append(zlib.crc32(np.frombuffer(payload, WIDTHS[len(payload) // n]).astype(np.uint32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crc, pa.int64())], ["name", "n", "crc"])


ENTRIES = "doc_id long, start long, n_tokens long, name binary, n long, after long"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads recipes: compares each with its Merkle root and gives a row per chunk, with the number of ids after it."""
    for batch in batches:
        many, names, n, after = [], [], [], []
        for recipe, root, total in zip(*(batch.column(i).to_pylist() for i in (3, 4, 2)), strict=True):
            own = [recipe[i : i + 32] for i in range(0, len(recipe), 36)]
            size = np.frombuffer(recipe, ENTRY)["n"].astype(np.int64)
            if merkle(own) != root or size.sum() != total:
                raise ValueError(f"recipe {root.hex()} doesn't hold")
            many.append(len(own))
            names += own
            n.append(size)
            after.append(total - np.cumsum(size))
        if many:
            rows = pa.array(np.repeat(np.arange(len(many)), many))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(3)), pa.array(names, pa.binary()), pa.array(np.concatenate(n)), pa.array(np.concatenate(after))], ["doc_id", "start", "n_tokens", "name", "n", "after"])


def _powers() -> np.ndarray:
    """Row k, as four tables of 256: what 4 * 2**k zero bytes make of a CRC-32."""

    def times(m: list[int], v: int) -> int:
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v, i = v >> 1, i + 1
        return out

    matrix = [0xEDB88320, *(1 << i for i in range(31))]  # one bit
    tables = []
    for step in range(5 + 32):
        if step >= 5:  # 32 bits, then twice as many each time
            tables.append([[times(matrix, byte << 8 * place) for byte in range(256)] for place in range(4)])
        matrix = [times(matrix, x) for x in matrix]
    return np.array(tables, np.uint32)


def shift_crc(crc: np.ndarray, after: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The share that a part's CRC-32 has in that of a whole with ``after`` 32-bit numbers behind the part. The whole's
    CRC-32 is the exclusive or of all shares. ``tables`` are :func:`_powers`."""
    crc, after = crc.astype(np.uint32), after.astype(np.int64)
    for k in range(int(after.max(initial=0)).bit_length()):
        t = tables[k]
        moved = t[0][crc & 255] ^ t[1][crc >> 8 & 255] ^ t[2][crc >> 16 & 255] ^ t[3][crc >> 24]
        crc = np.where(after >> k & 1, moved, crc)
    return crc


def _shares(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = shift_crc(batch.column(4).to_numpy(), batch.column(5).to_numpy(), tables.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(share.astype(np.int64))], ["doc_id", "start", "n_tokens", "n", "share"])

    return run


def _tables(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    chunks = spark.read.schema(OBJECTS).parquet(f"{store}/objects").where("kind = 'chunk'").select(F.col("key").alias("name"), "n", "payload")
    manifest = [tuple(r) for r in spark.read.schema(MANIFEST).parquet(f"{store}/manifest").orderBy("part").collect()]
    found = sums(spark.read.parquet(f"{store}/recipes"))
    if [(part, n_docs, n_tokens, bytes(root)) for part, _, n_docs, n_tokens, root in manifest] != found:
        raise ValueError("the recipes are not those of the manifest")
    base = {part: before for part, before, *_ in manifest}
    # A row per partition of the recipes, so as a map in the plan.
    at = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])[F.col("part")] if base else F.lit(0)
    recipes = spark.read.parquet(f"{store}/recipes").withColumn("start", F.col("local_start") + at.cast("long"))
    return chunks, recipes


def _listed(recipes: DataFrame) -> DataFrame:
    return recipes.select("doc_id", "start", "n_tokens", "names", "root").mapInArrow(_entries, ENTRIES)


def summaries(spark: SparkSession, store: str) -> DataFrame:
    """Per document of the store: doc_id, start, n_tokens, and the CRC-32 of its ids, from the verified files.

    Chunks are read and verified once each; a document's CRC follows from those of its chunks and their places in its
    recipe, so payloads need not move again. A chunk of very many documents makes a skewed join side, which adaptive
    execution splits.
    """
    chunks, recipes = _tables(spark, store)
    checked = chunks.mapInArrow(_check, "name binary, n long, crc long").select("name", F.col("n").alias("there"), "crc")
    found = _listed(recipes).join(checked, "name", "left").select("doc_id", "start", "n_tokens", _same("n", "there").alias("n"), "crc", "after")
    shares = found.mapInArrow(_shares(spark.sparkContext.broadcast(_powers())), "doc_id long, start long, n_tokens long, n long, share long")
    whole = shares.groupBy("doc_id", "start", "n_tokens").agg(F.sum("n").alias("n"), F.bit_xor("share").alias("ids_crc32"))
    return whole.select("doc_id", "start", _same("n_tokens", "n").alias("n_tokens"), "ids_crc32")


def _same(a: str, b: str):
    return F.when(F.col(a) == F.col(b), F.col(a)).otherwise(F.raise_error(F.lit("the store lacks a chunk or has one of another length")).cast("long"))


def read(spark: SparkSession, store: str) -> DataFrame:
    """The documents of the store again: doc_id, start, ids (little-endian unsigned 32-bit)."""
    chunks, recipes = _tables(spark, store)
    parts = _listed(recipes).join(chunks.drop("n"), "name", "left").groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("after", "n", "payload")), asc=False).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [b"".join(np.frombuffer(p["payload"], f"<u{len(p['payload']) // p['n']}").astype("<u4").tobytes() for p in parts) for parts in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    return parts.mapInArrow(joined, "doc_id long, start long, ids binary")
