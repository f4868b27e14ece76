"""Best-fit packing in bulk-synchronous rounds.

Documents become pieces of at most ``size`` tokens. A round takes the longest pieces left, down to two thirds of the
longest, and the gaps of open sequences that hold any of them. Both are range-sorted together, longest first and gaps
before pieces of their length; a gap that holds the longest piece several times counts as so many places. Every
partition sweeps over its own rows and gives each piece its successor, the smallest place before it that no earlier
piece has; what a partition could not match, pieces at its start and places at its end, is matched across partitions by
their numbers alone, and swept again there. Where several want a place the lower rank, by length, then doc_id and piece,
has it; the others go on to the next larger place or, where there is none, to the next round. Gaps are updated, and the
next round begins. Once no open gap holds a piece left, sequences are opened: as many as the pieces of the longest one's
kind fill, a kind being how often a length goes into ``size``, or as all pieces left need at least.

Number of sequences: mostly that of best-fit decreasing, a few more at times, since gaps made within a round wait for the
next one. Pieces, gaps and matches stay distributed; the driver sees a row for each length at first, for each kind
after each round (at most ``size`` either way), and for each partition of a sweep of several.

A null text is empty and becomes one piece, its end id. Null ids are sorted first; repeated rows are separate
documents. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, shared_dir, written
from .word_ids import WordEncoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, size: int = 4096, end: int = 1) -> DataFrame:
    """One row per piece of each document's ids and the end id after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        made = WordEncoder(path)
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                out = [[], [], [], [], []]
                for doc, ids in zip(batch.column(0).to_pylist(), made.encode(batch.column(1).to_pylist()), strict=True):
                    ids = np.append(np.frombuffer(ids, made.kind).astype("<u4"), np.uint32(end))
                    for k, start in enumerate(range(0, len(ids), size)):
                        piece = ids[start : start + size]
                        for column, value in zip(out, (doc, k, start, len(piece), zlib.crc32(piece.tobytes())), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, PIECES)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches the pieces (kind 1) of each run with its places (kind 0), which come before those they hold.

    Gives a row per piece, its ``seq`` null and ``place`` its number among such ones where no place is left, and a row
    per remaining places of a gap, ``place`` being the number of those below it.
    """
    from pyspark import TaskContext

    part, current = TaskContext.get().partitionId(), None
    stack: list[list[int]] = []
    out: list[tuple] = []
    missed = 0

    def rest() -> None:
        below = 0
        for seq, room, number in stack:
            out.append((None, None, seq, room, number, part, below))
            below += number
        stack.clear()

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)

    for batch in batches:
        for run, kind, at, number, amount in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run != current:
                rest()
                current, missed = run, 0
            if kind == 0:
                stack.append([at, amount, number])
            elif stack:
                top = stack[-1]
                out.append((at, amount, top[0], top[1], 0, part, 0))
                top[2] -= 1
                if not top[2]:
                    stack.pop()
            else:
                out.append((at, amount, None, None, 0, part, missed))
                missed += 1
        if out:
            yield made(out)
            out.clear()
    rest()
    for at in range(0, len(out), 8192):
        yield made(out[at : at + 8192])


KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
NAMES = ["rank", "length", "seq", "room", "number", "part", "place"]
SWEPT = "rank long, length long, seq long, room long, number long, part int, place long"
EVENT = ["run", "kind", "at", "number", "amount"]


def across(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which places of earlier partitions serve the unmatched pieces of later ones, the last places first.

    ``left`` has (partition, pieces, places) in order; the rows are (run, partition of the pieces, first piece, partition
    of the places, first place, number). There are at most two for each partition.
    """
    found, stack = [], []
    for part, want, places in left:
        first = 0
        while first < want and stack:
            source, there = stack.pop()
            take = min(there, want - first)
            found.append((len(found), part, first, source, there - take, take))
            first += take
            if take < there:
                stack.append((source, there - take))
        if places:
            stack.append((part, places))
    return found


def _round(events: DataFrame, rows: int, base: str, task_rows: int) -> DataFrame:
    """One sweep over ``events`` (value and the columns of EVENT): a row per piece, seq null where it found no place."""
    parts = -(-rows // task_rows)
    order = [F.col("value").desc(), F.col("kind"), F.col("at")]
    dealt = events.repartition(1) if parts == 1 else events.repartitionByRange(parts, *order)
    swept = written(dealt.sortWithinPartitions(*order).select(*EVENT).mapInArrow(_swept, SWEPT), f"{base}/swept")
    found = swept.where("rank is not null")
    if parts == 1:
        return found
    per = swept.where("seq is null or rank is null").groupBy("part").agg(F.count("rank").alias("pieces"), F.sum("number").alias("places"))
    runs = across([tuple(r) for r in per.orderBy("part").collect()])
    if not runs:
        return found
    spark = events.sparkSession
    plan = F.broadcast(spark.createDataFrame(runs, "run long, p_part int, p_first long, s_part int, s_first long, n long"))
    pieces_ = found.where("seq is null").join(plan, F.expr("part = p_part and place >= p_first and place < p_first + n"), "left")
    wanted = pieces_.where("run is not null").selectExpr("run", "1 kind", "rank at", "1L number", "length amount", "place key")
    places = swept.where("rank is null").join(plan, F.expr("part = s_part and place < s_first + n and place + number > s_first"))
    served = places.selectExpr("run", "0 kind", "seq at", "least(place + number, s_first + n) - greatest(place, s_first) number", "room amount", "place key")
    again = served.unionByName(wanted).repartition("run").sortWithinPartitions("run", "kind", "key").select(*EVENT)
    matched = written(again.mapInArrow(_swept, SWEPT).where("rank is not null"), f"{base}/across")
    return found.where("seq is not null").unionByName(matched).unionByName(pieces_.where("run is null").select(*NAMES))


def pack(found: DataFrame, size: int = 4096, task_rows: int = 250_000) -> DataFrame:
    """Adds sequence_id and offset to what :func:`pieces` gives; a task sweeps over about ``task_rows`` rows."""
    spark = found.sparkSession
    base = shared_dir(spark, "packing")
    found = written(found, f"{base}/pieces")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("length").desc(), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    ranged = written(found.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id()), f"{base}/ranged")
    counts = dict(ranged.groupBy("length").count().collect())  # at most a row for each length
    gaps = spark.createDataFrame([], "seq long, gap long")
    left = None  # pieces that the round before could not place
    kinds: list[tuple[int, int, int, int, int]] = []  # of those: size / length, pieces, tokens, least and greatest length
    reached, opened, open_gaps, widest = size + 1, 0, 0, 0
    placed: list[DataFrame] = []
    while kinds or any(n < reached for n in counts):
        longest = max(k[4] for k in kinds) if kinds else max(n for n in counts if n < reached)
        lowest = min(reached, longest * 2 // 3 + 1)
        events, rows = [], sum(k[1] for k in kinds)
        if kinds:
            events.append(left.select("rank", "length"))
            if widest < min(k[3] for k in kinds):
                per, same = max(kinds, key=lambda k: k[4])[:2]
                more = max(same // per, -(-sum(k[2] for k in kinds) // size))
                gaps = gaps.unionByName(spark.range(opened, opened + more, 1, 1).select(F.col("id").alias("seq"), F.lit(size).cast("long").alias("gap")))
                opened, open_gaps = opened + more, open_gaps + more
        if lowest < reached:
            events.append(ranged.where(f"length >= {lowest} and length < {reached}").select("rank", "length"))
            rows += sum(c for n, c in counts.items() if lowest <= n < reached)
        least = min([k[3] for k in kinds] + [n for n in counts if lowest <= n < reached])
        reached = lowest
        wanting = events[0] if len(events) == 1 else events[0].unionByName(events[1])
        wanting = wanting.selectExpr("length value", "0L run", "1 kind", "rank at", "1L number", "length amount")
        holding = gaps.where(f"gap >= {least}").selectExpr(f"least(gap, {longest}L) value", "0L run", "0 kind", "seq at", f"greatest(gap div {longest}, 1L) number", "gap amount")
        here = f"{base}/round{len(placed)}"
        tried = _round(holding.unionByName(wanting), rows + open_gaps, here, task_rows)
        placed.append(tried.where("seq is not null").select("rank", "seq", "room", "length"))
        left = tried.where("seq is null")
        kinds = [tuple(r) for r in left.groupBy(F.expr(f"{size} div length").alias("kind")).agg(F.count("*"), F.sum("length"), F.min("length"), F.max("length")).collect()]
        changed = gaps.unionByName(placed[-1].select("seq", (-F.col("length")).alias("gap"))).groupBy("seq").agg(F.sum("gap").alias("gap"))
        gaps = written(changed.where(f"gap >= {min(counts)}"), f"{here}/gaps")
        open_gaps, widest = gaps.agg(F.count("*"), F.coalesce(F.max("gap"), F.lit(0))).first()
    if not placed:
        return ranged.selectExpr("doc_id", "piece", "start", "length", "ids_crc32", "0L sequence_id", "0L offset")
    every = placed[0]
    for more in placed[1:]:
        every = every.unionByName(more)
    # A sequence's room shrinks from round to round, so it tells their order.
    before = Window.partitionBy("seq").orderBy(F.col("room").desc(), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = every.select("rank", F.col("seq").alias("sequence_id"), (F.sum("length").over(before) - F.col("length")).alias("offset"))
    return ranged.join(at, "rank").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def best_fit(docs: DataFrame, path: str, size: int = 4096, end: int = 1) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``size`` tokens."""
    return pack(pieces(docs, path, size, end), size)
