"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Documents become token ids and an end id; longer ones than ``capacity`` are cut into pieces.
An instance is then a histogram of piece lengths: ``capacity`` numbers at most, however many
documents there are. That is all that comes to the driver, which solves it by length:

1. Reduction. A set of pieces that fits dominates another if the other's pieces can be grouped to
   go where the set's are. Where a set with piece j dominates all others with j, it is fixed for
   good without losing any optimum: j alone if nothing fits beside it; j and its exact complement;
   j and the largest piece k that fits beside it, if no two or more pieces that fit beside j have
   a larger sum than k (the sums that can be reached are a bit set). Copies are fixed together:
   taking away pieces only removes alternatives. This repeats until nothing more can be fixed.
2. Best fit, longest first, for the rest: sequences of equal content are one entry with a count.

The plan gives, for each length, which ranks go into which sequences at which offset. Ranks
within a length come from counts of (length, salt) cells and row numbers inside a cell, so a
length that a third of all pieces have is spread over many tasks.

A null text is an empty one: its piece is the end id alone. Ids may be null or repeat; each row
is a document of its own. Other columns are not read. No rows give no pieces. A text of any length is
encoded whole, in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import filled, materialise, small_batches, texts

CAPACITY, END_ID = 2048, 0
#: Pieces of one length that share a salt, about.
CELL_ROWS = 200_000
#: Rows of the plan up to which it is broadcast; it has some thousands.
FEW = 200_000

Pattern = tuple[int, ...]


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, turn) for each piece of each row's ids and end id; turn numbers
    the pieces of a task."""
    end = end_id.to_bytes(4, "little")
    names = ["id", "piece", "start", "length", "ids_crc32", "turn"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from heddle.llm.word_memo import word_memo

        memo, turn = word_memo(path), 0
        for batch in batches:
            rows, cut = [], []
            for k, ids in enumerate(memo.batch(texts(batch))):
                ids += end
                for j, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(k)
                    cut.append((j, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*cut, strict=True) if cut else [[]] * 4
            values = [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            turns = pa.array(range(turn, turn + len(rows)), pa.int64())
            turn += len(rows)
            yield pa.record_batch([batch.column("id").take(pa.array(rows, pa.int64())), *values, turns], names)

    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), filled(text_col))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, turn long")


def _pair_above(left: dict[int, int], low: int, high: int) -> bool:
    """Whether two pieces have a sum above low, up to high: the quick way to see most cases."""
    there = sum(1 << s for s in left)
    for s, n in left.items():
        if (there ^ (1 << s) * (n < 2)) >> max(low + 1 - s, 0) & ((1 << (high - max(low + 1, s) + 1)) - 1 if high >= max(low + 1, s) else 0):
            return True
    return False


def _sums(left: dict[int, int], limit: int) -> int:
    """Bit s is set if two or more of the pieces have sum s, up to limit."""
    mask, one, more = (1 << (limit + 1)) - 1, 0, 0  # sums of exactly one piece, of two or more
    for s, n in left.items():
        if s > limit or not n:
            continue
        n, step, any_, two = min(n, limit // s), 1, 0, 0
        reach = 1  # sums of copies of s alone
        while n:
            step = min(step, n)
            reach |= (reach << (s * step)) & mask
            n, step = n - step, step * 2
        any_ = reach & ~1 & mask
        two = any_ & ~(1 << s)
        copies = [k * s for k in range(1, limit // s + 1) if any_ >> (k * s) & 1]
        grown = two
        for c in copies:
            grown |= ((one | more) << c) & mask
        more |= grown
        one |= 1 << s
    return more


def reduce_instance(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """(fixed patterns with their counts, the lengths that are left)."""
    left = {s: n for s, n in histogram.items() if n}
    fixed: list[tuple[Pattern, int]] = []

    def fix(pattern: Pattern, n: int) -> None:
        fixed.append((pattern, n))
        for s in pattern:
            left[s] -= n
            if not left[s]:
                del left[s]

    def partner(j: int) -> int | None:
        """The largest length that fits beside one piece of length j, or None."""
        return max((s for s, n in left.items() if s <= capacity - j and n > (s == j)), default=None)

    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            if j not in left:
                continue
            k, room = partner(j), capacity - j
            if k is None:
                fix((j,), left[j])
                changed = True
                continue
            if k < room:
                others = {s: n - (s == j) for s, n in left.items() if s <= room and n > (s == j)}
                if _pair_above(others, k, room) or _sums(others, room) >> (k + 1):
                    continue
            n = left[j] // 2 if j == k else min(left[j], left[k])
            if n:
                fix((j, k), n)
                changed = True
    return fixed, left


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns with their counts, by best fit with the longest pieces first."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    rooms = 0  # bit r is set if a sequence has room r

    def put(room: int, pattern: Pattern, n: int) -> None:
        nonlocal rooms
        if n:
            open_.setdefault(room, []).append((pattern, n))
            rooms |= 1 << room

    for s in sorted(histogram, reverse=True):
        n = histogram[s]
        while n:
            fitting = rooms >> s << s
            if fitting:
                room = (fitting & -fitting).bit_length() - 1
                pattern, m = open_[room].pop()
                if not open_[room]:
                    rooms ^= 1 << room
            else:
                room, pattern, m = capacity, (), n
            each = room // s  # the sequence that has one has the least room, so it gets the next
            full = min(m, n // each)
            put(room - each * s, (*pattern, *[s] * each), full)
            n -= full * each
            if full < m and n:
                put(room - n * s, (*pattern, *[s] * n), 1)
                full, n = full + 1, 0
            if pattern:
                put(room, pattern, m - full)
    return [x for group in open_.values() for x in group]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    if any(s < 1 or s > capacity for s in histogram):
        raise ValueError("a piece is empty or longer than the capacity")
    fixed, left = reduce_instance(histogram, capacity)
    return fixed + best_fit(left, capacity)


def slots(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, pieces in each, first offset)."""
    out, rank, sequence = [], {}, 0
    for pattern, n in patterns:
        at = 0
        for s in sorted(set(pattern), reverse=True):
            each, first = pattern.count(s), rank.get(s, 0)
            rank[s] = first + n * each
            out.append((s, first, rank[s], sequence, each, at))
            at += s * each
        sequence += n
    return out


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows of ``pieces``, which must be cheap to read again."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    found = slots(plan(histogram, capacity))
    table = spark.createDataFrame(found, "length long, lo long, hi long, sequence long, each long, at long")
    table = F.broadcast(table) if len(found) <= FEW else table
    salts = max(8, sum(histogram.values()) // CELL_ROWS)
    # by the place in a task, so that rows that repeat are dealt out too
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "ids_crc32", "turn")
    ranked = salted.withColumn("number", F.row_number().over(inside) - 1).join(cells, ["length", "salt"]).withColumn("rank", F.col("number") + F.col("before"))
    found = ranked.join(table, (ranked.length == table.length) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return found.select("id", "piece", "start", ranked.length, "ids_crc32", (F.col("sequence") + F.expr("(rank - lo) div each")).alias("sequence_id"), (F.col("at") + F.pmod(nth, F.col("each")) * ranked.length).alias("offset"))


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for each piece."""
    cut = materialise(pieces(df, path, capacity, end_id, id_col, text_col))
    return assign(cut, capacity).withColumnRenamed("id", id_col)
