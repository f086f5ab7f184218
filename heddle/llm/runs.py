"""Periodic runs of words, in linear time on an ordered alphabet (after Ellert and Fischer).

A run is a stretch of words with smallest period q that is as long as it can be, here at least ``MIN_LENGTH`` words
and ``MIN_EXPONENT`` periods. Every run begins with less than a period before a Lyndon root: a word sequence that is
the longest Lyndon sequence at its place, under one of the two orders of the alphabet. So:

1. From right to left, the next smaller suffix of every place is found for both orders at once, by walking
   the places that were smaller before. Words are only compared with each other; there is no suffix structure
   and no hash of a text. Where first words differ, which is nearly everywhere, one order needs no walk at all.
2. A comparison of two suffixes goes on where the one before it on the walk ended, and for each distance between two
   suffixes the furthest left match is remembered: a later match at that distance that reaches it takes over its end.
   So no two places are compared twice at one distance. Random and periodic texts take 2 to 5 comparisons a word at
   any length; the most repetitive texts known (Fibonacci, Thue-Morse) 6.5 to 8 from 20,000 to 80,000 words.
3. A root that is followed by its own repetition is extended to the left, once a run.

Words are what lies between blanks (space, tab, line feeds, form feed), compared as bytes. A null text is an empty one, without
words; ids may be null or repeat, and each row stands alone. A text of any length is treated in one piece: a task
holds its words and a few numbers for each. Other columns are not read, so none can clash. No rows give no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import filled, map_batches

MIN_LENGTH, MIN_EXPONENT = 24, 3
BLANKS = " \t\n\x0b\f\r"
RUN = "struct<start: bigint, length: bigint, period: bigint>"


class Lyndon:
    """Next smaller suffixes of both orders, with how far each one matches.

    ``following[0]`` takes words in their order, ``following[1]`` in the reverse; the end is smaller than any word in both.
    ``repeated`` has (place, period, matched) where the longest Lyndon sequence at a place is followed by itself.
    ``compared`` counts comparisons of words within matches.
    """

    def __init__(self, words: list):
        n = len(words)
        self.words, self.following, self.matched = words, ([n] * n, [n] * n), ([0] * n, [0] * n)
        self.start, self.end = [n] * (n + 1), [n] * (n + 1)  # by distance: the furthest left match known, and its end
        self.repeated: tuple[list, list] = ([], [])
        self.compared = 0
        up, down = self.following
        walk = self._walk
        for i in range(n - 2, -1, -1):
            here, there = words[i], words[i + 1]
            if here < there:
                down[i] = i + 1
                j = up[i + 1]
                while j < n and words[j] > here:
                    j = up[j]
                if j < n and words[j] == here:
                    walk(0, i, j)
                else:
                    up[i] = j
            elif here > there:
                up[i] = i + 1
                j = down[i + 1]
                while j < n and words[j] < here:
                    j = down[j]
                if j < n and words[j] == here:
                    walk(1, i, j)
                else:
                    down[i] = j
            else:
                walk(0, i, i + 1)
                walk(1, i, i + 1)

    def _match(self, i: int, j: int, known: int) -> int:
        """How many words suffixes i and j share, at least ``known``."""
        words, d, n = self.words, j - i, len(self.words)
        at, reach = i + known, self.start[d]
        begin, stop = at, n - d
        while at < stop and at < reach and words[at] == words[at + d]:
            at += 1
        self.compared += at - begin + 1
        if at >= reach:
            at = max(at, self.end[d])
        self.start[d], self.end[d] = i, at
        return at - i

    def _walk(self, order: int, i: int, j: int) -> None:
        """Sets the next smaller suffix of i, from place j on, whose first word is that at i."""
        words, following, matched, n = self.words, self.following[order], self.matched[order], len(self.words)
        shared, known = self._match(i, j, 1), True
        while True:
            if known:
                if j + shared == n or (words[j + shared] > words[i + shared]) == (order == 1):
                    break
            # suffix i is smaller than suffix j: on to what is smaller than that
            after, common = following[j], matched[j]
            if after == n:
                j, shared = n, 0
                break
            j = after
            if common < shared:
                shared = common
                break
            known = common == shared
            if known:
                shared = self._match(i, j, shared)
        following[i], matched[i] = j, shared
        if shared >= j - i and j < n:
            self.repeated[order].append((i, j - i, shared))


def runs_of(words: list, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period. ``min_exponent`` is 3 or more."""
    if len(words) < min_length:
        return []
    found = set()
    for roots in Lyndon(words).repeated:
        last: dict[int, int] = {}  # where the last run of each period ends: its other roots are left out
        for i, q, shared in reversed(roots):
            end = i + q + shared
            if last.get(q) == end:
                continue
            last[q] = end
            start = i
            while start and words[start - 1] == words[start - 1 + q]:
                start -= 1
            if end - start >= max(min_length, min_exponent * q):
                found.add((start, end - start, q))
    return sorted(found)


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    out, at = [], 0
    for begin, end in sorted((start + q, start + length) for start, length, q in runs):
        if begin > at:
            out += words[at:begin]
        at = max(at, end)
    return out + words[at:]


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(id, n_words, runs array<struct<start, length, period>>, collapsed) for each row; collapsed is the text without the
    repetitions, its words joined by single spaces."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, runs, rest = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = text.split()  # of bytes: at BLANKS
                here = runs_of(words, min_length, min_exponent)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in here])
                rest.append(b" ".join(collapsed(words, here)))
            columns = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(rest, pa.binary()).cast(pa.string())]
            return pa.record_batch(columns, ["id", "n_words", "runs", "collapsed"])

        return one

    rows = df.select(F.col(id_col).alias("id"), filled(text_col))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, runs array<{RUN}>, collapsed string"
    return map_batches(rows, make, schema).withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """The run with the most periods, the first of equals; null without one."""
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(more(best, r), r).otherwise(best))


def looped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): a tenth of the texts, by checksum of the id, repeat a stretch of their words to the end. A row without an
    id or words stays as it is."""
    h = F.crc32(F.col(id_col).cast("string"))
    words = F.split(F.btrim(text_col, F.lit(BLANKS)), "[ \\t\\n\\x0B\\f\\r]+")
    n = F.when(F.length(F.btrim(text_col, F.lit(BLANKS))) > 0, F.size(words)).otherwise(0)
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    left = n - a
    p = (1 + F.floor(left / (3 + g % 8))).cast("int")
    times = F.ceil(left / p).cast("int")
    unit = F.slice(words, a + 1, p)
    edited = F.concat_ws(" ", F.slice(words, F.lit(1), a), F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), left))
    return df.select(id_col, F.when((h % 10 == 0) & (n > 0), edited).otherwise(F.col(text_col)).alias(text_col))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The number of runs, the strongest one, and digests of all runs and of the collapsed text, for each row."""
    found = periodic_runs(df, id_col, text_col).withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.col("best")
    return found.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
