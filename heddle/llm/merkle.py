"""Document fingerprints: Merkle trees over spans, paragraphs and sections.

A text is cut into paragraphs (lines, with their line end), these into spans (sentences; longer
ones after so many words or characters from their start), and runs of paragraphs form sections
that end where a paragraph's digest says so, so that an edit moves no far section's end. A node's
digest hashes its children's digests. Equal roots mean equal texts; where roots differ, only the
branches that differ are descended, down to the edited spans.

The fingerprint string has the whole tree: ``root:``, then sections joined by ``|``, a section its digest,
``/`` and its paragraphs joined by ``,``, a paragraph its digest, ``-`` and its spans joined by ``.``, a
span eight hex digits of its digest and its length in hex. So two texts are compared without
reading either: equal roots end it; else sections that are equal in the same order are aligned, only
those between them are descended, to paragraphs and then to spans. What stays apart are the edits,
and likeness is the share of characters outside of them, so it depends on the order.

Neighbours in ascending id order are found without a global sort: quantiles cut the ids into
buckets, each bucket is sorted on its own and streams through a task, and each gets a copy of the
first document of the bucket that follows it.

A null text is an empty one, whose tree has no spans; two empty texts have likeness 1. Rows with
equal ids are neighbours in the order of their texts, and all in one bucket. A row with a null id has no next
document: its edited text keeps its first part only, and its next text is the empty one. A single
document is its own next one. No rows give no rows. A very long text is one row: its tree has a node
for each span, some tens of characters, and is compared in n log n steps. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import filled, map_batches, small_batches, texts

LINE = re.compile(r"[^\n]*\n|[^\n]+")
SENTENCE = re.compile(r"[^.!?]+[.!?]*\s*|[.!?]+\s*")
SPAN_WORDS, SPAN_CHARS = 12, 160
#: One paragraph in so many ends a section.
SECTION = 4
DIGEST = 16
#: Hex digits of a digest in the fingerprint string: of the root, of sections and paragraphs, of spans.
ROOT_HEX, NODE_HEX, SPAN_HEX = 32, 12, 8
MAX_BUCKETS, NULL_BUCKETS = 16_384, 64


def _hash(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:DIGEST]


def spans(paragraph: str) -> list[str]:
    out = []
    for s in SENTENCE.findall(paragraph):
        if len(s) <= SPAN_CHARS:
            out.append(s)
            continue
        words = s.split(" ")
        for k in range(0, len(words), SPAN_WORDS):
            part = " ".join(words[k : k + SPAN_WORDS]) + (" " if k + SPAN_WORDS < len(words) else "")
            out += [part[j : j + SPAN_CHARS] for j in range(0, len(part), SPAN_CHARS)]
    return out


class Node(NamedTuple):
    """``digest`` as the fingerprint string has it, in hex; ``size`` in characters."""

    digest: str
    size: int
    children: list


def _parent(digests: list[bytes], children: list[Node], hex_digits: int) -> tuple[bytes, Node]:
    digest = _hash(b"".join(digests))
    return digest, Node(digest.hex()[:hex_digits], sum([c.size for c in children]), children)


def tree(text: str) -> Node:
    """The root; its children are sections, theirs paragraphs, theirs spans, all in the text's order,
    without gaps."""
    sections, whole = [], []
    digests, current = [], []
    for line in LINE.findall(text):
        parts = spans(line)
        leaves = [_hash(s.encode()) for s in parts]
        digest, node = _parent(leaves, [Node(d.hex()[:SPAN_HEX], len(s), []) for d, s in zip(leaves, parts, strict=True)], NODE_HEX)
        digests.append(digest)
        current.append(node)
        if digest[-1] % SECTION == 0:
            digest, node = _parent(digests, current, NODE_HEX)
            whole.append(digest)
            sections.append(node)
            digests, current = [], []
    if current:
        digest, node = _parent(digests, current, NODE_HEX)
        whole.append(digest)
        sections.append(node)
    return _parent(whole, sections, ROOT_HEX)[1]


def render(root: Node) -> str:
    """The fingerprint string of a tree."""
    span = lambda s: f"{s.digest}{s.size:x}"
    paragraph = lambda p: p.digest + "-" + ".".join(map(span, p.children))
    section = lambda s: s.digest + "/" + ",".join(map(paragraph, s.children))
    return root.digest + ":" + "|".join(map(section, root.children))


def parse(fingerprint: str) -> Node:
    """The tree of a fingerprint string."""

    def node(text: str, marks: str, joins: str) -> Node:
        if not marks:
            return Node(text[:SPAN_HEX], int(text[SPAN_HEX:], 16), [])
        digest, _, rest = text.partition(marks[0])
        children = [node(x, marks[1:], joins[1:]) for x in rest.split(joins[0])] if rest else []
        return Node(digest, sum(c.size for c in children), children)

    return node(fingerprint, ":/-", "|,.")


def fingerprint(text: str) -> str:
    return render(tree(text))


def aligned(xs: list[Node], ys: list[Node]) -> list[tuple[int, int]]:
    """Places of equal nodes in both lists, ascending in both: those at either end, and between
    them a longest run of pairs of the k-th occurrences of a digest."""
    head, least = 0, min(len(xs), len(ys))
    while head < least and xs[head].digest == ys[head].digest:
        head += 1
    tail = 0
    while tail < least - head and xs[-1 - tail].digest == ys[-1 - tail].digest:
        tail += 1
    there = defaultdict(list)
    for j in range(len(ys) - tail - 1, head - 1, -1):
        there[ys[j].digest].append(j)  # the first is popped first
    ends, last, before = [], [], {}  # least end of an ascending run of each length
    for i in range(head, len(xs) - tail):
        if places := there.get(xs[i].digest):
            j = places.pop()
            k = bisect_left(ends, j)
            before[i, j] = last[k - 1] if k else None
            ends[k : k + 1], last[k : k + 1] = [j], [(i, j)]
    middle, at = [], last[-1] if last else None
    while at:
        middle.append(at)
        at = before[at]
    return [(k, k) for k in range(head)] + middle[::-1] + [(len(xs) - k, len(ys) - k) for k in range(tail, 0, -1)]


def differing(a: Node, b: Node) -> list[tuple[int, int, int, int]]:
    """Where two trees differ: (start, end) in a's text and in b's of each run of differing spans.
    Branches that are equal are not descended."""
    out: list[list[int]] = []

    def descend(xs: list[Node], ys: list[Node], x: int, y: int) -> None:
        i = j = 0
        for m, n in [*aligned(xs, ys), (len(xs), len(ys))]:
            apart, other = xs[i:m], ys[j:n]
            x_end, y_end = x + sum([c.size for c in apart]), y + sum([c.size for c in other])
            if apart and other and apart[0].children:
                descend([c for p in apart for c in p.children], [c for p in other for c in p.children], x, y)
            elif apart or other:
                if out and out[-1][1] == x and out[-1][3] == y:
                    out[-1][1::2] = x_end, y_end
                else:
                    out.append([x, x_end, y, y_end])
            if m < len(xs):
                x, y = x_end + xs[m].size, y_end + ys[n].size
            i, j = m + 1, n + 1

    if a.digest != b.digest:
        descend(a.children, b.children, 0, 0)
    return [tuple(run) for run in out]


def alike(a: Node, b: Node) -> float:
    """Likeness of two trees, from 0 to 1: the share of their characters outside of the edits."""
    if a.digest == b.digest:
        return 1.0
    apart = sum(e - s + e2 - s2 for s, e, s2, e2 in differing(a, b))
    return 1 - apart / (a.size + b.size)


def likeness(a: str, b: str) -> float:
    """Of two fingerprint strings."""
    return alike(parse(a), parse(b))


def edits(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """Where text b differs from text a: (start, end) in a and in b of each run of differing spans."""
    return differing(tree(a), tree(b))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for each row."""

    def make():
        return lambda batch: pa.record_batch([batch.column("id"), pa.array([fingerprint(x) for x in texts(batch)], pa.string())], ["id", "fingerprint"])

    rows = df.select(F.col(id_col).alias("id"), filled(text_col))
    return map_batches(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def _bucket(value: Column, cuts: list[int], low: int, high: int) -> Column:
    """How many of the ascending cuts are at most the value. Cells of equal width say where
    to begin, so a row is compared with a few cuts only."""
    n = max(1, len(cuts))
    width = max(1, -(-(high - low + 1) // (2 * n)))
    starts, k = [], 0
    for c in range(2 * n + 1):
        while k < len(cuts) and cuts[k] < low + c * width:
            k += 1
        starts.append(k)
    array = F.lit(cuts).cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    cell = F.expr(f"least(greatest((cast(id as bigint) - {low}L) div {width}L, 0L), {2 * n - 1}L)").cast("int")
    first = F.element_at(F.lit(starts), cell + 1)
    count = F.element_at(F.lit(starts), cell + 2) - first
    return first + F.size(F.filter(F.slice(array, first + 1, F.greatest(count, F.lit(0))), lambda c: c <= value))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(bucket, guard, id, text), each bucket in one partition and sorted: the next row of the
    bucket is the next document; a guard is a copy of the next bucket's first document."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), filled(text_col))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or max(16, min(MAX_BUCKETS, 8 * partitions))
    ids = rows.select("id").where("id is not null")
    span = ids.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    null_bucket = (-1 - F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(NULL_BUCKETS))).cast("int")
    if span["low"] is None:
        rows = rows.withColumn("bucket", null_bucket).withColumn("guard", F.lit(0))
    else:
        cuts = sorted({int(x) for x in ids.approxQuantile("id", [k / buckets for k in range(1, buckets)], 0.25 / buckets)} if buckets > 1 else set())
        bucket = _bucket(F.col("id"), cuts, span["low"], span["high"]).cast("int")
        heads = [(r["bucket"], r["head"]) for r in ids.select("id", bucket.alias("bucket")).groupBy("bucket").agg(F.min("id").alias("head")).collect()]  # a row a bucket
        heads.sort()
        follows = spark.createDataFrame([(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)], "id long, bucket int")
        guards = rows.join(F.broadcast(follows), "id").select("id", "text", "bucket", F.lit(1).alias("guard"))
        rows = rows.select("id", "text", F.when(F.col("id").isNull(), null_bucket).otherwise(bucket).alias("bucket"), F.lit(0).alias("guard")).unionAll(guards)
    return rows.repartition(partitions, "bucket").sortWithinPartitions("bucket", "guard", "id", "text").select("bucket", "guard", "id", "text")


def edited_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edits): each
    text against itself with its last half replaced by the next text's beginning; ``edits`` are the
    runs that differ, as start-end:start-end joined by commas, in characters of both texts."""
    kinds = {
        "id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
        "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "edits": pa.string(),
    }

    def compare(row: tuple[int, str, Node], text: str, following: Node) -> tuple:
        i, own_text, own = row
        half = len(own_text) // 2
        edited = own_text[: len(own_text) - half] + text[:half]
        changed = tree(edited)
        said = ",".join([f"{s}-{e}:{s2}-{e2}" for s, e, s2, e2 in differing(own, changed)])
        digest = hashlib.sha256(edited.encode()).hexdigest()
        return i, len(own_text), digest, render(own), render(changed), alike(own, changed), alike(own, following), said

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], [*kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, waiting, empty = None, None, tree("")
        for batch in batches:
            out = []
            for b, guard, i, x in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if b < 0 or waiting is not None or not guard:
                    own = tree(x)
                if waiting is not None:
                    out.append(compare(waiting, x, own) if b == bucket else compare(waiting, "", empty))
                    waiting = None
                if b < 0:
                    out.append(compare((i, x, own), "", empty))
                elif not guard:
                    bucket, waiting = b, (i, x, own)
            yield batch_of(out)
        if waiting is not None:
            yield batch_of([compare(waiting, "", empty)])

    small_batches(df.sparkSession)
    schema = ", ".join(f"{name} {kind}" for name, kind in zip(kinds, "long long string string string double double string".split(), strict=True))
    done = with_next(df, id_col, text_col, buckets).mapInArrow(run, schema)
    return done.withColumnRenamed("id", id_col)
