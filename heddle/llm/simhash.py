"""SimHash near-duplicates, with candidates by pigeonring filtering.

A document's fingerprint has bit j set if more than half of its shingles' 64-bit hashes have.
Fingerprints that differ in at most ``max_diff`` bits link.

Candidates. The 64 bits are cut into m = max_diff + 1 segments on a ring. If two fingerprints
differ in at most max_diff bits, then some chain of consecutive segments keeps every prefix
within its share of the budget: the first l segments differ in at most floor(l * max_diff / m) =
l - 1 bits in all. (The plain pigeonhole only asks this of l = 1.) So the chain's first segment
is equal and its second differs in one bit at most, which is a join on two thirds of the bits:
one side has its two segments, the other has them and each one-bit change of the second. The
longer prefixes are then tested, and the full Hamming distance last. A fingerprint has a fixed
number of keys, so the work grows with the number of different fingerprints, and a key is met by
few of them, also in very large tables.

On request, links of ``near_duplicates`` also need a Jaccard similarity of the shingle sets. Its
nodes are then pairs of fingerprint and shingle set, and different texts of one fingerprint are
compared like those of fingerprints that link.

``deduplicate`` links by that similarity alone. At a Jaccard similarity of 0.8 the 64 bits differ in
10 on average, which leaves segments of four bits: too short for a join key in a large table. So
its fingerprint is longer. The shingle hashes are dealt out to the segments of a ring, and a segment's
value is its least hash, equal in both texts with a probability of their similarity. Pigeonring
filtering is as above: some chain of consecutive segments has no difference, and it is the join key.
Chains lengthen with the number of texts (``chain_length``), so that keys stay selective, and
the ring is as long as ``ring_size`` says, so that a pair at the threshold has no such chain in
fewer than one of 10**8 cases. A small set has too few hashes for a ring; its keys are those of its
first shingles that any set of this similarity must share one of (with n shingles, the first
n - ceil(t * n) + 1 in any one order of all). Shingles that many small sets have come last
in that order, so few sets meet at them. Sets that meet at a key form a group with the least of
them, its head. A group's texts are compared in blocks with their head and with each other; then, in
a group of several blocks, those that are not yet in its head's component with all others. The
similarity is always computed on the texts, and pairs are never written, only links that join
components.

Copies have one fingerprint and are one node; links are between different nodes. Nothing
is capped. Ids may repeat (each row gets its own fingerprint and component); a null id never
gives a component its name unless all ids in it are null. A null text is an empty one. Documents
without words have fingerprint zero and link like any other; as shingle sets they are equal. A
very long text is hashed in blocks of shingles. No rows give no rows. ``near_duplicates`` reads no
other columns; ``deduplicate`` passes them through, and refuses names that begin with ``__heddle``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import filled, map_batches, materialise, small_batches
from heddle.llm.components import connected_components

BITS, SEED = 64, 42
#: Shingles whose bits are counted at once, to bound memory on very long texts.
BLOCK = 1 << 15
#: How many small sets make a shingle common, and of how many.
COMMON, COMMON_OF = 3, 4000
#: Sets up to this size have keys of single shingles; larger ones, and those that can be similar to
#: larger ones, have keys of chains.
SMALL_SET = 128
#: How often a pair at the threshold may share no chain.
MISSES = 1e-8
#: Texts, and shingles, that a block of a group has at most, about.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 1 << 17
#: Shingles whose occurrences in a block are multiplied at once.
COLUMNS = 4096
#: A table of up to so many (id, hash) rows is broadcast to the texts; a larger one is joined by a shuffle.
FEW = 200_000
#: Against rounding in bounds on sizes of sets, which must never be too strict.
SLACK = 1e-6


def fingerprint(text: bytes, width: int) -> int:
    """Unsigned fingerprint of a UTF-8 text. bytes.lower and bytes.split know ASCII only."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(BITS, np.int64)
    digest, join = xxhash.xxh64_digest, b" ".join
    for start in range(0, n, BLOCK):
        part = words[start : start + BLOCK + width - 1]
        shingles: Iterable[bytes] = map(join, zip(*(part[k:] for k in range(width)), strict=False)) if len(words) >= width else [join(words)]
        hashes = b"".join([digest(x, SEED) for x in shingles])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """The hashes of a text's different shingles, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, join, parts = xxhash.xxh64_digest, b" ".join, []
    for start in range(0, max(1, len(words) - width + 1), BLOCK):
        part = words[start : start + BLOCK + width - 1]
        shingles: Iterable[bytes] = map(join, zip(*(part[k:] for k in range(width)), strict=False)) if len(words) >= width else [join(words)]
        parts.append(np.unique(np.frombuffer(b"".join([digest(x, SEED) for x in shingles]), np.uint64)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def set_name(hashes: np.ndarray) -> int:
    """Unsigned hash of a shingle set."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def chain_length(n: int) -> int:
    """Segments of a chain, for n texts: two up to a million, one more for each hundredfold."""
    return max(2, math.ceil(math.log10(max(n, 1)) / 2 - 1))


def no_chain(size: int, similarity: float, chain: int) -> float:
    """A bound on the probability that of so many segments, each equal with this one, no ``chain``
    consecutive ones are equal: that of a row of them, which a ring's is below."""
    run = [1.0] + [0.0] * (chain - 1)  # by the number of equal ones at the end
    for _ in range(size):
        run = [(1 - similarity) * sum(run), *(similarity * x for x in run[:-1])]
    return sum(run)


def ring_size(similarity: float, chain: int) -> int:
    """Segments of the fingerprint, a multiple of eight."""
    return next((m for m in range(8, 512, 8) if no_chain(m, similarity, chain) <= MISSES), 512)


def ring(hashes: np.ndarray, size: int) -> np.ndarray:
    """The least of a set's sorted hashes in each segment; an empty segment has the next one's,
    with the distance mixed in."""
    segment = (hashes % np.uint64(size)).astype(np.int64)
    least = np.zeros(size, np.uint64)
    least[segment[::-1]] = hashes[::-1]  # the first of a segment is written last
    full = np.zeros(size, bool)
    full[segment] = True
    if not full.all():
        at = np.flatnonzero(full)
        following = at[np.searchsorted(at, np.arange(size)) % len(at)]
        least = least[following] + ((following - np.arange(size)) % size).astype(np.uint64) * MIX[0]
    return least


#: Odd numbers that mix keys.
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def keys_of(hashes: np.ndarray, similarity: float, segments: int, chain: int, common: np.ndarray) -> np.ndarray:
    """Keys of a shingle set; sets of this similarity share one."""
    n, out = len(hashes), []
    if not n:
        return hashes
    if n <= SMALL_SET:
        ordered = hashes
        if len(common):
            late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
            ordered = np.concatenate([hashes[~late], hashes[late]])
        out.append(ordered[: n - math.ceil(similarity * n - SLACK) + 1])
    if n >= similarity * SMALL_SET - SLACK:
        # by the hashes alone: if common shingles came last, what differs in near copies would come first
        least, mixed = ring(hashes, segments), np.arange(segments, dtype=np.uint64) * MIX[3]
        for k in range(chain):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX[1] + np.roll(least, -k) * MIX[2]
        out.append(mixed ^ (mixed >> np.uint64(31)))
    return out[0] if len(out) == 1 else np.concatenate(out)


def fingerprints(df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(x, width) for x in batch.column("text").to_pylist()], np.uint64)
            return pa.record_batch([batch.column("id"), pa.array(found.view(np.int64), pa.int64())], ["id", "fp"])

        return one

    rows = df.select(F.col(id_col).alias("id"), filled(text_col).cast("binary").alias("text"))
    return map_batches(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _mask(lo: int, hi: int) -> int:
    """Bits lo to hi - 1, as a signed long."""
    m = ((1 << hi) - 1) ^ ((1 << lo) - 1)
    return m - (1 << BITS) if m >> (BITS - 1) else m


def _segments(max_diff: int) -> list[tuple[int, int]]:
    cuts = [round(k * BITS / (max_diff + 1)) for k in range(max_diff + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def _keys(nodes: DataFrame, segments: list[tuple[int, int]], changed: bool) -> DataFrame:
    """(chain, key, fp): a row for each chain, and with ``changed`` for each change of its second segment."""
    rows = []
    for k, (lo, hi) in enumerate(segments):
        nxt = segments[(k + 1) % len(segments)] if len(segments) > 2 else (0, 0)
        mask = _mask(lo, hi) | _mask(*nxt)
        rows += [(k, mask, 0)] + [(k, mask, _mask(b, b + 1)) for b in range(*nxt) if changed]
    structs = F.array(*(F.struct(F.lit(k).cast("tinyint").alias("chain"), F.lit(m).cast("long").alias("mask"), F.lit(x).cast("long").alias("flip")) for k, m, x in rows))
    wide = nodes.select("fp", F.explode(structs).alias("s"))
    return wide.select(F.col("s.chain").alias("chain"), F.col("fp").bitwiseAND(F.col("s.mask")).bitwiseXOR(F.col("s.flip")).alias("key"), "fp")


def links(nodes: DataFrame, max_diff: int) -> DataFrame:
    """(a, b), a < b: the pairs of different fingerprints that differ in at most max_diff bits.
    ``nodes`` has each fingerprint once. A pair may come out once a chain."""
    segments = _segments(max_diff)
    a = _keys(nodes, segments, False).withColumnRenamed("fp", "a")
    b = _keys(nodes, segments, True).withColumnRenamed("fp", "b")
    pairs = a.join(b, ["chain", "key"]).where("a < b")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    within = F.lit(False)
    for k in range(len(segments)):  # prefixes of the chain that starts at segment k
        mask, ok = 0, F.col("chain") == k
        for length in range(1, len(segments)):
            mask |= _mask(*segments[(k + length - 1) % len(segments)])
            ok = ok & (F.bit_count(diff.bitwiseAND(F.lit(mask))) < length)
        within = within | ok
    return pairs.where(within).where(F.bit_count(diff) <= max_diff).select("a", "b")


def common_shingles(df: DataFrame, width: int, text_col: str) -> np.ndarray:
    """Sorted hashes of the shingles that COMMON small sets or more have, and COMMON of each COMMON_OF. All texts are counted, each
    set once; at most SMALL_SET * COMMON_OF / COMMON shingles are so common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, sets = [], []
            for x in batch.column("text").to_pylist():
                found = shingle_hashes(x, width)
                if 0 < len(found) <= SMALL_SET and (node := set_name(found)) not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(found.view(np.int64))
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *sets]), pa.int64()))
            yield pa.record_batch([pa.array(np.array(nodes, np.uint64).view(np.int64), pa.int64()), lists], ["node", "shingles"])

    small_batches(df.sparkSession)
    found = df.select(filled(text_col).cast("binary").alias("text")).mapInArrow(run, "node long, shingles array<long>")
    sets = materialise(found.groupBy("node").agg(F.first("shingles").alias("shingles")))
    least = max(COMMON, math.ceil(sets.count() * COMMON / COMMON_OF))
    counted = sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return np.sort(counted.select("shingle").toArrow().column("shingle").to_numpy().view(np.uint64))


def _text_hash(text_col: str) -> Column:
    """With the id it names a row's text, without Python."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def shingle_rows(df: DataFrame, width: int, similarity: float, n: int, common: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, node, size, keys): of each row's text the hash, the shingle set's name and number
    of shingles, and its keys, which are empty where the task has given this set's."""
    chain = chain_length(n)
    segments = ring_size(similarity, chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, sizes, keys, ends = [], [], [np.zeros(0, np.uint64)], [0]
            for x in batch.column("text").to_pylist():
                found = shingle_hashes(x, width)
                nodes.append(set_name(found))
                sizes.append(len(found))
                new = nodes[-1] not in seen
                if new:
                    seen.add(nodes[-1])
                    keys.append(keys_of(found, similarity, segments, chain, common))
                ends.append(ends[-1] + (len(keys[-1]) if new else 0))
            named = pa.array(np.array(nodes, np.uint64).view(np.int64), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64), pa.int64()))
            yield pa.record_batch([batch.column("id"), batch.column("hash"), named, pa.array(sizes, pa.int64()), lists], ["id", "hash", "node", "size", "keys"])

    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), _text_hash(text_col).alias("hash"), filled(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, hash long, node long, size long, keys array<long>")


def _some(table: DataFrame) -> DataFrame:
    """A materialised table of few columns as a join's side: broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= FEW else table


def _texts_of(df: DataFrame, rows: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) for the ends of the pairs; of a node's rows, that of the least id and hash."""
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    least = rows.join(ends, "node").groupBy("node").agg(F.min(F.struct("id", "hash")).alias("row"))
    least = materialise(least.select("node", F.col("row.id").alias("id"), F.col("row.hash").alias("hash")))
    whole = df.select(F.col(id_col).alias("of"), _text_hash(text_col).alias("of_hash"), filled(text_col))
    found = whole.join(_some(least), F.col("of").eqNullSafe(F.col("id")) & (F.col("of_hash") == F.col("hash")))
    return materialise(found.groupBy("node").agg(F.first("text").alias("text")))


def _joined(hashes: list[np.ndarray], label: np.ndarray, asked: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Links (places in the list) by which sets of this similarity join the labelled groups that
    they are in; at least one of the linked is asked for. The first set is compared first, and
    what it joins is not compared with each other."""
    size = np.array([len(h) for h in hashes])
    flat, owner = np.concatenate(hashes), np.repeat(np.arange(len(hashes)), size)
    _, column, found_in = np.unique(flat, return_inverse=True, return_counts=True)
    some = found_in[column] > 1  # others are in no intersection
    dense = np.cumsum(found_in > 1) - 1
    owner, column = owner[some], dense[column[some]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + COLUMNS, COLUMNS))
    left, right, label = [], [], label.copy()

    def compare(those: np.ndarray) -> None:
        both = np.zeros((len(those), len(hashes)), np.float32)
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part = np.zeros((len(hashes), COLUMNS), np.float32)
            part[owner[lo:hi], column[lo:hi] - k * COLUMNS] = 1
            both += part[those] @ part.T
        near = both >= similarity * (size[those][:, None] + size[None, :] - both) - SLACK
        near &= (label[those][:, None] != label[None, :]) & (size[those] > 0)[:, None]
        for a, b in zip(*np.nonzero(near), strict=True):
            a = those[a]
            if label[a] != label[b]:
                left.append(int(a))
                right.append(int(b))
                label[label == label[b]] = label[a]

    if asked[0]:
        compare(np.array([0]))
    rest = np.flatnonzero(asked & (label != label[0])) if asked[0] else np.flatnonzero(asked)
    for at in range(0, len(rest), BLOCK_TEXTS):
        compare(rest[at : at + BLOCK_TEXTS])
    return left, right


def _compare(rows: DataFrame, similarity: float, width: int) -> DataFrame:
    """From rows (head, i, j, node, label, asked, text), sorted so that those of one block
    follow each other, the head first: (a, b), the links that join labels."""
    names = ("node", "label", "asked", "text")

    def work(block: dict[str, list]) -> pa.RecordBatch:
        at = {node: k for k, node in reversed(list(enumerate(block["node"])))}  # a node may come once as asked for
        first = sorted(at.values())
        asked = {node for node, a in zip(block["node"], block["asked"], strict=True) if a}
        nodes = [block["node"][k] for k in first]
        hashes = [shingle_hashes(block["text"][k].encode(), width) for k in first]
        label = np.array([block["label"][k] for k in first], np.int64)
        a, b = _joined(hashes, label, np.array([x in asked for x in nodes]), similarity)
        return pa.record_batch([pa.array([nodes[k] for k in x], pa.int64()) for x in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, block = None, {}
        for batch in batches:
            groups = zip(*(batch.column(c).to_pylist() for c in ("head", "i", "j")), strict=True)
            for group, *values in zip(groups, *(batch.column(c).to_pylist() for c in names), strict=True):
                if group != of:
                    if of is not None:
                        yield work(block)
                    of, block = group, {c: [] for c in names}
                for c, x in zip(names, values, strict=True):
                    block[c].append(x)
        if of is not None:
            yield work(block)

    small_batches(rows.sparkSession)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(partitions, "head", "i", "j")
    dealt = dealt.sortWithinPartitions("head", "i", "j", F.col("node") != F.col("head"), "node", F.col("asked").desc())
    return dealt.mapInArrow(run, "a long, b long")


def similar_pairs(df: DataFrame, rows: DataFrame, width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(a, b): pairs of shingle sets of this similarity, enough of them to connect all that any
    such pairs connect."""
    keyed = rows.select(F.explode("keys").alias("key"), "node", "size")
    heads = keyed.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last").select("key", "head")
    members = keyed.join(heads, "key").select("head", "node", "size").distinct()  # the head is one
    shape = members.groupBy("head").agg(F.count("*").alias("texts"), F.sum("size").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("texts") / BLOCK_TEXTS), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    members = members.join(shape.select("head", blocks.cast("int").alias("blocks")), "head")
    members = materialise(members.withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    pairs = members.select(F.col("head").alias("a"), F.col("node").alias("b"))
    texts = _texts_of(df, rows, pairs, id_col, text_col)

    # each block with its head
    own = members.where("node <> head").select("head", "i", F.lit(0).alias("j"), "node")
    led = members.select("head", "blocks").distinct().select("head", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("j"), F.col("head").alias("node"))
    asked = own.unionAll(led).withColumns({"label": F.col("node"), "asked": F.lit(True)})
    linked = materialise(_compare(asked.join(texts, "node"), similarity, width))

    # in groups of several blocks, those apart from the head's component with all
    labels = materialise(connected_components(linked))
    many = members.where("blocks > 1").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_head = many.where("node = head").select("head", F.col("label").alias("head_label"))
    many = materialise(many.join(of_head, "head").withColumn("asked", F.col("label") != F.col("head_label")))
    apart = many.where("asked").groupBy("head").agg(F.ceil(F.count("*") / BLOCK_TEXTS).cast("int").alias("parts"))
    many = many.join(apart, "head")
    kinds = ["head", "i", "j", "node", "label", "asked"]
    all_ = many.withColumns({"asked": F.lit(False), "j": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))}).select(*kinds)
    part = F.pmod(F.xxhash64(F.lit("part"), "node"), F.col("parts")).cast("int")
    ask = many.where("asked").withColumns({"j": part, "i": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))}).select(*kinds)
    rest = materialise(all_.unionAll(ask))
    if rest.isEmpty():
        return linked
    return linked.unionAll(_compare(rest.join(texts, "node"), similarity, width))


def near_duplicates(df: DataFrame, width: int = 5, max_diff: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint hex string, component_id) for each row; fingerprints are linked, whatever their texts. ``deduplicate``
    links by the similarity of texts."""
    rows = materialise(fingerprints(df, width, id_col, text_col).withColumn("node", F.col("fp")))
    prints = materialise(rows.select("fp").distinct())
    pairs = links(prints, max_diff)
    nodes = materialise(rows.groupBy("node").agg(F.min("id").alias("root")))
    labels = connected_components(pairs)
    named = materialise(nodes.join(labels, "node", "left").select("node", "root", F.coalesce("label", "node").alias("label")))
    least = named.groupBy("label").agg(F.min("root").alias("component_id"))
    of = materialise(named.select("node", "label").join(least, "label").select("node", "component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(of, "node").select(F.col("id").alias(id_col), hexed, "component_id")


def deduplicate(df: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of near-duplicates: that of the smallest id (null last),
    then name of the shingle set, then hash of the text. Of rows that repeat with their id, one
    stays. Texts link at this Jaccard similarity of their shingle sets."""
    n = df.count()
    common = common_shingles(df, width, text_col)
    rows = materialise(shingle_rows(df, width, similarity, n, common, id_col, text_col))
    labels = connected_components(similar_pairs(df, rows, width, similarity, id_col, text_col))
    counted = rows.groupBy("id", "hash", "node").agg(F.count("*").alias("n"))
    counted = materialise(counted.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "node", "hash"))
    groups = counted.groupBy("label").agg(first.alias("first"), F.sum("n").alias("rows")).where("rows > 1")
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("hash") == F.col("first.hash"))
    more = materialise(counted.join(groups, "label").select("id", "hash", "n", is_first.alias("first")))

    names = ["__heddle_id", "__heddle_hash"]
    if {*names} & {*df.columns}:
        raise ValueError("names that begin with __heddle are taken")
    hashed = df.withColumn("__heddle_text", _text_hash(text_col))
    same = F.col(id_col).eqNullSafe(F.col(names[0])) & (F.col("__heddle_text") == F.col(names[1]))
    drop = materialise(more.where("not first or n > 1").select("id", "hash").toDF(*names))
    kept = hashed.join(_some(drop), same, "left_anti").select(*df.columns)
    repeated = materialise(more.where("first and n > 1").select("id", "hash").toDF(*names))
    if repeated.isEmpty():
        return kept
    them = hashed.join(_some(repeated), same).groupBy(*names).agg(F.first(F.struct(*df.columns)).alias("row"))
    return kept.unionAll(them.select("row.*"))
