import random
import zlib
from collections import Counter

from helpers import ODD, no_rows, odd_rows, table

from heddle.llm import packing
from heddle.llm.queries import WORD_BPE, vocabulary
from heddle.llm.token_counts import tokenizer

PATH = vocabulary(WORD_BPE)


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for r in {r for r in rooms if r >= items[k]}:
            rest = rooms.copy()
            rest.remove(r)
            place(k + 1, [*rest, r - items[k]])
        place(k + 1, [*rooms, capacity - items[k]])

    place(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    rng = random.Random(5)
    for _ in range(400):
        capacity = rng.choice([10, 12, 20])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        fixed, left = packing.reduce_instance(Counter(items), capacity)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(items, capacity)
        assert all(sum(p) <= capacity for p, _ in fixed)


def test_plan_uses_every_piece_once():
    rng = random.Random(6)
    for _ in range(200):
        sizes = Counter(min(64, int(rng.lognormvariate(2.5, 1)) + 1) for _ in range(rng.randint(1, 500)))
        patterns, back = packing.plan(sizes, 64), Counter()
        for pattern, n in patterns:
            assert sum(pattern) <= 64 and n > 0
            for s in pattern:
                back[s] += n
        assert back == sizes
        least = -(-sum(s * n for s, n in sizes.items()) // 64)
        assert sum(n for _, n in patterns) <= least * 1.3 + 1


def check(spark, rows, texts, capacity):
    tok = tokenizer(PATH)
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    expected = Counter()
    for i, text in texts:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            expected[i, piece, start, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert Counter((r[0], r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    return len(used), -(-sum(r.length for r in rows) // capacity)


def test_odd_rows(spark):
    rows = packing.pack(odd_rows(spark), PATH, 2048).collect()
    check(spark, rows, ODD, 2048)
    assert packing.pack(no_rows(spark), PATH).count() == 0


def test_whole_table_and_salts(spark, small, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 5)
    docs = table(spark, small, "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    for capacity in (2048, 64):
        used, least = check(spark, packing.pack(docs, PATH, capacity).collect(), texts, capacity)
        assert used <= least * 1.02 + 1
