import itertools
import random

import xxhash
from helpers import no_rows, odd_rows, shingle_set, table

from heddle.llm.components import connected_components
from heddle.llm.simhash import SMALL_SET, chain_length, common_shingles, deduplicate, fingerprint, keys_of, links, near_duplicates, no_chain, ring_size, shingle_hashes


def slow_fingerprint(text, width):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] if len(words) >= width else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(items, linked):
    label = {x: x for x in items}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {x: find(x) for x in items}


def test_fingerprint():
    rng = random.Random(1)
    for k in range(60):
        text = "".join(rng.choice(["Ab", "É", "c", " ", "\t", "\x0b", " ", "\x85", "d e"]) for _ in range(rng.randint(0, 60)))
        assert fingerprint(text.encode(), 3) == slow_fingerprint(text, 3), k
    text = "abc d " * 40_000
    assert fingerprint(text.encode(), 3) == slow_fingerprint(text, 3)


def test_links_equal_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for x in base:
        for _ in range(12):
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for tau in (0, 1, 2, 3, 6):
        got = {(r.a, r.b) for r in links(df, tau).collect()}
        assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= tau}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, 5001 + k) for k in range(50)] + [(7, 7), (None, 8)]
    df = spark.createDataFrame(edges, "a long, b long")
    expected = groups({x for e in edges for x in e if x is not None}, [e for e in edges if None not in e])
    got = {r.node: r.label for r in connected_components(df).collect()}
    assert got == {k: v for k, v in expected.items() if k != v}
    assert connected_components(df.limit(0)).count() == 0


def test_whole_table(spark, small):
    docs = table(spark, small, "documents")
    prints = {r.doc_id: fingerprint((r.text or "").encode(), 3) for r in docs.collect()}
    ids = sorted(prints)
    expected = groups(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    rows = near_duplicates(docs, 3, 2).collect()
    assert {r.doc_id: r.component_id for r in rows} == expected
    assert all(r.fingerprint == f"{prints[r.doc_id]:016x}" for r in rows)


def test_odd_rows(spark):
    rows = near_duplicates(odd_rows(spark), 3, 2).collect()
    assert len(rows) == 11
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {2} and len(zero) == 4
    assert near_duplicates(no_rows(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    df = odd_rows(spark)
    kept = deduplicate(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id is None, r.doc_id, r.text or "") for r in kept.collect()), key=str)
    assert [x[:2] for x in got].count((False, 1)) == 2 and len(got) == 6
    assert deduplicate(no_rows(spark)).count() == 0


def test_similarity_is_of_shingle_sets(spark):
    words = [f"w{k}" for k in range(400)]
    near = words.copy()
    near[200] = "changed"
    far = [w if k % 8 else "z" + w for k, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(words).upper())], "doc_id long, text string")
    kept = {r.doc_id for r in deduplicate(df).collect()}
    a, b = (shingle_set(" ".join(x).encode(), 5) for x in (words, near))
    assert len(a & b) / len(a | b) > 0.8
    assert 1 in kept and 3 in kept and 4 not in kept


def copies_at(rng, words, share):
    """Words with a run of them replaced, so that the fingerprint may go far and similarity stays."""
    n = int(len(words) * share)
    at = rng.randrange(len(words) - n)
    return words[:at] + [f"c{rng.randrange(10**9)}" for _ in range(n)] + words[at + n :]


def test_groups_are_those_of_jaccard_alone(spark):
    rng = random.Random(8)
    texts = [" ".join(["common phrase that stands on all pages"] * (k % 2) + [f"w{rng.randrange(10**9)}" for _ in range(3)]) for k in range(30)]
    for k in range(25):
        words = [f"w{k}x{rng.randrange(400)}" for _ in range(rng.choice((12, 60, 120, 150, 300, 1200)))]
        texts += [" ".join(copies_at(rng, words, share)) for share in (0, 0.02, 0.06, 0.09, 0.1, 0.11, 0.2)]
    sets = {k: shingle_set(x.encode(), 5) for k, x in enumerate(texts)}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    far = [(a, b) for a, b in pairs if (fingerprint(texts[a].encode(), 5) ^ fingerprint(texts[b].encode(), 5)).bit_count() > 6]
    assert len(far) > 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in deduplicate(df).collect()} == set(groups(sets, pairs).values())


def test_texts_with_one_fingerprint_are_tested(spark):
    texts = [" ".join(["run"] * 200 + [f"w{k}x{j}" for j in range(40)]) for k in range(3)]
    assert len({fingerprint(x.encode(), 5) for x in texts}) == 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in deduplicate(df).collect()} == {0, 1, 2}


def test_similar_sets_share_a_key():
    rng, none = random.Random(11), shingle_hashes(b"", 5)
    size = ring_size(0.8, 2)
    assert no_chain(size, 0.8, 2) <= 1e-8 and size < ring_size(0.8, 3) < ring_size(0.6, 3)
    assert [chain_length(10**k) for k in (0, 6, 7, 8, 9, 10)] == [2, 2, 3, 3, 4, 4]
    few = sum(not any(x and y for x, y in itertools.pairwise([rng.random() < 0.5 for _ in range(8)])) for _ in range(20_000))
    assert abs(few / 20_000 - no_chain(8, 0.5, 2)) < 0.02
    for _ in range(1500):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((7, 30, 100, SMALL_SET, SMALL_SET + 10, 500)))]
        other = copies_at(rng, words, rng.choice((0.02, 0.08, 0.1)))
        a, b = (shingle_hashes(" ".join(x).encode(), 5) for x in (words, other))
        both = len(set(a.tolist()) & set(b.tolist()))
        if both >= 0.8 * (len(a) + len(b) - both):
            assert set(keys_of(a, 0.8, size, 2, none).tolist()) & set(keys_of(b, 0.8, size, 2, none).tolist())


def test_pairs_within_one_fingerprint(spark):
    run = " ".join(["run"] * 200)
    texts = [f"{run} " + " ".join(f"w{k}x{j}" for j in range(n)) for k in range(3) for n in (40, 41)] + [""] * 3
    assert len({fingerprint(x.encode(), 5) for x in texts[:6]}) == 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in deduplicate(df).collect()} == {0, 2, 4, 6}


def test_groups_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr("heddle.llm.simhash.BLOCK_TEXTS", 8)
    rng = random.Random(21)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(copies_at(rng, copies_at(rng, words, 0.06), 0.05)) for _ in range(90)]
    sets = {k: shingle_set(x.encode(), 5) for k, x in enumerate(texts)}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    expected = groups(sets, pairs)
    assert 1 < len(set(expected.values())) < 90
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in deduplicate(df).collect()} == set(expected.values())


def test_common_shingles_are_counted_over_all_texts(spark):
    import numpy as np

    texts = [f"a{k} b{k} c{k} " + ("here it stands" if k % 3000 < 3 else f"d{k}") for k in range(9000)]  # in 9 of 9,000
    df = spark.createDataFrame([(x,) for x in [*texts, *texts[:50], "here it stands " * 300, None]], "text string")
    found = common_shingles(df, width=3, text_col="text")
    assert found.tolist() == shingle_hashes(b"here it stands", 3).tolist() and found.dtype == np.uint64
