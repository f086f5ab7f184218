import random
import zlib

import pytest
from helpers import LONG, no_rows, odd_rows, table
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.llm import runs
from heddle.llm.queries import QUERIES


def brute(words, least=24, exponent=3):
    """Every period by itself: maximal stretches of equal words at that distance, smallest periods only."""
    found, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, exponent * q):
                part = words[s : i + q]
                if not any(all(part[k] == part[k + r] for k in range(len(part) - r)) for r in range(1, q)):
                    found.append((s, len(part), q))
            i += i == s
    return sorted(found)


def brute_collapsed(words, found):
    bad = {k for s, n, q in found for k in range(s + q, s + n)}
    return [w for k, w in enumerate(words) if k not in bad]


def planted(rng, letters, n):
    words = [rng.choice("abcd"[:letters]) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n else 0):
        a, e = sorted((rng.randrange(n), rng.randint(0, n)))
        p = rng.randint(1, max(1, (e - a) // 3))
        for i in range(a, e):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("letters", [1, 2, 3, 4])
def test_runs_equal_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(1500):
        words = planted(rng, letters, rng.randint(0, 90))
        for least in (3, 24):
            found = brute(words, least)
            assert runs.runs_of(words, least) == found
            assert runs.collapsed(words, found) == brute_collapsed(words, found)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["a", "b", "ab"]), max_size=60))
def test_any_words(words):
    assert runs.runs_of(words, 3) == brute(words, 3)


def families(n):
    fib, last = "ab", "a"
    while len(fib) < n:
        fib, last = fib + last, fib
    rng = random.Random(3)
    yield "one letter", "a" * n, 2.5
    yield "random", "".join(rng.choices("ab", k=n)), 4
    yield "periodic", "".join(rng.choices("ab", k=997)) * (n // 997), 5
    yield "growing blocks", "".join("a" * k + "b" for k in range(1, int((2 * n) ** 0.5))), 5
    yield "falling blocks", "".join("a" * k + "b" for k in range(int((2 * n) ** 0.5), 1, -1)), 6
    yield "nested", ((("a" * 9 + "b") * 9 + "c") * 9 + "d") * (n // 830), 6
    yield "fibonacci", fib[:n], 9
    yield "thue-morse", "".join("ab"[k.bit_count() & 1] for k in range(n)), 9


def test_comparisons_stay_within_a_few_a_word():
    for name, words, most in families(60_000):
        assert runs.Lyndon(list(words)).compared <= most * len(words), name


def test_a_text_of_a_million_words():
    words = [b"w%d" % (k * 7919 % 10007) for k in range(200_000)] + [b"x", b"y", b"z"] * 200_000 + [b"end"] * 200_000
    assert runs.runs_of(words) == [(0, 200_000, 10007), (200_000, 600_000, 3), (800_000, 200_000, 1)]


def looped(text, doc_id):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(text, doc_id):
    import hashlib

    words = looped(text, doc_id)
    found = brute(words) if len(words) < 3000 else runs.runs_of(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join("{},{},{}\n".format(*r) for r in found)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha(lines.encode()), sha(b" ".join(brute_collapsed(words, found))), len(words))


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_whole_table(spark, small):
    docs = table(spark, small, "documents").collect()
    got = QUERIES["op11_periodic_runs"](spark, small)
    assert rows(got) == sorted(repr(expected(r.text, r.doc_id)) for r in docs)
    assert got.where("n_runs > 0").count() > 10


def test_odd_rows(spark):
    df = odd_rows(spark)
    edited = runs.looped(df)
    assert rows(runs.digests(edited)) == sorted(repr(expected(r.text, r.doc_id)) for r in df.collect())
    assert runs.digests(runs.looped(no_rows(spark))).count() == 0
    collapsed = {r.doc_id: r.collapsed for r in runs.periodic_runs(df).collect()}
    assert collapsed[3] == collapsed[5] == "" and len(collapsed[4]) < len(LONG) / 2
    empty = {r.doc_id: (r.n_runs, r.start, r.period) for r in runs.digests(df).collect()}
    assert empty[2] == empty[3] == (0, None, None)


def test_blanks_are_ascii_only(spark):
    df = spark.createDataFrame([(1, "a\u00a0b " * 30 + "x\x1fy\x0bz")], "doc_id long, text string")
    row = runs.periodic_runs(df).first()
    assert row.n_words == 32 and [tuple(r) for r in row.runs] == [(0, 30, 1)] and row.collapsed == "a\u00a0b x\x1fy z"
