import random
import re
import zlib
from collections import Counter

from helpers import no_rows, odd_rows, table
from oracle import compare
from pyspark.sql import functions as F

from heddle.llm import spelling
from heddle.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans(spelling.UPPER, spelling.UPPER.lower())


def counted(rows, min_chars=6, min_count=5):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            words[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return {w: n for w, n in words.items() if len(w) >= min_chars and n >= min_count}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(known):
    near = {w: [x for x in known if one_apart(w, x)] for w in known}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-known[x], x), default=None)
        form[w] = best if best is not None and known[best] >= 5 * known[w] else None
    for w, n in known.items():
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, form[w], root, n, len(near[w]), known.get(form[w])


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_whole_table(spark, small):
    query = QUERIES["op12_spelling_variants"](spark, small)
    docs = [(r.doc_id, r.text) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    assert rows(query) == sorted(brute(counted(docs)), key=repr)
    got, expected = compare(query, ORACLES["op12_spelling_variants"], small)
    assert got == expected


def test_chains_ties_and_clashing_keys(spark):
    rng = random.Random(5)
    letters = "abßé"
    words = {"".join(rng.choices(letters, k=rng.randint(3, 6))): rng.choice([1, 1, 2, 5, 6, 25, 30, 125, 700]) for _ in range(400)}
    df = spark.createDataFrame([(w,) for w, n in words.items() for _ in range(n)], "word string").repartition(7)
    got = rows(spelling.variants(df, min_chars=1, min_count=1))
    assert got == sorted(brute(words), key=repr)
    assert any(root not in (form, word) for word, form, root, *_ in got)
    # characters that repeat: each pair still counts once
    same = {"aaaaaa": 40, "aaaaaaa": 8, "aaaaab": 5, "baaaaa": 5, "ababab": 9, "bababa": 9}
    df = spark.createDataFrame([(w,) for w, n in same.items() for _ in range(n)], "word string")
    assert rows(spelling.variants(df)) == sorted(brute(same), key=repr)


def test_a_key_that_many_words_share_stays_bounded(spark):
    stem, letters = "abcdefgh", "abcdefghijklmnopqrstuvwxyz"
    words = {stem[:k] + c + stem[k:] for k in range(9) for c in letters} | {stem[:k] + c + stem[k + 1 :] for k in range(8) for c in letters}
    df = spark.createDataFrame([(w,) for w in words for _ in range(5)] + [(stem,)] * 100, "word string")
    known = dict.fromkeys(words, 5) | {stem: 105}
    assert rows(spelling.variants(df)) == sorted(brute(known), key=repr)


def test_odd_rows(spark):
    df = odd_rows(spark)
    docs = [(r.doc_id, r.text) for r in df.collect()] * 5
    five = df
    for _ in range(4):
        five = five.unionAll(df)
    assert rows(spelling.variants(spelling.words_with_slips(five))) == sorted(brute(counted(docs)), key=repr)
    assert spelling.variants(spelling.words_with_slips(no_rows(spark))).count() == 0
    assert spelling.variants(spelling.words_with_slips(df.withColumn("text", F.lit(None).cast("string")))).count() == 0
    assert sorted(r.word for r in spelling.word_rows(df.where("doc_id = 6")).collect()) == ["endoftext", "é"]


def test_core_is_native(spark, small):
    plan = spelling.near_words(spelling.vocabulary(spelling.words_with_slips(table(spark, small, "documents"))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
