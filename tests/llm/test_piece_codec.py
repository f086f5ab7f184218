import hashlib
import random

from helpers import ODD, no_rows, odd_rows, table

from heddle.llm.piece_codec import codec, digests, encode_decode, merged
from heddle.llm.queries import PIECE_BPE, vocabulary

PATH = vocabulary(PIECE_BPE)
PARTS = ["a", "b", "the ", "é", "1", "2", " ", "\n", "<|endoftext|>", "\t", " ", "ing", "Σ", "!!", "'s", "ﬁ", "日本", "\x1c", "\r\n", "  ", "    ", "▁", "<s>", "\x00", "<0x0A>", "ﷺ", "𝄞", "aaaa", "tion", "er", "   "]


def test_equals_the_library():
    c, rng = codec(PATH), random.Random(1)
    for k in range(4000):
        text = "".join(rng.choice(PARTS) if k % 4 else rng.choice("abehinorst ") for _ in range(rng.randint(0, 60)))
        ids = c.encode(text)
        assert ids == c.processor.encode(text)
        assert c.decode(ids) == c.processor.decode(ids)


def test_runs_of_marks():
    c = codec(PATH)
    for n in range(50):
        for text in (" " * n, " " * n + "the", " " * n + "\n", " " * n + "日", "a" + " " * n, "\n" + " " * n + "b"):
            assert c.encode(text) == c.processor.encode(text)


def test_compatibility_is_what_merging_gives():
    c, rng = codec(PATH), random.Random(3)
    pieces = list(c.score)
    for k in range(4000):
        a, b = rng.choice(pieces), rng.choice(pieces)
        if k % 2:
            whole = rng.choice(pieces)
            cut = rng.randint(1, max(1, len(whole) - 1))
            a, b = whole[:cut], whole[cut:]
        if a in c.score and b in c.score:
            assert c.compatible(a, b) == (merged([*a, *b], c.score) == [a, b])


def test_round_trip_and_odd_rows(spark):
    c = codec(PATH)
    rows = encode_decode(odd_rows(spark), PATH).collect()
    assert sorted(len(r.ids) for r in rows) == sorted(len(c.processor.encode(x or "")) for _, x in ODD)
    assert {r.decoded for r in rows} == {c.processor.decode(c.processor.encode(x or "")) for _, x in ODD}
    assert digests(no_rows(spark), PATH).count() == 0


def test_whole_table(spark, small):
    docs, p = table(spark, small, "documents"), codec(PATH).processor
    for r in digests(docs, PATH).join(docs, "doc_id").collect():
        ids = p.encode(r.text or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(p.decode(ids)))
