import random
import time

import pytest
from helpers import LONG, ODD, no_rows, odd_rows, table

from heddle.llm import word_memo
from heddle.llm.queries import WORD_BPE, vocabulary
from heddle.llm.token_counts import long_ids, token_counts, tokenizer

PATH = vocabulary(WORD_BPE)
PARTS = ["a", "b", "the ", "é", "1", "2", " ", "\n", "<|endoftext|>", "\t", " ", "é", "ing", "Σ", "ſ", "!!", "'s", "'ll", "ﬁ", "日本", "\x1c", "\x85", "\r\n", " ́", " ", "İ"]


def whole(text):
    return tokenizer(PATH).encode(text, add_special_tokens=False).ids


def test_chunks_splice_to_the_whole():
    rng = random.Random(1)
    for k in range(800):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 300)))
        text = text.replace(" ", "").replace("\n", "") if k % 7 == 0 else text
        assert long_ids(tokenizer(PATH), text, rng.choice([8, 20, 50]), rng.choice([2, 5, 16])) == whole(text)


def test_places_are_cut_in_any_surroundings():
    rng = random.Random(6)
    kinds = "aZéßΣσЖ日本のカ가힣שعकก09٣!?.,'-=<>|。「」 \n\t\u0301\u3099\u1161\u11a8\u09be\u00a0\u0085İŉﬁ½Ⅷ"
    parts = [*kinds, "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "e\u0301", "=\u0338"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 120)))
        assert long_ids(tokenizer(PATH), text, rng.choice([6, 12, 30]), rng.choice([2, 4, 9])) == whole(text), text
    wide = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000]
    for _ in range(2000):
        text = "".join(rng.choice(wide if rng.random() < 0.6 else kinds) for _ in range(80))
        assert long_ids(tokenizer(PATH), text, 12, 4) == whole(text), text


@pytest.mark.parametrize("alphabet", ["etaoin", "的一是不了人我在有他。", "abcXYZ019+/", "กขคงจา", "=-*#", "の日本カ"])
def test_time_is_linear_without_white_space(alphabet):
    text = "".join(random.Random(7).choices(alphabet, k=2_000_000))
    began = time.process_time()
    expected = whole(text)
    library = time.process_time() - began
    began = time.process_time()
    assert long_ids(tokenizer(PATH), text) == expected
    assert time.process_time() - began < 10 * library


def test_words_join_to_the_whole(monkeypatch):
    monkeypatch.setattr(word_memo, "MEMO_WORDS", 30)
    memo, rng = word_memo.WordMemo(tokenizer(PATH)), random.Random(2)
    for _ in range(800):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 80)))
        assert memo.ids(text) == b"".join(i.to_bytes(4, "little") for i in whole(text))


def test_odd_rows(spark):
    rows = token_counts(odd_rows(spark), PATH, limit=3).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted((len((x or "").encode()), len(whole(x or "")), len(whole(x or "")) > 3) for _, x in ODD)
    assert sum(r.doc_id is None for r in rows) == 2
    assert len(LONG) > 100_000
    assert token_counts(no_rows(spark), PATH).count() == 0


@pytest.mark.parametrize("chunk", [16_384, 500])
def test_whole_table(spark, small, chunk):
    docs = table(spark, small, "documents")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, PATH, chunk_chars=chunk).collect()}
    assert got == {r.doc_id: len(whole(r.text or "")) for r in docs.collect()}
