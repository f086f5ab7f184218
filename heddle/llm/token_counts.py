"""Token counts of whole texts, huge ones by overlap resynchronisation.

A short text is encoded word by word, each new word once (see word_memo). A text longer than
``chunk_chars`` is encoded in chunks that overlap by ``overlap_chars``, each with offsets. Two neighbours are spliced at a common
boundary that is *proven* stable:

* it lies in the overlap where the pre-tokenizer always cuts, whatever stands around it (``CUT``): before
  white space, on either side of a digit, between a letter and a punctuation mark (but not after an
  apostrophe, which may begin a contraction). The characters on both sides are of scripts where no
  normalisation reaches across or changes the kind, and it is in no added token. No merge
  crosses such a place, so what stands before it cannot change what stands after it; and
* from there to the last such place of the overlap, both encodings give the same ids at the
  same offsets.

Where the overlap has no such place, or the encodings differ, the overlap is doubled, up to the whole
of the left chunk; then the chunk itself is, so that a run of letters without any such place is encoded
as one. Both grow geometrically, so the work stays in proportion to the text, with white space
or without. So the counts are those of the whole text.

Nulls count as empty texts, which have no tokens; ids may be null or repeat; one row comes out
for each row that goes in, no rows give none; columns besides the id and the text are not read.
"""

from __future__ import annotations

import re
import string
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import filled, map_batches, single_threaded, texts

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256


def _cut_places() -> re.Pattern:
    """Places between two characters where the pre-tokenizer cuts in any surroundings."""
    # letters that are one letter when normalised, and do not join with what precedes them
    small = "".join(c for c in map(chr, range(0x41, 0x530)) if c.isalpha() and len(x := unicodedata.normalize("NFC", c).lower()) == 1 and x.isalpha())
    ranges = ((0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
    letter = small + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)
    mark = re.escape(string.punctuation) + "\u3001-\u3003\u3008-\u3011\uff01-\uff0f\uff1a-\uff20"
    no_apostrophe = mark.replace("'", "")
    white, digit = " \t\n\r", "0-9"
    cuts = ((f"^{white}", white), (digit, letter + digit + mark), (letter + mark, digit), (letter, mark), (no_apostrophe, letter))
    return re.compile("|".join(f"(?<=[{a}])(?=[{b}])" for a, b in cuts))


CUT = _cut_places()

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer, loaded once a process."""
    if path not in _loaded:
        single_threaded()
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _encode(tok, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """(start, end, id) of the tokens of text[start:end], in the text's own offsets."""
    found = tok.encode(text[start:end], add_special_tokens=False)
    return [(a + start, b + start, i) for (a, b), i in zip(found.offsets, found.ids, strict=True)]


def _places(tok, text: str, start: int, end: int) -> list[int]:
    """The cutting places in text[start:end] that are in no added token."""
    places = [m.start() for m in CUT.finditer(text, start, end)]
    for token in tok.get_added_tokens_decoder().values():
        size = len(token.content)
        at = text.find(token.content, max(0, start - size), end + size)
        while at >= 0:
            places = [p for p in places if not at < p < at + size]
            at = text.find(token.content, at + 1, end + size)
    return places


def _splice(places: list[int], left: list, right: list) -> int | None:
    """The first of the places from which on both encodings agree, or None; those of the first half
    only give the right one time to fall into step."""
    last = places[-1]
    for at in places[len(places) // 2 :]:
        if [t for t in left if t[0] >= at and t[1] <= last] == [t for t in right if t[0] >= at and t[1] <= last]:
            return at
    return None


def long_ids(tok, text: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> list[int]:
    """Ids of the whole text, from overlapping chunks."""
    n, trusted, overlap, ids = len(text), 0, overlap_chars, []
    end = min(n, chunk_chars)
    left = _encode(tok, text, 0, end)
    while end < n:
        begin = max(trusted, end - overlap)
        places, at = _places(tok, text, begin + 1, end), None
        if places:
            end_right = min(n, end + chunk_chars)
            right = _encode(tok, text, begin, end_right)
            at = _splice(places, left, right)
        if at is not None:
            ids += [i for a, b, i in left if a >= trusted and b <= at]
            left, trusted, end, overlap = right, at, end_right, overlap_chars
        elif begin > trusted:
            overlap *= 2
        else:  # the overlap is all of the left chunk that isn't spliced
            end, overlap = min(n, trusted + 2 * max(end - trusted, chunk_chars)), overlap_chars
            left = _encode(tok, text, trusted, end)
    return ids + [i for a, _, i in left if a >= trusted]


def token_counts(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, n_chars) for each row of ``df``."""

    def make():
        from heddle.llm.word_memo import word_memo

        tok, memo = tokenizer(path), word_memo(path)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            all_texts = texts(batch)
            counts = [len(ids) // 4 for ids in memo.batch([x if len(x) <= chunk_chars else "" for x in all_texts])]
            for k, x in enumerate(all_texts):
                if len(x) > chunk_chars:
                    counts[k] = len(long_ids(tok, x, chunk_chars, overlap_chars))
            columns = {
                "id": batch.column("id"),
                "n_bytes": pa.array([len(x.encode()) for x in all_texts], pa.int64()),
                "n_tokens": pa.array(counts, pa.int64()),
                "over_limit": pa.array([c > limit for c in counts], pa.bool_()),
                "n_chars": pa.array(map(len, all_texts), pa.int64()),
            }
            return pa.record_batch([*columns.values()], [*columns])

        return one

    rows = df.select(F.col(id_col).alias("id"), filled(text_col))
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, make, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_chars long").withColumnRenamed("id", id_col)
