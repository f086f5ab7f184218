"""Encoding whole texts by their white-space-delimited words, each word once.

The pre-tokenizer of the word-end BPE vocabulary drops white space, and no merge, normalisation
or added token reaches across it, so a text's ids are those of its words one after the other.
Words repeat; a worker remembers the first ones' ids in a bounded table and gives the library
only those it hasn't. New words made of letters are encoded together, as one text: each is one
pre-token, whose last token has the word end. Closing punctuation after a Latin, Greek or Cyrillic
letter that stays one when normalised is a pre-token of its own, and is cut off first.
"""

from __future__ import annotations

import string
import unicodedata

import numpy as np

from heddle.llm.token_counts import tokenizer

#: Words that a worker remembers, and the longest of them; the table is emptied when eight times
#: as many others have come by since it was full.
MEMO_WORDS, MEMO_CHARS = 400_000, 48
END = "</w>"
CLOSING = string.punctuation

#: Letters before which closing punctuation may be cut off: each is one letter when normalised.
FIRM = frozenset(c for c in map(chr, range(0x530)) if c.isalpha() and unicodedata.normalize("NFC", c).lower().isalpha())

_loaded: dict[str, WordMemo] = {}


def word_memo(path: str) -> WordMemo:
    if path not in _loaded:
        _loaded[path] = WordMemo(tokenizer(path))
    return _loaded[path]


class WordMemo:
    def __init__(self, tok):
        self.tok = tok
        self.known: dict[str, bytes] = {"": b""}
        self.missed = 0
        self.packed = [i.to_bytes(4, "little") for i in range(tok.get_vocab_size(with_added_tokens=True))]
        vocab = tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(END)]] = True

    def _whole(self, words: list[str]) -> list[bytes]:
        packed = self.packed
        return [b"".join([packed[i] for i in e.ids]) for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Of words made of letters, by one call."""
        ids = np.array(self.tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(stops) != len(words):  # a letter that normalises to something else
            return self._whole(words)
        data, starts = ids.tobytes(), [0, *stops[:-1].tolist()]
        return [data[a:b] for a, b in zip(starts, stops.tolist(), strict=True)]

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words. ASCII letters normalise to lower case and are one pre-token, so they
        go to the merges at once."""
        known, packed, merge = self.known, self.packed, self.tok.model.tokenize
        found: dict[str, bytes] = {}
        bases: dict[str, str] = {}
        odd, letters = [], []
        for w in words:
            base = w if w.isalpha() else w.rstrip(CLOSING)
            if len(base) > MEMO_CHARS or not base.isalpha() or (base is not w and base[-1] not in FIRM):
                odd.append(w)
                continue
            if base is not w:
                bases[w] = base
            if base in known or base in found:
                continue
            if base.isascii():
                found[base] = b"".join([packed[t.id] for t in merge(base.lower())])
            else:
                found[base] = b""
                letters.append(base)
        if letters:
            found.update(zip(letters, self._letters(letters), strict=True))
        tails = {w[len(b) :] for w, b in bases.items()}.difference(known)
        other = [*odd, *tails]
        if other:
            found.update(zip(other, self._whole(other), strict=True))
        for w, b in bases.items():
            t = w[len(b) :]
            found[w] = (known[b] if b in known else found[b]) + (known[t] if t in known else found[t])
        return found

    def batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers. New words of all texts are
        encoded together."""
        known, parts, missing = self.known, [], {}
        for text in texts:
            words = text.replace("\n", " ").split(" ")
            found = list(map(known.get, words))
            if None in found:
                at = [k for k, x in enumerate(found) if x is None]
                new = [words[k] for k in at]
                missing.update(dict.fromkeys(new))
                parts.append((found, at, new))
            else:
                parts.append((found, (), ()))
        if missing:
            encoded = self._encode(list(missing))
            for found, at, new in parts:
                for k, w in zip(at, new, strict=True):
                    found[k] = encoded[w]
            if len(known) < MEMO_WORDS:
                known.update((w, x) for w, x in encoded.items() if len(w) <= MEMO_CHARS)
            else:
                self.missed += len(encoded)
                if self.missed > 8 * MEMO_WORDS:
                    self.missed = 0
                    known.clear()
                    known[""] = b""
        return [b"".join(found) for found, _, _ in parts]

    def ids(self, text: str) -> bytes:
        return self.batch([text])[0]
