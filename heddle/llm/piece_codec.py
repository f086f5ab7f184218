"""Exact encoding with a merge-type (BPE) SentencePiece model by backtracking, and decoding.

The library's merge loop is not run over the text. Instead:

1. The text is escaped as the library does (a mark before it, spaces become marks) and cut where
   no piece can reach: before a run of marks, and between characters that stand together in no piece
   (those outside the vocabulary become byte pieces). The cuts are read off the vocabulary, not assumed.
2. In each unit, an Aho-Corasick automaton of all pieces gives the longest piece at each place.
   From left to right the longest piece is taken whose re-merged concatenation with the piece
   before it gives back those two pieces (checked by merging, remembered by pair). Where none
   fits, the place goes into a bitfield of failed positions and the piece before it is shortened.
   A sequence whose neighbours are all compatible is the merge loop's own result, and a place's
   prefix has one such sequence, so a failed place is never tried twice.
3. Runs of marks longer than one have pieces of equal rank, merged leftmost first after all
   others; their split repeats with the longest such piece.

Units repeat, so each worker remembers the last ones (bounded). Decoding is the library's own.

Nulls and empty texts have no ids and decode to the empty text; ids may be null or repeat; one
row comes out for each that goes in, and none for none; other columns are not read. A text of any
length is encoded in one task, a unit at a time.
"""

from __future__ import annotations

import hashlib
from itertools import chain
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import filled, map_batches, texts

MARK = "▁"
#: Units, their parts and pairs of pieces that a worker remembers; beyond it the memory is emptied.
MEMO_UNITS, MEMO_PARTS, MEMO_PAIRS = 400_000, 400_000, 400_000
#: Longer units are encoded anew each time.
MEMO_CHARS = 40

_loaded: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _loaded:
        _loaded[path] = PieceCodec(path)
    return _loaded[path]


def merged(symbols: list[str], score: dict[str, float]) -> list[str]:
    """Merge the best-scored neighbours, leftmost first among equals, until none is a piece."""
    symbols = list(symbols)
    while True:
        best, at = None, -1
        for k in range(len(symbols) - 1):
            s = score.get(symbols[k] + symbols[k + 1])
            if s is not None and (best is None or s > best):
                best, at = s, k
        if best is None:
            return symbols
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]


class PieceCodec:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, proto.ModelProto.SentencePiece
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback, the identity normaliser and a leading mark is needed")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined or unused pieces are not supported")
        score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.id = {p.piece: k for k, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.byte = [self.processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(MARK in x[1:] and x.strip(MARK) for x in score):
            raise ValueError("a piece has a mark after another character")
        marks = {x: s for x, s in score.items() if len(x) > 1 and not x.strip(MARK)}
        self.score = {x: s for x, s in score.items() if x not in marks}
        if marks and max(marks.values()) >= min(s for x, s in self.score.items() if len(x) > 1):
            raise ValueError("runs of marks must merge after all else")
        self.mark_score, self.period = {MARK: 0.0, **marks}, max(map(len, marks), default=1)
        self.single = {x for x in score if len(x) == 1}
        self.auto = ahocorasick.Automaton()
        for x in self.score:
            self.auto.add_word(x, (len(x) - 1, x))
        self.auto.make_automaton()
        self.spine: dict[str, tuple[list, list] | None] = {}
        self.inside = {x[k : k + 2] for x in self.score for k in range(len(x) - 1)}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.first: dict[str, tuple[int, ...]] = {}
        self.later: dict[str, tuple[int, ...]] = {}
        self.missed = 0
        self.runs: dict[int, tuple[int, ...]] = {}
        self.cut_lines = "\n" not in self.single
        self.decimal = [str(k) for k in range(len(model.pieces))]

    def spines(self, piece: str) -> tuple[list, list] | None:
        """The symbols that stand at the piece's right and left end while its characters merge,
        each with the rank of the merge that ends it. None if its merges aren't in rank order."""
        if piece in self.spine:
            return self.spine[piece]
        symbols, right, left, last, ordered = [*piece], [], [], -1.0, True
        while len(symbols) > 1:
            ranks = [-self.score.get(x + y, float("-inf")) for x, y in zip(symbols, symbols[1:], strict=False)]
            rank = min(ranks)
            k = ranks.index(rank)
            ordered &= last <= rank < float("inf")
            if not ordered:
                break
            if k == len(symbols) - 2:
                right.append((symbols[-1], rank))
            if k == 0:
                left.append((symbols[0], rank))
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            last = rank
        end = [(piece, float("inf"))]
        self.spine[piece] = (right + end, left + end) if ordered else None
        return self.spine[piece]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the characters of both gives back just these two.

        It does unless, on the way, a symbol at the left one's end and one at the right one's
        start merge before either is taken by its own side; among equal ranks the merge further
        left comes first. Pieces with merges out of rank order are merged as a whole.
        """
        key = (left, right)
        if (known := self.fits.get(key)) is None:
            if len(self.fits) >= MEMO_PAIRS:
                self.fits.clear()
            a, b = self.spines(left) if left else ([], []), self.spines(right)
            if a is None or b is None:
                known = merged([*left, *right], self.score) == [x for x in key if x]
            else:
                score = self.score
                known = True
                for x, until_x in a[0]:
                    for y, until_y in b[1]:
                        s = score.get(x + y)
                        if s is not None and -s < until_x and -s <= until_y:
                            known = False
            self.fits[key] = known
        return known

    def pieces(self, unit: str) -> list[str]:
        """The pieces of a unit, all of whose characters are in the vocabulary."""
        size, score, fits, compatible = len(unit), self.score, self.fits, self.compatible
        longest = [""] * size
        for end, (n, x) in self.auto.iter(unit):  # for one start, longer ones come later
            longest[end - n] = x
        failed = 0  # bit p: no compatible sequence goes on from p
        out: list[str] = []
        at, piece, before = 0, longest[0], ""
        while True:
            if not (failed and failed >> (at + len(piece)) & 1):
                fit = fits.get((before, piece))
                if compatible(before, piece) if fit is None else fit:
                    out.append(piece)
                    at += len(piece)
                    if at == size:
                        return out
                    before, piece = piece, longest[at]
                    continue
            piece = piece[:-1]
            while piece not in score:
                if not piece:  # none is left here, so the piece before is shortened
                    failed |= 1 << at
                    piece = out.pop()
                    at -= len(piece)
                    before = out[-1] if out else ""
                piece = piece[:-1]

    def part_ids(self, part: str) -> tuple[int, ...]:
        known = part[0] in self.single
        ids = tuple([self.id[x] for x in self.pieces(part)] if known else [self.byte[b] for c in part for b in c.encode()])
        if len(part) <= MEMO_CHARS:
            if len(self.parts) >= MEMO_PARTS:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def unit_ids(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit, cut between neighbours that stand together in no piece. Characters
        outside the vocabulary are in no piece, so they are cut off too, and become bytes."""
        inside, known = self.inside, self.parts.get
        cuts = [k for k, pair in enumerate(map(add, unit, unit[1:]), 1) if pair not in inside]
        if not cuts:
            return (known(unit) or self.part_ids(unit)) if unit else ()
        ids: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True):
            part = unit[a:b]
            ids += known(part) or self.part_ids(part)
        return tuple(ids)

    def run_ids(self, n: int) -> tuple[int, ...]:
        """Ids of n marks that no other piece takes."""
        if n > self.period:
            return self.run_ids(self.period) * (n // self.period) + self.run_ids(n % self.period)
        if n not in self.runs:
            self.runs[n] = tuple(self.id[x] for x in merged([MARK] * n, self.mark_score)) if n else ()
        return self.runs[n]

    def remembered(self, memo: dict[str, tuple[int, ...]], word: str, prefix: str) -> tuple[int, ...]:
        ids = memo.get(word)
        if ids is None:
            ids = self.unit_ids(prefix + word)
            if len(word) <= MEMO_CHARS:
                if len(memo) < MEMO_UNITS:
                    memo[word] = ids
                else:  # keep the frequent early ones until many others have come by
                    self.missed += 1
                    if self.missed > 8 * MEMO_UNITS:
                        self.missed = 0
                        memo.clear()
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        parts: list[tuple[int, ...]] = []
        take, known, alone = parts.append, self.later.get, (self.id[MARK],)
        text = text.replace(MARK, " ")
        for k, line in enumerate(text.split("\n") if self.cut_lines else [text]):
            words, waiting = line.split(" "), 0
            if k:
                take((self.byte[10],))
                if words[0]:
                    take(self.remembered(self.first, words[0], ""))
                words = words[1:]
            if "" not in words:
                found = list(map(known, words))
                if None in found:
                    found = [self.remembered(self.later, w, MARK) if ids is None else ids for w, ids in zip(words, found, strict=True)]
                parts += found
                continue
            for w in words:
                if not w:  # a mark, and another follows it
                    waiting += 1
                    continue
                ids = known(w) or self.remembered(self.later, w, MARK)
                if waiting:
                    if ids[:1] == alone:  # the last mark stays with the run
                        take(self.run_ids(waiting + 1))
                        ids = ids[1:]
                    else:
                        take(self.run_ids(waiting))
                    waiting = 0
                take(ids)
            if waiting:
                take(self.run_ids(waiting))
        return list(chain.from_iterable(parts))

    def decimals(self, ids: list[int]) -> bytes:
        """Ids in decimal, joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids)).encode()

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) for each row."""

    def make():
        c = codec(path)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [c.encode(x) for x in texts(batch)]
            return pa.record_batch([batch.column("id"), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())], ["id", "ids", "decoded"])

        return one

    rows = df.select(F.col(id_col).alias("id"), filled(text_col))
    return map_batches(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode_decode's rows without the long columns."""

    def make():
        c = codec(path)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, of_ids, of_text = [], [], []
            for x in texts(batch):
                ids = c.encode(x)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(c.decimals(ids)).hexdigest())
                of_text.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            return pa.record_batch([batch.column("id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return one

    rows = df.select(F.col(id_col).alias("id"), filled(text_col))
    return map_batches(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
