"""Secret scans: fixed patterns, and formats learnt from labelled credentials.

Three patterns give the base spans: assignments, access keys and long hex strings. What they find
in a bounded sample of documents labels credentials by kind; generated examples of published key
formats are added. For each kind an automaton is inferred from its examples, however few (see
grammar), one more from other long tokens of the sample. Each long token of each whole text, base spans'
included, is then scored: its log likelihood under the best kind less that under ordinary tokens. One
above ``MARGIN`` that overlaps no base span is a span of kind ``format``; so a credential of a format
that the corpus labels elsewhere is found where no pattern says so.

The sample is about ``FIT_DOCUMENTS`` documents by hash of their text; of each kind it gives
``FIT_EXAMPLES`` different values by hash, ``FIT_CHARS`` characters of them in all, and four times as many
ordinary tokens.

A null text is an empty one; ids may be null or repeat, and each row is scanned alone. Without documents, or
without labelled ones, the generated examples alone are learnt from; no rows give no rows. A text of
any length is scanned in one piece, in time linear in its spans, and so is a token of it. Columns besides the id and the
text are not read by ``find`` and ``scan``; ``redact`` passes them through.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import filled, map_batches, materialise, texts
from heddle.llm.grammar import TO_CLASS, Automaton

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
CANDIDATE = re.compile("[A-Za-z0-9+/_-]{16,}={0,2}")
#: Documents whose base spans are the labelled sample; examples of each kind, and characters of them, learnt from.
FIT_DOCUMENTS, FIT_EXAMPLES, FIT_CHARS = 20_000, 400, 40_000
#: Log of how much likelier a credential's format must be than an ordinary token's.
MARGIN = 6.0

_HEX, _ALNUM = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Published key formats as (prefix, alphabet, lengths of the rest).
FORMATS = (
    ("AKIA", _ALNUM[:26] + "234567", (16,)),
    ("ghp_", _ALNUM, (36,)),
    ("AIza", _ALNUM + "-_", (35,)),
    ("sk_live_", _ALNUM, (24,)),
    ("xoxb-", "0123456789-" + _ALNUM, (48,)),
    ("", _HEX, (32, 40, 64)),
    ("", _HEX.upper(), (32, 40, 64)),
    ("", _ALNUM + "+/", (40,)),
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in the order of starts, then of KINDS."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    for run in CANDIDATE.finditer(text):  # a long hex run is inside one of these
        if run.end() - run.start() >= LEAST_HEX:
            out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text, run.start(), run.end()) if m.end() - m.start() >= LEAST_HEX]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@dataclass
class Model:
    kinds: list[tuple[str, Automaton]]  # with the literal prefix that its tokens have
    ordinary: Automaton

    def score(self, token: str) -> float:
        """Log of how much likelier the token is a credential than an ordinary one."""
        classes, best = token.translate(TO_CLASS), float("-inf")
        for prefix, automaton in self.kinds:
            if token.startswith(prefix):
                best = max(best, automaton.log_likelihood(classes[len(prefix) :]))
        return best - self.ordinary.log_likelihood(classes)


def _value(text: str, start: int, end: int, kind: str) -> str:
    """The credential of a base span: of an assignment what is assigned."""
    return ASSIGN.match(text, start)[2] if kind == "assign" else text[start:end]


def _apart(text: str, base: list[tuple[int, int, str]]) -> Iterator[tuple[re.Match, bool]]:
    """Each candidate, and whether it overlaps no base span. Both are in order, so one walk over the spans does."""
    k, n, covered = 0, len(base), 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < n and base[k][0] < end:  # covered: up to where the spans that begin before reach
            covered = max(covered, base[k][1])
            k += 1
        yield m, covered <= start


def scored(text: str, model: Model) -> tuple[list[tuple[int, int, str]], float]:
    """Base spans and tokens apart from them that have a credential's format, and the best score of
    all candidates: long tokens and the values of base spans."""
    base = base_spans(text)
    more, best = [], float("-inf")
    for s, e, kind in base:
        best = max(best, model.score(_value(text, s, e, kind)))
    for m, apart in _apart(text, base):
        score = model.score(m[0])
        best = max(best, score)
        if score >= MARGIN and apart:
            more.append((m.start(), m.end(), "format"))
    return sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base, best


def spans(text: str, model: Model) -> list[tuple[int, int, str]]:
    return scored(text, model)[0]


def generated(n: int) -> dict[str, list[str]]:
    """Examples of the published formats."""
    rng = random.Random(20240229)
    return {f"{k}": [prefix + "".join(rng.choices(alphabet, k=rng.choice(sizes))) for _ in range(n)] for k, (prefix, alphabet, sizes) in enumerate(FORMATS)}


def harmless(n: int) -> list[str]:
    """Examples of long tokens that are no credentials: words in any case, joined words, numbers,
    dates and UUIDs."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bcdfghlmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    out = []
    for _ in range(n):
        words = [word() for _ in range(rng.randint(3, 5))]
        out += ["".join(words), "".join(words).upper(), "_".join(words), "-".join(words), "/".join(words), "".join(map(str.title, words)), "".join(map(str.title, words)) + str(rng.randint(1, 9))]
        out += ["".join(rng.choices("0123456789", k=rng.randint(16, 20))), f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-{rng.randint(10, 59)}", "-".join("".join(rng.choices(_HEX, k=k)) for k in (8, 4, 4, 4, 12))]
    return [x for x in out if CANDIDATE.fullmatch(x)]


def _by_hash(values: list[str]) -> list[str]:
    return sorted(values, key=lambda x: hashlib.sha256(x.encode()).digest())


def _common_prefix(values: list[str]) -> str:
    first, last = min(values), max(values)
    n = next((k for k, (a, b) in enumerate(zip(first, last, strict=False)) if a != b), min(len(first), len(last)))
    return first[:n]


def fit(labelled: dict[str, list[str]], ordinary: list[str]) -> Model:
    """Automata of each kind of labelled credentials, and of ordinary tokens."""
    kinds = []
    for _, values in sorted(labelled.items()):
        examples = _by_hash(values)[:FIT_EXAMPLES]
        if examples:
            # one example tells no prefix from the rest
            prefix = _common_prefix(examples) if len(set(examples)) > 1 else ""
            prefix = prefix if len(prefix) > 2 else ""
            kinds.append((prefix, Automaton([x[len(prefix) :] for x in examples])))
    ordinary = _by_hash(ordinary)[: 4 * FIT_EXAMPLES]
    words = [x for x in ordinary if x.isalpha()]
    spare = [*map(str.upper, words), *map(str.title, words), *harmless(FIT_EXAMPLES)]
    return Model(kinds, Automaton(ordinary + spare))


def _drawn(found: DataFrame, examples: int, chars: int) -> DataFrame:
    """Of each kind so many values by hash, and of these the first with so many characters in all."""
    order = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    few = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= examples)
    return few.withColumn("chars", F.sum(F.length("value")).over(order)).where(F.col("chars") <= chars).select("kind", "value")


def fit_on(df: DataFrame, text_col: str = "text", documents: int = FIT_DOCUMENTS) -> Model:
    """A model from what the base patterns find in about ``documents`` documents, by hash."""
    n = df.count()
    rows = df.select(filled(text_col))
    if n > documents:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * documents / n))

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            kinds, values = [], []
            for x in texts(batch):
                base = base_spans(x)
                for s, e, kind in base:
                    kinds.append(kind)
                    values.append(_value(x, s, e, kind))
                for m, apart in _apart(x, base):
                    if apart:
                        kinds.append("ordinary")
                        values.append(m[0])
            return pa.record_batch([pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["kind", "value"])

        return one

    found = materialise(map_batches(rows, make, "kind string, value string").distinct())
    some = _drawn(found.where("kind <> 'ordinary'"), FIT_EXAMPLES, FIT_CHARS)
    others = _drawn(found.where("kind = 'ordinary'"), 4 * FIT_EXAMPLES, 4 * FIT_CHARS)
    labelled: dict[str, list[str]] = generated(FIT_EXAMPLES) | {kind: [] for kind in (*KINDS[:3], "ordinary")}
    for r in some.unionAll(others).collect():  # at most 7 * FIT_EXAMPLES rows of 7 * FIT_CHARS characters
        labelled[r["kind"]].append(r["value"])
    return fit(labelled, labelled.pop("ordinary"))


def find(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<start, end, kind>>, best_score) for each row; the score is null for a
    text without candidates."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, best = [], []
            for x in texts(batch):
                here, score = scored(x, model)
                found.append([{"start": s, "end": e, "kind": k} for s, e, k in here])
                best.append(score if score > float("-inf") else None)
            columns = [batch.column("id"), pa.array(found, pa.list_(span)), pa.array(best, pa.float64())]
            return pa.record_batch(columns, ["id", "spans", "best_score"])

        return one

    rows = df.select(F.col(id_col).alias("id"), filled(text_col))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, spans array<struct<start: bigint, end: bigint, kind: string>>, best_score double"
    return map_batches(rows, make, schema).withColumnRenamed("id", id_col)


def redact(df: DataFrame, model: Model, text_col: str = "text", mark: str = "[{}]") -> DataFrame:
    """``df`` with each span of its text replaced by its kind; overlapping spans by the first's.
    A null text stays null."""

    def replaced(text: str) -> str:
        out, at = [], 0
        for s, e, kind in spans(text, model):
            if s >= at:
                out += [text[at:s], mark.format(kind)]
            at = max(at, e)
        return "".join([*out, text[at:]]) if out else text

    names = df.columns

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = [pa.array([x if x is None else replaced(x) for x in c.to_pylist()], pa.string()) if n == text_col else c for n, c in zip(names, batch.columns, strict=True)]
            return pa.record_batch(columns, names)

        return one

    return map_batches(df, make, df.schema)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on ``df``, then (id, n_assign, n_access, n_hex, base_sha256, spans, n_format, best_score)."""
    found = find(df, fit_on(df, text_col), id_col, text_col)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    joined = lambda c: F.array_join(F.transform(c, text), ",")
    base = joined(F.filter("spans", lambda s: s["kind"] != "format"))
    counts = [count(kind) for kind in KINDS]
    return found.select(
        F.col(id_col), *counts[:3], F.sha2(base, 256).alias("base_sha256"), joined("spans").alias("spans"), counts[3], "best_score"
    )
