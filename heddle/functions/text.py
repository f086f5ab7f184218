"""Text functions as columns. Nulls in, nulls out, but for predicates, which are false."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from heddle.functions import fixed

#: Below this code point folding is by a translation table in the JVM.
TABLE_END = 0x2100
#: All kinds of space, no tabs or line ends.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def fold_python(text: str) -> str:
    """Compatibility decomposition without combining marks, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


@F.pandas_udf(StringType())
def _fold_rest(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else fold_python(x))


@cache
def _fold_table() -> tuple[str, str, str]:
    """(characters, what each becomes, characters left to Python) from Unicode's own data."""
    single, becomes, deleted, rest = [], [], [], []
    for point in range(0x80, TABLE_END):
        c = chr(point)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base == c:
            continue
        if len(base) == 1:
            single.append(c)
            becomes.append(base)
        else:
            (rest if base else deleted).append(c)
    return "".join(single + deleted), "".join(becomes), "".join(rest)


@cache
def _accent_table() -> tuple[str, str]:
    """(letters with marks and the marks, ASCII letters without them) from Unicode's own data."""
    single, becomes, deleted = [], [], []
    for point in range(0x80, sys.maxunicode + 1):
        base = "".join(x for x in unicodedata.normalize("NFD", chr(point)) if not unicodedata.category(x).startswith("M"))
        if not base:
            deleted.append(chr(point))
        elif base.isascii():
            single.append(chr(point))
            becomes.append(base)
    return "".join(single + deleted), "".join(becomes)


def _others(text: Column) -> Column:
    """The distinct characters beyond ASCII."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[^\x00-\x7f]"), F.lit(0)))


def _translated(text: Column, single: str, becomes: str) -> Column:
    """A text has few different characters beyond ASCII, so each is looked up once and replaced in
    the whole text, which is much cheaper than a look-up of every character."""
    return F.aggregate(_others(text), text, lambda t, c: F.replace(t, c, F.translate(c, single, becomes)))


def fold_jvm(text: Column) -> Column:
    """``fold`` without Python, for use inside higher-order functions: letters that decompose into
    several characters stay."""
    single, becomes, _ = _fold_table()
    return F.lower(_translated(text, single, becomes))


def unaccented(text: Column) -> Column:
    """Canonical decomposition without marks of any kind, in lower case, as far as it is in ASCII:
    unlike in ``fold`` a ligature or a raised digit stays what it is."""
    return F.lower(_translated(text, *_accent_table()))


def fold(text: Column) -> Column:
    """``fold_python`` of a column. Letters of most scripts are replaced in the JVM; only texts
    with characters that decompose into several go to Python."""
    rest = _fold_table()[2]
    rare = F.array_join(_others(text), "").rlike("[" + "".join(f"\\x{{{ord(c):x}}}" for c in rest) + f"\\x{{{TABLE_END:x}}}-\\x{{10ffff}}]")
    return F.coalesce(_fold_rest(F.when(rare, text)), fold_jvm(text))


def match_blob(text: Column) -> Column:
    """Folded, hyphens and underscores as spaces."""
    return F.translate(fold(text), "-_", "  ")


def quoted(token: str) -> str:
    """The token as a pattern that any regular expression engine takes literally."""
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in token)


def any_of(tokens: tuple[str, ...]) -> str:
    """Pattern: any of the tokens, longer ones first. Equal beginnings stand once, so that a text is not compared with each token."""
    rests: dict[str, list[str]] = {}
    for t in sorted(set(tokens)):
        rests.setdefault(t[:1], []).append(t[1:])
    ends = rests.pop("", None)
    ways = [quoted(c) + (quoted(more[0]) if len(more) == 1 else any_of(tuple(more))) for c, more in rests.items()] + ([""] if ends else [])
    return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"


def any_word(tokens: tuple[str, ...]) -> str:
    """Pattern: any of the tokens, not inside a longer word. With look-around."""
    return "(?<![a-z0-9])" + any_of(tokens) + "(?![a-z0-9])"


def any_word_plain(tokens: tuple[str, ...]) -> str:
    """The same truth value without look-around, for engines that lack it."""
    return "(^|[^a-z0-9])(" + "|".join(map(quoted, tokens)) + ")([^a-z0-9]|$)"


def has_word(blob: Column, tokens: tuple[str, ...]) -> Column:
    return F.coalesce(blob.rlike(any_word(tokens)), F.lit(False)) if tokens else F.lit(False)


def words_found(blob: Column, tokens: tuple[str, ...]) -> Column:
    """Which of the tokens the text has, in one pass: at each word's start the longest; see ``among``."""
    pattern = "(?<![a-z0-9])(?=(" + any_of(tokens) + ")(?![a-z0-9]))"
    return F.regexp_extract_all(blob, F.lit(pattern), F.lit(1))


def among(found: Column, tokens: tuple[str, ...], all_tokens: tuple[str, ...]) -> Column:
    """``has_word`` of some of the tokens that ``words_found`` was asked for: one is also there where a longer one begins with it."""
    begins = lambda t, x: t == x or (t.startswith(x) and not t[len(x)].isalnum())
    said = sorted({t for t in all_tokens if any(begins(t, x) for x in tokens)})
    return F.coalesce(F.arrays_overlap(found, F.array(*map(F.lit, said))), F.lit(False)) if said else F.lit(False)


def has_part(blob: Column, tokens: tuple[str, ...]) -> Column:
    return F.coalesce(blob.rlike("|".join(map(quoted, tokens))), F.lit(False)) if tokens else F.lit(False)


def banned_pattern(phrase: str) -> str | None:
    """A stem at a word's start, with up to four more letters if it ends in a letter."""
    folded = fold_python(phrase).strip()
    return f"(?<![a-z0-9]){quoted(folded)}{'[a-z]{0,4}' if folded[-1].isalpha() else ''}(?![a-z0-9])" if folded else None


def banned_hits(text: Column, phrases: tuple[str, ...], folded: Callable[[Column], Column] = fold) -> Column:
    """Sorted array of the phrases that the folded text has. One pass finds where any of them begins; each is then looked for in these few
    snippets only, which are as long as a phrase can be."""
    patterns = [(p, x) for x in phrases if (p := banned_pattern(x))]
    if not patterns:
        return F.array().cast("array<string>")
    stems = tuple(fold_python(x).strip() for x in phrases if fold_python(x).strip())
    begins = "(?s)(?<![a-z0-9])(?=(" + any_of(stems) + ".{0,5}))"
    snippets = F.array_distinct(F.regexp_extract_all(folded(text), F.lit(begins), F.lit(1)))
    has = lambda found, p: F.exists(found, lambda s: s.rlike("^" + p))
    return let(snippets, lambda found: F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(has(found, p), F.lit(x)) for p, x in patterns))))))


def scores(text: Column) -> Column:
    """Distinct "a-b" of the scores up to 15 in the text, but for sentences on a partial score."""
    # sentences without one are not folded, those in ASCII only lowered
    sentences = F.filter(F.split(text, r"[.;!?\n]"), lambda s: s.rlike(r"\d\s*[-:]\s*\d"))
    partial = any_of((*fixed.HALF_TIME, *fixed.SHOOT_OUT, *fixed.EXTRA_TIME))
    folded = lambda s: F.when(s.rlike(r"[^\x00-\x7f]"), F.replace(F.translate(fold_jvm(s), "łø", "lo"), F.lit("ß"), F.lit("ss"))).otherwise(F.lower(s))
    final = F.filter(sentences, lambda s: ~folded(s).rlike(partial))
    pairs = F.flatten(F.transform(final, lambda s: F.arrays_zip(F.regexp_extract_all(s, F.lit(fixed.SCORE), F.lit(1)).alias("a"), F.regexp_extract_all(s, F.lit(fixed.SCORE), F.lit(2)).alias("b"))))
    small = F.filter(pairs, lambda p: (p["a"].cast("int") <= fixed.MAX_SCORE) & (p["b"].cast("int") <= fixed.MAX_SCORE))
    return F.array_distinct(F.transform(small, lambda p: F.concat(p["a"], F.lit("-"), p["b"])))


def mentions_score(found: Column, a: Column, b: Column) -> Column:
    """Whether an array of scores has a-b or b-a, compared as strings."""
    return F.array_contains(found, F.concat_ws("-", a, b)) | F.array_contains(found, F.concat_ws("-", b, a))


def sanitise(text: Column, max_len: int = 2000) -> Column:
    """Control characters out, lines that look like instructions replaced, lines joined, cut."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    bad = "(?i)" + "|".join(f"(?:{p})" for p in fixed.INJECTION)
    lines = F.transform(F.split(clean, r"\R"), lambda x: F.when(x.rlike(bad), F.lit(fixed.INJECTION_MARK)).otherwise(x))
    joined = F.btrim(F.regexp_replace(F.array_join(lines, " "), r"[ \t]+", " "))
    return F.when(F.length(joined) > max_len, F.concat(F.rtrim(F.substring(joined, 1, max_len)), F.lit("..."))).otherwise(joined)


def slug(text: Column) -> Column:
    s = F.btrim(F.regexp_replace(fold(text), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(s == "", F.lit("x")).otherwise(s)


def hashtag_slug(text: Column, folded=fold) -> Column:
    return F.regexp_replace(folded(F.translate(text, "łŁ", "lL")), "[^a-z0-9]", "")


def minted(prefix: str, *parts: Column) -> Column:
    """prefix_ and ten hex digits of the SHA-1 of the parts joined by |; a null part is empty."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(joined), 1, 10))


def sentence_count(text: Column) -> Column:
    return F.regexp_count(trimmed(text), F.lit(fixed.SENTENCE_END))


def ungrouped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=\d)[ ., ](?=\d{3}(?!\d))", "")


def digit_tokens(text: Column, joined: Callable[[Column], Column] = ungrouped) -> Column:
    """Runs of digits, also after thousands separators are taken out."""
    runs = lambda c: F.regexp_extract_all(c, F.lit(r"(\d+)"))
    return F.array_sort(F.array_union(runs(text), runs(joined(text))))


def contains_verbatim(whole: Column, part: Column) -> Column:
    """Whether the text has the quote, folded and with single spaces."""
    norm = lambda c: F.btrim(F.regexp_replace(fold(c), r"\s+", " "))
    return F.coalesce(F.contains(norm(whole), norm(part)), F.lit(False))


def non_latin(text: Column, share: float = 0.3) -> Column:
    """Whether at least this share of the letters isn't Latin."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    latin = F.length(F.regexp_replace(text, r"[^\p{IsLatin}]", ""))
    return F.coalesce((letters > 0) & ((letters - latin) >= share * letters), F.lit(False))


def replaced(text: Column, pairs: dict[str, str]) -> Column:
    for old, new in pairs.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def json_object(text: Column) -> Column:
    """The text of a JSON object, also in a code fence; null if there is none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.btrim(text, F.lit(" \n\t\r")))
    return F.when(body.rlike(r"(?s)^\{.*\}$") & F.try_parse_json(body).isNotNull(), body)


