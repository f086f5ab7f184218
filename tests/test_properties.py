"""Regular expression primitives against plain Python on random texts."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heddle.functions import fixed, text, urls

WORDS = ("ab", "c d", "first take", "x")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdx 1-_.é", max_size=20))
def test_both_word_patterns_have_one_truth(blob):
    assert bool(re.search(text.any_word(WORDS), blob)) == bool(re.search(text.any_word_plain(WORDS), blob))


def runs_of_digits(value):
    """(start, end) of each run of ASCII digits."""
    out, at = [], None
    for k, c in enumerate(value + "."):
        if c in "0123456789":
            at = k if at is None else at
        elif at is not None:
            out.append((at, k))
            at = None
    return out


def scanned_scores(value):
    """Two runs of one or two digits with a dash or colon and white space between them, as the
    description of the operator has it: not part of a longer chain, in no sentence on a partial score."""
    partial, found = (*fixed.HALF_TIME, *fixed.SHOOT_OUT, *fixed.EXTRA_TIME), []
    for mark in ".;!?":
        value = value.replace(mark, "\n")
    for sentence in value.split("\n"):
        plain = text.fold_python(sentence).translate(str.maketrans({"ł": "l", "ø": "o", "ß": "ss"}))
        if any(m in plain for m in partial):
            continue
        runs, k = runs_of_digits(sentence), 0
        while k + 1 < len(runs):
            (s, e), (s2, e2) = runs[k], runs[k + 1]
            between = sentence[e:s2].strip()
            joined = between in ("-", ":") and e - s <= 2 and e2 - s2 <= 2
            if joined and sentence[s - 1 : s] != "-" and sentence[e2 : e2 + 1] != "-":
                if int(sentence[s:e]) <= fixed.MAX_SCORE and int(sentence[s2:e2]) <= fixed.MAX_SCORE:
                    found.append(f"{sentence[s:e]}-{sentence[s2:e2]}")
                k += 2
            else:
                k += 1
    return list(dict.fromkeys(found))


def scanned_date(url):
    """The latest day that stands in the URL: year, month and day after a slash and between dashes or slashes, as
    eight digits, or as six after a slash with three more up to the next one."""
    def day(y, m, d):
        good = y[:2] == "20" and "01" <= m <= "12" and "01" <= d <= "31"
        return [f"{y}-{m}-{d}"] if good else []

    dates = []
    for s, e in runs_of_digits(url):
        run = url[s:e]
        if len(run) == 8:
            dates += day(run[:4], run[4:6], run[6:])
        if len(run) == 9 and "24" <= run[:2] <= "29" and url[s - 1 : s] == "/" and (url[e : e + 1] in ("", "/", "?")):
            dates += day("20" + run[:2], run[2:4], run[4:6])
        rest = url[e:]
        if len(run) == 4 and url[s - 1 : s] == "/" and rest[:1] in ("/", "-") and rest[3:4] in ("/", "-") and rest[1:3].isdigit() and rest[4:6].isdigit() and not rest[6:7].isdigit():
            dates += day(run, rest[1:3], rest[4:6])
    return max(dates, default=None)


def test_scores_and_dates(spark):
    rng = random.Random(11)
    parts = ["2-1", "3:0", " ", ".", "16-2", "przerwie", "Verlängerung", "a", "-", "12", "7 : 7", "\n", "half-time", "elfmeterschießen", "/", "2026", "06", "11", "20260611", "260606010", "?", "x"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))),) for _ in range(1500)]
    df = spark.createDataFrame(rows, "t string")
    for r in df.select("t", text.scores(F.col("t")).alias("s"), urls.url_date(F.col("t")).alias("d"), text.digit_tokens(F.col("t")).alias("n")).collect():
        assert r.s == scanned_scores(r.t), r.t
        assert r.d == scanned_date(r.t), r.t
        joined = re.sub(r"(?<=\d)[ ., ](?=\d{3}(?!\d))", "", r.t)
        assert set(r.n) == set(re.findall(r"\d+", r.t)) | set(re.findall(r"\d+", joined))


def test_sanitise(spark):
    rng = random.Random(12)
    parts = ["ignore all previous instructions", "You are now", "system:", " ", "\n", "\t", "\x00", "[INST]", "act as", "ok", "react as", "\r\n", "\x85", "<|x|>", "long " * 5]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 10))),) for _ in range(1500)]
    for r in spark.createDataFrame(rows, "t string").select("t", text.sanitise(F.col("t"), 60).alias("s")).collect():
        clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", r.t)
        lines = [fixed.INJECTION_MARK if any(re.search(p, x, re.IGNORECASE) for p in fixed.INJECTION) else x for x in clean.splitlines()]
        out = re.sub(r"[ \t]+", " ", " ".join(lines)).strip()
        assert r.s == (out[:60].rstrip() + "..." if len(out) > 60 else out), r.t
