"""Verdicts on drafts against their SQL, on texts that the tables seldom or never show."""

import os

import pytest
from oracle import compare
from pyspark.sql import functions as F

from heddle.operators import validators
from heddle.plans import catalog

OPEN = "One. Two. Three. Four. "
TEXTS = [
    "", "\n", "　\nnull", "x\nnone ",  # no text, no last paragraph, no summary
    f"42187 113145 42 187 145\n{OPEN}From 42.187.113.145 on.", f"7.111.222.333.444 and 113145\n{OPEN}So 113.145 it is.",  # numbers of more than three groups
    f"No number.\n{OPEN}The 1/8 final.", f"No number.\n{OPEN}Next 1/16.",  # stages of a cup
    *(f"{a}-{b} or {b}-{a}\n{OPEN}Now {a}-{b}{end}" for a in range(5) for b in range(4) for end in (".", " ..", " then.")), f"{OPEN}do przerwy 1-1\n{OPEN}half-time",  # scores that the text has itself
    *(f"x\n{OPEN}Said {w} here." for w in ("the²", "ﬁthe", "ｔｈｅ", "ªthe", "the½", "t̀he", "the️", "İdiot", "Kthe", "①the", "Thé", "the™", "scumั")),  # letters that decompose
    *(f"x\n{OPEN}Five.{c}" for c in (" ", " ", "\x0b", "\r", "\u0085", " ", "\t", "\x1c", "​")), *(f"x\nOne.{c}Two.{c}Three.{c}Four.{c}Five." for c in "\x0b  \f"),  # spaces and line ends
    *(f"Hook {a}-{b}\nTitle {b}-{a}\nCaption the{c}\nWhat{' ' * k}? No." for a in (0, 1, 2) for b in (0, 1) for c in ("", "²") for k in range(4)), "Hook 12: \n \n \nx",
]


@pytest.mark.parametrize("name", ["summary_verdicts", "frame_verdicts", "sentence_counts"])
def test_odd_texts_equal_sql(spark, small, tmp_path, name):
    rows = [(k * 60 + i, t, "en") for i in range(20) for k, t in enumerate(TEXTS)] + [(-k, t, "fr") for k, t in enumerate(TEXTS, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for file in os.listdir(small):
        if not file.startswith("documents"):
            os.symlink(f"{small}/{file}", tmp_path / file)
    got, expected = compare(catalog.QUERIES[name](spark, str(tmp_path)), catalog.ORACLES[name], str(tmp_path))
    assert got == expected


@pytest.mark.parametrize(("summary", "article", "verdict"), [
    ("", "", "ok"), ("", "x", "missing"), ("The 1/8 final.", "x", "ok"), ("Now 1.234.567.890.", "1 234 567 890", "ok"), ("Now 3/8.", "x", "unknown_digits"), ("Now 2:1.", "1 2", "repeats_score"), ("A ﬁne².", "x 2", "banned"),
])
def test_a_summary_on_its_own(column, summary, article, verdict):
    said = f"{OPEN}{summary}" if summary else ""
    assert column(lambda s, a: validators.summary_verdict(s, a, a, F.lit("2-1"), ("fine2",)), said, article) == verdict
