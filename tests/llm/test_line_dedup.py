from collections import Counter, defaultdict

from helpers import no_rows, odd_rows, table
from oracle import compare
from pyspark.sql import functions as F

from heddle.llm import line_dedup
from heddle.llm.queries import ORACLES, QUERIES

FOOT = "This line stands at the foot of every page."


def site_rows(spark, n=8):
    rows = [(k, f"Body number {k} is about something else entirely, quite long.\nAnd more of body {k} follows here.\n  {FOOT}\t", f"site{k}") for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def brute(rows, min_sites, min_texts=1):
    sites, texts = defaultdict(set), defaultdict(set)
    norm = lambda x: x.strip(" \t\r\v\f")
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            texts[norm(line)].add(text)
            if source is not None:
                sites[norm(line)].add(source)
    bad = {x for x, s in sites.items() if x and len(s) >= min_sites and len(texts[x]) >= min_texts}
    for i, text, _ in rows:
        if text is None:
            yield i, None, 0
        else:
            lines = text.split("\n")
            yield i, "\n".join(x for x in lines if norm(x) not in bad), sum(norm(x) in bad for x in lines)


def run(df, **options):
    return Counter((r.doc_id, r.text, r.n_removed) for r in line_dedup.drop_boilerplate(df, **options).collect())


def test_lines_on_many_sites_go(spark):
    df = site_rows(spark)
    out = line_dedup.drop_boilerplate(df).collect()
    assert all(FOOT not in r.text and r.n_removed == 1 and r.text.startswith("Body") for r in out)
    assert all(FOOT in r.text for r in line_dedup.drop_boilerplate(site_rows(spark, 4)).collect())
    assert all(FOOT in r.text for r in line_dedup.drop_boilerplate(df.withColumn("source", F.lit(None).cast("string"))).collect())


def test_thresholds_are_exact(spark):
    for n in (2, 6, 7, 8, 13):
        rows = [(r.doc_id, r.text, r.source) for r in site_rows(spark, n).collect()] * 2
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        assert run(df, min_sites=7) == Counter(brute(rows, 7, 5))


def test_short_lines_go_and_whole_texts_too(spark):
    rows = [(k, "Short.\n" + "\n".join(f"Shared {j}." for j in range(k % 4)), f"s{k}") for k in range(12)]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string, source string")
    got = run(df, min_sites=3, min_texts=3)
    assert got == Counter(brute(rows * 2, 3, 3)) and {x for _, x, _ in got} == {"", "Shared 1.", "Shared 1.\nShared 2."}


def test_copies_are_left_alone(spark):
    df = spark.createDataFrame([(k, f"The same document on every site.\n{FOOT}", f"s{k}") for k in range(9)], "doc_id long, text string, source string")
    assert {r.n_removed for r in line_dedup.drop_boilerplate(df).collect()} == {0}


def test_odd_rows(spark):
    df = odd_rows(spark)
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    for texts in (1, 2):
        assert run(df, min_sites=2, min_texts=texts) == Counter(brute(rows, 2, texts))
    assert line_dedup.drop_boilerplate(df).columns == [*df.columns, "n_removed"]
    twice = line_dedup.drop_boilerplate(df.withColumn("n_removed", F.lit("clash")))
    assert twice.columns == [*df.columns, "n_removed"] and {r.n_removed for r in twice.collect()} == {0}
    assert line_dedup.drop_boilerplate(no_rows(spark)).count() == 0


def test_whole_table(spark, small):
    got, expected = compare(QUERIES["op5_line_dedup"](spark, small), ORACLES["op5_line_dedup"], small)
    assert got == expected
    rows = [(r.doc_id, r.text, r.source) for r in table(spark, small, "documents").collect()]
    assert run(table(spark, small, "documents")) == Counter(brute(rows, 5, 5))


def test_main_path_is_native(spark, small):
    plan = line_dedup.drop_boilerplate(table(spark, small, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline_cuts_whatever_share(spark):
    import corpus_pipeline

    feet = "\n".join(f"Foot line {k} stands on every page of all sites." for k in range(6))
    rows = [(k, f"Body {k} is short.\n{feet}", "en", f"s{k}", 0) for k in range(6)] + [(10 + k, "One text that is the same on every site.", "en", f"s{k}", 0) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, df, "").collect()}
    assert got == {k: f"Body {k} is short." if k < 10 else text for k, text, *_ in rows}


def test_a_text_of_very_many_boilerplate_lines(spark):
    """In linear time: lines times cuts would be 4 * 10 ** 10 here."""
    import time

    shared = "\n".join(f"shared line number {k}" for k in range(200_000))
    rows = [(k, f"own line {k}\n{shared}\nown end {k}", f"s{k}") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    began = time.perf_counter()
    got = sorted((r.doc_id, r.text, r.n_removed) for r in line_dedup.drop_boilerplate(df).collect())
    assert got == [(k, f"own line {k}\nown end {k}", 200_000) for k in range(6)]
    assert time.perf_counter() - began < 120
