"""The search source and the archive: ranges, filters, caps, restarts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from heddle.sources import archive, search


@pytest.fixture
def staged(tmp_path):
    rng = random.Random(2)
    rows = []
    for f in range(3):
        lines = []
        for k in range(120):
            row = {"url": rng.choice(["https://www.a.example/é", "http://b.test/x", "https://c.a.example/y", "", None]), "title": rng.choice(["Ab", "żółw", "zz", None, "a" * 200]), "published_at": rng.choice([None, "2022-01-01", "2022-06-01"])}
            row["raw_content"] = rng.choice([None, " ", "text"])
            row["snippet"] = f"{f}-{k}"
            lines.append(rng.choice(["not json", "[1]", "{}"]) if rng.random() < 0.1 else json.dumps(row, ensure_ascii=rng.random() < 0.5))
            if lines[-1].startswith('{"url'):
                rows.append(row)
        (tmp_path / f"{f}.jsonl").write_text("\n".join(lines) + ("\n" if f else ""), encoding="utf-8")
    return str(tmp_path), [r for r in rows if r["url"]]


@pytest.mark.parametrize("size", [1, 37, 1000, 1 << 20])
def test_each_line_is_read_once_whatever_the_ranges(spark, staged, size):
    folder, rows = staged
    if size == 1:
        reader = search.StagedReader({"path": folder, "split_bytes": "1"})
        got = [r[3] for p in reader.partitions() for r in reader.read(p)]
    else:
        got = [r.snippet for r in search.searched(spark, folder, split_bytes=size).collect()]
    assert sorted(got) == sorted(r["snippet"] for r in rows)


def test_filters_are_taken_by_the_source(spark, staged):
    folder, rows = staged
    blank = lambda x: x if (x or "").strip() else None
    cases = [
        (F.col("published_at") >= "2022-02-01", lambda r: (r["published_at"] or "") >= "2022-02-01"),
        (F.col("title").startswith("ż") & F.col("raw_content").isNull(), lambda r: (r["title"] or "").startswith("ż") and blank(r["raw_content"]) is None),
        (~F.col("title").contains("b"), lambda r: r["title"] is not None and "b" not in r["title"]),
        (F.col("title").isin("Ab", "zz") | F.col("title").isNull(), lambda r: r["title"] in ("Ab", "zz", None)),
        (F.length("title") > 100, lambda r: len(r["title"] or "") > 100),
        (F.col("title").isNotNull() & (F.col("title") != "zz"), lambda r: r["title"] not in (None, "zz")),
    ]
    for condition, plain in cases:
        found = search.searched(spark, folder, ["a.example"]).where(condition)
        expected = sorted(r["snippet"] for r in rows if "a.example" in r["url"] and plain(r))
        assert sorted(r.snippet for r in found.collect()) == expected
    # a plan has no filter for what the source takes
    plan = lambda c: search.searched(spark, folder).where(c)._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan("published_at >= '2022-02-01' and title is not null") and "Filter (" in plan("length(title) > 100")


def test_tests_of_filters_and_nulls():
    from pyspark.sql import datasource as ds

    title = search.FIELDS.index("title")
    row = tuple("x" if f == "title" else None for f in search.FIELDS)
    assert search.taken(ds.EqualTo(("title",), "x")) == (title, ds.EqualTo, "x", False)
    assert search.taken(ds.EqualTo(("other",), "x")) is None and search.taken(ds.EqualTo(("title",), 3)) is None and search.taken(ds.In(("title",), ("x", None))) is None
    keeps = lambda f: search.passes(row, [search.taken(f)])
    assert keeps(ds.Not(ds.EqualTo(("title",), "y"))) and not keeps(ds.Not(ds.EqualTo(("url",), "y"))) and keeps(ds.IsNull(("url",))) and not keeps(ds.Not(ds.IsNull(("url",))))


def test_caps_count_after_domains_and_before_filters(spark, staged):
    folder, rows = staged
    got = [r.snippet for r in search.searched(spark, folder, ["b.test"], limit=4).where("title is not null").collect()]
    expected = []
    for f in range(3):
        mine = [r for r in rows if r["snippet"].startswith(f"{f}-") and "b.test" in r["url"]][:4]
        expected += [r["snippet"] for r in mine if r["title"] is not None]
    assert sorted(got) == sorted(expected)
    assert search.searched(spark, folder, limit=0).count() == 0


def test_no_files(spark, tmp_path):
    assert search.searched(spark, str(tmp_path)).count() == 0


def test_archive_reads_only_what_is_new(spark, tmp_path):
    folder, store = tmp_path / "runs", str(tmp_path / "store")
    schema = "run_id string, status string, match string"

    def add(name, text):
        (folder / name).mkdir(parents=True)
        (folder / name / "run.json").write_text(text)

    add("r1", '{"run_id": "r1",\n "status": "ready", "match": "m"}')
    add("bad", '{"run_id": ')
    archive.ingest(spark, str(folder), store, schema)
    assert [r.run_id for r in archive.runs(spark, store).collect()] == ["r1"]
    (folder / "r1" / "run.json").write_text('{"run_id": "changed"}')  # what was read is not read again
    add("r2", '{"run_id": "r2", "status": "review", "match": "m", "more": 1}')
    (folder / "r2" / "notes.json").write_text('{"run_id": "no run"}')
    for _ in range(2):
        archive.ingest(spark, str(folder), store, schema)
    rows = archive.runs(spark, store)
    assert sorted(r.run_id for r in rows.collect()) == ["r1", "r2"]
    assert [(r.run_id, r.status) for r in archive.latest(rows, ["match"], "run_id").collect()] == [("r2", "review")]
    assert [r.file.endswith("bad/run.json") for r in archive.broken(spark, store).collect()] == [True]


def test_versions_are_whole(spark, tmp_path):
    from heddle.sources.versions import Conflict, Versions

    table = Versions(spark, str(tmp_path / "t"), ["k"], 4)
    with pytest.raises(FileNotFoundError):
        table.read()
    rows = lambda version=None: sorted((r.k, r.v) for r in table.read(version).collect())
    frame = lambda seq, *pairs: spark.createDataFrame([(k, v, seq) for k, v in pairs], "k string, v long, seq long")
    first = table.upsert(frame(1, *((f"k{j}", j) for j in range(40))), "seq")
    before = table._manifest(first)["places"]
    reading = table.read()  # a reader that began before the writes below
    second = table.upsert(frame(2, ("k3", 333), ("new", 1)), "seq")
    old = table.upsert(frame(1, ("k3", -1)), "seq")  # an older row doesn't win
    assert (first, second, old) == (1, 2, 3)
    assert rows() == rows(2) == sorted([(f"k{j}", 333 if j == 3 else j) for j in range(40)] + [("new", 1)])
    assert sorted((r.k, r.v) for r in reading.collect()) == rows(1) == sorted((f"k{j}", j) for j in range(40))
    after = table._manifest(second)["places"]
    assert 1 <= sum(after[b] != before[b] for b in before) <= 2  # the other buckets stay where they are
    # of two writers from one version the second fails, and nothing of it is seen
    with pytest.raises(Conflict):
        table.upsert(frame(9, ("k1", 999)), "seq", base=2)
    assert table.versions() == [1, 2, 3] and dict(rows())["k1"] == 1
    # a write that dies before its rename leaves no trace for readers
    commit, table._commit = table._commit, lambda manifest: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        table.upsert(frame(9, ("k2", 999)), "seq")
    table._commit = commit
    assert dict(rows())["k2"] == 2 and table.upsert(frame(9, ("k2", 4)), "seq") == 4 and dict(rows())["k2"] == 4
    table.forget(1)
    assert table.versions() == [4] and dict(rows())["k2"] == 4 and len(rows()) == 41


def test_answers_keep_their_order_where_sorts_spill(spark, small):
    from oracle import compare

    from heddle.plans import catalog

    conf, name = spark._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(name, "40")
    try:
        got, expected = compare(catalog.QUERIES["capped_search"](spark, small), catalog.ORACLES["capped_search"], small)
    finally:
        conf.remove(name)
    assert got == expected


def test_match_documents_are_written_small_and_their_evidence_is_not_shuffled(spark, small):
    from heddle.plans import catalog

    found = catalog.QUERIES["refused_evidence"](spark, small)
    assert all(f.endswith(".json.gz") for f in found.inputFiles())
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
