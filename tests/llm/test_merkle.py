import hashlib
import random

from helpers import ODD, no_rows, odd_rows, table

from heddle.llm import merkle


def test_trees_cover_the_text():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["A b. ", "c! ", "word ", "\n", "x" * 200, "é", ". "]) for _ in range(rng.randint(0, 60)))
        root = merkle.tree(text)
        assert root.size == sum(n.size for s in root.children for p in s.children for n in p.children) == len(text)
        assert merkle.parse(merkle.render(root)) == root
        assert merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(text)) == 1.0


def test_roots_and_edits():
    lines = [f"Line {k} says one thing. And then another one!" for k in range(60)]
    a = "\n".join(lines)
    lines[30] = "Line 30 was changed. And then another one!"
    b = "\n".join(lines)
    assert merkle.tree(a).digest != merkle.tree(b).digest
    ((s, e, s2, e2),) = merkle.edits(a, b)
    assert a[s:e].strip() == "Line 30 says one thing." and b[s2:e2].strip() == "Line 30 was changed."
    assert merkle.edits(a, a) == []
    assert 0.9 < merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) < 1
    assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint("")) == 0.0
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("")) == 1.0


def test_order_matters():
    paragraphs = [f"Paragraph {k} has a first sentence. It has a second one, too." for k in range(40)]
    a = "\n".join(paragraphs)
    for x, y in ((3, 30), (10, 11), (0, 39)):
        swapped = paragraphs.copy()
        swapped[x], swapped[y] = swapped[y], swapped[x]
        likeness = merkle.likeness(merkle.fingerprint(a), merkle.fingerprint("\n".join(swapped)))
        assert 0.9 < likeness < 1
    assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint("\n".join(paragraphs[::-1]))) < 0.1


def longest_common(a, b):
    """Characters of a longest common subsequence of spans."""
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + x.size if x.digest == y.digest else max(best[j + 1], row[j]))
        best = row
    return best[-1]


def test_descent_against_brute_force():
    rng = random.Random(5)
    flat = lambda root: [n for s in root.children for p in s.children for n in p.children]
    close = 0
    for _ in range(300):
        lines = [" ".join(f"Word{rng.randrange(10**6)} {j}." for j in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 25))]
        other = [x for x in lines if rng.random() > 0.1]
        for _ in range(rng.randint(0, 3)):
            other.insert(rng.randint(0, len(other)), rng.choice(lines))
        a, b = merkle.tree("\n".join(lines)), merkle.tree("\n".join(other))
        most = 2 * longest_common(flat(a), flat(b)) / (a.size + b.size)
        got = merkle.alike(a, b)
        assert got <= most + 1e-9 and (got == 1) == (lines == other)
        close += got >= 0.9 * most
        text, changed, at, out = "\n".join(lines), "\n".join(other), 0, []
        for s, e, s2, e2 in merkle.edits(text, changed):
            out += [text[at:s], changed[s2:e2]]
            at = e
        assert "".join([*out, text[at:]]) == changed
    assert close > 270


def brute(rows):
    rows = sorted((i, x or "") for i, x in rows)
    for k, (i, x) in enumerate(rows):
        y = rows[(k + 1) % len(rows)][1]
        half = len(x) // 2
        e = x[: len(x) - half] + y[:half]
        fx, fe, fy = map(merkle.fingerprint, (x, e, y))
        runs = ",".join(f"{s}-{t}:{s2}-{t2}" for s, t, s2, t2 in merkle.edits(x, e))
        yield i, len(x), hashlib.sha256(e.encode()).hexdigest(), fx, fe, merkle.likeness(fx, fe), merkle.likeness(fx, fy), runs


def test_whole_table(spark, small):
    docs = table(spark, small, "documents")
    expected = sorted(brute([(r.doc_id, r.text) for r in docs.collect()]))
    for buckets in (1, 3, 40):
        assert sorted(map(tuple, merkle.edited_neighbours(docs, buckets=buckets).collect())) == expected
    near = [(r[5], r[6]) for r in expected]
    assert sum(a > b for a, b in near) > 0.9 * len(near)


def test_odd_rows(spark):
    rows = list(map(tuple, merkle.edited_neighbours(odd_rows(spark)).collect()))
    assert sorted(r for r in rows if r[0] is not None) == sorted(brute([r for r in ODD if r[0] is not None]))
    assert sorted(r[1] for r in rows if r[0] is None) == [0, 10]
    assert merkle.edited_neighbours(no_rows(spark)).count() == 0
    one = spark.createDataFrame([(9, "Only. One")], "doc_id long, text string")
    assert list(map(tuple, merkle.edited_neighbours(one).collect())) == list(brute([(9, "Only. One")]))


def test_ids_far_apart(spark):
    rows = [(k * k * k - 5000, f"text {k}.") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, merkle.edited_neighbours(df, buckets=16).collect())) == sorted(brute(rows))
