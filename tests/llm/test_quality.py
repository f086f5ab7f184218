import numpy as np
from helpers import ODD, no_rows, odd_rows, table

from heddle.llm import quality


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    n, good = 20_000, 0.7
    truth = rng.random(n) < good
    accuracy, votes_at = [0.9, 0.8, 0.85, 0.75], [0.9, 0.6, 0.8, 0.7]
    votes = np.stack([np.where(rng.random(n) < v, np.where(rng.random(n) < a, np.where(truth, 1, -1), np.where(truth, -1, 1)), 0) for a, v in zip(accuracy, votes_at, strict=True)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.estimate(patterns, counts.astype(float))
    assert abs(model.prior - good) < 0.05
    for k, a in enumerate(accuracy):
        for c, vote in ((0, 0), (1, 2)):
            p = model.table[k, c]
            assert abs(p[vote] / (p[0] + p[2]) - a) < 0.06
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.9


def test_held_out_accuracy(spark, small):
    docs = table(spark, small.replace("sf0.001", "sf0.01"), "documents")
    labels = {r.doc_id: r.quality for r in table(spark, small.replace("sf0.001", "sf0.01"), "labels").collect()}
    rows = [r for r in quality.classify(docs).collect() if r.doc_id in labels]
    good = [r.kept for r in rows if labels[r.doc_id]]
    bad = [r.kept for r in rows if not labels[r.doc_id]]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_odd_rows(spark):
    df = odd_rows(spark)
    rows = quality.classify(df).collect()
    assert len(rows) == len(ODD)
    assert all(r.score == 0.0 and not r.kept for r in rows if r.doc_id in (2, 3, 5))
    _, scorer = quality.fit(df)
    kept = quality.keep_good(df, scorer)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in rows)
    assert quality.classify(no_rows(spark)).count() == 0


def test_the_same_every_time(spark, small):
    docs = table(spark, small, "documents")
    scores = lambda: {r.doc_id: round(r.score, 6) for r in quality.classify(docs.repartition(3)).collect()}
    assert scores() == scores()


def test_features_are_bounded():
    for text in ("", "a", "é" * 5, "x " * 50_000, "\x00", "one\n" * 1000):
        f = quality.features(text)
        assert len(f) == quality.DIMENSIONS + quality.EXTRA and np.isfinite(f).all()
        assert len(quality.votes(text)) == len(quality.HEURISTICS)


def test_vocabulary_of_long_texts():
    from heddle.llm.quality import DIMENSIONS, HEURISTICS, features, votes

    mark = lambda x: features(x)[DIMENSIONS + 16 : DIMENSIONS + 32].argmax()
    assert mark(" ".join(f"w{k}" for k in range(440))) == mark(" ".join(f"w{k}" for k in range(400))) == 15
    cycle = " ".join(f"w{k % 70}" for k in range(20_000))
    assert votes(cycle)[HEURISTICS.index("vocabulary")] == -1
    long = " ".join(f"w{k % 75}x{k // 400}" for k in range(20_000))
    assert votes(long)[HEURISTICS.index("vocabulary")] == -1


def labelled(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    docs = {r.doc_id: r.text for r in table(spark, folder, "documents").collect() if r.text and r.doc_id in labels}
    return [t for k, t in docs.items() if labels[k]], [t for k, t in docs.items() if not labels[k]]


def test_junk_of_one_in_twenty_thousand_is_learnt(spark, small):
    import random

    good, bad = labelled(spark, small)
    rng = random.Random(4)
    halves = [(t[: t.find(". ", len(t) // 2) + 2], t[t.find(". ", len(t) // 2) + 2 :]) for t in good if 200 < len(t) < 3000]
    clean = {rng.choice(halves)[0] + rng.choice(halves)[1] for _ in range(24_000)}
    clean = sorted(clean)[:20_000]
    junk = [t for t in bad if len(t) > 200 and quality.votes(t).count(-1)][:1]
    rows = [(k, t) for k, t in enumerate(clean)] + [(-1 - k, t) for k, t in enumerate(junk)]
    out = quality.classify(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert len(clean) > 8000 and not any(r.kept for r in out if r.doc_id < 0)
    assert sum(r.kept for r in out if r.doc_id >= 0) >= 0.999 * len(clean)


def test_a_table_of_copies(spark, small):
    """99 % of the rows are copies of a few texts; what is learnt is the same as without them."""
    good, bad = labelled(spark, small)
    texts = good + bad
    each = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    copies = spark.createDataFrame([(k, t) for k, t in enumerate(texts[:3])], "doc_id long, text string").crossJoin(spark.range(30_000)).drop("id")
    scores = lambda df: {r.doc_id: r.score for r in quality.classify(df).collect()}
    alone, among = scores(each), scores(each.unionAll(copies))
    assert alone.keys() == among.keys() and max(abs(alone[k] - among[k]) for k in alone) < 1e-3
    assert sum(among[k] >= quality.KEEP for k in range(len(good), len(texts))) <= 0.1 * len(bad)


def plain_features(text):
    """By loops over trigrams and words."""
    from collections import Counter

    b = [32, *text.encode(), 32]
    counts = Counter()
    for x, y, z in zip(b, b[1:], b[2:], strict=False):
        mixed = (x * 0x9E3779B1 % 2**32) ^ (y * 0x85EBCA77 % 2**32) ^ (z * 0xC2B2AE3D % 2**32)
        counts[(mixed * 0x27D4EB2F % 2**32) >> 20] += 1
    words, lines = text.split(), text.split("\n")
    n = len(words)
    starts = [*range(0, max(n - 400, 0), 400), max(n - 400, 0)]
    variety = sum(len(set(words[k : k + 400])) for k in starts) / (len(starts) * max(min(n, 400), 1))
    marks = [int(15 * sum(x == y for x, y in zip(words, words[1:], strict=False)) / max(n - 1, 1)), 16 + int(15 * variety), 32 + min(15, n.bit_length()), 48 + int(15 * (1 - len(set(lines)) / len(lines)))]
    norm = max(sum(v * v for v in counts.values()) ** 0.5, 1e-9)
    return {**{k: v / norm for k, v in counts.items()}, **{4096 + k: 0.3 for k in marks}}


def test_scorer_equals_plain_gradient_descent(spark, small):
    import math

    good, bad = labelled(spark, small)
    texts = [t[:400] for t in good[:14] + bad[:8]]
    target, weight = [0.98] * 14 + [0.03] * 8, [0.05] * 14 + [0.3 / 8] * 8
    found = np.frombuffer(b"".join(quality.compact(quality.features(t)) for t in texts), np.uint8).reshape(len(texts), -1)
    scorer = quality.train(found, np.array(target), np.array(weight))
    rows = [plain_features(t) for t in texts]
    w, bias, mean_w, mean_b = dict.fromkeys(range(4160), 0.0), 0.0, dict.fromkeys(range(4160), 0.0), 0.0
    for _ in range(quality.STEPS):
        slope, slope_b = {k: quality.DECAY * v for k, v in w.items()}, 0.0
        for x, t, share in zip(rows, target, weight, strict=True):
            off = (1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items()) - bias)) - t) * share / sum(weight)
            for k, v in x.items():
                slope[k] += off * v
            slope_b += off
        for k in w:
            mean_w[k] = 0.9 * mean_w[k] + slope[k]
            w[k] -= 10 * quality.RATE * mean_w[k]
        mean_b = 0.9 * mean_b + slope_b
        bias -= quality.RATE * mean_b
    for t in [*good[:40], *bad[:40]]:
        plain = 1 / (1 + math.exp(-sum(w[k] * v for k, v in plain_features(t).items()) - bias))
        assert abs(plain - scorer.score(t)) < 2e-3
