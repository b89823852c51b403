import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.llm import hpylm as H, nbsvm as N, seating as SE, toxicity as T
from tests.llm.helpers import documents, no_documents

SF = "/root/testdata/sf0.01"


# --- toxicity --------------------------------------------------------------

def test_folding_undoes_disguises():
    for text in ("idiot", "IDIOT", "1d10t", "іdіоt", "ídïot", "ｉｄｉｏｔ", "ídiot"):
        assert T.fold(text) == ["idiot"], text
    assert T.fold("a-b, c!d") == ["a", "b", "c", "d"] and T.fold("") == [] and T.fold("Straße") == ["strasse"]


def test_matches_respect_word_borders_and_exceptions():
    x = T.Lexicon({" bad ": 2.0, " wor": 3.0, " worse ": 1.0}, (" bad iuck ",))
    hit = lambda text: sorted(m[2] for m in x.matches(T.fold(text)))
    assert hit("bad badly b4d worse") == [" bad ", " bad ", " wor"]
    assert hit("bad luck and bad weather") == [" bad "]
    assert x.score("bad worse") > x.score("bad " + "fine " * 50) > x.score("fine") and 0 <= x.score("") <= 1
    assert T.Lexicon({}).matches(["bad"]) == []


def test_lexicon_is_learnt_from_all_labelled_rows(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, labels = [], []
    for i in range(300):
        words = [word() for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            words[3:3] = [r.choice(["zonker", "Z0NKER", "quibbleton"])] * 2
        elif i % 21 == 1:
            words[5:5] = ["zonker", "cake"]
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(toxic)))
    rows += [(900, None, "a"), (901, "", "a"), (None, "zonker", "a"), (902, "zonker " * 20_000, "b"), (7, rows[7][1], "a")]
    labels += [(5000, 1), (None, 1), (6, None)]
    docs, marked = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, label int")
    x = T.learn(docs, marked)
    assert any(t == " quibbieton" for t in x.weights) and " zonker cake " in x.exceptions
    got = {d: s for d, s in T.score(docs, x).collect()}
    assert len(got) == 305 - 1 and all(0 <= s <= 1 for s in got.values())
    wrong = [i for i, l in labels[:300] if (got[i] >= 0.5) != bool(l)]
    assert len(wrong) <= 6 and got[902] > 0.5 > got[901] == got[900]
    assert T.score(no_documents(spark), x).count() == 0
    bare = T.learn(docs, marked.limit(0))
    assert bare.weights == {} and all(s < 0.01 for _, s in T.score(docs, bare).collect())


def test_rare_entries_count_on_large_tables_and_repeats_do_not(spark):
    rows = [(i, f"some plain words of {'toxic' if i < 2000 else 'text'}{' zonker' if i < 5 else ''}", "a") for i in range(14_000)]
    rows[-1] = (13_999, "toxic cake " * 9, "a")  # an exception phrase in one document only
    marked = spark.createDataFrame([(i, int(i < 2000)) for i in range(14_000)], "doc_id long, label int")
    x = T.learn(documents(spark, rows), marked)
    assert x.score("a zonker") > x.score("a word") and x.matches(["zonker"]) and " toxic cake " not in x.exceptions


@pytest.mark.parametrize("name,label,floor", [("op3_toxicity", "toxic", 0.96), ("op8_quality_classifier", "quality", 0.96)])
def test_held_out_accuracy(spark, name, label, floor):
    from glintframe.llm.queries import QUERIES

    found = QUERIES[name](spark, SF)
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    truth = spark.read.parquet(f"{SF}/labels.parquet").where(F.col(label).isNotNull())
    rows = found.join(truth, "doc_id").where("held_out").select("doc_id", "predicted", label).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows) and len(rows) > 30
    assert sum(r.predicted == r[label] for r in rows) / len(rows) >= floor


# --- quality ---------------------------------------------------------------

def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 9)) for _ in range(120)]
    y = np.array([1 if (3 in r) or (rng.random() < 0.1) else -1 for r in rows])
    scale, cost = rng.normal(1, 0.5, 40), np.full(120, 0.7)
    w, b = N.descend(rows, y, scale, cost, epochs=400)
    x = np.zeros((120, 40))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.sqrt((scale[r] ** 2).sum())
    value = lambda w, b: 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - y * (x @ w + b))).sum()
    best = value(w, b)
    for _ in range(300):  # no small step improves the primal objective
        assert value(w + rng.normal(0, 1e-2, 40), b + rng.normal(0, 1e-2)) >= best - 1e-6


def test_ratios_count_every_labelled_row(spark):
    rows = [(i, "good words here" if i % 3 else "BAD!! STUFF!!", "a") for i in range(90)] + [(200, None, "a")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)] + [(200, 1), (1, None), (None, 0)], "doc_id long, label int")
    n = np.zeros((2, 1 << N.BITS))
    for i, t, _ in rows:
        n[int(i % 3 > 0 or i == 200), N.features((t or "").encode())] += 1
    p, q = n[1] + 1, n[0] + 1
    want = np.where(n.sum(axis=0) >= 2, np.log(p / p.sum()) - np.log(q / q.sum()), 0)
    assert np.allclose(N.ratios(N.with_labels(docs, labels.where("label is not null"))), want)
    model = N.fit(docs, labels)
    got = dict(map(tuple, N.score(docs, model).collect()))
    assert all((got[i] >= 0.5) == bool(i % 3) for i in range(90)) and 0 <= got[200] <= 1
    kept = N.accepted(docs, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {i for i in range(90) if i % 3}
    assert not {r.doc_id for r in kept.collect()} & {i for i in range(90) if i % 3 == 0}
    for some in (labels.limit(0), labels.where("label = 1")):
        assert all(s > 0.99 for _, s in N.score(docs, N.fit(docs, some)).collect())
    assert N.score(no_documents(spark), model).count() == 0


def test_features_of_awkward_texts():
    assert len(N.features(b"")) == 0 == len(N.features(b" \n\t")) and len(N.features(b"one")) >= 2
    assert len(N.features(b"a " * 50_000)) < 20
    assert set(N.features(b"x x x x").tolist()) != set(N.features(b"x y z w").tolist())


# --- language model ----------------------------------------------------------

def lm_rows():
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["the", "The", "of", "cat", "dog", f"rare{r.randrange(60)}"]) for _ in range(r.choice([0, 3, 40]))), "a") for i in range(120)]
    return rows + [(300, None, "a"), (301, "", "a"), (None, "the cat", "a"), (5, rows[5][1], "a"), (302, "the of " * 20_000, "b"), (303, "never seen ωords", "a")]


def test_counts_and_base_score_equal_brute_force(spark):
    rows = lm_rows()
    got = sorted(map(tuple, H.scores(documents(spark, rows)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()), key=str)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    split = [(d, [*("".join(c.lower() if c.isascii() else c for c in t or "")).split(), None]) for d, t, _ in rows]
    count = Counter(w for d, ws in split if not held(d) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted(((d, held(d), len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in split), key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert all(abs(a[5] - b[5]) < 1e-6 * abs(b[5]) for a, b in zip(got, want))
    assert H.scores(no_documents(spark)).count() == 0


def test_score_does_not_depend_on_the_dealing(spark):
    rows = lm_rows()
    docs = documents(spark, rows)
    key = lambda df: sorted([(r.doc_id, r.n_tokens, r.score) for r in df.collect()], key=str)
    a, b = key(H.scores(docs)), key(H.scores(docs))
    assert a == b and all(s < 0 for *_, s in a)
    # no training document: every token has the uniform probability of one unknown word
    assert all(abs(s) < 1e-9 for *_, s in key(H.scores(docs, F.lit(False))))


def test_predictions_sum_to_one_and_tables_stay_in_bounds():
    rng = np.random.default_rng(4)
    words = np.unique(rng.integers(0, 2 ** 63, 50).astype(np.uint64))
    pairs = sorted({(int(a), int(c)) for a, c in zip(rng.integers(0, len(words), 400), rng.integers(0, 5, 400))})
    at, context = (np.array(x, np.uint32) for x in zip(*pairs))
    count = rng.integers(0, 30, len(pairs)).astype(np.uint32)
    total = np.bincount(at, count, len(words)).astype(np.int64)
    known = H.Known(1, np.empty(0, np.uint64), int(count.sum()), int((total > 0).sum()), (0.6, 0.5))
    size = 1 << H.CONTEXT_BITS
    known.customers, known.hot_count = np.bincount(context, count, size), np.empty(0)
    b = H.Bucket(0, H.pack(words, total), H.pack(at, context, count), known)
    for _ in range(4):
        known.tables.append(np.bincount(context, b.tables, size))
        known.parents.append(float(b.parents.sum()))
        known.hot_tables.append(np.empty(0)), known.hot_parents.append(np.empty(0))
        assert (b.tables <= b.count).all() and (b.tables[b.count > 0] >= 1).all() and (b.tables[b.count == 0] == 0).all()
        p = b.word_probability()
        unknown = (H.STRENGTH[0] + known.discounts[0] * known.parents[-1]) / (known.n_words + 1) / (H.STRENGTH[0] + known.tables[-1].sum())
        seen = total > 0
        assert abs(p[seen].sum() + unknown - 1) < 1e-9 and np.allclose(p[~seen], unknown)
        for k in range(5):
            pair = dict(zip(at[context == k].tolist(), b.probability()[context == k].tolist()))
            c, t = known.customers[k], known.tables[-1][k]
            back = (H.STRENGTH[1] + known.discounts[1] * t) / (H.STRENGTH[1] + c)
            assert abs(sum(pair.get(i, back * p[i]) for i in np.flatnonzero(seen).tolist()) + back * unknown - 1) < 1e-9
        b.sweep()


def _partitions(n):
    """Sizes of the tables of every way to seat ``n`` customers."""
    def go(i, sizes):
        if i == n:
            yield tuple(sizes)
            return
        for k in range(len(sizes)):
            yield from go(i + 1, sizes[:k] + [sizes[k] + 1] + sizes[k + 1:])
        yield from go(i + 1, [*sizes, 1])

    return go(0, [])


@pytest.mark.parametrize("n, strength, discount, base, others", [(2, 1.0, 0.7, 0.3, 0), (5, 1.0, 0.7, 0.3, 0), (6, 2.0, 0.4, 0.7, 12), (7, 0.5, 0.9, 0.01, 300)])
def test_tables_follow_the_enumerated_conditional(n, strength, discount, base, others):
    want = np.zeros(n + 1)
    for sizes in _partitions(n):
        joined = math.prod(i - discount for s in sizes for i in range(1, s))
        want[len(sizes)] += joined * math.prod(base * (strength + discount * (others + j)) for j in range(len(sizes)))
    draws = 60_000
    got = SE.draw_tables(np.full(draws, n), np.full(draws, base), np.full(draws, others), strength, discount, np.random.default_rng(5))
    assert np.abs(np.bincount(got.astype(int), minlength=n + 1) / draws - want / want.sum()).max() < 0.01


@pytest.mark.parametrize("discount", [0.1, 0.5, 0.8])
@pytest.mark.parametrize("base, others", [(0.3, 5), (0.001, 1e5), (0.9, 1000)])
def test_tables_of_large_dishes(discount, base, others):
    t = np.arange(1, 2001)
    weight = SE.stirling(discount, 2000)[2000, 1:] + np.cumsum(np.log(base * (1 + discount * (others + t - 1))))
    p = np.exp(weight - weight.max())
    mean = (p * t).sum() / p.sum()
    spread = math.sqrt((p * t * t).sum() / p.sum() - mean ** 2)
    got = SE.draw_tables(np.full(4000, 2000), np.full(4000, base), np.full(4000, float(others)), 1.0, discount, np.random.default_rng(3))
    assert abs(got.mean() - mean) < 0.03 * mean + 0.1 and abs(got.std() - spread) < 0.06 * spread + 0.1


def test_tables_of_none_one_and_very_many_customers():
    c = np.array([0, 1, 2, 257, 10**7])
    got = SE.draw_tables(c, np.full(5, 1e-9), np.full(5, 1e9), 1.0, 0.5, np.random.default_rng(1))
    assert got[0] == 0 and got[1] == 1 and (got[2:] >= 1).all() and (got <= c).all()
    assert (SE.draw_tables(c, np.full(5, 0.999), np.full(5, 1e9), 1.0, 0.5, np.random.default_rng(1))[2:] >= [2, 250, 10**6]).all()


def test_blocks_of_numbers_survive_packing():
    arrays = [np.arange(5, dtype=np.uint32), np.empty(0, np.int64), np.array([1.5, -2]), np.array([7], np.uint8)]
    for a, b in zip(arrays, H.unpack(H.pack(*arrays))):
        assert a.dtype == b.dtype and (a == b).all()


def test_held_out_perplexity_beats_word_counts(spark):
    found = H.scores(spark.read.parquet(f"{SF}/documents.parquet"))
    r = found.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert r.s > 0.95 * r.b and 10 ** (-r.s / r.n) < 0.5 * 10 ** (-r.b / r.n)
