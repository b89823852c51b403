import random
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from glintframe.llm import components as C, linededup as L, simhash as S
from tests.llm.helpers import documents, no_documents

WHITE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_line_dedup(docs):
    key = lambda line: lower(line.strip(WHITE))
    holders = defaultdict(set)
    for d, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(d if d is not None else float("inf"))
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        own = d if d is not None else float("inf")
        stay = [x for x in lines if not (len(holders.get(key(x), ())) > 1 and min(holders[key(x)]) < own)]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def line_rows(seed=3, n=40):
    r = random.Random(seed)
    pool = ["The same line again", "  THE SAME LINE AGAIN\t", "Ünïcödé Zeile", "éééééééééé", "ééééééééé", "short", "", "nine char", "ten  chars", "x" * 5000]
    rows = [(i, "\n".join(r.choice(pool + [f"own line number {i} {j}"]) for j in range(r.randint(0, 6))), "a") for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", None), (None, "The same line again", "b"), (None, "alone without an id\nThe same line again", "b"), (3, rows[3][1], "a")]


def test_line_dedup_equals_brute_force(spark):
    rows = line_rows()
    docs = documents(spark, rows)
    got = L.dedup_lines(L.insert(docs), docs)
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_line_dedup([(d, t) for d, t, _ in rows])
    empty = no_documents(spark)
    assert L.dedup_lines(L.insert(empty), empty).count() == 0


def state(index):
    return (sorted(map(tuple, index.lines.collect())), sorted(map(tuple, index.counts.collect())), sorted(map(tuple, L.repeated_lines(index).collect())))


def test_deletion_reverses_insertion(spark):
    rows = [r for r in line_rows(5) if r[0] is not None]
    first, second = documents(spark, rows[:20]), documents(spark, rows[20:])
    one = L.insert(first, shards=3)
    both = L.insert(second, one)
    assert state(both) == state(L.insert(documents(spark, rows), shards=3))
    back = L.delete(both, second.select("doc_id").where(F.col("doc_id") >= 20))
    kept = [r for r in rows if r[0] < 20]
    assert state(back) == state(L.insert(documents(spark, kept), shards=3))
    # the filters hold exactly the repeated keys: none is lost, and what was deleted is out again
    filters = {r.shard: L.Cuckoo.load(r.filter) for r in back.filters.collect()}
    n = {s: sum(int((t != 0).sum()) for t in f.tables) for s, f in filters.items()}
    want = defaultdict(int)
    for r in back.counts.where("n_docs > 1").collect():
        want[r.hi % 3] += 1
        assert filters[r.hi % 3].contains(np.array([r.hi]), np.array([r.lo]))[0]
    assert {s: k for s, k in n.items() if k} == dict(want)
    assert state(L.delete(back, spark.createDataFrame([(999,), (None,)], "doc_id long"))) == state(back)
    assert state(L.insert(first, back))[0] == state(back)[0]


def test_cuckoo_filter_keeps_all_keys_and_forgets_deleted_ones():
    rng = np.random.default_rng(1)
    hi, lo = (rng.integers(-2 ** 63, 2 ** 63 - 1, 20_000) for _ in range(2))
    f = L.Cuckoo(100)  # far too small: tables are added
    f.insert(hi[:10_000], lo[:10_000])
    assert f.contains(hi[:10_000], lo[:10_000]).all()
    assert f.contains(hi[10_000:], lo[10_000:]).mean() < 0.01
    f.delete(hi[:5_000], lo[:5_000])
    g = L.Cuckoo.load(f.dump())
    assert g.contains(hi[5_000:10_000], lo[5_000:10_000]).all()
    assert g.contains(hi[:5_000], lo[:5_000]).mean() < 0.01


def plain_fingerprint(text):
    words = lower(text or "").split(" ")
    words = [w for chunk in words for w in "".join(c if c not in WHITE else " " for c in chunk).split(" ") if w]
    if not words:
        return 0
    pieces = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, close):
    root = list(range(len(values)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(values)):
        for j in range(i):
            if close(values[i], values[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}é" for i in range(40)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([2, 30, 200]))] for _ in range(12)]
    rows = []
    for i in range(90):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = r.choice(vocabulary).upper()
        rows.append((i + 5, "\t ".join(words), "a"))
    rows += [(1, None, "a"), (2, "", "a"), (3, " \n ", None), (None, "w1é w2é", "a"), (7, rows[2][1], "a"), (4, "long " * 20_000, "a")]
    docs = documents(spark, rows)
    got = sorted(map(tuple, S.near_duplicates(docs).collect()), key=str)
    fp = [plain_fingerprint(t) for _, t, _ in rows]
    root = groups(fp, lambda a, b: bin(a ^ b).count("1") <= 4)
    least = {g: min((rows[i][0] for i in range(len(rows)) if root[i] == g and rows[i][0] is not None), default=None) for g in root}
    want = sorted(((d, f - (1 << 64) if f >> 63 else f, least[g]) for (d, _, _), f, g in zip(rows, fp, root)), key=str)
    assert got == want
    kept = [x.doc_id for x in S.keep_one(docs).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({g for g in least.values() if g is not None}) and kept.count(None) == 1
    assert S.keep_one(docs).columns == docs.columns
    assert S.near_duplicates(no_documents(spark)).count() == 0 == S.keep_one(no_documents(spark)).count()


def test_one_row_of_each_group_stays_with_and_without_ids(spark):
    r = random.Random(8)
    text = [" ".join(f"w{r.randrange(5000)}" for _ in range(80)) for _ in range(6)]
    rows = [(None, text[0], "a"), (None, text[0], "a"), (None, text[1], "a"), (4, text[1], "a"), (2, text[2], "a"), (9, text[2], "a"), (9, text[3], "a"),
            (9, text[3], "b"), (2, text[4], "a"), (1, text[4], "a"), (None, text[5], "a"), (None, None, "a"), (None, "", "a")]
    for parts in (1, 4):
        kept = [(x.doc_id, x.text or "") for x in S.keep_one(documents(spark, rows, parts)).collect()]
        want = [(None, text[0]), (4, text[1]), (2, text[2]), (9, text[3]), (1, text[4]), (None, text[5]), (None, "")]
        assert sorted(kept, key=str) == sorted(want, key=str)


def test_crowded_buckets_are_tiled_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 16)
    rng = np.random.default_rng(4)
    centre = [int(x) for x in rng.integers(0, 2 ** 63, 4)]
    fp = set()
    for _ in range(400):
        x = centre[int(rng.integers(4))]
        for b in rng.integers(0, 64, int(rng.integers(0, 7))):
            x ^= 1 << int(b)
        fp.add(x)
    fp = sorted(fp)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fp], "fp long")
    pairs = [(r.a % 2 ** 64, r.b % 2 ** 64) for r in S.links(df).collect()]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in pairs)
    at = {x: i for i, x in enumerate(fp)}
    edges = {(at[a], at[b]) for a, b in pairs} | {(at[b], at[a]) for a, b in pairs}
    joined = groups(list(range(len(fp))), lambda a, b: (a, b) in edges)
    close = groups(fp, lambda a, b: bin(a ^ b).count("1") <= 4)
    same = lambda roots: {frozenset(i for i, g in enumerate(roots) if g == r) for r in set(roots)}
    assert same(joined) == same(close)


def test_components_of_chains_stars_and_repeats(spark):
    r = random.Random(9)
    order = list(range(100, 160))
    r.shuffle(order)
    pairs = list(zip(order, order[1:])) + [(50, i) for i in range(1, 30)] + [(50, 3), (3, 50), (200, 200), (None, 7), (7, None), (-5, 300)]
    got = {x.node: x.root for x in C.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 160)} | {i: 1 for i in [*range(1, 30), 50]} | {-5: -5, 300: -5}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0
