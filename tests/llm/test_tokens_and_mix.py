import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glintframe.llm import mixing as M, repair as R
from glintframe.llm.queries import word_tokenizer
from tests.llm.helpers import documents, no_documents


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    first = 49408
    for ids in (np.array([], np.uint16), np.array([2], np.uint16), np.full(1000, 7, np.uint16), np.tile(np.array([5, 6, 7, 8, 2], np.uint16), 900),
                rng.integers(0, 40, 30_000).astype(np.uint16)):
        seq, rules = R.compress(ids, first)
        length = R.lengths(rules, first)
        assert (R.expand(seq, rules, first, length) == ids).all()
        assert len(seq) <= len(ids) and not (rules[:, 0] == R.END).any()
        for _ in range(20):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist()) if len(ids) else (0, 0)
            if a < b:
                assert (R.random_access(seq, rules, first, length, a, b) == ids[a:b]).all()
    assert len(R.compress(np.tile(np.arange(3, 19, dtype=np.uint16), 500), first)[0]) < 2000


def test_encoder_equals_the_tokenizer():
    t, e = Tokenizer.from_file(word_tokenizer()), R.encoder(word_tokenizer())
    r = random.Random(1)
    letters = "aAbBÅåIiİ'’sSdD.,!  \n\t́̇̊  \x1c<|>K0९१éÉ\x00漢"
    for _ in range(1500):
        x = "".join(r.choice(letters) for _ in range(r.randint(0, 30))) + r.choice(["", "<|endoftext|>", "<|ENDOFTEXT|>", "x<|startoftext|>y", "it's we'll"])
        assert e([x.encode()])[0].tolist() == t.encode(x, add_special_tokens=False).ids, ascii(x)


def test_encoder_learns_a_word_in_use_once(monkeypatch):
    monkeypatch.setattr(R, "CACHE", 400)
    t, e = Tokenizer.from_file(word_tokenizer()), R.Encoder(word_tokenizer())
    learnt, learn = Counter(), e._learn
    e._learn = lambda words: (learnt.update(words), learn(words))[1]
    common = [f"{x}{y}ing" for x in "bcdfg" for y in "aeiou"] + ["1,5", "été.", "Straße"]
    spell = lambda i: "".join("abcdefghij"[int(d)] for d in str(i))
    for k in range(40):
        texts = [" ".join(common), "", "Xyz <|endoftext|> <|ENDOFTEXT|>.", *[f"once{spell(30 * k + i)}, {common[i % 28]}" for i in range(30)], " \n"]
        assert [x.tolist() for x in e([x.encode() for x in texts])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert sum(n for w, n in learnt.items() if w.startswith(b"once")) == 1200
    assert max(learnt.values()) == 1


def test_token_files_round_trip(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["alpha", "Beta,", "gamma", "Straße", "l'été"]) for _ in range(r.randint(0, 60))), "a") for i in range(60)]
    rows += [(100, None, "a"), (101, "", "a"), (None, "no id", "a"), (5, "again", "b"), (102, "very long " * 30_000, None)]
    docs = documents(spark, rows)
    R.write_tokens(docs, str(tmp_path / "t"), word_tokenizer(), per_shard=500)
    got = R.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    t = Tokenizer.from_file(word_tokenizer())
    want = Counter((d, tuple(t.encode(x or "", add_special_tokens=False).ids + [2])) for d, x, _ in rows)
    assert Counter((g.doc_id, tuple(np.frombuffer(g.ids, "<u4").tolist())) for g in got) == want
    start = 0
    for g in got:
        assert (g.start, g.n_tokens) == (start, len(g.ids) // 4)
        start += g.n_tokens
    ids = [g.doc_id for g in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    digest = {(x.doc_id, x.start): x.ids_crc32 for x in R.read_tokens(spark, str(tmp_path / "t"), digest=True).collect()}
    assert digest == {(g.doc_id, g.start): zlib.crc32(g.ids) for g in got}
    assert spark.read.parquet(str(tmp_path / "t")).count() > 3
    R.write_tokens(no_documents(spark), str(tmp_path / "none"), word_tokenizer())
    assert R.read_tokens(spark, str(tmp_path / "none")).count() == 0


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def mix_rows():
    r = random.Random(8)
    shares = {"b": 300, "a": 40, "Z": 25, "é": 60, None: 15, "": 8, "empty": 5}
    rows, i = [], 0
    for s, n in shares.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * (0 if s == "empty" else r.choice([0, 1, 3, 50, 200]))), s))
            i += 1
    return rows + [(None, "no id here", "a"), (3, rows[3][1], "b"), (i, None, "b")]


def test_mix_meets_its_targets(spark):
    rows = mix_rows()
    docs = documents(spark, rows, 5)
    run = lambda: [tuple(x) for x in M.mix(docs, F.col("source"), M.word_count(F.col("text")), F.col("doc_id"))
                   .select("doc_id", "source", "mix_size", "mix_source_size", "mix_target", "mix_copies").collect()]
    got = run()
    assert Counter((d, s) for d, s, *_ in got) == Counter((d, s) for d, _, s in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target = plain_targets(sizes)
    taken, rate = defaultdict(int), {s: target[s] / sizes[s] if sizes[s] else 0 for s in sizes}
    for d, s, size, whole, goal, copies in got:
        assert whole == sizes[s] and abs(goal - target[s]) < 1e-6 * max(1, goal)
        assert math.floor(rate[s] - 1e-9) <= copies <= math.ceil(rate[s] - 1e-9) <= 3
        taken[s] += copies * size
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 200, s
    assert Counter(got) == Counter(run())
    out = M.mix_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(g[5] for g in got)
    assert M.mix_documents(no_documents(spark)).count() == 0


def test_pipeline_keeps_clean_documents_and_applies_every_stage(spark, tmp_path):
    import corpus_pipeline as P

    r = random.Random(4)
    vocabulary = ["river", "stone", "light", "garden", "window", "letter", "evening", "market", "harbour", "winter"]
    prose = lambda: " ".join(f"{r.choice(vocabulary)}{r.randrange(400)}" for _ in range(60)).capitalize() + "."
    junk = lambda: " ".join(f"{r.choice(vocabulary).upper()}!!" for _ in range(60))
    passage = [f"bench{i}" for i in range(40)]
    rows = [(i, prose() if i % 4 else junk(), "abc"[i % 3]) for i in range(400)]
    copy = (1000, rows[1][1], "a")
    dirty = (1001, prose() + " " + " ".join(passage[5:30]), "b")
    docs = documents(spark, [*rows, copy, dirty]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    now = docs
    seen = []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen.append({x.doc_id for x in now.select("doc_id").collect()})
    clean = {i for i, _, _ in rows if i % 4}
    assert seen[0] == clean | {1000, 1001}
    assert seen[1] == clean | {1001}
    assert seen[2] == clean
    final = P.STAGES[-1][1](spark, now, str(tmp_path))
    assert Counter(x.doc_id for x in final.collect()) == Counter(x.doc_id for x in now.select("doc_id").collect())
    assert P.run(spark, str(tmp_path)).count() == now.count()
    none = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


@pytest.mark.parametrize("text,n", [(None, 0), ("", 0), (" \t\n", 0), ("a b c", 2), ("x\x0by\x1cz", 2)])
def test_word_count_parts_at_ascii_white_space_only(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(M.word_count(F.col("t"))).first()[0] == n


def test_stages_keep_columns_whatever_their_names(spark):
    from glintframe.llm import decontam, mixing, simhash

    names = ("__row", "row", "hash", "doc", "__hash", "mix_copies", "mix_size", "mix_source_size", "mix_target", "size", "at", "part", "fp", "key")
    rows = [(i, f"text number {i % 3} of many words " * 20, "s") for i in range(6)] + [(None, None, None), (None, None, None)]
    docs = documents(spark, rows).withColumns({n: F.lit(n) for n in names})
    benchmark = spark.createDataFrame([("i", "no such passage in any of the documents here")], "item_id string, text string")
    for stage in (simhash.keep_one, lambda d: decontam.clean_documents(d, benchmark), mixing.mix_documents):
        got = stage(docs)
        assert got.columns == docs.columns
        found = got.collect()
        assert found and all(r[n] == n for r in found for n in names)
