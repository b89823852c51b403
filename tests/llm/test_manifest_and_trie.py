"""Exact dedup, Merkle manifest and conversation trie against brute force."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from glintframe.llm import exactdedup, merkle, prefixtrie, queries
from tests.llm.helpers import documents, no_documents

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
ROWS = [(1, "a b", "s"), (2, "a  \n b", None), (3, None, "s"), (4, "", "t"), (5, "a b ", "s"), (6, "x" * 200_000, "s"), (7, "x" * 200_000, "s"),
        (None, "a\tb", "s"), (None, "lone", "s"), (None, "lone", "s"), (9, "é ü", "s"), (9, "é ü", "s"), (8, "É ü", "s"), (0, "\x0b\x0ca", "s")]


def _groups(rows):
    norm = [re.sub(r"[ \t-\r]+", " ", t or "") for _, t, _ in rows]
    return [(d, min((x for (x, _, _), n in zip(rows, norm) if n == m and x is not None), default=None), norm.count(m), H(m)) for (d, _, _), m in zip(rows, norm)]


@pytest.mark.parametrize("most", [exactdedup.MOST_BLOCKS, 1])
def test_exact_duplicates(spark, monkeypatch, most):
    monkeypatch.setattr(exactdedup, "MOST_BLOCKS", most)
    got = exactdedup.duplicates(documents(spark, ROWS)).collect()
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(_groups(ROWS), key=key)
    kept = [r for r in got if r.kept]
    assert len({r.text_sha256 for r in kept}) == len(kept) == len({x[3] for x in _groups(ROWS)})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_full_second_filter_only_lets_more_rows_through(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "BITS_A_CELL", 0)
    monkeypatch.setattr(exactdedup, "HASHES", 1)
    rows = [(i, f"text {i % 3000}", "s") for i in range(5000)]
    got = exactdedup.duplicates(documents(spark, rows))
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got.collect()) == [(i, i % 3000, 2 if i % 3000 < 2000 else 1) for i in range(5000)]


def test_filter_passes_most_single_rows_and_all_copies(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 2000, F.col("id") % 1000).otherwise(F.col("id")).cast("string").alias("k"))
    marked = exactdedup.with_suspicion(rows, "k")
    assert marked.where("suspect and cast(k as long) < 1000").count() == 2000
    assert marked.where("suspect").count() < 2300


def test_rows_kept_whole_with_clashing_columns(spark):
    docs = documents(spark, ROWS).withColumns({c: F.lit(c) for c in ("suspect", "digest", "place", "bloom_bits", "bloom_in", "group_size", "least")})
    got = exactdedup.keep_first(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == len({x[3] for x in _groups(ROWS)}) and all(r.suspect == "suspect" and r.bloom_in == "bloom_in" for r in rows)
    assert {r.doc_id for r in rows} == {0, 1, 3, 5, 6, 8, 9, None}
    assert exactdedup.keep_first(no_documents(spark)).count() == 0 and exactdedup.duplicates(no_documents(spark)).count() == 0


def _dataset(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string").repartition(3)


def _leaf(d, source, lang, n, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)))


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def _proofs(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    levels = {k: _levels([_leaf(*r) for r in sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, _leaf(*r)))]) for k, v in trees.items()}
    names = sorted(levels, key=lambda k: (k is not None, (k or "").encode()))
    top = _levels([levels[k][-1][0] for k in names])
    siblings = lambda tree, i: [lvl[i >> h ^ 1] for h, lvl in enumerate(tree[:-1]) if (i >> h ^ 1) < len(lvl)]
    return sorted((leaf, levels[k][-1][0], top[-1][0], H(*siblings(levels[k], i), *siblings(top, j))) for j, k in enumerate(names) for i, leaf in enumerate(levels[k][0]))


MORE = [(i, f"s{i % 3}", ["en", "de", "é", None, ""][(i * i + i // 7) % 5], None if i % 11 == 0 else i, "t" * (i % 40)) for i in range(70)]
MORE += [(None, None, None, None, None), (None, None, None, None, None), (3, "s", "en", 1, "again"), (3, "s", "en", 1, "again"), (500, "s", "xx", 1, "x" * 100_000)]


@pytest.mark.parametrize("block", [2, 10])
def test_witnesses(spark, block):
    shown = merkle.witnesses(merkle.append(None, _dataset(spark, MORE), block, half=F.lit(None).cast("binary")))
    got = merkle.refold(shown, "leaf").collect()
    assert all(r.folded_root == r.root for r in got)
    assert sorted((r.leaf.hex(), r.subroot.hex(), r.root.hex(), H((r.path + r.tree_path).hex())) for r in got) == _proofs(MORE)
    assert all(r.folded_root != r.root for r in merkle.refold(shown.withColumn("bad", F.unhex(F.sha2("path", 256))), "bad").collect())


def test_appending_gives_the_manifest_of_the_whole(spark):
    rows = [r for r in MORE if r[0] is not None and r[0] != 3]
    cuts, block = [0, 5, 37, 1000], 2
    state = None
    for a, b in zip(cuts, cuts[1:]):
        state = merkle.append(state, _dataset(spark, [r for r in rows if a <= r[0] < b]), block)
    got = merkle.refold(merkle.witnesses(state), "leaf").collect()
    assert all(r.folded_root == r.root for r in got)
    assert sorted((r.leaf.hex(), r.subroot.hex(), r.root.hex(), H((r.path + r.tree_path).hex())) for r in got) == _proofs(rows)
    with pytest.raises(ValueError):
        merkle.append(state, _dataset(spark, [(2, "s", "en", 1, "late")]))


def test_no_rows_no_witnesses(spark):
    assert merkle.witnesses(merkle.append(None, _dataset(spark, []))).count() == 0


def _trie(sequences):
    """Brute force over ``{conv: [(role, text)]}``."""
    nodes = {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(conv)
    kids, leaves, saved = ({p: 0 for p in nodes} for _ in range(3))
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        words = len(re.findall(r"[^ \t-\r]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * words
    rows = []
    for path, members in nodes.items():
        ends = sorted(c for c in members if len(sequences[c]) == len(path))
        rows.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), kids[path], leaves[path], saved[path], H(",".join(map(str, ends)))))
    return sorted(map(str, rows))


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _conversations(seed):
    random.seed(seed)
    rows = [(c, t, random.choice(["user", "bot", None]), random.choice(["a", "a b", "", None, "c  d\ne"])) for c in [*range(-3, 45), 1000, 2**40] for t in range(random.choice([1, 2, 5]))]
    rows += [(c, None if t == 0 else t, "user", f"same {t}") for c in range(100, 160) for t in range(20)] + [(7777, t, "user", f"long {t} " * 40) for t in range(300)]
    return rows


@pytest.mark.parametrize("shard", [6, 1 << 14])
def test_trie_of_sequences(spark, shard):
    rows = _conversations(1)
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, words int, depth int").repartition(5)
    got = prefixtrie.prefix_trie(prefixtrie.turn_rows(frame), ["turn"], shard)
    seq = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        seq.setdefault(c, []).append((role or "", text or ""))
    assert sorted(str(tuple(r[c] for c in COLUMNS)) for r in got.collect()) == _trie(seq)


def _rebuilt(rows):
    own = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    base = lambda c: c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
    h = lambda c: zlib.crc32(str(c).encode()) % 4
    return {c: own.get(base(c), [])[:h(c)] + own[c][h(c):] for c in own}


def test_query_over_awkward_conversations(spark, tmp_path):
    rows = [r for r in _conversations(2) if r[0] != 7777] + [(201, 0, "x", "only")]
    frame = spark.createDataFrame([*rows, (None, 1, "user", "nobody")], "conv_id long, turn long, role string, text string")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.QUERIES["op13_conversation_trie"](spark, str(tmp_path))
    want = _rebuilt(rows)
    assert any(not v for v in want.values())
    assert sorted(str(tuple(r[c] for c in COLUMNS)) for r in got.collect()) == _trie(want)


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixtrie.prefix_trie(queries.rebuilt(prefixtrie.turn_rows(none)), ["part", "p"]).count() == 0
