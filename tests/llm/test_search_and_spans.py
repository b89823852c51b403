import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from glintframe.llm import bm25 as B, decontam as D, styletree as S
from tests.llm.helpers import documents, no_documents


def plain_top_k(docs, queries, k):
    split = [[w.decode() for w in D.words((t or "").encode())] for _, t, _ in docs]
    df, n = Counter(w for words in split for w in set(words)), len(docs)
    mean = sum(map(len, split)) / n
    out = []
    for q, text in queries:
        terms = set(w.decode() for w in D.words((text or "").encode()))
        found = []
        for (d, _, _), words in zip(docs, split):
            tf, s = Counter(words), 0.0
            for t in sorted(terms):
                if tf[t]:
                    s += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(words) / mean))
            if s > 0:
                found.append((round(s, 6), d))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(q, i + 1, d, s) for i, (s, d) in enumerate(found[:k])]
    return sorted(out, key=str)


def test_top_k_equals_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"t{i}" for i in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary[:r.choice([6, 6, 40, 400])]) for _ in range(n))
    rows = [(i, text(r.choice([0, 1, 20, 120])), "a") for i in range(300)]
    rows += [(900 + i, rows[7][1], "copies") for i in range(15)] + [(800, None, "a"), (801, "", None), (None, rows[9][1], "a"), (7, rows[7][1], "a"), (802, "t1 " * 40_000, "a")]
    docs = documents(spark, rows, 4)
    queries = [(i, rows[i][1]) for i in range(0, 300, 12)] + [(1000, "t1 T2 t3"), (1001, "nowhere to be found"), (1002, None), (1003, "t399")]
    asked = spark.createDataFrame(queries, "query_id long, text string")
    got = sorted([tuple(x) for x in B.top_k(docs, asked, 10).collect()], key=str)
    want = plain_top_k(rows, queries, 10)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want))
    assert B.top_k(docs, asked.limit(0)).count() == 0 == B.top_k(no_documents(spark), asked).count()


def test_queries_meet_shards_together(monkeypatch):
    """Documents are scored exactly for a task's best, not for the best of each shard, and like texts meet like texts."""
    import types

    import pyarrow as pa

    r = random.Random(8)
    tongues = [[f"{c}{i}" for i in range(300)] for c in "abc"]
    text = lambda w, n: " ".join(r.choice(w[:r.choice([20, 80, 300])]) for _ in range(n))
    rows = [(i, text(tongues[i % 3], r.choice([1, 30, 90])), "a") for i in range(3000)]
    rows += [(5000 + i, rows[30][1], "copies") for i in range(30)] + [(None, rows[60][1], "a"), (4000, rows[60][1], "a"), (4001, "", None)]
    queries = [(i, rows[i][1]) for i in range(0, 3000, 15)] + [(7000, "a0"), (7001, "a1 b2 c3 nowhere")]
    monkeypatch.setattr(B, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 3)))
    for name, value in (("SHARD_DOCS", 250), ("ROW_TERMS", 500), ("SCORES", 3000), ("CELLS", 700), ("TABLE", 40), ("PART", 30), ("WAITING", 600)):
        monkeypatch.setattr(B, name, value)
    batch = lambda x: pa.RecordBatch.from_arrays([pa.array([d for d, *_ in x], pa.int64()), pa.array([t for _, t, *_ in x])], names=["doc_id", "text"])
    index = [x for b in B._build(batch(rows[i:i + 250]) for i in range(0, len(rows), 250)) for x in b.to_pylist()]
    df = Counter(t for x in index for t, n in zip(*B.unpack(x["terms"])) for _ in range(n))
    terms = [(q, 1, t, df[t]) for q, x in queries for t in sorted(set(B._hashes([x.encode()])[0])) if df[t]]
    packed = [x for b in B._packed(pa.RecordBatch.from_arrays([pa.array(np.array(c).astype(np.int64) if i != 2 else np.array(c, np.uint64).view(np.int64))
                                                               for i, c in enumerate(zip(*terms[j:j + 70]))], names=list("qatd")) for j in range(0, len(terms), 70)) for x in b.to_pylist()]
    assert len(index) == 13 and len(packed) > 5 and sum(x["n_terms"] for x in packed) == len(terms)
    scored, exact = [0], B.Shard.exact
    monkeypatch.setattr(B.Shard, "exact", lambda self, docs, marked: (scored.__setitem__(0, scored[0] + len(docs)), exact(self, docs, marked))[1])
    asked = B.Asked([x["terms"] for x in packed], len(rows), 10)
    mean = sum(x["n_words"] for x in index) / len(rows)
    for x in index:
        shard = B.Shard(asked, x["docs"], x["terms"], x["postings"], mean)
        for part in asked.parts:
            part.meet(shard)
    got = {}
    for part in asked.parts:
        for q, score, missing, d in zip(*part.best):
            got.setdefault(int(part.query[q]), []).append((None if missing else int(d), float(score)))
    want = {}
    for q, _, d, score in plain_top_k(rows, queries, 10):
        want.setdefault(q, []).append((d, score))
    for q in want:
        want[q].sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        assert [d for d, _ in got[q]] == [d for d, _ in want[q]] and all(abs(a[1] - b[1]) < 2e-6 for a, b in zip(got[q], want[q])), q
    assert set(got) == set(want) and len(asked.parts) >= 7
    assert scored[0] < 5 * 10 * len(queries)  # each of the 13 shards had its own best ten before


def test_top_k_in_several_lots(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("uvwxyz") + str(r.randrange(40)) for _ in range(30)), "a") for i in range(400)]
    docs = documents(spark, rows, 5)
    queries = [(i, rows[i][1]) for i in range(0, 400, 8)]
    monkeypatch.setattr(B, "TASK_TERMS", 500)
    asked = spark.createDataFrame(queries, "query_id long, text string")
    got = sorted([tuple(x) for x in B.top_k(docs, asked, 10).collect()], key=str)
    want = plain_top_k(rows, queries, 10)
    assert [x[:3] for x in got] == [x[:3] for x in want]


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(2)
    for symbols in (1, 3, 50):
        text = rng.integers(1, symbols + 1, 3000)
        text[rng.integers(0, 3000, 200)] = 0
        text[1000:1400] = text[200:600]
        text[-1] = 0
        index = D.FMIndex(text, symbols)
        phrases = [text[i:i + n] for i, n in zip(rng.integers(0, 2980, 150), rng.integers(1, 14, 150)) if (text[i:i + n] > 0).all()]
        phrases += [rng.integers(1, symbols + 1, 5) for _ in range(20)]
        matrix = np.zeros((len(phrases), 13), np.int64)
        for i, p in enumerate(phrases):
            matrix[i, 13 - len(p):] = p
        low, high = index.search(matrix, np.array([len(p) for p in phrases]))
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(len(text) - len(p) + 1) if (text[i:i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_wavelet_ranks_and_access():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 11, 500)
    tree = D.WaveletTree(x, 4)
    assert (tree.access(np.arange(500)) == x).all()
    for c in range(12):
        at = rng.integers(0, 501, 20)
        assert (tree.rank(np.full(20, c), at) == [(x[:i] == c).sum() for i in at]).all()


def plain_spans(docs, items):
    phrases = defaultdict(set)
    for item, text in items:
        w = D.words((text or "").encode())
        for i in range(max(1, len(w) - 12) if w else 0):
            phrases[tuple(w[i:i + 13])].add("" if item is None else str(item))
    out = []
    for d, text, _ in docs:
        w, hit, found = D.words((text or "").encode()), set(), set()
        for p, owners in phrases.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i:i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found |= owners
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def test_occurrences_equal_brute_force(spark, monkeypatch):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "Ωmega", "x-y"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([14, 20, 40]))) for i in range(12)] + [(50, "only three words"), (51, None), (52, "..."), (53, text(13)), (None, text(15))]
    items += [(54, items[0][1]), (0, items[0][1])]
    rows = []
    for i in range(60):
        words = text(r.choice([0, 5, 60, 300])).split()
        for _ in range(r.randint(0, 3)):
            piece = (r.choice(items)[1] or "").upper().split()
            a = r.randrange(len(words) + 1)
            words[a:a] = piece[r.randint(0, 3):] if len(piece) > 3 else piece
        rows.append((i, ", ".join(words), "a"))
    rows += [(70, None, "a"), (71, "", "a"), (None, items[1][1], None), (3, rows[3][1], "b"), (72, (items[2][1] + " ") * 300, "a")]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = plain_spans(rows, items)
    shape = lambda found: sorted(((x.doc_id, x.n_words, sum(b - a for a, b in x.spans), tuple(x["items"])) for x in found.collect()), key=str)
    assert shape(D.occurrences(docs, bench)) == want
    monkeypatch.setattr(D, "BLOCK_WORDS", 60)  # the benchmark in several passes
    assert shape(D.occurrences(docs, bench)) == want
    flagged = {x.doc_id for x in D.contamination(D.occurrences(docs, bench)).where("contaminated").collect()}
    assert flagged == {d for d, n, hit, _ in want if hit and 20 * hit >= n}
    clean = D.clean_documents(docs, bench)
    assert clean.columns == docs.columns and {x.doc_id for x in clean.collect()} == {d for d, *_ in rows} - flagged
    assert D.occurrences(no_documents(spark), bench).count() == 0
    assert all(x.spans == [] for x in D.occurrences(docs, bench.limit(0)).collect())


def test_rows_go_by_themselves_and_not_by_id(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(30))
    bench = spark.createDataFrame([(1, passage), (2, passage.upper() + " more")], "item_id long, text string")
    rows = [(None, passage, "a"), (None, "clean one", "a"), (None, "clean two", "a"), (None, None, "a"), (5, "x " + passage, "a"), (5, "clean three", "a"), (6, "clean four", "a"), (6, "clean four", "a")]
    want = sorted(t or "" for _, t, _ in rows if passage not in (t or ""))
    for words in (1 << 18, 10):
        monkeypatch.setattr(D, "BLOCK_WORDS", words)
        assert sorted(x.text or "" for x in D.clean_documents(documents(spark, rows), bench).collect()) == want


def test_spans_merge():
    assert D.merge_spans([(5, 8), (0, 2), (2, 3), (7, 9), (5, 6)]) == [(0, 3), (5, 9)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=x>menu</a></ul></nav><div id="cookie-notice">cookies</div><!-- <p>no</p> -->%s
<aside>side</aside><div class="comments"><p>a reader</p></div><form>f<input></form><footer>&copy; foot</footer></body></html>"""


def test_blocks_of_a_page():
    article = "<article class='with-comments'><h1>One &amp; two</h1><p>First <b>bold\n  text<p>Second&nbsp;line<br>goes on<ul><li>a<li>b</ul><div class=ad>buy</div><table><tr><td>1<td>2</table></article>"
    assert S.main_blocks(PAGE % article) == ["One & two", "First bold text", "Second line goes on", "a", "b", "1", "2"]
    loose = "<div class=content><h2>Head</h2><p>Text</p><p hidden>gone</p></div><section class='post-comments'>c</section>"
    assert S.main_blocks(PAGE % loose) == ["Head", "Text"]
    assert S.main_blocks("") == [] and S.main_blocks("bare &lt;text") == ["bare <text"]
    assert S.main_blocks("<p>cut <b>off &am") == ["cut off &am"] and S.main_blocks("<p>x<p class=") == ["x"]
    assert S.main_blocks("<script>never closed <p>x") == [] and S.main_blocks("</div></p>a<span class=advert>b</span>c") == ["a", "c"]
    assert S.main_blocks("<p>" + "long " * 50_000)[0].count("long") == 50_000


def test_hints_take_no_article_with_them():
    article = "<main><article><p>Kept</p><div class=ad>buy</div></article></main>"
    for names in ("class='layout has-sidebar'", "id=page-with-banner", "class=content-widget", "class=no-sidebar", "class='entry social-enabled'"):
        assert S.main_blocks(f"<body><div {names}>{article}</div></body>") == ["Kept"], names
    for names in ("class=no-sidebar", "class='entry social-enabled'", "id=page-with-banner"):
        assert S.main_blocks(f"<body><div {names}><p>Loose</p></div></body>") == ["Loose"], names
    assert S.main_blocks("<div class=sidebar><p>side</p></div><nav><div class=menu><main>menu</main></div></nav><p>Text</p>") == ["Text"]
    comments = "<div class=comments><article class=comment><p>a reader</p></article></div><p>Text</p>"
    assert S.main_blocks(comments) == ["Text"]


def test_branches_that_a_site_repeats_go(spark):
    page = lambda i: f"<html><body><div class=teaser2x>Same words everywhere</div><div class=text><p>Text {i} of the page.</p><p>Shared line.</p></div></body></html>"
    rows = [(i, f"https://one.example/{i}", page(i), "x") for i in range(20)]
    rows += [(100, "https://few.example/1", page(1), "x"), (101, "no url at all", page(2), "x"), (102, None, page(3), "x"), (103, "https://one.example/n", None, "x"),
             (104, "https://one.example/e", "", "x"), (5, "https://one.example/5", page(5), "x"), (None, "https://ONE.example/5", page(5), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, low string")
    got = {(r.page_id, r.url): r.text for r in S.main_text(df).collect()}
    assert len(got) == len(rows) - 1 and S.main_text(df).count() == len(rows)
    for i in range(20):
        assert got[i, f"https://one.example/{i}"] == f"Text {i} of the page.\n\nShared line."
    assert got[None, "https://ONE.example/5"] == got[5, "https://one.example/5"]
    for k in ((100, "https://few.example/1"), (101, "no url at all"), (102, None)):
        assert got[k].startswith("Same words everywhere")
    assert got[103, "https://one.example/n"] == got[104, "https://one.example/e"] == ""
    importance = {r.path: r.importance for r in S.style_tree(df).where("host = 'one.example'").collect()}
    low = [v for k, v in importance.items() if k.endswith("div.teaserx")]
    assert low and max(low) < 0.05 and [v for k, v in importance.items() if k.endswith("div.text")][0] > 0.5
    assert S.main_text(df.limit(0)).count() == 0


STORY = "".join(f"<p>Paragraph {i} of the story, which is long enough.</p>" for i in range(4))
TEXTS = [f"Paragraph {i} of the story, which is long enough." for i in range(4)]


@pytest.mark.parametrize("page", [
    f"<body><form action=x><div>{STORY}</div></form></body>", f"<body><form><article>{STORY}</article><button>Go</button></form></body>",
    f"<div>{STORY}</div><article><h3>Teaser</h3></article>", f"<main><div>{STORY}</div><article>Teaser</article></main>",
    *(f"<body><div class='{c}'>{STORY}</div><div class=sidebar>Side</div></body>" for c in
      ("content-area sidebar-right", "post social-post", "elementor-widget-wrap", "hentry tags")),
    f"<div class='page sidebar-left'><div class=sidebar>Side</div>{STORY}<form><p>Sign up</p></form></div>",
    f"<article>{STORY}</article><div class=sidebar>{STORY}{STORY}</div>",
    f"<div>{STORY}</div><div class=comments>{STORY}{STORY}{STORY}</div>"])
def test_no_hint_form_or_teaser_takes_the_story(page):
    assert S.main_blocks(page) == TEXTS
