"""The ``opN_*`` queries over the given tables, and their DuckDB text where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from glintframe.llm import bm25, decontam, exactdedup, hpylm, linededup, merkle, mixing, nbsvm, prefixtrie, repair, simhash, styletree, toxicity
from glintframe.llm.common import remainder, table
from glintframe.session import materialize, shared_dir

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def word_tokenizer() -> str:
    """Path of the public tokenizer that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _crc32(value: str) -> str:
    """``crc32`` of a number's digits, bit by bit; DuckDB has no function for it."""
    digits = f"list_transform(string_split({value}::varchar, ''), lambda c: ascii(c)::bigint)"
    bits = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::bigint))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {digits}), lambda a, b: {bits}), 4294967295::bigint)"


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op1_line_dedup", rf"""
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) a from documents),
lines as (select doc_id, unnest(a) line, unnest(range(len(a))) i from split),
keyed as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {_AZ}) k from lines),
shared as (select k, min(doc_id) f from keyed where length(k) >= 10 group by k having count(distinct doc_id) > 1),
marked as (select keyed.*, f is not null and f < doc_id as gone from keyed left join shared using (k))
select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) kept_sha256
from marked group by doc_id""")
def op1(spark, sf):
    docs = table(spark, sf, "documents")
    found = linededup.dedup_lines(linededup.insert(docs), docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op2_top_k_search", f"""
with t as (select doc_id, unnest({_WORDS}) t from documents),
n as (select count(*) docs, (select count(*) from t) / count(*) mean from documents),
tf as (select doc_id, t, count(*) tf from t group by doc_id, t),
len as (select doc_id, count(*) dl from t group by doc_id),
df as (select t, count(*) df from tf group by t),
q as (select doc_id query_id, t from tf where doc_id % 100 = 0),
s as (select query_id, tf.doc_id, round(sum(ln(1 + (docs - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double
             / (tf + 1.2::double * (0.25::double + 0.75::double * dl / mean))), 6) score
      from q join tf using (t) join df using (t) join len on len.doc_id = tf.doc_id, n group by query_id, tf.doc_id),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s)
select query_id, rank, doc_id, score from r where rank <= 10""")
def op2(spark, sf):
    docs = table(spark, sf, "documents")
    return bm25.top_k(docs, docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text"))


@query("op3_toxicity")
def op3(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    found = toxicity.score(docs, toxicity.learn(docs, nbsvm.training_labels(labels, "toxic")))
    return found.select("doc_id", nbsvm.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_repair_tokens")
def op4(spark, sf):
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    repair.write_tokens(table(spark, sf, "documents"), path, word_tokenizer())
    return repair.read_tokens(spark, path, digest=True)


@query("op5_html_main_text")
def op5(spark, sf):
    return styletree.main_text(table(spark, sf, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op6_benchmark_decontamination", f"""
with d as (select doc_id, {_WORDS} w from documents),
b as (select item_id, {_WORDS} w from benchmark),
phrases as (select item_id, array_to_string(w[i:i+12], ' ') p, least(len(w), 13) n
            from (select *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i from b where len(w) > 0)),
widths as (select distinct n from phrases),
spots as (select doc_id, n, i, array_to_string(w[i:i+n-1], ' ') p from (select *, unnest(range(1, len(w) - n + 2)) i from d, widths where len(w) >= n)),
found as (select distinct doc_id, item_id, i, s.n from spots s join phrases q on s.p = q.p and s.n = q.n),
hit as (select doc_id, count(distinct spot) n_hit from (select doc_id, unnest(range(i, i + n)) spot from (select distinct doc_id, i, n from found)) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) names from (select distinct doc_id, item_id::varchar item from found) group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(names, '')) items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join hit using (doc_id) left join items using (doc_id)""")
def op6(spark, sf):
    found = decontam.contamination(decontam.occurrences(table(spark, sf, "documents"), table(spark, sf, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op7_pitman_yor_scores")
def op7(spark, sf):
    return hpylm.scores(table(spark, sf, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op8_quality_classifier")
def op8(spark, sf):
    found = nbsvm.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return found.select("doc_id", nbsvm.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= nbsvm.THRESHOLD).cast("int").alias("predicted"))


@query("op9_mix_sources", r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::bigint size from documents),
s as (select source, sum(size)::bigint source_size, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] weight from d group by source),
l as (select *, 3 * source_size / weight full_at, (sum(source_size) over () - coalesce(sum(3 * source_size) over (order by 3 * source_size / weight, source nulls last
        rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by 3 * source_size / weight, source nulls last rows between current row and unbounded following) as lvl from s),
t as (select source, source_size, least(weight * (select arg_min(lvl, full_at) from l where lvl <= full_at), (3 * source_size)::double) target,
             ('0x' || substr(md5('mix' || case when source is null then '|0' else '|1' end || coalesce(source, '')), 1, 6))::int / 16777216.0::double u from s),
r as (select d.*, source_size, target, case when source_size > 0 then target / source_size else 0 end rate, u,
             row_number() over (partition by d.source order by size, doc_id nulls first) - 1 k from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (least(floor((k + 1) * rate + u) - floor(k * rate + u), ceil(rate)) * size)::bigint taken from r""")
def op9(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(docs, F.col("source"), F.col("size"), F.col("doc_id"))
    return mixed.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
                        (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


@query("op10_simhash_near_dedup")
def op10(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op12_exact_dedup", r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') t from documents)
select doc_id, min(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
       doc_id = min(doc_id) over (partition by t) kept, sha256(t) text_sha256 from n""")
def op12(spark, sf):
    return exactdedup.duplicates(table(spark, sf, "documents"))


def _field(c):
    return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"


_LEAF = "sha256(" + " || ".join(_field(c) for c in merkle.FIELDS) + ")"


@query("op11_merkle_manifest", f"""
with recursive d as (
  select doc_id, lang, {_LEAF} leaf, {_LEAF.replace("n_chars", "(n_chars + 1)")} bad from documents),
p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 i from d),
up as (
  select lang, 0 lvl, list(leaf order by i) a from p group by lang
  union all
  select lang, lvl + 1, [sha256(a[2 * k + 1] || coalesce(a[2 * k + 2], '')) for k in range((len(a) + 1) // 2)] from up where len(a) > 1),
sub as (select lang, a[1] subroot, row_number() over (order by lang nulls first) - 1 j from up where len(a) = 1),
top as (
  select 0 lvl, list(subroot order by j) a from sub
  union all
  select lvl + 1, [sha256(a[2 * k + 1] || coalesce(a[2 * k + 2], '')) for k in range((len(a) + 1) // 2)] from top where len(a) > 1),
r as (select p.*, subroot, j, row_number() over () id from p join sub on p.lang is not distinct from sub.lang),
path as (
  select id, up.lvl, i >> up.lvl spot, a[(xor(i >> up.lvl, 1) + 1)::int] sib from r join up on r.lang is not distinct from up.lang where len(a) > 1
  union all
  select id, 1000 + top.lvl, j >> top.lvl, a[(xor(j >> top.lvl, 1) + 1)::int] from r, top where len(a) > 1),
step as (select *, row_number() over (partition by id order by lvl) k from path),
proof as (select id, sha256(coalesce(string_agg(sib, '' order by lvl), '')) proof_sha256, count(*) steps from path group by id),
walk as (
  select id, 1 k, case when crc % 7 = 0 then coalesce(bad, leaf) else leaf end cur from (select *, {_crc32("doc_id")} crc from r)
  union all
  select w.id, w.k + 1, sha256(case when spot % 2 = 1 then sib || cur else cur || coalesce(sib, '') end) from walk w join step s on w.id = s.id and w.k = s.k),
last as (select id, arg_max(cur, k) folded_root from walk group by id)
select doc_id, leaf, subroot, (select a[1] from top where len(a) = 1) root, coalesce(proof_sha256, sha256('')) proof_sha256, folded_root,
       folded_root = (select a[1] from top where len(a) = 1) verified
from r left join proof using (id) join last using (id)""")
def op11(spark, sf):
    docs = table(spark, sf, "documents")
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS]
    tampered = F.when(remainder(F.col("doc_id"), 7) == 0, F.unhex(merkle.leaf(changed)))
    proved = merkle.witnesses(merkle.append(None, docs, tampered=tampered))
    text = lambda c: F.lower(F.hex(c))
    found = merkle.refold(proved.withColumn("shown", F.coalesce("tampered", "leaf")), "shown")
    return found.select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
                        F.sha2(text(F.concat("path", "tree_path")).cast("binary"), 256).alias("proof_sha256"),
                        text("folded_root").alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


def rebuilt(turns):
    """Every conversation ``c`` anew: the first ``h`` turns of ``c - c % 20``, then its own after its first ``h``; ``h = crc32(c) % 4``.

    Rows ``conv_id, part, p, key, words`` and for each conversation one without a key. Turns that share a number stand in order of their keys.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")) - 1
    own = materialize(turns.select("conv_id", "key", "words", place.alias("p"), remainder(F.col("conv_id"), 4).alias("h")))
    names = own.where("p = 0").select("conv_id", "h", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"))
    heads = own.where("p < 3").select(F.col("conv_id").alias("base"), "p", "key", "words")
    return (own.where("p >= h").select("conv_id", F.lit(2).alias("part"), "p", "key", "words")
            .unionByName(names.where("h > 0").join(heads, "base").where("p < h").select("conv_id", F.lit(1).alias("part"), "p", "key", "words"))
            .unionByName(names.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("p"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("words"))))


@query("op13_conversation_trie", rf"""
with c as (select conv_id, list(md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) order by turn nulls first) k,
                  list(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) order by turn nulls first) w, {_crc32("conv_id")} % 4 h
           from conversations where conv_id is not null group by conv_id),
r as (select c.conv_id, list_concat(coalesce(b.k, [])[1:c.h], c.k[c.h + 1:]) k, list_concat(coalesce(b.w, [])[1:c.h], c.w[c.h + 1:]) w
      from c left join c b on b.conv_id = c.conv_id - c.conv_id % 20),
m as (select conv_id, unnest(range(len(k) + 1)) d, k, w from r),
p as (select conv_id, d, len(k) n, array_to_string(k[1:d], ' ') name, array_to_string(k[1:d - 1], ' ') up, case when d > 0 then w[d] else 0 end words from m),
nodes as (select name, any_value(up) up, any_value(d) depth, any_value(words) words, min(conv_id) conv_id, count(*) n_convs,
                 sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (d = n), '')) ends_sha256 from p group by name),
kids as (select up name, count(*) n_children from nodes where depth > 0 group by up),
full_nodes as (select nodes.*, coalesce(n_children, 0) n_children from nodes left join kids using (name)),
below as (select a.name, count(*) filter (b.n_children = 0) n_leaves, sum((b.n_convs - 1) * b.words)::bigint saved_tokens
          from full_nodes a join full_nodes b on starts_with(b.name, a.name) group by a.name)
select f.conv_id, f.depth, u.conv_id parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
from full_nodes f join below using (name) left join full_nodes u on f.depth > 0 and u.name = f.up""")
def op13(spark, sf):
    turns = prefixtrie.turn_rows(table(spark, sf, "conversations"))
    return prefixtrie.prefix_trie(rebuilt(turns), ["part", "p"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
