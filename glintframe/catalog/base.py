"""Registry of runnable queries, and the stand-in inputs they read.

Each stand-in is the same view twice: a Spark DataFrame over the given Parquet tables,
and the DuckDB text of the same relation for the cross-check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from glintframe.session import ship_code

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query under ``name``; ``covers`` lists the inventory rows it answers."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return ship_code(spark).read.parquet(f"{sf}/{name}.parquet")


SIDE = 8  # an embedding of 64 values is read as an 8 x 8 frame


def cells(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return (e.select(F.col("label").cast("long").alias("scene"), F.col("vec_id").alias("frame"), F.posexplode("embedding"))
            .select("scene", "frame", "pos", F.col("col").cast("double").alias("v")))


def grid(spark, sf) -> DataFrame:
    """Paired score maps of 8 x 8 frames."""
    p = F.col("pos")
    raw = F.least(F.lit(1.0), F.abs("v"))
    return cells(spark, sf).select(
        "scene", "frame", F.floor(p / SIDE).cast("int").alias("y"), (p % SIDE).cast("int").alias("x"),
        p.cast("int").alias("pos"), F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), raw.alias("raw"),
        (raw * (0.55 + 0.05 * (p % 11))).alias("outp"))


def rgb(spark, sf) -> DataFrame:
    """Three-channel frames: the channels are the same vector read from three starting points."""
    e = table(spark, sf, "embeddings")
    n = SIDE * SIDE
    at = lambda shift: F.least(F.lit(1.0), 2 * F.abs(F.element_at("embedding", ((F.col("pos") + shift) % n + 1).cast("int")).cast("double")))
    return (e.select(F.col("label").cast("long").alias("scene"), F.col("vec_id").alias("frame"), "embedding",
                     F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pos"))
            .select("scene", "frame", F.floor(F.col("pos") / SIDE).cast("int").alias("y"), (F.col("pos") % SIDE).cast("int").alias("x"),
                    "pos", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"),
                    at(0).alias("r"), at(21).alias("g"), at(42).alias("b")))


def paired_rgb(spark, sf) -> DataFrame:
    """RGB frames with a suppressed variant (``sr, sg, sb``) and a second one (``fr, fg, fb``)."""
    f = 0.55 + 0.05 * (F.col("pos") % 11)
    g = 0.90 + 0.02 * (F.col("pos") % 7)
    df = rgb(spark, sf)
    return df.select("*", *[(F.col(c) * f).alias(f"s{c}") for c in "rgb"],
                     *[F.least(F.lit(1.0), F.col(c) * g).alias(f"f{c}") for c in "rgb"])


def blend_inputs(spark, sf) -> DataFrame:
    """Paired colour frames with stand-ins for the score, the evidence and the structure cue.

    The evidence strength differs by frame, from none to strong.
    """
    k = (F.col("frame") % 7) / 4.0
    return paired_rgb(spark, sf).withColumns({
        "score": F.least(F.lit(1.0), F.col("r") * k * 1.2), "cross": F.least(F.lit(1.0), F.col("g") * k), "confidence": F.col("b"),
        "cross_support": F.least(F.lit(1.0), F.col("g") * F.col("b") * k), "removed_support": F.least(F.lit(1.0), F.col("b") * k * 1.2),
        "structure": 0.19 * (F.col("pos") % 6)})


def pair_rows(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("scene"), F.col("l_suppkey").alias("frame"),
        (F.col("l_discount") * 3).alias("raw"), (F.col("l_tax") * 3).alias("outp"))


def observations(spark, sf) -> DataFrame:
    return (table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("frame"), F.col("l_partkey").alias("point_id"))
            .agg((F.avg("l_extendedprice") / 105000).alias("lum")))


def tracks(spark, sf) -> DataFrame:
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    return (table(spark, sf, "lineitem").select(s.alias("frame"), p.alias("point_id")).distinct()
            .withColumns({"x": (F.col("point_id") % 80) / 10.0,
                          "y": ((F.col("frame") * 7 + F.col("point_id")) % 80) / 10.0}))


def points(spark, sf) -> DataFrame:
    """3-D points with a reprojection error; every 17th id is the invalid marker."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("point_id"),
                    ((F.col("p_partkey") % 40) / 10.0).alias("error"))


def poses(spark, sf) -> DataFrame:
    """Two camera branches: the second is turned a quarter about z, scaled, shifted and slightly noisy."""
    e = [F.col("embedding")[i].cast("double") for i in range(17)]
    unit = lambda q: [c / F.sqrt(sum((v * v for v in q), F.lit(0.0))) for c in q]
    d = table(spark, sf, "embeddings").select(
        F.col("label").cast("long").alias("scene"), F.col("vec_id").alias("frame"),
        e[0].alias("cx"), e[1].alias("cy"), e[2].alias("cz"),
        (1.7 * (-e[1]) + 0.5 + 0.01 * e[6]).alias("ox"), (1.7 * e[0] - 0.25 + 0.01 * e[7]).alias("oy"),
        (1.7 * e[2] + 1.0 + 0.01 * e[8]).alias("oz"),
        *[c.alias(n) for c, n in zip(unit(e[9:13]), ("qw", "qx", "qy", "qz"))], *[e[i].alias(f"n{i}") for i in range(13, 17)])
    w, x, y, z = (F.col(c) for c in ("qw", "qx", "qy", "qz"))
    turned = [w - z, x - y, y + x, z + w]
    noisy = [t * 0.7071067811865476 + 0.02 * F.col(f"n{i + 13}") for i, t in enumerate(turned)]
    return d.select("scene", "frame", "cx", "cy", "cz", "ox", "oy", "oz", "qw", "qx", "qy", "qz",
                    *[c.alias(n) for c, n in zip(unit(noisy), ("pw", "px", "py", "pz"))])


def _view_extras(u, i):
    any_ = (i % 40 + 10).cast("double")
    source = (u % 50 + 100) * 0.2
    return [any_.alias("raw_any"), (any_ * (0.7 + 0.005 * (i % 50))).alias("out_any"), (any_ * 0.3).alias("raw_strong"),
            (any_ * 0.3 * (0.6 + 0.01 * (i % 60))).alias("out_strong"), (u % 50 + 20).alias("strict_px"), (u % 50 + 30).alias("strong_px"),
            (u % 50 + 10).alias("strong_suppressed_px"), source.alias("source_score"), (source * (0.5 + 0.01 * (i % 70))).alias("residual_score")]


def views(spark, sf) -> DataFrame:
    u, i, v = F.col("user_id"), F.col("event_id"), F.col("value")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("scene"), i.alias("view_id"), (u % 30 + 1).alias("direction"), (i % 3 + 1).alias("height"),
        (i % 10 != 0).alias("within_support"), (u + 1000).alias("pixels"), (v / 500).alias("raw_mean"),
        (v / 500 * (0.6 + 0.008 * (i % 60))).alias("out_mean"), (u % 50 + 100).alias("source_px"),
        (u % 50 + 40).alias("improved_px"), *_view_extras(u, i))


def files(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("frame"),
                    F.concat(F.lit("frame_"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.lit(".png")).alias("name"),
                    F.sha2("text", 256).alias("actual"))


def expected(spark, sf) -> DataFrame:
    l, d = table(spark, sf, "labels"), table(spark, sf, "documents")
    return l.join(d, "doc_id").select(
        F.col("doc_id").alias("frame"),
        F.when(F.col("quality") == 0, F.lit("stale")).otherwise(F.sha2("text", 256)).alias("expected"))


_CELLS = ("(select label::bigint scene, vec_id frame, generate_subscripts(embedding,1)-1 pos, unnest(embedding)::double v "
          "from embeddings)")
_VIEWS = {
    "cells": f"select * from {_CELLS}",
    "grid": ("select scene, frame, (pos//8)::int y, (pos%8)::int x, pos::int pos, 8 h, 8 w, least(1::double,abs(v)) raw, "
             "least(1::double,abs(v))*(0.55::double+0.05::double*(pos%11)) outp from cells"),
    "rgb": ("select a.scene, a.frame, (a.pos//8)::int y, (a.pos%8)::int x, a.pos::int pos, 8 h, 8 w, least(1::double,2*abs(a.v)) r, "
            "least(1::double,2*abs(b.v)) g, least(1::double,2*abs(e.v)) b from cells a "
            "join cells b on a.frame=b.frame and b.pos=(a.pos+21)%64 join cells e on a.frame=e.frame and e.pos=(a.pos+42)%64"),
    "paired_rgb": ("select *, r*k sr, g*k sg, b*k sb, least(1::double,r*m) fr, least(1::double,g*m) fg, least(1::double,b*m) fb from "
                   "(select *, 0.55::double+0.05::double*(pos%11) k, 0.90::double+0.02::double*(pos%7) m from rgb)"),
    "blend_inputs": ("select * exclude (k,m,q), least(1::double,r*q*1.2::double) score, least(1::double,g*q) cross_, b confidence, least(1::double,g*b*q) cross_support, "
                     "least(1::double,b*q*1.2::double) removed_support, 0.19::double*(pos%6) structure from (select *, (frame%7)/4::double q from paired_rgb)"),
    "pair_rows": "select l_returnflag||l_linestatus scene, l_suppkey frame, l_discount*3 raw, l_tax*3 outp from lineitem",
    "observations": ("select l_suppkey frame, l_partkey point_id, avg(l_extendedprice)/105000 lum from lineitem "
                     "group by l_suppkey, l_partkey"),
    "tracks": ("select distinct l_suppkey frame, l_partkey point_id, (l_partkey%80)/10::double x, "
               "((l_suppkey*7+l_partkey)%80)/10::double y from lineitem"),
    "points": "select p_partkey point_id, (p_partkey%40)/10::double error from part",
    "poses": ("select scene, frame, cx, cy, cz, ox, oy, oz, qw, qx, qy, qz, a/sqrt(a*a+b*b+c*c+d*d) pw, b/sqrt(a*a+b*b+c*c+d*d) px, c/sqrt(a*a+b*b+c*c+d*d) py, "
              "d/sqrt(a*a+b*b+c*c+d*d) pz from (select *, (qw-qz)*0.7071067811865476::double+0.02::double*e[14]::double a, (qx-qy)*0.7071067811865476::double+0.02::double*e[15]::double b, "
              "(qy+qx)*0.7071067811865476::double+0.02::double*e[16]::double c, (qz+qw)*0.7071067811865476::double+0.02::double*e[17]::double d from "
              "(select label::bigint scene, vec_id frame, embedding e, e[1]::double cx, e[2]::double cy, e[3]::double cz, "
              "1.7::double*(-e[2]::double)+0.5::double+0.01::double*e[7]::double ox, 1.7::double*e[1]::double-0.25::double+0.01::double*e[8]::double oy, "
              "1.7::double*e[3]::double+1::double+0.01::double*e[9]::double oz, sqrt(e[10]::double*e[10]::double+e[11]::double*e[11]::double+e[12]::double*e[12]::double+e[13]::double*e[13]::double) qn, "
              "e[10]::double/qn qw, e[11]::double/qn qx, e[12]::double/qn qy, e[13]::double/qn qz from embeddings))"),
    "views": ("select event_type scene, event_id view_id, user_id%30+1 direction, event_id%3+1 height, event_id%10<>0 within_support, "
              "1000+user_id pixels, value/500 raw_mean, value/500*(0.6::double+0.008::double*(event_id%60)) out_mean, "
              "100+user_id%50 source_px, 40+user_id%50 improved_px, (10+event_id%40)::double raw_any, (10+event_id%40)*(0.7::double+0.005::double*(event_id%50)) out_any, "
              "(10+event_id%40)*0.3::double raw_strong, (10+event_id%40)*0.3::double*(0.6::double+0.01::double*(event_id%60)) out_strong, 20+user_id%50 strict_px, "
              "30+user_id%50 strong_px, 10+user_id%50 strong_suppressed_px, (100+user_id%50)*0.2::double source_score, "
              "(100+user_id%50)*0.2::double*(0.5::double+0.01::double*(event_id%70)) residual_score from events"),
    "files": ("select doc_id frame, 'frame_'||lpad(doc_id::varchar,7,'0')||'.png' as name, sha256(text) actual from documents"),
    "expected": ("select d.doc_id frame, case when l.quality=0 then 'stale' else sha256(text) end expected from labels l "
                 "join documents d on l.doc_id=d.doc_id"),
}
_NEEDS = {"grid": ["cells"], "rgb": ["cells"], "paired_rgb": ["cells", "rgb"], "blend_inputs": ["cells", "rgb", "paired_rgb"]}


def duck(inputs: str, select: str, *steps: tuple[str, str], recursive: bool = False) -> str:
    """DuckDB text: the named stand-ins as CTEs, further CTE steps, then the final select."""
    names: list[str] = []
    for name in inputs.split():
        for need in [*_NEEDS.get(name, []), name]:
            if need not in names:
                names.append(need)
    parts = [f"{n} as materialized ({_VIEWS[n]})" for n in names]
    parts += [f"{n} as {'' if recursive and 'union all' in text else 'materialized '}({text})" for n, text in steps]
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)} {select}" if parts else select


def r6(expr: str) -> str:
    """DuckDB twin of the 6-digit rounding (no negative zero)."""
    return f"(case when round(({expr})::double,6)=0 then 0::double else round(({expr})::double,6) end)"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, integers to long: the comparable form of a result."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), 6)
        elif kind in ("integer", "short", "byte", "long"):
            c = c.cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)
