"""Hash and document audits: expected against actual, at any number of files."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from glintframe.functions.scalar import col
from glintframe.session import materialize, place


def verify_join(expected: DataFrame, actual: DataFrame, keys, expected_col="expected", actual_col="actual") -> DataFrame:
    """``match``, ``mismatch``, ``missing`` (expected only) or ``unexpected`` per key; hash case does not matter."""
    e, a = F.lower(col(expected_col)), F.lower(col(actual_col))
    both = expected.join(actual, list(keys), "full_outer")
    status = (F.when(a.isNull(), "missing").when(e.isNull(), "unexpected").when(e == a, "match").otherwise("mismatch"))
    return both.withColumn("status", status)


def checks(verified: DataFrame, name, ignore_unexpected: bool = True) -> DataFrame:
    kept = verified.where("status <> 'unexpected'") if ignore_unexpected else verified
    return kept.select(col(name).cast("string").alias("name"), (F.col("status") == "match").alias("passed"), F.col("status").alias("detail"))


def check_totals(check_rows: DataFrame, keys=()) -> DataFrame:
    return check_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("failures"),
                                         F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))


def set_digest(files: DataFrame, group: str, name: str = "name", digest: str = "actual") -> DataFrame:
    """Count and SHA-256 of the lines ``name NUL HASH newline`` of every set, in name order.

    The digest of a set is sequential by definition; rows without a set name form a set of their own. Sets are placed and sorted by Spark (spilling
    to disk), and each task feeds the short lines through one running hash, holding no set in memory.
    """
    kind = files.schema[group].dataType.simpleString()
    lines = place(files.select(F.col(group).alias("g"), F.coalesce(F.col(name), F.lit("")).alias("n"), F.coalesce(F.upper(digest), F.lit("")).alias("d")), "g").sortWithinPartitions("g", "n")

    def run(batches):
        open_set, state, count = None, None, 0
        for b in batches:
            done = []
            for key, rows in b.groupby("g", sort=False, dropna=False):
                key = None if pd.isna(key) else key
                if state is None or key != open_set:
                    if state is not None:
                        done.append((open_set, count, state.hexdigest().upper()))
                    open_set, state, count = key, hashlib.sha256(), 0
                state.update("".join(n + "\0" + d + "\n" for n, d in zip(rows["n"], rows["d"])).encode())
                count += len(rows)
            if done:
                yield pd.DataFrame(done, columns=[group, "files", "digest"])
        if state is not None:
            yield pd.DataFrame([(open_set, count, state.hexdigest().upper())], columns=[group, "files", "digest"])

    return lines.mapInPandas(run, f"{group} {kind}, files bigint, digest string")


def profile_guard(actual: DataFrame, frozen: DataFrame, key: str = "parameter", value: str = "value") -> DataFrame:
    """Parameters whose value differs from the frozen profile, or which exist on one side only."""
    a = actual.select(key, F.col(value).alias("actual"))
    f = frozen.select(key, F.col(value).alias("frozen"))
    return a.join(f, key, "full_outer").where(~F.col("actual").eqNullSafe(F.col("frozen")))


def verify_cells(generated: DataFrame, expected: DataFrame) -> DataFrame:
    keys = ["table", "row", "col"]
    g, e = (d.select(*keys, F.col("value").alias(n)) for d, n in ((generated, "actual"), (expected, "expected")))
    both = g.join(e, keys, "full_outer")
    return both.withColumn("passed", F.col("actual").eqNullSafe(F.col("expected")))


# --- nested documents ----------------------------------------------------

def _judged(rows: DataFrame, key: str, relative: float, absolute: float) -> DataFrame:
    """Nodes that differ (``difference``) or must be opened (``more``); equal ones are dropped, with all below them.

    The first sign of a node's text tells its kind. Columns read more than once come out of a generator, so that the
    planner does not put their texts in each place.
    """
    once = lambda **values: F.inline(F.array(F.struct(*[v.alias(n) for n, v in values.items()])))
    d = rows.select("*", once(ja=F.to_json("a"), jr=F.to_json("r"), na=F.expr("try_variant_get(a, '$', 'double')"), nr=F.expr("try_variant_get(r, '$', 'double')")))
    sign, same = F.coalesce(F.substring("jr", 1, 1), F.lit("")), F.col("ja").eqNullSafe(F.col("jr"))
    nested, numeric = sign.isin("{", "["), sign.rlike("[-0-9]")
    near = F.abs(F.col("na") - F.col("nr")) <= F.greatest(relative * F.greatest(F.abs("na"), F.abs("nr")), F.lit(absolute))
    text = (F.when(same | nested, None).when(~numeric, "values differ").when(F.col("na").isNull(), "not a number")
            .when(F.isnan("na") | F.isnan("nr") | ~near, "values differ"))
    open_ = F.col("difference").isNull() & nested & ~same
    found = d.select(key, "location", "a", "r", once(found=F.coalesce("difference", text), more=open_)).where("found is not null or more")
    return found.select(key, "location", *[F.when(F.col("more"), F.col(c)).alias(c) for c in "ar"], F.col("found").alias("difference"), "more")


def _opened(rows: DataFrame, key: str) -> DataFrame:
    """The members of every open node, or the difference that keeps it closed; finished rows stay."""
    as_map, as_list = (lambda v: F.expr(f"try_variant_get({v}, '$', 'map<string, variant>')")), (lambda v: F.expr(f"try_variant_get({v}, '$', 'array<variant>')"))
    node = lambda location, a, r, difference: F.struct(location.alias("location"), a.alias("a"), r.alias("r"), difference.cast("string").alias("difference"))
    nothing = F.lit(None).cast("variant")
    closed = lambda difference: F.array(node(F.col("location"), nothing, nothing, difference))
    pair = lambda a, r: F.struct(a.alias("a"), r.alias("r"))
    # a member that one side lacks is NULL there; a JSON null is not
    alone = lambda values: F.exists(values, lambda e: e["a"].isNull() | e["r"].isNull())
    fields = lambda m: (F.when(m.isNull(), closed(F.lit("not an object"))).when(alone(F.map_values(m)), closed(F.lit("other keys")))
                        .otherwise(F.transform(F.map_entries(m), lambda e: node(F.concat("location", F.lit("."), e["key"]), e["value"]["a"], e["value"]["r"], F.lit(None)))))
    items = lambda v: (F.when(v.isNull() | alone(v), closed(F.lit("not a list of this length")))
                       .otherwise(F.transform(v, lambda e, i: node(F.concat("location", F.lit("["), i.cast("string"), F.lit("]")), e["a"], e["r"], F.lit(None)))))
    # an array of one value gives that value a name, so that it is made once for each node
    mapping = F.transform(F.array(F.map_zip_with(as_map("a"), as_map("r"), lambda k, a, r: pair(a, r))), fields)[0]
    sequence = F.transform(F.array(F.zip_with(as_list("a"), as_list("r"), pair)), items)[0]
    members = F.when(~F.col("more"), closed(F.col("difference"))).when(as_map("r").isNotNull(), mapping).otherwise(sequence)
    return rows.select(key, F.inline(members))


def compare_documents(pairs: DataFrame, key: str, actual: str = "actual", reference: str = "reference",
                      relative: float = 1e-12, absolute: float = 1e-9) -> DataFrame:
    """Differences of two JSON documents per key, as (key, location, difference).

    Both documents descend in step, one nesting level at a time over all keys at once. Unequal key
    sets or lengths are one difference and end the descent there; numbers compare with a tolerance,
    everything else exactly. Only differences and unequal nodes are written at each level.
    """
    # few files can hold many documents, so they are spread before they are parsed
    placed = place(pairs.select(key, actual, reference), key)
    top = placed.select(key, F.lit("$").alias("location"), F.parse_json(actual).alias("a"), F.parse_json(reference).alias("r"), F.lit(None).cast("string").alias("difference"))
    level, out = _judged(top, key, relative, absolute), None
    while True:
        level = materialize(_judged(_opened(level, key), key, relative, absolute))
        here = level.where("difference is not null").select(key, "location", "difference")
        out = here if out is None else out.union(here)
        level = level.where("more")
        if not level.take(1):
            return out
