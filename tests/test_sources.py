import json

import pytest
from pyspark.sql import functions as F

from glintframe.operators import audit as A, blend as B
from glintframe.plans import reports as RP
from glintframe.sources import readers as S
from glintframe.streaming import incremental as I


def test_ppm_like_image_rows_become_pixels(spark):
    data = bytearray(range(18))  # 2 x 3 pixels, blue green red
    img = spark.createDataFrame([("s", 1, 2, 3, 3, data)], "scene string, frame int, h int, w int, channels int, data binary")
    rows = {(r.y, r.x): r for r in S.explode_pixels(img).collect()}
    assert len(rows) == 6
    assert rows[1, 2].b == pytest.approx(15 / 255) and rows[1, 2].g == pytest.approx(16 / 255) and rows[1, 2].r == pytest.approx(17 / 255)


def test_map_round_trip_truncates(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, 0, 0, 0.5), ("s", 1, 0, 1, 1.7)], "scene string, frame int, y int, x int, v double")
    S.write_map(df, str(tmp_path / "m"), "v")
    got = {r.x: r.score for r in S.read_map(spark, str(tmp_path / "m")).collect()}
    assert got[0] == 32767 / 65535 and got[1] == 1.0


def test_text_sources(spark, tmp_path):
    (tmp_path / "sums.txt").write_text("ABC  a/b.png\n\nDEF  with  blanks\n")
    assert sorted(tuple(r) for r in S.read_checksums(spark, str(tmp_path / "sums.txt")).collect()) == [("a/b.png", "abc"), ("with  blanks", "def")]
    (tmp_path / "v.csv").write_text("view_id,within_support,pixels,x\np1,True,10,nan\np2,true,5,1.5\n")
    any_case = {r.view_id: r for r in S.read_view_metrics(spark, str(tmp_path / "v.csv")).collect()}
    assert any_case["p1"].x is None and any_case["p2"].within_support
    assert not {r.view_id: r for r in S.read_view_metrics(spark, str(tmp_path / "v.csv"), True).collect()}["p2"].within_support
    (tmp_path / "cells.json").write_text(json.dumps({"schema": "x", "t1": [["a", "b"], ["c", "d"]]}))
    cells = S.read_cells(spark, str(tmp_path / "cells.json"))
    assert cells.count() == 4
    changed = cells.withColumn("value", F.when(F.col("value") == "d", "D").otherwise(F.col("value")))
    assert A.verify_cells(changed, cells).where("not passed").count() == 1
    stats = {"mean": 1.0, "median": 2.0, "q25": 0.5, "q75": 3.0}
    (tmp_path / "s.json").write_text(json.dumps({"scenes": {"A": {"frames": 3, "per_image_statistics": {"m": stats}}}}, indent=1))
    assert tuple(S.read_summary(spark, str(tmp_path / "s.json")).first()) == ("A", 3, "m", 1.0, 2.0, 0.5, 3.0)
    (tmp_path / "t.json").write_text(json.dumps({"schema": "s1", "views": [{"view_id": "p1", "raw_camera_to_world": [[1, 0, 0, 7], [0, 1, 0, 8], [0, 0, 1, 9], [0, 0, 0, 1]], "within_support": True}]}))
    v = S.read_trajectory(spark, str(tmp_path / "t.json")).first()
    assert (v.cx, v.cy, v.cz, v.within_support) == (7, 8, 9, True)


def test_hash_files_and_registered_counts(spark, tmp_path):
    import hashlib
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bin").write_bytes(b"abc")
    assert S.hash_files(spark, str(tmp_path / "d")).first().actual == hashlib.sha256(b"abc").hexdigest()
    doc = lambda n: spark.createDataFrame([("A", list(range(n)))], "scene string, frames array<int>")
    r = S.registered_counts(doc(3), doc(2)).first()
    assert (r.raw_registered_frames, r.other_registered_frames, r.equal) == (3, 2, False)


def test_profiles_and_parameter_table(spark, tmp_path):
    from glintframe.operators.matte import DEFAULTS
    p = {"m1": {"release": "m1", "detector_version": "d3", "blend_mode": "evidence_matte", "threshold": 0.3, "data_factor": 4, "blend_parameters": {k: float(v) for k, v in DEFAULTS.items()}}}
    (tmp_path / "p.json").write_text(json.dumps(p))
    profiles = S.read_profiles(spark, str(tmp_path / "p.json"))
    text = {r.label: r.value for r in RP.table_parameters(profiles, "m1").collect()}
    assert text["threshold/steepness/data_factor"] == "0.30/8/4" and text["small_width/large_width"] == "2/10 px"
    assert text["background_score/background_evidence"] == "0.012/0.025" and text["matte_smoothness/matte_iterations"] == "1.5/24"
    runs = spark.createDataFrame([("d3", "evidence_matte", 0.3, 4), ("d3", "soft", 0.25, 4)], "detector_version string, blend_mode string, threshold double, data_factor int")
    assert sorted((r.profile, r.tag) for r in RP.profile_of(runs, profiles).collect()) == [("custom", "soft_t0.25"), ("m1", "evidence_matte_t0.3")]
    with pytest.raises(ValueError):
        RP.table_parameters(profiles, "m1", steepness=7)


def test_document_tolerances(spark):
    df = spark.createDataFrame([(1, '{"a":[1,{"b":true}]}', '{"a":[1.0000000000001,{"b":true}]}'), (2, '{"a":1}', '{"a":[1]}'), (3, '{"a":"x","b":null}', '{"a":1,"b":null}'), (4, "[1]", '{"a":1}')],
                               "k int, actual string, reference string")
    got = sorted((r.k, r.location, r.difference) for r in A.compare_documents(df, "k").collect())
    assert got == [(2, "$.a", "not a list of this length"), (3, "$.a", "not a number"), (4, "$", "not an object")]


def test_only_unequal_nodes_of_documents_are_written(spark, monkeypatch):
    written, cut = [], A.materialize
    monkeypatch.setattr(A, "materialize", lambda df: written.append(cut(df)) or written[-1])
    rows = [(i, '{"a":[1,{"b":null}],"c":"x"}', '{"c":"x","a":[1,{"b":null}]}') for i in range(50)]
    rows += [(90, '{"a":null}', '{"a":1}'), (91, '{"a":[{"b":1},null,2]}', '{"a":[{"b":2},null,2]}'), (92, None, '"x"'), (93, None, None)]
    df = spark.createDataFrame(rows, "k int, actual string, reference string")
    got = sorted((r.k, r.location, r.difference) for r in A.compare_documents(df, "k").collect())
    assert got == [(90, "$.a", "not a number"), (91, "$.a[0].b", "values differ"), (92, "$", "values differ")]
    assert sum(d.count() for d in written) == 5


def _pixel_stream(spark, path, per_trigger=1):
    schema = "scene string, frame int, y int, x int, raw double, outp double, expected int"

    def put(number, *xs):
        rows = [("s", number, 0, x, 0.2 - 0.19 * (x % 2), 0.1 - 0.1 * (x % 2), 2) for x in xs]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    return put, lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def test_new_frames_only_and_parameter_guard(spark, tmp_path):
    put, stream = _pixel_stream(spark, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    put(1, 0, 1), put(2, 0, 1), put(1, 0, 1)
    I.evaluate_new_frames(stream(), I.frame_transitions, out, {"weak": 0.075})
    assert I.results(spark, out).agg(F.sum("pixels")).first()[0] == 4
    put(3, 0, 1)
    I.evaluate_new_frames(stream(), I.frame_transitions, out, {"weak": 0.075})
    assert I.results(spark, out).agg(F.sum("pixels")).first()[0] == 6
    with pytest.raises(ValueError):
        I.evaluate_new_frames(stream(), I.frame_transitions, out, {"weak": 0.1})


def test_frame_delivered_twice_in_one_batch_counts_once(spark, tmp_path):
    put, stream = _pixel_stream(spark, str(tmp_path / "in"), per_trigger=10)
    put(1, 0, 1), put(1, 0, 1)
    I.evaluate_new_frames(stream(), I.frame_transitions, str(tmp_path / "out"), {})
    assert I.results(spark, str(tmp_path / "out")).agg(F.sum("pixels")).first()[0] == 2


def test_frame_split_over_batches_waits_until_it_is_whole(spark, tmp_path):
    put, stream = _pixel_stream(spark, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    put(1, 0), put(2, 1)
    I.evaluate_new_frames(stream(), I.frame_transitions, out, {}, expected="expected")
    assert I.results(spark, out).count() == 0
    put(1, 1), put(1, 0), put(3, 0, 1)
    I.evaluate_new_frames(stream(), I.frame_transitions, out, {}, expected="expected")
    got = {r.frame: r.n for r in I.results(spark, out).groupBy("frame").agg(F.sum("pixels").alias("n")).collect()}
    assert got == {1: 2, 3: 2}


def test_running_totals_take_corrections_and_close_old_frames(spark, tmp_path):
    schema = "scene string, frame int, before int, after int, pixels long, version long"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    now = lambda: sorted((r.before, r.after, r.pixels) for r in I.totals(spark, out).collect())
    out = str(tmp_path / "out")
    assert I.totals(spark, out) is None
    put(("s", 1, 0, 0, 5, 1), ("s", 1, 1, 0, 7, 1)), put(("s", 2, 0, 0, 3, 2))
    I.running_totals(stream(), out, horizon=3)
    assert now() == [(0, 0, 8), (1, 0, 7)]
    put(("s", 1, 0, 0, 6, 3))  # the corrected frame has no second pair any more
    put(("s", 2, 0, 0, 3, 2))
    I.running_totals(stream(), out, horizon=3)
    assert now() == [(0, 0, 9)]
    put(("s", 3, 1, 1, 1, 9))  # closes the first two
    I.running_totals(stream(), out, horizon=3)
    assert now() == [(0, 0, 9), (1, 1, 1)]


def test_corrections_of_closed_frames_count_once(spark, tmp_path):
    schema = "scene string, frame int, before int, after int, pixels long, version long"
    out, path = str(tmp_path / "out"), str(tmp_path / "in")

    def total(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        I.running_totals(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), out, horizon=5)
        return sorted((r.before, r.after, r.pixels) for r in I.totals(spark, out).collect())

    assert total(("s", 1, 0, 0, 10, 1)) == [(0, 0, 10)]
    assert total(("s", 2, 0, 0, 7, 20)) == [(0, 0, 17)]
    assert total(("s", 3, 1, 1, 1, 30)) == [(0, 0, 17), (1, 1, 1)]
    assert total(("s", 1, 0, 0, 10, 31)) == [(0, 0, 17), (1, 1, 1)]
    assert total(("s", 1, 0, 1, 4, 32)) == [(0, 0, 7), (0, 1, 4), (1, 1, 1)]
    assert total(("s", 1, 0, 1, 9, 2)) == [(0, 0, 7), (0, 1, 4), (1, 1, 1)]
    assert total(("s", 4, 2, 2, 5, 3)) == [(0, 0, 7), (0, 1, 4), (1, 1, 1), (2, 2, 5)]  # late, but new


def test_frame_that_never_becomes_whole_is_given_up(spark, tmp_path):
    put, stream = _pixel_stream(spark, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    run = lambda: I.evaluate_new_frames(stream(), I.frame_transitions, out, {}, expected="expected", patience_ms=1)
    put(1, 0), put(2, 0, 1)
    run()
    put(3, 0, 1)
    run()
    assert {(r.frame, r.status, r.held, r.expected) for r in I.given_up(spark, out).collect()} == {(1, "incomplete", 1, 2)}
    assert {r.frame for r in I.results(spark, out).collect()} == {2, 3}
    put(1, 0, 1)
    run()
    assert {r.frame for r in I.results(spark, out).collect()} == {1, 2, 3}


def test_strategy_registry(spark):
    assert "soft" in B.available_strategies()
    with pytest.raises(ValueError, match="available"):
        B.get_strategy("nothing")
    with pytest.raises(ValueError):
        B.check_requirements(B.get_strategy("evidence_matte"), "single_view")


def test_artifacts_are_listed(spark, tmp_path):
    one = lambda i, **m: {"id": i, "levels": ["R1", "R2"], "limitation": "none", **m}
    (tmp_path / "m.json").write_text(json.dumps({"figures": [one(1), one(2)], "tables": [one(1)]}))
    entry = "array<struct<id: bigint, levels: array<string>, limitation: string>>"
    rows = RP.list_artifacts(S.read_json_document(spark, str(tmp_path / "m.json"), f"figures {entry}, tables {entry}")).collect()
    assert sorted((r.kind, r.id, r.levels) for r in rows) == [("figure", "1", "R1, R2"), ("figure", "2", "R1, R2"), ("table", "1", "R1, R2")]


def test_a_frame_that_comes_whole_costs_two_looks_at_its_state():
    import pandas as pd
    from glintframe.streaming.incremental import _Assembly
    calls = []

    class State:
        def __init__(self, name):
            self.name, self.value = name, None

        def __getattr__(self, call):
            def do(*given):
                calls.append((self.name, call))
                if call == "update":
                    self.value = given[0]
                return self.value if call == "get" else self.value is not None
            return do

    class Handle:
        getValueState = getListState = lambda self, name, schema: State(name)

    columns = ["scene", "frame", "piece", "n", "status", "held"]
    processor = _Assembly(["piece"], "n", None, columns)
    processor.init(Handle())
    rows = pd.DataFrame({"scene": "a", "frame": 1, "piece": [1, 2, 2], "n": 2})
    out = list(processor.handleInputRows(("a", 1), iter([rows]), None))
    assert [list(o["piece"]) for o in out] == [[1, 2]] and len(calls) == 2
    assert not list(processor.handleInputRows(("a", 1), iter([rows]), None)) and len(calls) == 3
