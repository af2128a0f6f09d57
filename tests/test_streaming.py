import json

import pytest
from pyspark.errors import StreamingQueryException

from factloom.streaming import history, records, unchanged


def test_history_keeps_each_run_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    run = {"kind": "generation", "run_id": "r1", "generated_at": "2024-01-01T00:00:00Z", "selected": 4, "cached": 1, "failed": 0}
    (source / "a.json").write_text(json.dumps(run) + "\n" + json.dumps(run))
    (source / "b.json").write_text(json.dumps(run | {"run_id": "r2", "generated_at": "2024-01-02T00:00:00Z"}))
    stream = history.deduplicated(history.run_stream(spark, str(source)))
    history.append_history(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    table = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.run_id for r in table.collect()) == ["r1", "r2"]
    assert history.current_runs(table).first().run_id == "r2"


def _runs(folder, name, *runs):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"kind": k, "run_id": i, "generated_at": f"2024-01-0{d}T00:00:00Z", "selected": 4, "cached": 1, "failed": f}) for k, i, d, f in runs))


def test_a_failed_batch_is_written_once(spark, tmp_path):
    source, root, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    _runs(source, "a.json", ("generation", "r1", 1, 0), ("generation", "r1", 1, 0), ("verification", "v1", 2, 1))
    for step in ("history", "current", "ledger"):  # each try fails after one more step

        def fail(done, step=step):
            if done == step:
                raise RuntimeError("lost")

        with pytest.raises(StreamingQueryException):
            records.record(history.run_stream(spark, str(source)), root, state, fail).awaitTermination(120)
        seen = {r.run_id for r in records.history(spark, root).collect()}
        assert seen == ({"r1", "v1"} if step == "ledger" else set())
    before = [tuple(r) for r in records.committed(spark, root).collect()]
    records.record(history.run_stream(spark, str(source)), root, state).awaitTermination(120)
    assert [tuple(r) for r in records.committed(spark, root).collect()] == before == [(0, 2, 1)]
    _runs(source, "b.json", ("generation", "r1", 1, 0), ("generation", "r2", 3, 2))
    records.record(history.run_stream(spark, str(source)), root, state).awaitTermination(120)
    assert sorted(r.run_id for r in records.history(spark, root).collect()) == ["r1", "r2", "v1"]
    assert {(r.kind, r.run_id) for r in records.current(spark, root).collect()} == {("generation", "r2"), ("verification", "v1")}
    assert {tuple(r) for r in records.summary(spark, root).select("kind", "runs", "failed_runs", "last_run_id", "cache_hit_rate").collect()} == {("generation", 2, 1, "r2", 0.25), ("verification", 1, 1, "v1", 0.25)}
    assert sorted(tuple(r) for r in records.committed(spark, root).collect()) == [(0, 2, 1), (1, 1, 1)]


def test_unchanged_work_is_skipped(spark, tmp_path):
    source = tmp_path / "plans"
    source.mkdir()

    def plan(name, *rows):
        (source / name).write_text("\n".join(json.dumps({"module": m, "fingerprint": f, "planned_at": n}) for n, (m, f) in enumerate(rows)))
        stream = spark.readStream.schema("module string, fingerprint string, planned_at long").json(str(source))
        out = []
        unchanged.changed(stream).writeStream.foreachBatch(lambda df, n: out.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(out)

    assert plan("a.json", ("m1", "x"), ("m2", "y"), ("m1", "x")) == [("m1", "x", None), ("m2", "y", None)]
    assert plan("b.json", ("m1", "x"), ("m2", "z"), ("m3", "w")) == [("m2", "z", "y"), ("m3", "w", None)]
    assert plan("c.json", ("m2", "z"), ("m1", "x")) == []
