"""Small rules that no table of the driver shows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.functions import text
from textloom.operators import fuse, records
from textloom.sources.parsers import monospaced
from textloom.streaming import jobs


@pytest.mark.parametrize("font", ["JetBrains Mono", "DejaVu Sans Mono", "Hack", "Lucida Console", "Consolas", "Courier New", "Source Code Pro", "PT_Mono"])
def test_monospaced_fonts(font):
    assert monospaced(font)


@pytest.mark.parametrize("font", ["", "Monotype Corsiva", "Arial", "Hackney", "New Courier"])
def test_other_fonts(font):
    assert not monospaced(font)


def test_an_image_shell_is_told_below_its_own_breadcrumb(spark):
    rows = [("[A [x] > B]\n![p](q)", "A [x] > B", True), ("[note]\n![p](q)", None, False), ("[A]\ntext", "A", False), ("![p](q) ![](r)", None, True)]
    df = spark.createDataFrame(rows, "t string, crumb string, want boolean")
    assert df.where(text.is_image_shell(F.col("t"), F.col("crumb")) != F.col("want")).count() == 0


def test_a_batch_waits_for_an_active_run_and_is_not_lost(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    seen, busy = [], [True]
    job = lambda df, _: seen.append(df.count())
    failed = jobs.every(stream(), None, job, str(tmp_path / "cp"), active=lambda: busy[0], patience=0.2)
    with pytest.raises(Exception, match="waited"):
        failed.awaitTermination()
    assert seen == []
    busy[0] = False
    jobs.every(stream(), None, job, str(tmp_path / "cp"), active=lambda: busy[0]).awaitTermination()
    assert seen == [5]


def test_bounds_of_lists_and_pools(spark):
    with pytest.raises(ValueError):
        records.newest(spark.range(3), ["id"], 201)
    assert [r["id"] for r in records.newest(spark.range(3), ["id"], 2).collect()] == [2, 1]
    assert fuse.vector_pool(5, False, False) == 5 and fuse.vector_pool(5, True, False) == 20


def test_guarded_steps(spark):
    """Against a machine that takes one step after another; nulls, repeats and unknown steps are rejected."""
    import random

    r = random.Random(5)
    kinds = ["create", "start", "progress", "cancel", "success", "failed", "odd", None]
    log = [(r.choice((1, 2, 3, 4, None)), i, r.choices(kinds, (3, 3, 2, 2, 1, 1, 1, 1))[0]) for i in range(150)]
    state, want = {}, {}
    for run, i, step in log:
        now = state.get(run)
        active = now in ("queued", "running")
        ok = run is not None and {"create": now is None, "start": now == "queued", "progress": now is not None, "cancel": active, "success": now is not None, "failed": now is not None}.get(step, False)
        want[i] = ok
        if ok and step not in ("progress", "cancel"):
            state[run] = {"create": "queued", "start": "running"}.get(step, step)
    df = spark.createDataFrame(log, "run int, at int, step string").repartition(5)
    done = records.guarded_steps(df, "run", ["at"], "step")
    assert {x["at"]: x["accepted"] for x in done.collect()} == want and any(want.values())
    timed = done.withColumn("ts", F.timestamp_seconds("at"))
    assert {x["run"]: x["status"] for x in records.states_of_steps(timed, "run", ["at"], "step", "ts").collect()} == state
    assert records.guarded_steps(df.limit(0), "run", ["at"], "step").count() == 0
