"""The two jobs: their SQL, reruns, growing input, a run that fails midway, odd rows, the command line."""

from __future__ import annotations

import datetime as dt
import json
import logging
import os
import random
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ionweave.errors import AnalysisError, ConfigError, PreprocessError
from jobs import acquisition_ingest as ai
from jobs import common, registry
from jobs import marker_terms as mt

from .test_oracles import DATA, ordered

ROOT = Path(__file__).resolve().parents[1]
PEAKS = "l_orderkey long, l_partkey long, l_extendedprice double, l_shipdate timestamp"
CHANNELS = "p_partkey long, p_retailprice double"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="sample tables are not here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_job_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got, want = ordered(registry.QUERIES[name](spark, DATA).toPandas()), ordered(con.execute(registry.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) > 0 and got.equals(want.astype(got.dtypes.to_dict()))


# --------------------------------------------------------------------------
# marker terms


def texts(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.mode("overwrite").parquet(str(path))
    return str(path)


def small_collections():
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["laser", "cell", "mark", f"only{g}", "shared"]) for _ in range(30)), g, "s") for i, g in enumerate("ab" * 40)]
    return rows


def test_markers_of_small_collections(spark, tmp_path):
    rows = [(i, t.replace("onlya", "lipid").replace("onlyb", "sugar"), g, s) for i, t, g, s in small_collections()]
    odd = [(None, "lipid lipid", "b", "s"), (900, "lipid lipid", None, "s"), (901, None, "a", "s"), (0, "LIPID it is", "a", "s"), (902, "", "c d/e", "s")]
    docs, out = texts(spark, tmp_path / "docs", rows + odd), str(tmp_path / "out")
    found = mt.marker_terms(spark, docs, out, mt.DEFAULTS | {"terms": 2}).collect()
    first = {r.collection: r for r in found if r["rank"] == 1}
    assert first["a"].term == "lipid" and first["b"].term == "sugar" and "c d/e" not in first
    assert first["a"].documents == sum(g == "a" and "lipid" in t for _, t, g, _ in rows)
    assert {r["rank"] for r in found} == {1, 2} and all(0 <= r.score <= 1 for r in found)
    assert sorted(p.name for p in Path(out).glob("collection=*")) == ["collection=a", "collection=b"]


def test_markers_rerun_and_shrink(spark, tmp_path):
    docs, out = texts(spark, tmp_path / "docs", small_collections()), str(tmp_path / "out")
    one = sorted(map(tuple, mt.marker_terms(spark, docs, out).collect()))
    assert sorted(map(tuple, mt.marker_terms(spark, docs, out).collect())) == one
    texts(spark, tmp_path / "docs", [r for r in small_collections() if r[2] == "a"])
    assert {r.collection for r in mt.marker_terms(spark, docs, out).collect()} == {"a"}
    texts(spark, tmp_path / "docs", [])
    assert mt.marker_terms(spark, docs, out).count() == 0


def test_marker_settings(spark, tmp_path):
    docs = texts(spark, tmp_path / "docs", small_collections())
    for bad in ({"terms": 0}, {"mu": -1}, {"id": "nowhere"}, {"expressed_pct": 2}):
        with pytest.raises(AnalysisError):
            mt.marker_terms(spark, docs, str(tmp_path / "out"), mt.DEFAULTS | bad)
    for text in ("[1]", "{", '{"colection": "lang"}'):
        (tmp_path / "c.json").write_text(text)
        with pytest.raises(ConfigError):
            common.load_config(spark, str(tmp_path / "c.json"), mt.DEFAULTS)
    for job in (mt, ai):
        name = job.__name__.split(".")[1]
        given = json.loads((ROOT / "jobs" / f"{name}.json").read_text())
        assert common.load_config(spark, str(ROOT / "jobs" / f"{name}.json"), job.DEFAULTS) == job.DEFAULTS | given == job.DEFAULTS


# --------------------------------------------------------------------------
# acquisition


@pytest.fixture
def study(spark, tmp_path):
    """Channels, and a function that drops a file of peaks into the watched folder."""
    spark.createDataFrame([(c, 500.0 + c // 2 * 1.0 + (c % 2) * 0.01) for c in range(20)] + [(3, 501.01), (98, -1.0), (99, None)], CHANNELS).write.parquet(str(tmp_path / "channels"))
    (tmp_path / "peaks").mkdir()

    def drop(rows):
        spark.createDataFrame(rows, PEAKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "peaks"))

    def run(name="one", **config):
        place = tmp_path / name
        return ai.acquisition_ingest(spark, str(tmp_path / "peaks"), str(tmp_path / "channels"), str(place / "out"), str(place / "check"), ai.DEFAULTS | config)

    return drop, run, tmp_path


def peaks(seed, n, months):
    rng = random.Random(seed)
    return [(rng.randrange(30), rng.randrange(20), round(rng.uniform(1, 50), 2), dt.datetime(2024, rng.choice(months), rng.randint(1, 28))) for _ in range(n)]


def brute(rows):
    """(month, feature): pixels, pixels of the month, total, largest; two channels share a feature."""
    cells, months = {}, {}
    for pixel, channel, value, time in rows:
        if pixel is not None and channel is not None and channel < 20 and value is not None and value == value and abs(value) != float("inf") and time is not None:
            key = f"{time:%Y-%m}", channel // 2, pixel
            cells[key] = cells.get(key, 0) + value
            months.setdefault(key[0], set()).add(pixel)
    out = {}
    for (month, feature, _), value in cells.items():
        out.setdefault((month, feature), []).append(value)
    return {k: (len(v), len(months[k[0]]), round(sum(v), 2), round(max(v), 2)) for k, v in out.items()}


def read(df):
    return {(r.month, r.col_ord): (r.pixels, r.month_pixels, r.total, r.largest) for r in df.collect()}


def written(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_two_runs_over_growing_input(study, caplog):
    drop, run, tmp = study
    caplog.set_level(logging.INFO, "jobs")
    first, second = peaks(1, 400, [1, 2, 3]), peaks(2, 300, [3, 4])
    drop(first)
    assert read(run()) == brute(first)
    before = written(tmp / "one" / "out" / "summary")
    caplog.clear()
    drop(second)
    assert read(run()) == brute(first + second)
    assert [m for m in caplog.messages if "read" in m] == [f"batch 1 of {tmp}/peaks: read 300 peaks, dropped 0"]
    after = written(tmp / "one" / "out" / "summary")
    same = {p for p in before if "month=2024-01" in str(p) or "month=2024-02" in str(p)}
    assert same and all(after[p] == before[p] for p in same)
    now = read(run())
    assert now == brute(first + second) and written(tmp / "one" / "out" / "summary") == after and any("no new files" in m for m in caplog.messages)
    # all at once, and a file at a time, give the same
    assert read(run("two")) == now and read(run("three", max_files=1)) == now


def test_unusable_rows_and_new_channels(study, spark, caplog):
    drop, run, tmp = study
    caplog.set_level(logging.INFO, "jobs")
    time = dt.datetime(2024, 5, 5)
    odd = [(None, 1, 1.0, time), (1, None, 1.0, time), (1, 98, 1.0, time), (1, 99, 1.0, time), (1, 77, 1.0, time), (1, 2, None, time), (1, 2, float("nan"), time), (1, 2, float("inf"), time), (1, 2, 1.0, None)]
    good = peaks(3, 100, [5])
    drop(odd + good)
    assert read(run()) == brute(good)
    assert f"batch 0 of {tmp}/peaks: read 109 peaks, dropped 9" in caplog.messages
    # a channel added later joins the features there are; the axis stays
    axis = sorted(map(tuple, spark.read.parquet(str(tmp / "one/out/axis")).collect()))
    spark.createDataFrame([(77, 503.02), (78, 700.0)], CHANNELS).write.mode("append").parquet(str(tmp / "channels"))
    drop([(1, 77, 2.5, time), (1, 78, 2.5, time)])
    assert read(run()) == brute(good + [(1, 6, 2.5, time)])
    assert sorted(map(tuple, spark.read.parquet(str(tmp / "one/out/axis")).collect())) == axis


def test_a_batch_that_fails_is_taken_again(study, monkeypatch):
    drop, run, tmp = study
    first, second = peaks(4, 200, [1, 2]), peaks(5, 200, [2, 3])
    drop(first)
    run()
    drop(second)

    def broken(values, axis):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(ai, "monthly", broken)
        with pytest.raises(StreamingQueryException):
            run()
    assert (tmp / "one/out/values/batch=1").exists()
    assert read(run()) == brute(first + second)


def test_nothing_yet_and_settings(study, spark):
    drop, run, tmp = study
    drop([])
    assert run().count() == 0
    for bad in ({"tolerance": 0}, {"unit": "kg"}, {"max_files": 0}, {"time": "nowhere"}, {"channel_mz": "nowhere"}):
        with pytest.raises(PreprocessError):
            run("bad", **bad)
    assert not spark.streams.active


# --------------------------------------------------------------------------
# command line


def command(module, *args):
    env = os.environ | {"PYTHONPATH": str(ROOT), "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    return subprocess.run([sys.executable, "-m", module, *args], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)


def test_command_lines(study, spark, tmp_path):
    drop, _, tmp = study
    rows = peaks(6, 50, [1])
    drop(rows)
    done = command("jobs.acquisition_ingest", "--config", "jobs/acquisition_ingest.json", "--peaks", str(tmp / "peaks"), "--channels", str(tmp / "channels"), "--output", str(tmp / "o"), "--checkpoint", str(tmp / "c"))
    assert done.returncode == 0 and "read 50 peaks" in done.stderr, done.stderr
    assert read(spark.read.schema(ai.SUMMARY).parquet(str(tmp / "o" / "summary"))) == brute(rows)
    docs = texts(spark, tmp_path / "docs", small_collections())
    done = command("jobs.marker_terms", "--config", "jobs/marker_terms.json", "--documents", docs, "--output", str(tmp / "m"))
    assert done.returncode == 0 and "80 rows" in done.stderr, done.stderr
    assert spark.read.parquet(str(tmp / "m")).where(F.col("rank") == 1).count() == 2
