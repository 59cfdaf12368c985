"""Publications with a manifest, and privacy parameters that travel with results."""

from dataclasses import replace

import pytest
from test_jobs import b, summary

from tallyveil.errors import AggregationError
from tallyveil.operators import release
from tallyveil.sources import readers, writers

PARAMS = release.PrivacyParams(epsilon=1.0, l1=10)


def results(spark, n=40, params=PARAMS):
    return release.add_noise(spark.createDataFrame([(b(k), k) for k in range(1, n + 1)], "bucket binary, unnoised_metric long"), params, "none")


@pytest.mark.parametrize("moved", [0, 1, 2])
def test_a_publication_that_is_cut_off_is_not_seen_and_can_be_done_again(spark, tmp_path, monkeypatch, moved):
    path, real, done = str(tmp_path / "out"), writers.files.move_once, []

    def killed(spark, source, target):
        if "_manifest" in target or len(done) == moved:
            raise KeyboardInterrupt
        done.append(target)
        return real(spark, source, target)

    with monkeypatch.context() as m:
        m.setattr(writers.files, "move_once", killed)
        with pytest.raises(KeyboardInterrupt):
            writers.write_sharded(results(spark), path, 735)
    with pytest.raises(AggregationError) as e:
        readers.read_summary(spark, path)
    assert e.value.code == "INPUT_DATA_READ_FAILED"
    assert writers.write_sharded(results(spark, 50), path, 735) == ["out-1-of-2.parquet", "out-2-of-2.parquet"]
    assert summary(readers.read_summary(spark, path)) == {k: k for k in range(1, 51)}
    with pytest.raises(FileExistsError):
        writers.write_sharded(results(spark), path, 735)
    assert writers.damaged_shards(spark, path) == []


def test_damaged_shards_and_foreign_files(spark, tmp_path):
    path = tmp_path / "out"
    writers.write_sharded(results(spark), str(path), 735)
    (path / "stray.parquet").write_bytes((path / "out-1-of-2.parquet").read_bytes())  # no file of the publication
    assert summary(readers.read_summary(spark, str(path))) == {k: k for k in range(1, 41)}
    (path / "out-1-of-2.parquet").write_bytes((path / "out-2-of-2.parquet").read_bytes())
    assert writers.damaged_shards(spark, str(path)) == ["out-1-of-2.parquet"]
    (path / "out-2-of-2.parquet").unlink()
    assert writers.damaged_shards(spark, str(path)) == ["out-1-of-2.parquet", "out-2-of-2.parquet"]
    with pytest.raises(FileExistsError):  # a folder that holds something else is left alone
        writers.write_sharded(results(spark), str(tmp_path), 735)


def test_parameters_travel_with_results(spark, tmp_path):
    other = replace(PARAMS, epsilon=2.0)
    writers.write_sharded(results(spark), str(tmp_path / "a"))
    writers.write_summary(results(spark), str(tmp_path / "b"))
    writers.write_sharded(results(spark, params=other), str(tmp_path / "c"))
    writers.write_summary(results(spark, params=other), str(tmp_path / "d"))
    a, b_, c, d = (readers.read_summary(spark, str(tmp_path / n)) for n in "abcd")
    assert [release.params_of(x) for x in (a, b_, c, d)] == [PARAMS, PARAMS, other, other]
    assert release.union_results(a, b_).count() == 80 and release.params_of(release.union_results(a, b_).filter("metric > 3")) == PARAMS
    for x, y in ((a, c), (b_, d), (a.select("bucket", (a.metric + 1).alias("metric")), a)):
        with pytest.raises(ValueError):
            release.union_results(x, y)
    with pytest.raises(ValueError):
        release.union_results(a, b_, other, other)
    with pytest.raises(ValueError):
        readers.read_summary(spark, [str(tmp_path / n) for n in "ac"])
    assert release.params_of(readers.read_summary(spark, [str(tmp_path / n) for n in "ab"])) == PARAMS
    plain = results(spark).selectExpr("bucket", "metric + 0 AS metric")
    assert release.union_results(plain, plain, PARAMS, PARAMS).count() == 80


def test_exhausted_inputs_lie_in_bounded_files(spark, tmp_path):
    info = spark.range(25).selectExpr("CAST(id AS STRING) AS api", "timestamp_seconds(id) AS scheduled_report_time")
    for per_file, n_files in ((1_000_000, 1), (10, 2)):
        path = f"{tmp_path}/{per_file}"
        writers.write_exhausted_info(info, path, per_file)
        back = spark.read.json(path)
        assert len(back.inputFiles()) == n_files and {(r.api, r.scheduled_report_time) for r in back.collect()} == {(str(i), float(i)) for i in range(25)}
    writers.write_exhausted_info(info.limit(0), f"{tmp_path}/none")
    assert spark.read.text(f"{tmp_path}/none").count() == 0
