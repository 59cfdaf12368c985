"""The ledger of privacy budget: repeated batches, writers at the same time, days read, folding."""

import threading
from dataclasses import replace
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_jobs import b, frame, job, report

from tallyveil.errors import AggregationError
from tallyveil.functions import files
from tallyveil.operators import budget
from tallyveil.operators.ledger import Ledger
from tallyveil.plans import job as jobs
from tallyveil.sources import readers

DAY = datetime(2021, 1, 5, 7, tzinfo=UTC)


def units(spark, *keys, day=DAY):
    return spark.createDataFrame([(f"key{k}", day + timedelta(days=d), "https://a.com") for k, d in [(k, 0) if isinstance(k, int) else k for k in keys]], "privacy_budget_key string, reporting_window timestamp, reporting_origin string")


def counts(ledger):
    return {(r.privacy_budget_key, str(r.reporting_window.date())): r.used for r in ledger.used().groupBy("privacy_budget_key", "reporting_window").agg(F.sum("used").alias("used")).collect()}


def test_a_batch_is_bound_to_its_units_and_release(spark, tmp_path):
    ledger, drawn = Ledger(spark, str(tmp_path / "ledger")), []

    def release(path):
        drawn.append(path)
        spark.range(3).write.parquet(path)

    first = ledger.consume(units(spark, 1, 2), "one", release=release, request="r")
    assert (first.number, first.repeated, first.lacking) == (1, False, None) and spark.read.parquet(first.release).count() == 3
    again = ledger.consume(units(spark, 2, 1), "one", release=release, request="r")
    assert again.repeated and again.release == first.release and len(drawn) == 1
    for other, request in ((units(spark, 1, 3), "r"), (units(spark, 1), "r"), (units(spark, 1, 2), "other")):
        with pytest.raises(AggregationError) as e:
            ledger.consume(other, "one", release=release, request=request)
        assert e.value.code == "PRIVACY_BUDGET_ERROR"
    lacking = ledger.consume(units(spark, 2, 3), "two", release=release)
    assert [r.privacy_budget_key for r in lacking.lacking.collect()] == ["key2"] and lacking.number is None and len(drawn) == 1
    assert counts(ledger) == {("key1", "2021-01-05"): 1, ("key2", "2021-01-05"): 1}
    assert ledger.consume(units(spark), "none").number == 2 and ledger.consume(units(spark), "none").repeated


def test_failed_releases_use_no_budget(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))

    def fails(path):
        spark.range(1).write.parquet(path)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ledger.consume(units(spark, 1), "one", release=fails)
    assert ledger.used().count() == 0 and not files.names(spark, str(tmp_path / "ledger" / "releases"))
    assert ledger.consume(units(spark, 1), "one").number == 1


def test_writers_at_the_same_time_never_use_a_unit_twice(spark, tmp_path):
    """Eight writers, four of which want a unit in common with their neighbour; two run the same batch."""
    path, out, failures = str(tmp_path / "ledger"), {}, []
    wanted = {f"w{k}": [k, k + 1] for k in range(6)} | {"twin": [50], "twin again": [50]}
    tables = {name: units(spark, *keys) for name, keys in wanted.items()}

    def write(name):
        try:
            out[name] = Ledger(spark, path).consume(tables[name], name.split()[0], release=lambda p: spark.range(1).write.parquet(p))
        except Exception as e:  # noqa: BLE001
            failures.append(e)

    threads = [threading.Thread(target=write, args=(name,)) for name in wanted]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failures
    assert set(counts(Ledger(spark, path)).values()) == {1}
    won = {name for name, r in out.items() if r.number is not None}
    for k in range(5):
        assert not {f"w{k}", f"w{k + 1}"} <= won
    assert {int(n[3:]) for n, _ in counts(Ledger(spark, path))} == {u for name in won for u in wanted[name]}
    assert out["twin"].release == out["twin again"].release and {out["twin"].repeated, out["twin again"].repeated} == {True, False}
    numbers = sorted(r.number for name, r in out.items() if r.number and not r.repeated)
    assert numbers == list(range(1, len(numbers) + 1))


def test_only_the_days_asked_for_are_read(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    for k in range(3):
        ledger.consume(units(spark, *((k, 10 * k + d) for d in range(10))), f"batch{k}")
    asked = budget.written_units(units(spark, (0, 3), (1, 3), (1, 12)))
    lacking = ledger.lacking(asked)
    plan = lacking._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "dynamicpruning" in plan and "day#" in plan.split("PartitionFilters")[1]
    assert sorted(r.privacy_budget_key for r in lacking.collect()) == ["key0", "key1"]
    read = {f.split("day=")[1][:10] for f in ledger._used(0, datetime(2021, 1, 8).date(), datetime(2021, 1, 9).date()).inputFiles() if "day=" in f}
    assert read == {"2021-01-08", "2021-01-09"}


def test_folding_keeps_budget_batches_and_expiry(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    first = ledger.consume(units(spark, (1, 0), (2, 40)), "one", release=lambda p: spark.range(2).write.parquet(p))
    ledger.consume(units(spark, (9, 0)), "old", release=lambda p: spark.range(2).write.parquet(p))
    before = counts(ledger)
    assert ledger.compact(DAY + timedelta(days=50)) == 2 and counts(ledger) == before
    ledger.vacuum()
    assert counts(ledger) == before and not files.names(spark, str(tmp_path / "ledger" / "commits"))
    assert ledger.consume(units(spark, (1, 0), (2, 40)), "one").release == first.release and spark.read.parquet(first.release).count() == 2
    assert ledger.consume(units(spark, (2, 40), (3, 1)), "two").lacking.count() == 1
    assert ledger.consume(units(spark, (3, 41)), "three").number == 3
    assert ledger.compact(DAY + timedelta(days=100)) == 3
    ledger.vacuum()
    assert set(counts(ledger)) == {("key2", "2021-02-14"), ("key3", "2021-02-15")}
    with pytest.raises(AggregationError, match="no longer kept"):
        ledger.consume(units(spark, (1, 0)), "late")
    assert ledger.consume(units(spark, (1, 0), (2, 40)), "one").repeated  # a batch ends with its last day
    assert not any(r.batch == "old" for r in ledger.commits().collect()) and len(files.names(spark, str(tmp_path / "ledger" / "releases"))) == 1
    assert ledger.consume(units(spark, (4, 42)), "four").number == 4


def test_a_number_that_was_folded_meanwhile_is_not_used(spark, tmp_path, monkeypatch):
    """A slow writer read the log before others committed, folded it and deleted the commits."""
    ledger, head = Ledger(spark, str(tmp_path / "ledger")), Ledger._head
    ledger.consume(units(spark, 1), "one")

    def slow(self):
        at = head(self)
        if not done:
            done.append(True)
            other = Ledger(spark, self.path)
            other.consume(units(spark, 2), "two")
            other.compact(DAY)
            other.vacuum()
        return at

    done = []
    monkeypatch.setattr(Ledger, "_head", slow)
    assert ledger.consume(units(spark, 3), "three").number == 3
    assert {k for k, _ in counts(ledger)} == {"key1", "key2", "key3"}


def test_a_rerun_draws_no_new_noise(spark, tmp_path):
    rows = frame(spark, [report(k, [(k, 5, 0)]) for k in range(1, 12)])
    domain = spark.createDataFrame([(b(k),) for k in range(1, 12)], "bucket binary")
    run = job(ledger=str(tmp_path / "ledger"), budget="ledger", batch="day", noise="secure", output=str(tmp_path / "one"))
    result = lambda out: sorted((bytes(r.bucket), r.metric) for r in out.summary.collect())
    code = lambda out: out.result_info.first().return_code
    first = jobs.run_aggregation(spark, run, rows, domain)
    again = jobs.run_aggregation(spark, replace(run, output=str(tmp_path / "two")), rows, domain)
    assert code(first) == code(again) == "SUCCESS" and result(first) == result(again)
    published = [sorted((bytes(r.bucket), r.metric) for r in readers.read_summary(spark, str(tmp_path / n)).collect()) for n in ("one", "two")]
    assert published[0] == published[1]
    for more in ({"filtering_ids_text": "0,1"}, {"debug_privacy_epsilon": "1"}, {"attribution_report_to": "https://b.foo.com", "report_error_threshold_percentage": "100"}):
        other = jobs.run_aggregation(spark, replace(run, output=str(tmp_path / "three"), **more), rows, domain)
        assert code(other) == "PRIVACY_BUDGET_ERROR" and other.summary is None
    fresh = jobs.run_aggregation(spark, replace(run, batch="other", output=str(tmp_path / "four")), rows, domain)
    assert code(fresh) == "PRIVACY_BUDGET_EXHAUSTED"


def test_a_failed_publication_is_taken_up_again(spark, tmp_path, monkeypatch):
    rows, domain = frame(spark, [report(1, [(1, 5, 0)])]), spark.createDataFrame([(b(1),), (b(2),)], "bucket binary")
    run, draws = job(ledger=str(tmp_path / "ledger"), budget="ledger", batch="day", noise="secure", output=str(tmp_path / "out")), []
    real = jobs.write_sharded

    def fails(results, *args, **more):
        draws.append(sorted(r.metric for r in results.collect()))
        raise FileExistsError("no room")

    monkeypatch.setattr(jobs, "write_sharded", fails)
    with pytest.raises(AggregationError, match="day") as e:
        jobs.run_aggregation(spark, run, rows, domain)
    assert e.value.code == "RESULT_WRITE_ERROR"
    monkeypatch.setattr(jobs, "write_sharded", real)
    jobs.run_aggregation(spark, run, rows, domain)
    assert sorted(r.metric for r in readers.read_summary(spark, str(tmp_path / "out")).collect()) == draws[0]
