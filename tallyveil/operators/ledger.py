"""The ledger of privacy budget: a log of commits over a table of used units.

``units/day=.../token=...``    units used, by day of their reporting window; a token is one try of one batch
``commits/<number>.json``      what counts: each number is one file that only one writer can create
``releases/<token>``           the noised result that a batch's budget was used for
``snapshots/<number>``         all commits up to a number, folded: their units, and batches still known

A writer reads the log, checks its units against those of all commits, writes them under a new token and tries to create
the next number. If another writer was faster, it checks against the new commits alone and tries the number after.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AggregationError
from ..functions import files
from ..functions.sizes import bounded_broadcast
from ..schemas import LEDGER, UNIT

LIMIT = 1
KEPT_DAYS = 92  # reports older than 90 days are refused, so units two days older than that are never asked for
TRIES = 1000
_COMMIT = "number long, batch string, token string, n_units long, digest string, request string, first_day date, last_day date, has_release boolean"
_UNITS = f"{LEDGER}, day date, token string"


@dataclass(frozen=True)
class Receipt:
    """What became of a batch: units that lack budget (then nothing was used), or its commit and release."""

    lacking: DataFrame | None
    number: int | None
    release: str | None  # where the noised result is, if the commit has one
    repeated: bool = False  # the batch was committed before; no further budget was used


@dataclass(frozen=True)
class Known:
    number: int
    n_units: int
    digest: str
    request: str
    release: str | None


@dataclass(frozen=True)
class _Digest:
    n_units: int
    digest: str
    first_day: date | None
    last_day: date | None


def _digest(units: DataFrame) -> _Digest:
    """The same for the same set of units in any order; and the days that they lie in."""
    rows = units.select(F.xxhash64(*UNIT).alias("a"), F.xxhash64(F.lit(1), *reversed(UNIT)).alias("b"), F.to_date("reporting_window").alias("day"))
    r = rows.agg(F.count("*"), F.bit_xor("a"), F.bit_xor("b"), F.sum(F.pmod("a", F.lit(1 << 31))), F.min("day"), F.max("day")).first()
    return _Digest(r[0], f"{r[1] or 0:x}:{r[2] or 0:x}:{r[3] or 0:x}", r[4], r[5])


def distinct_units(units: DataFrame) -> DataFrame:
    """Units once each; rows without a budget key or a window are none."""
    return units.select(*UNIT).filter(F.col(UNIT[0]).isNotNull() & F.col(UNIT[1]).isNotNull()).distinct()


class Ledger:
    """The ledger at ``path``; any number of writers may use it at once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # reading

    def _numbers(self, kind: str) -> list[int]:
        return [int(n.partition(".")[0]) for n in files.names(self.spark, f"{self.path}/{kind}") if n[:1].isdigit()]

    def _snapshot(self) -> int:
        """The number of the last snapshot, 0 if there is none."""
        return max(self._numbers("snapshots"), default=0)

    def _head(self) -> int:
        """The last commit's number."""
        return max(self._numbers("commits"), default=self._snapshot())

    def _entries(self, after: int, upto: int | None = None) -> DataFrame:
        """Commits with numbers above ``after``, a row each."""
        if not files.exists(self.spark, f"{self.path}/commits"):
            return self.spark.createDataFrame([], _COMMIT)
        rows = self.spark.read.schema(_COMMIT).option("pathGlobFilter", "*.json").option("mode", "FAILFAST").json(f"{self.path}/commits").filter(F.col("number") > after)
        return rows if upto is None else rows.filter(F.col("number") <= upto)

    def commits(self) -> DataFrame:
        """All commits that are still known."""
        last = self._snapshot()
        rows = self._entries(last)
        return rows.unionByName(self.spark.read.schema(_COMMIT).parquet(f"{self.path}/snapshots/{last:020d}/commits")) if last else rows

    def _used(self, after: int, first: date | None, last: date | None, upto: int | None = None) -> DataFrame:
        """Units of commits above ``after`` (and of the snapshot, if it is 0) that lie in days ``first`` to ``last``."""
        snapshot = self._snapshot() if after == 0 else 0
        entries = self._entries(max(after, snapshot), upto)
        out = self.spark.createDataFrame([], _UNITS)
        units = self._days(f"{self.path}/units", _UNITS, first, last)
        if units is not None:
            if first is not None:
                entries = entries.filter((F.col("first_day") <= F.lit(last)) & (F.col("last_day") >= F.lit(first)))
            out = units.join(bounded_broadcast(entries.select("token")), "token", "left_semi")
        if snapshot and (upto is None or snapshot <= upto):
            old = self._days(f"{self.path}/snapshots/{snapshot:020d}/units", f"{LEDGER}, day date", first, last)
            out = out if old is None else out.unionByName(old, allowMissingColumns=True)
        return out

    def _days(self, path: str, schema: str, first: date | None, last: date | None) -> DataFrame | None:
        """Units of days ``first`` to ``last``; folders of other days are not even listed."""
        days = [n for n in files.names(self.spark, path) if n.startswith("day=") and (first is None or f"day={first}" <= n <= f"day={last}")]
        if not days:
            return None
        rows = self.spark.read.schema(schema).option("basePath", path).parquet(*(f"{path}/{n}" for n in days))
        return rows if first is None else rows.filter(F.col("day").between(F.lit(first), F.lit(last)))

    def _write_units(self, units: DataFrame, token: str) -> None:
        """Units under their days; each writer has a folder of its own until they are written."""
        staging = f"{self.path}/_staging/{token}"
        rows = units.select(*UNIT, F.lit(1).alias("used"), F.to_date("reporting_window").alias("day"))
        rows.repartition("day").write.partitionBy("day").parquet(staging)
        for day in files.names(self.spark, staging):
            if day.startswith("day="):
                files.move_once(self.spark, f"{staging}/{day}", f"{self.path}/units/{day}/token={token}")
        files.delete(self.spark, staging)

    def used(self) -> DataFrame:
        """All units used so far."""
        return self._used(0, None, None).select(*UNIT, "used")

    def lacking(self, units: DataFrame, after: int = 0, limit: int | None = None, digest: _Digest | None = None) -> DataFrame:
        """Those of ``units`` whose budget is used up; with ``limit`` the first few by key.

        Only the days that ``units`` lie in are read: by their range, and day by day as Spark finds them when it runs.
        """
        digest = digest or _digest(units)
        if not digest.n_units:
            return units.select(*UNIT).limit(0)
        wanted = units.select(*UNIT).withColumn("day", F.to_date("reporting_window"))
        days = wanted.select("day").filter(F.col("day").between(F.lit(digest.first_day), F.lit(digest.last_day))).distinct()
        used = self._used(after, digest.first_day, digest.last_day).join(bounded_broadcast(days), "day", "left_semi")
        full = used.groupBy(*UNIT).agg(F.sum("used").alias("used")).filter(F.col("used") >= LIMIT).select(*UNIT)
        out = units.select(*UNIT).join(full, UNIT, "left_semi")
        return out if limit is None else out.orderBy(*UNIT).limit(limit)

    # writing

    def release_path(self, token: str) -> str:
        return f"{self.path}/releases/{token}"

    def find(self, batch: str) -> Known | None:
        """What a batch was committed for and where its release is; None if it is not known."""
        row = self.commits().filter(F.col("batch") == batch).first()
        return row and Known(row.number, row.n_units, row.digest, row.request, self.release_path(row.token) if row.has_release else None)

    def committed(self, units: DataFrame, batch: str, request: str = "", digest: _Digest | None = None) -> Receipt | None:
        """The receipt of a batch that is known, None for a new one. A batch that was committed for other units, or for
        another request, is refused: its name is taken."""
        known = self.find(batch)
        if known is None:
            return None
        mine = digest or _digest(units)
        if (known.n_units, known.digest, known.request) != (mine.n_units, mine.digest, request):
            raise AggregationError("PRIVACY_BUDGET_ERROR", f"batch {batch} is committed for other units or another request")
        return Receipt(None, known.number, known.release, True)

    def consume(self, units: DataFrame, batch: str, limit: int | None = None, release: Callable[[str], None] | None = None, request: str = "") -> Receipt:
        """All or nothing: use up all of ``units`` (a written table, distinct), or return those that lack budget.

        ``release(path)`` writes what the budget is for, before it is used up; the commit then points to it. A batch that
        is known already, from an earlier run or from one at the same time, uses no more budget, and its receipt names
        the release of that run: no other one may be drawn for it.
        """
        mine = _digest(units)
        known = self.committed(units, batch, request, mine)
        if known:
            return known
        self._refuse_expired(mine)
        token, seen, written = uuid.uuid4().hex, 0, False
        try:
            for _ in range(TRIES):
                head = self._head()
                lacking = self.lacking(units, seen, limit, mine)
                if lacking.take(1):
                    return self.committed(units, batch, request, mine) or Receipt(lacking, None, None)
                if not written:
                    written = True
                    if mine.n_units:
                        self._write_units(units, token)
                    if release:
                        release(self.release_path(token))
                days = {"first_day": str(mine.first_day), "last_day": str(mine.last_day)} if mine.n_units else {}
                entry = {"number": head + 1, "batch": batch, "token": token, "n_units": mine.n_units, "digest": mine.digest, "request": request, "has_release": release is not None, **days}
                name = f"{self.path}/commits/{head + 1:020d}.json"
                if files.create_once(self.spark, name, json.dumps(entry) + "\n"):
                    if self._snapshot() > head:  # the number was folded and vacuumed since the head was read
                        files.delete(self.spark, name)
                        continue
                    token = None
                    return Receipt(None, head + 1, self.release_path(entry["token"]) if release else None)
                seen = head  # another writer was first: only what came after is new
                known = self.committed(units, batch, request, mine)
                if known:
                    return known
        finally:
            if token and written:  # not committed: nobody reads it
                files.delete(self.spark, self.release_path(token))
                files.delete(self.spark, f"{self.path}/_staging/{token}")
                for day in files.names(self.spark, f"{self.path}/units"):
                    if f"day={mine.first_day}" <= day <= f"day={mine.last_day}":
                        files.delete(self.spark, f"{self.path}/units/{day}/token={token}")
        raise AggregationError("PRIVACY_BUDGET_ERROR", f"no commit in {TRIES} tries")

    # upkeep

    def _expired_before(self) -> date | None:
        last = self._snapshot()
        text = files.read_text(self.spark, f"{self.path}/snapshots/{last:020d}/expired.json") if last else "null"
        day = json.loads(text)
        return date.fromisoformat(day) if day else None

    def _refuse_expired(self, mine: _Digest) -> None:
        before = self._expired_before()
        if before and mine.first_day and mine.first_day < before:
            raise AggregationError("PRIVACY_BUDGET_ERROR", f"units of days before {before} are no longer kept")

    def compact(self, as_of: datetime, kept_days: int = KEPT_DAYS) -> int:
        """Fold all commits into a snapshot; units of days more than ``kept_days`` before ``as_of`` end, and with them
        the batches that have no later ones. Writers may go on meanwhile. Returns the snapshot's number."""
        before, upto, last = (as_of - timedelta(days=kept_days)).date(), self._head(), self._snapshot()
        earlier = self._expired_before()
        before = max(before, earlier) if earlier else before
        if upto == last:  # no new commits; a snapshot has its number from them
            return last
        staging, target = f"{self.path}/snapshots/_staging-{uuid.uuid4().hex}", f"{self.path}/snapshots/{upto:020d}"
        units = self._used(0, before, date.max, upto).groupBy(*UNIT, "day").agg(F.sum("used").cast("int").alias("used"))
        units.repartition("day").write.partitionBy("day").parquet(f"{staging}/units")
        known = self.commits().filter((F.col("number") <= upto) & (F.coalesce("last_day", F.lit(date.max)) >= F.lit(before)))
        known.write.parquet(f"{staging}/commits")
        files.write_text(self.spark, f"{staging}/expired.json", json.dumps(str(before)))
        if not files.move_once(self.spark, staging, target):
            files.delete(self.spark, staging)  # another one folded the same commits
        return upto

    def vacuum(self) -> None:
        """Delete what the last snapshot stands for, and releases of batches no longer known. For when no reader that
        began before the snapshot is left."""
        last = self._snapshot()
        if not last:
            return
        folded = {r.token for r in self._entries(0, last).select("token").toLocalIterator()}  # commits since the last vacuum
        earlier = [n for n in self._numbers("snapshots") if n < last]
        ended = folded | {r.token for n in earlier for r in self.spark.read.schema(_COMMIT).parquet(f"{self.path}/snapshots/{n:020d}/commits").select("token").toLocalIterator()}
        known = {r.token for r in self.commits().filter("has_release").select("token").toLocalIterator()}
        for day in files.names(self.spark, f"{self.path}/units"):
            for name in files.names(self.spark, f"{self.path}/units/{day}") if day.startswith("day=") else ():
                if name.removeprefix("token=") in folded:
                    files.delete(self.spark, f"{self.path}/units/{day}/{name}")
        for token in ended - known:
            files.delete(self.spark, self.release_path(token))
        for number in self._numbers("commits"):
            if number <= last:
                files.delete(self.spark, f"{self.path}/commits/{number:020d}.json")
        for number in earlier:
            files.delete(self.spark, f"{self.path}/snapshots/{number:020d}")
