"""From exact sums to a release: domain joins, noise, threshold."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import norm_bucket
from ..functions.exact_noise import discrete_laplace
from ..functions.folders import new_folder

TOLERANCE = 1e-4
PARAMS = "privacy_params"  # the key of a metric's metadata


@dataclass(frozen=True)
class PrivacyParams:
    epsilon: float = 10.0
    l1: int = 65536
    delta: float = 1e-5

    def with_debug_epsilon(self, text: str | None) -> PrivacyParams:
        """A job's own epsilon; text that is no number is ignored, one outside (0, 64] is refused."""
        try:
            value = float(text) if text is not None else None
        except ValueError:
            value = None
        if value is None:
            return self
        if not 0 < value <= 64:
            raise ValueError("debug_privacy_epsilon must be above 0 and at most 64")
        return PrivacyParams(value, self.l1, self.delta)

    def threshold(self) -> float:
        if not 0 < self.delta < 1:
            raise ValueError("delta must be between 0 and 1, exclusive")
        return self.l1 / self.epsilon * (self.epsilon + math.log(1 / self.delta))


def read_domain_keys(domain: DataFrame) -> DataFrame:
    """Distinct 16-byte buckets."""
    return domain.select(norm_bucket("bucket").alias("bucket")).distinct()


def join_domain(sums: DataFrame, domain: DataFrame) -> DataFrame:
    """Each bucket of the (distinct) domain once, with its sum or 0; other buckets are dropped."""
    return domain.join(sums, "bucket", "left").select("bucket", F.coalesce("unnoised_metric", F.lit(0).cast("bigint")).alias("unnoised_metric"))


def debug_report(sums: DataFrame, domain: DataFrame) -> DataFrame:
    """Buckets of either side with annotations ``in_domain`` and ``in_reports``."""
    both = domain.withColumn("_d", F.lit(True)).join(sums.withColumn("_r", F.lit(True)), "bucket", "full_outer")
    notes = F.array_compact(F.array(F.when(F.col("_d"), "in_domain"), F.when(F.col("_r"), "in_reports")))
    return both.select("bucket", F.coalesce("unnoised_metric", F.lit(0).cast("bigint")).alias("unnoised_metric"), notes.alias("annotations"))


def keys_in(sums: DataFrame, keys: DataFrame) -> DataFrame:
    return sums.join(keys, "bucket", "left_semi")


def report_only(sums: DataFrame, domain: DataFrame) -> DataFrame:
    return sums.join(domain, "bucket", "left_anti")


def geometric_difference(params: PrivacyParams, seed: int | None = None) -> Column:
    """Discrete Laplace noise from two geometric draws of Spark's generator: for tests and modelling."""
    log_p = -params.epsilon / params.l1
    draw = lambda k: F.floor(F.log(F.lit(1.0) - F.rand(None if seed is None else seed + k)) / F.lit(log_p))
    return (draw(0) - draw(1)).cast("bigint")


def secure_noise(params: PrivacyParams) -> Column:
    """Exact discrete Laplace noise from the operating system's random source, drawn by Arrow batch: the default for
    releases."""
    epsilon, l1 = params.epsilon, params.l1

    @F.pandas_udf("bigint")
    def draw(values: pd.Series) -> pd.Series:
        return pd.Series(discrete_laplace(len(values), epsilon, l1))

    return draw.asNondeterministic()(F.col("unnoised_metric"))


def add_noise(sums: DataFrame, params: PrivacyParams, noise: str | Callable[[Column], Column] = "secure", seed: int | None = None) -> DataFrame:
    """Adds ``metric``: the sum plus noise. ``noise``: ``none``, ``secure``, ``prng``, or a function of the sum.

    The column says what it was noised with; Parquet files keep that (``params_of``).
    """
    if callable(noise):
        metric = noise(F.col("unnoised_metric"))
    else:
        metric = F.col("unnoised_metric") + {"none": lambda: F.lit(0), "secure": lambda: secure_noise(params), "prng": lambda: geometric_difference(params, seed)}[noise]()
    return with_params(sums.withColumn("metric", metric.cast("bigint")), params)


def released(noised: DataFrame, path: str | None = None) -> DataFrame:
    """The noised table, written once and read back: a lost task must not draw other noise for what is published.

    Summary and debug report both derive from it. Without a path it goes to the shared folder.
    """
    path = path or new_folder(noised.sparkSession, "release")
    noised.write.parquet(path)
    return noised.sparkSession.read.schema(noised.schema).parquet(path)


def apply_threshold(noised: DataFrame, threshold: float) -> DataFrame:
    return noised.filter(F.col("metric") >= threshold - TOLERANCE)


def optional_domain(sums: DataFrame, domain: DataFrame | None, params: PrivacyParams, noise="secure", skip_threshold: bool = False, seed: int | None = None, debug: bool = False) -> DataFrame:
    """Domain buckets, and the reports' other buckets where their noisy sum reaches the threshold.

    With ``debug``: all buckets of either side with annotations, and ``in_output`` for those that the summary has.
    """
    if debug:
        both = debug_report(sums, domain if domain is not None else sums.select("bucket").limit(0))
        inside = F.array_contains("annotations", "in_domain")
        kept = F.lit(True) if skip_threshold else inside | (F.col("metric") >= params.threshold() - TOLERANCE)
        return add_noise(both, params, noise, seed).withColumn("in_output", kept)
    if domain is None:
        out = add_noise(sums, params, noise, seed)
        return out if skip_threshold else apply_threshold(out, params.threshold())
    inside = add_noise(join_domain(sums, domain), params, noise, seed)
    outside = add_noise(report_only(sums, domain), params, noise, None if seed is None else seed + 2)
    return inside.unionByName(outside if skip_threshold else apply_threshold(outside, params.threshold()))


def with_params(results: DataFrame, params: PrivacyParams) -> DataFrame:
    """``results`` whose column ``metric`` says that it has noise of these parameters."""
    return results.withMetadata("metric", {PARAMS: {"epsilon": float(params.epsilon), "l1": int(params.l1), "delta": float(params.delta)}})


def params_of(results: DataFrame) -> PrivacyParams | None:
    """The parameters that ``results`` say they were noised with, None if they say nothing."""
    said = results.schema["metric"].metadata.get(PARAMS) if "metric" in results.columns else None
    return PrivacyParams(**said) if said else None


def union_results(a: DataFrame, b: DataFrame, params_a: PrivacyParams | None = None, params_b: PrivacyParams | None = None) -> DataFrame:
    """Both results, refused unless their privacy parameters are equal.

    Results say their parameters themselves, also when they are read from Parquet. Parameters are given for results that
    say nothing, and have to be those that results say.
    """
    found = []
    for results, given in ((a, params_a), (b, params_b)):
        said = params_of(results)
        if said and given and said != given:
            raise ValueError(f"results have noise of {said}, not of {given}")
        if not said and not given:
            raise ValueError("results without known privacy parameters cannot be joined")
        found.append(said or given)
    if found[0] != found[1]:
        raise ValueError("results with different privacy parameters cannot be joined")
    return a.unionByName(b)


def debug_columns(noised: DataFrame) -> DataFrame:
    """The debug report's columns: bucket, unnoised_metric, noise, annotations."""
    return noised.select("bucket", "unnoised_metric", (F.col("metric") - F.col("unnoised_metric")).alias("noise"), "annotations")
