"""Sites (registrable domains) of reporting origins, by rules of public suffixes.

A plain rule names a suffix. A wildcard rule ``*.ck`` makes every name right under ``ck`` one. An exception rule
``!www.ck`` takes a name out again: its suffix is what follows its first label. An exception wins over all other rules,
else the longest suffix does. Hosts and rules are compared in ASCII form, so ``公司.cn`` and ``xn--55qx5d.cn`` are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import written
from .names import unused
from .sizes import bounded_broadcast

# A small table of public suffix rules; give a full one as a file or a DataFrame with a column ``suffix``.
SUFFIXES = "com org net edu gov mil int info biz io co dev app uk co.uk org.uk ac.uk gov.uk de fr es it nl be ch at eu us ca au com.au net.au org.au jp co.jp ne.jp or.jp *.kawasaki.jp !city.kawasaki.jp in co.in br com.br mx com.mx cn com.cn 公司.cn ru pl se no fi dk cz pt ie nz co.nz za co.za kr co.kr sg com.sg hk com.hk tw com.tw *.ck !www.ck blogspot.com github.io".split()
PLAIN, WILDCARD, EXCEPTION = "plain", "wildcard", "exception"
_LABEL = r"[a-z0-9_]([a-z0-9_-]{0,61}[a-z0-9_])?"
_DOMAIN = rf"^(?=.{{1,253}}$)({_LABEL}\.)*{_LABEL}$"
_DOTS = ("。．｡", "...")  # full stops of other scripts


def _ascii(host: Column) -> Column:
    """Lower case, with labels of other letters in their ASCII form; null if there is none."""
    return F.when(host.rlike(r"^\p{ASCII}*$"), F.lower(host)).otherwise(F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), F.lower(host))))


def suffix_rules(suffixes: DataFrame) -> DataFrame:
    """suffix and kind of rules as a public-suffix file writes them (column ``suffix``): ``com``, ``*.ck``, ``!www.ck``."""
    text = F.trim("suffix")
    kind = F.when(text.startswith("*."), WILDCARD).when(text.startswith("!"), EXCEPTION).otherwise(PLAIN)
    rules = suffixes.select(_ascii(F.translate(F.regexp_replace(text, r"^(\*\.|!)", ""), *_DOTS)).alias("suffix"), kind.alias("kind"))
    return rules.filter("suffix != ''").distinct()


def suffix_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SUFFIXES], "suffix string")


def public_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a public-suffix file: one a line, up to the first white space; comments and blank lines are left
    out."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\S*)", 1).alias("suffix")).filter("suffix != '' AND NOT startswith(suffix, '//')")


def _suffix_starts(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """host and the label (from 0) at which its public suffix starts; hosts without a suffix have no row.

    One join: each tail of a host meets the rule of that name, whatever its kind.
    """
    labels = F.split(_ascii(F.col("host")), r"\.")
    tails = F.transform(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("suffix")))
    rows = hosts.select("host", F.explode(tails).alias("t")).select("host", "t.i", "t.suffix")
    found = rows.join(bounded_broadcast(suffix_rules(suffixes)), "suffix")
    start = F.when(F.col("kind") == EXCEPTION, F.col("i") + 1).when(F.col("kind") == WILDCARD, F.col("i") - 1).otherwise(F.col("i"))
    found = found.select("host", (F.col("kind") != EXCEPTION).alias("other"), start.alias("start")).filter("start >= 0")
    return found.groupBy("host").agg(F.min(F.struct("other", "start")).alias("best")).select("host", F.col("best.start").alias("start"))


def _host(origin: Column) -> Column:
    """The host of an origin with a scheme; null if it is malformed."""
    plain = F.try_parse_url(origin, F.lit("HOST"))
    other = F.nullif(F.regexp_extract(origin, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@\s]*@)?([^/?#:@\s\[\]]+)(?::[0-9]*)?(?:[/?#]|$)", 1), F.lit(""))
    host = F.when(origin.rlike(r"^\p{ASCII}*$"), plain).otherwise(other)
    host = F.regexp_replace(F.lower(F.translate(host, *_DOTS)), r"\.$", "")
    return F.when(origin.rlike("^[A-Za-z][A-Za-z0-9+.-]*://") & _ascii(host).rlike(_DOMAIN), host)


def _origins(df: DataFrame, origin: str, key: str) -> DataFrame:
    """The distinct values of ``origin``, written: whatever looks them up runs on these and not, pushed down, on all rows."""
    return written(df.select(F.col(origin).alias(key)).distinct(), "origins").filter(F.col(key).isNotNull())


def with_site(df: DataFrame, suffixes: DataFrame, origin: str = "reporting_origin", site: str = "site") -> DataFrame:
    """``df`` plus ``site``: ``https://`` and the registrable domain of ``origin``, in the origin's own letters.

    Null where the origin has no scheme, is malformed, is a bare public suffix or is under none. Only distinct
    origins are looked up; where they are few, ``df`` is not shuffled. ``suffixes``: rules as in a public-suffix file (column ``suffix``).
    """
    key = unused(df, "origin_key")
    base = _origins(df, origin, key).withColumn("host", _host(F.col(key)))
    starts = _suffix_starts(base.filter("host IS NOT NULL").select("host").distinct(), suffixes).filter("start > 0")
    labels = F.split("host", r"\.")
    known = base.join(starts, "host").select(key, F.concat(F.lit("https://"), F.array_join(F.slice(labels, F.col("start"), F.size(labels)), ".")).alias(site))
    known = bounded_broadcast(written(known, "sites"))
    return df.join(known, df[origin] == known[key], "left").drop(key)


def with_domain_flag(df: DataFrame, suffixes: DataFrame, origin: str = "reporting_origin", flag: str = "is_domain") -> DataFrame:
    """``df`` plus ``flag``: the origin is a bare, well-formed domain name that ends in a public suffix."""
    key, good = unused(df, "origin_key"), unused(df, "origin_good")
    host = F.regexp_replace(F.lower(F.translate(F.col(key), *_DOTS)), r"\.$", "")
    base = _origins(df, origin, key).withColumn("host", host)
    shown = _ascii(F.col("host"))
    hosts = base.filter(shown.rlike(_DOMAIN) & F.element_at(F.split(shown, r"\."), -1).rlike("^[a-z_]"))
    known = hosts.join(_suffix_starts(hosts.select("host").distinct(), suffixes), "host", "left_semi").select(key, F.lit(True).alias(good))
    known = bounded_broadcast(written(known, "domains"))
    return df.join(known, df[origin] == known[key], "left").withColumn(flag, F.coalesce(F.col(good), F.lit(False))).drop(key, good)
