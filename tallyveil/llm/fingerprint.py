"""Document fingerprints: canonical exact digests, with SQL functions only.

A text is normalised (NFKC), folded in case and white space, and digested by two 64-bit xxhash functions.
Texts in one digest bucket are compared byte by byte; should two differ, each gets a number of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import bounded_broadcast
from .components import saved, spread, unused
from .sketch import text_bytes

SPAN_BYTES = 8 << 20
MAX_SPANS = 4096
FINE = 64


def _icu(of: str, text: Column) -> Column:
    """A static function of the ICU library that Spark ships."""
    name, method = of.rsplit(".", 1)
    return F.call_function("java_method", F.lit(f"com.ibm.icu.{name}"), F.lit(method), text, F.lit(True))


def _nfkc_folded(text: Column) -> Column:
    """NFKC under full case folding of all scripts. ASCII text is its own normal form, and only lower case changes it.

    Composing can bring letters that fold again, and folding marks that compose again: both are done twice.
    """
    folded = text
    for _ in range(2):
        folded = _icu("lang.UCharacter.foldCase", _icu("text.Normalizer.compose", folded))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(_icu("text.Normalizer.compose", folded))


def canonical(text: Column) -> Column:
    """Normal form: NFKC, case folded in full (sharp s as ss, one sigma, iota below as iota), runs of white space one space, none at the ends."""
    space = r"[\s\x{85}\p{Z}]"  # a single space between words stays as it is
    return F.trim(F.regexp_replace(_nfkc_folded(text), rf"{space}{{2,}}|[\s\x{{85}}\p{{Z}}&&[^ ]]", " "))


def digest(canon: Column) -> Column:
    """128 bits: xxhash64 twice, the second time seeded by a constant, as 32 hex digits."""
    return F.lower(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(canon), F.xxhash64(F.lit(1), canon)))))


def _numbers(rows: DataFrame) -> DataFrame | None:
    """``digest, canon, number`` of the buckets that hold different canonical texts; None when there is no such bucket.

    ``rows``: digest, text. Digests are counted first; only texts of a digest that more than one row has are then
    compared, byte by byte. Copies are dropped map-side, so a group of any size stays small.
    """
    several = saved(rows.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "several")
    texts = rows.join(bounded_broadcast(several), "digest", "left_semi").select("digest", "text").distinct()
    canon = texts.select("digest", canonical(F.col("text")).alias("canon")).distinct()
    mixed = saved(canon.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "mixed")
    if not mixed.take(1):
        return None
    return canon.join(mixed, "digest").withColumn("number", F.row_number().over(Window.partitionBy("digest").orderBy("canon")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus ``fingerprint``: equal exactly for texts of equal canonical form.

    Null text counts as empty. All rows and columns stay, repeated rows included; a column named ``fingerprint``
    is replaced. The table is written once, with its digests, to the shared folder.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = saved(docs.drop("fingerprint").withColumn("fingerprint", digest(canonical(text))), "fingerprints", "zstd")
    numbers = _numbers(rows.select(F.col("fingerprint").alias("digest"), text.alias("text")))
    return rows if numbers is None else _numbered(rows, numbers, "fingerprint", canonical(text))


def _with_next(rows: DataFrame, n_bytes: int) -> DataFrame:
    """``rows`` (doc_id, text, ...) plus ``next``, a struct of the next row by descending id; the first follows the last.

    Ids are cut into spans by quantiles; each span's first row also goes, as a ghost, to the span before, so one
    exchange of the texts serves a windowed ``lead`` and no task sees more than its span. Equal ids are ordered
    by text; null ids come last.
    """
    n = int(min(max(n_bytes // SPAN_BYTES, 1), MAX_SPANS))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100_000)).first()[0] or []
    cuts = sorted({c for c in cuts}, reverse=True) if n > 1 else []
    groups = [cuts[i : i + FINE] for i in range(0, len(cuts), FINE)]
    as_array = lambda x: F.array(*map(F.lit, x)).cast("array<bigint>")
    below = lambda a: F.size(F.filter(a, lambda c: c > F.coalesce("doc_id", F.lit(-(1 << 63)))))
    if len(groups) > 1:
        coarse = below(as_array([g[-1] for g in groups]))
        fine = F.coalesce(below(F.get(F.array(*map(as_array, groups)), coarse)), F.lit(0))
        span = coarse * FINE + F.when(coarse < len(groups), fine).otherwise(0)
    else:
        span = below(as_array(cuts))
    rows = rows.withColumn("_span", span.cast("int"))
    heads = dict(rows.groupBy("_span").agg(F.max("doc_id")).collect())  # a row a span: MAX_SPANS at most
    used = sorted(heads)
    before = {s: used[i - 1] for i, s in enumerate(used)}
    every = range(max(used, default=0) + 1)
    head = F.get(as_array([heads.get(s) for s in every]), F.col("_span"))
    ghost = F.get(as_array([before.get(s) for s in every]), F.col("_span")).cast("int")
    here = F.struct(F.col("_span").alias("at"), F.lit(False).alias("ghost"))
    copies = F.when(F.col("doc_id").eqNullSafe(head), F.array(here, F.struct(ghost.alias("at"), F.lit(True).alias("ghost")))).otherwise(F.array(here))
    names = [c for c in rows.columns if c != "_span"]
    dealt = rows.withColumn("_place", F.explode(copies)).select(*names, F.col("_place.at").alias("_at"), F.col("_place.ghost").alias("_ghost"))
    order = Window.partitionBy("_at").orderBy("_ghost", F.desc_nulls_last("doc_id"), "text")
    return dealt.withColumn("next", F.lead(F.struct(*names)).over(order)).filter("NOT _ghost").select(*names, "next")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of edited texts, whose last third is the start of the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (1.0 when
    the fingerprints are equal, else 0.0). Null text counts as empty. Repeated rows each get a row.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    n_bytes = text_bytes(base, "text")
    base = saved(spread(base).withColumn("digest", digest(canonical(F.col("text")))), "digests", "zstd")
    numbers = _numbers(base.select("digest", "text"))
    rows = _with_next(base, n_bytes)
    size = F.char_length("text")
    third = F.floor(size / 3).cast("int")
    rows = rows.select("doc_id", "text", size.cast("long").alias("n_chars"), F.concat(F.left("text", size - third), F.left("next.text", third)).alias("edited"), F.col("digest").alias("fingerprint"), F.col("next.digest").alias("next_fingerprint"), F.col("next.text").alias("next_text"))
    rows = rows.withColumn("edited_canon", canonical(F.col("edited"))).withColumn("edited_fingerprint", digest(F.col("edited_canon")))
    if numbers is not None:
        rows = _numbered(_numbered(_numbered(rows, numbers, "fingerprint", canonical(F.col("text"))), numbers, "next_fingerprint", canonical(F.col("next_text"))), numbers, "edited_fingerprint", F.col("edited_canon"))
    # An edited text in its document's bucket is compared with it byte by byte.
    clash = (F.col("edited_fingerprint") == F.col("fingerprint")) & (F.col("edited_canon") != canonical(F.col("text")))
    rows = rows.withColumn("edited_fingerprint", F.when(clash, F.concat("edited_fingerprint", F.lit("-e"))).otherwise(F.col("edited_fingerprint")))
    same = lambda c: (F.col("fingerprint") == F.col(c)).cast("double")
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"))


def _numbered(rows: DataFrame, numbers: DataFrame, name: str, canon: Column) -> DataFrame:
    d, c, n, own = (unused(rows, x) for x in ("digest_known", "canon_known", "number_known", "canon_own"))
    known = numbers.select(F.col("digest").alias(d), F.col("canon").alias(c), F.col("number").alias(n))
    rows = rows.withColumn(own, canon).join(known, (F.col(name) == F.col(d)) & (F.col(own) == F.col(c)), "left")
    return rows.withColumn(name, F.concat_ws("-", name, n)).drop(d, c, n, own)
