"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers (in digits or words), units and names become typed placeholders, so that a question with other values has
the same template. Hashed windows of template words are joined with those of the benchmark; the values that stand
in the slots of a match then have to map consistently, each of the item's values to one of the document's.

A capitalised word inside a sentence is a name; one at the start of a sentence or line, or after a quote or
bracket, may be. Documents are looked up with all of these as names and with all as plain words, and items are
indexed with each of them both ways, so that a passage has the same template wherever it stands. A name of several
words is read both word by word and as one name (``_versions``).

Only texts that hold an anchor are read that closely: a run of up to four words of an item's window that are surely
no slots and have no digit, the longest of the window. Such words, and their neighbourhood, are the same in a marked and
in a plain text (marking joins or splits only what has a digit), and a match holds its windows' anchors, so none is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import bounded_broadcast
from .components import saved, spread, unused

WINDOW = 10
ANCHOR = 4
MIN_LITERAL = 5  # words that are no slot, in a match that counts
# Unit words that may follow a number.
UNITS = "kg g mg lb lbs oz km m cm mm mi miles mile feet foot ft inch inches yards l ml litres liters gallons s sec seconds min minutes h hours days weeks months years mph kmh percent dollars euros pounds cents degrees watts volts joules newtons".split()

# Words that are no name though a sentence starts with them.
OPENERS = "a the what who whom whose which when where why how if in on at of for to from with by as and or but is are was were does did has have had can could would should this that these those there it he she they we you i".split()

# Words that are numbers.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()

_NAME, _UNIT, _MAYBE, _SMALL, _JOIN = "\x01", "\x02", "\x03", "\x04", "\x05"
_ANY_NUMBER = rf"(?:{'|'.join(NUMBERS)})(?![\p{{L}}\p{{N}}])"

# Patterns begin with what is rare, a mark or a letter that few words begin with, and look behind only from there: a look
# behind over up to 40 letters would else be tried at every character of a text.
_NUMBER = rf"(?i)(?=[{''.join(sorted({n[0] for n in NUMBERS}))}])(?<![\p{{L}}\p{{N}}])({'|'.join(NUMBERS)})"
_CAPITAL = rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{N}}{_JOIN}])(?!(?i:{_ANY_NUMBER}))"
_INSIDE = rf"{_MAYBE}(?<=[\p{{Ll}}\p{{Nd}},;] {_MAYBE})"  # a possible name inside a sentence
_WORD = r"[\p{L}\p{N}'’-]{1,40}"
_RUN = rf" {_NAME}(?<={_NAME}{_WORD} {_NAME})"  # between two words of a name
_LONGER = rf" {_NAME}(?<=(?:{_NAME}|{_MAYBE}(?!(?i:{'|'.join(OPENERS)})(?![\p{{L}}\p{{N}}]))){_WORD} {_NAME})"


def _marked(text: Column, item: bool = False) -> Column:
    """The text with a mark in front of names, possible names and units in a number's wake; numbers are one word. In
    an item, a small word that starts a sentence is marked too: a document may write it large."""
    units = rf"(?=(?:{'|'.join(UNITS)})\b)"
    text = F.when(text.rlike(f"[{_NAME}-{_JOIN}]"), F.translate(text, "".join((_NAME, _UNIT, _MAYBE, _SMALL, _JOIN)), " " * 5)).otherwise(text)
    text = F.regexp_replace(text, rf"{_NUMBER}[\s-]+(?={_ANY_NUMBER})", "$1" + _JOIN)
    if item:
        text = F.regexp_replace(text, rf"(?:^|(?<=[.?!:\"“”«»(\[\n]\s{{0,3}}))(?=\p{{Ll}})(?!{_ANY_NUMBER})", _SMALL)
    text = F.regexp_replace(text, _CAPITAL, _MAYBE)
    text = F.regexp_replace(text, _INSIDE, _NAME)
    text = F.regexp_replace(text, rf"{_NUMBER}[\s\xA0]+{units}", "$1 " + _UNIT)
    digits = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?<=\p{Nd})[.,:/](?=\p{Nd})", ""), rf"(?i)(?<=\p{{Nd}})[\s\xA0]*{units}", " " + _UNIT)
    return _let(text, lambda t: F.when(t.rlike(r"\p{Nd}"), digits(t)).otherwise(t))


def _versions(text: Column, item: bool = False) -> Column:
    """An array of the marked, lower-case words of a text: each word of a name alone, then runs of names as one, then
    also with a word before them that starts a sentence and may be a name."""
    words = lambda t: F.array_remove(F.split(F.lower(t), rf"[^\p{{L}}\p{{N}}{_NAME}-{_JOIN}]+"), "")
    joined = lambda t: F.array_distinct(F.array(t, F.regexp_replace(t, _RUN, _JOIN), F.regexp_replace(t, _LONGER, _JOIN)))
    return F.transform(_let(_marked(text, item), joined), words)


def _first(word: Column) -> Column:
    return F.substring(word, 1, 1)


def _bare(word: Column) -> Column:
    """A word without a name's mark."""
    return F.when(_first(word).isin(_NAME, _MAYBE, _SMALL), F.substring(word, 2, 1 << 30)).otherwise(word)


def _kind(word: Column, names: tuple[str, ...] = (_NAME,)) -> Column:
    """'n', 'u' or 'd' for a name (a word with one of the marks ``names``), unit or number; null for any other word."""
    first = _first(word)
    number = first.between("0", "9") | F.substring_index(word, _JOIN, 1).isin(NUMBERS)
    return F.when(first.isin(*names), "n").when(first == _UNIT, "u").when(number, "d")


def _template_hash(word: Column, names: tuple[str, ...] = (_NAME,)) -> Column:
    return F.xxhash64(F.coalesce(F.concat(F.lit(_UNIT), _kind(word, names)), _bare(word)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _starts(n_words: Column, width: int) -> Column:
    last = n_words - width
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _windows(words: Column, widths: list[int]) -> Column:
    """Structs (h, at, width) of all windows of each width, possible names as names, and again of those that hold a
    possible name, as plain words; ``at`` counts words from 0."""

    def of(x: Column, width: int) -> list[Column]:
        window = lambda hashes: lambda i: F.struct(F.xxhash64(F.slice(hashes, i + 1, width), F.lit(width)).alias("h"), i.alias("at"), F.lit(width).alias("width"))
        maybe, last = x["maybe"], F.size(x["names"]) - width

        def first_holds(p: Column, k: Column) -> Column:  # starts of the windows whose first possible name is p
            begin, end = F.greatest(p - (width - 1), F.get(maybe, k - 1) + 1, F.lit(0)), F.least(p, last)
            return F.when(begin <= end, F.sequence(begin, end)).otherwise(F.array().cast("array<int>"))

        return [F.transform(_starts(F.size(x["names"]), width), window(x["names"])), F.transform(F.flatten(F.transform(maybe, first_holds)), window(x["plain"]))]

    at = F.filter(F.transform(words, lambda w, i: F.when(_first(w) == _MAYBE, i)), lambda i: i.isNotNull())
    read = F.struct(F.transform(words, lambda w: _template_hash(w, (_NAME, _MAYBE))).alias("names"), F.transform(words, lambda w: _template_hash(w)).alias("plain"), at.alias("maybe"))
    return _let(read, lambda x: F.concat(*(part for w in widths for part in of(x, w))))


def _item_windows(words: Column, width: int) -> Column:
    """As ``_windows`` of one width, with every choice of which possible names of a window are names."""
    both = F.transform(words, lambda w: F.when(_first(w).isin(_MAYBE, _SMALL), F.array(_template_hash(w), _template_hash(w, (_MAYBE, _SMALL)))).otherwise(F.array(_template_hash(w))))

    def of(i: Column, choices: Column) -> Column:
        none = F.array(F.array().cast("array<bigint>"))
        every = F.aggregate(F.slice(choices, i + 1, width), none, lambda done, word: F.flatten(F.transform(done, lambda d: F.transform(word, lambda h: F.concat(d, F.array(h))))))
        return F.transform(every, lambda hashes: F.struct(F.xxhash64(hashes, F.lit(width)).alias("h"), i.alias("at"), F.lit(width).alias("width")))

    return _let(both, lambda choices: F.flatten(F.transform(_starts(F.size(choices), width), lambda i: of(i, choices))))


def _anchors(tokens: Column, width: int) -> Column:
    """Structs (n, h, maybe) of all windows of an item: length and hash of the longest run of words that are surely no
    slots and have no digit, ANCHOR at most, and whether the window holds a possible name or another word that is no
    slot."""
    sure = F.transform(tokens, lambda w: _kind(w, (_NAME, _MAYBE, _SMALL)).isNull() & ~w.contains(_JOIN) & ~w.rlike(r"\p{Nd}"))

    def reach(flags: Column, i: Column, stop: Column) -> Column:  # sure words in a row from i on
        n = F.lit(0)
        for k in reversed(range(ANCHOR)):
            n = F.when(F.coalesce(F.get(flags, i + k), F.lit(False)) & (i + k < stop), n + 1).otherwise(0)
        return n

    def of(flags: Column, i: Column) -> Column:
        stop = i + width
        best = F.array_max(F.transform(F.sequence(i, stop - 1), lambda p: F.struct(reach(flags, p, stop).alias("n"), (-p).alias("p"))))
        part = F.slice(tokens, i + 1, width)
        words = [F.get(tokens, k - best["p"]) for k in range(ANCHOR)]
        h = F.coalesce(*(F.when(best["n"] == k, F.xxhash64(F.lit(k), *words[:k])) for k in range(1, ANCHOR + 1)), F.lit(0))
        return F.struct(best["n"].alias("n"), h.alias("h"), F.exists(part, lambda w: _first(w).isin(_MAYBE, _SMALL) | _kind(w).isNull()).alias("maybe"))

    return _let(sure, lambda flags: F.transform(_starts(F.size(tokens), width), lambda i: of(flags, i)))


def _anchored(texts: DataFrame, items: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """The texts (doc_id, text_hash, text) that hold an anchor of an item; all of them if an item has none.

    Windows of slots alone count for nothing here: a match of such windows alone is no leak, unless it is a whole item.
    Where a window without an anchor is a whole item, or holds a word that may be no slot, every text is looked at.
    """
    rows = None
    for size in sizes:
        part = items.filter(F.least(F.size("item_tokens"), F.lit(window)) == size).select("item_tokens", F.explode(_anchors(F.col("item_tokens"), size)).alias("x"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return texts.limit(0)
    rows = saved(rows.select((F.size("item_tokens") <= window).alias("whole"), "x.*"), "anchors")
    if rows.filter("n = 0 AND (whole OR maybe)").take(1):
        return texts
    lengths = [r.n for r in rows.filter("n > 0").select("n").distinct().collect()]  # ANCHOR at most
    plain = F.when(F.octet_length("text") == F.char_length("text"), F.split(F.lower("text"), "[^a-z0-9]+")).otherwise(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    shifted = lambda w: F.arrays_zip(w.alias("w0"), *(F.slice(w, k + 1, F.size(w)).alias(f"w{k}") for k in range(1, max(lengths))))
    words = texts.select("doc_id", "text_hash", F.explode(_let(plain, shifted)).alias("x")).select("doc_id", "text_hash", *(F.col("x").getField(f"w{k}").alias(f"w{k}") for k in range(max(lengths))))
    grams = F.array(*(F.xxhash64(F.lit(n), *(F.col(f"w{k}") for k in range(n))) for n in lengths))
    seen = words.select("doc_id", "text_hash", F.explode(grams).alias("h"))
    keys = saved(seen.join(bounded_broadcast(rows.filter("n > 0").select("h").distinct()), "h", "left_semi").select("doc_id", "text_hash").distinct(), "anchored")
    known = bounded_broadcast(keys.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")))
    return texts.join(known, texts["doc_id"].eqNullSafe(F.col("_doc")) & (texts["text_hash"] == F.col("_hash")), "left_semi")


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The best match of each document and benchmark item that counts as a leak; documents without one have no row.

    Columns: doc_id, item_id, kind (``verbatim``: all slots hold the item's own values; ``reparameterised``:
    each value of the item maps to one of the document's), doc_start, item_start (words), n_words (matched),
    item_words, coverage. A match whose slots are inconsistent counts only with ``window`` words outside slots
    or more (kind ``mixed``), and so does one where a word that starts an item's sentence and cannot be a name is
    another one in the document. Items with fewer words than a window match as a whole; items without words, null
    texts and empty tables match nothing. Null and repeated ids stay as they are; rows of one id are one document.
    Words are counted as the match reads them: a name of several words, or a number, may be one. Other columns are
    ignored.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    items = saved(items.select("item_id", F.explode(_versions(F.col("text"), item=True)).alias("item_tokens")).filter("size(item_tokens) > 0").distinct(), "items")
    sizes = [r[0] for r in items.select(F.least(F.size("item_tokens"), F.lit(window)).alias("w")).distinct().orderBy("w").collect()]  # WINDOW at most
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    texts = spread(texts).withColumn("text_hash", F.xxhash64("text"))
    wanted = None
    for size in sizes or [window]:
        part = items.filter(F.least(F.size("item_tokens"), F.lit(window)) == size).select("item_id", "item_tokens", F.explode(_item_windows(F.col("item_tokens"), size)).alias("x"))
        wanted = part if wanted is None else wanted.unionByName(part)
    wanted = wanted.select(F.col("x.h").alias("h"), "item_id", F.xxhash64("item_tokens").alias("item_hash"), F.col("x.at").alias("item_at"), F.col("x.width").alias("width"))

    read = _anchored(texts, items, sizes, window).select("doc_id", F.explode(_versions(F.col("text"))).alias("doc_tokens"))
    read = saved(read.withColumn("doc_hash", F.xxhash64("doc_tokens")), "read")
    seen = read.select("doc_id", "doc_hash", F.explode(_windows(F.col("doc_tokens"), sizes or [window])).alias("x")).select("doc_id", "doc_hash", F.col("x.h").alias("h"), F.col("x.at").alias("at"))
    hits = seen.join(bounded_broadcast(wanted), "h")
    # One row for each document, item and alignment: the words from the first matched window to the end of the last.
    runs = hits.groupBy("doc_id", "doc_hash", "item_id", "item_hash", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.min("item_at").alias("begin"), F.max(F.col("item_at") + F.col("width")).alias("end"))
    runs = saved(runs, "runs")

    keys = runs.select(F.col("doc_id").alias("_doc"), F.col("doc_hash").alias("_hash")).distinct()
    matched = read.join(bounded_broadcast(keys), read["doc_id"].eqNullSafe(F.col("_doc")) & (read["doc_hash"] == F.col("_hash")), "left_semi")
    matched = matched.dropDuplicates(["doc_id", "doc_hash"]).select(F.col("doc_id").alias("_doc"), F.col("doc_hash").alias("_hash"), "doc_tokens")
    known = items.select(F.col("item_id").alias("_item"), F.xxhash64("item_tokens").alias("_item_hash"), "item_tokens")
    both = runs.join(matched, runs["doc_id"].eqNullSafe(F.col("_doc")) & (F.col("doc_hash") == F.col("_hash"))).join(known, runs["item_id"].eqNullSafe(F.col("_item")) & (F.col("item_hash") == F.col("_item_hash")))

    n_words = F.col("end") - F.col("begin")
    pairs = F.arrays_zip(F.slice("item_tokens", F.col("begin") + 1, n_words).alias("i"), F.slice("doc_tokens", F.col("begin") + F.col("shift") + 1, n_words).alias("d"))
    bare = F.transform(pairs, lambda p: F.struct(_bare(p["i"]).alias("i"), _bare(p["d"]).alias("d"), _first(p["i"]).alias("mark"), _kind(p["i"]).alias("kind"), _kind(p["d"], (_NAME, _MAYBE)).alias("doc_kind")))
    both = both.withColumn("pairs", bare)
    other = lambda p: p["doc_kind"].eqNullSafe("n") & (p["i"] != p["d"])
    slot = lambda p: (p["kind"].isNotNull() & p["kind"].eqNullSafe(p["doc_kind"])) | ((p["mark"] == _MAYBE) & other(p))
    both = both.withColumn("slots", F.array_distinct(F.transform(F.filter("pairs", slot), lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d")))))
    literal = F.size(F.filter("pairs", lambda p: p["kind"].isNull() & (p["i"] == p["d"])))
    both = both.withColumn("literal", literal).withColumn("same", F.forall("slots", lambda p: p["i"] == p["d"]))
    # Read as a name to be found, but surely none, and the document has another word there.
    both = both.withColumn("other_word", F.exists("pairs", lambda p: ((p["mark"] == _SMALL) | ((p["mark"] == _MAYBE) & p["i"].isin(OPENERS))) & other(p)))
    both = both.withColumn("consistent", F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda p: p["i"]))))
    whole = (F.col("begin") == 0) & (F.col("end") == F.size("item_tokens"))
    kind = F.when(F.col("same"), "verbatim").when(F.col("consistent"), "reparameterised").otherwise("mixed")
    leak = F.when((kind == "mixed") | F.col("other_word"), F.col("literal") >= window).otherwise((F.col("literal") >= MIN_LITERAL) | whole)
    found = both.withColumn("kind", kind).filter(leak).select(
        "doc_id", "doc_hash", "item_id", "kind", (F.col("begin") + F.col("shift")).alias("doc_start"), F.col("begin").alias("item_start"),
        n_words.alias("n_words"), F.size("item_tokens").alias("item_words"), F.least(F.lit(1.0), n_words / F.size("item_tokens")).alias("coverage"),
    )
    best = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("kind", "doc_start", "item_start", "n_words", "item_words", "coverage"), F.struct("coverage", "n_words", -F.col("doc_start"), -F.col("item_start"), "doc_hash")).alias("b"))
    return best.select("doc_id", "item_id", "b.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a leak (rows of one id go together; rows without an id stay)."""
    leak = unused(docs, "leak")
    leaks = saved(benchmark_matches(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(leak)).distinct(), "leaks")
    return docs.join(bounded_broadcast(leaks), docs[id_col] == F.col(leak), "left_anti")
