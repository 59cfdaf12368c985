"""N-gram Jaccard join with adaptive multi-match prefixes.

1. A count-min sketch of shingles gives one lossless test: a text whose estimated repeated shingles are too
   few to reach the threshold has no partner. All later work is on the texts that are left.
2. Equal sets become one representative. Exact document frequencies order each set's tokens, rarest first.
3. A document needs a prefix of ``size - least overlap + l`` tokens to share ``l`` of them with any partner.
   Each document picks the ``l`` of least estimated cost: list entries to scan plus candidates to verify,
   which are at most (entries / l).
4. Documents that share prefix tokens are brought together (stars over the tokens' lists, then components);
   a group is joined in one task: candidates must share as many prefix tokens as both documents' ``l`` ask,
   and are verified on whole sets unless already connected. A larger group is dealt as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import bounded_broadcast
from . import sketch
from .components import connected_components, saved, small_batches, unused
from .words import lower_ascii, mix, span_hashes, spans, text_chunks, tidy, tidy_group, window_hashes

MAX_MATCH = 6
VERIFY_COST = 8.0  # of one candidate, in list entries
BLOCK_TOKENS = 1 << 20  # tokens of one block of a group at most; a task holds two blocks
SHARE_TOKENS, SHARE_BLOCKS = 1 << 14, 16  # a group above so many tokens is shared out to several blocks, up to 16
LAST = np.iinfo(np.int64).max


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct shingle hashes sorted by row, cut points by row) for runs of texts.

    A text with fewer words than ``width`` has its whole sequence as one shingle, and none without words.
    """
    for row, end, data, offsets in text_chunks(column):
        data = lower_ascii(data)
        starts, ends, first = spans(data, offsets)
        words = span_hashes(data, starts, ends)
        h, document, _ = window_hashes(words, first, width)
        for n in range(1, width):
            short = np.flatnonzero(np.diff(first) == n)
            if len(short):
                total = np.zeros(len(short), np.uint64)
                for k in range(n):
                    total = mix(total + words[first[short] + k] + np.uint64(n))
                h, document = np.concatenate([h, total]), np.concatenate([document, short])
        order = np.lexsort((h, document))
        h, document = h[order], document[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (document[1:] != document[:-1])
        h, document = h[new], document[new]
        yield row, end, h, np.searchsorted(document, np.arange(end - row + 1))


def _least_overlap(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least intersection of a set of ``size`` with any partner: ceil(size * num / den)."""
    return -(-size * num // den)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, threshold: tuple[int, int] = (85, 100), block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row a row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest linked id.

    Texts are linked when ``den * intersection >= num * union`` for ``threshold`` (num, den); all such links
    count, through any number of documents. Null or wordless text: an empty set, linked with nothing, its own
    id as component. Null id: counts as larger than all others, and stays null where it is the smallest of its
    component. Repeated rows each get a row. Other columns are ignored; an empty table gives no rows.
    """
    spark, (num, den) = docs.sparkSession, threshold
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    layout = sketch.Layout.of(sketch.text_bytes(docs, "text"))
    parts = sketch.dealt(docs, layout)

    def hashes(rows: pa.Table) -> Iterator[np.ndarray]:
        for _, _, h, _ in shingle_sets(rows["text"].combine_chunks(), width):
            yield h

    def sets(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left):
            rows = sketch.opened(left)
            found = list(shingle_sets(rows["text"].combine_chunks(), width))
            repeats = sketch.repeated(np.concatenate([h for _, _, h, _ in found]), right, layout)
            at = 0
            for row, end, h, cuts in found:
                size, again = np.diff(cuts), repeats[at : at + len(h)]
                at += len(h)
                kept = np.concatenate([[0], np.cumsum(again)])[cuts]
                may = (np.diff(kept) >= _least_overlap(size, num, den)) & (size > 0)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])[cuts]
                other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0x5BD1E995)), dtype=np.uint64)])[cuts]
                lists = pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), pa.array(h[again].view(np.int64)))
                lists = pc.if_else(pa.array(~may), pa.scalar(None, lists.type), lists)
                ids = rows["doc_id"].slice(row, end - row).combine_chunks()
                out.append(pa.RecordBatch.from_arrays([ids, pa.array(size.astype(np.int64)), pa.array(np.diff(sums).view(np.int64)), pa.array(np.diff(other).view(np.int64)), lists], ["doc_id", "n", "a", "b", "tokens"]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.Table.from_batches(out, pa.schema(list(zip(["doc_id", "n", "a", "b", "tokens"], kinds, strict=True))))

    replies = sketch.answers(parts, hashes, layout)
    every = saved(parts.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(tidy_group(sets), "doc_id long, n long, a long, b long, tokens array<long>"), "sets")
    key = F.coalesce("doc_id", F.lit(LAST))
    # Equal sets: one representative, found by 128 bits of digest and the size; map-side minima keep large classes small.
    classes = every.filter("tokens IS NOT NULL").groupBy("n", "a", "b").agg(F.min(key).alias("rep"))
    # Different texts under one id (or under null) need nodes of their own.
    taken = classes.groupBy("rep").agg(F.count("*").alias("times")).filter("times > 1")
    own = F.lit(-1) - F.xxhash64("n", "a", "b").bitwiseAND((1 << 62) - 1)
    classes = saved(classes.join(taken, "rep", "left").select("n", "a", "b", "rep", F.when(F.col("times").isNull(), F.col("rep")).otherwise(own).alias("node")), "classes")
    reps = every.join(classes, ["n", "a", "b"]).filter((key == F.col("rep")) & F.col("tokens").isNotNull()).select(F.col("node").alias("id"), "n", "tokens").dropDuplicates(["id"])
    reps = saved(_shared_only(reps, num, den), "shared")
    prefixes = reps.select("id", F.explode(F.expr("slice(tokens, 1, prefix)")).alias("token"))
    lists = prefixes.groupBy("token").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    stars = prefixes.join(lists, "token").filter("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    groups = connected_components(stars)
    members = saved(reps.join(groups, "id"), "members")
    weights = members.groupBy("component").agg(F.sum(F.size("tokens")).alias("weight"))
    # A group is dealt to blocks by hash of id, and each pair of blocks is a task's; a small group is one block.
    blocks = F.greatest(F.ceil(F.col("weight") / block_tokens), F.least(F.ceil(F.col("weight") / SHARE_TOKENS), F.lit(SHARE_BLOCKS)))
    members = members.join(weights, "component").withColumn("blocks", blocks.cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = members.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "n", "tokens", "prefix", "matches", "levels"
    )

    tasks = max(16, layout.partitions)
    links = dealt.repartition(tasks, "component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(tidy(lambda batches: _linked(batches, num, den)), "a long, b long")
    joined = classes.join(connected_components(links).withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = joined.groupBy("component").agg(F.min("rep").alias("smallest"))
    out = every.join(joined.join(smallest, "component").select("n", "a", "b", "smallest"), ["n", "a", "b"], "left")
    component = F.when(F.col("tokens").isNull(), F.col("doc_id")).otherwise(F.coalesce("smallest", key))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(component == LAST, F.lit(None)).otherwise(component).alias("component_id"))


def _shared_only(reps: DataFrame, num: int, den: int) -> DataFrame:
    """Sets cut to tokens that another set also has, rarest first, without the sets that can have no partner.

    ``prefix``: entries of the list in the document's prefix; tokens of no other set come before the list.
    ``matches``: the document's l. ``levels``: entries before the last one of the prefix for l = 1; each entry
    after that one needs a larger l.
    """
    rows = reps.select("id", "n", F.explode("tokens").alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    again = rows.join(counts, "token").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    least = F.expr(f"cast(ceil(n * {num} / {den}) as int)")
    again = again.withColumn("m", F.size("t")).withColumn("least", least).filter("m >= least")
    # cost of l: entries scanned + VERIFY_COST * entries / l
    options = ", ".join(
        f"struct(aggregate(slice(t, 1, least(m, m - least + {k})), 0L, (s, x) -> s + x.df - 1) * (1 + {VERIFY_COST} / {k}) as cost, {k} as k)" for k in range(1, MAX_MATCH + 1)
    )
    again = again.withColumn("matches", F.expr(f"array_min(filter(array({options}), x -> x.k <= least)).k"))
    return again.select("id", "n", F.expr("transform(t, x -> x.token)").alias("tokens"), F.expr("m - least + matches").alias("prefix"), "matches", F.expr("m - least").alias("levels"))


def _linked(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Links (a spanning forest of them) of each group or pair of blocks; rows come group by group."""
    at, held, out = None, [], []

    def emit(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*pairs, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for x in batch.to_pylist():
            group = (x["component"], x["i"], x["j"])
            if group != at:
                out += _join_group(held, num, den)
                at, held = group, []
                if len(out) > 10_000:
                    yield emit(out)
                    out = []
            held.append(x)
    out += _join_group(held, num, den)
    if out:
        yield emit(out)


def _join_group(rows: list[dict], num: int, den: int) -> list[tuple[int, int]]:
    if len(rows) < 2:
        return []
    cross = rows[0]["i"] != rows[0]["j"]
    rows.sort(key=lambda x: (x["n"], x["id"]))
    size = np.array([x["n"] for x in rows])
    lengths = np.array([len(x["tokens"]) for x in rows])
    values, token = np.unique(np.concatenate([np.array(x["tokens"], np.int64) for x in rows]), return_inverse=True)
    edges = np.concatenate([[0], np.cumsum(lengths)])
    prefix = np.array([min(x["prefix"], k) for x, k in zip(rows, lengths, strict=True)])
    matches = np.array([x["matches"] for x in rows])
    one = np.array([x["levels"] for x in rows]) + 1  # entries in the prefix for one match
    block = np.array([x["block"] for x in rows])
    in_prefix = np.concatenate([np.arange(k) < p for k, p in zip(lengths, prefix, strict=True)])
    owner = np.repeat(np.arange(len(rows)), lengths)
    level = np.concatenate([np.maximum(np.arange(k) - o + 2, 1) for k, o in zip(lengths, one, strict=True)])
    # posting lists of prefix tokens, by document order
    order = np.flatnonzero(in_prefix)
    order = order[np.argsort(token[order], kind="stable")]
    lists_at = np.searchsorted(token[order], np.arange(len(values) + 1))
    docs_of, level_of = owner[order], level[order]

    links = []
    label = np.arange(len(rows))  # the component of each document
    mine = np.zeros(len(values), bool)
    for i in range(1, len(rows)):
        shortest = -(-size[i] * num // den)
        parts, levels = [], []
        for k in range(edges[i], edges[i] + prefix[i]):
            a, b = lists_at[token[k]], lists_at[token[k] + 1]
            b = a + np.searchsorted(docs_of[a:b], i)
            if a < b:
                parts.append(docs_of[a:b])
                levels.append(np.maximum(level_of[a:b], level[k]))
        if not parts:
            continue
        other, at = np.concatenate(parts), np.concatenate(levels)
        need = np.minimum(matches[other], matches[i])
        other = other[at <= need]
        count = np.bincount(other, minlength=i)[:i]
        pair = np.flatnonzero(count)
        pair = pair[(count[pair] >= np.minimum(matches[pair], matches[i])) & (size[pair] >= shortest)]
        if cross:
            pair = pair[block[pair] != block[i]]
        mine[token[edges[i] : edges[i + 1]]] = True
        pair = pair[np.lexsort((-count[pair], label[pair]))]
        quota = 1
        while len(pair := pair[label[pair] != label[i]]):
            # a link settles a whole component, so each is tried with its likeliest documents first, then more
            start = np.concatenate([[True], label[pair][1:] != label[pair][:-1]])
            rank = np.arange(len(pair)) - np.flatnonzero(start)[np.cumsum(start) - 1]
            tried, pair = pair[rank < quota], pair[rank >= quota]
            quota *= 4
            taken = [token[edges[j] : edges[j + 1]] for j in tried]
            cut = np.concatenate([[0], np.cumsum([len(x) for x in taken])[:-1]])
            both = np.add.reduceat(mine[np.concatenate(taken)].astype(np.int64), cut)
            ok = den * both >= num * (size[i] + size[tried] - both)
            for j in tried[ok]:
                if label[j] != label[i]:
                    links.append((rows[i]["id"], rows[j]["id"]))
                    label[label == label[j]] = label[i]
            # relabelling may put one component's documents apart: keep them together
            pair = pair[np.argsort(label[pair], kind="stable")]
        mine[token[edges[i] : edges[i + 1]]] = False
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """``docs`` with one document, the smallest id, of each group of near copies (five words, 0.8).

    Rows that share an id stay or go together, but of rows equal in id and text one stays. Rows without an id stay.
    """
    groups = jaccard_join(docs, id_col, text_col, width, threshold)
    name = unused(docs, "gone")
    gone = saved(groups.filter("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    kept = docs.join(bounded_broadcast(gone), docs[id_col] == F.col(name), "left_anti")
    repeated = docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").take(1)
    if not repeated:
        return kept
    return kept.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col]).unionByName(kept.filter(F.col(id_col).isNull()))
