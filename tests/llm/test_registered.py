"""The registered queries and the pipeline's stages, on the given tables, against brute force or held-out labels."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import DATA
from test_operators import brute_common, brute_components, brute_substrings, brute_totals, canon, split

import corpus_pipeline
from tallyveil.llm import language, licenses, packing, tokens
from tallyveil.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.01"


def run(spark, name, data=DATA):
    return QUERIES[name](spark, data).collect()


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


@pytest.fixture(scope="module")
def table(spark):
    return rows_of(spark.read.parquet(f"{DATA}/documents.parquet"))


def rest(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_of_held_out_documents(spark):
    known = {r.doc_id: r for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    out = run(spark, "op1_language", LARGER)
    assert sorted(x.doc_id for x in out) == sorted(known) and all(x.held_out == (rest(x.doc_id, 4) == 2) and 0 <= x.score <= 1 for x in out)
    right = []
    for x in out:
        text, lang = known[x.doc_id].text, known[x.doc_id].lang
        if not any(c.isalpha() for c in text or ""):
            assert x.lang_pred == "und"
        elif x.held_out and lang is not None:
            right.append(x.lang_pred == lang)
    assert len(right) > 100 and np.mean(right) > 0.97


def test_quality_of_held_out_documents(spark):
    ids = [r.doc_id for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id").collect()]
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    out = run(spark, "op3_quality", LARGER)
    assert sorted(x.doc_id for x in out) == sorted(ids)
    assert all(x.held_out == (rest(x.doc_id, 5) == 0) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in out)
    right = [x.predicted == marks[x.doc_id] for x in out if x.held_out and marks.get(x.doc_id) is not None]
    assert len(right) > 20 and np.mean(right) > 0.95


def assert_packed(out, texts, length=4096):
    """Each document's ids in pieces, and pieces gapless in sequences that hold ``length`` at most."""
    tokenizer = tokens.WordTokens(tokens.vocabulary_path()).tokenizer
    whole = tokenizer.encode_batch([t or "" for _, t in texts], add_special_tokens=False)
    want = []
    for (i, _), coded in zip(texts, whole, strict=True):
        ids = [*coded.ids, 1]
        want += [(i, k // length, k, len(ids[k : k + length]), zlib.crc32(np.array(ids[k : k + length], "<u4").tobytes())) for k in range(0, len(ids), length)]
    assert sorted((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in out) == sorted(want)
    bins = defaultdict(list)
    for x in out:
        bins[x.sequence_id].append((x.offset, x.length))
    for placed in bins.values():
        ends = np.cumsum([n for _, n in sorted(placed)])
        assert [o for o, _ in sorted(placed)] == [0, *ends[:-1]] and ends[-1] <= length
    bound = packing.lower_bound(np.array([w[3] for w in want]), length)
    assert bound <= len(bins) <= bound * 1.02 + 1


def test_packing(spark, table):
    assert_packed(run(spark, "op4_packing"), [(r[0], r[1]) for r in table])


def test_fingerprints(spark, table):
    order = sorted(((i, t or "") for i, t, *_ in table), reverse=True)
    out = {x.doc_id: x for x in run(spark, "op5_fingerprint")}
    assert len(out) == len(order)
    by_form, by_print = defaultdict(set), defaultdict(set)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited, x = t[: len(t) - len(t) // 3] + after[: len(t) // 3], out[i]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert x.near_edited == (canon(t) == canon(edited)) and x.near_next == (canon(t) == canon(after))
        for text, found in ((t, x.fingerprint), (edited, x.edited_fingerprint)):
            by_form[canon(text)].add(found)
            by_print[found].add(canon(text))
    assert all(len(v) == 1 for v in [*by_form.values(), *by_print.values()])


def test_chat(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    said = r"\### Assistant: </turn> ok"
    turns[-7] = [(0, "user", said), (1, "assistant", said)]
    out = {x.conv_id: x for x in run(spark, "op6_chat")}
    assert set(out) == set(turns)
    for c, rows in turns.items():
        rows.sort()
        target, x = "".join(t for _, role, t in rows if role == "assistant"), out[c]
        assert x.n_turns == len(rows) and x.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in rows).encode()).hexdigest()
        assert x.loss_chars == len(target) and x.loss_sha256 == hashlib.sha256(target.encode()).hexdigest()
        assert x.formatted_chars > sum(len(t) for *_, t in rows)


def grams(text, n):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def assert_decontaminated(found, texts, items):
    """Documents with ten words of an item in a row are found; those without four are not."""
    for i, t in texts:
        if any(grams(t, 10) & grams(text, 10) for text in items):
            assert i in found
        elif not any(grams(t, 4) & grams(text, 4) for text in items):
            assert i not in found


def test_decontamination(spark, table):
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    out = run(spark, "op7_decontamination")
    assert out and all(0 < x.coverage <= 1 for x in out)
    assert_decontaminated({x.doc_id for x in out}, [(r[0], r[1]) for r in table], items)


def test_token_counts(spark, table):
    cache, first = tokens.WordTokens(tokens.vocabulary_path()), {}
    for i, t, *_ in table:
        first[t] = min(first.get(t, i), i)
    live = {}
    for i, t, lang, source, _ in table:
        if first[t] == i:
            live[(i, "words")] = (source, lang, sum(any(c.isalnum() for c in w) for w in split(t)))
            live[(i, "word_bpe_49k")] = (source, lang, len(cache.tokenizer.encode(t or "", add_special_tokens=False).ids))
    got = {(x.source, x.lang, x.version): (x.n_docs, x.n_tokens) for x in run(spark, "op9_token_counts")}
    assert got == brute_totals(live)


def test_licenses(spark, table):
    """Every notice that stands whole in a text is found, and every row's count is that of the longest common words."""
    templates = {name: licenses.template_words(t) for name, t in licenses.TEMPLATES.items()}
    out, texts = run(spark, "op10_licenses"), {r[0]: r[1] or "" for r in table}
    found = defaultdict(list)
    for x in out:
        found[x.doc_id].append(x.license)
        assert texts[x.doc_id][x.start_char : x.end_char] == x.matched
        words = templates[x.license]
        assert brute_common(words, licenses.template_words(x.matched)) == x.n_matched and x.coverage == pytest.approx(x.n_matched / len(words)) and x.coverage >= 0.8
    assert found
    for i, t in texts.items():
        text = f" {' '.join(map(str, licenses.template_words(t)))} "
        whole = {name for name, w in templates.items() if f" {' '.join(map(str, w))} " in text}
        longest = {a for a in whole if not any(a != b and f" {' '.join(map(str, templates[a]))} " in f" {' '.join(map(str, templates[b]))} " for b in whole)}
        assert longest <= set(found[i])


def test_stages_against_brute_force(spark, table):
    """Each stage on all that the one before kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def step(name):
        return spark.createDataFrame(stages[name](spark, docs, DATA).collect(), docs.schema)

    model = language.fit(docs)
    rejected = {x.doc_id for x in language.identify(docs, model).collect() if x.rejected}
    docs = step("language_id")
    kept = rows_of(docs)
    assert sorted(kept) == sorted(r for r in table if r[0] not in rejected) and len(rejected) < 0.2 * len(table)

    gone = {i for i, _, c in brute_components(kept, 5, 80, 100) if i != c}
    docs = step("near_duplicates")
    assert sorted(rows_of(docs)) == sorted(r for r in kept if r[0] not in gone)

    kept = rows_of(docs)
    want = [(r[0], k if g else r[1], r[2], r[3], len(k) if g else r[4]) for r, (_, n, g, k) in zip(kept, brute_substrings(kept), strict=True) if not g or g < n]
    docs = step("substring_dedup")
    assert sorted(map(str, rows_of(docs))) == sorted(map(str, want))

    texts, items = [(r[0], r[1]) for r in rows_of(docs)], [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    docs = step("decontamination")
    left = rows_of(docs)
    assert_decontaminated({i for i, _ in texts} - {r[0] for r in left}, texts, items)
    assert_packed(stages["packing"](spark, docs, DATA).collect(), [(r[0], r[1]) for r in left])


def test_stages_with_odd_tables(spark):
    """Nulls in any column, empty and repeated rows, an empty table, and a column that clashes with the operators' own."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None,) * 5, (None, "", None, None, 0), (10**9, None, None, None, None), (10**9, "", "en", "s", 0), (10**9 + 1, "— 123", "en", "s", 5)], docs.schema)
    odd = docs.unionByName(odd).unionByName(docs.limit(3)).unionByName(odd)
    for name in ("h", "part", "gone", "leak", "digest"):
        odd = odd.withColumn(name, odd.text)
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, odd, DATA), stage(spark, odd.limit(0), DATA)
        assert none.count() == 0
        if name != "packing":
            assert out.dtypes == odd.dtypes and 0 < out.count() <= odd.count()
        else:
            assert out.filter("doc_id IS NULL").count() == odd.filter("doc_id IS NULL").count()
