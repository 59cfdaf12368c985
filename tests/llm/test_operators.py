"""The ten operators against brute force on small fixtures, with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyveil.llm import chat, components, decontamination, fingerprint, jaccard, language, licenses, packing, quality, queries, sampling, sketch, substring_dedup, token_counts, tokens, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus(seed=3, n=60):
    """Copies, near copies, shared passages, junk, edge texts, a repeated row, a repeated id, null ids and texts."""
    r = random.Random(seed)
    texts = [sentence(r, r.randint(30, 120)) for _ in range(n)]
    passage = sentence(r, 60)
    for i in range(0, n, 5):
        texts[i] += "\n" + passage + " " + sentence(r, 10)
    texts += [texts[3], texts[3] + " ", texts[4].upper()]
    for _ in range(25):  # a chain of near copies
        w = texts[7].split()
        w[r.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += ["", " \t\n", "one", "one two three", "One  two\tthree", None, None, "é" * 50, "a b " * 200, sentence(r, 9000), passage]
    ids = list(range(100, 100 + len(texts)))
    r.shuffle(ids)
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["s1", None]), None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    rows += [rows[0], (rows[1][0], sentence(r, 40), "en", "s1", 5), (None, texts[2], None, None, None), (None, sentence(r, 30), "fr", "s2", 1)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = ["h", "part", "kind", "tokens", "component", "n"]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in clash:
        df = df.withColumn(c, F.lit("extra"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LAST = 2**63 - 1


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# words and sketches


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["a bb  ccc", None, "", "x", "\n a bb\x0bccc é z", "ccc"]
    found = []
    for limit in (1, 7, 1000):
        got = []
        for row, _, data, offsets in words.text_chunks(pa.array(["skip", *texts])[1:], limit):
            starts, ends, first = words.spans(data, offsets)
            hashes = words.span_hashes(data, starts, ends)
            for i in range(len(first) - 1):
                part = range(first[i], first[i + 1])
                got.append(([bytes(data[starts[k] : ends[k]]).decode() for k in part], [int(hashes[k]) for k in part]))
                assert row + i == len(got) - 1
        assert [g[0] for g in got] == [split(t) for t in texts]
        found.append(got)
    assert found[0] == found[1] == found[2]
    by_word = {}
    for ws, hs in found[0]:
        for w, h in zip(ws, hs, strict=True):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert list(words.unpressed(words.pressed(np.array([1, 2**40], np.int64)), 2, np.int64)) == [1, 2**40]


def sketch_flags(spark, values, n_rows=6000):
    """(layout, flag by value) of the sketch of ``values``, ten to a row; the text of a row is its values."""
    texts = [" ".join(map(str, values[i : i + 10])) for i in range(0, len(values), 10)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    layout = sketch.Layout.of(sketch.text_bytes(df, "text"), 20)
    numbers = lambda rows: np.array([int(x) for t in rows["text"].to_pylist() for x in t.split()], np.uint64)
    parts = sketch.dealt(df, layout)
    replies = sketch.answers(parts, lambda rows: iter([numbers(rows)]), layout)

    def flagged(left, right):
        import pyarrow as pa

        found = numbers(sketch.opened(left))
        return pa.table({"v": pa.array(found.view(np.int64)), "yes": pa.array(sketch.repeated(found, right, layout))})

    out = parts.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(flagged, "v long, yes boolean").toPandas()
    return layout, dict(zip(out["v"].to_numpy().view(np.uint64).tolist(), out["yes"].tolist(), strict=True))


def distinct_values(n=40_000):
    r = np.random.default_rng(1)
    values = r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
    values[n // 2 : n // 2 + n // 8] = values[: n // 8]
    return values.tolist()


def test_sketch_loses_no_repeat(spark):
    values = distinct_values()
    counts = Counter(values)
    _, flags = sketch_flags(spark, values)
    assert all(flags[v] for v in counts if counts[v] > 1)
    assert np.mean([flags[v] for v in counts if counts[v] == 1]) < 0.1


def test_sketch_filters_alike_at_every_size(spark, monkeypatch):
    """The same hashes, in one block and cut to many small ones, as a table a thousand times larger has: the share of
    wrong answers does not grow."""
    values = distinct_values()
    counts = Counter(values)
    for block, part in ((1 << 22, 6 << 20), (1000, 6 << 20), (200, 30_000)):
        monkeypatch.setattr(sketch, "BLOCK_HASHES", block)
        monkeypatch.setattr(sketch, "PART_BYTES", part)
        layout, flags = sketch_flags(spark, values)
        assert all(flags[v] for v in counts if counts[v] > 1)
        assert np.mean([flags[v] for v in counts if counts[v] == 1]) < 0.1
    assert layout.block_bits >= 5 and layout.parts > 20
    big = sketch.Layout.of(100 << 40)
    assert sketch.Layout.of(30 << 30).block_bits >= 10 and big.partitions <= sketch.MAX_PARTITIONS and big.parts * (1 << big.block_bits) < 100 << 40


# 2 substring dedup


def brute_substrings(rows, window=13):
    first = {}
    keyed = [(LAST if i is None else i, split(t)) for i, t, *_ in rows]
    for i, w in keyed:
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            first[s] = min(first.get(s, LAST), i)
    out = []
    for (i, w), row in zip(keyed, rows, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((row[0], len(w), len(gone), kept))
    return out


def test_substring_dedup(docs, rows, empty):
    got = [tuple(r) for r in substring_dedup.substring_dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_substrings(rows), key=str)
    assert substring_dedup.substring_dedup(empty).count() == 0
    carried = substring_dedup.substring_dedup(docs, carry=("part", "source")).select("doc_id", "source", "part")
    assert Counter(map(tuple, carried.collect())) == Counter((r[0], r[3], "extra") for r in rows)


def test_substring_dedup_is_the_same_when_the_sketch_is_full(docs, rows, monkeypatch):
    monkeypatch.setattr(sketch, "CODE_BITS", 2)
    monkeypatch.setattr(sketch, "PART_BYTES", 10_000)
    got = [tuple(r) for r in substring_dedup.substring_dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_substrings(rows), key=str)


def test_without_repeats_keeps_columns(docs, rows):
    out = substring_dedup.without_repeats(docs)
    assert out.dtypes == docs.dtypes
    want = [(i, t if not g else k, len(k) if g else row[4]) for row, (i, n, g, k) in zip(rows, brute_substrings(rows), strict=True) for t in [row[1]] if not g or g < n]
    assert sorted(map(tuple, out.select("doc_id", "text", "n_chars").collect()), key=str) == sorted(want, key=str)


# 8 Jaccard join


def brute_components(rows, width, num, den):
    sets = []
    for _, t, *_ in rows:
        w = split((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(set() if not w else {tuple(w)} if len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)})
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    smallest = defaultdict(lambda: LAST)
    for i, (d, *_) in enumerate(rows):
        smallest[root(i)] = min(smallest[root(i)], LAST if d is None else d)
    return [(rows[i][0], len(sets[i]), None if smallest[root(i)] == LAST else smallest[root(i)]) for i in range(len(rows))]


@pytest.mark.parametrize("width,threshold,block", [(4, (85, 100), 1 << 20), (5, (80, 100), 500), (2, (50, 100), 2000)])
def test_jaccard_join(docs, rows, width, threshold, block):
    got = [tuple(r) for r in jaccard.jaccard_join(docs, width=width, threshold=threshold, block_tokens=block).collect()]
    assert sorted(got, key=str) == sorted(brute_components(rows, width, *threshold), key=str)


def test_near_duplicates(docs, rows, empty):
    kept = jaccard.near_duplicates(docs)
    gone = {i for i, _, c in brute_components(rows, 5, 80, 100) if i is not None and i != c}
    want = {(i, t) for i, t, *_ in rows if i is not None and i not in gone}
    got = [tuple(r) for r in kept.filter("doc_id IS NOT NULL").select("doc_id", "text").collect()]
    assert len(got) == len(want) and set(got) == want
    assert kept.dtypes == docs.dtypes and kept.filter("doc_id IS NULL").count() == 2
    assert jaccard.near_duplicates(empty).count() == 0 and jaccard.jaccard_join(empty).count() == 0


@pytest.mark.parametrize("hub", [components.HUB, 8])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB", hub)
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(30)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {x.id: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}


# 4 packing


def test_tokens_are_those_of_the_tokenizer():
    cache = tokens.WordTokens(tokens.vocabulary_path())
    r = random.Random(1)
    pool = [*"abcXYZ019'’s't're<|>.,;-_()²½ßÀÖ×÷éÉİıŉǅΣςσ中文̸́  \x1c\x85​\t\n ﬁ   ", "<|endoftext|>", "'ll"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(4000)] + ["", "x" * 5000]
    for text, whole in zip(texts, cache.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(cache.encode(text), "<u4").tolist() == whole.ids
    assert cache.encode(None) == b""


def test_tokens_of_capitals_are_those_of_the_tokenizer():
    cache = tokens.WordTokens(tokens.vocabulary_path())
    letters = list(map(chr, range(0xC0, 0x250)))
    texts = [w for c in letters for w in (c, f"{c}arna", f"ar{c}na", f"ARN{c}", f"{c}{c}, x{c}'s 1{c}")] + ["Ɓarna Əli Ɗan Ⱥ"]
    for text, whole in zip(texts, cache.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(cache.encode(text), "<u4").tolist() == whole.ids


def test_packing(spark, docs, rows, empty):
    pieces = packing.token_pieces(docs, length=64)
    cache = tokens.WordTokens(tokens.vocabulary_path())
    want = []
    for i, t, *_ in rows:
        ids = np.frombuffer(cache.encode(t), "<u4").tolist() + [1]
        want += [(i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
    out = packing.pack(pieces, length=64, partition_pieces=25).collect()
    assert sorted(map(str, (tuple(r)[:5] for r in out))) == sorted(map(str, want))
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    bound = packing.lower_bound(np.array([w[3] for w in want]), 64)
    assert bound <= len(bins) <= bound * 1.05 + 2
    sequences = packing.packed_sequences(docs, length=64).collect()
    assert sum(len(s.ids) for s in sequences) == sum(w[3] for w in want) and all(len(s.ids) == s.n_tokens <= 64 for s in sequences)
    assert packing.pack(packing.token_pieces(empty)).count() == 0


def test_bound_and_best_fit():
    r = np.random.default_rng(2)
    for capacity in (10, 50):
        for _ in range(40):
            lengths = r.integers(1, capacity + 1, r.integers(1, 60))
            bins, _, n = packing.best_fit_decreasing(lengths, capacity)
            assert (np.bincount(bins, lengths) <= capacity).all() and n >= packing.lower_bound(lengths, capacity) >= -(-lengths.sum() // capacity)
    assert packing.lower_bound(np.array([6, 6, 6, 4]), 10) == 3


# 5 fingerprints


def canon(t):
    nfkc = lambda s: unicodedata.normalize("NFKC", s)
    return re.sub(r"[\s\x85]+", " ", nfkc(nfkc(nfkc(t).casefold()).casefold())).strip(" ")


def test_folding_is_that_of_unicode_for_all_code_points(spark):
    """Alone and before marks that fold and compose; folding once more changes nothing."""
    letters = [chr(i) for i in range(1, 0x110000) if unicodedata.category(chr(i)) not in ("Cn", "Cs", "Co")]
    df = spark.createDataFrame([(c,) for c in letters], "c string").repartition(4)
    for tail in ("", "\u0345\u0301", "\u0301\u0345", "Σ\u0308"):
        text = F.concat("c", F.lit(tail))
        once = fingerprint._nfkc_folded(text)
        for r in df.select("c", once.alias("once"), fingerprint._nfkc_folded(once).alias("twice")).collect():
            nfkc = lambda s: unicodedata.normalize("NFKC", s)
            assert r.once == nfkc(nfkc(nfkc(r.c + tail).casefold()).casefold()) == r.twice, (r.c, tail)


def test_fingerprints(spark, empty):
    import struct

    import xxhash

    seed = xxhash.xxh64(struct.pack("<i", 1), seed=42).intdigest()
    digest = lambda t: f"{xxhash.xxh64(canon(t).encode(), seed=42).intdigest():016x}{xxhash.xxh64(canon(t).encode(), seed=seed).intdigest():016x}"
    texts = ["Straße", "STRASSE", "ﬁne  é\n", "fine é", "", None, " ", "a b c", "A b C", "ΑΣ", "ας", "x" * 3000, "tie", "eit", "\u1c80", "в", "ΑΙ", "ᾳ"]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(6, "same id"), (6, "same id"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1))
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), digest(t), digest(edited), float(digest(t) == digest(edited)), float(digest(t) == digest(after))))
    for span in (1 << 20, 1, 700):
        old, fingerprint.SPAN_BYTES = fingerprint.SPAN_BYTES, span
        try:
            assert sorted(map(str, map(tuple, fingerprint.edited_fingerprints(df).collect()))) == sorted(map(str, want))
        finally:
            fingerprint.SPAN_BYTES = old
    plain = {r.text: r.fingerprint for r in fingerprint.fingerprints(df).collect()}
    assert plain["Straße"] == plain["STRASSE"] and plain["ΑΣ"] == plain["ας"] and plain["\u1c80"] == plain["в"] and plain["ΑΙ"] == plain["ᾳ"] and plain["a b c"] == plain["A b C"] and plain[None] == plain[" "] == plain[""]
    assert fingerprint.edited_fingerprints(empty).count() == 0 and fingerprint.fingerprints(empty).count() == 0
    one = fingerprint.edited_fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0


def test_colliding_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "digest", lambda c: F.concat(F.lit("d"), F.char_length(c) % 2))
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "AA"), (4, "c")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(df).collect()}
    assert got[1] == got[3] and len(set(got.values())) == 3


# 6 chat


def test_chat(spark):
    r = random.Random(4)
    rows = []
    for conv in [1, 2, 3, None]:
        if conv != 2:
            rows.append((conv, 0, "system", r"be <brief> \ ok"))
        for t in range(1, 40):
            rows.append((conv, t, "assistant" if t % 2 == 0 else "user", r.choice(["</turn>\n<turn user>\n", "\\", "", None, "<", sentence(r, r.randint(1, 80))])))
    rows += [(7, 1, None, "no role"), (7, 1, "assistant", "tie"), (7, None, "assistant", "no number"), (8, 0, "a>\n<b", "odd role"), (9, 0, "assistant", sentence(r, 3000)), (9, 1, "assistant", "x"), (9, 1, "assistant", "x"), (10, 0, "system", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).repartition(4)
    want = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda x: (str(x[0]), x[1] is None, x[1] or 0, x[2] or "", x[3] or "")):
        want[c].append((role or "", text or ""))
    cache = tokens.WordTokens(tokens.vocabulary_path())
    for budget in (10, 120, 5000):
        windows = chat.format_conversations(df, budget=budget)
        got = {x.conv_id: x for x in chat.read_back(windows).collect()}
        assert set(got) == set(want)
        for c, turns in want.items():
            said = "".join(t for role, t in turns if role == "assistant")
            assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
            assert got[c].loss_chars == len(said) and got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        for w in windows.collect():
            turns = chat.read_turns(w.text)
            assert w.n_tokens == len(cache.encode(w.text)) // 4 == len(cache.tokenizer.encode(w.text, add_special_tokens=False).ids)
            assert w.n_tokens <= budget or len(turns) == 1
            assert w.history <= chat.HISTORY_TURNS and (not w.system or turns[0][0] == "system") and (w.window or not w.system and not w.history)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.read_turns("<turn a>\nno end")


@pytest.mark.parametrize("text", ["", "\\", "\\<", "</turn>", "\\\\>", "a<b>c\\d", r"\### Assistant: </turn> ok"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text and not re.search(r"(?<!\\)(\\\\)*<", chat.escape(text))


# 7 decontamination


def test_decontamination(spark, empty):
    r = random.Random(6)
    question = "the train from Boston left at 1,200 km away and Alice with 35 kg met Alice again near the old 35 bridge"
    items = [(1, question), (2, "short item of five words"), (3, sentence(r, 40)), (4, ""), (5, None), (6, sentence(r, 14).upper())]
    other = question.replace("Boston", "Oslo").replace("1,200", "77").replace("Alice", "Bob").replace("35", "9")
    mixed = question.replace("1,200 km", "5 km").replace("35 kg", "6 kg").replace("old 35", "old 8").replace("met Alice", "met Carol")
    w3 = items[2][1].split()
    docs = [
        (10, f"before it, {question} and after"), (11, f"before it, {other}. After"), (12, "some short item of five words here"), (13, sentence(r, 300)), (14, "x " + " ".join(w3[5:16]) + " y"), (15, " ".join(w3[5:14])),
        (16, f"{items[5][1].lower()}"), (17, None), (18, ""), (10, sentence(r, 20)), (None, f"say {question} now"), (19, f"Well, {mixed}"), (20, f"before it, {question} and after {question}"),
    ]
    df = spark.createDataFrame(docs + [docs[0]], "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("item_id", F.lit(2))
    bench = spark.createDataFrame(items + [items[0]], "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = {(x.doc_id, x.item_id): x for x in decontamination.benchmark_matches(df, bench).collect()}
    kinds = {k: x.kind for k, x in got.items()}
    assert kinds.pop((19, 1)) == "mixed"
    assert kinds == {(10, 1): "verbatim", (11, 1): "reparameterised", (12, 2): "verbatim", (14, 3): "verbatim", (16, 6): "verbatim", (None, 1): "verbatim", (20, 1): "verbatim"}
    assert got[(12, 2)].doc_start == 1 and got[(14, 3)].n_words == 11 and got[(14, 3)].item_start == 5 and got[(10, 1)].coverage == 1.0
    kept = decontamination.decontaminated(df, bench)
    assert sorted(str(x.doc_id) for x in kept.collect()) == ["13", "15", "17", "18", "None"] and kept.dtypes == df.dtypes
    assert decontamination.benchmark_matches(empty, bench).count() == 0
    assert decontamination.benchmark_matches(df, bench.limit(0)).count() == 0


def test_decontamination_does_not_depend_on_position(spark):
    ocean, tom = "What is the largest ocean on earth?", "Tom has 12 apples."
    items = [(1, ocean), (2, tom), (3, "what did Alice buy. how much was it"), (4, "Rivers flow down and Tom swims. how far is it to the old bridge")]
    docs = [
        (10, f"he asked: {ocean}"), (11, f"and he asked {ocean}"), (12, f"well, {ocean}"), (13, f"and he asked\n{ocean} yes"), (14, "say what is the largest ocean on earth"), (15, f"he said  {ocean}"), (16, f"« {ocean} »"),
        (20, "and Bob has 15 apples"), (21, "Bob has 15 apples"), (22, "so.\nBob has 15 apples"), (23, "yes, Bob has\n15 apples"), (24, f"she said ({tom})"), (25, "“Bob has 15 apples”"),
        (30, "asked What did Bob buy. How much was it"), (31, "What did\nBob buy. how much was it"), (40, "he said Rivers flow down and Bob swims. How far is it to the old bridge"),
        (50, "and Jupiter is the largest ocean on earth"), (51, "Where is the largest ocean on earth?"), (52, "Bob did Alice buy. how much was it"), (53, "12 apples has Tom"),
    ]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.kind for x in decontamination.benchmark_matches(df, bench).collect()}
    want = {(i, 1): "verbatim" for i in range(10, 17)} | {(i, 2): "reparameterised" for i in (20, 21, 22, 23, 25)} | {(24, 2): "verbatim", (30, 3): "reparameterised", (31, 3): "reparameterised", (40, 4): "reparameterised"}
    assert got == want


NAMES = ["Alice", "Bob", "Carla", "Denis", "New York", "Mary Ann Smith", "Oslo", "Juan Carlos", "Leipzig", "Rio Grande"]
QUESTIONS = [
    "{a} has {x} apples and gives {y} of them to {b}. How many apples does {a} have left?",
    "A train leaves {a} at a speed of {x} km per hour and reaches {b} after {y} hours of travel without a stop.",
    "If {a} can paint the old fence in {x} hours and {b} needs {y} hours, how long do they need together?",
    "In {a} there were {x} farmers, {y} of whom moved to {b} before the winter came over the mountains.",
    "The recipe of {a} takes {x} grams of sugar, which {b} mixes with {y} litres of milk in a large bowl.",
]
SPELLED = {2: "two", 3: "three", 7: "seven", 12: "twelve", 25: "twenty-five", 40: "forty", 310: "three hundred ten", 96: "96", 1500: "1,500", 18: "18"}


def test_reparameterised_questions_are_found(spark):
    """Other numbers, in digits or words, and other names, of one word or more, at any place of a text."""
    r = random.Random(21)
    fill = lambda q, names, numbers: q.format(a=names[0], b=names[1], x=SPELLED[numbers[0]], y=SPELLED[numbers[1]])
    items = [(i, fill(q, r.sample(NAMES, 2), r.sample(sorted(SPELLED), 2))) for i, q in enumerate(QUESTIONS)]
    docs, want = [], {}
    for k in range(120):
        i = k % len(QUESTIONS)
        text = fill(QUESTIONS[i], r.sample(NAMES, 2), r.sample(sorted(SPELLED), 2))
        before = r.choice(["", sentence(r, 8) + " ", sentence(r, 5) + ". ", sentence(r, 5) + ":\n", "He wrote “", "and so, "])
        docs.append((k, before + text + " " + sentence(r, 12)))
        want[k] = i
    docs += [(1000 + k, sentence(r, 60)) for k in range(60)]
    got = decontamination.benchmark_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {x.doc_id: x.item_id for x in got}
    right = sum(found.get(k) == i for k, i in want.items())
    assert right >= 0.9 * len(want) and not any(d >= 1000 for d in found)


def odd_text(r, n):
    """Words with digits, signs and units inside, numbers in all forms, names, capitals and letters of other scripts."""
    kinds = ["gpt3.5", "web2.0", "x9", "5kg", "3.5 km", "1,000", "12:30", "twenty-one", "three miles", "Anna", "Bo Li", "B-52", "v1.2.3", "é2à", "½", "Straße", "Ελλάς", "мир", "a/b", "10/12x", "c++", "e-mail", "İstanbul", "٣", "4th", "R2D2", "the", "of", "model", "scored", "higher", "is", "used", "by", "critics", "others", "line", "sum", "paper", "still", "than"]
    return "".join(r.choice(kinds) + r.choice([" ", " ", " ", " ", ", ", ". ", "\n", "\u00a0", " - "]) for _ in range(n))


def test_anchors_lose_nothing(spark, monkeypatch):
    """Documents are the same with anchors as when every text is read closely: passages verbatim and with other numbers."""
    r = random.Random(17)
    items = [odd_text(r, r.randint(4, 30)) for _ in range(60)] + ["the gpt3.5 model scored higher than others", "is web2.0 still used by its critics", "gpt3.5 web2.0 x9 R2D2 v1.2.3 B-52 4th é2à x9 gpt3.5 web2.0"]
    docs = [odd_text(r, 25) for _ in range(60)]
    for item in items:
        docs.append(odd_text(r, 15) + " " + item + " " + odd_text(r, 15))
        docs.append(odd_text(r, 8) + re.sub(r"\d", lambda m: str((int(m[0]) + 1) % 10), item))
    table = lambda rows, name: spark.createDataFrame(list(enumerate(rows)), f"{name} long, text string")
    for part in (items[:30], items[30:60], items[60:62], items[62:]):
        found = lambda: sorted(map(tuple, decontamination.benchmark_matches(table(docs, "doc_id"), table(part, "item_id")).select("doc_id", "item_id", "kind", "n_words").collect()))  # noqa: B023, E731
        anchored = found()
        with monkeypatch.context() as m:
            m.setattr(decontamination, "_anchored", lambda texts, *_: texts)
            assert anchored == found()
        assert len({i for _, i, *_ in anchored}) >= len(part) * 0.9


def test_decontamination_reads_long_texts_and_items_without_sure_words(spark):
    r = random.Random(23)
    question = "the train from Boston left at 12 km away and Alice with 35 kg met Alice again near the old 35 bridge"
    items, docs = [(1, question), (2, "Tom 5 Alice 7")], [(1, sentence(r, 30_000) + " " + question + " " + sentence(r, 30_000)), (2, "so Bob 9 Carol 4 went"), (3, sentence(r, 50)), (4, None), (5, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    every = {(x.doc_id, x.item_id): x.kind for x in decontamination.benchmark_matches(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert every == {(1, 1): "verbatim", (2, 2): "reparameterised"}
    one = {(x.doc_id, x.item_id): x.kind for x in decontamination.benchmark_matches(df, spark.createDataFrame(items[:1], "item_id long, text string")).collect()}
    assert one == {(1, 1): "verbatim"}  # by anchors, and with every text looked at


# 1 language and 3 quality

ALPHABETS = {"en": "the and with other nation house", "xx": "zuk grov tchel brünk schnar", "yy": "ollá ñire cuesta aquí lleva"}


def language_rows(n=240):
    r = random.Random(8)
    return [(i, " ".join(r.choice(ALPHABETS[lang].split()) for _ in range(r.randint(5, 60))), lang) for i in range(n) for lang in [r.choice(list(ALPHABETS))]]


def test_language(spark, empty):
    rows = language_rows() + [(1000, None, "en"), (1001, "", "xx"), (1002, "123 --- 45", "yy"), (1003, "the house", None), (None, "zuk grov", "xx"), (1004, "…—", None), (1004, "the other house", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).repartition(3)
    out = language.predict_languages(df).collect()
    assert len(out) == len(rows)
    known = {i: lang for i, _, lang in rows[:240]}
    held = [x for x in out if x.held_out and x.doc_id in known]
    assert held and np.mean([x.lang_pred == known[x.doc_id] for x in held]) > 0.97
    for x in out:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1
        if x.doc_id in (1000, 1001, 1002):
            assert x.lang_pred == "und" and x.rejected and x.score == 0
    assert {x.lang_pred for x in out if x.doc_id == 1004} == {"und", "en"} and {x.lang_pred for x in out if x.doc_id is None} == {"xx"}
    assert language.predict_languages(empty).count() == 0
    model = language.fit(df)
    kept = language.accepted(df, model)
    assert kept.dtypes == df.dtypes and {x.doc_id for x in kept.collect()} >= set(known) and kept.filter("doc_id IN (1000, 1001, 1002)").count() == 0
    blank = language.fit(df.withColumn("lang", F.lit(None).cast("string")))
    assert blank.languages == [] and language.accepted(df, blank).count() == len(rows) - 4
    assert language.train([("abc", "en")] * 3).languages == ["en"]


def test_language_rejects_what_it_does_not_know(spark):
    model = language.fit(spark.createDataFrame(language_rows(), "doc_id long, text string, lang string"))
    model.threshold = 0.999
    df = spark.createDataFrame([(1, "qqq jjj 中文 vvv")], "doc_id long, text string")
    assert language.identify(df, model).first().rejected


@pytest.mark.parametrize("share", [0.05, 0.1])
def test_noisy_labels_reject_few_texts(share):
    import pyarrow as pa

    r = random.Random(12)
    rows = language_rows(2400)
    noisy = [(t, r.choice([x for x in ALPHABETS if x != lang]) if r.random() < share else lang) for _, t, lang in rows]
    model = language.train(noisy)
    judged = list(language._judged(pa.array([t for _, t, _ in rows]), model))
    assert np.concatenate([x[4] for x in judged]).mean() <= 2 * language.MAX_REJECTED
    best = np.array(model.languages)[np.concatenate([x[2] for x in judged])]
    assert np.mean(best == np.array([lang for _, _, lang in rows])) > 0.97


def test_rejection_is_bounded_whatever_the_errors():
    r = np.random.default_rng(4)
    for n in (1, 19, 49, 480):
        for classes in (2, 50):  # confidence says nothing of the labels; 50 close languages are all below the floor
            model = language.LanguageModel([str(i) for i in range(classes)], r.normal(0, 0.05, (1 << 17, classes)).astype(np.float32), np.zeros(classes))
            bags = [(r.integers(0, 1 << 17, 20), np.full(20, 0.05)) for _ in range(n)]
            model = language._calibrated(model, bags, r.integers(0, classes, n))
            p = np.array([language._softmax((share @ model.table[ids] + model.bias) / model.temperature).max() for ids, share in bags])
            assert (p < model.threshold).sum() <= language.MAX_REJECTED * n
    assert language.train([("abc", "a"), ("dce", "b"), ("fgh", "c")]).threshold < 0.4


def test_samples_share_their_bytes_by_class(spark):
    """A long text in front takes no other's room, and one class takes none of another's."""
    rows = [("x" * 900, "a"), *[("a" * 50, "a")] * 30, *[("é" * 25, "b")] * 30, ("y" * 100_000, "b"), (None, "b")]
    df = spark.createDataFrame(rows, "text string, label string").coalesce(1)
    got = sampling.collected(df, 2, 1000)
    assert Counter(label for _, label in got) == {"a": 10, "b": 11} and len(got[0][0]) == 0
    assert ("x" * 900, "a") in sampling.collected(df, 1, 1000) and sampling.collected(df.limit(0), 0) == []


def test_quality(spark, empty):
    r = random.Random(9)
    good = [sentence(r, r.randint(20, 80)).capitalize() + "." for _ in range(150)]
    bad = [" ".join(w + r.choice(["!!", "###"]) for w in sentence(r, 40).upper().split()) for _ in range(40)] + [" ".join([r.choice(WORDS)] * 60) for _ in range(30)] + [(sentence(r, 6) + ". ") * 12 for _ in range(30)]
    labelled = [(i, t, q) for i, (t, q) in enumerate([(t, 1) for t in good] + [(t, 0) for t in bad])]
    df = spark.createDataFrame([(i, t) for i, t, _ in labelled] + [(900, None), (901, ""), (None, "no id here"), (902, "x " * 20_000), (0, labelled[0][1])], "doc_id long, text string").withColumn("quality", F.lit("clash"))
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in labelled] + [(901, None, 0), (None, 1, 0), (12345, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.predict_quality(df, labels).collect()
    assert len(out) == df.count() and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in out)
    truth = {i: q for i, _, q in labelled}
    held = [x for x in out if x.held_out and x.doc_id in truth]
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in out)
    assert len(held) > 20 and np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.95
    assert quality.predict_quality(empty, labels).count() == 0
    assert {x.score for x in quality.predict_quality(df, labels.limit(0)).collect()} == {0.5}


# 9 token counts


def brute_totals(live):
    out = defaultdict(lambda: [0, 0])
    for (_, version), (source, lang, n) in live.items():
        out[(source, lang, version)][0] += 1
        out[(source, lang, version)][1] += n
    return {k: tuple(v) for k, v in out.items()}


def test_token_ledger(spark, tmp_path):
    ledger, live, r = token_counts.TokenCounts(spark, str(tmp_path / "counts")), {}, random.Random(2)
    total = lambda: {(x.source, x.lang, x.version): (x.n_docs, x.n_tokens) for x in ledger.totals().collect()}
    assert total() == {}
    for number in range(4):
        changes = {}
        for _ in range(30):
            key = (r.choice([None, *range(12)]), r.choice(["v1", "v2"]))
            changes[key] = (r.choice(["s", "t", None]), r.choice(["en", None]), r.choice(["insert", "insert", "delete", "revise"]), r.choice([None, 0, 5, 9]))
        for key, (source, lang, op, n) in changes.items():
            if op == "insert":
                live[key] = (source, lang, n or 0)
            elif key in live and op == "revise":
                live[key] = (source if source is not None else live[key][0], lang if lang is not None else live[key][1], n or 0)
            elif op == "delete":
                live.pop(key, None)
        rows = [(d, v, s, g, op, n) for (d, v), (s, g, op, n) in changes.items()]
        df = spark.createDataFrame(rows + rows[:3], "doc_id long, version string, source string, lang string, op string, n_tokens long").withColumn("n", F.lit(1))
        assert ledger.apply(f"b{number}", df) and not ledger.apply(f"b{number}", df)
        assert total() == brute_totals(live)
    ledger.spark.range(3).write.parquet(f"{ledger.path}/rows/left-behind")  # a writer that died
    assert ledger.compact() and not ledger.compact() and total() == brute_totals(live) and not ledger.apply("b0", df)
    assert {(x.doc_id, x.version): (x.source, x.lang, x.n_tokens) for x in ledger.current().collect()} == live
    plan = ledger.current(spark.createDataFrame([(3, "v1")], "doc_id long, version string"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)  # a small batch reads its own buckets


def test_token_counts(docs, rows, empty):
    got = token_counts.count_tokens(docs, {"w": token_counts.word_count, "b": token_counts.bpe_count()})
    cache = tokens.WordTokens(tokens.vocabulary_path())
    want = Counter((i, lang, n) for i, t, lang, *_ in rows for n in [len(split(t))])
    assert Counter((x.doc_id, x.lang, x.n_tokens) for x in got.filter("version = 'w'").collect()) == want
    assert sum(x.n_tokens for x in got.filter("version = 'b'").collect()) == sum(len(cache.encode(r[1])) // 4 for r in rows)
    assert token_counts.count_tokens(empty, {"w": token_counts.word_count}).count() == 0


def test_lettered_words():
    count = token_counts.lettered_word_count
    assert count("a – b « c » …") == 3 and count("a -- b !? é …") == 3 and count("— • «» ...") == 0 and count(None) == count("") == 0
    for text in ["a\u2003b c\u00a0d", "x\x1cy\x85z", "中文 ٣ ² don't (é) \u3000 –a–", "one\x0btwo\tthree\n"]:
        assert count(text) == sum(any(c.isalnum() for c in w) for w in split(text)) <= token_counts.word_count(text)


def test_revised_words_of_the_query(spark, tmp_path):
    rows = [(1, "a – b « c » …", "en", "s", 13), (2, "x\u2003y z", "en", "s", 5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.version: x.n_tokens for x in queries.QUERIES["op9_token_counts"](spark, str(tmp_path)).collect()}
    assert got["words"] == 3 + 2


# 10 licenses


def test_licenses(spark, empty):
    r = random.Random(3)
    t = licenses.TEMPLATES
    header = t["Apache-2.0-header"]
    docs = [
        (1, f"{sentence(r, 30)}\n{t['MIT']}\n{sentence(r, 5)} {t['CC-BY-NC-4.0']}"), (2, "été " + t["GPL-3.0"].upper().replace(" ", "\n  * ")), (3, header.replace("compliance with", "full compliance with").replace("obtain a copy of", "get")),
        (4, sentence(r, 200)), (5, None), (6, ""), (7, "licensed under the"), (8, t["MIT"]), (8, t["MIT"]), (None, t["MPL-2.0"]), (9, (t["MIT"] + " ") * 40 + sentence(r, 3000)), (10, "Released under the"),
    ]
    got = licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string").withColumn("license", F.lit("x"))).collect()
    found = Counter((x.doc_id, x.license) for x in got)
    assert found == {(1, "MIT"): 1, (1, "CC-BY-NC-4.0"): 1, (2, "GPL-3.0"): 1, (3, "Apache-2.0-header"): 1, (8, "MIT"): 2, (None, "MPL-2.0"): 1, (9, "MIT"): 40}
    text = {i: x for i, x in docs}
    for x in got:
        assert text[x.doc_id][x.start_char : x.end_char] == x.matched and 0.8 <= x.coverage <= 1
    three = next(x for x in got if x.doc_id == 3)
    assert three.n_matched == len(licenses.template_words(header)) - 4 + 0 and three.matched.startswith("Licensed") and three.matched.endswith("implied")
    assert licenses.scan_licenses(empty).count() == 0
    assert licenses.scan_licenses(spark.createDataFrame(docs[:1], "doc_id long, text string"), {"none": "", "two words": "of it"}).count() == 0


def brute_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_is_the_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(300):
        a = np.array([r.randrange(6) for _ in range(r.randint(1, 10))], np.uint64)
        b = np.array([r.randrange(6) for _ in range(r.randint(0, 12))], np.uint64)
        padded = np.concatenate([np.full(12, 99, np.uint64), b])
        k, start, end = licenses.align(a, padded, 25, 12)
        assert k == brute_common(a, b)
        if k:  # the span holds as many words in common, and no tighter one does
            assert k == brute_common(a, padded[start:end])
            assert not any(brute_common(a, padded[i : i + end - start - 1]) == k for i in range(len(padded)))
        assert licenses.align(a, a, 7, 0)[0] == len(a)


def test_templates_with_insertions_and_gaps_are_found(spark):
    r = random.Random(14)
    long = [n for n, t in licenses.TEMPLATES.items() if len(licenses.template_words(t)) >= 35]
    docs, want = [], {}
    for k, (name, n) in enumerate((name, n) for name in long for n in (0, 3, 8, 15, 25, 40)):
        w = licenses.TEMPLATES[name].split()
        at = r.randrange(len(w) // 4, 3 * len(w) // 4)
        docs.append((k, f"{sentence(r, 20)} {' '.join(w[:at])} {sentence(r, n)} {' '.join(w[at:])} {sentence(r, 20)}"))
        want[k] = name
    for name in long:  # a tenth is left out
        w = licenses.TEMPLATES[name].split()
        docs.append((len(docs), " ".join(w[: len(w) // 2] + w[len(w) // 2 + len(w) // 10 :])))
        want[len(docs) - 1] = name
    docs += [(9000 + k, sentence(r, 300)) for k in range(30)]
    got = defaultdict(set)
    for x in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got[x.doc_id].add(x.license)
    assert sum(want[k] in got[k] for k in want) >= 0.9 * len(want) and not any(k >= 9000 for k in got)


def test_sister_licenses_are_not_confused(spark):
    """Notices of sister licenses, families without a version, tags, and unknown versions."""
    t = licenses.TEMPLATES
    notice = "{} is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    docs, want = [], []

    def case(text, *names):
        docs.append((len(docs), text))
        want.append(set(names))

    case(notice.format("This library", "Lesser General Public License", "2.1"), "LGPL-2.1-header")
    case(notice.format("This library", "Lesser General Public License", "3"), "LGPL-3.0-header")
    case(notice.format("This program", "General Public License", "2"), "GPL-2.0-header")
    case(notice.format("This program", "General Public License", "3"), "GPL-header")
    case(notice.format("This program", "Affero General Public License", "3"), "AGPL-3.0-header")
    case(notice.format("This program", "General Public License", "7"), "GPL")
    case("It is licensed under the GNU General Public License.", "GPL")
    case("It is licensed under the GNU Lesser General Public License.", "LGPL")
    case("This work is licensed under the GNU General Public License, version 2.1.", "GPL")
    case("Released under the BSD License.")
    case("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0")
    case("Licensed under CC BY 3.0.")
    case("# SPDX-License-Identifier: GPL-2.0-or-later\nint main()", "SPDX-GPL-2.0-or-later")
    case("/* SPDX-License-Identifier: MIT */", "SPDX-MIT")
    case("SPDX-License-Identifier: MIT-Modern-Variant")
    case("// SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception", "SPDX-Apache-2.0")
    case(t["EPL-2.0"], "EPL-2.0")
    case(t["MPL-2.0-header"].replace("2.0", "1.1"))
    for name, text in t.items():
        if licenses.deciding(text) and len(licenses.template_words(text)) < licenses.LONG:
            case(f"so\n{text}\n", name)
    got = defaultdict(set)
    for x in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got[x.doc_id].add(x.license)
    wrong = [(text, got[i], want[i]) for i, text in docs if got[i] != want[i]]
    assert not wrong


def test_whole_license_texts(spark):
    """Whole texts, without titles, within comments, damaged, twice in a text; one whose sister has no template is not taken for it."""
    r = random.Random(9)
    whole = {n: t for n, t in licenses.TEMPLATES.items() if n.endswith("-whole")}
    assert {"Apache-2.0-whole", "GPL-2.0-whole", "GPL-3.0-whole", "LGPL-2.1-whole", "LGPL-3.0-whole", "MPL-2.0-whole"} <= set(whole)
    docs, want = [], {}
    for name, text in whole.items():
        lines = text.splitlines()
        words_ = text.split()
        forms = [
            text,
            "\n".join(lines[5:]),
            "\n".join(f" * {x}" for x in lines),
            " ".join(w for w in words_ if r.random() > 0.04),
            f"{sentence(r, 400)}\n{text}\n{sentence(r, 400)}",
            text[: int(len(text) * 0.9)],
        ]
        if name == "Apache-2.0-whole":
            body = text[text.index("1. Definitions") : text.index("END OF TERMS")]
            forms.append(body)
        for form in forms:
            want[len(docs)] = name
            docs.append((len(docs), form))
    affero = len(docs)
    docs.append((affero, whole["GPL-3.0-whole"].replace("General Public", "Affero General Public")))
    twice = len(docs)
    docs.append((twice, f"{whole['MPL-2.0-whole']} {sentence(r, 50)} {whole['MPL-2.0-whole']} {sentence(r, 50)} {whole['GPL-2.0-whole']}"))
    got = defaultdict(list)
    for x in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect():
        got[x.doc_id].append(x.license)
    wrong = [(i, want[i], got[i]) for i in want if [n for n in got[i] if n.endswith("-whole")] != [want[i]]]
    assert not wrong
    assert not [n for n in got[affero] if n.endswith("-whole")]
    assert sorted(n for n in got[twice] if n.endswith("-whole")) == ["GPL-2.0-whole", "MPL-2.0-whole", "MPL-2.0-whole"]
