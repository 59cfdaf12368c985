"""Structure repair, concatenate-and-cut packing and fill-in-middle against brute force on small fixtures."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tallyveil.llm import concatenation
from tallyveil.llm import fill_in_middle as fim
from tallyveil.llm import queries, structure_repair

SCHEMA = "doc_id long, text string, lang string"


def brute_fim(doc_id, text):
    """(n, form, prefix, middle, output) by string slices."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:p], text[p:q], text[q:]
    if h4 % 100 < 20:
        return n, "spm", p, q - p, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", p, q - p, f"<P>{prefix}<S>{suffix}<M>{middle}"


FIM_TEXTS = ["", None, "a", "é", "<", "<S", "P>", "<<P", "S>M>", "a<P>b", "<M>", "日本語のテキスト", "🙂🙂a🙂", "éé", "<P", ">", "x" * 70_000, "ü🙂" * 40_000, "a\x00b\r\n", "<<<<>>>>SPM"]


def test_fill_in_middle(spark):
    rows = [(100 * k + j, t, "en") for k, t in enumerate(FIM_TEXTS) for j in range(14)]
    rows += [(None, "no id at all", None), (None, None, None), rows[40], rows[40], (-7, "negative id", "fr")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for clash in ("n", "form", "output", "h0"):
        docs = docs.withColumn(clash, F.lit("extra"))
    out = fim.restored(fim.fill_in_middle(docs)).collect()
    got = sorted(((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output, x.text) for x in out), key=str)
    assert got == sorted(((i, *brute_fim(i, t), t or "") for i, t, _ in rows), key=str)
    assert {x.form for x in out} == {"plain", "psm", "spm"}
    assert fim.restored(fim.fill_in_middle(docs.limit(0))).count() == 0


def test_outputs_with_wrong_marks_are_refused(spark):
    with pytest.raises(Exception, match="one mark each"):
        fim.restored(spark.createDataFrame([("<P>a<S>b", "psm")], "output string, form string")).collect()


def test_restored_keeps_columns_and_takes_a_free_name(spark):
    rows = spark.createDataFrame([("<S>c<P>a<M>b", "spm", "other"), (None, None, None)], "output string, form string, text string")
    assert [(r.text, r._text) for r in fim.restored(rows).collect()] == [("other", "abc"), (None, "")]


def test_fill_in_middle_matches_sql(spark, duck):
    from conftest import same_rows

    same_rows(queries.QUERIES["op13_fill_in_middle"](spark, DATA).toPandas(), duck.sql(queries.ORACLES["op13_fill_in_middle"]).df())


def coded(texts):
    tokenizer = concatenation.ByteTokens(ranks=None).tokenizer
    return [[*e.ids, 1] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def assert_concatenated(out, texts, length):
    """Each document's ids lie in one piece each; sequences are gapless, full, and the last ones powers of two."""
    want = {}
    for (i, _), ids in zip(texts, coded([t for _, t in texts]), strict=True):
        want.setdefault(i, []).append(ids)
    by_doc, by_sequence = {}, {}
    for x in out:
        by_doc.setdefault(x.doc_id, []).append(x)
        by_sequence.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert set(by_doc) == set(want)
    for i, rows in by_doc.items():
        expected = []
        for ids in want[i]:  # rows of one id are each cut: compare what starts, ends and sums do not depend on
            expected.append(len(ids))
        assert sum(x.length for x in rows) == sum(expected)
        assert sorted(x.doc_tokens for x in rows if x.start == 0) == sorted(expected)
        for x in rows:
            assert any(len(ids) == x.doc_tokens and zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes()) == x.ids_crc32 for ids in want[i])
    total, sizes = sum(len(ids) for many in want.values() for ids in many), []
    for parts in by_sequence.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]]
        sizes.append(int(ends[-1]))
    assert sum(sizes) == total and sizes.count(length) >= total // length
    rest = [n for n in sizes if n != length]
    assert len(rest) == bin(total % length).count("1") and all(n & (n - 1) == 0 for n in rest)


@pytest.mark.parametrize("length", [16, 2048])
def test_concatenate(spark, length):
    texts = ["", None, "a", "one two three", "x" * 5000, " " * 4000, "<|endoftext|> and <|endoftext|>", "日本語 🙂 é", "\u2028\x85\u200d", "word " * 9000, "it's we'll I'D '' \n\n x"]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(None, "no id", None), (None, None, None), (3, "one two three", "en"), (3, "one two three", "en"), (4, "another text", "fr")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for clash in ("part", "place", "n", "ids", "start"):
        docs = docs.withColumn(clash, F.lit("extra"))
    assert_concatenated(concatenation.pieces(docs, length).collect(), [(i, t) for i, t, _ in rows], length)
    assert concatenation.pieces(docs.limit(0), length).count() == 0 and concatenation.sequences(docs.limit(0), length).count() == 0


@pytest.mark.parametrize("length", [16, 2048])
def test_sequences_hold_what_pieces_say(spark, length):
    rows = [(k, "word " * (k * 7 % 60) + str(k), "en") for k in range(300)] + [(1000, "long text " * 3000, "en")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6).sortWithinPartitions("doc_id")
    every = [i for ids in coded([t for _, t, _ in rows]) for i in ids]
    out = sorted(concatenation.sequences(docs, length).collect())
    assert sorted(i for x in out for i in x.ids) == sorted(every) and all(x.n_tokens == len(x.ids) for x in out)
    assert [x.sequence_id for x in out] == list(range(len(out))) and [x.n_tokens for x in out[: len(every) // length]] == [length] * (len(every) // length)
    row = [i for x in out for i in x.ids]
    ends = [k for k, i in enumerate(row) if i == 1]  # the texts between end ids, in whatever order of partitions
    found = sorted(tuple(row[a + 1 : b]) for a, b in itertools.pairwise([-1, *ends]))
    assert found == sorted(tuple(ids[:-1]) for ids in coded([t for _, t, _ in rows]))


def test_blocks_of_partitions_place_all_documents(spark, monkeypatch):
    monkeypatch.setattr(concatenation, "BLOCK", 2)
    rows = spark.createDataFrame([(p, 10 * j, 10 * p + j, 10, None) for p in (0, 1, 3, 4, 7) for j in range(3)], "part int, local long, doc_id long, n long, ids binary")
    out, total = concatenation.placed(rows)
    assert total == 150 and sorted(r.place for r in out.collect()) == list(range(0, 150, 10))


def test_ranks_give_the_tokenizers_ids():
    """Every code point beside letters, digits, spaces and signs; a tenth of them here, drawn by their number."""
    tokens = concatenation.ByteTokens()
    points = [c for c in range(0, 0x110000, 10) if not 0xD800 <= c <= 0xDFFF] + list(range(1, 0x3000))
    for k in range(0, len(points), 512):
        text = "".join(f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} .{chr(c)}, " for c in points[k : k + 512])
        assert tokens.fast.encode(text, allowed_special="all") == tokens.tokenizer.encode(text, add_special_tokens=False).ids


def test_concatenated_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert_concatenated(queries.QUERIES["op12_concatenate"](spark, DATA).collect(), [tuple(r) for r in docs], 2048)


SPACE = " \t\n\x0b\x0c\r"


def brute_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired text) of one conversation's (turn, role, text)
    in order: dynamic programming over rows and the repaired roles so far, whole strings compared."""
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, found = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        found.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))

    def grammar(letters):  # the states that a prefix of an accepted text can be in
        return re.fullmatch(r"s?(ua)*u?", letters) is not None

    # state: the last letters of the repaired roles say all that the grammar needs
    short = lambda letters: letters[-1:]
    now = {"": (0, "", ())}

    def better(states, key, weight):
        if key not in states or weight[:2] < states[key][:2]:
            states[key] = weight

    def inserted(states):
        for _ in range(4):
            for key, (cost, audit, out) in list(states.items()):
                for role in ("user", "assistant"):
                    letters = "".join(r[:1] for r, _ in out) + role[0]
                    if grammar(letters):
                        better(states, short(letters), (cost + 5, audit + "I", (*out, (role, ""))))
        return states

    now = inserted(now)
    for (_, role, text), fault in zip(rows, found, strict=True):
        after = {}
        for key, (cost, audit, out) in now.items():
            better(after, key, (cost + 2, audit + "D", out))
            if fault in ("b", "d"):
                continue
            more = 5 if fault == "t" else 0
            for new, price, letter in [(role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")]:
                letters = "".join(r[:1] for r, _ in out) + new[:1]
                if new[:1] and grammar(letters):
                    better(after, short(letters), (cost + price + more, audit + letter, (*out, (new, text))))
        now = inserted(after)
    cost, audit, out = min((now[k] for k in ("", "a") if k in now), key=lambda x: x[:2])
    return gaps, found.count("b"), found.count("d"), found.count("t"), illegal, cost, audit, "\n".join(f"{r}:{t}" for r, t in out)


def exhaustive(rows):
    """The least (cost, audit) over all edits of a few rows, by trying them all."""
    found, seen = [], set()
    for role, text in rows:
        bare = text.strip(SPACE)
        found.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = (2 * len(rows), "D" * len(rows))

    def go(k, letters, cost, audit):
        nonlocal best
        if cost > best[0]:
            return
        if k == len(rows) and re.fullmatch(r"(s?(ua)+)?", letters):
            best = min(best, (cost, audit))
        for role in "ua":
            if cost + 5 <= best[0] and re.fullmatch(r"s?(ua)*u?", letters + role):
                go(k, letters + role, cost + 5, audit + "I")
        if k < len(rows):
            go(k + 1, letters, cost + 2, audit + "D")
            if found[k] not in ("b", "d"):
                more = 5 * (found[k] == "t")
                for letter, price, name in [(rows[k][0][:1], 0, "K"), ("u", 1, "R"), ("a", 1, "R")]:
                    if letter and re.fullmatch(r"s?(ua)*u?", letters + letter):
                        go(k + 1, letters + letter, cost + price + more, audit + name)

    go(0, "", 0, "")
    return best


def test_brute_force_is_the_least_of_all_edits():
    import random

    r = random.Random(5)
    for _ in range(150):
        rows = [(r.choice(["user", "assistant", "system", "tool", ""]), r.choice(["a.", "b.", "c", "", "d!"])) for _ in range(r.randint(0, 6))]
        assert exhaustive(rows) == brute_repair([(k, *x) for k, x in enumerate(rows)])[5:7]


def assert_repaired(out, conversations):
    got = {x.conv_id: x for x in out}
    assert len(got) == len(out) and set(got) == set(conversations)
    for c, rows in conversations.items():
        want, x = brute_repair(rows), got[c]
        assert (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit) == want[:7], c
        if hasattr(x, "repaired_sha256"):
            assert x.repaired_sha256 == hashlib.sha256(want[7].encode()).hexdigest(), c


def order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role.encode(), hashlib.sha256(text.encode()).hexdigest())


def random_conversations(seed, sizes):
    import random

    r = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "cut", "", " ", "\u00a0", "Ends. \n", "long " * 40 + "end.", "é.", "x\ty", "."]
    rows = []
    for c, n in enumerate(sizes):
        for k in range(n):
            role = ("user", "assistant")[k % 2] if r.random() < 0.7 else r.choice(["system", "user", "assistant", "tool", None, ""])
            rows.append((c, r.choice([k, k, k, r.randrange(n), None]), role, r.choice([*texts, f"unique {r.random()}.", f"unique {r.random()}."]) if r.random() < 0.95 else None))
    return rows


@pytest.mark.parametrize("chunk", [1, 3, 32])
def test_repair(spark, monkeypatch, chunk):
    monkeypatch.setattr(structure_repair, "CHUNK", chunk)
    rows = random_conversations(chunk, [0, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 150, *[5] * 40])
    rows += [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (99, None, None, None), (98, 5, "user", "same."), *[(98, 6, "user", "same.")] * 30, (98, 7, "assistant", "x" * 200_000 + ".")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    for clash in ("conv", "part", "at", "fault", "copy"):
        turns = turns.withColumn(clash, F.lit("extra"))
    conversations = {}
    for c, t, role, text in rows:
        conversations.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    for c in conversations:
        conversations[c].sort(key=order)
    repair = structure_repair.Repair(turns)
    assert_repaired(repair.conversations().collect(), conversations)
    digests = {x.conv_id: x.repaired_sha256 for x in repair.digests().collect()}
    repaired = {}
    for x in sorted(repair.rows().collect(), key=lambda x: (str(x.conv_id), x.part, x.at, x.k)):
        repaired.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
    for c, found in conversations.items():
        want = brute_repair(found)[7]
        assert "\n".join(repaired.get(c, [])) == want
        assert digests.get(c, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(want.encode()).hexdigest()
    none = structure_repair.Repair(turns.limit(0))
    assert none.conversations().count() == none.rows().count() == none.digests().count() == 0


def test_a_hot_conversation_is_cut_over_many_parts(spark):
    rows = random_conversations(9, [600, 3, 3])
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        repair = structure_repair.Repair(turns)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert repair.runs.filter("conv = 0").select("part").distinct().count() > 1
    conversations = {}
    for c, t, role, text in rows:
        conversations.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    for c in conversations:
        conversations[c].sort(key=order)
    assert_repaired(repair.conversations().collect(), conversations)


def test_structure_repair_of_the_table(spark):
    conversations = {}
    for x in sorted(spark.read.parquet(f"{DATA}/conversations.parquet").collect(), key=lambda x: (x.conv_id, x.turn)):
        fate, rows = zlib.crc32(f"{x.conv_id}:{x.turn}".encode()) % 20, conversations.setdefault(x.conv_id, [])
        row = (x.turn, "user" if fate == 4 else x.role, "" if fate == 1 else re.sub("[.!?]", "", x.text) if fate == 2 else x.text)
        rows += [row] * (0 if fate == 0 else 2 if fate == 3 else 1)
    assert_repaired(queries.QUERIES["op11_structure_repair"](spark, DATA).collect(), conversations)
