"""Patterns of operator 7: each begins with what is rare, and finds what a look behind at every character would."""

from pyspark.sql import functions as F

from tallyveil.llm import decontamination as d


def test_patterns_begin_with_what_is_rare_and_find_the_same(spark):
    word = r"[\p{L}\p{N}'’-]{1,40}"
    n, m, openers = d._NAME, d._MAYBE, "|".join(d.OPENERS)
    slow = {
        d._RUN: rf"(?<={n}{word}) {n}",
        d._LONGER: rf"(?<=(?:{n}|{m}(?!(?i:{openers})(?![\p{{L}}\p{{N}}]))){word}) {n}",
        d._INSIDE: rf"(?<=[\p{{Ll}}\p{{Nd}},;] ){m}",
        d._CAPITAL: rf"(?<![\p{{L}}\p{{N}}{d._JOIN}])(?=\p{{Lu}}\p{{Ll}})(?!(?i:{d._ANY_NUMBER}))",
        d._NUMBER: rf"(?i)(?<![\p{{L}}\p{{N}}])({'|'.join(d.NUMBERS)})",
    }
    assert d._RUN.startswith(f" {n}") and d._LONGER.startswith(f" {n}") and d._INSIDE.startswith(m)
    texts = [
        f"so {n}Anna {n}Maria {n}O'Neil met {m}The {n}Queen. {m}Bob {n}Lee, {m}bob {m}Éva", f"{n}{'x' * 40} {n}B {n}{'x' * 41} {n}C", "Twenty One oranges; ONE two, seven-teen Éric 7Up xTwo Two",
        f"a {m}Dan 7 {m}Eve,{m}Fay; {m}Gil {n}", f"{n}  {n}A {n}B {m}{n}C{d._JOIN}Dora", "", " ".join(["plain"] * 50),
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for fast, old in slow.items():
        got = rows.select(F.regexp_replace("t", fast, "#").alias("a"), F.regexp_replace("t", old, "#").alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got]
