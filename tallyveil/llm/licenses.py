"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

Templates are cut to words and three-word grams; winnowing keeps the smallest hash of every few grams, and an
inverted index (small, broadcast) maps hashes to template positions. Every gram of a text is looked up, so a
text that holds as many template words in a row as winnowing guarantees is a candidate. Hits on neighbouring
diagonals are a segment; segments that go on in both template and text, up to GAP words apart, are a chain, so
inserted or left-out words do not cut a template in two. Over the diagonals of each chain a banded alignment of
template and text gives the matched words, their coverage and the span.

Sister licenses differ in few words, so coverage alone cannot tell them: names, versions and tags (``deciding``) of a
template must stand in the span too, and no others. Whole texts of licenses (LONG words or more) may lack their title;
of them the names of sister licenses must occur about as often as in the template.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import small_batches, spread
from .license_texts import TEMPLATES
from .words import lower_ascii, span_hashes, text_chunks, tidy, window_hashes

GRAM, WINNOW = 3, 2  # runs of GRAM + WINNOW - 1 template words are always found
BAND = 6  # diagonals on either side of a chain's
GAP = 48  # words that may be inserted or left out between two segments
MIN_COVERAGE = 0.8
LONG = 500  # words of a whole text
LEAST_HITS = 16  # a whole text is a candidate from one in so many of its index entries on, in one chain
_DECIDING = re.compile(
    r"spdx-license-identifier:?[\s*#/]*(?P<tag>[^\s*/;,)]+)|\bcc[ -]by(?P<cc>(?:[ -](?:nc|sa|nd))*[ -]\d+(?:\.\d+)*)"
    r"|\b(?:version|v)[\s.*#/]*(?P<version>\d+(?:\.\d+)*)|\blicense,?\s+(?P<number>\d+\.\d+)"
    r"|\b(?P<name>lesser|library(?=\W+general)|affero|mit|bsd|isc|apache|mozilla|eclipse|gnu|cc0)\b"
)
_SISTERS = ("lesser", "library", "affero")
INDEX_BYTES = 32 << 20  # bound of the broadcast index; more templates are refused

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = _ALNUM[128:] = True


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters and digits (any non-ASCII byte is a letter) of lower-cased bytes, as in ``words.spans``."""
    inside = np.concatenate([[False], _ALNUM[data], [False]])
    starts, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[_ALNUM[data[cut]] & _ALNUM[data[cut - 1]]]  # a text ends and the next begins inside a run
    starts, ends = np.union1d(starts, cut), np.union1d(ends, cut)
    return starts, ends, np.searchsorted(starts, offsets)


def template_words(text: str) -> np.ndarray:
    data = lower_ascii(np.frombuffer(text.encode(), np.uint8))
    starts, ends, _ = _spans(data, np.array([0, len(data)]))
    return span_hashes(data, starts, ends)


def deciding(text: str) -> Counter[str]:
    """Names, versions (2 and 2.0 are one) and tags in a text, and how often each occurs."""
    found: Counter[str] = Counter()
    for x in _DECIDING.finditer(text.lower()):
        if x["tag"]:
            found["tag " + x["tag"].rstrip(".")] += 1
        elif x["cc"]:
            found["cc-by" + x["cc"].replace(" ", "-")] += 1
        elif x["name"]:
            found[x["name"]] += 1
        else:
            found["version " + re.sub(r"(\.0+)+$", "", x["version"] or x["number"])] += 1
    return found


def decided(template: Counter[str], n_words: int, span: str) -> bool:
    """Whether a span of text names what a template of ``n_words`` words names; templates that name nothing always agree."""
    if not template:
        return True
    here = deciding(span)
    if n_words < LONG:
        return set(here) == set(template)
    return all(template[x] - 4 <= 2 * here[x] <= 4 * template[x] for x in _SISTERS)  # a few may be damaged or cut off


def winnowed(words: np.ndarray) -> list[tuple[int, int]]:
    """(hash, position) of the smallest gram of every WINNOW grams in a row; shorter templates are one gram."""
    width = min(GRAM, len(words))
    h, _, _ = window_hashes(words, np.array([0, len(words)]), width)
    if len(h) <= WINNOW:
        return [(int(x), i) for i, x in enumerate(h)]
    picked = {k + int(np.argmin(h[k : k + WINNOW])) for k in range(len(h) - WINNOW + 1)}
    return [(int(h[i]), i) for i in sorted(picked)]


_BITS = 21  # of a place in the text of an alignment
_MASK = (1 << _BITS) - 1


def align(template: np.ndarray, text: np.ndarray, width: int, expected: int) -> tuple[int, int, int]:
    """Matched words, first and end word in ``text`` of the best banded alignment: most words in common, then the
    tightest span, then the start nearest to ``expected``. Cell (i, j) is looked at when j - i is from 0 to below
    ``width``; a cell holds matched words, place of the first (late is tight) and end of the last, in one number."""
    best = np.full(width, _MASK, np.int64)
    for i, word in enumerate(template):
        row = best.copy()
        row[:-1] = np.maximum(best[:-1], best[1:])  # template word left out
        at = np.flatnonzero(text[i : i + width] == word)
        if len(at):
            k, first = best[at] >> 2 * _BITS, best[at] >> _BITS & _MASK
            row[at] = np.maximum(row[at], (k + 1) << 2 * _BITS | np.where(k > 0, first, at + i) << _BITS | _MASK - (at + i + 1))
        best = np.maximum.accumulate(row)  # text word left out
    k, first, end = best >> 2 * _BITS, best >> _BITS & _MASK, _MASK - (best & _MASK)
    top = np.lexsort((np.abs(first - expected), end - first, -k))[0]
    return (int(k[top]), int(first[top]), int(end[top])) if k[top] else (0, 0, 0)


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(n for n, t in templates.items() if t and len(template_words(t)))
        self.words = [template_words(templates[n]) for n in self.names]
        self.deciding = [deciding(templates[n]) for n in self.names]
        picked = [winnowed(w) for w in self.words]
        for i, w in enumerate(self.words):
            if len(w) >= LONG:  # phrases that a whole text repeats would put hits on all diagonals
                times = Counter(h for h, _ in picked[i])
                picked[i] = [x for x in picked[i] if times[x[0]] == 1]
        self.least = np.array([max(1, len(p) // LEAST_HITS) if len(w) >= LONG else 1 for p, w in zip(picked, self.words, strict=True)], np.int64)
        entries = sorted((h, i, at) for i, p in enumerate(picked) for h, at in p)
        self.hashes = np.array([e[0] for e in entries], np.uint64)
        self.template, self.at = np.array([e[1] for e in entries], np.int64), np.array([e[2] for e in entries], np.int64)
        self.widths = sorted({min(GRAM, len(w)) for w in self.words})
        if 24 * len(entries) + 8 * sum(map(len, self.words)) > INDEX_BYTES:
            raise ValueError("the templates' index is above its bound")

    def candidates(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, template, first and last diagonal) of chains of hits; a diagonal is the start word expected."""
        found: dict[tuple[int, int], set[tuple[int, int]]] = {}
        for width in self.widths:
            h, document, at = window_hashes(words, first, width)
            a, b = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
            n = b - a
            gram = np.repeat(np.arange(len(h)), n)
            entry = np.arange(len(gram)) - np.repeat(np.cumsum(n) - n, n) + a[gram]
            key = document[gram].astype(np.int64) * len(self.names) + self.template[entry]
            _, place, times = np.unique(key, return_inverse=True, return_counts=True)
            enough = times[place] >= self.least[self.template[entry]]
            gram, entry = gram[enough], entry[enough]
            for g, e in zip(gram.tolist(), entry.tolist(), strict=True):
                found.setdefault((int(document[g]), int(self.template[e])), set()).add((int(at[g] - self.at[e]), int(at[g])))
        return [
            (*key, low, high)
            for key, hits in sorted(found.items())
            for low, high, n in chains(sorted(hits), len(self.words[key[1]]))
            if n >= self.least[key[1]]
        ]


def chains(hits: list[tuple[int, int]], length: int) -> list[tuple[int, int, int]]:
    """First and last diagonal, and number of hits, of each chain of hits (diagonal, text word), sorted, of a template of ``length`` words.

    A segment continues the one before that gives the longest chain: it begins and ends later in the text and in the
    template. Every segment is in one chain at least.
    """
    segments: list[list[tuple[int, int]]] = []
    for x in hits:
        if not segments or x[0] - segments[-1][-1][0] > min(BAND, length // 2):
            segments.append([])
        segments[-1].append(x)
    # text begin and end, template begin and end, first and last diagonal, hits
    spans = sorted((min(a for _, a in s), max(a for _, a in s), min(a - d for d, a in s), max(a - d for d, a in s), s[0][0], s[-1][0], len(s)) for s in segments)
    score, before = [s[6] for s in spans], [-1] * len(spans)
    for j, y in enumerate(spans):
        for i in range(j - 1, -1, -1):
            x = spans[i]
            if y[0] - x[0] > length + GAP:
                break
            if all(x[e] < y[e] for e in range(4)) and abs(y[4] - x[5]) <= GAP and score[i] + y[6] > score[j]:
                score[j], before[j] = score[i] + y[6], i
    out, used = [], set()
    for j in sorted(range(len(spans)), key=lambda j: (-score[j], j)):
        if j in used:
            continue
        low, high, n = spans[j][4], spans[j][5], score[j]
        while j >= 0:
            used.add(j)
            low, high = min(low, spans[j][4]), max(high, spans[j][5])
            j = before[j]
        out.append((low, high, n))
    return out


def _span_text(data: np.ndarray, offsets: np.ndarray, document: int, start: int, end: int) -> str:
    """Text of a span and of what hangs on to its last word, as in ``GPL-2.0-only``."""
    rest = bytes(data[end : min(end + 64, int(offsets[document + 1]))]).split(maxsplit=1)
    hangs = rest[0] if rest and not bytes(data[end : end + 1]).isspace() else b""
    return (bytes(data[start:end]) + hangs).decode("utf-8", "ignore")


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row a match: doc_id, license, coverage, n_matched, start_word, end_word, start_char, end_char, matched.

    ``coverage`` is the share of the template's words matched in order, from ``min_coverage`` on. Of matches that
    overlap in a text, the one with most matched words stays, less the template's unmatched ones and a quarter of the
    span's (ties: by name).
    Words inserted into a template, or left out of it, up to GAP in one place, do not hide it, but a notice that names
    another version or a sister license is not one of the template; ``GPL``, ``LGPL`` and ``AGPL`` alone are families
    named without a known version, ``SPDX-...`` tags (of joined ones, the first), ``...-whole`` whole texts. Characters are code points; ``matched`` is the text of the span. Null or empty texts and empty tables give
    no rows; null ids and repeated rows stay as they are.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates))
    names = ["doc_id", "license", "coverage", "n_matched", "start_word", "end_word", "start_char", "end_char", "matched"]
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows = []
            for row, _, data, offsets in text_chunks(batch["text"]):
                low = lower_ascii(data)
                starts, ends, first = _spans(low, offsets)
                words = span_hashes(low, starts, ends)
                matches: dict[int, list[tuple]] = {}
                for document, t, low_start, high_start in index.candidates(words, first):
                    low_word, high_word = first[document] + low_start - BAND, first[document] + high_start + len(index.words[t]) + BAND
                    begin, end = max(low_word, first[document]), min(high_word, first[document + 1])
                    pad = np.zeros(begin - low_word, np.uint64)  # before the text's first word: matches nothing
                    k, a, b = align(index.words[t], np.concatenate([pad, words[begin:end]]), high_start - low_start + 2 * BAND + 1, BAND)
                    if k >= min_coverage * len(index.words[t]) and decided(index.deciding[t], len(index.words[t]), _span_text(data, offsets, document, starts[low_word + a], ends[low_word + b - 1])):
                        matches.setdefault(document, []).append((2 * k - len(index.words[t]) - (b - a - k) / 4, k, index.names[t], low_word + a, low_word + b, len(index.words[t])))
                for document, found in sorted(matches.items()):
                    kept: list[tuple] = []
                    for x in sorted(set(found), key=lambda x: (-x[0], -x[1], x[2], x[3])):
                        if all(x[4] <= y[3] or y[4] <= x[3] for y in kept):
                            kept.append(x)
                    low_byte = offsets[document]
                    for _, k, name, a, b, n in sorted(kept, key=lambda x: x[3]):
                        head, body = bytes(data[low_byte : starts[a]]).decode(), bytes(data[starts[a] : ends[b - 1]]).decode()
                        rows.append((batch["doc_id"][row + document].as_py(), name, k / n, k, int(a - first[document]), int(b - first[document]), len(head), len(head) + len(body), body))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    return spread(rows).mapInArrow(tidy(scan), "doc_id long, license string, coverage double, n_matched long, start_word long, end_word long, start_char long, end_char long, matched string")
