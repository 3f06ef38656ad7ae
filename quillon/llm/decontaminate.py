"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and items are normalised alike: A-Z become lower case, every ASCII character but letters and digits separates words, all else
belongs to words. Every run of 13 consecutive words of an item (all words of a shorter item) is a window; the automaton holds each
window once, between spaces, with the items it stands for, and reads the normalised text of a document once. Word offsets map what it
finds back to the original text.

Scale: the automaton goes to every Python worker, so its size is measured first (characters of all windows). Beyond
``max_automaton_chars`` the items are dealt into so many blocks, each with an automaton of its own; documents then pass once for each
block and carry what is hit so far along, written to the shared folder between passes. Documents are never shuffled.

Defined results: a null text or one without words has no words, is not hit and not contaminated; an item without words, or with a
null id or text, has no window; items that share a window are all reported, repeated items once; repeated documents give repeated rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, columns, unused, written

WINDOW = 13
#: Characters of windows in one automaton, at some 50 bytes each.
MAX_AUTOMATON_CHARS = 4_000_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def windows_of(text: str | None, width: int = WINDOW) -> list[bytes]:
    w = words_of(text)
    return [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []


class Automaton:
    """All windows of some items; finds them in a text."""

    def __init__(self, items: list[tuple[str, str]], width: int = WINDOW):
        held: dict[str, tuple[int, set[str]]] = {}
        for item, text in items:
            for window in windows_of(text, width):
                key = f" {window.decode()} "
                held.setdefault(key, (key.count(" ") - 1, set()))[1].add(item)
        self.trie = ahocorasick.Automaton()
        for key, (n, names) in held.items():
            self.trie.add_word(key, (n, tuple(names)))
        self.empty = not held
        if held:
            self.trie.make_automaton()

    def find(self, text: str | None) -> tuple[int, list[tuple[int, int, tuple[str, ...]]]]:
        """Number of words, and (first word, end word, items) of every window that occurs."""
        words = words_of(text)
        if self.empty or not words:
            return len(words), []
        norm = f" {b' '.join(words).decode()} "
        found = list(self.trie.iter(norm))
        if not found:
            return len(words), []
        spaces = np.flatnonzero(np.frombuffer(norm.encode("utf-32-le"), np.uint32) == 32)
        ends = np.searchsorted(spaces, [at for at, _ in found])  # the match ends with the space after its last word
        return len(words), [(int(e) - n, int(e), names) for e, (_, (n, names)) in zip(ends, found, strict=True)]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Code-point offsets of the words in the original text."""
    return [m.span() for m in _WORD.finditer(text)]


_cache: dict[tuple, Automaton] = {}


def _automaton(key: tuple, items: list[tuple[str, str]], width: int) -> Automaton:
    """Built once in each Python worker."""
    if key not in _cache:
        _cache.clear()
        _cache[key] = Automaton(items, width)
    return _cache[key]


def _marker(key: tuple, shared, width: int):
    """(texts, what is found so far) -> what is found with the items of this block too."""

    def run(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(key, shared.value, width)
        for texts, before in batches:
            rows = []
            for text, runs, names in zip(texts, before["runs"], before["items"], strict=True):
                n, hits = automaton.find(text)
                runs = np.asarray(runs, np.int64).reshape(-1, 2)
                spans: list[int] = []
                if hits or len(runs):
                    both = merged([*map(tuple, runs.tolist()), *((s, e) for s, e, _ in hits)])
                    at = word_offsets(text)
                    spans = [x for s, e in both for x in (at[s][0], at[e - 1][1])]
                    rows.append((n, [x for r in both for x in r], spans, sorted({*names, *(i for *_, many in hits for i in many)})))
                else:
                    rows.append((n, [], spans, []))
            yield pd.DataFrame(rows, columns=["n_words", "runs", "spans", "items"])

    return run


def mark(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, max_automaton_chars: int = MAX_AUTOMATON_CHARS, to: str = "found") -> DataFrame:
    """docs with a struct column, named by ``to``: n_words, runs (first and end word, flat, merged), spans (start and end code point in the
    original, flat), items (sorted as strings). A column of docs of that name is replaced."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = columns(items, item=item_col, text=item_text_col).select(F.col("item").cast("string"), "text").dropna().distinct()
    chars = items.select(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars * width // max_automaton_chars))
    kind = "n_words long, runs array<int>, spans array<int>, items array<string>"
    out = docs.withColumn(to, F.expr("named_struct('n_words', 0L, 'runs', array(), 'spans', array(), 'items', array())").cast(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>"))
    for block in range(blocks):
        part = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()]
        part.sort()
        key = (width, hashlib.sha256(repr(part).encode()).hexdigest())
        shared = spark.sparkContext.broadcast(part)

        found = F.pandas_udf(_marker(key, shared, width), kind)
        out = out.withColumn(to, found(F.col(f"`{text_col}`"), F.col(to)))
        if block + 1 < blocks:
            out = written(out, "decontaminate")
    return out


def n_hit(found: str = "found"):
    return F.expr(f"aggregate(sequence(0, size({found}.runs) div 2 - 1), 0L, (n, i) -> n + {found}.runs[2 * i + 1] - {found}.runs[2 * i])")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The query's columns."""
    hit = F.when(F.size("found.runs") > 0, n_hit()).otherwise(F.lit(0).cast("long"))
    rows = mark(docs.select("doc_id", "text"), items).select("doc_id", F.col("found.n_words").alias("n_words"), hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", contaminated())


def contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs without the contaminated rows; the same columns."""
    names, to = docs.columns, unused(docs, "found")
    hit = F.when(F.size(f"{to}.runs") > 0, n_hit(to)).otherwise(F.lit(0).cast("long"))
    rows = mark(docs, items, text_col=text_col, to=to)
    return rows.where(~((hit > 0) & (20 * hit >= F.col(f"{to}.n_words")))).select(*[F.col(f"`{c}`") for c in names])


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
), widths AS (SELECT DISTINCT m FROM p),
s AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, widths WHERE len(w) >= m)
), hits AS (SELECT doc_id, s.m, i, item_id FROM s JOIN p ON s.g = p.g AND s.m = p.m),
cover AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hits) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN names USING (doc_id)
"""
