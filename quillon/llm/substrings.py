"""Removal of repeated substrings: every byte of a 50-byte string that also starts in a document with a smaller id.

Which strings repeat is decided on a Burrows-Wheeler transform. Suffixes are put in order by prefix doubling, until no two are equal; the
symbols before them are the transform. Breadth-first backward extension from the empty string visits intervals of equal prefixes by
increasing length; the first interval to end at a place of the order gives the common prefix there. The search stops at the minimum
length, so that what is still open then parts no two strings that agree on 50 bytes: these are one class, and its least id is what each of
its strings is held against. Only texts that may hold a repeat are transformed:

1. Documents are packed once, compressed, into *units* of a few megabytes, written to the shared folder. All later steps deal in units.
2. Every 50-byte string has an anchor, the least hash of its 20-byte strings, and equal strings have equal anchors. Strings in a row with
   one anchor form a *run*. Units send each distinct anchor once, with a count; a shuffle by anchor finds those in two documents or more.
3. Units join their repeated anchors and send the text of those runs to the shuffle by anchor. Equal runs, found by a hash and then
   compared byte by byte, are sent once, with their least id, and enter the transform once. A task transforms all its runs in blocks of
   bounded size, runs of one anchor together. Runs of a very frequent anchor are sent string by string and dealt by the string instead, so
   that no anchor fills a task.
4. The strings found go back to their units, which count and hash what stays of each document.

Buckets of the shuffle are as many as the input asks for, and each is held alone, one after another where a task has several.

Defined results: null and empty texts have no bytes; rows of one id never remove each other's bytes, repeated rows get equal results; rows with
a null id keep all bytes and remove none; matches don't cross documents; other columns are ignored. Ids are whole numbers; other types are
refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, columns, written

LEAST, GRAM = 50, 20
WINDOW = LEAST - GRAM + 1
UNIT_BYTES, BUCKET_BYTES, BLOCK_BYTES, SLICE = 4 << 20, 4 << 20, 1 << 18, 1 << 18
#: Tasks of a shuffle at most; beyond, a task has several buckets.
MOST_PARTS = 1 << 15
#: Runs of an anchor in the corpus beyond which they are sent string by string.
FREQUENT = 2000
U = np.uint64
_P = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_BASE = U(0x2545F4914F6CDD1D)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * _P[3]
    return x ^ (x >> U(29))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of ranges, one range after another."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


class Unit:
    """The documents of a unit: ids, known (whether the id is not null), bytes one after another."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, data: bytes):
        self.ids, self.known, self.lengths, self.data = ids, known, lengths, data
        self.bytes = np.frombuffer(data, np.uint8)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    @classmethod
    def of(cls, row) -> Unit:
        return cls(np.frombuffer(row.ids, np.int64), np.frombuffer(row.known, np.bool_), np.frombuffer(row.lengths, np.int64), zstandard.decompress(row.data))

    def runs(self, hashed: bool) -> dict[str, np.ndarray]:
        """start, windows, anchor, doc of every run and, if asked for, a hash of its text."""
        parts = []
        n = len(self.bytes)
        for at in range(0, n - LEAST + 1, SLICE):
            b = self.bytes[at : at + SLICE + LEAST - 1].astype(U)
            h1 = b + U(1)
            h2 = h1[:-1] * _P[0] + h1[1:]
            h4 = h2[:-2] * _P[1] + h2[2:]
            h8 = h4[:-4] * _P[2] + h4[4:]
            h16 = h8[:-8] * _P[4] + h8[8:]
            m = _mixed(h16[: len(b) - GRAM + 1] * _P[5] + h4[16 : len(b) - GRAM + 17])
            for step in (1, 2, 4, 8):
                m = np.minimum(m[:-step], m[step:])
            m = np.minimum(m[: len(b) - LEAST + 1], m[WINDOW - 16 :])
            place = at + np.arange(len(m))
            doc = np.searchsorted(self.ends, place, side="right")
            good = (place + LEAST <= self.ends[doc]) & self.known[doc]
            new = good & np.r_[True, (m[1:] != m[:-1]) | ~good[:-1]]
            start = np.flatnonzero(new)
            stop = np.flatnonzero(good & np.r_[~good[1:] | new[1:], True]) + 1
            # A least hash is small, so it is mixed again (one to one): buckets are upper bits, and must be even.
            part = {"start": at + start, "windows": stop - start, "anchor": _mixed(m[start]), "doc": doc[start]}
            if hashed:
                power = np.full(len(h4), _BASE, U)
                power[0] = 1
                total = np.r_[U(0), np.cumsum(_mixed(h4) * np.cumprod(power, dtype=U), dtype=U)]
                inverse = np.full(len(h4), U(pow(int(_BASE), -1, 1 << 64)), U)
                inverse[0] = 1
                part["hash"] = (total[stop + LEAST - 4] - total[start]) * np.cumprod(inverse, dtype=U)[start]
            parts.append(part)
        if not parts:
            parts = [{"start": np.zeros(0, np.int64), "windows": np.zeros(0, np.int64), "anchor": np.zeros(0, U), "doc": np.zeros(0, np.int64), "hash": np.zeros(0, U)}]
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0] if k in parts[-1]}

    def sent(self, repeated: np.ndarray, frequent: np.ndarray, bits: int) -> dict[str, np.ndarray]:
        """Runs whose anchor is in repeated (its upper bits, sorted), those of frequent ones cut into single strings; and for each the
        place of its representative, the one of the smallest id with equal text."""
        r = self.runs(True)
        upper = r["anchor"] >> U(24 - bits)
        at = np.searchsorted(repeated, upper)
        there = (at < len(repeated)) & (repeated[np.minimum(at, len(repeated) - 1)] == upper) if len(repeated) else np.zeros(len(upper), bool)
        r = {k: v[there] for k, v in r.items()}
        often = frequent[at[there]] if len(repeated) else np.zeros(0, bool)
        if often.any():
            whole, cut = ({k: v[x] for k, v in r.items()} for x in (~often, often))
            n = cut["windows"]
            start = ranges(cut["start"], n)
            h = np.zeros(len(start), U)
            for c in range(LEAST):
                h = (h ^ self.bytes[start + c].astype(U)) * _P[c % 6]
                h ^= h >> U(31)
            single = {"start": start, "windows": np.ones(len(start), np.int64), "anchor": _mixed(h), "doc": np.repeat(cut["doc"], n), "hash": h}
            r = {k: np.concatenate([whole[k], single[k]]) for k in whole}
        ids = self.ids[r["doc"]]
        order = np.lexsort((r["start"], ids, r["hash"], r["windows"], r["anchor"]))
        same = np.zeros(len(order), bool)
        same[1:] = np.all([r[k][order][1:] == r[k][order][:-1] for k in ("anchor", "windows", "hash")], axis=0)
        first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))] if len(order) else order
        lead = np.empty(len(order), np.int64)
        lead[order] = first
        size = r["windows"] + LEAST - 1
        lead[unlike(self.bytes, r["start"], size, lead)] = -1
        lead = np.where(lead < 0, np.arange(len(lead)), lead)
        return r | {"id": ids, "lead": lead}


def unlike(text: np.ndarray, start: np.ndarray, size: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The runs whose bytes aren't those of their lead, which has the same size."""
    copies = np.flatnonzero(lead != np.arange(len(lead)))
    cuts, out, at = np.cumsum(size[copies]), [np.zeros(0, np.int64)], 0
    while at < len(copies):
        to = max(at + 1, int(np.searchsorted(cuts, (cuts[at - 1] if at else 0) + SLICE)))
        part = copies[at:to]
        n = size[part]
        differ = text[ranges(start[part], n)] != text[ranges(start[lead[part]], n)]
        out.append(part[np.logical_or.reduceat(differ, np.cumsum(n) - n)])
        at = to
    return np.concatenate(out)


def suffix_order(s: np.ndarray) -> np.ndarray:
    """The order of the rotations of s (symbols below 256; UTF-8 has fewer), by prefix doubling on those that aren't told apart yet."""
    n = len(s)
    k = s.astype(U)
    for width in (1, 2, 4):
        k = (k << U(8 * width)) | np.roll(k, -width)
    order = np.argsort(k)
    k = k[order]
    new = np.r_[True, k[1:] != k[:-1]]
    rank = np.empty(n, np.int64)  # the first place of the rotations that are equal so far
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = ~new | np.r_[~new[1:], False]
    at, width = order[tied], 8
    while len(at) and width < n:
        old = rank[at]
        key = (old.astype(U) << U(32)) | rank[(at + width) % n].astype(U)
        by = np.argsort(key)
        at, old, key = at[by], old[by], key[by]
        new = np.r_[True, key[1:] != key[:-1]]
        places = np.arange(len(at))
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], places, 0))
        rank[at] = old + np.maximum.accumulate(np.where(new, places, 0)) - group
        at = at[~new | np.r_[~new[1:], False]]
        width *= 2
    if len(at):  # rotations that are equal all round
        return np.argsort(rank, kind="stable")
    order[rank] = np.arange(n)
    return order


def repeated_prefixes(text: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """order, group: the positions of text (symbols, read in a circle) by their first ``least`` symbols, and for each place of the order the
    number of its class of equal first ``least`` symbols."""
    n = len(text)
    s = (np.cumsum(np.bincount(text) > 0) - 1)[text].astype(np.uint8)
    order = suffix_order(s)
    bwt = s[order - 1]
    by_symbol = np.argsort(bwt, kind="stable").astype(np.int32)  # places of the transform by symbol: the j-th is where the j-th suffix comes from
    back = np.empty(n, np.int32)
    back[by_symbol] = np.arange(n, dtype=np.int32)
    following, before = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    equal = np.diff(bwt[by_symbol]) == 0
    following[by_symbol[:-1][equal]] = by_symbol[1:][equal]
    before[by_symbol[1:][equal]] = by_symbol[:-1][equal]
    parted = np.zeros(n + 1, bool)  # whether the common prefix of a place and the one before is known, and so is shorter
    parted[[0, n]] = True
    lo, hi = np.zeros(1, np.int32), np.full(1, n, np.int32)
    for _ in range(least):
        size = hi - lo
        total = np.cumsum(size, dtype=np.int32)
        place = np.arange(total[-1], dtype=np.int32) + np.repeat(lo - (total - size), size)
        low, high = np.repeat(lo, size), np.repeat(hi, size)
        left = np.sort(back[place[before[place] < low]])  # first and last of each symbol in each interval
        right = np.sort(back[place[following[place] >= high]]) + 1
        new = ~parted[right]
        lo, hi = left[new], right[new]
        parted[hi] = True
        if not len(lo):
            break
    return order, np.cumsum(parted[:n]) - 1


def settled(anchor: np.ndarray, hash_: np.ndarray, windows: np.ndarray, ids: np.ndarray, offsets: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For every string of every run (one after another) whether a smaller id has it too."""
    n = len(anchor)
    base = np.cumsum(windows) - windows
    least = np.empty(int(windows.sum()), np.int64)
    order = np.lexsort((ids, hash_, windows, anchor))
    same = np.zeros(n, bool)
    same[1:] = np.all([k[order][1:] == k[order][:-1] for k in (anchor, windows, hash_)], axis=0)
    lead = np.empty(n, np.int64)
    lead[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(n)))] if n else order
    lead[unlike(text, offsets, windows + LEAST - 1, lead)] = -1
    lead = np.where(lead < 0, np.arange(n), lead)
    todo = order[lead[order] == order]  # each text once, with its least id, by anchor
    sizes, family = (windows + LEAST)[todo], anchor[todo]
    ends = np.r_[np.flatnonzero(family[1:] != family[:-1]) + 1, len(todo)]  # where runs of one anchor end
    at = 0
    while at < len(todo):
        to = int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK_BYTES)) + at + 1
        to = int(ends[np.searchsorted(ends, min(to, len(todo)))])
        part = todo[at:to]
        size = windows[part] + LEAST - 1
        start = np.cumsum(size + 1) - size - 1
        block = np.zeros(int((size + 1).sum()), np.int64)  # a mark after each run
        block[ranges(start, size)] = text[ranges(offsets[part], size)].astype(np.int64) + 1
        doc = np.full(len(block), np.iinfo(np.int64).max)
        mine = ranges(start, windows[part])
        doc[mine] = np.repeat(ids[part], windows[part])
        places, group = repeated_prefixes(block)
        by_class = np.minimum.reduceat(doc[places], np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))
        smallest = np.empty(len(block), np.int64)
        smallest[places] = by_class[group]
        least[ranges(base[part], windows[part])] = smallest[mine]
        at = to
    return least[ranges(base[lead], windows)] < np.repeat(ids, windows)


def _one_by_one(run):
    """Of a partition whose rows are sorted by bucket, each bucket whole."""

    def all_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for bucket, part in batch.groupby("bucket", sort=True):
                if held and held[-1]["bucket"].iloc[0] != bucket:
                    yield run(pd.concat(held, ignore_index=True))
                    held = []
                held.append(part)
        if held:
            yield run(pd.concat(held, ignore_index=True))

    return all_


def _split(buckets: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    cuts = np.searchsorted(buckets, np.arange(n + 1))
    for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
        yield int(k), slice(cuts[k], cuts[k + 1])


def packed(docs: DataFrame, id_col: str, text_col: str, unit_bytes: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, known, texts, size, n = [], [], [], 0, 0
        part = TaskContext.get().partitionId() << 32

        def row() -> pd.DataFrame:
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            return pd.DataFrame([(part + n, size, np.array(ids, np.int64).tobytes(), np.array(known, np.bool_).tobytes(), lengths.tobytes(), zstandard.compress(b"".join(texts), 3))], columns=["unit", "bytes", "ids", "known", "lengths", "data"])

        for batch in batches:
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                missing = pd.isna(doc)
                ids.append(0 if missing else int(doc))
                known.append(not missing)
                texts.append((text or "").encode())
                size += len(texts[-1])
                if size >= unit_bytes or len(texts) >= 1 << 16:
                    yield row()
                    ids, known, texts, size, n = [], [], [], 0, n + 1
        if texts:
            yield row()

    kind = dict(docs.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is {kind}; ids are whole numbers")
    rows = columns(docs, id=id_col, text=text_col).select(F.col("id").cast("long").cast("string").alias("id"), "text")
    return written(rows.mapInPandas(run, "unit long, bytes long, ids binary, known binary, lengths binary, data binary"), "units")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int = UNIT_BYTES, with_spans: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, spans (array of starts and ends, in bytes) and kept (binary) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    units = packed(docs, id_col, text_col, unit_bytes)
    total = units.agg(F.sum("bytes")).first()[0] or 0
    bits = int(np.clip((total // BUCKET_BYTES).bit_length(), 2, 22))
    shift, low = U(64 - bits), U((1 << 40) - 1)
    link = "unit long, bucket int, data binary"

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                u = Unit.of(r)
                runs = u.runs(False)
                upper = runs["anchor"] >> U(24 - bits)
                ids = u.ids[runs["doc"]]
                order = np.lexsort((ids, upper))
                upper, ids = upper[order], ids[order]
                new = np.flatnonzero(np.r_[True, upper[1:] != upper[:-1]]) if len(upper) else np.zeros(0, np.int64)
                n = np.diff(np.r_[new, len(upper)])
                two = ids[new + n - 1] != ids[new] if len(new) else np.zeros(0, bool)
                value = upper[new]
                row = np.empty((len(value), 6), np.uint8)
                row[:, :5] = (value & low).view(np.uint8).reshape(-1, 8)[:, :5]
                row[:, 5] = np.minimum(n, 127) | two.astype(np.int64) << 7
                yield pd.DataFrame([(r.unit, k, row[at].tobytes()) for k, at in _split(value >> U(40), 1 << bits)], columns=["unit", "bucket", "data"])

    def common(group: pd.DataFrame) -> pd.DataFrame:
        rows = [np.frombuffer(d, np.uint8).reshape(-1, 6) for d in group["data"]]
        cuts = np.r_[0, np.cumsum([len(r) for r in rows])]
        both = np.concatenate(rows)
        wide = np.zeros((len(both), 8), np.uint8)
        wide[:, :5] = both[:, :5]
        _, at, n = np.unique(wide.view(U).ravel(), return_inverse=True, return_counts=True)
        two = np.bincount(at, weights=both[:, 5] >> 7) > 0
        often = np.bincount(at, weights=both[:, 5] & 127) > frequent
        keep = ((n > 1) | two)[at]
        out = np.concatenate([both[:, :5], often[at, None].astype(np.uint8)], axis=1)
        bucket = int(group["bucket"].iloc[0])
        mine = (out[a:b][keep[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        return pd.DataFrame([(int(unit), bucket, data) for unit, data in zip(group["unit"], mine, strict=True) if data], columns=["unit", "bucket", "data"])

    def known(links: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The unit's repeated anchors and which of them are frequent."""
        links = links.sort_values("bucket")
        value, often = [np.zeros(0, U)], [np.zeros(0, bool)]
        for bucket, data in zip(links["bucket"], links["data"], strict=True):
            x = np.frombuffer(data, np.uint8).reshape(-1, 6)
            wide = np.zeros((len(x), 8), np.uint8)
            wide[:, :5] = x[:, :5]
            value.append(wide.view(U).ravel() | (U(bucket) << U(40)))
            often.append(x[:, 5] > 0)
        return np.concatenate(value), np.concatenate(often)

    def send(unit: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(unit) and len(links):
            row = next(unit.itertuples(index=False))
            u = Unit.of(row)
            r = u.sent(*known(links), bits)
            lead = np.flatnonzero(r["lead"] == np.arange(len(r["lead"])))
            lead = lead[np.argsort(r["anchor"][lead], kind="stable")]
            for k, at in _split(r["anchor"][lead] >> shift, 1 << bits):
                x = lead[at]
                text = u.bytes[ranges(r["start"][x], r["windows"][x] + LEAST - 1)]
                head = np.array([len(x)], np.int64)
                rows.append((row.unit, k, zstandard.compress(b"".join(a.tobytes() for a in (head, r["anchor"][x], r["hash"][x], r["windows"][x], r["id"][x], x, text)), 1)))
        return pd.DataFrame(rows, columns=["unit", "bucket", "data"])

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        parts, texts, cuts, at = [], [], [0], 0
        for data in group["data"]:
            data = zstandard.decompress(data)
            n = int(np.frombuffer(data, np.int64, 1)[0])
            anchor, hash_ = (np.frombuffer(data, U, n, 8 + 8 * n * i) for i in (0, 1))
            windows, ids, place = (np.frombuffer(data, np.int64, n, 8 + 8 * n * i) for i in (2, 3, 4))
            size = windows + LEAST - 1
            parts.append((anchor, hash_, windows, ids, place, at + np.cumsum(size) - size))
            texts.append(np.frombuffer(data, np.uint8, offset=8 + 40 * n))
            cuts.append(cuts[-1] + n)
            at += len(texts[-1])
        anchor, hash_, windows, ids, place, offsets = (np.concatenate(x) for x in zip(*parts, strict=True))
        found = settled(anchor, hash_, windows, ids, offsets, np.concatenate(texts))
        base = np.cumsum(windows) - windows
        some = np.add.reduceat(found, base) > 0
        rows = []
        for k, unit in enumerate(group["unit"]):
            x = cuts[k] + np.flatnonzero(some[cuts[k] : cuts[k + 1]])
            if len(x):
                n = windows[x]
                flags = np.packbits(found[ranges(base[x], n)])
                rows.append((int(unit), -1, np.array([len(x)], np.int64).tobytes() + place[x].tobytes() + n.tobytes() + flags.tobytes()))
        return pd.DataFrame(rows, columns=["unit", "bucket", "data"])

    def results(unit: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in unit.itertuples(index=False):
            u = Unit.of(row)
            begins = np.zeros(len(u.bytes), np.bool_)
            r = u.sent(*known(links[links["bucket"] >= 0]), bits)
            if len(r["lead"]):
                n = r["windows"]
                base = np.cumsum(n) - n
                flags = np.zeros(int(n.sum()), bool)
                for data in links.loc[links["bucket"] < 0, "data"]:
                    m = int(np.frombuffer(data, np.int64, 1)[0])
                    place, size = np.frombuffer(data, np.int64, m, 8), np.frombuffer(data, np.int64, m, 8 + 8 * m)
                    flags[ranges(base[place], size)] = np.unpackbits(np.frombuffer(data, np.uint8, offset=8 + 16 * m), count=int(size.sum()))
                lead = r["lead"]
                begins[ranges(r["start"], n)] = np.where(np.repeat(r["id"] > r["id"][lead], n), True, flags[ranges(base[lead], n)])
            place = np.arange(len(begins), dtype=np.int32)
            gone = place - np.maximum.accumulate(np.where(begins, place, np.int32(-LEAST))) < LEAST if len(begins) else begins
            for doc, is_known, s, e in zip(u.ids, u.known, u.starts, u.ends, strict=True):
                g = gone[s:e]
                removed = int(g.sum())
                d = np.diff(np.r_[0, g.astype(np.int8), 0]) if removed else np.zeros(0, np.int8)
                kept = u.bytes[s:e][~g].tobytes() if removed else u.data[s:e]
                more = (np.stack([np.flatnonzero(d == 1), np.flatnonzero(d == -1)], axis=1).ravel().astype(np.int32), kept) if with_spans else ()
                rows.append((int(doc) if is_known else None, int(e - s), removed, int((d == 1).sum()), hashlib.sha256(kept).hexdigest(), *more))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans", "kept"] * with_spans
        return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    def dealt(rows: DataFrame, by_bucket) -> DataFrame:
        parts = min(1 << bits, MOST_PARTS)
        return rows.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket").mapInPandas(_one_by_one(by_bucket), link)

    found = units.select("unit", "ids", "known", "lengths", "data").mapInPandas(anchors, link)
    repeated = written(dealt(found, common), "anchors")
    whole = units.select("unit", "ids", "known", "lengths", "data")
    sent = whole.groupBy("unit").cogroup(repeated.groupBy("unit")).applyInPandas(send, link)
    decided = dealt(sent, decide)
    more = ", spans array<int>, kept binary" if with_spans else ""
    return whole.groupBy("unit").cogroup(repeated.unionByName(decided).groupBy("unit")).applyInPandas(results, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g HAVING count(*) > 1),
m AS (SELECT doc_id, i FROM w JOIN f USING (g) WHERE doc_id > first),
b AS (SELECT doc_id, i, max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m),
r AS (SELECT doc_id, i, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b),
s AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY doc_id, k),
p AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed FROM s GROUP BY doc_id),
gaps AS (
  SELECT doc_id, a, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s
  UNION ALL SELECT doc_id, len(h) // 2, coalesce(last, 0) FROM d LEFT JOIN (SELECT doc_id, max(z) AS last FROM s GROUP BY doc_id) USING (doc_id)
),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS hexed FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(hexed)) AS kept_sha256
FROM d LEFT JOIN p USING (doc_id) JOIN kept USING (doc_id)
"""
