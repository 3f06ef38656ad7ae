"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Letters are lower-cased and every run of other characters becomes one space; 1- to 3-grams of code points are hashed to a fixed number
of features. Document frequencies count every training document of the corpus in one pass (each task adds up its own, then a shuffle of
at most ``n_features`` rows a task). Weights are fitted on the driver by follow-the-regularised-leader (FTRL-proximal) with an L1 and an
L2 penalty, which leaves most of them exactly zero, on a bounded sample of the training documents: at most ``max_train_docs``, chosen by
the hash of the id, so the choice doesn't depend on partitioning. Half of the sample is open to all languages alike, the rest goes by
their numbers of labelled rows, so that every language is learned. A fifth of each language's sample is kept from the weights and sets the
temperature. The model that goes to the workers is languages x features numbers, whatever the size of the corpus.

Defined results: null texts and texts without a letter get ``und`` and score 0; so does every text where nothing could be learned (no
labelled document). Rows with a null id are not held out and not learned from; repeated rows are scored alike; whole texts count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, columns, crc_mod, gathered

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    n_features: int = 1 << 15
    #: The bound of the sample that weights are fitted on, in documents and in features that occur in them.
    max_train_docs: int = 6000
    max_train_entries: int = 12_000_000
    epochs: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point its lower case if that is one letter, itself if it is a letter, else a space."""
    if not _letters:
        out = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            if (c := chr(i)).isalpha():
                out[i] = ord(low) if len(low := c.lower()) == 1 else i
        _letters.append(out)
    return _letters[0]


def features(text: str | None, n: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Features and counts; None for a text without a letter."""
    if not text:
        return None
    a = letters()[np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)]
    space = a == 32
    if space.all():
        return None
    a = a[~(space & np.roll(space, 1)) | (np.arange(len(a)) == 0)]
    one = a * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + a[1:] * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0x27D4EB2F) + a[2:] * np.uint32(0x165667B1)
    shift = np.uint32(32 - n.bit_length() + 1)
    counts = np.zeros(n, np.int64)
    for h in (one, two * np.uint32(0x9E3779B1), three * np.uint32(0x9E3779B1)):
        counts += np.bincount(h >> shift, minlength=n)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf[at]
    return (v / np.sqrt(v @ v)).astype(np.float32) if len(v) and v.any() else np.zeros(len(v), np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, s: Settings, seed: int = 7) -> np.ndarray:
    """Weights, features x classes."""
    z = np.zeros((s.n_features, classes))
    n = np.zeros((s.n_features, classes))

    def at(idx: np.ndarray) -> np.ndarray:
        zi = z[idx]
        return np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n[idx])) / s.alpha + s.l2))

    order = np.random.default_rng(seed)
    for _ in range(s.epochs):
        for i in order.permutation(len(rows)):
            idx, val, y = rows[i]
            w = at(idx)
            p = softmax(val @ w)
            p[y] -= 1
            g = val[:, None] * p
            step = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / s.alpha
            z[idx] += g - step * w
            n[idx] += g * g
    return at(np.arange(s.n_features)).astype(np.float32)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm; 1 where there is nothing to fit."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean())

    lo, hi, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    settings: Settings

    def predict(self, text: str | None) -> tuple[str, float]:
        found = features(text, self.settings.n_features)
        if found is None or not self.langs:
            return UNDETERMINED, 0.0
        at, counts = found
        p = softmax(weighted(at, counts, self.idf) @ self.weights[at] / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def quotas(labelled: dict[str, int], most: int) -> dict[str, int]:
    """Documents to draw of each language: as many of all where there are few, half of ``most`` in equal parts, the rest in proportion."""
    floor = max(1, most // (2 * max(1, len(labelled))))
    base = {lang: min(n, floor) for lang, n in labelled.items()}
    left, more = max(0, most - sum(base.values())), max(1, sum(labelled.values()) - sum(base.values()))
    return {lang: base[lang] + min(n - base[lang], left * (n - base[lang]) // more) for lang, n in labelled.items()}


def within(rows: list, quota: dict[str, int], most_entries: int) -> list[tuple]:
    """Rows (h, id, lang, key, entries) by hash: the quota of each language, all languages cut alike where the entries pass the bound."""
    nth: dict[str, int] = {}
    ranked = []
    for h, i, lang, key, entries in sorted(map(tuple, rows)):
        nth[lang] = nth.get(lang, 0) + 1
        if nth[lang] <= quota[lang]:
            ranked.append((nth[lang] > 1, nth[lang] / quota[lang], h, i, lang, key, entries))
    out, total = [], 0
    for *_, h, i, lang, key, entries in sorted(ranked):
        total += entries
        if total > most_entries:
            break
        out.append((h, i, lang, key))
    return out


def fit(train: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings | None = None) -> Model:
    """Document frequencies from every row of train, weights from a bounded sample of those with a language."""
    s = settings or Settings()
    bounded_batches(train.sparkSession)
    rows = columns(train, id=id_col, text=text_col, lang=lang_col)

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(s.n_features, np.int64), 0
        by: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                if found := features(text, s.n_features):
                    df[found[0]] += 1
                    n += 1
                    if lang is not None and lang != UNDETERMINED:
                        by[lang] = by.get(lang, 0) + 1
        at = np.flatnonzero(df)
        names = pd.Series([None] * (len(at) + 1) + list(by), dtype=object)
        yield pd.DataFrame({"feature": [*at, -1, *[-2] * len(by)], "lang": names, "n": [*df[at], n, *by.values()]})

    counted = rows.select("text", "lang").mapInPandas(frequencies, "feature int, lang string, n long").groupBy("feature", "lang").agg(F.sum("n").alias("n")).toPandas()
    labelled = {r.lang: int(r.n) for r in counted[counted["feature"] == -2].itertuples()}
    df = np.zeros(s.n_features)
    docs = int(counted.loc[counted["feature"] == -1, "n"].sum())
    held = counted[counted["feature"] >= 0]
    df[held["feature"]] = held["n"]
    idf = np.where(df > 0, np.log((1 + docs) / (1 + df)) + 1, 0)

    known = rows.where(F.col("lang").isNotNull() & (F.col("lang") != UNDETERMINED))
    scale = 1 << 30
    quota = quotas(labelled, s.max_train_docs)
    # Somewhat more than the quota, so that it is reached.
    shares = [(lang, min(scale, int(scale * (q + 4 * q**0.5 + 4) / labelled[lang]) + 1)) for lang, q in quota.items()]
    shares = F.broadcast(train.sparkSession.createDataFrame(shares, "lang string, share long"))
    drawn = known.join(shares, "lang").withColumn("h", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(scale))).where("h < share").withColumn("key", F.xxhash64("text"))

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(text, s.n_features) for text in batch["text"]]
            out = [(h, i, lang, k, len(f[0])) for h, i, lang, k, f in zip(batch["h"], batch["id"], batch["lang"], batch["key"], found, strict=True) if f]
            yield pd.DataFrame(out, columns=["h", "id", "lang", "key", "entries"])

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, h, text, lang in zip(batch["id"], batch["h"], batch["text"], batch["lang"], strict=True):
                if found := features(text, s.n_features):
                    out.append((str(key), h, lang, found[0].astype(np.uint32).tobytes(), found[1].astype(np.uint32).tobytes()))
            yield pd.DataFrame(out, columns=["id", "h", "lang", "at", "n"])

    known_as = ["h", "id", "lang", "key"]
    seen = drawn.select("h", F.col("id").cast("string").alias("id"), "lang", "key", "text").mapInPandas(lengths, "h long, id string, lang string, key long, entries long").groupBy(*known_as).agg(F.max("entries").alias("entries"))
    picked = within(seen.orderBy(*known_as).limit(4 * s.max_train_docs + 8 * len(quota)).collect(), quota, s.max_train_entries)
    ids = F.broadcast(train.sparkSession.createDataFrame([(h, i, lang, k) for h, i, lang, k in picked], "h long, id string, lang string, key long"))
    chosen = drawn.withColumn("id", F.col("id").cast("string")).join(ids, known_as).dropDuplicates(known_as)
    got = list(gathered(chosen.mapInPandas(sample, "id string, h long, lang string, at binary, n binary")))
    got.sort(key=lambda r: (r["h"], r["id"], r["lang"], bytes(r["at"])))
    langs = sorted({r["lang"] for r in got})
    data = [(at := np.frombuffer(r["at"], np.uint32), weighted(at, np.frombuffer(r["n"], np.uint32), idf), langs.index(r["lang"])) for r in got]
    kept, rest, nth = [], [], [0] * len(langs)
    for x in data:
        nth[x[2]] += 1
        (kept if nth[x[2]] % 5 else rest).append(x)
    weights = ftrl(kept or rest, len(langs), s) if langs else np.zeros((s.n_features, 0), np.float32)
    logits = np.array([v @ weights[at] for at, v, _ in rest]).reshape(len(rest), len(langs))
    return Model(langs, idf.astype(np.float32), weights, temperature(logits, np.array([y for *_, y in rest], int)), s)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of those names are replaced."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    p = docs.withColumn("lang_pred", run(F.col(f"`{text_col}`")))
    return p.withColumn("score", F.col("lang_pred.score")).withColumn("lang_pred", F.col("lang_pred.lang_pred"))


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: learns where crc32 of the id, modulo 3, is not 1, and scores every row."""
    rest = crc_mod("doc_id", 3)
    model = fit(docs.where(rest != 1))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
