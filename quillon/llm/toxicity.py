"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; longer words are cut into pieces of 24 bytes, so that
nothing is left out. A word's input is its hashed embedding plus the mean of the hashed embeddings of its character 3-grams (with marks
for its ends). Windows of ``width`` words overlap by ``width - stride``; a window runs through a gated recurrent unit in both directions,
attention pools the states of its words, and a logistic unit scores it. A text's score is that of its worst window: all windows of a
text are scored, however long it is.

Training is multiple-instance: every window of a clean document is clean, of a toxic document the worst window is toxic. Labels are
noisy: words are hidden at random, and from the third epoch on toxic labels of texts that score low are left out. It runs on the driver
on a bounded sample of labelled rows: at most ``max_train_docs`` of them, chosen by the hash of the id, and of those, by the hash still, as
many as have ``max_train_bytes`` of text together; a single text over that bound is left out. Only those ids (a proven bound) are
broadcast to find their texts. The network has some 900,000 numbers, whatever the size of the corpus; scoring is one
narrow stage.

Defined results: null and empty texts have no words and get the score of an empty window, which is trained as clean; repeated rows are
scored alike; labels that are null are not learned from; an id labelled twice counts once, as toxic if either label is. Without any
labelled row every score is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, columns, crc_mod, gathered, sigmoid, unused

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
PIECE = 24


@dataclass(frozen=True)
class Settings:
    #: The bound of the sample that the network is fitted on, in documents and in bytes of text.
    max_train_docs: int = 4000
    max_train_bytes: int = 24_000_000
    words: int = 1 << 16
    grams: int = 1 << 13
    inputs: int = 12
    hidden: int = 8
    width: int = 32
    stride: int = 16
    epochs: int = 5
    batch: int = 32
    rate: float = 0.01
    #: Chance that a word is hidden in training; from the third epoch on, toxic labels whose text scores less are left out as noise.
    hide: float = 0.2
    trim: float = 0.2
    seed: int = 11


def words_of(text: str | None) -> list[bytes]:
    if not text:
        return []
    words = text.encode().translate(_TABLE).split()
    if max(map(len, words), default=0) > PIECE:
        words = [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    return words


def word_rows(words: list[bytes], words_mod: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % words_mod


def gram_rows(words: list[bytes], grams_mod: int) -> np.ndarray:
    """Flat rows of the 3-grams of each word between its marks; a word of n bytes has n of them."""
    b = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8)
    inside = (b[:-2] != 62) & (b[1:-1] != 62)  # no 3-gram runs over the mark at a word's end
    b = b.astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return ((h ^ (h >> np.uint32(15)))[inside] % np.uint32(grams_mod)).astype(np.int64)


def layout(n_words: list[int], width: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word (in the concatenation), length and text of each window; every text has one at least."""
    first, length, text, at = [], [], [], 0
    for t, n in enumerate(n_words):
        starts = range(0, max(1, n - width + stride), stride) if n > width else (0,)
        for s in starts:
            first.append(at + s)
            length.append(min(width, n - s))
            text.append(t)
        at += n
    return np.array(first, np.int64), np.array(length, np.int64), np.array(text, np.int64)


@dataclass
class Network:
    s: Settings
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, s: Settings) -> Network:
        r = np.random.default_rng(s.seed)
        e, h = s.inputs, s.hidden
        draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        p = {"word": draw(s.words, e, scale=0.1), "gram": draw(s.grams, e, scale=0.1)}
        for d in "fb":
            p |= {f"W{d}": draw(e, 3 * h, scale=e**-0.5), f"U{d}": draw(h, 3 * h, scale=h**-0.5), f"c{d}": np.zeros(3 * h, np.float32)}
        p |= {"A": draw(2 * h, h, scale=(2 * h) ** -0.5), "a": draw(h, scale=h**-0.5), "v": draw(2 * h, scale=(2 * h) ** -0.5), "o": np.zeros(1, np.float32)}
        return cls(s, p)

    def embed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of distinct words; their word rows, flat 3-gram rows, and how many 3-grams each has."""
        rows = word_rows(words, self.s.words)
        n = np.fromiter(map(len, words), np.int64, len(words))
        flat = gram_rows(words, self.s.grams)
        x = self.p["word"][rows]
        if len(words):
            x = x + np.add.reduceat(self.p["gram"][flat], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / n[:, None].astype(np.float32)
        return x, rows, flat, n

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"}

    def run(self, g: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Logits of windows; at: windows x width rows of g, mask: which of them are words. tape: gets what the backward pass needs."""
        b, width = at.shape
        h = self.s.hidden
        states = np.zeros((b, width, 2 * h), np.float32)
        for d, steps in (("f", range(width)), ("b", range(width - 1, -1, -1))):
            u, now, gd = self.p[f"U{d}"], np.zeros((b, h), np.float32), g[d]
            off = 0 if d == "f" else h
            for t in steps:
                x = gd[at[:, t]]
                zr = sigmoid32(x[:, : 2 * h] + now @ u[:, : 2 * h])
                r, z = zr[:, h:], zr[:, :h]
                rh = r * now
                c = np.tanh(x[:, 2 * h :] + rh @ u[:, 2 * h :])
                m = mask[:, t, None]
                after = now + m * (1 - z) * (c - now)
                if tape is not None:
                    tape[d, t] = (now, z, r, c, rh)
                now = after
                states[:, t, off : off + h] = now
        q = np.tanh(states @ self.p["A"])
        e = np.where(mask > 0, q @ self.p["a"], np.float32(-1e9))
        w = np.exp(e - e.max(axis=1, keepdims=True)) * mask
        w = w / np.maximum(w.sum(axis=1, keepdims=True), np.float32(1e-9))
        pooled = (w[:, :, None] * states).sum(axis=1)
        if tape is not None:
            tape["top"] = (states, q, w, pooled)
        return pooled @ self.p["v"] + self.p["o"][0]

    def back(self, tape: dict, at: np.ndarray, mask: np.ndarray, dlogit: np.ndarray, rows: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Gradients of the parameters above the inputs, and of the gates' rows."""
        states, q, w, pooled = tape["top"]
        h, width = self.s.hidden, at.shape[1]
        grad = {"v": pooled.T @ dlogit, "o": dlogit.sum(keepdims=True)}
        dpooled = dlogit[:, None] * self.p["v"]
        dstates = w[:, :, None] * dpooled[:, None, :]
        dw = (states * dpooled[:, None, :]).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=1, keepdims=True))
        dq = de[:, :, None] * self.p["a"] * (1 - q * q)
        grad["a"] = np.einsum("bt,bth->h", de, q)
        grad["A"] = np.einsum("bti,bth->ih", states, dq)
        dstates = dstates + dq @ self.p["A"].T
        dg = {}
        for d, steps in (("f", range(width - 1, -1, -1)), ("b", range(width))):
            u, off = self.p[f"U{d}"], 0 if d == "f" else h
            du, dnow, out = np.zeros_like(u), np.zeros((len(at), h), np.float32), np.zeros((rows, 3 * h), np.float32)
            for t in steps:
                before, z, r, c, rh = tape[d, t]
                m = mask[:, t, None]
                dh = dnow + dstates[:, t, off : off + h]
                dz = dh * m * (before - c) * z * (1 - z)
                dc = dh * m * (1 - z) * (1 - c * c)
                drh = dc @ u[:, 2 * h :].T
                dr = drh * before * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                du[:, : 2 * h] += before.T @ dzr
                du[:, 2 * h :] += rh.T @ dc
                np.add.at(out, at[:, t], np.concatenate([dzr, dc], axis=1))
                dnow = dh * (1 - m * (1 - z)) + drh * r + dzr @ u[:, : 2 * h].T
            grad[f"U{d}"], dg[d] = du, out
        return grad, dg

    def logits(self, texts: list[list[bytes]], most: int = 512) -> list[np.ndarray]:
        """Logits of all windows of each text."""
        distinct: dict[bytes, int] = {}
        ids = np.fromiter((distinct.setdefault(w, len(distinct)) for t in texts for w in t), np.int64)
        g = self.gates(self.embed(list(distinct))[0]) if distinct else {d: np.zeros((1, 3 * self.s.hidden), np.float32) for d in "fb"}
        ids = ids if len(ids) else np.zeros(1, np.int64)
        first, length, text = layout([len(t) for t in texts], self.s.width, self.s.stride)
        out = np.empty(len(first), np.float32)
        steps = np.arange(self.s.width)
        for i in range(0, len(first), most):
            at = ids[np.minimum(first[i : i + most, None] + steps, len(ids) - 1)]
            mask = (steps < length[i : i + most, None]).astype(np.float32)
            out[i : i + most] = self.run(g, at, mask)
        return np.split(out, np.searchsorted(text, np.arange(1, len(texts)))) if texts else []

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i in range(0, len(texts), 64):
            out[i : i + 64] = [x.max() for x in self.logits([words_of(t) for t in texts[i : i + 64]])]
        return sigmoid(out)


def sigmoid32(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def train(rows: list[tuple[str | None, int]], s: Settings) -> Network:
    """rows: texts and labels. Adam with a falling rate."""
    net = Network.fresh(s)
    one: dict[bytes, bytes] = {}  # equal words are held once
    texts = [[one.setdefault(w, w) for w in words_of(t)] for t, _ in rows] + [[]]
    y = np.array([label for _, label in rows] + [0], np.float32)
    r = np.random.default_rng(s.seed)
    m, v, step = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    steps = np.arange(s.width)
    for epoch in range(s.epochs):
        order = r.permutation(len(texts))
        for i in range(0, len(order), s.batch):
            part = order[i : i + s.batch]
            chosen, ys, ws = [], [], []
            for k, z in zip(part, net.logits([texts[j] for j in part]), strict=True):
                worst = int(z.argmax()) if epoch else int(r.integers(len(z)))
                take = {worst} if y[k] else {worst, int(z.argmax())}
                if epoch > 1 and y[k] and z.max() < np.log(s.trim / (1 - s.trim)):
                    continue
                for at in take:
                    chosen.append(texts[k][at * s.stride : at * s.stride + s.width])
                    ys.append(y[k])
                    ws.append(1 / len(take))
            if not chosen:
                continue
            distinct: dict[bytes, int] = {}
            at = np.zeros((len(chosen), s.width), np.int64)
            mask = np.zeros((len(chosen), s.width), np.float32)
            for j, words in enumerate(chosen):
                at[j, : len(words)] = [distinct.setdefault(w, len(distinct)) for w in words]
                mask[j, : len(words)] = r.random(len(words)) >= s.hide
            distinct = distinct or {b"-": 0}
            x, at_words, flat, n = net.embed(list(distinct))
            tape: dict = {}
            z = net.run(net.gates(x), at, mask, tape)
            dz = ((sigmoid(z) - np.array(ys)) * np.array(ws) / len(part)).astype(np.float32)
            grad, dg = net.back(tape, at, mask, dz, len(distinct))
            dx = np.zeros_like(x)
            for d in "fb":
                grad[f"W{d}"], grad[f"c{d}"] = x.T @ dg[d], dg[d].sum(axis=0)
                dx += dg[d] @ net.p[f"W{d}"].T
            grad["word"], grad["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(grad["word"], at_words, dx)
            np.add.at(grad["gram"], flat, np.repeat(dx / n[:, None].astype(np.float32), n, axis=0))
            step += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.p[k] = (net.p[k] - s.rate * (1 - epoch / s.epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings | None = None) -> Network | None:
    """A network from a bounded sample of the labelled documents, a quarter of it toxic where there are so many; None without any."""
    s = settings or Settings()
    spark = docs.sparkSession
    known = columns(labels, id=id_col, y=label_col).dropna().groupBy("id").agg(F.max("y").cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    toxic = min(n.get(1, 0), s.max_train_docs // 4)
    most = {1: toxic, 0: s.max_train_docs - toxic}
    scale = 1 << 30
    h = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(scale))
    share = {y: min(scale, int(scale * most[y] / max(1, n.get(y, 0)))) for y in (0, 1)}
    chosen = known.where(((F.col("y") == 1) & (h < share[1])) | ((F.col("y") == 0) & (h < share[0])))
    picked = [(r["id"], r["y"]) for r in chosen.orderBy(h, "id").limit(2 * s.max_train_docs).collect()]
    if not picked:
        return None
    ids = spark.createDataFrame(picked, chosen.schema)
    found = columns(docs, id=id_col, text=text_col).join(F.broadcast(ids), "id").withColumn("key", F.xxhash64("text")).withColumn("h", h)
    sizes = found.groupBy("h", "id", "key").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"))
    kept, size = [], 0
    for r in sizes.where(F.col("n") <= s.max_train_bytes).orderBy("h", "id", "key").limit(4 * s.max_train_docs).collect():
        size += r["n"]
        if size > s.max_train_bytes:
            break
        kept.append((r["id"], r["key"]))
    read = F.broadcast(spark.createDataFrame(kept, sizes.select("id", "key").schema))
    rows = [(r["id"], r["text"], r["y"]) for r in gathered(found.join(read, ["id", "key"]).dropDuplicates(["id", "key"]))]
    rows.sort(key=lambda x: (x[0], x[1] or ""))
    return train([(t, y) for _, t, y in rows], s)


def score(docs: DataFrame, net: Network | None, *, text_col: str = "text", to: str = "score") -> DataFrame:
    """docs with a column of scores; a column of that name is replaced."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = shared.value
        for texts in batches:
            yield pd.Series(net.score(texts.tolist()) if net else np.zeros(len(texts)))

    return docs.withColumn(to, run(F.col(f"`{text_col}`")))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns: learns where crc32 of the id, modulo 5, is not 0, and scores every row."""
    net = fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    rows = score(docs.select("doc_id", "text"), net)
    return rows.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs without the rows that score 0.5 or more; the same columns."""
    names = docs.columns
    net = fit(docs, labels.where(crc_mod("doc_id", 5) != 0), text_col=text_col)
    to = unused(docs, "_toxicity")
    return score(docs, net, text_col=text_col, to=to).where(F.col(to) < 0.5).select(*[F.col(f"`{c}`") for c in names])
