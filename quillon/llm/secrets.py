"""Secret scan: fixed detectors, and a battery of randomness tests with length-aware false-discovery control.

Three detectors by pattern always report (kinds ``assign``, ``access``, ``hex``). The battery looks at every other long token: a run of
encoding symbols is split after each '=' that isn't padding, and of each piece the longest parts that one encoding holds are candidates,
for every encoding, so that NAME=VALUE, ?sig=VALUE and path/VALUE don't hide the value. It infers the candidate's encoding (hex, base32, base64, URL-safe base64) and asks how unlikely it is that a *patterned* string of that
length and alphabet (a word, a path, a counter) looks as random as this one does, by three tests:

* uniformity: under the patterned null the chi-squared statistic of the symbols against uniform frequencies is noncentral, with a
  noncentrality that grows with the length; the p-value is the lower tail.
* runs: patterned tokens change the class of symbol (lower, upper, digit) seldom; upper binomial tail of the observed changes. A change is
  the start of a word, capitalised or not, or of a number, so that camelCase, snake_case and numbered names count as patterned.
* serial correlation: patterned tokens have correlated neighbours; by Fisher's z, the chance of a correlation as near to zero.

Fisher's method combines the three. Within a document a weighted Benjamini-Hochberg step-up decides, with weights that rise with
the length and average 1, so that short tokens, for which the tests have little power, need smaller p-values. Candidates that overlap a
span of a detector aren't tested; those found that overlap each other are one span of kind ``random``.

Defined results: null text counts as empty and has no spans; each row is judged alone, so repeated rows give repeated results; other
columns are ignored. The plan is one narrow stage: no shuffle, no state beyond one Arrow batch.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, columns

# The detectors' patterns and least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

LEAST_TOKEN = 20
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PIECE = re.compile(r"[^=]+=*")
#: The symbols of each encoding below; a hex part has one case.
PARTS = tuple(map(re.compile, (r"[0-9a-f]{20,}", r"[0-9A-F]{20,}", r"[A-Z2-7]+=*", r"[A-Za-z0-9+/]+={0,2}", r"[A-Za-z0-9_-]+={0,2}")))
HAS_LETTER = re.compile(r"[A-Za-z]")
WORD = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]+|[a-z]|[0-9]+")
#: (name, members, alphabet) by increasing alphabet; a token has the first encoding that holds all its symbols.
ENCODINGS = (
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), "0123456789abcdef"),
    ("base32", re.compile(r"[A-Z2-7]+=*"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base64", re.compile(r"[A-Za-z0-9+/]+={0,2}"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", re.compile(r"[A-Za-z0-9_-]+={0,2}"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Patterned null: excess of squared frequencies over uniform a symbol, chance of a change of class, correlation of neighbours.
NULL_EXCESS, NULL_CHANGE, NULL_CORRELATION = 1.5, 0.12, 0.3


def _normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _noncentral_chi2_cdf(x: float, df: float, nc: float) -> float:
    """Sankaran's normal approximation."""
    if x <= 0:
        return 0.0
    m = df + nc
    h = 1 - 2 * m * (df + 3 * nc) / (3 * (df + 2 * nc) ** 2)
    p = (df + 2 * nc) / m**2
    c = (h - 1) * (1 - 3 * h)
    z = ((x / m) ** h - (1 + h * p * (h - 1 - 0.5 * (2 - h) * c * p))) / (h * math.sqrt(2 * p * (1 + 0.5 * c * p)))
    return _normal_cdf(z)


def _binomial_tail(n: int, p: float, k: int) -> float:
    """P(X >= k), summed from the largest term of the tail or of what is below it."""
    if not 0 < k <= n:
        return 1.0 if k <= 0 else 0.0
    above = k > n * p
    i = k if above else k - 1
    term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    total = 0.0
    while term > 1e-17 * total:
        total += term
        term *= (n - i) / (i + 1) * p / (1 - p) if above else i / (n - i + 1) * (1 - p) / p
        i += 1 if above else -1
    return min(1.0, total) if above else max(0.0, 1 - total)


def _chi2_tail_even(x: float, df: int) -> float:
    """P(X >= x) of a central chi-squared with an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, df // 2):
        term *= x / 2 / i
        total += term
    return math.exp(-x / 2) * total


def encoding_of(token: str) -> tuple[str, str] | None:
    """Name and alphabet, or None for numbers and where no encoding mixes kinds of symbols as the token does."""
    if not HAS_LETTER.search(token):
        return None
    for name, members, alphabet in ENCODINGS:
        if members.fullmatch(token):
            return name, alphabet
    return None


def randomness_p(token: str) -> float:
    """The chance that a patterned token of this length and encoding looks as random; 1 where no encoding fits."""
    found = encoding_of(token)
    if found is None:
        return 1.0
    name, alphabet = found
    body = token.rstrip("=")
    if name == "hex":
        body = body.lower()
    n, k = len(body), len(alphabet)
    if n < 8:
        return 1.0
    place = {c: i for i, c in enumerate(alphabet)}
    values = [place[c] for c in body]
    counts: dict[int, int] = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    chi2 = sum(c * c for c in counts.values()) * k / n - n
    p_uniform = _noncentral_chi2_cdf(chi2, k - 1, n * NULL_EXCESS)
    p_runs = _binomial_tail(n - 1, NULL_CHANGE, max(0, len(WORD.findall(body)) - 1))
    mean = sum(values) / n
    spread = sum((v - mean) ** 2 for v in values)
    r = sum((a - mean) * (b - mean) for a, b in zip(values, values[1:], strict=False)) / spread if spread else 1.0
    z = math.atanh(min(0.999, abs(r)))
    p_serial = _normal_cdf((z - math.atanh(NULL_CORRELATION)) * math.sqrt(max(1, n - 3)))
    fisher = -2 * sum(math.log(max(p, 1e-300)) for p in (p_uniform, p_runs, p_serial))
    return _chi2_tail_even(fisher, 6)


def discoveries(tokens: list[tuple[int, int, str]], q: float) -> list[tuple[int, int]]:
    """Spans kept by weighted Benjamini-Hochberg at level q."""
    if not tokens:
        return []
    power = [1 - math.exp(-(e - s) / 20) for s, e, _ in tokens]
    scale = len(tokens) / sum(power)
    ranked = sorted((randomness_p(t) / (w * scale), s, e) for (s, e, t), w in zip(tokens, power, strict=True))
    keep = 0
    for i, (p, _, _) in enumerate(ranked, 1):
        if p <= q * i / len(ranked):
            keep = i
    return sorted((s, e) for _, s, e in ranked[:keep])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the detectors by start, then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2], x[1]))


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of the parts of long tokens that some encoding holds, each once."""
    found = set()
    for m in TOKEN.finditer(text):
        for piece in PIECE.finditer(text, m.start(), m.end()):
            if piece.end() - piece.start() >= LEAST_TOKEN:
                for part in PARTS:
                    found |= {p.span() for p in part.finditer(text, *piece.span()) if p.end() - p.start() >= LEAST_TOKEN}
    return sorted(found)


def joined_up(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def all_spans(text: str, q: float, base: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
    base = base_spans(text) if base is None else base
    tokens = [(a, b, text[a:b]) for a, b in candidates(text) if HAS_LETTER.search(text, a, b) and not any(s < b and a < e for s, e, _ in base)]
    return sorted(base + [(s, e, 3) for s, e in joined_up(discoveries(tokens, q))], key=lambda x: (x[0], x[2], x[1]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", q: float = 1e-3) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base (string), spans (string) of every row; q: the false-discovery level."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                text = text or ""
                base = base_spans(text)
                spans = all_spans(text, q, base)
                n = [sum(k == i for _, _, k in spans) for i in range(4)]
                rows.append((*n, joined(base), joined(spans)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_random", "base", "spans"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    kind = dict(docs.dtypes)[id_col]
    return columns(docs, doc_id=id_col, text=text_col).mapInPandas(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_random long, base string, spans string")


def redact(docs: DataFrame, *, text_col: str = "text", mask: str = "[SECRET]", q: float = 1e-3) -> DataFrame:
    """docs with every span found replaced by the mask; null texts stay null, texts without a span stay as they are."""
    bounded_batches(docs.sparkSession)

    def clean(text: str | None) -> str | None:
        if not text or not (spans := all_spans(text, q)):
            return text
        parts, at = [], 0
        for s, e, _ in spans:
            if s >= at:
                parts += [text[at:s], mask]
            at = max(at, e)
        return "".join([*parts, text[at:]])

    masked = F.pandas_udf(lambda texts: texts.map(clean, na_action="ignore").astype(object), "string")
    return docs.withColumn(text_col, masked(F.col(f"`{text_col}`")))


def digest(found: DataFrame) -> DataFrame:
    """The query's columns."""
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random")
