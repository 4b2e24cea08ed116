"""Secret scans: patterns, and a battery of randomness tests with false-discovery control.

Patterns find assignments, access keys and long hexadecimal runs.  Beside them every long token is a candidate.  Its encoding (the
smallest alphabet that holds its characters) turns it into a row of symbols, which three tests hold against random symbols:
chi-squared for a uniform alphabet, runs above and below the alphabet's middle, and serial correlation.  Fisher's method combines them
to a p-value for "random symbols".

Long tokens of ordinary writing (letters of one case) show how uneven language is.  The excess of chi-squared over its degrees of
freedom, per symbol, does not depend on a token's length, and its spread falls with the root of the length: all such tokens of the
corpus give its mean and scale, and a candidate's place in that distribution is its p-value for "this is language".  Mean and scale are a median and a
median deviation, which secrets among these tokens hardly move; the tokens are candidates like all others.

Within each band of lengths the weighted procedure of Benjamini and Hochberg then accepts secrets at a bounded share of false discoveries: a
candidate's p-value for language is divided by its weight, which its combined p-value for random symbols sets (none where the battery
rejects random symbols outright, little where it nearly does), relative to the mean weight of the band.  Short tokens need to be more even than long ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesearch.llm.shared import durable, extended, whole_row

# Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
PIECE = re.compile(r"[A-Za-z0-9_-]{20,}={0,2}")
LANGUAGE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Alphabets, the smallest that holds a token is its encoding.
ENCODINGS = (
    ("dec", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("alpha", "abcdefghijklmnopqrstuvwxyz"),
    ("ALPHA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: First lengths of the bands.
BANDS = (20, 24, 32, 48, 64)
#: What language is taken to look like before the corpus has shown it: mean, scale, and for how many tokens this counts.
PRIOR = (0.7, 1.6, 10)
#: Combined p-values from which on a candidate has a weight, and the weights.
WEIGHTS = ((0.001, 0.1), (0.01, 0.5), (0.05, 1.0))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding(token: str) -> tuple[str, str] | None:
    used = set(token)
    return next(((name, a) for name, a in ENCODINGS if used <= set(a)), None)


def battery(token: str) -> tuple[float, float, int]:
    """(excess of chi-squared a symbol, combined p-value of "random symbols", size of the alphabet); no encoding: (inf, 0, 0)."""
    core = token.rstrip("=")
    found = encoding(core)
    if found is None:
        return math.inf, 0.0, 0
    alphabet = found[1]
    a, n = len(alphabet), len(core)
    x = [alphabet.index(c) for c in core]
    counts: dict[int, int] = {}
    for v in x:
        counts[v] = counts.get(v, 0) + 1
    df, chi = a - 1, sum(c * c for c in counts.values()) * a / n - n
    # Wilson and Hilferty's normal form of chi-squared.
    p_chi = normal_tail(((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = [v >= a / 2 for v in x]
    n1, runs = sum(high), 1 + sum(u != v for u, v in zip(high, high[1:]))
    if 0 < n1 < n:
        mean = 1 + 2 * n1 * (n - n1) / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * normal_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)  # all on one side
    m = sum(x) / n
    spread = sum((v - m) ** 2 for v in x)
    p_serial = 2 * normal_tail(abs(sum((u - m) * (v - m) for u, v in zip(x, x[1:])) / spread) * math.sqrt(n)) if spread else 0.0
    half = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))  # Fisher: twice this is chi-squared with 6 degrees of freedom
    return (chi - df) / (n - 1), min(1.0, math.exp(-half) * (1 + half + half * half / 2)), a


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, token) of the long tokens; one that no encoding holds, such as a key within a path, is cut at its / and +."""
    for m in CANDIDATE.finditer(text):
        if encoding(m[0].rstrip("=")) is not None:
            yield m.start(), m.end(), m[0]
        else:
            yield from ((m.start() + x.start(), m.start() + x.end(), x[0]) for x in PIECE.finditer(m[0]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches in a text, sorted."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    """(pattern spans, candidates); a candidate: start, end, band, language, statistic, p-value of random."""
    spans, found = base_spans(text), []
    if max(map(len, text.split()), default=0) >= BANDS[0]:  # a candidate or a hexadecimal run lies within a word
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
        for start, end, word in candidates(text):
            language = LANGUAGE.fullmatch(word) is not None
            stat, p, a = battery(word.lower() if language else word)  # a capital that begins a word is no symbol of another alphabet
            band = max(b for b in BANDS if b <= len(word))
            if a > 10:  # digits alone are numbers, not secrets
                found.append((start, end, band, language, stat, p))
    return sorted(spans), found


SPAN = "struct<start:long,kind:int,end:long>"
FOUND = "struct<start:long,end:long,band:int,language:boolean,stat:double,p:double>"


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``base`` and ``found`` arrays: one pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        cand = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("band", pa.int32()), ("language", pa.bool_()), ("stat", pa.float64()), ("p", pa.float64())]))
        for b in batches:
            base, found = [], []
            for t in b.column(len(keep)):
                s, f = scan(t.as_py() or "")
                base.append([dict(zip(("start", "kind", "end"), x)) for x in s])
                found.append([dict(zip(("start", "end", "band", "language", "stat", "p"), x)) for x in f])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(base, span), pa.array(found, cand)], [*keep, "base", "found"])

    rows = docs.select(*keep, F.col("text").alias("_text"))
    return rows.mapInArrow(run, extended(rows, f"base array<{SPAN}>, found array<{FOUND}>"))


def _median(cells) -> tuple[int, int]:
    """(rows, median) of a table grouped by ``cell``."""
    counts = sorted((r["cell"], r["count"]) for r in cells.count().collect())
    k, upto = sum(n for _, n in counts), 0
    for cell, n in counts:
        upto += n
        if 2 * upto >= k:
            return k, cell
    return 0, 0


def thresholds(scan_rows: DataFrame, q: float) -> tuple[float, float, dict[tuple[int, int], float]]:
    """(mean, scale, (band, level) -> highest z that is accepted).  What reaches the driver are counts by thousandths, and by band, level and twentieths of z."""
    found = scan_rows.select(F.explode("found").alias("f")).select("f.*").withColumn("n", F.col("end") - F.col("start"))
    # Whole thousandths, of which there are some ten thousands at most.
    s = F.round(F.col("stat") * 1000).cast("long")
    ordinary = found.where("language")
    k, mid = _median(ordinary.groupBy(s.alias("cell")))
    m0, d0, k0 = PRIOR
    mean = (k * mid / 1e3 + k0 * m0) / (k + k0)
    _, far = _median(ordinary.groupBy(F.round(F.abs(F.col("stat") - mean) * F.sqrt("n") * 1000).cast("long").alias("cell")))
    dev = math.sqrt((k * max(1.4826 * far / 1e3, d0 / 2) ** 2 + k0 * d0 * d0) / (k + k0))
    z = (F.col("stat") - mean) * F.sqrt("n") / dev
    cell = F.greatest(F.floor(z * 20), F.lit(-400)).cast("int")
    counts: dict[int, dict[tuple[int, int], int]] = {b: {} for b in BANDS}
    for r in found.groupBy("band", level(F.col("p")).alias("level"), F.least(cell, F.lit(100)).alias("cell")).count().collect():
        counts[r["band"]][r["level"], r["cell"]] = r["count"]
    return mean, dev, {(b, k): z for b, by in counts.items() for k, z in accepted_below(by, q).items()}


def level(p):
    """How many of the bounds in ``WEIGHTS`` a combined p-value reaches."""
    return sum(F.when(p >= low, 1).otherwise(0) for low, _ in WEIGHTS)


def accepted_below(counts: dict[tuple[int, int], int], q: float) -> dict[int, float]:
    """Weighted Benjamini-Hochberg over candidates counted by (level, twentieths of z): level -> the highest z that is accepted."""
    m = sum(counts.values())
    weight = {k + 1: w for k, (_, w) in enumerate(WEIGHTS)}
    whole = sum(n * weight.get(k, 0.0) for (k, _), n in counts.items())
    tested = sorted((normal_tail(-(c + 1) / 20) * whole / (m * weight[k]), k, c) for k, c in counts if k and c < 100)
    upto, best = 0, 0
    for i, (p, k, c) in enumerate(tested, 1):
        upto += counts[k, c]
        if p <= q * upto / m:
            best = i
    out: dict[int, float] = {}
    for _, k, c in tested[:best]:
        out[k] = max(out.get(k, -math.inf), (c + 1) / 20)
    return out


def with_secret_spans(docs: DataFrame, keep: list[str], q: float = 0.05) -> DataFrame:
    """The columns ``keep`` with ``spans``, an array of (start, kind, end) sorted: pattern spans, and random tokens that touch none of them."""
    rows = durable(scanned(docs, keep), "secrets-scan")
    mean, dev, limits = thresholds(rows, q)

    def accepted(c):
        ok = F.lit(False)
        for (b, k), z in limits.items():
            ok = ok | ((c["band"] == b) & (level(c["p"]) == k) & ((c["stat"] - mean) * F.sqrt(c["end"] - c["start"]) / dev < z))
        return ok

    free = lambda c: ~F.exists("base", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    more = F.transform(F.filter("found", lambda c: accepted(c) & free(c)), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return rows.select(*keep, "base", F.array_sort(F.concat("base", more)).alias("spans"))


def _joined(spans: str):
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, q: float = 0.05) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every document.

    Positions are code points, the end exclusive.  Null and empty texts have no spans (base_sha256 of the empty string).  Repeated rows
    give a row each.  An empty table gives an empty result.
    """
    rows = with_secret_spans(docs, ["doc_id"], q)
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def mask_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with the spans of all secrets replaced by ``mask``, n_chars counted anew where it is a column; every row stays.

    Null texts stay null, repeated rows stay repeated, an empty table stays empty; columns may have any names.
    """
    rows = with_secret_spans(docs.select(whole_row(docs).alias("row"), "text"), ["row"])  # whatever names the columns have
    rows = rows.select("row", "spans", F.col("row.text").alias("text"))
    # Texts are joined from what lies between spans; spans that overlap count as one.
    ends = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(F.col("text"), a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit(mask))).otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], s["end"]).alias("at"),
        ),
    )
    done = rows.withColumn("_m", ends)
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.concat(F.col("_m")["out"], F.expr("substring(text, cast(_m.at as int) + 1)")))
    done = done.withColumn("text", text)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select([new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
