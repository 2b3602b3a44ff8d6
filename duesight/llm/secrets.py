"""Secrets: fixed patterns, and runs of characters that a battery of randomness tests can't tell from chance.

Three patterns give the base spans. Besides, every run of at least 20 key
characters is tested, wherever it stands and whatever they are ('=' belongs to
it only as padding at its end): its encoding is inferred from its
characters, and chi-squared tests of alphabet uniformity, a runs test and a
serial-correlation test each give a probability. They are combined by Fisher's
method. Short runs have less power than long ones, so false discoveries are
controlled within each class of lengths, over all runs of the corpus: a run is
called structured only as the Benjamini-Hochberg rule at `rate` allows, and the
others become spans of kind `random`, unless they touch a base span.

Null text counts as empty and has no span. Rows are never merged: a repeated
row is found twice. Other columns than doc_id and text are not looked at.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duesight.session import materialise

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?(?![A-Za-z0-9+/_-])")
#: Encodings from the narrowest; a run has the first whose alphabet holds it.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "UPPER": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
#: Bins of -log10 p: a tenth each, up to 30.
BINS, LAST_BIN = 10, 300

SPAN = "struct<kind:string,start:long,stop:long>"
RUN_TYPE = "struct<start:long,stop:long,encoding:string,bin:int>"


def upper_tail(chi2: float, df: int) -> float:
    """P(X >= chi2) of a chi-squared variable (Wilson and Hilferty)."""
    if df <= 0:
        return 1.0
    z = ((max(chi2, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def uniformity(x: np.ndarray, size: int) -> float:
    """Chi-squared test over equal stretches of the alphabet, of five expected characters or so each."""
    bins = max(2, min(size, len(x) // 5))
    edges = np.arange(bins + 1) * size // bins
    expected = np.diff(edges) * len(x) / size
    seen = np.histogram(x, edges)[0]
    return upper_tail(float(((seen - expected) ** 2 / expected).sum()), bins - 1)


def classes(run: str, alphabet: str) -> float:
    """Chi-squared test over digits, capitals, small letters and signs, as the alphabet has them.

    Letters alone are told apart by vowels, too: words have more of them than chance gives.
    """
    kinds = [str.isdigit, str.isupper, str.islower]
    if alphabet.isalpha():
        kinds = [lambda c: c in "AEIOU", lambda c: c in "aeiou", lambda c: c.isupper() and c not in "AEIOU"]
    of = lambda s: np.array([sum(map(k, s)) for k in kinds])
    seen, share = of(run), of(alphabet) / len(alphabet)
    seen, share = np.append(seen, len(run) - seen.sum()), np.append(share, 1 - share.sum())
    seen, share = seen[share > 1e-9], share[share > 1e-9] * len(run)
    return upper_tail(float(((seen - share) ** 2 / share).sum()), len(seen) - 1)


def runs(x: np.ndarray, size: int) -> float:
    """Wald and Wolfowitz: stretches in the upper and lower half of the alphabet."""
    up = x * 2 >= size
    a, b = int(up.sum()), int((~up).sum())
    if not a or not b:
        return 2.0 ** (1 - len(x))
    n, mean = a + b, 1 + 2 * a * b / (a + b)
    var = (mean - 1) * (mean - 2) / (n - 1)
    return two_sided((1 + int((up[1:] != up[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial(x: np.ndarray) -> float:
    """Correlation of each character with the next."""
    y = x - x.mean()
    power = float((y * y).sum())
    if not power:
        return 10.0 ** -len(x)
    n = len(x)
    return two_sided((float((y[1:] * y[:-1]).sum()) / power + 1 / n) * math.sqrt(n))


def battery(run: str) -> tuple[str, float] | None:
    """(encoding, probability that chance gives tests as bad as these); None for a run that no encoding holds."""
    run = run.rstrip("=")
    for name, alphabet in ALPHABETS.items():
        if set(run) <= set(alphabet):
            place = {c: i for i, c in enumerate(alphabet)}
            x = np.array([place[c] for c in run], float)
            size = len(alphabet)
            tests = [uniformity(x, size), classes(run, alphabet), runs(x, size), serial(x)]
            return name, upper_tail(-2 * sum(math.log(max(p, 1e-300)) for p in tests), 2 * len(tests))
    return None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, str, int]]:
    out = []
    for m in RUN.finditer(text):
        run, (start, stop) = m[0], m.span()
        if any(a < stop and start < b for _, a, b in base):
            continue
        if result := battery(run):
            out.append((start, stop, result[0], min(LAST_BIN, int(-BINS * math.log10(max(result[1], 1e-300))))))
    return out


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, tested runs: one row per document."""
    schema = f"doc_id long, base array<{SPAN}>, runs array<{RUN_TYPE}>"
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    run_type = pa.list_(pa.struct([
        ("start", pa.int64()), ("stop", pa.int64()), ("encoding", pa.string()), ("bin", pa.int32())]))

    def scan(batches):
        for batch in batches:
            base, tested = [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text or "")
                base.append([dict(zip(("kind", "start", "stop"), s)) for s in spans])
                tested.append([dict(zip(("start", "stop", "encoding", "bin"), c)) for c in candidates(text or "", spans)])
            yield pa.record_batch([batch.column("doc_id"), pa.array(base, span), pa.array(tested, run_type)],
                                  names=["doc_id", "base", "runs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, schema)


def length_class(length: Column) -> Column:
    """Half powers of two, 20 characters and up."""
    return F.floor(2 * F.log2(length.cast("double"))).cast("int")


def cutoffs(counts: list[tuple[int, int, int]], rate: float) -> dict[int, int]:
    """From (class, bin, runs): the smallest bin whose runs count as structured in each class."""
    out, by = {}, {}
    for c, b, n in counts:
        by.setdefault(c, {})[b] = n
    for c, bins in by.items():
        total, seen = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            seen += bins[b]
            if 10 ** (-b / BINS) * total <= rate * seen:
                out[c] = b
    return out


def secret_spans(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """doc_id, base: the spans of the patterns; spans: these and the random runs, by start. Characters, end exclusive."""
    rows = materialise(scanned(docs), "secrets")
    counts = (rows.select(F.explode("runs").alias("run"))
              .groupBy(length_class(F.col("run.stop") - F.col("run.start")).alias("c"), F.col("run.bin").alias("b"))
              .agg(F.count("*").alias("n")))
    # At most 301 bins for each of a few dozen classes.
    limit = cutoffs([tuple(r) for r in counts.collect()], rate)

    def random(run: Column) -> Column:
        least = F.lit(LAST_BIN + 1)
        for c, b in limit.items():
            least = F.when(length_class(run["stop"] - run["start"]) == c, F.lit(b)).otherwise(least)
        return run["bin"] < least

    found = F.transform(F.filter("runs", random), lambda r: F.struct(
        F.lit("random").alias("kind"), r["start"].alias("start"), r["stop"].alias("stop")))
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)
    ordered = F.array_sort(F.transform(F.concat("base", found), lambda s: F.struct(
        s["start"], rank(s["kind"]).alias("rank"), s["kind"], s["stop"])))
    return rows.select("doc_id", "base", F.transform(
        ordered, lambda s: F.struct(s["kind"], s["start"], s["stop"])).alias("spans"))


def span_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_report(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """Counts by pattern and digests of the spans, one row per document."""
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return secret_spans(docs, rate).select(
        "doc_id", *(number(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(span_text("base").cast("binary"), 256).alias("base_sha256"), span_text("spans").alias("spans"))
