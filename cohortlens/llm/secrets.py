"""Secret scan with DataFrame functions only.

Base spans come from three patterns: assignments of a password-like name, access key ids and
long lower-case hex runs. Positions are code points: a text split at its matches gives the
gaps between them, and a fold over gaps and matches gives every start and end.

The randomness battery adds spans. Its candidates are runs of 20 or more characters of the
usual secret alphabets. A candidate's encoding (hex, base32, upper or lower alphanumeric,
letters, base64) is inferred, and three tests of "this is a random string of that encoding"
run on it: chi-squared uniformity over the encoding's alphabet (Wilson-Hilferty), a
Wald-Wolfowitz runs test of a two-class split of the alphabet, and lag-1 serial correlation.
Fisher's method joins the three p-values.

A candidate is random-looking when the joined test does not reject at ``ALPHA``. Short
ordinary strings can pass by lack of power, so each candidate is also weighed against
ordinary text: its e-value is the likelihood ratio of a random string of its encoding over
ordinary text, where letters follow the letter frequencies of all documents and letters and
digits change places at their rate there or at ``CHANGES``, whichever explains the string
better (case and symbols are left out, since identifiers mix them at will). Among ordinary
text its mean is at most 1. False discoveries are then controlled per stratum (encoding, half
octave of length) by the Benjamini-Hochberg procedure for e-values, which holds under any
dependence: with ``m`` candidates in the stratum, those of at least ``e`` are reported once
there are ``m / (FDR * e)`` of them. Many ordinary strings raise that cut-off for weak
candidates; one of at least ``m / FDR`` is always reported. The cut-offs come from
one count per stratum and quarter unit of ``log e``, a small table.

Defined cases: a null text is empty; a text without matches has empty strings for digest and
spans; equal rows give equal results; a null doc_id is kept; an empty table gives an empty
result; only the two named columns are read.
"""
from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base kinds, in their order of listing.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run is taken whole, so 20 characters or more
HEX = r"[0-9a-f]{24,}"
VALUE_LENGTH = 6

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHA, FDR = 0.01, 0.05
CHANGES = 0.1  # of neighbours in an identifier, how many are a letter and a digit
BINS, MAX_BIN = 4, 400  # of log e: bins a unit, and the last bin

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
VOWELS = "aeiouAEIOU"
# name, pattern, alphabet, characters of the first class in the runs test
ENCODINGS = [
    ("hex", r"^(?=.*[0-9])[0-9a-f]+$", DIGITS + "abcdef", DIGITS),
    ("hex_upper", r"^(?=.*[0-9])[0-9A-F]+$", DIGITS + "ABCDEF", DIGITS),
    ("lower", r"^[a-z]+$", LOWER, VOWELS),
    ("upper", r"^[A-Z]+$", UPPER, VOWELS),
    ("base32", r"^[A-Z2-7]+=*$", UPPER + "234567", "234567"),
    ("upper_alnum", r"^[A-Z0-9]+$", UPPER + DIGITS, DIGITS),
    ("lower_alnum", r"^[a-z0-9]+$", LOWER + DIGITS, DIGITS),
    ("letters", r"^[A-Za-z]+$", UPPER + LOWER, UPPER),
    ("base64", r"^[A-Za-z0-9+/_-]+=*$", UPPER + LOWER + DIGITS + "+/_-", UPPER + DIGITS),
]


# ---------------------------------------------------------------- positions
def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches; value is ``group``."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
    steps = F.zip_with(
        F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("size"))), values,
        lambda s, v: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), v.alias("value")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(state: Column, step: Column) -> Column:
        start = state["at"] + step["gap"]
        end = start + step["size"]
        found = F.struct(start.alias("start"), end.alias("end"), step["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(found)).alias("out"))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), add)["out"]
    return F.when(text.rlike(pattern), found).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans per base kind, in listing order."""
    return {
        "assign": F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= VALUE_LENGTH),
        "access": matches(text, ACCESS),
        "hex": matches(text, HEX),
    }


def span_list(kinds: dict[str, Column]) -> Column:
    """kind:start:end of all spans by start, then kind in the order given."""
    def mark(spans: Column, rank: int, kind: str) -> Column:
        return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    marked = [mark(spans, rank, kind) for rank, (kind, spans) in enumerate(kinds.items())]
    return F.array_join(F.transform(F.array_sort(F.concat(*marked)), lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")


# ---------------------------------------------------------------- the battery
def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def upper_tail(z: Column) -> Column:
    """P(N(0,1) > z) by the rational approximation 26.2.17 of Abramowitz and Stegun."""
    def tail(x: Column) -> Column:
        a = F.least(F.abs(x), F.lit(37.0))
        poly = bound(F.lit(1.0) / (F.lit(1.0) + 0.2316419 * a), lambda t: t * (
            0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
        upper = F.exp(-a * a / 2) * 0.3989422804014327 * poly
        return bound(upper, lambda p: F.when(x >= 0, p).otherwise(F.lit(1.0) - p))

    return bound(z, tail)


def encoding_of(token: Column, rates: dict[str, float]) -> Column:
    """(name, alphabet, first, weights, to_digit, to_letter) of the first encoding whose pattern the
    token fits; null for none. Weights: log likelihood ratio of each character of the alphabet
    among its kind; the others: log chance that a letter or digit of a random string is a digit or letter."""
    out = F.lit(None)
    for name, pattern, alphabet, first in reversed(ENCODINGS):
        letters, digits = sum(c.isalpha() for c in alphabet), sum(c.isdigit() for c in alphabet)
        seen = sum(rates[c.lower()] for c in alphabet if c.isalpha())
        weights = [log(seen / rates[c.lower()] / letters) if c.isalpha() else 0.0 for c in alphabet]
        shares = [log(n / (letters + digits)) if letters and digits else None for n in (digits, letters)]
        parts = {"name": F.lit(name), "alphabet": F.lit(alphabet), "first": F.lit(first), "weights": F.array(*map(F.lit, weights))}
        parts |= {k: F.lit(v).cast("double") for k, v in zip(("to_digit", "to_letter"), shares)}
        out = F.when(token.rlike(pattern), F.struct(*[v.alias(k) for k, v in parts.items()])).otherwise(out)
    return out


def battery(token: Column, rates: dict[str, float]) -> Column:
    """(name, size, p, log_e): encoding, length without padding, the joined p-value of the tests
    and the log likelihood ratio of a random string over ordinary text."""
    def neighbours(values: Column, join: Callable[[Column, Column], Column]) -> Column:
        return F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), join)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    def uniform(x: Column) -> Column:
        k = x["width"] - 1
        squares = F.aggregate(
            F.array_distinct(x["chars"]), F.lit(0.0),
            lambda s, c: s + F.pow(F.size(F.filter(x["chars"], lambda y: y == c)).cast("double"), F.lit(2.0)))
        chi2 = F.greatest(x["width"] * squares / x["n"] - x["n"], F.lit(0.0))
        return upper_tail((F.pow(chi2 / k, F.lit(1 / 3)) - (1 - F.lit(2.0) / (9 * k))) / F.sqrt(F.lit(2.0) / (9 * k)))

    def runs(x: Column) -> Column:
        def judge(y: Column) -> Column:
            n, pairs = x["n"], 2 * y["n1"] * (x["n"] - y["n1"])
            spread = F.sqrt(F.greatest(pairs * (pairs - n) / (n * n * (n - 1)), F.lit(1e-9)))
            return F.when(pairs == 0, F.lit(0.0)).otherwise(2 * upper_tail(F.abs((y["changes"] - pairs / n) / spread)))

        def counts(sides: Column) -> Column:
            changes = F.size(F.filter(neighbours(sides, lambda a, b: a != b), lambda d: d))
            return F.struct(F.size(F.filter(sides, lambda s: s)).cast("double").alias("n1"), changes.alias("changes"))

        return bound(bound(F.transform(x["chars"], lambda c: F.instr(x["first"], c) > 0), counts), judge)

    def serial(x: Column) -> Column:
        def judge(centred: Column) -> Column:
            lagged = total(neighbours(centred, lambda a, b: a * b))
            return bound(total(F.transform(centred, lambda v: v * v)), lambda power: F.when(power <= 0, F.lit(0.0)).otherwise(
                2 * upper_tail(F.abs((lagged / F.greatest(power, F.lit(1e-9)) + 1 / x["n"]) * F.sqrt(x["n"])))))

        places = F.transform(x["chars"], lambda c: F.instr(x["alphabet"], c).cast("double"))
        return bound(bound(places, lambda p: bound(total(p) / x["n"], lambda mean: F.transform(p, lambda v: v - mean))), judge)

    def weighed(x: Column) -> Column:
        def pairs(y: Column) -> Column:
            stays = y["digits"] + y["letters"] - y["changes"]
            text = F.greatest(*[y["changes"] * log(r) + stays * log(1 - r) for r in (rates["change"], CHANGES)])
            return y["digits"] * x["to_digit"] + y["letters"] * x["to_letter"] - text

        found = {"digits": "[A-Za-z0-9](?=[0-9])", "letters": "[A-Za-z0-9](?=[A-Za-z])", "changes": "[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"}
        counts = F.struct(*[F.regexp_count(token, F.lit(pattern)).alias(k) for k, pattern in found.items()])
        letters = F.aggregate(x["chars"], F.lit(0.0), lambda t, c: t + F.element_at(x["weights"], F.instr(x["alphabet"], c)))
        return letters + F.when(x["to_digit"].isNull(), F.lit(0.0)).otherwise(bound(counts, pairs))

    def tests(x: Column) -> Column:
        half = -(F.log(F.greatest(uniform(x), F.lit(1e-300))) + F.log(F.greatest(runs(x), F.lit(1e-300))) + F.log(F.greatest(serial(x), F.lit(1e-300))))
        joined = bound(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))  # chi-squared with 6 degrees of freedom
        return F.struct(x["name"].alias("name"), x["n"].cast("int").alias("size"), joined.alias("p"), weighed(x).alias("log_e"))

    def parts(y: Column) -> Column:
        enc, chars = y["enc"], y["chars"]
        return F.struct(
            enc["name"].alias("name"), enc["alphabet"].alias("alphabet"), enc["first"].alias("first"), chars.alias("chars"),
            *[enc[c].alias(c) for c in ("weights", "to_digit", "to_letter")],
            F.size(chars).cast("double").alias("n"), F.length(enc["alphabet"]).cast("double").alias("width"))

    chars = F.regexp_extract_all(F.rtrim(token, F.lit("=")), F.lit("(?s)."), F.lit(0))
    return bound(bound(F.struct(chars.alias("chars"), encoding_of(token, rates).alias("enc")), parts), tests)


def stratum(result: Column) -> Column:
    return F.concat_ws(":", result["name"], F.floor(F.log2(result["size"].cast("double")) * 2).cast("string"))


def strength(result: Column) -> Column:
    """Bin of the e-value; -1 for what the battery takes for no random string."""
    return F.when(result["p"] >= ALPHA, F.least(F.floor(F.greatest(result["log_e"], F.lit(0.0)) * BINS), F.lit(MAX_BIN))).otherwise(-1).cast("int")


def candidates(text: Column, rates: dict[str, float]) -> Column:
    """Array of (start, end, test) of the candidates of a text; test is their ``battery``."""
    return F.transform(matches(text, CANDIDATE), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), battery(m["value"], rates).alias("test")))


def text_rates(docs: DataFrame, text: str) -> dict[str, float]:
    """Of all documents: the frequency of every lower-case letter, and how often a letter and a
    digit are neighbours, per lower-case letter."""
    raw = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(
        *[(F.octet_length(raw) - F.octet_length(F.replace(raw, F.lit(c), F.lit("")))).alias(c) for c in LOWER],
        F.regexp_count(raw, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")).alias("change"),
    )
    total = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in counted.columns]).first().asDict()
    letters = sum(total[c] + 1 for c in LOWER)
    return {c: (total[c] + 1) / letters for c in LOWER} | {"change": min(max(total["change"] / letters, 1e-3), 0.5)}


def cut_offs(docs: DataFrame, text: str, rates: dict[str, float]) -> dict[str, int]:
    """Per stratum the least bin that is reported; strata that report nothing are left out."""
    raw = F.coalesce(F.col(text), F.lit(""))
    tests = docs.where(raw.rlike(CANDIDATE)).select(F.explode(candidates(raw, rates)).alias("c")).where("c.test.name is not null")
    counts: dict[str, dict[int, int]] = {}
    for row in tests.groupBy(stratum(F.col("c.test")).alias("stratum"), strength(F.col("c.test")).alias("bin")).count().collect():
        counts.setdefault(row["stratum"], {})[row["bin"]] = row["count"]
    out = {}
    for name, bins in counts.items():
        total, above = sum(bins.values()), 0
        for at in sorted((b for b in bins if b >= 0), reverse=True):
            above += bins[at]
            if at / BINS + log(FDR * above / total) >= 0:
                out[name] = at
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts per base kind, digest of the base spans and all spans of every row."""
    rates = text_rates(docs, text)
    cuts = sorted(cut_offs(docs, text, rates).items())
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), raw.alias("text"))
    base = base_spans(F.col("text"))
    rows = rows.select("doc_id", *[spans.alias(kind) for kind, spans in base.items()], candidates(F.col("text"), rates).alias("tried"))
    least = F.create_map(*[F.lit(v) for cut in cuts for v in cut]) if cuts else F.create_map().cast("map<string,int>")
    random = F.filter("tried", lambda c: strength(c["test"]) >= F.try_element_at(least, stratum(c["test"])))
    kinds = {kind: F.col(kind) for kind in base}
    return rows.select(
        "doc_id", *[F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in kinds],
        F.sha2(span_list(kinds).cast("binary"), 256).alias("base_sha256"),
        span_list({**kinds, "random": random}).alias("spans"),
    )
