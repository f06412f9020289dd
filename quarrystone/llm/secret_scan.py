"""Secrets by pattern, and by a battery of randomness tests with length-aware control of false discoveries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.store import stored


def _either(word: str) -> str:
    """The word with its letters in either case, ASCII only."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: kind: (pattern, least length of what it is told by). The order is that of kinds at one place.
ASSIGN = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run of under the least length fails wherever in it a match starts, so these patterns hold it.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: What the battery looks at: runs of characters that keys and tokens are made of.
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
#: (pattern, alphabet), the first that fits is the inferred encoding.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("^[0-9a-f]+$", DIGITS + "abcdef"),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("^[a-z]+$", LOWER),
    ("^[A-Z2-7]+$", UPPER + "234567"),
    ("^[a-z0-9]+$", DIGITS + LOWER),
    ("^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("", UPPER + LOWER + DIGITS + "+/-_"),
)
#: How often two letters of running text agree.
COINCIDENCE = 0.065
#: Lengths that part candidates into strata: short ones, on which the tests tell little, are controlled by themselves.
STRATA = (24, 32, 48, 64)
#: Share of false discoveries in a stratum: among candidates that are told from text, and among those that the combined battery rejects as not random.
SHARE, REJECTED = 0.05, 0.01
#: Bins of -log10 p: 20 for each power of ten.
BINS = 400


def pieces(text: Column, pattern: str, made) -> Column:
    """made(m) of each leftmost non-overlapping match m, with gap and length: the code points between it and the match before, and its own."""
    m, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    out = F.zip_with(F.slice(between, 1, F.size(m)), m, lambda b, y: F.struct(F.length(b).alias("gap"), F.length(y).alias("length"), made(y).alias("x")))
    return F.when(F.regexp_like(text, F.lit(pattern)), out)


def upper_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal Z, by the logistic approximation."""
    z = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def battery(token: Column) -> Column:
    """Struct (n, random, text): the token's length; the combined probability, were its characters uniform in the alphabet of its
    encoding, of a chi-squared, runs and lag-one correlation as extreme as its own; and the probability that as much running text is as even."""
    alphabet = F.lit(ENCODINGS[-1][1])
    for pattern, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(token.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    base = F.struct(alphabet.alias("a"), F.regexp_extract_all(token, F.lit("."), F.lit(0)).alias("c"))

    def numbers(x: Column) -> Column:
        v = F.transform(x["c"], lambda c: (F.instr(x["a"], c) - 1).cast("double"))
        k = F.length(x["a"]).cast("double")
        squares = F.aggregate(F.transform(F.array_distinct(x["c"]), lambda d: F.size(F.filter(x["c"], lambda c: c == d))), F.lit(0).cast("double"), lambda a, c: a + c.cast("double") * c)
        return F.struct(v.alias("v"), k.alias("k"), F.size(x["c"]).cast("double").alias("n"), squares.alias("squares"))

    def sums(x: Column) -> Column:
        n = x["n"]
        mean = F.aggregate(x["v"], F.lit(0.0), lambda a, v: a + v) / n
        high = F.size(F.filter(x["v"], lambda v: v >= x["k"] / 2)).cast("double")
        pairs = F.zip_with(F.slice(x["v"], 1, F.size(x["v"]) - 1), F.slice(x["v"], 2, F.size(x["v"]) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        turns = F.size(F.filter(pairs, lambda p: (p["a"] >= x["k"] / 2) != (p["b"] >= x["k"] / 2))).cast("double")
        return F.struct(x["k"].alias("k"), n.alias("n"), x["squares"].alias("squares"), mean.alias("mean"), high.alias("high"), turns.alias("turns"), pairs.alias("pairs"), x["v"].alias("v"))

    def tests(x: Column) -> Column:
        n, k = x["n"], x["k"]
        chi, spread = k / n * x["squares"] - n, F.sqrt(2 * (k - 1) * (n - 1) / n)
        runs_mean = 2 * x["high"] * (n - x["high"]) / n + 1
        runs_var = (runs_mean - 1) * (runs_mean - 2) / (n - 1)
        runs = F.when(runs_var > 0, (x["turns"] + 1 - runs_mean) / F.sqrt(runs_var)).otherwise(12.0)
        around = F.aggregate(x["v"], F.lit(0.0), lambda a, v: a + (v - x["mean"]) * (v - x["mean"]))
        lag = F.aggregate(x["pairs"], F.lit(0.0), lambda a, p: a + (p["a"] - x["mean"]) * (p["b"] - x["mean"]))
        serial = F.when(around > 0, (lag / around + 1 / n) * F.sqrt(n)).otherwise(12.0)
        own = k * COINCIDENCE  # how much likelier two characters of text agree than uniform ones
        text = 1 - upper_tail((chi - (k - 1) - (n - 1) * F.greatest(own - 1, F.lit(0.5))) / (spread * F.greatest(own, F.lit(1.5))))
        least = F.lit(1e-12)
        log = lambda p: F.ln(F.greatest(p, least))
        half = -(log(upper_tail((chi - (k - 1)) / spread)) + log(2 * upper_tail(F.abs(runs))) + log(2 * upper_tail(F.abs(serial))))
        return F.struct(n.alias("n"), (F.exp(-half) * (1 + half + half * half / 2)).alias("random"), text.alias("text"))

    out = F.transform(F.array(base), numbers)
    return F.transform(F.transform(out, sums), tests)[0]


def stratum(n: Column) -> Column:
    return sum((F.when(n >= at, 1).otherwise(0) for at in STRATA), F.lit(0))


def bin_of(p: Column) -> Column:
    return F.least(F.lit(BINS), F.floor(-20 * F.log10(F.greatest(p, F.lit(1e-30))))).cast("int")


def cutoffs(counts: dict[tuple[int, int], int], share: float = SHARE) -> dict[int, int]:
    """For each stratum the least bin from which candidates count as found: of those at or beyond it, at most a share is expected
    if the hypothesis held for all."""
    out = {}
    for s in range(len(STRATA) + 1):
        total = sum(n for (t, _), n in counts.items() if t == s)
        beyond, best = 0, BINS + 1
        for b in range(BINS, -1, -1):
            beyond += counts.get((s, b), 0)
            if beyond and total * math.pow(10, -b / 20) <= share * beyond:
                best = b
        out[s] = best
    return out


def joined(found: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined. found: structs (s, kind, e), sorted."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", name(x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scanned(docs: DataFrame) -> DataFrame:
    """row (a number of its own for each row), doc_id, and by kind the matches' gaps and lengths with what the kind is judged by. A null text counts as empty. No text is stored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))

    def tried(m: Column) -> Column:
        b = F.transform(F.array(battery(m)), lambda b: F.struct(stratum(b["n"]).alias("stratum"), bin_of(b["random"]).alias("random"), bin_of(b["text"]).alias("text")))
        return b[0]

    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    every = lambda m: F.lit(True)
    t = F.col("t")
    return rows.select("row", "doc_id", pieces(t, ASSIGN, long_enough).alias("assign"), pieces(t, ACCESS, every).alias("access"), pieces(t, HEX, every).alias("hex"), pieces(t, CANDIDATE, tried).alias("some"))


def placed(rows: DataFrame) -> DataFrame:
    """row, kind (its number), s, e (code points, end exclusive), and for the battery's candidates stratum, random and text: all matches that count. Places are running sums, a window for each row and kind."""
    parts = []
    for k, name in enumerate(("assign", "access", "hex", "some")):
        one = rows.where(F.size(name) > 0).select("row", F.lit(k).alias("kind"), F.posexplode(name).alias("i", "m"))
        judged = ("m.x", F.lit(None).alias("b")) if k < 3 else (F.lit(True).alias("x"), F.col("m.x").alias("b"))
        parts.append(one.select("row", "kind", "i", "m.gap", "m.length", *judged))
    kind = parts[3].schema["b"].dataType
    every = parts[0].withColumn("b", F.col("b").cast(kind))
    for p in parts[1:]:
        every = every.unionByName(p.withColumn("b", F.col("b").cast(kind)))
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    e = F.sum(F.col("gap") + F.col("length")).over(upto).cast("int")
    return every.withColumn("e", e).where("x").select("row", "kind", (F.col("e") - F.col("length")).alias("s"), "e", "b.stratum", "b.random", "b.text")


def free(found: DataFrame) -> DataFrame:
    """found without the candidates that overlap a pattern's match: one that starts no later and ends in or after the candidate, or the next one that starts within it."""
    order = Window.partitionBy("row").orderBy("s", "kind")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("s"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)  # running from the end
    base = F.col("kind") < 3
    last, following = F.max(F.when(base, F.col("e"))).over(before), F.min(F.when(base, F.col("s"))).over(after)
    out = found.withColumns({"_last": F.coalesce(last, F.lit(0)), "_next": F.coalesce(following, F.lit(2**31 - 1))})
    return out.where(base | ((F.col("_last") <= F.col("s")) & (F.col("_next") >= F.col("e")))).drop("_last", "_next")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (structs s, kind, e in order; spans has the battery's finds, kind 3, as well), a row for each document.

    A candidate is found if, by its evenness, it is told from text, and the combined battery (chi-squared, runs, lag-one
    correlation) doesn't reject it as random. Both are decided under control of the share of false discoveries in the stratum of its length.
    """
    rows = stored(scanned(docs), "secret-pieces")
    found = stored(free(placed(rows)), "secret-spans")
    tried = found.where("kind = 3")
    # At most strata times bins rows come to the driver.
    counted = lambda c: {(r[0], r[1]): r[2] for r in tried.groupBy("stratum", c).count().collect()}
    even, uneven = cutoffs(counted("text")), cutoffs(counted("random"), REJECTED)
    least = lambda cut: F.element_at(F.array(*(F.lit(cut[s]) for s in range(len(STRATA) + 1))), F.col("stratum") + 1)
    kept = found.where((F.col("kind") < 3) | ((F.col("text") >= least(even)) & (F.col("random") < least(uneven))))
    spans = F.array_sort(F.collect_list(F.struct("s", "kind", "e")))
    by_row = kept.groupBy("row").agg(spans.alias("spans")).withColumn("base", F.filter("spans", lambda x: x["kind"] < 3))
    none = F.array().cast(by_row.schema["spans"].dataType)
    return rows.select("row", "doc_id").join(by_row, "row", "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def secrets(docs: DataFrame) -> DataFrame:
    """One row for each document, repeated ones and those without an id too: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans; an empty table gives no rows; a text takes time in proportion to its length and matches.
    """
    rows = scan(docs)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
