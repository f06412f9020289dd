"""Quality by weak supervision: rules vote or abstain, and expectation maximisation weighs them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.store import stored

GAP = r"[\x20\x09-\x0D]+"
#: Accuracies and the share of good documents stay within these bounds: a rule never counts against its own vote.
LEAST, MOST = 0.55, 0.99
STEPS = 50


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what rules look at besides: n_lines, n_letters, n_upper.

    A row for each document, repeated ones and those without an id too; a null text has no words; a text is read whole, however
    long. Words of 3-word windows that occur twice or more are found by sorting the windows' 64-bit hashes, less as many
    low bits as the window's number takes (9 bits for 500 words), which tell where each is. Neighbours with equal hashes are
    compared by their words; a text in which two differ is sorted by its words instead.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    rows = rows.select("doc_id", "t", F.array_remove(F.split("t", GAP), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("w")
    rows = rows.select(
        "doc_id",
        "w",
        n.alias("n"),
        F.ceil(F.log2(n + 1.0)).cast("int").alias("bits"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
    )
    own = [c for c in rows.columns if c != "w"]
    packed = F.expr("transform(sequence(0, n - 3), i -> shiftleft(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)), bits) | cast(i as bigint))")
    rows = rows.select(*own, "w", F.when(F.col("n") >= 3, F.sort_array(packed)).alias("k"))
    at = lambda i: f"cast(k[{i}] & (shiftleft(1L, bits) - 1) as int)"
    same_hash = "shiftright(k[i], bits) = shiftright(k[i - 1], bits)"
    other_words = " or ".join(f"w[{at('i')} + {j}] <> w[{at('i - 1')} + {j}]" for j in range(3))
    rows = rows.withColumn("clash", F.expr(f"size(k) > 1 and exists(sequence(1, size(k) - 1), i -> {same_hash} and ({other_words}))"))
    twice = "filter(sequence(0, size(k) - 1), i -> (i > 0 and shiftright(k[i], bits) = shiftright(k[i - 1], bits)) or (i < size(k) - 1 and shiftright(k[i], bits) = shiftright(get(k, i + 1), bits)))"
    by_hash = f"transform({twice}, i -> {at('i')})"
    spelled = "sort_array(transform(sequence(0, n - 3), i -> struct(concat_ws(' ', w[i], w[i + 1], w[i + 2]) as t, i as i)))"
    by_words = f"transform(array({spelled}), s -> transform(filter(sequence(0, size(s) - 1), i -> (i > 0 and s[i].t = get(s, i - 1).t) or s[i].t = get(s, i + 1).t), i -> s[i].i))[0]"
    where = F.expr(f"sort_array(case when clash then {by_words} else {by_hash} end)")
    rows = rows.select(*own, F.when(F.col("k").isNotNull(), where).alias("at"))
    covered = F.expr("aggregate(sequence(0, size(at) - 1), 0L, (a, i) -> a + least(3, coalesce(get(at, i + 1) - at[i], 3)))")
    rows = rows.select(*own, F.when(F.size("at") > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")


def ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def votes() -> dict[str, Column]:
    """1: good, 0: bad, -1: abstains."""
    vote = lambda good, bad: F.when(bad, 0).when(good, 1).otherwise(-1)
    words, length = F.col("n_words"), ratio("word_chars", "n_words")
    return {
        "length": vote(words >= 80, words < 20),
        "word_length": vote(length.between(3, 9), (length < 2) | (length > 14)),
        "symbols": vote(ratio("n_symbols", "n_words") <= 0.05, ratio("n_symbols", "n_words") > 0.3),
        "lines": vote(ratio("n_dup_lines", "n_lines") <= 0.1, ratio("n_dup_lines", "n_lines") > 0.4),
        "repeats": vote(ratio("n_repeat_words", "n_words") <= 0.1, ratio("n_repeat_words", "n_words") > 0.35),
        "letters": vote(ratio("n_letters", "word_chars") >= 0.85, ratio("n_letters", "word_chars") < 0.65),
        "upper": vote(ratio("n_upper", "n_letters") <= 0.2, ratio("n_upper", "n_letters") > 0.6),
    }


def fitted(patterns: dict[tuple[int, ...], int]) -> tuple[float, list[float]]:
    """The share of good documents and each rule's accuracy, by expectation maximisation over the counts of vote patterns."""
    rules = len(next(iter(patterns))) if patterns else len(votes())
    share, accuracy = 0.8, [0.8] * rules
    rows = sorted(patterns.items())
    for _ in range(STEPS):
        good_all, right, cast_ = 0.0, [0.0] * rules, [0.0] * rules
        for pattern, n in rows:
            p = posterior(pattern, share, accuracy)
            good_all += n * p
            for j, v in enumerate(pattern):
                if v >= 0:
                    cast_[j] += n
                    right[j] += n * (p if v else 1 - p)
        total = sum(n for _, n in rows)
        share = min(MOST, max(1 - MOST, good_all / total)) if total else share
        accuracy = [min(MOST, max(LEAST, r / c)) if c else a for r, c, a in zip(right, cast_, accuracy, strict=True)]
    return share, accuracy


def posterior(pattern: tuple[int, ...], share: float, accuracy: list[float]) -> float:
    x = math.log(share / (1 - share)) + sum((1 if v else -1) * math.log(a / (1 - a)) for v, a in zip(pattern, accuracy, strict=True) if v >= 0)
    return 1 / (1 + math.exp(-x))


def judged(docs: DataFrame) -> DataFrame:
    """The measures of each document with its quality: the posterior probability that it is good.

    The counts of vote patterns, at most three to the power of the number of rules, are all that comes to the driver; they cover all documents.
    """
    rows = stored(measured(docs).withColumns(votes()), "quality-measures")
    names = list(votes())
    counts = {tuple(r[:-1]): r[-1] for r in rows.groupBy(*names).count().collect()}
    share, accuracy = fitted(counts)
    x = F.lit(math.log(share / (1 - share)))
    for name, a in zip(names, accuracy, strict=True):
        x = x + F.when(F.col(name) == 1, math.log(a / (1 - a))).when(F.col(name) == 0, -math.log(a / (1 - a))).otherwise(0.0)
    return rows.withColumn("quality", 1 / (1 + F.exp(-x)))


def quality(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality.

    Repeated rows are judged alike and count as often as they are there; an empty table gives no rows; null and empty texts fail the base.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("quality") >= 0.5)).alias("kept"), "quality")
