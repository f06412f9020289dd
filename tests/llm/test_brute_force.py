"""The parts of operators that SQL can't express, against plain Python: the battery's finds, Feistel pseudonyms, posterior verdicts, hot keys."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrystone.llm import hot, pii, quality, secret_scan, url_filter
from quarrystone.llm.components import components


def tail(z):
    z = max(-12.0, min(12.0, z))
    return 1 / (1 + math.exp(1.5976 * z + 0.07056 * z * z * z))


def plain_battery(token):
    letters = next(a for p, a in secret_scan.ENCODINGS if re.match(p, token))
    n, k = float(len(token)), float(len(letters))
    v = [float(letters.index(c)) for c in token]
    mean, squares = sum(v) / n, sum(c * c for c in Counter(token).values())
    high = [x >= k / 2 for x in v]
    chi, spread = k / n * squares - n, math.sqrt(2 * (k - 1) * (n - 1) / n)
    runs_mean = 2 * sum(high) * (n - sum(high)) / n + 1
    runs_var = (runs_mean - 1) * (runs_mean - 2) / (n - 1)
    runs = (sum(a != b for a, b in zip(high, high[1:])) + 1 - runs_mean) / math.sqrt(runs_var) if runs_var > 0 else 12.0
    around = sum((x - mean) ** 2 for x in v)
    serial = (sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / around + 1 / n) * math.sqrt(n) if around > 0 else 12.0
    own = k * secret_scan.COINCIDENCE
    text = 1 - tail((chi - (k - 1) - (n - 1) * max(own - 1, 0.5)) / (spread * max(own, 1.5)))
    half = -sum(math.log(max(p, 1e-12)) for p in (tail((chi - (k - 1)) / spread), 2 * tail(abs(runs)), 2 * tail(abs(serial))))
    binned = lambda p: min(secret_scan.BINS, math.floor(-20 * math.log10(max(p, 1e-30))))
    return sum(n >= at for at in secret_scan.STRATA), binned(math.exp(-half) * (1 + half + half * half / 2)), binned(text)


def base_spans(text):
    rules = ((secret_scan.ASSIGN, lambda m: len(m[2]) >= 6), ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("[0-9a-f]+", lambda m: len(m[0]) >= 24))
    return [(m.start(), k, m.end()) for k, (pattern, ok) in enumerate(rules) for m in re.finditer(pattern, text) if ok(m)]


def test_the_battery_finds_what_a_plain_version_finds(spark):
    rng = random.Random(4)
    token = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    made = [token(mixed, rng.randrange(20, 70)) for _ in range(40)] + [token("0123456789abcdef", 40) for _ in range(10)] + ["ABABABAB" * 5, "a" * 30, "abcdefghijklmnopqrstuvwxyz"]
    made += ["".join(rng.choice(("the", "and", "river", "stone", "over")) for _ in range(9)) for _ in range(60)]
    texts = {i: f"x é😀 {t} password={t if i % 9 == 0 else 'no'} {made[(i * 7) % len(made)]} end" for i, t in enumerate(made)}
    texts |= {900: None, 901: "", 902: "plain words only"}
    base = {i: base_spans(t or "") for i, t in texts.items()}
    tried = {i: [(m.start(), m.end(), *plain_battery(m[0])) for m in re.finditer(secret_scan.CANDIDATE, t or "") if not any(s < m.end() and m.start() < e for s, _, e in base[i])] for i, t in texts.items()}
    every = [x for xs in tried.values() for x in xs]
    even = secret_scan.cutoffs(Counter((x[2], x[4]) for x in every))
    uneven = secret_scan.cutoffs(Counter((x[2], x[3]) for x in every), secret_scan.REJECTED)
    found = {i: sorted(base[i] + [(s, 3, e) for s, e, t, r, p in tried[i] if p >= even[t] and r < uneven[t]]) for i in texts}
    assert sum(k == 3 for xs in found.values() for _, k, _ in xs) > 30
    frame = spark.createDataFrame(list(texts.items()) + [(3, texts[3]), (None, texts[5])], "doc_id long, text string").repartition(3)
    got = secret_scan.secrets(frame).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        i = 5 if r.doc_id is None else r.doc_id
        assert r.spans == ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in found[i]), i


def keyed(key, kind, i, other):
    return int(hashlib.sha256(f"{key}|{kind}|{i}|{other}".encode()).hexdigest()[:15], 16)


def plain_feistel(left, right, a, b, key, kind):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + keyed(key, kind, i, right) % a) % a
        else:
            right = (right + keyed(key, kind, i, left) % b) % b
    return left, right


def plain_digits(d, key, kind):
    half = len(d) // 2
    x, y = plain_feistel(int(d[:half]), int(d[half:]), 10**half, 10 ** (len(d) - half), key, kind)
    return str(x).zfill(half) + str(y).zfill(len(d) - half)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10


def put(shape, d):
    it = iter(d)
    return re.sub("[0-9]", lambda _: next(it), shape)


def plain_card(m, key):
    d = re.sub("[^0-9]", "", m)
    body = plain_digits(d[:-1], key, "card")
    return put(m, next(body + c for c in "0123456789" if luhn(body + c) == 0))


def plain_phone(m, key):
    d = re.sub("[^0-9]", "", m)
    code = 0 if m[0] != "+" else len(found[0]) if (found := re.match(pii.CODE, d)) else 3
    return put(m, d[:code] + plain_digits(d[code:], key, "phone"))


def plain_ssn(m, key):
    area, group, serial = map(int, m.split("-"))
    x, y = plain_feistel(area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    return f"{x + (2 if x >= 665 else 1):03}-{y // 9999 + 1:02}-{y % 9999 + 1:04}"


def plain_address(m, key):
    p = list(map(int, m.split(".")))
    x, y = plain_feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, key, "ip")
    return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"


def test_pseudonyms_are_those_of_a_plain_feistel_network(spark):
    key, c, s = "another key", "4539 5787 6362 1486", "4539578763621486"
    phones = ["+1 555 123 4567", "+15551234567", "(555) 123-4567", "555-123-4567", "+44 20 7946 0958", "+442079460958", "+33 1 23 45 67 89", "+49 30 12345678", "+353 1 234 5678"]
    cases = [
        *((p, plain_phone(p, key)) for p in phones),
        *((x, plain_card(x, key)) for x in (c, s, c.replace(" ", "-"), "3782 822463 10005", "378282246310005")),
        *((x, plain_ssn(x, key)) for x in ("123-45-6789", "001-01-0001", "665-99-9999", "667-01-0001", "899-99-9999")),
        *((x, plain_address(x, key)) for x in ("10.0.0.1", "0.0.0.0", "255.255.255.255")),
        *((x, x) for x in ("010.0.0.1", "256.1.1.1", "000-12-1234", "666-12-1234", "900-12-1234", "123-00-1234", "4539578763621487", "1999-02-30", "+12 3")),
        (f"order 12 {c} 12/27", f"order 12 {plain_card(c, key)} 12/27"),
        (f"2024 {c} 1227 {c}", f"2024 {plain_card(c, key)} 1227 {plain_card(c, key)}"),
        (f"{c} {s}", f"{plain_card(c, key)} {plain_card(s, key)}"),
        (f"call {phones[4]} 12 now", f"call {plain_phone(phones[4], key)} 12 now"),
        (f"at 10.0.0.1, {c} " * 3000, f"at {plain_address('10.0.0.1', key)}, {plain_card(c, key)} " * 3000),
        (f"x{phones[1]}y({phones[2]})", f"x{plain_phone(phones[1], key)}y({plain_phone(phones[2], key)})"),
        ("b" * 5000 + "@x.com", "b" * 5000 + "@x.com"),
        ("12" * 30_000, "12" * 30_000),
        (None, None),
        ("", ""),
    ]
    rows = [(i, t) for i, (t, _) in enumerate(cases)]
    got = {r.doc_id: r.text for r in pii.pseudonymized(spark.createDataFrame(rows, "doc_id long, text string"), key).collect()}
    for i, (t, want) in enumerate(cases):
        assert got[i] == want, t
    spark.conf.set(pii.KEY_SETTING, key)
    try:
        assert {r.doc_id: r.text for r in pii.pseudonymized(spark.createDataFrame(rows[:3], "doc_id long, text string")).collect()} == {i: got[i] for i in range(3)}
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_verdicts_are_those_of_a_plain_estimation(spark, sf):
    rows = quality.judged(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    names = list(quality.votes())
    weak = {
        "length": lambda r: (r.n_words >= 80, r.n_words < 20),
        "word_length": lambda r: (3 <= r.word_chars / max(1, r.n_words) <= 9, not 2 <= r.word_chars / max(1, r.n_words) <= 14),
        "symbols": lambda r: (r.n_symbols / max(1, r.n_words) <= 0.05, r.n_symbols / max(1, r.n_words) > 0.3),
        "lines": lambda r: (r.n_dup_lines / max(1, r.n_lines) <= 0.1, r.n_dup_lines / max(1, r.n_lines) > 0.4),
        "repeats": lambda r: (r.n_repeat_words / max(1, r.n_words) <= 0.1, r.n_repeat_words / max(1, r.n_words) > 0.35),
        "letters": lambda r: (r.n_letters / max(1, r.word_chars) >= 0.85, r.n_letters / max(1, r.word_chars) < 0.65),
        "upper": lambda r: (r.n_upper / max(1, r.n_letters) <= 0.2, r.n_upper / max(1, r.n_letters) > 0.6),
    }
    vote = [[0 if weak[n](r)[1] else 1 if weak[n](r)[0] else -1 for n in names] for r in rows]
    assert vote == [[r[n] for n in names] for r in rows]
    share, accuracy = 0.8, [0.8] * len(names)
    for _ in range(quality.STEPS):
        p = []
        for v in vote:
            good = share * math.prod(a if x == 1 else 1 - a if x == 0 else 1 for x, a in zip(v, accuracy))
            bad = (1 - share) * math.prod(1 - a if x == 1 else a if x == 0 else 1 for x, a in zip(v, accuracy))
            p.append(good / (good + bad))
        cast = [[(p[i] if v[j] else 1 - p[i]) for i, v in enumerate(vote) if v[j] >= 0] for j in range(len(names))]
        share = min(0.99, max(0.01, sum(p) / len(p)))
        accuracy = [min(0.99, max(0.55, sum(c) / len(c))) if c else a for c, a in zip(cast, accuracy)]
    for r, v in zip(rows, vote):
        good = share * math.prod(a if x == 1 else 1 - a if x == 0 else 1 for x, a in zip(v, accuracy))
        bad = (1 - share) * math.prod(1 - a if x == 1 else a if x == 0 else 1 for x, a in zip(v, accuracy))
        assert r.quality == pytest.approx(good / (good + bad), abs=1e-9)


def test_repeats_are_found_although_hashes_clash(spark, monkeypatch):
    """With hashes of two values only, the words decide."""
    words = ["a b c x a b c", "a b c d e f g", "x y z x y z x y z", "one two three four one two three five"]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    want = [6, 0, 9, 6]
    assert [r.n_repeat_words for r in quality.measured(docs).orderBy("doc_id").collect()] == want
    real = F.expr
    monkeypatch.setattr(quality.F, "expr", lambda e: real(e.replace("xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))", "pmod(xxhash64(get(w, i)), 2)")))
    assert [r.n_repeat_words for r in quality.measured(docs).orderBy("doc_id").collect()] == want


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_split(spark, monkeypatch, how):
    monkeypatch.setattr(hot, "LEAST", 4)
    monkeypatch.setattr(hot, "CELLS", 8)
    rows = spark.createDataFrame([(None if i % 7 == 0 else i % 3 if i % 2 else 99, i) for i in range(300)], "k long, v long")
    other = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (99, "d"), (None, "e")], "k long, w string")
    got = hot.split_join(rows, other, "k", ["v"], how)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, rows.join(other, "k", how).collect()))


def test_components_of_a_star_and_a_path(spark, monkeypatch):
    monkeypatch.setattr(hot, "LEAST", 4)
    links = [(50, i) for i in range(51, 150)] + [(i, i + 1) for i in range(200, 230)] + [(300, 301), (301, 300)]
    got = {r.v: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 50 for i in range(50, 150)} | {i: 200 for i in range(200, 231)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_rules_and_a_hot_url(spark, monkeypatch):
    """The same verdicts with rules in a broadcast and in a shuffle."""
    monkeypatch.setattr(hot, "LEAST", 4)
    urls = ["https://a.net/x"] * 40 + ["https://m.example.net/en/1", "https://x.org/fr/", None, "", "https://y.example.com/de/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = Counter(map(tuple, url_filter.filter_urls(pages).collect()))
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    assert Counter(map(tuple, url_filter.filter_urls(pages).collect())) == want and sum(want.values()) == len(urls)
