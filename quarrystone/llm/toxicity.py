"""Toxicity by a small bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm import words as W
from quarrystone.llm.store import ship

ship(__name__)

#: Words of a window, and words from one window's start to the next: windows overlap by eight words.
LENGTH, STRIDE = 32, 24
#: Buckets of hashed words and of hashed character trigrams, and the width of each embedding.
WORD_BUCKETS, CHAR_BUCKETS, WIDTH = 1 << 13, 1 << 12, 8
#: Units of each direction.
UNITS = 8
#: The network is fitted on at most so many labelled documents of each class (the first in the order of a hash
#: of their id), of at most so many bytes each.
TRAIN_EACH, TRAIN_BYTES = 1200, 30_000
EPOCHS, BATCH, RATE = 10, 128, 0.01
#: Share of the words of a batch that are known by their trigrams alone.
DROPPED = 0.5
#: Few labelled rows give few steps an epoch; then there are more epochs, up to the steps that a full sample makes in EPOCHS.
LEAST_STEPS = 230
#: Windows that are scored at once, few enough for a step's arrays to stay in a core's cache.
AT_ONCE = 2048


def features(read: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids: for each word the number of its distinct word; bucket of each distinct word; trigram buckets of the distinct words, one after the other; where each one's trigrams begin."""
    h = read.hashes(3)
    distinct, at, ids = np.unique(h, return_index=True, return_inverse=True)
    start, length = read.start[at], read.end[at] - read.start[at]
    # Each distinct word's bytes between two marks: trigrams at each of its bytes.
    begin = np.cumsum(length) - length
    pos = np.arange(length.sum()) - np.repeat(begin, length)
    src = np.repeat(start, length) + pos
    norm = np.concatenate(([32], read.norm)).astype(np.uint64)  # shifted by one: the byte before a word is a space
    before = np.where(pos == 0, np.uint64(32), norm[src])
    after = norm[np.minimum(src + 2, len(norm) - 1)]
    tri = W.mixed((before << np.uint64(16)) | (norm[src + 1] << np.uint64(8)) | after)
    return ids.astype(np.int64), (distinct % np.uint64(WORD_BUCKETS)).astype(np.int64), (tri % np.uint64(CHAR_BUCKETS)).astype(np.int64), begin


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of all texts: the text, the first word, the number of words. A text without words has none."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, -(-(n - (LENGTH - STRIDE)) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(n)), count)
    start = first[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return doc, start, np.minimum(LENGTH, first[1:][doc] - start)


def new_network(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    u, d = UNITS, 2 * WIDTH
    net = {"word": rng.normal(0, 0.1, (WORD_BUCKETS, WIDTH)), "char": rng.normal(0, 0.1, (CHAR_BUCKETS, WIDTH))}
    for side in "fb":
        net[f"wx_{side}"] = rng.normal(0, d**-0.5, (d, 3 * u))
        net[f"wh_{side}"] = rng.normal(0, u**-0.5, (u, 3 * u))
        net[f"b_{side}"] = np.zeros(3 * u)
    net |= {"attend": rng.normal(0, 0.3, 2 * u), "out": rng.normal(0, 0.3, 2 * u), "bias": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in net.items()} | {"cut": np.zeros(2, np.float32)}


def inputs(net: dict, bucket: np.ndarray, tri: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The word and character inputs of each distinct word."""
    if not len(bucket):
        return np.zeros((0, 2 * WIDTH), np.float32)
    n = np.diff(np.append(begin, len(tri)))[:, None].astype(np.float32)
    return np.concatenate([net["word"][bucket], np.add.reduceat(net["char"][tri], begin, 0) / np.sqrt(n)], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def soft(x: np.ndarray) -> np.ndarray:
    """The network's squashing function from -1 to 1, several times as fast as tanh; gates use soft(x) / 2 + 1 / 2."""
    return x / (1 + np.abs(x))


def _direction(net: dict, side: str, gates: np.ndarray, mask: np.ndarray, order: range, keep: list | None) -> np.ndarray:
    """States (windows, steps, units). gates: (windows, steps, 3 * units) from the inputs. keep gets what the backward pass needs."""
    u, h = UNITS, np.zeros((len(gates), UNITS), np.float32)
    states = np.empty((len(gates), LENGTH, UNITS), np.float32)
    for t in order:
        g, rec = gates[:, t], h @ net[f"wh_{side}"]
        zr = 0.5 * soft(g[:, : 2 * u] + rec[:, : 2 * u]) + 0.5
        z, r = zr[:, :u], zr[:, u:]
        n = soft(g[:, 2 * u :] + r * rec[:, 2 * u :])
        new = n + z * (h - n)
        m = mask[:, t, None]
        new = h + m * (new - h)
        if keep is not None:
            keep.append((t, h, z, r, n, rec[:, 2 * u :], m))
        states[:, t] = h = new
    return states


def forward(net: dict, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """The logit of each window. x: inputs of distinct words; ids: (windows, steps) numbers of distinct words; mask: 1 where there is a word."""
    states = []
    for side, order in (("f", range(LENGTH)), ("b", range(LENGTH - 1, -1, -1))):
        gates = (x @ net[f"wx_{side}"] + net[f"b_{side}"])[ids]
        saved: list | None = [] if keep is not None else None
        states.append(_direction(net, side, gates, mask, order, saved))
        if keep is not None:
            keep[side] = saved
    both = np.concatenate(states, 2)
    weight = both @ net["attend"] - 1e9 * (1 - mask)
    weight = np.exp(weight - weight.max(1, keepdims=True)) * mask
    weight /= np.maximum(weight.sum(1, keepdims=True), 1e-9)
    pooled = np.einsum("wt,wtd->wd", weight, both)
    if keep is not None:
        keep |= {"both": both, "weight": weight, "pooled": pooled}
    return pooled @ net["out"] + net["bias"][0]


def backward(net: dict, x: np.ndarray, ids: np.ndarray, keep: dict, d_logit: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the recurrent, attention and output weights, and "x": of the inputs of the distinct words."""
    u, grads = UNITS, {}
    both, weight, pooled = keep["both"], keep["weight"], keep["pooled"]
    grads["out"], grads["bias"] = pooled.T @ d_logit, np.array([d_logit.sum()])
    d_pool = d_logit[:, None] * net["out"]
    d_both = weight[:, :, None] * d_pool[:, None]
    d_w = np.einsum("wtd,wd->wt", both, d_pool)
    d_e = weight * (d_w - (weight * d_w).sum(1, keepdims=True))
    grads["attend"] = np.einsum("wt,wtd->d", d_e, both)
    d_both += d_e[:, :, None] * net["attend"]
    d_x = np.zeros_like(x)
    for side, part in (("f", slice(0, u)), ("b", slice(u, 2 * u))):
        wh = net[f"wh_{side}"]
        d_h = np.zeros((len(ids), u), np.float32)
        d_gates = np.zeros((len(ids), LENGTH, 3 * u), np.float32)
        d_wh = np.zeros_like(wh)
        for t, h, z, r, n, rec_n, m in reversed(keep[side]):
            d_new = d_h + d_both[:, t, part]
            d_cell, d_h = d_new * m, d_new * (1 - m)
            d_n, d_z = d_cell * (1 - z), d_cell * (h - n)
            d_h = d_h + d_cell * z
            d_an = d_n * (1 - np.abs(n)) ** 2
            d_r = d_an * rec_n
            d_az, d_ar = d_z * 0.5 * (1 - np.abs(2 * z - 1)) ** 2, d_r * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            d_rec = np.concatenate([d_az, d_ar, d_an * r], 1)
            d_gates[:, t] = np.concatenate([d_az, d_ar, d_an], 1)
            d_wh += h.T @ d_rec
            d_h = d_h + d_rec @ wh.T
        grads[f"wh_{side}"] = d_wh
        flat, order = ids.ravel(), np.argsort(ids.ravel(), kind="stable")
        own, at = np.unique(flat[order], return_index=True)
        summed = np.add.reduceat(d_gates.reshape(-1, 3 * u)[order], at, 0)
        grads[f"b_{side}"] = summed.sum(0)
        grads[f"wx_{side}"] = x[own].T @ summed
        d_x[own] += summed @ net[f"wx_{side}"].T
    grads["x"] = d_x
    return grads


def window_ids(ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(LENGTH)
    at = np.minimum(start[:, None] + steps, len(ids) - 1)
    return ids[at], (steps < n[:, None]).astype(np.float32)


def _swept(side: str, net: dict, table: np.ndarray, ids: np.ndarray, mask: np.ndarray, full: np.ndarray, order: range) -> np.ndarray:
    """States (steps, windows, units) as forward() has them, without what learning needs. table: gates of each distinct word; ids, mask: (steps, windows)."""
    u = UNITS
    h = np.zeros((ids.shape[1], u), np.float32)
    states = np.empty((LENGTH, ids.shape[1], u), np.float32)
    for t in order:
        g, rec = np.take(table, ids[t], 0), h @ net[f"wh_{side}"]
        zr = g[:, : 2 * u] + rec[:, : 2 * u]
        size = np.abs(zr)
        size += 1
        zr /= size
        zr *= 0.5
        zr += 0.5
        n = zr[:, u:] * rec[:, 2 * u :]
        n += g[:, 2 * u :]
        size = np.abs(n)
        size += 1
        n /= size
        new = h - n
        new *= zr[:, :u]
        new += n
        if not full[t]:
            new = np.where(mask[t, :, None], new, h)
        states[t] = h = new
    return states


def window_logits(net: dict, x: np.ndarray, ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The logit of each window."""
    u, tables = UNITS, {}
    for side in "fb":
        tables[side] = x @ net[f"wx_{side}"] + net[f"b_{side}"]
    steps, out = np.arange(LENGTH)[:, None], []
    for i in range(0, len(start), AT_ONCE):
        a, k = start[None, i : i + AT_ONCE], n[None, i : i + AT_ONCE]
        own, mask = ids[np.minimum(a + steps, len(ids) - 1)], steps < k
        full = mask.all(1)
        f = _swept("f", net, tables["f"], own, mask, full, range(LENGTH))
        b = _swept("b", net, tables["b"], own, mask, full, range(LENGTH - 1, -1, -1))
        weight = np.where(mask, f @ net["attend"][:u] + b @ net["attend"][u:], np.float32(-1e9))
        weight = np.exp(weight - weight.max(0))
        value = f @ net["out"][:u] + b @ net["out"][u:]
        out.append((weight * value).sum(0) / weight.sum(0) + net["bias"][0])
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def fitted(rows: list[tuple[bytes, int]], seed: int = 5, clean_weight: float = 1.0) -> dict[str, np.ndarray]:
    """A network fitted to (text, label) rows. A document is as toxic as its worst window: each epoch learns from the
    window that now looks worst in each document, and from one more of each clean document. A fifth of the rows, left out of
    learning, sets the logit at which the score is one half; there a wrongly rejected clean row weighs as clean_weight missed toxic ones."""
    # Rows without a word have no window to learn from.
    rows = [r for r, n in zip(rows, np.diff(W.Words([t for t, _ in rows], W.separators("alnum")).first), strict=True) if n] if rows else rows
    net = new_network(seed)
    if len({y for _, y in rows}) < 2:
        net["cut"] = np.array([1.0, (1 if not rows or not rows[0][1] else -1) * 20.0], np.float32)
        return net
    rng = np.random.default_rng(seed)
    label = np.array([y for _, y in rows], np.float32)
    test = np.arange(len(rows)) % 5 == 4
    read = W.Words([t for t, _ in rows], W.separators("alnum"), W.lowered())
    ids, bucket, tri, begin = features(read)
    doc, start, n = windows(read.first)
    # At first the worst window is the one with the word most of whose documents are toxic.
    word_doc = np.unique(np.repeat(np.arange(len(rows)), np.diff(read.first)) * len(bucket) + ids)
    learn = ~test[word_doc // len(bucket)]
    bad = np.bincount((word_doc % len(bucket))[learn], label[(word_doc // len(bucket))[learn]], len(bucket))
    odds = np.log((bad + 0.5) / (np.bincount((word_doc % len(bucket))[learn], minlength=len(bucket)) - bad + 0.5))
    looks = np.array([odds[ids[a : a + k]].max() for a, k in zip(start.tolist(), n.tolist(), strict=True)], np.float32)
    mean = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items() if k != "cut"}
    step = 0
    trigrams = np.diff(np.append(begin, len(tri)))
    epochs = max(EPOCHS, -(-LEAST_STEPS // max(1, -(-(3 * int((~test).sum()) // 2) // BATCH))))
    for epoch in range(epochs):
        if epoch:
            looks = window_logits(net, inputs(net, bucket, tri, begin), ids, start, n)
        order = np.lexsort((looks, doc))
        worst = order[np.append(np.flatnonzero(np.diff(doc[order])), len(order) - 1)]
        clean = np.flatnonzero(label[doc] == 0)
        pick = np.concatenate([worst, rng.permutation(clean)[: len(worst) // 2]])
        pick = rng.permutation(pick[~test[doc[pick]]])
        for i in range(0, len(pick), BATCH):
            own = pick[i : i + BATCH]
            w, mask = window_ids(ids, start[own], n[own])
            distinct, local = np.unique(w, return_inverse=True)
            local = local.reshape(w.shape)
            spans = [tri[begin[k] : begin[k] + trigrams[k]] for k in distinct]
            sizes = np.array([len(s) for s in spans])
            t, b = np.concatenate(spans), np.cumsum(sizes) - sizes
            x, keep = inputs(net, bucket[distinct], t, b), {}
            # Now and then a word is known by its trigrams alone, so that unseen words of the same make are told too.
            seen = ((rng.random((len(x), 1)) >= DROPPED) / (1 - DROPPED)).astype(np.float32)
            x[:, :WIDTH] *= seen
            y = label[doc[own]]
            logit = forward(net, x, local, mask, keep)
            grads = backward(net, x, local, keep, ((_sigmoid(logit) - y) / len(own)).astype(np.float32))
            d_x = grads.pop("x")
            grads["word"], grads["char"] = np.zeros_like(net["word"]), np.zeros_like(net["char"])
            np.add.at(grads["word"], bucket[distinct], d_x[:, :WIDTH] * seen)
            np.add.at(grads["char"], t, np.repeat(d_x[:, WIDTH:] / np.sqrt(sizes)[:, None], sizes, 0))
            step += 1
            for k, g in grads.items():
                first, second = mean[k]
                first += 0.1 * (g - first)
                second += 0.01 * (g * g - second)
                net[k] -= (RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    top = np.full(len(rows), -np.inf)
    np.maximum.at(top, doc, window_logits(net, inputs(net, bucket, tri, begin), ids, start, n))
    own = test & np.isfinite(top)
    if len({*label[own]}) < 2:
        own = np.isfinite(top)
    values, y = top[own], label[own]
    order = np.argsort(values)
    values, y = values[order], y[order]
    # Between two neighbours, where the fewest rows are on the wrong side. The middle of the best places.
    wrong = np.concatenate(([0], np.cumsum(y == 1))) + clean_weight * np.concatenate((np.cumsum((y == 0)[::-1])[::-1], [0]))
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    at = int(best[len(best) // 2])
    cut = values[0] - 1 if at == 0 else values[-1] + 1 if at == len(values) else (values[at - 1] + values[at]) / 2
    net["cut"] = np.array([1.0, cut], np.float32)
    return net


def score(net: dict, texts: list[bytes | None]) -> np.ndarray:
    """The toxicity of each whole text, from 0 to 1: of its worst window. A text without words scores as a window without words would."""
    read = W.Words(texts, W.separators("alnum"), W.lowered())
    top = np.full(len(texts), -np.inf)
    if len(read.start):
        ids, bucket, tri, begin = features(read)
        doc, start, n = windows(read.first)
        np.maximum.at(top, doc, window_logits(net, inputs(net, bucket, tri, begin), ids, start, n))
    top = np.where(np.isfinite(top), top, min(float(net["bias"][0]), float(net["cut"][1]) - 4))
    return 1 / (1 + np.exp(-np.clip(net["cut"][0] * (top - net["cut"][1]), -30, 30).astype(np.float64)))


def _scorer(net: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in W.blocks(batches):
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score(net, texts), pa.float64())], names=[*names, "score"])

    return run


def held_out(doc_id="doc_id"):
    """Rows that no label is learned from. A document without an id isn't one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """A network from at most TRAIN_EACH labelled documents of each class that aren't held out. Their ids are chosen in the labels alone; then their texts are read."""
    own = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").distinct()
    own = own.withColumn("_order", F.xxhash64("doc_id"))
    ids = [r for y in (0, 1) for r in own.where(F.col("toxic") == y).orderBy("_order", "doc_id").limit(TRAIN_EACH).select("doc_id", "toxic").collect()]
    if not ids:
        return fitted([])
    # A row of the sample stands for as many as its class has for each that was taken.
    total = {r[0]: r[1] for r in own.groupBy("toxic").count().collect()}
    stands_for = [total.get(y, 0) / max(1, sum(r[1] == y for r in ids)) for y in (0, 1)]
    # The root of the classes' ratio lies between counting the sample's rows and counting the corpus's.
    weight = (stands_for[0] / stands_for[1]) ** 0.5 if min(stands_for) else 1.0
    chosen = docs.sparkSession.createDataFrame([(int(r[0]), int(r[1])) for r in ids], "id long, toxic int")
    own = docs.where(F.octet_length("text") <= TRAIN_BYTES).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t"))
    # One text for each id, that of the least hash, so at most 2 * TRAIN_EACH rows however often an id's rows repeat.
    rows = own.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t")).collect()
    return fitted([(t.encode(), y) for _, t, y in sorted((r["id"], r["t"], r["toxic"]) for r in rows)], clean_weight=weight)


def toxic_scores(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep and score, a row for each document."""
    net = trained(docs, labels)
    kept = docs.select(*keep).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double"
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(_scorer(net), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document, repeated ones and those without an id too: doc_id, held_out, score, predicted.

    Null and empty texts get a score of well under one half. A long text is scored in all its windows. An empty table gives no rows; without
    labels of both classes every score is near that of the only class, or of clean.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = toxic_scores(rows, labels, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with their columns, whatever these are named."""
    short = [f"c{i}" for i in range(len(docs.columns))]
    net = trained(docs.select("doc_id", "text"), labels)
    renamed = docs.select(*(docs[c].alias(s) for c, s in zip(docs.columns, short, strict=True)), docs["text"].cast("string").alias("text"))
    schema = ", ".join(f"`{s}` {docs.schema[c].dataType.simpleString()}" for c, s in zip(docs.columns, short, strict=True)) + ", score double"
    return renamed.mapInArrow(_scorer(net), schema).where("score < 0.5").select(*(F.col(s).alias(c) for c, s in zip(docs.columns, short, strict=True)))
