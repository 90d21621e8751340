"""Language ID by error-correcting output codes.

Each language gets a codeword of +1 and -1. For each bit a binary n-gram classifier (smoothed log odds of hashed byte
n-grams, averaged over a text) tells the languages of +1 from those of -1. A text's margins are decoded with weighted
losses: each bit's logistic loss counts as much as its classifier is right on that language. The codeword of the least
loss is the answer; where the second one comes close, the answer is flagged as ambiguous.

The n-gram counts come from a sample of about ``SAMPLE_ROWS`` labelled texts, chosen by hash (all, if fewer); centres,
scales and weights of the bits come from all training rows. Every text is read whole.

Cases: null text or text without a letter: ``und`` with score 0, not ambiguous; rows without label are predicted, not
learned from; no training row at all: everything is ``und``; one language: every text with letters is of it, score 1;
repeated rows count each time; other columns are ignored. A null doc_id is not held out and not learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .words import LOWER, slices

#: Labelled rows whose n-grams are counted, about.
SAMPLE_ROWS = 50_000
SAMPLE_PARTS = 32
FEATURES = 1 << 16
GRAMS = (2, 4)
SMOOTH = 0.5
#: An answer is ambiguous if its probability is less than this much above the next one's.
GAP = 0.1
UNKNOWN = "und"

_LETTER = re.compile("[A-Za-z]")
#: Small letters and bytes of other scripts stay, all else is a gap between words.
_PLAIN = np.where(((LOWER >= 0x61) & (LOWER <= 0x7A)) | (LOWER >= 0x80), LOWER, 0x20).astype(np.uint32)


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 per language: all splits of up to 5 languages, else random ones far from each other."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        splits = np.arange(1, 2 ** (n - 1))
        rows = np.concatenate([np.zeros((1, len(splits)), np.int64), (splits[None, :] >> np.arange(n - 1)[:, None]) & 1])
        return (1 - 2 * rows).astype(np.int8)
    bits = int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for seed in range(200):
        code = np.random.Generator(np.random.PCG64(seed)).choice(np.array([-1, 1], np.int8), (n, bits))
        apart = (bits - (code.astype(int) @ code.T.astype(int)))[~np.eye(n, dtype=bool)].min()
        if apart > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, apart
    return best


def features(data: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place of the first byte, hashed feature) of the n-grams that lie in one text and have no two gaps in a row."""
    plain = _PLAIN[data]
    gap = plain == 0x20
    double = gap[1:] & gap[:-1]
    last = np.zeros(len(data) + 1, bool)
    last[ends[1:]] = True
    cut = np.cumsum(last)[:-1]
    blank = np.concatenate([[0], np.cumsum(double)])
    out = []
    for n in GRAMS:
        size = len(data) - n + 1
        if size <= 0:
            continue
        code = np.zeros(size, np.uint32)
        for k in range(n):
            code = (code << np.uint32(8)) | plain[k : k + size]
        code = (code + np.uint32(n)) * np.uint32(2654435761)
        code ^= code >> np.uint32(15)
        code *= np.uint32(2246822519)
        good = (cut[:size] == cut[n - 1 :]) & (blank[n - 1 : n - 1 + size] == blank[:size])
        at = np.flatnonzero(good)
        out.append((at, (code[at] >> np.uint32(16)).astype(np.int64)))
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    """One row in four, by the CRC of its id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_counts(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """The n-gram counts of each language over a sample of (doc_id, text, lang) by hash: as many rows of each language, or all that it has."""
    totals = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    each = max(1, sample_rows // max(1, len(totals)))
    # Hashes are whole numbers from -2**63 on; each language's share of them is taken.
    up_to = [x for lang, n in totals.items() for x in (F.lit(lang), F.lit(min(2**63 - 1, each * 2**64 // n - 2**63)))]
    sample = (rows.where(F.xxhash64("doc_id", "text") <= F.create_map(*up_to)[F.col("lang")]) if up_to else rows).repartition(SAMPLE_PARTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for part, data, ends in slices(batches):
            lang = part.column("lang").to_pylist()
            for at, feature in features(data, ends):
                doc = np.searchsorted(ends, at, "right") - 1
                names, owner = np.unique(lang, return_inverse=True)
                both = np.bincount(owner[doc] * FEATURES + feature, minlength=len(names) * FEATURES).reshape(len(names), FEATURES)
                for name, row in zip(names.tolist(), both, strict=True):
                    counts[name] = counts.get(name, 0) + row
        if counts:
            yield pa.record_batch({"lang": pa.array(list(counts), pa.string()), "counts": pa.array([v.astype(np.int64).tobytes() for v in counts.values()], pa.binary())})

    def add(key: tuple, parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in parts["counts"].to_pylist())
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "lang string, counts binary"
    found = sample.mapInArrow(count, schema).groupBy("lang").applyInArrow(add, schema).collect()  # a row per language
    return {r.lang: np.frombuffer(r["counts"], np.int64) for r in sorted(found)}


def bit_weights(counts: dict[str, np.ndarray], code: np.ndarray) -> np.ndarray:
    """(feature, bit): the log odds of the feature in the bit's languages of +1 against those of -1; a language counts alike however often it is seen."""
    if not code.shape[1]:
        return np.zeros((FEATURES, 0), np.float32)
    shares = np.stack([(c + SMOOTH) / (c.sum() + SMOOTH * FEATURES) for c in counts.values()])
    out = []
    for bit in code.T:
        out.append(np.log(shares[bit > 0].mean(0)) - np.log(shares[bit < 0].mean(0)))
    return np.stack(out, axis=1).astype(np.float32)


def margins(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, text_hash, lang, letters (whether the text has any) and the raw margins of all bits."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        bits = weights.shape[1]
        for part, data, ends in slices(batches):
            sums, n = np.zeros((len(part), bits)), np.zeros(len(part))
            for at, feature in features(data, ends):
                edge = np.searchsorted(at, ends)
                full = np.flatnonzero(np.diff(edge))
                if len(full) and bits:
                    sums[full] += np.add.reduceat(weights[feature], edge[full], axis=0)
                n += np.diff(edge)
            letters = [t is not None and (_LETTER.search(t) is not None or any(map(str.isalpha, t))) for t in part.column("text").to_pylist()]
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "text_hash": part.column("text_hash"),
                    "lang": part.column("lang"),
                    "letters": pa.array(letters, pa.bool_()),
                    "margins": pa.FixedSizeListArray.from_arrays(pa.array((sums / np.maximum(n, 1)[:, None]).ravel()), max(bits, 1)).cast(pa.list_(pa.float64())) if bits else pa.array([[]] * len(part), pa.list_(pa.float64())),
                }
            )

    return docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(measure, "doc_id bigint, text_hash bigint, lang string, letters boolean, margins array<double>")


def calibration(measured: DataFrame, langs: list[str], code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre and scale of each bit, and how often each bit is right on each language, over the training rows."""
    bits = code.shape[1]
    if not bits:
        return np.zeros(0), np.ones(0), np.ones((len(langs), 0))
    means = {r.lang: r.m for r in measured.groupBy("lang").agg(F.array(*(F.avg(F.col("margins")[j]) for j in range(bits))).alias("m")).collect()}
    mean = np.array([means.get(x, [0.0] * bits) for x in langs])
    up = np.array([mean[code[:, j] > 0, j].mean() for j in range(bits)])
    down = np.array([mean[code[:, j] < 0, j].mean() for j in range(bits)])
    centre, scale = (up + down) / 2, np.maximum((up - down) / 2, 1e-6)
    right = {r.lang: r.m for r in measured.groupBy("lang").agg(F.array(*(F.avg((F.col("margins")[j] > float(centre[j])).cast("double")) for j in range(bits))).alias("m")).collect()}
    above = np.array([right.get(x, [0.5] * bits) for x in langs])
    return centre, scale, np.where(code > 0, above, 1 - above)


def decode(margin: np.ndarray, code: np.ndarray, centre: np.ndarray, scale: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The probability of each language: weighted logistic losses against each codeword, as a softmax."""
    f = (margin - centre) / scale
    weight = right / np.maximum(right.sum(1, keepdims=True), 1e-9) * code.shape[1]
    loss = np.stack([(np.logaddexp(0, -2 * f * c) * w).sum(1) for c, w in zip(code, weight, strict=True)], axis=1)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    return p / p.sum(1, keepdims=True)


def identify(docs: DataFrame, learn_from: Column | None = None, sample_rows: int = SAMPLE_ROWS, gap: float = GAP) -> DataFrame:
    """For each row: doc_id, text_hash (xxhash64), lang_pred, score and ambiguous. Learns from rows with a label where ``learn_from`` holds."""
    chosen = F.coalesce(learn_from if learn_from is not None else ~held_out(), F.lit(False)) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    counts = gram_counts(docs.where(chosen).select("doc_id", "text", "lang"), sample_rows)
    langs = list(counts)
    code = codewords(len(langs))
    measured = stored(margins(docs, bit_weights(counts, code)), "margins")
    usable = measured.where((~held_out() if learn_from is None else learn_from) & F.col("doc_id").isNotNull() & F.col("letters") & F.col("lang").isNotNull())
    model = (code.astype(np.float64), *calibration(usable, langs, code))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, letters = len(batch), np.array(batch.column("letters").to_pylist(), bool)
            if langs and n:
                p = decode(batch.column("margins").flatten().to_numpy(zero_copy_only=False).reshape(n, -1), *model) if len(langs) > 1 else np.ones((n, 1))
                order = np.sort(p, axis=1)
                best, score = p.argmax(1), order[:, -1]
                close = letters & (score - (order[:, -2] if len(langs) > 1 else 0) < gap)
            else:
                letters, best, score, close = np.zeros(n, bool), np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "text_hash": batch.column("text_hash"),
                    "lang_pred": pa.array([langs[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)], pa.string()),
                    "score": pa.array(np.round(np.where(letters, score, 0.0), 6)),
                    "ambiguous": pa.array(close),
                }
            )

    return measured.mapInArrow(choose, "doc_id bigint, text_hash bigint, lang_pred string, score double, ambiguous boolean")
