"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; letters with a blank around every run of letters make 1- to 3-grams,
hashed into BINS columns. Counts over all training rows become a matrix of log probabilities of
BLOCK languages at most, which is broadcast; more languages come in further matrices, each of
which a further pass holds against the best language so far. Tasks score batches sparsely: one
lookup for each n-gram, summed by text.

A null text or one without a letter is `und` with score 0. Without any training row all are
`und`. The score is the posterior of the best language with the n-gram count damped to its
square root, as n-grams of one text are far from independent. Ties go to the smallest name.
Repeated rows learn as often as they stand and are judged alike; long texts are read whole, a
slice of texts at a time; an empty table gives an empty result. Only doc_id, text and lang are
read, so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import U64, chunks, cut, held_out, mix, training_row

BINS = 1 << 14
#: Languages of one matrix; with BINS it bounds what is broadcast (256 x 16384 doubles, 32 MB).
BLOCK = 256
#: Languages a training task counts at once (8 MB); more are passed on in parts.
COUNTED = 64


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts and the text each belongs to."""
    whole = "\n".join([*((x or b"").decode().replace("\n", " ") for x in texts), ""])
    code = np.frombuffer(whole.lower().encode("utf-32-le"), np.uint32)
    doc = np.cumsum(code == 10) - (code == 10)
    letter = letters()[code]
    code = np.where(letter, code, 32).astype(U64)
    use = letter.copy()
    use[1:] |= letter[:-1]
    use[:-1] |= letter[1:]
    code, doc, letter = code[use], doc[use], letter[use]
    out, at = [code[letter] * U64(3)], [doc[letter]]
    for n in (2, 3):
        m = len(code) - n + 1
        if m > 0:
            h = np.zeros(m, U64)
            any_letter = np.zeros(m, bool)
            for k in range(n):
                h = h * U64(0x100000001B3) + code[k : k + m]
                any_letter |= letter[k : k + m]
            same = (doc[:m] == doc[n - 1 :]) & any_letter
            out.append(h[same] * U64(3) + U64(n - 1))
            at.append(doc[:m][same])
    return (mix(np.concatenate(out)) % U64(BINS)).astype(np.int64), np.concatenate(at)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for name, sums in total.items():
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(used) + 1)), pa.array(np.append(used, -1)), pa.array(np.append(sums[used], rows[name]))], names=["lang", "bin", "n"])
        total.clear()
        rows.clear()

    for batch in batches:
        for part, texts in chunks(batch):
            names = part.column("lang").to_pylist()
            bins, doc = grams(texts)
            kinds, of, times = np.unique(np.array(names, object), return_inverse=True, return_counts=True)
            for at in range(0, len(kinds), COUNTED):
                if len(total) >= COUNTED:
                    yield from passed_on()
                some = kinds[at : at + COUNTED]
                here = (of[doc] >= at) & (of[doc] < at + COUNTED)
                sums = np.bincount((of[doc[here]] - at) * BINS + bins[here], minlength=len(some) * BINS).reshape(len(some), BINS)
                for k, name in enumerate(some):
                    total[name] = total.get(name, 0) + sums[k]
                    rows[name] = rows.get(name, 0) + int(times[at + k])
    yield from passed_on()


def train(docs: DataFrame) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Blocks of languages in order of name: names, log priors and log probabilities, from all training rows of docs (doc_id, text, lang)."""
    rows = docs.where(training_row() & F.col("lang").isNotNull()).select("text", "lang")
    sums = cut(rows.mapInArrow(counted, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")))
    numbers = sums.where("bin = -1")
    total, last = numbers.agg(F.sum("n")).first()[0], None
    while True:
        left = numbers if last is None else numbers.where(F.col("lang") > last)
        names = [r["lang"] for r in left.select("lang").orderBy("lang").limit(BLOCK).collect()]
        if not names:
            return
        last = names[-1]
        # At most BLOCK x (BINS + 1) small rows, whatever the input.
        got = sums.where(F.col("lang").between(names[0], last)).toArrow()
        row = np.searchsorted(np.array(names, object), np.array(got.column("lang").to_pylist(), object))
        bins, n = got.column("bin").to_numpy(), got.column("n").to_numpy()
        matrix, prior = np.full((len(names), BINS), 0.1), np.zeros(len(names))
        prior[row[bins < 0]] = n[bins < 0]
        matrix[row[bins >= 0], bins[bins >= 0]] += n[bins >= 0]
        yield names, np.log(prior / total), np.log(matrix) - np.log(matrix.sum(1, keepdims=True))


def scored(model):
    """Holds the languages of one block against the best so far: lang_pred, its value `top` and the sum `mass` of exp(value - top) of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prior, columns = model.value
        for batch in batches:
            for rows, texts in chunks(batch):
                bins, doc = grams(texts)
                n = np.bincount(doc, minlength=len(texts))
                damped = np.maximum(np.sqrt(n), 1)[:, None]
                sums = np.stack([np.bincount(doc, weights=columns[bins, k], minlength=len(texts)) for k in range(len(names))], 1)
                sums = (prior + sums) / damped
                best, top = sums.argmax(1), sums.max(1)
                old, mass = rows.column("top").to_numpy(), rows.column("mass").to_numpy()
                new = np.maximum(old, top)
                mass = np.where(n > 0, mass * np.exp(old - new) + np.exp(sums - new[:, None]).sum(1), 0.0)
                pred = [p if not k or a >= b else names[t] for p, k, a, b, t in zip(rows.column("lang_pred").to_pylist(), n, old, top, best, strict=True)]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", "text", "held_out")), pa.array(pred, pa.string()), pa.array(new), pa.array(mass)], names=["doc_id", "text", "held_out", "lang_pred", "top", "mass"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text, lang)."""
    rows = docs.select("doc_id", "text", held_out().alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("mass"))
    for k, (names, prior, matrix) in enumerate(train(docs)):
        model = docs.sparkSession.sparkContext.broadcast((names, prior, np.ascontiguousarray(matrix.T)))
        rows = (cut(rows) if k else rows).mapInArrow(scored(model), "doc_id long, text string, held_out boolean, lang_pred string, top double, mass double")
    return rows.select("doc_id", "held_out", "lang_pred", F.when(F.col("mass") > 0, 1 / F.col("mass")).otherwise(0.0).alias("score"))
