"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, from a block-max inverted index.

Examples are a bounded, class-balanced sample of the labelled training rows: EXAMPLES of either
class in the order of a hash, until they hold SAMPLE_BYTES of text. Tasks count their words; the
driver gets the counts, no text. All their words are terms, with document frequencies counted
over all documents. A query's own length scales all its cosines alike, which neither order nor
votes see: words that no example holds change nothing.

What else there is to choose is chosen by FOLDS of the examples, never by held-out rows: how many
neighbours vote, with what power of their cosine, and whether a word that stands with label 1 beyond
chance weighs more by sqrt(1 + chi-squared) than its TF-IDF. Each fold is scored by an index of the
others, with weights that its own labels had no part in; texts of the same words share a fold. The least
squared error wins, and of equals the first of SETTINGS, plain TF-IDF before weights that lean.

The index lists each term's examples with their weights. Rare terms are summed from their lists;
of the COMMON most frequent terms each block of examples keeps the largest weight. Bounds are a
block's best rare sum and those maxima; blocks are scored from the largest bound down until no
bound reaches the k-th best cosine, so the neighbours are exact.
Neighbours vote with that power of their cosine, weighted back to the class shares of the
labels; a monotone fit over the examples' votes out of their folds turns votes into scores.
The EVIDENCE neighbours of most votes come with the score: their doc_id, label and share of the votes.

Null and empty texts, and texts without a term, have no neighbour and get the share of label 1
among such examples, without evidence. Several labels of an id count as 1 if any is. Ties between
neighbours go to the lower place in the index. Repeated rows are scored alike, as examples they
count once; long texts are read whole, a slice of texts at a time. Without labelled rows all scores
are 0; an empty table gives an empty result. Only doc_id and text of docs, doc_id and toxic of labels
are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import NOT_ALNUM, U64, chunks, cut, held_out, training_row, words_of

EXAMPLES, SAMPLE_BYTES, BLOCK, EVIDENCE = 2500, 64_000_000, 64, 3
#: What the folds choose from: whether weights lean to label 1, neighbours, power of the cosine.
FOLDS = 5
SETTINGS = [(leans, k, power) for leans in (False, True) for k in (15, 5, 45) for power in (1, 2, 4)]
#: Terms with block maxima, and the most list entries and queries that are summed at once.
COMMON, ENTRIES, QUERIES = 1024, 2_000_000, 128
#: The least chi-squared value, and examples that hold it, of a term that weighs more.
CHI2, LEAST_DF = 15.0, 3
THRESHOLD = 0.3


def example_rows(docs: DataFrame, labels: DataFrame) -> tuple[list, dict[int, int]]:
    """(doc_id, toxic, word hashes, times) of the sampled training rows, and how many training labels either class has."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(training_row())
    rows = docs.where("text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("h"))
    # Labels meet the documents before any limit: a label without a usable text takes no place.
    keys = cut(rows.select("doc_id", "h", F.octet_length("text").alias("size")).join(marked, "doc_id").distinct())
    shares = {r["toxic"]: r["count"] for r in keys.groupBy("toxic").count().collect()}
    chosen = []
    for value in (0, 1):
        left = SAMPLE_BYTES
        for r in keys.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(EXAMPLES).collect():
            # The last one may pass the bound: whether a text is taken doesn't depend on its length.
            if left > 0:
                left -= r["size"]
                chosen.append((r["doc_id"], r["h"], value, len(chosen)))
    if not chosen:
        return [], shares

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                w = words_of(texts, NOT_ALNUM)
                words = [np.unique(w.hash[a:b].view(np.int64), return_counts=True) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                columns = [pa.array([x[k] for x in words], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("place", "doc_id", "toxic")), *columns], names=["place", "doc_id", "toxic", "words", "times"])

    ids = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, h long, toxic int, place int"))
    # 2 * EXAMPLES rows, of 2 * SAMPLE_BYTES and two texts at most; of repeated rows one.
    got = rows.join(ids, ["doc_id", "h"]).select("place", "doc_id", "toxic", "text").mapInArrow(counted, "place int, doc_id long, toxic int, words array<long>, times array<long>").dropDuplicates(["place"]).toArrow()
    order = np.argsort(got.column("place").to_numpy())
    array = lambda c, i: got.column(c)[i].values.to_numpy()
    return [(got.column("doc_id")[i].as_py(), got.column("toxic")[i].as_py(), array("words", i).view(U64), array("times", i)) for i in order.tolist()], shares


def leaning(doc: np.ndarray, term: np.ndarray, toxic: np.ndarray, n_terms: int) -> np.ndarray:
    """Each term's factor: above 1 where it stands with label 1 beyond chance."""
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    every = np.bincount(term, minlength=n_terms).astype(float)
    a = np.bincount(term, toxic[doc], minlength=n_terms)
    b, n = every - a, n0 + n1
    chi2 = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum(1, every * (n - every) * n1 * n0)
    return np.where((every >= LEAST_DF) & (a * n0 > b * n1) & (chi2 >= CHI2), np.sqrt(1 + chi2), 1.0)


def counts_in(texts: list[bytes | None], terms: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of all terms in the texts; terms are ascending word hashes and their numbers."""
    known, ids = terms
    w = words_of(texts, NOT_ALNUM)
    if not len(known) or not len(w.hash):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
    hit = known[at] == w.hash
    pair, times = np.unique(w.doc[hit] * len(known) + ids[at[hit]], return_counts=True)
    return pair // len(known), pair % len(known), times


def entries(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The places of first[i]:last[i] for all i, one after the other."""
    n = last - first
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


@dataclass
class Index:
    terms: tuple[np.ndarray, np.ndarray]
    #: Inverse document frequency, times leaning where weights lean.
    idf: np.ndarray
    #: Postings of term t are at first[t]:first[t + 1]. The first terms are the common ones: of
    #: these `cut[t]` has where each block begins in the postings, `most[t]` each block's largest weight.
    first: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    cut: np.ndarray
    most: np.ndarray
    vote: np.ndarray
    toxic: np.ndarray
    ids: np.ndarray
    raw: np.ndarray
    score: np.ndarray
    none: float
    k: int = SETTINGS[0][1]
    power: int = SETTINGS[0][2]
    dense: dict[int, np.ndarray] = field(default_factory=dict)

    def block(self, b: int) -> np.ndarray:
        """Weights of the common terms in the examples of block b."""
        if b not in self.dense:
            lo, hi = self.cut[:, b], self.cut[:, b + 1]
            at, out = entries(lo, hi), np.zeros((len(self.most), BLOCK))
            out[np.repeat(np.arange(len(lo)), hi - lo), self.example[at] - b * BLOCK] = self.weight[at]
            self.dense[b] = out
        return self.dense[b]

    def batch(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine of n queries, best first, and their cosines; 0 where there are fewer."""
        common, blocks = self.most.shape
        wide, rare = blocks * BLOCK, term >= common
        lo, hi = self.first[term[rare]], self.first[term[rare] + 1]
        at, n_at = entries(lo, hi), hi - lo
        sums = np.bincount(np.repeat(doc[rare], n_at) * wide + self.example[at], np.repeat(weight[rare], n_at) * self.weight[at], minlength=n * wide).reshape(n, blocks, BLOCK)
        query = np.zeros((n, common))
        query[doc[~rare], term[~rare]] = weight[~rare]
        limit = sums.max(2) + query @ self.most
        order = np.argsort(-limit, axis=1, kind="stable")
        sims, least, k = np.zeros((n, blocks, BLOCK)), np.zeros(n), min(k, wide)
        flat = sims.reshape(n, wide)
        for a, b in ((0, 4), (4, 16), (16, blocks)):
            want = np.zeros((n, blocks), bool)
            np.put_along_axis(want, order[:, a:b], True, 1)
            # A hair below the k-th best, as sums of another order round another way.
            want &= (limit > 0) & (limit >= least[:, None] * (1 - 1e-9))
            for at in np.flatnonzero(want.any(0)):
                asked = np.flatnonzero(want[:, at])
                sims[asked, at] = sums[asked, at] + query[asked] @ self.block(at)
            least = np.partition(flat, wide - k, axis=1)[:, wide - k]
        ids = np.argpartition(-flat, k - 1, axis=1)[:, :k]
        for i in np.flatnonzero((flat >= least[:, None]).sum(1) > k):
            ids[i] = np.argsort(-flat[i], kind="stable")[:k]
        got = np.take_along_axis(flat, ids, 1)
        best = np.lexsort((ids, -got))
        return np.take_along_axis(ids, best, 1), np.take_along_axis(got, best, 1)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine above 0, and their cosines (times the query's length)."""
        ids, sims = self.batch(np.zeros(len(term), np.int64), term, weight, 1, k)
        return ids[sims > 0], sims[sims > 0]

    def near(self, doc: np.ndarray, term: np.ndarray, times: np.ndarray, n: int, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Texts a to b of n, their k nearest examples and cosines, best first; a cosine of 0 is no neighbour."""
        bounds = np.searchsorted(doc, np.arange(n + 1))
        work = np.append(0, np.cumsum(np.where(term >= len(self.most), self.first[term + 1] - self.first[term], 0)))[bounds]
        a = 0 if len(self.vote) else n
        while a < n:
            b = min(max(a + 1, int(np.searchsorted(work, work[a] + ENTRIES))), a + QUERIES, n)
            x = slice(bounds[a], bounds[b])
            ids, sims = self.batch(doc[x] - a, term[x], (1 + np.log(times[x])) * self.idf[term[x]], b - a, k)
            yield a, b, np.minimum(ids, len(self.vote) - 1), sims
            a = b

    def share(self, ids: np.ndarray, sims: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
        """Share of label 1 among the votes, -1 without any, and each neighbour's share."""
        vote = sims**power * self.vote[ids]
        vote /= np.where(sims[:, :1] > 0, vote.sum(1, keepdims=True), 1)
        return np.where(sims[:, 0] > 0, (vote * self.toxic[ids]).sum(1), -1.0), vote

    def votes(self, doc: np.ndarray, term: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Share of label 1 among the neighbours' votes for each of n texts, -1 without any; the examples of most votes and their shares, 0 where there are fewer."""
        out, best, part = np.full(n, -1.0), np.zeros((n, EVIDENCE), np.int64), np.zeros((n, EVIDENCE))
        for a, b, ids, sims in self.near(doc, term, times, n, self.k):
            out[a:b], vote = self.share(ids, sims, self.power)
            most = np.argsort(-vote, axis=1, kind="stable")[:, :EVIDENCE]
            width = most.shape[1]
            best[a:b, :width] = np.take_along_axis(ids, most, 1)
            part[a:b, :width] = np.take_along_axis(vote, most, 1)
        return out, best, part

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.where(raw < 0, self.none, np.interp(raw, self.raw, self.score)) if len(self.raw) else np.full(len(raw), self.none)


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted least-squares fit of y that never falls as x grows."""
    blocks: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        blocks.append([x[i], y[i] * w[i], w[i], x[i]])
        while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][0] or blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]):
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], blocks[-1][1] + b[1], blocks[-1][2] + b[2], b[3]]
    xs = [v for b in blocks for v in (b[0], b[3])]
    ys = [v for b in blocks for v in [(b[1] + 0.5 * w.mean() * 0.5) / (b[2] + 0.5 * w.mean())] * 2]
    return np.array(xs), np.maximum.accumulate(np.array(ys)) if ys else np.array(ys)


def indexed(doc: np.ndarray, term: np.ndarray, times: np.ndarray, toxic: np.ndarray, names: np.ndarray, idf: np.ndarray, terms: tuple[np.ndarray, np.ndarray], shares: dict[int, int], leans: bool) -> Index:
    """The index of examples, (doc, term, times) being their words."""
    n_terms, n = len(idf), len(toxic)
    if leans:
        idf = idf * leaning(doc, term, toxic, n_terms)
    value = (1 + np.log(times)) * idf[term]
    value /= np.sqrt(np.bincount(doc, value**2, minlength=n))[doc]
    # Examples with the same strongest term stand together, so that few blocks matter to a query.
    lead = np.full(n, n_terms)
    strongest = np.argsort(value, kind="stable")
    lead[doc[strongest]] = term[strongest]
    order = np.lexsort((np.arange(n), toxic, lead))
    doc, toxic, names = np.argsort(order)[doc], toxic[order], names[order]
    by = np.lexsort((doc, term))
    doc_by, term_by, value_by = doc[by], term[by], value[by]
    first = np.searchsorted(term_by, np.arange(n_terms + 1))
    n_blocks, common = max(1, -(-n // BLOCK)), min(COMMON, n_terms)
    cuts, most = np.zeros((common, n_blocks + 1), np.int64), np.zeros((common, n_blocks))
    for t in range(common):
        lo, hi = first[t], first[t + 1]
        cuts[t] = lo + np.searchsorted(doc_by[lo:hi], np.arange(n_blocks + 1) * BLOCK)
        np.maximum.at(most[t], doc_by[lo:hi] // BLOCK, value_by[lo:hi])
    return Index(terms, idf, first, doc_by.astype(np.int32), value_by, cuts, most, class_weights(toxic, shares), toxic, names, np.zeros(0), np.zeros(0), 0.0)


def class_weights(toxic: np.ndarray, shares: dict[int, int]) -> np.ndarray:
    """How many labelled rows an example stands for."""
    have = {v: max(1, int((toxic == v).sum())) for v in (0, 1)}
    return np.array([shares[int(v)] / have[int(v)] for v in toxic])


def out_of_fold(fold: np.ndarray, doc: np.ndarray, term: np.ndarray, times: np.ndarray, toxic: np.ndarray, names: np.ndarray, *model) -> list[np.ndarray]:
    """For each of SETTINGS the examples' shares of label 1 among neighbours of other folds."""
    raw = [np.full(len(toxic), -1.0) for _ in SETTINGS]
    own = np.lexsort((term, doc))
    doc, term, times = doc[own], term[own], times[own]
    for f in range(FOLDS):
        mine, ask = fold == f, (fold == f)[doc]
        place = np.where(mine, np.cumsum(mine), np.cumsum(~mine)) - 1
        at = np.flatnonzero(mine)
        for leans in (False, True):
            index = indexed(place[doc[~ask]], term[~ask], times[~ask], toxic[~mine], names[~mine], *model, leans)
            for a, b, ids, sims in index.near(place[doc[ask]], term[ask], times[ask], len(at), max(k for _, k, _ in SETTINGS)):
                for out, (with_lean, k, power) in zip(raw, SETTINGS, strict=True):
                    if with_lean == leans:
                        out[at[a:b]] = index.share(ids[:, :k], sims[:, :k], power)[0]
    return raw


def calibrate(index: Index, raw: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """Sets the index's scores by the examples' votes; gives their mean squared error."""
    none = raw < 0
    index.none = float((weight * toxic)[none].sum() / weight[none].sum()) if none.any() else 0.0
    index.raw, index.score = monotone(raw[~none], toxic[~none], weight[~none])
    return float((weight * (index.calibrated(raw) - toxic) ** 2).sum() / weight.sum())


def fit(docs: DataFrame, labels: DataFrame) -> Index:
    rows, shares = example_rows(docs, labels)
    names, toxic = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
    known, term = np.unique(np.concatenate([np.zeros(0, U64), *(r[2] for r in rows)]), return_inverse=True)
    times = np.concatenate([np.zeros(0, np.int64), *(r[3] for r in rows)])
    doc = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    # Terms are numbered from the most frequent down.
    ids = np.empty(len(known), np.int64)
    ids[np.argsort(-np.bincount(term, minlength=len(known)), kind="stable")] = np.arange(len(known))
    term, terms, n_terms = ids[term], (known, ids), len(known)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(n_terms + 1, np.int64), 0
        for batch in batches:
            for _, part in chunks(batch):
                df += np.bincount(counts_in(part, shared.value)[1], minlength=n_terms + 1)
                n += len(part)
        df[-1] = n
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "n"])

    # One small row for each term of the examples.
    got = docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(n_terms + 1)
    df[got.column("term").to_numpy()] = got.column("n").to_numpy()
    words, model = (doc, term, times, toxic, names), (np.log((1 + df[-1]) / (1 + df[:-1])) + 1, terms, shares)
    if not len(rows):
        return indexed(*words, *model, False)
    # Texts of the same words share a fold.
    fold = np.array([int(np.bitwise_xor.reduce(r[2])) % FOLDS if len(r[2]) else 0 for r in rows])
    weight, votes = class_weights(toxic, shares), out_of_fold(fold, *words, *model)
    index = indexed(*words, *model, False)
    errors = [calibrate(index, raw, toxic, weight) for raw in votes]
    best = int(np.argmin(np.round(errors, 12)))
    leans, k, power = SETTINGS[best]
    index = indexed(*words, *model, leans) if leans else index
    index.k, index.power = k, power
    calibrate(index, votes[best], toxic, weight)
    return index


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence array<struct<doc_id, toxic, share>> for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.select("doc_id", "toxic")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.value
        for batch in batches:
            for rows, texts in chunks(batch):
                doc, term, times = counts_in(texts, index.terms)
                raw, best, share = index.votes(doc, term, times, len(texts))
                s = np.clip(index.calibrated(raw), 0, 1)
                some = share > 0
                of = best[some]
                fields = [pa.array(x) for x in (index.ids[of], index.toxic[of].astype(np.int32), share[some])]
                evidence = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(some.sum(1))), pa.int32()), pa.StructArray.from_arrays(fields, names=["doc_id", "toxic", "share"]))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), evidence], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    return docs.withColumn("held_out", held_out()).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id: long, toxic: int, share: double>>")
