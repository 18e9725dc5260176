"""Licence scans by a positional index of rare licence words, as column expressions.

Words of all templates are counted over all documents; the rarer, the higher their IDF. Phrases
(names of licences, key phrases) are looked up by their RARE words of highest IDF: the places
where a text holds them, less the word's offset in the phrase, are intersected; every start that
is left is verified against the whole phrase.

Licence texts are looked up by their ANCHORS words of highest IDF, each once at its first place:
postings list the texts and places of a word. Every such word of a document votes for a licence
text at its own place less the word's; where half the anchors of a licence text vote for places at
most DRIFT apart (words may be put in or left out between them), its mandatory key phrases must
stand about there too, at most SLACK words off. In a key phrase at most two words may be put in
between neighbours, but none of TELLING, which make it another licence's; one of four words or more
may lack one that isn't among its text's own words of `never_missing`.

The index of a document holds only places of such rare words, so most documents stop at one
overlap test: a key phrase that lacks a word still has one of its two rarest. A phrase with a
mandatory key phrase counts only where that stands in the document too, and not where a word of
`unless_after` follows or one of `unless_before` stands before it. Labels of SUPERSEDED go where a
more exact one stands. The score is 0 without a label; else 0.5 to 1 by the IDF mass of the
strongest phrase found, 0.75 for a licence text, 1 for one with all its anchors.

Null texts are empty: no words, no places, null first and last, empty labels. Repeated rows are
scanned alike; words of one IDF go by name. A long document is scanned whole; its votes are sorted,
so work grows with its licence words but for a logarithm. An empty table gives an empty result. Only
doc_id and text are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.license_texts import TEXTS, Text

RARE, ANCHORS, DRIFT, SLACK = 2, 12, 10, 12
WORD_END = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    phrase: str
    base: bool = False
    #: Another phrase that must stand somewhere in the text.
    mandatory: str = ""
    #: Words that make it no name of this licence where they follow, or stand before it.
    unless_after: tuple[str, ...] = ()
    unless_before: tuple[str, ...] = ()

    @property
    def words(self) -> list[str]:
        return self.phrase.split()


# Words that deny what follows, words that make a name another licence's, labels that give way to others.
DENIED = ("not", "no", "never", "without", "isn", "aren", "neither", "nor")
TELLING = ("affero", "lesser", "library", "noncommercial", "1")
#: Label: the labels that it gives way to; none stands for any.
SUPERSEDED = {"bsd-2": ("bsd-3",), "proprietary": ()}

# The three base phrases, then names and key phrases of public licences.
TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("agpl-3", "gnu affero general public license", mandatory="version 3"),
    Template("apache-2", "spdx license identifier apache 2 0"),
    Template("boost-1", "boost software license version 1", unless_before=DENIED),
    Template("bsd-3", "redistribution and use in source and binary forms", mandatory="neither the name of"),
    Template("cc-by", "creative commons attribution", unless_after=("noncommercial", "non", "nc", "sharealike", "share", "sa", "noderivatives", "noderivs", "no", "nd")),
    Template("cc0", "creative commons zero", unless_before=DENIED),
    Template("epl-2", "eclipse public license v 2", unless_before=DENIED),
    Template("gpl-2", "gnu general public license version 2", unless_before=DENIED),
    Template("gpl-3", "gnu general public license version 3", unless_before=DENIED),
    Template("gpl-3", "gnu general public license", mandatory="version 3 of the license"),
    Template("isc", "under the isc license", unless_before=DENIED),
    Template("lgpl", "gnu lesser general public license", unless_before=DENIED),
    Template("mit", "permission is hereby granted free of charge", mandatory="without restriction"),
    Template("mit", "spdx license identifier mit"),
    Template("mpl-2", "mozilla public license version 2", unless_before=DENIED),
    Template("mpl-2", "mozilla public license v 2", unless_before=DENIED),
    Template("proprietary", "all rights reserved", unless_before=("no", "not")),
    Template("unlicense", "released into the public domain", unless_before=DENIED),
)


def bound(value: Column, body) -> Column:
    """`body(value)` with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), WORD_END), "")


def frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many documents each licence word stands, and the number of documents."""
    known = F.array(*map(F.lit, ["", *vocabulary]))
    # The empty word stands for the document itself: one row for each word of the fixed templates.
    rows = docs.select(F.explode(F.array_union(F.array(F.lit("")), F.array_intersect(words(F.col("text")), known))).alias("w"))
    got = {r["w"]: r["count"] for r in rows.groupBy("w").count().collect()}
    return got, got.get("", 0)


def words_of_text(text: str) -> list[str]:
    return [w for w in re.split(WORD_END, "".join(c.lower() if c in UPPER else c for c in text)) if w]


def anchors(text: str, idf: dict[str, float]) -> dict[str, int]:
    """The first places of a text's ANCHORS words of highest IDF."""
    all_words = words_of_text(text)
    return {w: all_words.index(w) for w in sorted(set(all_words), key=lambda w: (-idf[w], w))[:ANCHORS]}


def gapped(phrase: str, never_missing: tuple[str, ...] = ()) -> str:
    """A pattern for a key phrase in words joined by blanks: words may stand in between, and one of four or more may be missing."""
    parts = phrase.split()
    gap = rf" (?:(?!(?:{'|'.join(TELLING)}) )\S+ ){{0,2}}"
    spared = [parts[:k] + parts[k + 1 :] for k, x in enumerate(parts) if len(parts) > 3 and x not in never_missing]
    return "(?:^| )(?:" + "|".join(gap.join(x) for x in [parts, *spared]) + ")(?: |$)"


def place(part: list[str], whole: list[str]) -> int:
    """Where part first stands in whole."""
    return next(i for i in range(len(whole)) if whole[i : i + len(part)] == part)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, texts: tuple[Text, ...] = TEXTS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs."""
    named = {t.phrase: t for t in templates}
    phrases, key_phrases = set(named) | {t.mandatory for t in templates if t.mandatory}, {p for t in texts for p in t.mandatory}
    vocabulary = sorted({w for p in phrases | key_phrases for w in p.split()} | {w for t in texts for w in words_of_text(t.text)})
    df, total = frequencies(docs, vocabulary)
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    rare = {p: sorted(set(p.split()), key=lambda w: (-idf[w], w))[:RARE] for p in phrases | key_phrases}
    places_of = [anchors(t.text, idf) for t in texts]
    posted = sorted({w for p in phrases for w in rare[p]} | {w for a in places_of for w in a})
    # A phrase needs its rarest word; a licence text has a mandatory phrase, which may lack one.
    keys = F.array(*(F.lit(x) for x in sorted({rare[p][0] for p in phrases} | {x for p in key_phrases for x in rare[p]})))
    anchored = sorted({w for a in places_of for w in a})
    postings = F.create_map(*(x for w in anchored for x in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(a[w]).alias("k")) for t, a in enumerate(places_of) if w in a)))))
    half, every = (F.array(*(F.lit(f(len(a))) for a in places_of)) for f in (lambda n: -(-n // 2), lambda n: n))

    def less(at: Column, k: int) -> Column:
        return F.transform(at, lambda x: x["i"] - k)

    def starts(p: str, w: Column, index: Column) -> Column:
        """Places where the phrase stands."""
        parts = p.split()

        def begins(rare_word: str) -> Column:
            at = F.filter(index, lambda x: x["w"] == rare_word)
            moved = [less(at, k) for k, y in enumerate(parts) if y == rare_word]
            return F.array_distinct(F.flatten(F.array(*moved)))

        lists = [begins(r) for r in rare[p]]
        both = lists[0]
        for x in lists[1:]:
            both = F.array_intersect(both, x)
        whole = F.filter(both, lambda i: (i >= 0) & (F.slice(w, F.greatest(i + 1, F.lit(1)), len(parts)) == F.array(*map(F.lit, parts))))
        after, before = (named[p].unless_after, named[p].unless_before) if p in named else ((), ())
        denied = lambda i, some: F.coalesce(F.get(w, i).isin(*some), F.lit(False)) if some else F.lit(False)
        return F.filter(whole, lambda i: ~denied(i + len(parts), after) & ~denied(i - 1, before)) if after or before else whole

    def verified(t: int, d: Column, w: Column) -> Column:
        """Whether the mandatory phrases of licence text t stand in the document where those of a text at place d would."""

        def stands_about(p: str) -> Column:
            parts = p.split()
            first = F.greatest(d + place(parts, words_of_text(texts[t].text)) - SLACK, F.lit(0))
            return F.array_join(F.slice(w, first + 1, len(parts) + 2 * SLACK), " ").rlike(gapped(p, texts[t].never_missing))

        return reduce(Column.__and__, (stands_about(p) for p in texts[t].mandatory))

    def aligned(index: Column, w: Column) -> Column:
        """Verified licence texts t of which half the anchors, or all of them (whole), vote for places at most DRIFT apart."""
        voting = F.filter(index, lambda x: x["w"].isin(anchored))
        votes = F.sort_array(F.flatten(F.transform(voting, lambda x: F.transform(postings[x["w"]], lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["k"]).alias("d"), p["k"].alias("k"))))))
        # One anchor has one vote for a place, so no more than these lie within DRIFT.
        most = ANCHORS * (DRIFT + 1)

        def near(s: Column, i: Column, x: Column) -> Column:
            return F.filter(F.slice(s, i + 1, most), lambda y: (y["t"] == x["t"]) & (y["d"] <= x["d"] + DRIFT))

        def enough(s: Column, i: Column, x: Column) -> Column:
            last = F.get(s, i + F.get(half, x["t"]) - 1)
            return F.coalesce((last["t"] == x["t"]) & (last["d"] <= x["d"] + DRIFT), F.lit(False))

        def standing(s: Column) -> Column:
            begun = F.filter(F.transform(s, lambda x, i: F.when(enough(s, i, x), F.struct(x["t"].alias("t"), near(s, i, x).alias("n")))), lambda x: x.isNotNull())
            sized = F.transform(begun, lambda x: F.struct(x["t"].alias("t"), F.element_at(x["n"], F.floor((F.size(x["n"]) + 1) / 2).cast("int"))["d"].alias("d"), F.size(F.array_distinct(F.transform(x["n"], lambda y: y["k"]))).alias("c")))
            ok = lambda x: reduce(Column.__or__, ((x["t"] == t) & verified(t, x["d"], w) for t in range(len(texts))))
            good = F.filter(F.filter(sized, lambda x: x["c"] >= F.get(half, x["t"])), ok)
            return F.array_distinct(F.transform(good, lambda x: F.struct(x["t"].alias("t"), (x["c"] >= F.get(every, x["t"])).alias("whole"))))

        return bound(votes, standing)

    def found(w: Column) -> Column:
        places = F.transform(w, lambda x, i: F.when(x.isin(posted), F.struct(x.alias("w"), i.alias("i"))))
        index = F.filter(places, lambda x: x.isNotNull())
        return bound(index, lambda x: F.struct(F.array(*(starts(p, w, x) for p in sorted(phrases))).alias("at"), aligned(x, w).alias("texts")))

    none = F.struct(F.array(*(F.array().cast("array<int>") for _ in phrases)).alias("at"), F.array().cast("array<struct<t:int,whole:boolean>>").alias("texts"))
    rows = docs.select("doc_id", F.explode(F.array(words(F.col("text")))).alias("w"))
    rows = rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.explode(F.array(F.when(F.arrays_overlap("w", keys), bound(F.col("w"), found)).otherwise(none))).alias("x"))
    at = {p: F.col("x.at")[k] for k, p in enumerate(sorted(phrases))}

    def holds(t: int, whole: bool = False) -> Column:
        """Whether licence text t stands in the document."""
        return F.exists("x.texts", lambda x: (x["t"] == t) & (x["whole"] | F.lit(not whole)))

    stands = lambda t: (F.size(at[t.phrase]) > 0) & ((F.size(at[t.mandatory]) > 0) if t.mandatory else F.lit(True))
    base = [t for t in templates if t.base]
    mass = max(sum(idf[w] for w in t.words) for t in templates)
    strength = [F.when(stands(t), 0.5 + 0.5 * sum(idf[w] for w in t.words) / mass).otherwise(0.0) for t in templates]
    strength += [F.when(holds(t, whole=True), 1.0).when(holds(t), 0.75).otherwise(0.0) for t in range(len(texts))]
    # Where no text aligns, the texts' own tests are not made.
    none_of = F.array().cast("array<string>")
    whole_texts = F.when(F.size("x.texts") > 0, F.array(*(F.when(holds(t), x.label) for t, x in enumerate(texts)))).otherwise(none_of)
    names = lambda some: F.array(*(F.when(stands(t), t.label) for t in some))
    base_names = F.array_sort(F.array_distinct(F.array_compact(names(base))))
    every_name = F.array_sort(F.array_distinct(F.array_compact(F.concat(names(templates), whole_texts))))
    gives_way = lambda all_names, x: reduce(Column.__or__, ((x == y) & (F.arrays_overlap(all_names, F.array(*map(F.lit, to))) if to else F.size(all_names) > 1) for y, to in SUPERSEDED.items()))
    left = bound(every_name, lambda n: F.filter(n, lambda x: ~gives_way(n, x)))
    all_base = F.flatten(F.array(*(at[t.phrase] for t in base)))
    return rows.select(
        "doc_id", "n_words", F.size(all_base).cast("long").alias("n_base"), F.array_min(all_base).cast("long").alias("first_word"), F.array_max(all_base).cast("long").alias("last_word"),
        F.array_join(base_names, ",").alias("base_labels"), F.array_join(left, ",").alias("labels"), F.greatest(*strength).alias("score"),
    )
