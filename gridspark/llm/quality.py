"""Quality rules as a short-circuit cascade of column expressions.

Every rule rejects by a boolean expression. A sample of whole texts, drawn in place from all
partitions, gives each rule's share of rejections and its cost in nanoseconds, by a clock read
before and after the rule's own expressions. Rules run in order of rejections per cost inside one
CASE that holds those expressions, so that a text which a cheap rule rejects never reaches a dear
one. The order changes the work and `rejected_by`, never the verdict; of rules of one value the
cheaper goes first, then the first by name. `quality` returns the base measures of every text, so
rules find these ready and only the others are taken inside the CASE; `good` takes all there.

Null and blank texts have no words, fail `words` and go. A long text is measured whole. Repeated
rows are judged alike; an empty table gives an empty result with the rules in their written order.
Further columns of docs, whatever their names, come back as they were.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import packed

#: Rows, in expectation, of the sample that orders the rules.
SAMPLE_ROWS = 2000
WORD_END = r"[\x20\x09-\x0D]+"


def bound(value: Column, body) -> Column:
    """`body(value)` with value evaluated once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_END), "")


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeat_words(all_words: Column, n: int = 5) -> Column:
    """Words inside n-word windows that the text holds twice or more."""

    def places(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        twice = bound(pairs, lambda s: F.filter(s, lambda x, i: same(s, i, i - 1) | same(s, i, i + 1)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(p, i + 1) - x, F.lit(n))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def count(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
        return bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bound(places(h), covered)))

    return bound(all_words, count)


@dataclass(frozen=True)
class Rule:
    """Rejects where `rejects(m)` holds for the measures m."""

    name: str
    rejects: Callable[[Mapping[str, Column]], Column]


#: The two first make base_failed.
RULES = (
    Rule("words", lambda m: m["n_words"] < 10),
    Rule("repeats", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule("symbols", lambda m: m["n_symbols"] > 0.2 * m["n_words"]),
    Rule("shouting", lambda m: m["n_exclaims"] > 0.5 * m["n_words"]),
    Rule("stutter", lambda m: m["n_stutters"] > 0.3 * m["n_words"]),
    Rule("lines", lambda m: (m["n_dup_lines"] > 3) & (100 * m["n_dup_lines"] > 30 * m["n_lines"])),
    Rule("word_length", lambda m: (m["word_chars"] > 25 * m["n_words"]) | (m["word_chars"] < 1.5 * m["n_words"])),
)
#: Measures that `quality` returns of every text.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures() -> dict[str, Column]:
    """All measures as expressions over the columns text and w, its words."""
    text, w = F.coalesce("text", F.lit("")), F.col("w")
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_exclaims": F.length(F.regexp_replace(text, "[^!]+", "")).cast("long"),
        "n_stutters": bound(w, lambda x: F.size(F.filter(x, lambda y, i: F.coalesce(y == F.get(x, i - 1), F.lit(False))))).cast("long"),
        "n_dup_lines": dup_lines(F.col("text")).cast("long"),
        "n_lines": F.size(F.split(text, "\n", -1)).cast("long"),
        "n_repeat_words": repeat_words(w).cast("long"),
    }


def with_words(docs: DataFrame, *keep: Column) -> DataFrame:
    """text, its words w and the columns `keep`. A generated row keeps the words from being evaluated again by each measure."""
    return docs.select(*keep, "text", F.explode(F.array(words(F.col("text")))).alias("w"))


def given(rows: DataFrame, ready: tuple[str, ...]) -> tuple[DataFrame, dict[str, Column]]:
    """rows with the measures `ready` as columns, and all measures: those columns, or expressions yet to be taken."""
    m = measures()
    return rows.select("*", *(m[k].alias(k) for k in ready)), {k: F.col(k) if k in ready else c for k, c in m.items()}


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ready: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """Rules by rejections per cost over a sample of about `sample_rows` whole rows from all partitions."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    rows, m = given(with_words(docs.select("text").sample(share, seed=2)), ready)
    # Columns of one projection are evaluated from left to right: the clock, a rule, the clock, and so on.
    clock = F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")
    columns = [clock.alias("t0")]
    for i, r in enumerate(rules):
        columns += [F.coalesce(r.rejects(m), F.lit(False)).cast("double").alias(f"r{i}"), clock.alias(f"t{i + 1}")]
    figures = (x for i in range(len(rules)) for x in (F.avg(f"r{i}").alias(f"share{i}"), F.avg(F.col(f"t{i + 1}") - F.col(f"t{i}")).alias(f"cost{i}")))
    got = rows.select(*columns).agg(F.count("*").alias("n"), *figures).first()
    if not got["n"]:
        return rules
    cost = {r.name: max(1.0, got[f"cost{i}"]) for i, r in enumerate(rules)}
    value = {r.name: got[f"share{i}"] / cost[r.name] for i, r in enumerate(rules)}
    return tuple(sorted(rules, key=lambda r: (-value[r.name], cost[r.name], r.name)))


def cascade(rules: tuple[Rule, ...], m: Mapping[str, Column]) -> Column:
    """The first rule that rejects, null if none does; CASE stops at the first that holds."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.rejects(m), r.name).otherwise(out)
    return out


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The base measures with the verdict: doc_id, n_words, ..., base_failed, kept, rejected_by."""
    rows, m = given(with_words(docs, F.col("doc_id")), BASE)
    base = RULES[0].rejects(m) | RULES[1].rejects(m)
    rows = rows.select("doc_id", *BASE, base.alias("base_failed"), cascade(ordered_rules(docs, rules, BASE), m).alias("rejected_by"))
    return rows.select("doc_id", *BASE, "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that no rule rejects; measures are taken inside the CASE, rule by rule."""
    rows = with_words(packed(docs, F.col("text")), F.col("row"))
    return rows.where(cascade(ordered_rules(docs, rules), measures()).isNull()).select("row.*")
