"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A text's base counts and the hashes of its words are made once. The cascade's
rules read these or, where they need more, the text. Each rule's cost and share
of rejected documents are measured on a sample; the cascade then tries the
rules by rejections per cost, and a document that one rule rejects is not put
to the later ones. The order changes the cost alone, never the verdict; which
rule is named in ``rejected_by`` follows the order, which rests on measured
times and may differ from run to run.

Functions over array elements are interpreted, so each word meets few of them:
one hash, and three that double the width of the hashed windows up to eight.

Cases: null and empty texts have no words and fail the base rules; repeated
rows get equal verdicts; an empty table gives an empty result and the rules in
the order given; columns whose names clash with the results are dropped.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methgrid.llm.exprs import blank_spaces, later, let, paired

#: Rows at most on which costs and selectivities are measured: the first of a tenth drawn at random, so that few files are read.
SAMPLE_ROWS = 400
#: Longer texts are not drawn, which bounds the sample's bytes; they are judged like all others.
SAMPLE_BYTES = 64 << 10
SYMBOLS = r"[^#*$%&|<>]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Rule(NamedTuple):
    """``rejects`` makes an expression of the text, its facts (the base counts, ``n_lines``, and ``hashes``, one for each word) and its letters, which are picked out only for rules that say they need them."""

    name: str
    rejects: Callable[[Column, Column, Column], Column]
    needs_letters: bool = False


def repeated_words(hashes: Column) -> Column:
    """How many words lie in windows of eight words that the text has twice or more."""

    def covered(windows: Column) -> Column:
        # (window, place) sorted by window: equal neighbours are repeats
        marked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(
            marked,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False))),
                    lambda x: x["i"],
                )
            ),
        )
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(8), F.coalesce(F.get(p, k + 1) - x, F.lit(8)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )

    def doubled(x: Column, by: int, then: Callable[[Column], Column]) -> Column:
        return let(paired(x, later(x, by), lambda a, b: F.xxhash64(a, b)), then)

    counted = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))
    return F.when(F.size(hashes) <= 8, F.lit(0).cast("long")).otherwise(doubled(hashes, 1, lambda x: doubled(x, 2, lambda y: doubled(y, 4, counted))))


def duplicate_lines(lines: Column) -> Column:
    """How many lines with a word equal an earlier line."""
    some = lambda x: F.filter(x, lambda y: y.rlike(r"[^\x20\x09-\x0D]"))
    many = let(some(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return F.when(F.size(F.array_distinct(lines)) == F.size(lines), F.lit(0).cast("long")).otherwise(many)


def facts(text: Column) -> Column:
    """A struct of the base counts, ``base_failed``, ``n_lines`` and ``hashes``."""
    text = F.coalesce(text, F.lit(""))

    def counted(hashes: Column, spaced: Column) -> Column:
        n = F.size(hashes).cast("long")
        lines = F.split(text, "\n")
        return let(
            repeated_words(hashes),
            lambda repeated: F.struct(
                n.alias("n_words"),
                F.length(F.replace(spaced, F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
                let(lines, duplicate_lines).alias("n_dup_lines"),
                repeated.alias("n_repeat_words"),
                ((n < 20) | (repeated * 100 > n * 30)).alias("base_failed"),
                F.size(lines).alias("n_lines"),
                hashes.alias("hashes"),
            ),
        )

    words = lambda spaced: F.array_remove(F.split(spaced, " "), "")
    return let(blank_spaces(text), lambda spaced: let(F.transform(words(spaced), lambda w: F.xxhash64(w)), lambda hashes: counted(hashes, spaced)))


def default_rules() -> list[Rule]:
    """Limits that lie far from what prose reaches."""
    stuttered = lambda h: F.size(F.array_remove(paired(h, later(h, 1), lambda a, b: a == b), False))
    return [
        Rule("symbols", lambda t, x, z: x["n_symbols"] * 100 > x["word_chars"] * 5),
        Rule("shouting", lambda t, x, z: F.length(F.regexp_replace(z, r"[^\p{Lu}]+", "")) * 100 > F.length(z) * 50, True),
        Rule("letters", lambda t, x, z: F.length(z) * 100 < x["word_chars"] * 50, True),
        Rule("long_words", lambda t, x, z: x["word_chars"] > x["n_words"] * 20),
        Rule("duplicate_lines", lambda t, x, z: (x["n_dup_lines"] >= 3) & (x["n_dup_lines"] * 100 > x["n_lines"] * 30)),
        Rule("stutter", lambda t, x, z: F.when(F.size(x["hashes"]) < 2, F.lit(False)).otherwise(stuttered(x["hashes"]) * 100 > x["n_words"] * 30)),
    ]


def only_letters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}]+", "")


def order_rules(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a sample; every rule stays."""
    short = docs.select(F.col(text)).filter(F.col(text).isNull() | (F.octet_length(text) <= SAMPLE_BYTES))
    rows_ = short.sample(0.1, seed=7).take(sample_rows) or short.take(sample_rows)
    body = F.coalesce(F.col(text), F.lit(""))
    sample = docs.sparkSession.createDataFrame(rows_, short.schema).select(body.alias("t"), facts(body).alias("x")).persist()
    try:
        rows = sample.count()

        def spent(column: Column) -> tuple[float, int]:
            began = time.perf_counter()
            hits = sample.select(F.count_if(column)).first()[0]
            return time.perf_counter() - began, hits

        if not rows:
            return list(rules)
        spent(F.lit(True))
        idle = min(spent(F.lit(True))[0] for _ in range(2))
        scored = []
        for rule in rules:
            seconds, hits = spent(cascade([rule], F.col("t"), F.col("x")).isNotNull())
            scored.append((hits / rows / max(seconds - idle, 1e-4), rule))
        return [r for _, r in sorted(scored, key=lambda x: -x[0])]
    finally:
        sample.unpersist()


def cascade(rules: list[Rule], text: Column, known: Column, letters: Column | None = None) -> Column:
    """The name of the first rule that rejects; null if none does. The letters are picked out once, by the first rule that needs them."""
    if not rules:
        return F.lit(None).cast("string")
    if rules[0].needs_letters and letters is None:
        return let(only_letters(text), lambda z: cascade(rules, text, known, z))
    return F.when(rules[0].rejects(text, known, letters if letters is not None else text), rules[0].name).otherwise(cascade(rules[1:], text, known, letters))


def judge(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``rejected_by`` (the first rule that rejects, ``base`` for the base rules) and ``kept``."""
    made = (*COUNTS, "base_failed")
    rest = [c for c in docs.columns if c not in (*made, "rejected_by", "kept")]
    ordered = order_rules(docs, rules if rules is not None else default_rules(), text)
    body = F.coalesce(docs[text], F.lit(""))
    first = lambda x: F.when(x["base_failed"], "base").otherwise(cascade(ordered, body, x))
    judged = let(facts(body), lambda x: F.struct(*[x[c].alias(c) for c in made], first(x).alias("rejected_by")))
    df = docs.select(*[docs[c] for c in rest], judged.alias("__judged"))
    return df.select(*rest, *[F.col(f"__judged.{c}") for c in made], "__judged.rejected_by", F.col("__judged.rejected_by").isNull().alias("kept"))


WORDS_SQL = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {WORDS_SQL} AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, unnest(range(0, len(words) - 7)) AS i, words FROM w WHERE len(words) >= 8),
g AS (SELECT doc_id, i, array_to_string(words[i + 1 : i + 8], ' ') AS g FROM p),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
s AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS own FROM r WHERE n > 1),
rep AS (SELECT doc_id, sum(own)::BIGINT AS n_repeat_words FROM s GROUP BY doc_id),
c AS (SELECT w.doc_id, w.t, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS letters,
             length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS capitals,
             len(string_split(t, chr(10))) AS n_lines,
             len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS n_stutter
      FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
b AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 100 > word_chars * 5 OR capitals * 100 > letters * 50 OR letters * 100 < word_chars * 50
            OR word_chars > n_words * 20 OR (n_dup_lines >= 3 AND n_dup_lines * 100 > n_lines * 30) OR n_stutter * 100 > n_words * 30) AS kept
FROM b
"""
