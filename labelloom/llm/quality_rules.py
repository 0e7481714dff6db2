"""Operator 9, quality rules as a short-circuit cascade.

Native: DataFrame functions only. Each rule is a predicate over statistics of a text that rejects a document. One pass
over a seeded sample counts the rows by which rules reject them. A rule's cost is the work of its statistics,
``WORK`` times the sample's characters and words; it takes no clock, so reruns agree. Rules are ordered greedily: next
comes the rule with the most rejections per cost among the rows that those before it leave.

The cascade is one nested CASE: a document that a rule rejects is not given to the later ones, whose statistics
stand inside their branches and are not computed for it. The order changes no verdict, but which of several
failing rules is named.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

WORD, SYMBOL = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"
#: White space within a line, and a word without a letter: one all of whose signs are ASCII and no letters.
GAP = r"[\x20\x09\x0B-\x0D]"
BARE = r"(?<![^\x20\x09-\x0D])[\x00-\x08\x0E-\x1F\x21-\x40\x5B-\x60\x7B-\x7F]++(?![^\x20\x09-\x0D])"
#: Rows of the sample that costs and selectivities are estimated on, about.
SAMPLE_ROWS, SAMPLE_SEED = 2_000, 11


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(_text(text), F.lit(pattern)).cast("long")


def text_words(text: Column) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return _count(text, WORD)


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(_text(text), r"[\x20\x09-\x0D]+", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(_text(text)) - F.length(F.translate(_text(text), "#*$%&|<>", ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(_text(text), "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def _repeats(w: Column) -> Column:
    """Words of an array that lie in 3-word windows found twice or more in it."""
    three = lambda i: F.slice(w, i, 3)
    starts = F.when(F.size(w) >= 4, F.sequence(F.lit(1), F.size(w) - 2)).otherwise(F.array().cast("array<int>"))
    # Equal windows have equal hashes: where all hashes differ nothing repeats, and no text is compared.
    none = let(F.transform(starts, lambda i: F.xxhash64(three(i))), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    ordered = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(three(i), " ").alias("g"), i.alias("i"))))
    same = lambda s, k, j: F.coalesce(F.get(s, k)["g"] == F.get(s, j)["g"], F.lit(False))
    twice = lambda s: F.filter(F.transform(s, lambda x, k: F.when(same(s, k, k - 1) | same(s, k, k + 1), x["i"])), lambda i: i.isNotNull())
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, i: F.struct((i + 3).alias("end"), (acc["n"] + i + 3 - F.greatest(acc["end"], i)).alias("n"))
    cover = lambda at: F.aggregate(F.array_sort(at), start, step, lambda acc: acc["n"])
    return F.when(none, F.lit(0)).otherwise(let(ordered, lambda s: cover(twice(s))))


def n_repeat_words(text: Column) -> Column:
    return let(text_words(text), _repeats).cast("long")


def n_bare_words(text: Column) -> Column:
    """Words without a letter."""
    return _count(text, BARE)


def n_lines(text: Column) -> Column:
    """Lines with a word."""
    return _count(text, rf"(?:\A|\n){GAP}*+[^\x20\x09-\x0D]")


def n_bullets(text: Column) -> Column:
    """Lines that begin with a bullet."""
    return _count(text, rf"(?:\A|\n){GAP}*+[-*\x{{2022}}\x{{2023}}]")


def n_ellipses(text: Column) -> Column:
    """Lines that end with an ellipsis."""
    return _count(text, rf"(?:\.\.\.|\x{{2026}}){GAP}*+(?=\n|\z)")


#: What a contract of the base asks of every row.
BASE_STATISTICS = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}
STATISTICS = BASE_STATISTICS | {"n_bare_words": n_bare_words, "n_lines": n_lines, "n_bullets": n_bullets, "n_ellipses": n_ellipses}
#: Work of a statistic for each character and for each word of a text; its unit is a plain pass over a character.
WORK = {"n_words": (2, 0), "word_chars": (3, 0), "n_symbols": (1, 0), "n_dup_lines": (2, 0), "n_repeat_words": (2, 120), "n_bare_words": (3, 0), "n_lines": (2, 0), "n_bullets": (2, 0), "n_ellipses": (2, 0)}


class Rule(NamedTuple):
    """The statistics that a rule needs and when it rejects; ``s`` gives a statistic's column by name."""

    needs: tuple[str, ...]
    rejects: Callable[[Callable[[str], Column]], Column]


RULES = {
    "short": Rule(("n_words",), lambda s: s("n_words") < 50),
    "repeated": Rule(("n_repeat_words", "n_words"), lambda s: 100 * s("n_repeat_words") > 50 * s("n_words")),
    "symbols": Rule(("n_symbols", "n_words"), lambda s: 10 * s("n_symbols") > s("n_words")),
    "word_length": Rule(("word_chars", "n_words"), lambda s: (s("word_chars") < 2 * s("n_words")) | (s("word_chars") > 15 * s("n_words"))),
    "dup_lines": Rule(("n_dup_lines", "n_words"), lambda s: 10 * s("n_dup_lines") > s("n_words")),
    "letters": Rule(("n_bare_words", "n_words"), lambda s: 2 * s("n_bare_words") > s("n_words")),
    "bullets": Rule(("n_bullets", "n_lines"), lambda s: (s("n_bullets") >= 5) & (10 * s("n_bullets") > 9 * s("n_lines"))),
    "ellipses": Rule(("n_ellipses", "n_lines"), lambda s: (s("n_ellipses") >= 5) & (10 * s("n_ellipses") > 3 * s("n_lines"))),
}
BASE = ("short", "repeated")


def from_text(text: Column):
    return lambda name: STATISTICS[name](text)


def order_rules(docs: DataFrame, rules: dict[str, Rule] = RULES, known: tuple[str, ...] = ()) -> list[str]:
    """Rule names by rejection per cost on a sample of ``docs``, best first; an empty table or sample keeps the given order.

    Statistics that are ``known`` already cost nothing. The sample is Spark's, with a fixed seed; the driver gets a row for
    each combination of rules that reject.
    """
    n = docs.count()
    if not n:
        return list(rules)
    sample = docs.select("text").sample(min(1.0, SAMPLE_ROWS / n), seed=SAMPLE_SEED)
    told = [F.coalesce(r.rejects(from_text(F.col("text"))), F.lit(False)).alias(k) for k, r in rules.items()]
    seen = sample.select(F.length(_text(F.col("text"))).alias("chars"), n_words(F.col("text")).alias("words"), F.struct(*told).alias("rejected"))
    rows = [(r["rejected"].asDict(), r["n"], r["chars"], r["words"]) for r in seen.groupBy("rejected").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("words").alias("words")).collect()]
    order, left = [], list(rules)
    while left:

        def gain(name: str) -> float:
            work = [WORK.get(s, (1, 0)) for s in rules[name].needs if s not in known]
            cost = sum(n + sum(c * chars + w * words for c, w in work) for _, n, chars, words in rows)
            return sum(n for no, n, _, _ in rows if no[name]) / max(cost, 1)

        best = max(left, key=gain)  # ties to the earlier
        order.append(best)
        left.remove(best)
        rows = [r for r in rows if not r[0][best]]
    return order


def failed_rule(order: list[str], statistic, rules: dict[str, Rule] = RULES) -> Column:
    """The first rule of the order that rejects, or null: later rules are not evaluated then."""
    return reduce(lambda rest, name: F.when(rules[name].rejects(statistic), F.lit(name)).otherwise(rest), reversed(order), F.lit(None).cast("string"))


def cascade(docs: DataFrame, order: list[str] | None = None, rules: dict[str, Rule] = RULES) -> DataFrame:
    """``docs`` with ``failed_rule`` (null: kept).

    A null or empty text has no words and fails as short. Texts of any length are read whole. Rows that repeat are judged
    each; an empty table gives no rows; columns pass through, one named failed_rule is replaced.
    """
    return docs.withColumn("failed_rule", failed_rule(order or order_rules(docs, rules), from_text(F.col("text")), rules))


def evaluated(judged: DataFrame, order: list[str]) -> DataFrame:
    """rule, n_evaluated, n_rejected of a cascade's result, in order: what the short circuit spared each rule."""
    at = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), F.col("failed_rule")), F.lit(0))
    by = judged.groupBy(F.when(at == 0, len(order) + 1).otherwise(at).cast("int").alias("at")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(k + 1).alias("place"), F.lit(x).alias("rule")) for k, x in enumerate(order)])
    rows = by.select("at", "n", F.explode(rules).alias("r"))
    return rows.groupBy("r.place", "r.rule").agg(F.sum(F.when(F.col("at") >= F.col("r.place"), F.col("n")).otherwise(0)).alias("n_evaluated"), F.sum(F.when(F.col("at") == F.col("r.place"), F.col("n")).otherwise(0)).alias("n_rejected")).orderBy("place").drop("place")


def statistics(docs: DataFrame, which: dict = BASE_STATISTICS) -> DataFrame:
    """doc_id and statistics of each row."""
    return docs.select("doc_id", *[f(F.col("text")).alias(k) for k, f in which.items()])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The digest returns the base statistics of every row: they are columns here, and the cascade reads them. What other rules
    # need is computed in the cascade alone, for rows that neither the base nor an earlier rule rejects.
    stats = docs.select("doc_id", "text", *[f(F.col("text")).alias(k) for k, f in BASE_STATISTICS.items()])
    base = reduce(lambda a, b: a | b, [RULES[k].rejects(F.col) for k in BASE])
    rest = {k: r for k, r in RULES.items() if k not in BASE}
    order = order_rules(docs, rest, tuple(BASE_STATISTICS))
    statistic = lambda name: F.col(name) if name in BASE_STATISTICS else STATISTICS[name](F.col("text"))
    kept = F.when(base, F.lit(False)).otherwise(failed_rule(order, statistic, rest).isNull())
    return stats.select("doc_id", *BASE_STATISTICS, base.alias("base_failed"), kept.alias("kept"))


OP9_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS k FROM t, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i) WHERE len(w) >= 3),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM r) GROUP BY 1),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(x) - length(translate(x, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, len(list_filter(w, lambda q: regexp_full_match(q, '[\x00-\x40\x5B-\x60\x7B-\x7F]+'))) AS bare, len(l) AS lines,
  len(list_filter(l, lambda q: regexp_matches(q, '^[\x20\x09\x0B-\x0D]*[-*\x{2022}\x{2023}]'))) AS bullets,
  len(list_filter(l, lambda q: regexp_matches(q, '(\.\.\.|\x{2026})[\x20\x09\x0B-\x0D]*$'))) AS ellipses FROM t LEFT JOIN p USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_dup_lines > n_words
    OR 2 * bare > n_words OR (bullets >= 5 AND 10 * bullets > 9 * lines) OR (ellipses >= 5 AND 10 * ellipses > 3 * lines)) AS kept
FROM s
"""
