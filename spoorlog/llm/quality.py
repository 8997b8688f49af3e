"""Quality rules: a decision list learned from labelled statistics.

Every text is first described by counts, in Spark expressions. Sequential
covering then learns, from labelled rows, an ordered list of conjunctions of
thresholds for low quality: each rule is grown condition by condition on two
thirds of the rows for information gain, pruned from its end on the other third,
and kept only if it is precise there; covered rows are set aside and the next
rule is grown. The list becomes one CASE expression that Spark evaluates.

Learning uses at most about ``rows`` labelled rows, chosen by a hash of the id (a
documented bound), and only their numbers. Without usable labels the list is
empty and keeps everything. Null text has no words; texts under ten words or
with more than a fifth of repeated words fail whatever the list says. Rows are
independent; documents labelled twice count by their smallest label.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorlog.session import staged

SPACE = r"[ \t\n\x0B\f\r]+"
WORD_CHAR = r"[^ \t\n\x0B\f\r]"
WINDOW = 5
FEATURES = ("n_words", "word_length", "symbol_share", "bang_share", "upper_share", "dup_line_share", "repeat_share", "distinct_share")


def statistics(docs: DataFrame) -> DataFrame:
    """Counts of each text; one row per input row.

    Repeated words are those in windows of five that occur twice or more in the
    text. Windows are compared by a 64-bit hash; only a text that has equal ones
    sorts them with their places and adds up what they cover.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != "")).withColumn(
        "lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD_CHAR)))
    window = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])
    rows = rows.withColumn("n_words", F.size("words").cast("bigint")).withColumn(
        "windows",
        F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")), window)))
    left = lambda pattern: F.length(F.regexp_replace("text", pattern, "")).cast("bigint")
    counted = rows.select(
        "doc_id", "n_words", "windows", F.length("text").cast("bigint").alias("n_chars"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        left(r"[^#*$%&|<>]+").alias("n_symbols"), left(r"[^!]+").alias("n_bangs"), left(r"[^\p{Lu}]+").alias("n_upper"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct"))
    sorted_ = counted.withColumn(
        "ranked",
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"),
               F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")
    same = lambda x, k: F.coalesce(F.get("ranked", k)["h"] == x["h"], F.lit(False))
    placed = sorted_.withColumn(
        "places",
        F.sort_array(F.transform(
            F.filter("ranked", lambda x, k: same(x, k + 1) | F.when(k > 0, same(x, k - 1)).otherwise(F.lit(False))), lambda x: x["i"]))).drop("ranked")
    covered = F.aggregate(
        F.transform("places", lambda p, k: F.least(F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("bigint"), lambda a, x: a + x)
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("places")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> list[Column]:
    """The numbers rules speak of, by the names in FEATURES."""
    of = lambda part, whole: (F.col(part) / F.greatest(F.col(whole), F.lit(1))).cast("double")
    return [
        F.col("n_words").cast("double").alias("n_words"), of("word_chars", "n_words").alias("word_length"),
        of("n_symbols", "n_chars").alias("symbol_share"), of("n_bangs", "n_chars").alias("bang_share"),
        of("n_upper", "n_chars").alias("upper_share"), of("n_dup_lines", "n_lines").alias("dup_line_share"),
        of("n_repeat_words", "n_words").alias("repeat_share"), of("n_distinct", "n_words").alias("distinct_share"),
    ]


@dataclass(frozen=True)
class Condition:
    """One threshold on one feature."""

    feature: str
    above: bool
    limit: float

    def column(self) -> Column:
        return F.col(self.feature) > self.limit if self.above else F.col(self.feature) <= self.limit

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:g}"


Rule = tuple[Condition, ...]


def learn(rows: list[tuple[float, ...]], low: list[bool], precision: float = 0.97, thresholds: int = 24, longest: int = 4) -> list[Rule]:
    """Sequential covering of the ``low`` rows by precise conjunctions.

    Sets of rows are bits of one integer, so a condition's cover is an AND.
    """
    n = len(rows)
    covers: dict[Condition, int] = {}
    for k, name in enumerate(FEATURES):
        values = sorted(r[k] for r in rows)
        for limit in sorted({values[(i + 1) * n // (thresholds + 1)] for i in range(thresholds)}) if n else ():
            bits = _bits(r[k] > limit for r in rows)
            covers[Condition(name, True, limit)] = bits
            covers[Condition(name, False, limit)] = ((1 << n) - 1) ^ bits
    bad, grow = _bits(low), _bits(i % 3 != 2 for i in range(n))
    left, rules = (1 << n) - 1, []
    while (bad & left & grow).bit_count() >= 5:
        rule, cover = _grown(covers, bad, left & grow, longest)
        rule = _pruned(rule, covers, bad, left & ~grow & ((1 << n) - 1))
        cover = left
        for c in rule:
            cover &= covers[c]
        hits, test = cover & bad, cover & ~grow
        right = (hits & ~grow).bit_count()
        if not rule or not test or right / test.bit_count() < precision:
            break
        rules.append(rule)
        left &= ~cover
    return rules


def _bits(flags) -> int:
    return int("".join("1" if f else "0" for f in flags)[::-1] or "0", 2)


def _grown(covers: dict[Condition, int], bad: int, left: int, longest: int) -> tuple[Rule, int]:
    """Add the condition of most information gain until only low rows are covered."""
    rule, cover = [], left
    while len(rule) < longest:
        p, t = (cover & bad).bit_count(), cover.bit_count()
        if not t or p == t:
            break
        best, gain = None, 1e-9
        for c, bits in covers.items():
            new = cover & bits
            pn = (new & bad).bit_count()
            if pn:
                g = pn * (math.log2(pn / new.bit_count()) - math.log2(p / t))
                if g > gain:
                    best, gain = c, g
        if best is None:
            break
        rule.append(best)
        cover &= covers[best]
    return tuple(rule), cover


def _pruned(rule: Rule, covers: dict[Condition, int], bad: int, test: int) -> Rule:
    """The shortest beginning of the rule that is worth most on the rows set aside."""
    best, worth, cover = rule, -2.0, test
    for k, c in enumerate(rule):
        cover &= covers[c]
        p, t = (cover & bad).bit_count(), cover.bit_count()
        if t and (2 * p - t) / t > worth + 1e-12:
            best, worth = rule[: k + 1], (2 * p - t) / t
    return best


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the number of the first rule that holds, else 0."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        both = rule[0].column()
        for c in rule[1:]:
            both = both & c.column()
        out = F.when(both, F.lit(k)).otherwise(out)
    return out.cast("int")


def train(stats: DataFrame, labels: DataFrame, rows: int = 20_000) -> list[Rule]:
    """Rules from ``labels`` (doc_id, quality) and a table of statistics."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(
        F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, rows / max(known.count(), 1))
    draw = F.xxhash64(F.lit(53), "doc_id").bitwiseAND(F.lit((1 << 31) - 1)) / F.lit(float(1 << 31))
    sample = stats.select("doc_id", *features()).join(known.filter(draw < share), "doc_id")
    found = sorted(tuple(r) for r in sample.orderBy(F.xxhash64("doc_id")).limit(rows).select(
        F.xxhash64("doc_id"), *FEATURES, "quality").collect())  # at most ``rows`` rows of numbers
    return learn([r[1:-1] for r in found], [r[-1] == 0 for r in found])


def judge(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> DataFrame:
    """Statistics, base_failed, the rule that fired (0: none) and kept, one row per input row."""
    stats = staged(statistics(docs), "quality-stats")
    rules = train(stats, labels, rows)
    numbers = [f.alias(f"f_{name}") for f, name in zip(features(), FEATURES, strict=True)]
    named = stats.select("*", *numbers)
    fired = verdict([tuple(Condition(f"f_{c.feature}", c.above, c.limit) for c in rule) for rule in rules])
    return named.withColumn("base_failed", base_failed()).withColumn("rule", fired).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0))
