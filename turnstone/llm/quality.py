"""Quality rules: a learned decision list over text statistics, all of it in DataFrame expressions.

``features`` measures whole texts. ``learn`` reads counts of labelled documents in a grid of at most
BINS ** len(RATIOS) cells (all labelled rows enter; the grid bounds what reaches the driver) and covers the bad
ones sequentially: a conjunction of threshold tests grows by FOIL gain on one part of the labels, loses tests
that the other part does not confirm, and is kept while the other part confirms its precision. ``verdict`` turns
the ordered conjunctions into one conditional expression.

Cases: null or empty text has no words and fails the base rule; without labels, or with one class only, the
list is empty and the base rule alone decides; labels that repeat or lack a document count as they join.
Windows of eight words are told apart by 64-bit hashes inside one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut

#: Tests are on these ratios, as SQL.
RATIOS = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "cast(n_dup_lines as double)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "log_words": "log1p(n_words)",
}
CUTS_BAD, CUTS_GOOD = (0.1, 0.35, 0.65, 0.9), (0.02, 0.5, 0.98)
BINS, MAX_TESTS, MAX_RULES, LEAST_PRECISION, LEAST_COVER = 8, 3, 12, 0.97, 5


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long)."""
    blank = r"[\x20\x09-\x0D]+"
    d = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    d = d.withColumn("_w", F.filter(F.split("_t", blank), lambda w: w != ""))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)))
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    d = d.withColumn("_x", F.expr("case when size(_h) >= 8 then transform(sequence(1, size(_h) - 7), i -> xxhash64(slice(_h, i, 8))) else array() end"))
    d = d.withColumn("_r", F.expr("case when size(array_distinct(_x)) < size(_x) then array_sort(transform(_x, (x, i) -> named_struct('x', x, 'i', i))) end"))
    # starts of windows that occur again, in text order: equal to a neighbour in hash order
    d = d.withColumn("_s", F.expr("array_sort(transform(filter(transform(_r, (r, j) -> named_struct('i', r.i, 'again', (j > 0 and r.x = _r[greatest(j - 1, 0)].x) or (j < size(_r) - 1 and r.x = _r[least(j + 1, size(_r) - 1)].x))), s -> s.again), s -> s.i))"))
    repeat = F.expr("coalesce(aggregate(transform(_s, (s, j) -> case when j = 0 then 8 else least(8, s - _s[greatest(j - 1, 0)]) end), 0L, (a, x) -> a + x), 0L)")
    return d.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _cells(feats: DataFrame, labels: DataFrame) -> tuple[dict[str, list[float]], list]:
    known = labels.where("quality is not null").select(F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("bad"))
    x = feats.join(known, feats["doc_id"] == F.col("_id")).where(~base_failed()).select("bad", (F.xxhash64("_id") % 3 == 0).alias("check"), *[F.expr(v).alias(k) for k, v in RATIOS.items()])
    x = cut(x)
    found = x.agg(*[F.percentile_approx(F.when(F.col("bad") == b, F.col(k)), list(q), 1000).alias(f"{k}_{b}") for k in RATIOS for b, q in ((True, CUTS_BAD), (False, CUTS_GOOD))]).first()
    cuts = {k: sorted({round(v, 6) for b in (True, False) for v in found[f"{k}_{b}"] or []}) for k in RATIOS}
    # the bin is the number of cuts that the value exceeds
    bins = [sum(((F.col(k) > c).cast("int") for c in cuts[k]), F.lit(0)).alias(k) for k in RATIOS]
    cells = x.select(*bins, "bad", "check").groupBy(*RATIOS).agg(*[F.count_if((F.col("bad") == b) & (F.col("check") == c)).alias(f"{'bad' if b else 'good'}_{'check' if c else 'grow'}") for b in (True, False) for c in (True, False)])
    return cuts, cells.collect()


def learn(feats: DataFrame, labels: DataFrame) -> list[list[tuple[str, str, float]]]:
    """Rejecting conjunctions in order; each test is (ratio, '>' or '<=', threshold)."""
    cuts, cells = _cells(feats, labels)
    rules: list[list[tuple[str, str, float]]] = []
    tests = [(k, op, i) for k in RATIOS for i in range(len(cuts[k])) for op in (">", "<=")]
    holds = lambda cell, rule: all((cell[k] > i) == (op == ">") for k, op, i in rule)
    total = lambda cs, what: sum(c[what] for c in cs)
    while len(rules) < MAX_RULES:
        rule, inside = [], cells
        while len(rule) < MAX_TESTS and total(inside, "good_grow"):
            p0, n0 = total(inside, "bad_grow"), total(inside, "good_grow")
            if not p0:
                break
            best = (0.0, None, None)
            for t in tests:
                sub = [c for c in inside if holds(c, [t])]
                p, n = total(sub, "bad_grow"), total(sub, "good_grow")
                gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                if gain > best[0] + 1e-9:
                    best = (gain, t, sub)
            if best[1] is None:
                break
            rule, inside = [*rule, best[1]], best[2]
        if not rule:
            break

        def worth(r: list) -> float:
            sub = [c for c in cells if holds(c, r)]
            p, n = total(sub, "bad_check"), total(sub, "good_check")
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        sub = [c for c in cells if holds(c, rule)]
        p, n = (total(sub, f"{x}_check") + total(sub, f"{x}_grow") for x in ("bad", "good"))
        if p + n < LEAST_COVER or p / (p + n) < LEAST_PRECISION or worth(rule) < 2 * LEAST_PRECISION - 1:
            break
        rules.append([(k, op, cuts[k][i]) for k, op, i in rule])
        cells = [c for c in cells if not holds(c, rule)]
    return rules


def verdict(rules: list[list[tuple[str, str, float]]]) -> Column:
    """Number of the first rule that rejects, in order; null if none does."""
    out = F.lit(None).cast("int")
    for no, rule in reversed(list(enumerate(rules, 1))):
        test = F.lit(True)
        for k, op, c in rule:
            test &= F.expr(RATIOS[k]) > c if op == ">" else F.expr(RATIOS[k]) <= c
        out = F.when(test, F.lit(no)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five statistics, base_failed, kept, rule (number of the rejecting rule)."""
    feats = cut(features(docs.select("doc_id", "text")).drop("text"))
    rule = verdict(learn(feats, labels))
    return feats.withColumns({"base_failed": base_failed(), "rule": rule}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
