"""Quality rules: base limits, then a decision list learned from labelled statistics. DataFrame functions only.

Sequential covering: a rule is grown as a conjunction of thresholds that gains most on the labelled bad documents not yet
covered, pruned on rows set apart, and added if it is precise enough; rows it covers leave, and the next rule follows. The list
becomes one ordered CASE expression over the statistics, which any later job can apply without the labels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanspark.llm.shared import UPPER, WHITE, stored

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "upper", "distinct", "digits", "marks", "line_words")
MORE = tuple(f"q_{f}" for f in FEATURES)
VERDICT = ("base_failed", "kept", "rule")
WINDOW = 5


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """docs with the columns BASE (longs) and MORE (doubles, the features that rules test) of the whole text; a null text has no words.

    n_repeat_words comes from hashes of 5-word windows: only where a hash occurs twice are windows sorted to find the words they cover.
    """
    names = [c for c in docs.columns if c not in (*BASE, *MORE, *VERDICT)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.trim(text, F.lit(WHITE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(WHITE)) != "")
    out = docs.select(
        *names,
        words.alias("__words"),
        lines.alias("__lines"),
        (F.length(text) - _without(text, WHITE)).cast("long").alias("word_chars"),
        _without(text, "#*$%&|<>").cast("long").alias("n_symbols"),
        _without(text, UPPER).alias("__upper"),
        _without(text, "0123456789").alias("__digits"),
        _without(text, "!?;:").alias("__marks"),
    )
    hashes = F.transform("__words", lambda w: F.xxhash64(w))
    out = out.select(
        "*",
        F.size("__words").cast("long").alias("n_words"),
        F.size("__lines").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("__hash"),
    ).drop("__words", "__lines")
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), lambda i: F.xxhash64(*(F.get("__hash", i + k) for k in range(WINDOW))))
    windows = F.when(F.col("n_words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>"))
    out = out.select("*", windows.alias("__windows"), F.size(F.array_distinct("__hash")).alias("__distinct")).drop("__hash")
    pairs = F.sort_array(F.transform("__windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    twice = F.size(F.array_distinct("__windows")) < F.size("__windows")
    out = out.withColumn("__sorted", F.when(twice, pairs)).drop("__windows")
    s = F.col("__sorted")
    same = lambda e, i: (e["x"] == F.get(s, i - 1)["x"]) | (e["x"] == F.get(s, i + 1)["x"])
    at = F.sort_array(F.transform(F.filter(s, lambda e, i: F.coalesce(same(e, i), F.lit(False))), lambda e: e["i"]))
    out = out.withColumn("__at", F.when(s.isNotNull(), at)).drop("__sorted")
    at = F.col("__at")
    covered = F.transform(at, lambda v, i: F.when(i == F.size(at) - 1, WINDOW).otherwise(F.least(F.lit(WINDOW), F.get(at, i + 1) - v)))
    repeats = F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    out = out.withColumn("n_repeat_words", repeats.cast("long")).drop("__at")

    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    features = {
        "words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "__n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "upper": per("__upper", "word_chars"),
        "distinct": per("__distinct", "n_words"),
        "digits": per("__digits", "word_chars"),
        "marks": per("__marks", "n_words"),
        "line_words": per("n_words", "__n_lines"),
    }
    return out.select(*names, *BASE, *(features[f].alias(f"q_{f}") for f in FEATURES))


@dataclass
class DecisionList:
    """Ordered rules; a rule is a list of (feature, ">" or "<=", threshold) that must all hold. The first that holds rejects."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    @staticmethod
    def _holds(rule: list[tuple[str, str, float]]) -> Column:
        out = F.lit(True)
        for name, op, t in rule:
            c = F.col(f"q_{name}")
            out = out & ((c > t) if op == ">" else (c <= t))
        return out

    def expression(self) -> Column:
        """The text of the first rule that holds, or null."""
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            out = F.when(self._holds(rule), " and ".join(f"{n} {op} {t:g}" for n, op, t in rule)).otherwise(out)
        return out


def _entropy_gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -math.inf


def learn(stats: DataFrame, labels: DataFrame, most_tests: int = 3, cuts: int = 64, precision: float = 0.95, least: int = 5) -> DecisionList:
    """A decision list for bad documents (labels.quality = 0; of several labels for one doc_id the worst) from stats (doc_id, MORE).

    All labelled rows that pass the base limits count. Thresholds are quantiles of the features (`cuts` of them); what reaches the driver is a
    histogram of features x cuts for each test added. A third of the rows, by a hash of doc_id, is set apart for pruning. A rule
    needs `least` bad rows set apart and the given precision on both parts. The search ends when no feature that is left begins such a rule;
    after each rule all features may begin again. Without labels the list is empty.
    """
    told = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0).cast("int")).alias("bad")).filter(F.col("bad").isNotNull())
    rows = stored(stats.filter(~base_failed()).select("doc_id", *MORE).join(told, "doc_id"), "labelled")
    marks = [i / (cuts + 1) for i in range(1, cuts + 1)]
    found = rows.agg(*(F.percentile_approx(m, marks, 10_000).alias(m) for m in MORE)).first()
    if found is None or found[0] is None:
        return DecisionList()
    steps = {m: sorted(set(found[m])) for m in MORE}
    # A cell counts the thresholds under the value.

    def cell(m: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, steps[m])), lambda t: F.col(m) > t))

    apart = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    cells = [f"cell_{m}" for m in MORE]
    rows = stored(rows.select(*(cell(m).alias(c) for m, c in zip(MORE, cells, strict=True)), "bad", apart.alias("apart")), "labelled-cells")

    def test(name: str, op: str, t: float) -> Column:
        at = steps[name].index(t)
        return F.col(f"cell_{name}") > at if op == ">" else F.col(f"cell_{name}") <= at

    def holds(rule: list[tuple[str, str, float]]) -> Column:
        out = F.lit(True)
        for one in rule:
            out = out & test(*one)
        return out

    rules: list[list[tuple[str, str, float]]] = []
    rest, barred = F.lit(True), set()
    while len(barred) < len(MORE):
        rule: list[tuple[str, str, float]] = []
        for _ in range(most_tests):
            part = rows.filter(~F.col("apart") & rest & holds(rule))
            # The histograms of all features in one pass.
            by = part.groupingSets([[F.col(c)] for c in cells], *cells).agg(F.sum("bad").alias("p"), F.count(F.lit(1)).alias("all")).collect()
            counts = [{"k": k, "cell": r[c], "p": r["p"], "all": r["all"]} for r in by for k, c in enumerate(cells) if r[c] is not None]
            best = _best_test(counts, steps, least, set() if rule else barred)
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        heads = [rule[:i] for i in range(1, len(rule) + 1)]
        sums = [F.sum(F.when(holds(h) & (F.col("apart") == a), F.lit(1) if c is None else F.col(c)).otherwise(0)) for h in heads for a in (True, False) for c in ("bad", None)]
        got = rows.filter(rest).agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
        worth = []
        for i, h in enumerate(heads):
            p, n, p1, n1 = (got[4 * i + j] or 0 for j in range(4))
            if p >= least and p >= precision * n and p1 >= precision * n1:
                worth.append(((2 * p - n) / n, p, -len(h), h))
        if not worth:  # what begins with this feature doesn't hold on the rows set apart: another one begins
            barred.add(rule[0][0])
            continue
        rule = max(worth)[-1]
        rules.append(rule)
        rest, barred = rest & ~holds(rule), set()
    return DecisionList([[(n.removeprefix("q_"), op, t) for n, op, t in r] for r in rules])


def _best_test(counts: list, steps: dict[str, list[float]], least: int, barred: set[str]) -> tuple[str, str, float] | None:
    """The test of the highest FOIL gain, of equals that with the widest gap above its threshold; counts: k (feature), cell, p (bad rows), all."""
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r["k"], {})[r["cell"]] = (r["p"], r["all"] - r["p"])
    best, gain = None, (1e-9, 0.0)
    for k, cells in sorted(by.items()):
        name = MORE[k]
        p0, n0 = (sum(v[i] for v in cells.values()) for i in (0, 1))
        if not p0 or not n0:
            return None
        if name in barred:
            continue
        p = n = 0
        for at, t in enumerate(steps[name]):
            p, n = p + cells.get(at, (0, 0))[0], n + cells.get(at, (0, 0))[1]
            above = steps[name][at + 1] if at + 1 < len(steps[name]) else t
            gap = (above - t) / ((steps[name][-1] - steps[name][0]) or 1)
            for op, (a, b) in (("<=", (p, n)), (">", (p0 - p, n0 - n))):
                if a >= least and (g := (round(_entropy_gain(a, b, p0, n0), 6), gap)) > gain:
                    best, gain = (name, op, t), g
    return best


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """stats with base_failed, kept and rule (the rule that rejects, null if none or if the base limits fail). MORE is dropped."""
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), rules.expression()))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop(*MORE)


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with BASE, base_failed, kept and rule: statistics are taken once, a list is learned from labels and applied to every row.

    Null texts have no words and fail the base limits; repeated rows each get their row; null ids are judged but never join labels.
    Columns of docs with the names of new columns are replaced.
    """
    stats = stored(statistics(docs), "quality-statistics")
    return judge(stats, learn(stats, labels))
