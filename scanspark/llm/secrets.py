r"""Secret scans: named assignments, access keys, hexadecimal keys, and stretches of high entropy. DataFrame functions only.

Candidate strings are the runs of a class of characters, a window or more long. A window slides over each; the counts of its characters change by
the one that enters and the one that leaves, and so does the sum of c log2 c over the counts c, from which the window's Shannon entropy follows. Windows
with at least a class's bits a character are joined to spans. Runs that an allow-list matches are no candidates. Sums are
whole numbers (c log2 c in units of 2 ** -20), so results don't depend on the order of additions.
"""

from __future__ import annotations

import functools
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanspark.llm.pii import let

UNIT = 1 << 20


class Pattern(NamedTuple):
    """A kind of secret with a form of its own: the expression, and which group of it must have `least` characters. A text with one matches quick, and
    in lower case contains one of hints (none: any text does)."""

    name: str
    expression: str
    group: int
    least: int
    quick: str
    hints: tuple[str, ...] = ()

    def likely(self, text: Column) -> Column:
        hinted = [F.contains(F.lower(text), F.lit(h)) for h in self.hints]
        return functools.reduce(Column.__or__, hinted) & text.rlike(self.quick) if hinted else text.rlike(self.quick)


class Window(NamedTuple):
    """A class of characters: windows of `size` with `bits` or more a character are reported as kind `name`. chars has each character once."""

    name: str
    chars: str
    size: int
    bits: float

    @property
    def run(self) -> str:
        return "[" + self.chars.replace("-", r"\-") + "]{" + str(self.size) + ",}"

    @property
    def most(self) -> int:
        """The largest sum of c log2 c of a window with as many bits."""
        return math.floor(self.size * (math.log2(self.size) - self.bits) * UNIT)


PATTERNS = (
    Pattern("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, "[:=]", ("password", "passwd", "secret", "token", "api")),
    Pattern("access", "AKIA[A-Z0-9]+", 0, 16, "AKIA", ("akia",)),
    Pattern("hex", "[0-9a-f]+", 0, 32, "[0-9a-f]{32}"),
)
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A window of random characters has about 3.5 bits (hexadecimal, 24) and 4.0 (base64, 20); words written together stay under 3.9.
WINDOWS = (Window("entropy_hex", DIGITS + "abcdefABCDEF", 24, 3.2), Window("entropy_base64", DIGITS + LOWER + UPPER + "+/_-", 20, 3.9))
#: Runs that are no secrets: numbers, words of one case, UUIDs, and fillers of documentation.
ALLOWED = (
    "^[0-9+/_-]+$",
    "^[A-Z]?[a-z+/_-]+$",
    "^[A-Z+/_-]+$",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "(?i)example|sample|dummy|placeholder|changeme|xxxxxx|123456789|abcdefgh",
)


def sums(size: int) -> list[int]:
    """c log2 c for c from 0 to size, in UNIT."""
    return [0] + [round(c * math.log2(c) * UNIT) for c in range(1, size + 1)]


def found(text: Column, expression: str) -> Column:
    """An array of structs (start, match) of all matches in text, left to right; start in code points."""
    pairs = F.zip_with(F.split(text, expression), F.regexp_extract_all(text, F.lit(expression), F.lit(0)), lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,match:string>>").alias("out"))

    def step(state: Column, p: Column) -> Column:
        at = state["at"] + F.length(p["gap"])
        one = F.array(F.struct(at.alias("start"), p["match"].alias("match")))
        return F.struct((at + F.length(p["match"])).alias("at"), F.concat(state["out"], one).alias("out"))

    return F.aggregate(F.filter(pairs, lambda p: p["match"].isNotNull()), start, step, lambda s: s["out"])


def span(kind: int, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))


NO_SPANS = "array<struct<start:int,kind:int,end:int>>"


def matched(text: Column, pattern: Pattern, kind: int) -> Column:
    """The spans of a kind: matches whose group has as many characters as it needs."""
    good = lambda m: F.length(F.regexp_extract(m["match"], pattern.expression, pattern.group)) >= pattern.least
    return F.transform(F.filter(found(text, pattern.expression), good), lambda m: span(kind, m["start"], m["start"] + F.length(m["match"])))


def hot_windows(run: Column, window: Window) -> Column:
    """Spans (start, end) of a run, joined from all its windows of window.bits or more a character."""
    table = F.array(*map(F.lit, sums(window.size)))
    code = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(window.chars), c) - 1)

    def slid(codes: Column) -> Column:
        start = F.struct(
            F.array_repeat(F.lit(0), len(window.chars)).alias("counts"),
            F.lit(0).cast("long").alias("sum"),
            F.lit(None).cast("int").alias("start"),
            F.lit(-1).alias("end"),
            F.array().cast("array<struct<start:int,end:int>>").alias("out"),
        )

        def step(state: Column, i: Column) -> Column:
            counts, enters = state["counts"], F.get(codes, i)
            leaves = F.when(i >= window.size, F.get(codes, i - window.size)).otherwise(-1)
            n_leaves = F.coalesce(F.get(counts, leaves), F.lit(0))
            n_enters = F.get(counts, enters) - (leaves == enters).cast("int")
            at = lambda n: F.get(table, n)
            fewer = F.when(leaves >= 0, at(n_leaves - 1) - at(n_leaves)).otherwise(0)
            total = state["sum"] + fewer + at(n_enters + 1) - at(n_enters)
            new = F.when(leaves == enters, counts).otherwise(F.transform(counts, lambda n, k: n + (k == enters).cast("int") - (k == leaves).cast("int")))
            hot = (i >= window.size - 1) & (total <= window.most)
            first = i - (window.size - 1)
            apart = hot & (first > state["end"])
            done = F.when(apart & (state["end"] >= 0), F.concat(state["out"], F.array(F.struct(state["start"].alias("start"), state["end"].alias("end"))))).otherwise(state["out"])
            return F.struct(
                new.alias("counts"),
                total.alias("sum"),
                F.when(apart, first).otherwise(state["start"]).alias("start"),
                F.when(hot, i + 1).otherwise(state["end"]).alias("end"),
                done.alias("out"),
            )

        last = lambda s: F.when(s["end"] >= 0, F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["out"])
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, last)

    return let(code, slid)


def windowed(text: Column, window: Window, kind: int, allowed: tuple[str, ...]) -> Column:
    """The spans of a class of characters in text."""
    suspect = lambda m: ~m["match"].rlike("|".join(f"(?:{a})" for a in allowed)) if allowed else F.lit(True)
    runs = F.filter(found(text, window.run), suspect)
    return F.flatten(F.transform(runs, lambda m: F.transform(hot_windows(m["match"], window), lambda w: span(kind, m["start"] + w["start"], m["start"] + w["end"]))))


def written(spans: Column, names: list[str]) -> Column:
    """kind:start:end of spans, by start, then kind, joined by commas."""
    name = lambda s: F.get(F.array(*map(F.lit, names)), s["kind"])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS, windows: tuple[Window, ...] = WINDOWS, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs with n_<pattern> for each pattern, base_spans (those of the patterns) and spans (those of windows, too): `kind:start:end` by start, then kind in the order given, joined by commas.

    Starts and ends are code points, ends exclusive. Matches of a pattern are those from left to right that don't overlap; those that are too short are dropped then.
    Spans of windows that lie in a span of a pattern are left out. A run matched by an expression of allowed gives none (the patterns have no
    allow-list). A null text is empty: no spans, and empty strings. Very long texts and runs are scanned whole. Repeated rows each get their result, a null
    doc_id stays. Columns of docs with the names of new ones are replaced. No row moves: the operator is one projection.
    """
    names = [p.name for p in patterns] + [w.name for w in windows]
    new = [*(f"n_{p.name}" for p in patterns), "base_spans", "spans"]
    kept = [c for c in docs.columns if c not in new]
    text, none = F.coalesce(F.col("text").cast("string"), F.lit("")), F.array().cast(NO_SPANS)
    own = [F.when(p.likely(text), matched(text, p, i)).alias(f"__p{i}") for i, p in enumerate(patterns)]
    more = [F.when(text.rlike(w.run), windowed(text, w, len(patterns) + i, allowed)).alias(f"__w{i}") for i, w in enumerate(windows)]
    out = docs.select(*kept, *own, *more)
    base = F.concat(*(F.coalesce(f"__p{i}", none) for i in range(len(patterns))))
    out = out.withColumn("__base", base)
    more = F.concat(*(F.coalesce(f"__w{i}", none) for i in range(len(windows)))) if windows else none
    more = F.filter(more, lambda s: ~F.exists("__base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    counts = [F.coalesce(F.size(f"__p{i}"), F.lit(0)).cast("long").alias(f"n_{p.name}") for i, p in enumerate(patterns)]
    return out.select(*kept, *counts, written(F.col("__base"), names).alias("base_spans"), written(F.concat("__base", more), names).alias("spans"))


def _sql() -> str:
    """The same in DuckDB: every window's characters are counted anew, and windows are joined by their gaps."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    kinds = ", ".join(f"({i}, {quoted(p.name)}, {quoted(p.expression)}, {p.group}, {p.least})" for i, p in enumerate(PATTERNS))
    classes = ", ".join(f"({len(PATTERNS) + i}, {quoted(w.name)}, {quoted(w.run)}, {w.size}, {w.most})" for i, w in enumerate(WINDOWS))
    allowed = quoted("|".join(f"(?:{a})" for a in ALLOWED))
    places = "CAST(list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda g: length(g))), 0) AS BIGINT)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p(kind, name, expr, grp, least) AS (VALUES {kinds}),
w(kind, name, expr, size, most) AS (VALUES {classes}),
f(c, v) AS (VALUES {", ".join(f"({c}, {v})" for c, v in enumerate(sums(max(w.size for w in WINDOWS))))}),
pm AS (SELECT doc_id, kind, name, grp, least, expr, regexp_extract_all(text, expr) AS ms, string_split_regex(text, expr) AS gaps FROM d, p),
pi AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM pm),
base AS (
  SELECT doc_id, kind, name, {places} AS a, {places} + length(ms[i]) AS b FROM pi
  WHERE length(CASE grp WHEN 0 THEN ms[i] ELSE regexp_extract(ms[i], expr, 2) END) >= least),
wm AS (SELECT doc_id, kind, name, size, most, regexp_extract_all(text, expr) AS ms, string_split_regex(text, expr) AS gaps FROM d, w),
wi AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM wm),
runs AS (SELECT doc_id, kind, name, size, most, {places} AS start, ms[i] AS run FROM wi WHERE NOT regexp_matches(ms[i], {allowed})),
slid AS (SELECT *, unnest(range(0, length(run) - size + 1)) AS pos FROM runs),
chars AS (SELECT *, substr(run, pos + 1 + k, 1) AS ch FROM (SELECT *, unnest(range(0, size)) AS k FROM slid)),
counts AS (SELECT doc_id, kind, name, size, most, start, pos, ch, count(*) AS c FROM chars GROUP BY ALL),
hot AS (SELECT doc_id, kind, name, size, start, pos FROM counts JOIN f USING (c) GROUP BY doc_id, kind, name, size, start, pos, most HAVING sum(v) <= most),
marked AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id, kind, start ORDER BY pos) + size THEN 0 ELSE 1 END AS fresh FROM hot),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, kind, start ORDER BY pos) AS island FROM marked),
more AS (SELECT doc_id, kind, name, start + min(pos) AS a, start + max(pos) + size AS b FROM islands GROUP BY doc_id, kind, name, size, start, island),
extra AS (SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = m.doc_id AND x.a <= m.a AND x.b >= m.b)),
said AS (
  SELECT doc_id, string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) AS spans
  FROM (SELECT * FROM base UNION ALL SELECT * FROM extra) GROUP BY doc_id),
told AS (
  SELECT doc_id, string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) AS spans, {", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{p.name}" for i, p in enumerate(PATTERNS))}
  FROM base GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{p.name}, 0) AS n_{p.name}" for p in PATTERNS)}, sha256(coalesce(told.spans, '')) AS base_sha256, coalesce(said.spans, '') AS spans
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN said USING (doc_id)
"""


OP13_SQL = _sql()
