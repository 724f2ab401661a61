"""Secret scans with DataFrame functions only: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .text import fresh

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs below the least length fail as a whole, so asking for the length in the pattern finds the same spans.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "entropy")  # the order of spans that start together


@dataclass(frozen=True)
class CharacterClass:
    """Runs of these characters within a candidate are judged by themselves: a window is hot from ``least`` bits a character."""

    name: str
    characters: str
    least: float


WINDOW = 24
# Every class looks at its own runs, so a name or path glued to a key does not change the limit; a hot window of any counts.
# The limit of the two alphanumeric classes fits base32, which they hold: 24 random characters of 32 have 3.95 bits.
CLASSES = (
    CharacterClass("hex", "0-9a-fA-F", 3.0),
    CharacterClass("upper", "A-Z0-9", 3.5),
    CharacterClass("lower", "a-z0-9", 3.5),
    CharacterClass("base64", "A-Za-z0-9+/_=-", 4.0),
)
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}+"
# The piece of a candidate that holds one of these is no secret: identifiers, placeholders, alphabets; or it has no digit at all.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i:example|placeholder|changeme|dummy|your[_-]|xxxx)",
    r"(?i:abcdefghijkl)|0123456789",
    r"^[^0-9]+$",
)
# What a match suppresses around it: up to the next = / _ (a - joins the words of one name), but not more than this.
REACH = 2 * WINDOW
SCALE = 1 << 20  # c * log2(c) as whole numbers, so that running sums do not drift


def _units(count: int) -> int:
    return round(count * math.log2(count) * SCALE) if count else 0


def matches(text: str, pattern: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))


def located(text: str, found: str, pattern: str) -> Column:
    """(start, value) of each match in code points: the pieces between the matches tell how far along each one is."""
    return F.expr(_located(f"`{text}`", f"`{found}`", pattern))


def _located(text: str, found: str, pattern: str) -> str:
    return f"""CASE WHEN size({found}) = 0 THEN CAST(array() AS array<struct<start:bigint,value:string>>) ELSE
        aggregate(
            zip_with(slice(split({text}, {_quoted(pattern)}, -1), 1, size({found})), {found}, (g, m) -> struct(length(g) AS gap, m AS value)),
            named_struct('at', 0L, 'out', CAST(array() AS array<struct<start:bigint,value:string>>)),
            (s, m) -> named_struct('at', s.at + m.gap + length(m.value), 'out', concat(s.out, array(named_struct('start', s.at + m.gap, 'value', m.value)))),
            s -> s.out) END"""


def _matches(text: str, pattern: str) -> str:
    """SQL: (start, value) of each match within a text that is an expression."""
    found = f"regexp_extract_all({text}, {_quoted(pattern)}, 0)"
    return f"flatten(transform(array({found}), found -> {_located(text, 'found', pattern)}))"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


NO_RUNS = "CAST(array() AS array<struct<start:bigint,end:bigint>>)"


def hot_runs(value: str, least: float, window: int = WINDOW) -> str:
    """SQL: (start, end) of the maximal runs of windows with ``least`` bits a character within a value.

    The window's character counts are kept from step to step: the character that enters adds one, the one that leaves
    takes one, and the sum of c * log2(c), which gives the entropy, changes by their four terms only.
    """
    table = "array(" + ", ".join(f"{_units(c)}L" for c in range(window + 2)) + ")"
    most = f"{math.floor(window * (math.log2(window) - least) * SCALE)}L"
    grown = f"""CASE
        WHEN t.sum > {most} OR t.i < {window} THEN t.runs
        WHEN size(t.runs) > 0 AND element_at(t.runs, -1).end >= t.i - {window} THEN
            concat(slice(t.runs, 1, size(t.runs) - 1), array(named_struct('start', element_at(t.runs, -1).start, 'end', t.i)))
        ELSE concat(t.runs, array(named_struct('start', t.i - {window}, 'end', t.i))) END"""
    return f"""aggregate(
        transform(array(filter(split({value}, ''), c -> c != '')), x -> struct(x AS chars, array_distinct(x) AS kinds)),
        {NO_RUNS},
        (ignored, a) -> aggregate(
            transform(a.chars, (c, i) -> struct(array_position(a.kinds, c) AS enters,
                CASE WHEN i >= {window} THEN array_position(a.kinds, a.chars[i - {window}]) ELSE 0L END AS leaves)),
            named_struct('i', 0L, 'counts', array_repeat(0, size(a.kinds)), 'sum', 0L, 'runs', {NO_RUNS}),
            (s, c) -> element_at(transform(array(named_struct(
                'i', s.i + 1,
                'counts', transform(s.counts, (n, k) -> n + IF(k + 1 = c.enters, 1, 0) - IF(k + 1 = c.leaves, 1, 0)),
                'sum', s.sum + CASE WHEN c.enters = c.leaves THEN 0L ELSE
                    {table}[s.counts[CAST(c.enters AS int) - 1] + 1] - {table}[s.counts[CAST(c.enters AS int) - 1]]
                    + CASE WHEN c.leaves = 0 THEN 0L ELSE
                        {table}[s.counts[CAST(c.leaves AS int) - 1] - 1] - {table}[s.counts[CAST(c.leaves AS int) - 1]] END END,
                'runs', s.runs)),
                t -> named_struct('i', t.i, 'counts', t.counts, 'sum', t.sum, 'runs', {grown})), 1),
            s -> s.runs))"""


def class_runs(value: str, suppressed: str, window: int = WINDOW, classes: Sequence[CharacterClass] = CLASSES) -> str:
    """SQL: (start, end) of the runs of windows within a candidate that are hot in any class, united where they meet.

    ``suppressed`` is a condition on ``p.value``, a class's run that is no secret.
    """
    found = ", ".join(
        f"""flatten(transform(filter({_matches(value, f"[{c.characters}]{{{window},}}+")}, p -> NOT ({suppressed})), p -> transform(
            {hot_runs("p.value", c.least, window)}, r -> named_struct('start', p.start + r.start, 'end', p.start + r.end))))"""
        for c in classes
    )
    return f"""aggregate(array_sort(concat({found})), {NO_RUNS}, (runs, r) -> CASE
        WHEN size(runs) > 0 AND element_at(runs, -1).end >= r.start THEN concat(slice(runs, 1, size(runs) - 1), array(named_struct(
            'start', element_at(runs, -1).start, 'end', greatest(element_at(runs, -1).end, r.end))))
        ELSE concat(runs, array(r)) END)"""


def _unsuppressed(value: str, allowed: Sequence[str]) -> str:
    """SQL: the candidate with spaces in place of the pieces that an allowed pattern suppresses."""
    near = f"[^=/_]{{0,{REACH}}}"
    for a in allowed:
        masked = f"""aggregate({_matches("v", f"(?:{near}(?:{a})){{1,8}}{near}")}, v, (t, m) -> concat(
            left(t, CAST(m.start AS int)), repeat(' ', length(m.value)), substring(t, CAST(m.start AS int) + length(m.value) + 1)))"""
        value = f"element_at(transform(array({value}), v -> IF(v RLIKE {_quoted(a)}, {masked}, v)), 1)"
    return value


def find_secrets(docs: DataFrame, name: str, text: str = "text", allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """The documents with a column ``name``: an array of (start, rank, end, kind), sorted, in code points, end exclusive.

    assign, access and hex are the leftmost non-overlapping matches of their patterns, each kind for itself.  entropy
    spans are the runs of windows with many bits a character, for the class of characters they lie in, in what
    the allow-list leaves of the candidates; they come on top and never remove a span.  Null and empty texts have no
    spans; very long ones are scanned whole; an empty table gives no rows.  One projection over the scan: no shuffle,
    no Python, and rows are handled each for itself, so repeated rows or ids do not matter.  The work grows with the
    text, and with the square of the number of matches within one text.
    """
    whole, *raw = fresh(docs, "_whole", "_assign", "_access", "_hex", "_candidates")
    patterns = dict(zip(raw, (ASSIGN, ACCESS, HEX, CANDIDATE)))
    rows = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumns({c: matches(whole, p) for c, p in patterns.items()})
    placed = fresh(rows, "_at_assign", "_at_access", "_at_hex", "_at_candidates")
    rows = rows.withColumns({p: located(whole, c, pattern) for p, (c, pattern) in zip(placed, patterns.items())})
    secret = f"x -> length(regexp_extract(x.value, {_quoted('^' + ASSIGN)}, 2)) >= 6"

    def spans(rank: int, source: str) -> str:
        return (
            f"transform({source}, x -> named_struct('start', x.start, 'rank', {rank}, 'end', x.start + length(x.value), 'kind', '{KINDS[rank]}'))"
        )

    def suppressed(value: str) -> str:
        return " OR ".join(f"{value} RLIKE {_quoted(a)}" for a in allowed) or "false"

    entropy = f"""flatten(transform(transform(`{placed[3]}`,
            x -> named_struct('start', x.start, 'value', {_unsuppressed("x.value", allowed)})), x -> transform(
        {class_runs("x.value", suppressed("p.value"))},
        r -> named_struct('start', x.start + r.start, 'rank', 3, 'end', x.start + r.end, 'kind', 'entropy'))))"""
    found = f"array_sort(concat({spans(0, f'filter(`{placed[0]}`, {secret})')}, {spans(1, f'`{placed[1]}`')}, {spans(2, f'`{placed[2]}`')}, {entropy}))"
    return rows.withColumn(name, F.expr(found)).drop(whole, *raw, *placed)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(docs: DataFrame, text: str = "text", mark: str = "***") -> DataFrame:
    """The documents with every span of the text, overlapping ones as one, replaced by ``mark``."""
    (name,) = fresh(docs, "_spans")
    rows = find_secrets(docs, name, text)
    cut = f"""aggregate(`{name}`, named_struct('at', 0L, 'out', ''),
        (s, x) -> named_struct('at', greatest(s.at, x.end), 'out', CASE WHEN x.start < s.at THEN s.out
            ELSE concat(s.out, substring(`{text}`, CAST(s.at AS int) + 1, CAST(x.start - s.at AS int)), '{mark}') END),
        s -> concat(s.out, substring(`{text}`, CAST(s.at AS int) + 1)))"""
    return rows.withColumn(text, F.when(F.size(name) > 0, F.expr(cut)).otherwise(F.col(text))).drop(name)
