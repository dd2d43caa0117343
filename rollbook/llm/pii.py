"""Personal data: patterns propose spans, checks confirm them, words near them adjust the score.

All of it is column expressions.  A pattern is applied twice, to cut the text
at its matches and to list the matches; lengths of pieces and matches give
each span's place in code points.  Words are sought only in the pieces next to
a match, so the work stays linear in the text.

The base kinds (email, ip, card, phone) are always reported.  The further kinds
(iban, ssn, shortcard) are reported when their check holds and their score with
the words near them reaches a threshold.

Cases: a NULL text counts as empty and has no spans; spans of different kinds
may overlap; offsets count code points, so characters beyond the basic plane
count once; equal rows give equal results; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.words import as_column, let

BLOCK = 128
NEAR = 48
THRESHOLD = 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    hint: Callable[[Column], Column]  # cheap test, true wherever the pattern could match
    pattern: str
    check: Callable[[Column], Column]  # on one match
    score: float
    near: str  # words that raise the score
    far: str  # words that lower it
    base: bool = True
    alone: bool = False  # the match must not touch letters or digits


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn check."""
    def total(figures: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            figure = F.substring(figures, -i, F.lit(1)).cast("int")
            twice = figure * 2
            return acc + F.when(i % 2 == 0, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(figure)
        return F.aggregate(F.sequence(F.lit(1), F.length(figures)), F.lit(0), step)
    return F.when(F.length(_digits(value)) > 0, let(_digits(value), total) % 10 == 0).otherwise(False)


def mod97(value: Column) -> Column:
    """Whether an account number, four characters moved to the end and letters read as 10 to 35, leaves 1 by 97."""
    bare = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))

    def step(acc: Column, character: Column) -> Column:
        code = F.ascii(character)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97).cast("int")

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _digit_count(low: int, high: int) -> Callable[[Column], Column]:
    return lambda v: F.length(_digits(v)).between(low, high)


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_HAS_DIGITS = r"[0-9][\x20-]?[0-9]"

# Possessive forms of the plain patterns: same leftmost matches, no backtracking.  A run of
# word characters is tried once, from its start or from the end of the match before.
KINDS = (
    Kind("email", lambda t: F.instr(t, "@") > 0,
         r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda v: F.lit(True), 0.9, "mail|contact|write|reach", "example|noreply"),
    Kind("ip", lambda t: t.rlike(r"[0-9]\.[0-9]"),
         r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         lambda v: v.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"), 0.6, "address|host|server|login", "version|release|section"),
    Kind("card", lambda t: t.rlike(_HAS_DIGITS), r"[0-9](?:[\x20-]?[0-9])++",
         lambda v: F.when(F.length(_digits(v)).between(16, 19), luhn(v)).otherwise(False), 0.8, "card|credit|visa|payment", "isbn|serial|order"),
    Kind("phone", lambda t: F.instr(t, "+") > 0, r"\+[0-9][\x20().0-9-]+[0-9]", _digit_count(8, 15),
         0.7, "phone|call|tel|mobile|fax", "sum|total|score"),
    Kind("iban", lambda t: t.rlike("[A-Z]{2}[0-9]{2}"),
         r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
         lambda v: F.when(F.length(F.regexp_replace(v, " ", "")).between(15, 34), mod97(v)).otherwise(False),
         0.7, "iban|account|bank|transfer", "serial|part", base=False, alone=True),
    Kind("ssn", lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
         lambda v: ~v.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, "ssn|social security|social-security", "serial|part",
         base=False, alone=True),
    Kind("shortcard", lambda t: t.rlike(_HAS_DIGITS), r"[0-9](?:[\x20-]?[0-9])++",
         lambda v: F.when(F.length(_digits(v)).between(13, 15), luhn(v)).otherwise(False),
         0.3, "card|credit|amex|payment", "isbn|serial|order", base=False, alone=True),
)


def _starts(steps: Column) -> Column:
    """Running sums of an array, by blocks so that long arrays stay cheap."""
    def block_sum(given: Column, block: Column, upto: Column) -> Column:
        return F.aggregate(F.slice(given, block * BLOCK + 1, upto), F.lit(0).cast("long"), lambda a, x: a + x)

    def blocks(given: Column) -> Column:
        sums = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(given) - 1) / BLOCK).cast("int")), lambda b: block_sum(given, b, F.lit(BLOCK)))
        before = F.aggregate(
            sums, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return let(before, lambda pre: F.transform(
            F.sequence(F.lit(0), F.size(given) - 1),
            lambda i: F.get(pre, F.floor(i / BLOCK).cast("int"))
            + block_sum(given, F.floor(i / BLOCK).cast("int"), (i % BLOCK + 1).cast("int"))))

    return let(steps, blocks)


def proposals(text: str | Column, kind: Kind) -> Column:
    """All matches in order: array of (start, stop, value, before, after, ok, score)."""
    text = F.coalesce(as_column(text), F.lit(""))

    def spans(cut: Column) -> Column:
        def with_starts(placed: Column) -> Column:
            def span(i: Column) -> Column:
                value = F.get(cut.found, i)
                start = F.get(placed, i)
                before, after = F.substring(F.get(cut.pieces, i), -NEAR, NEAR), F.substring(F.get(cut.pieces, i + 1), 1, NEAR)
                around = F.lower(F.concat(before, F.lit(" "), after))
                score = (
                    F.lit(kind.score) + F.when(around.rlike(kind.near), 0.3).otherwise(0.0)
                    - F.when(around.rlike(kind.far), 0.3).otherwise(0.0)
                )
                ok = kind.check(value)
                if kind.alone:
                    ok = ok & ~before.rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]")
                if not kind.base:
                    ok = ok & (score >= THRESHOLD)
                return F.struct(
                    start.alias("start"), (start + F.length(value)).alias("stop"), value.alias("value"), ok.alias("ok"),
                    F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"))
            return F.transform(F.sequence(F.lit(0), F.size(cut.found) - 1), span)

        steps = F.transform(cut.found, lambda v, i: (
            F.length(F.get(cut.pieces, i)) + F.when(i == 0, 0).otherwise(F.length(F.get(cut.found, i - 1)))).cast("long"))
        return let(steps, lambda s: let(_starts(s), with_starts))

    cut = F.struct(F.split(text, kind.pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("found"))
    none = F.lit(None).cast("array<struct<start:bigint,stop:bigint,value:string,ok:boolean,score:double>>")
    hit = kind.hint(text)
    return F.when(hit, let(cut, lambda c: F.when(F.size(c.found) > 0, spans(c)).otherwise(none))).otherwise(none)


def confirmed(text: str | Column, kind: Kind) -> Column:
    """The spans of a kind that its check confirms; never NULL."""
    empty = F.array().cast("array<struct<start:bigint,stop:bigint,value:string,ok:boolean,score:double>>")
    return F.coalesce(F.filter(proposals(text, kind), lambda s: s.ok), empty)


def as_text(spans: Column, kind: Kind) -> Column:
    """Spans as kind:start:end."""
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind.name), s.start.cast("string"), s.stop.cast("string")))


def _without(text: Column, kind: Kind) -> Column:
    def rebuilt(cut: Column) -> Column:
        marks = F.transform(cut.spans, lambda s: F.when(s.ok, F.lit(f"<{kind.name.upper()}>")).otherwise(s.value))
        return let(marks, lambda m: F.array_join(F.transform(
            cut.pieces, lambda p, i: F.concat(p, F.coalesce(F.get(m, i), F.lit("")))), ""))

    cut = F.struct(F.split(text, kind.pattern, -1).alias("pieces"), proposals(text, kind).alias("spans"))
    whole = let(cut, lambda c: F.when(F.exists(c.spans, lambda s: s.ok), rebuilt(c)).otherwise(text))
    return F.when(kind.hint(text), whole).otherwise(text)


def redact(df: DataFrame, text_column: str = "text") -> DataFrame:
    """The frame with each confirmed span of the text replaced by its kind in angle brackets, kind after kind; NULL stays NULL."""
    for kind in KINDS:
        df = df.withColumn(text_column, _without(F.col(text_column), kind))
    return df


def with_spans(df: DataFrame, text_column: str = "text", prefix: str = "_pii_") -> DataFrame:
    """The frame with one array of confirmed spans per kind, in columns named by the prefix."""
    return df.withColumns({f"{prefix}{k.name}": confirmed(text_column, k) for k in KINDS})


def all_spans(prefix: str = "_pii_", base_only: bool = False) -> Column:
    """Every span of a frame with spans, as kind:start:end joined by commas."""
    kinds = [k for k in KINDS if k.base or not base_only]
    return F.concat_ws(",", F.concat(*[as_text(F.col(f"{prefix}{k.name}"), k) for k in kinds]))


def best_score(prefix: str = "_pii_") -> Column:
    """The highest score of any span; 0 without spans."""
    each = [F.coalesce(F.array_max(F.transform(F.col(f"{prefix}{k.name}"), lambda s: s.score)), F.lit(0.0)) for k in KINDS]
    return reduce(F.greatest, each[1:], each[0])
