"""Personal data in plain columns: patterns propose, checksums confirm, context adjusts a score.

Every kind has a pattern, a check of the found text and a start score. A pattern's matches
are put between markers, the text is split at the markers, and every second piece is a
match; running lengths of the pieces give its place in code points. Luhn (cards), mod 97
(bank accounts) and digit counts confirm; words around the match raise the score. The four
base kinds are reported whenever their check holds; the other kinds must also reach
``THRESHOLD`` and must not overlap a base match.

All patterns use possessive quantifiers and fixed starts, so the search is linear in the
text. No Python runs on the executors.

Edge cases: a null text is an empty one without spans; repeated rows give repeated spans;
input columns named like an output are replaced. The marker character (U+0001) in a text is
read as U+0002, which no pattern matches either; redacted texts keep the original.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

MARK, OTHER = "\x01", "\x02"
THRESHOLD = 0.6
CONTEXT_BONUS = 0.35
BEFORE, AFTER = 40, 20
#: Pieces summed in one inner step of ``running``.
STEP = 512


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right counts double, less nine if above nine; the sum must end in zero."""
    flipped = F.reverse(digits)
    value = lambda i: F.substring(flipped, i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + value(i) - F.when(value(i) > 9, 9).otherwise(0))
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """The first four characters go last, letters count 10 to 35, the number must leave 1."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4))
    code = lambda i: F.ascii(F.substring(turned, i, 1))
    step = lambda s, i: F.when(code(i) < 58, s * 10 + code(i) - 48).otherwise(s * 100 + code(i) - 55) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    """base: reported whenever the check holds. hint: a character without which no match is possible."""

    name: str
    pattern: str
    check: Callable[[Column], Column]
    score: float
    words: str
    base: bool = False
    hint: str = "[0-9]"


KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda x: F.lit(True), 0.65, "e-?mail|mail|contact|write|kontakt|correo|courriel", True, "@",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda x: x.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.6, "ip|address|host|server|adresse|client", True,
    ),
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
        lambda x: luhn(_digits(x)), 0.6, "card|visa|credit|debit|carte|karte|tarjeta", True,
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        lambda x: F.length(_digits(x)).between(8, 15), 0.6, "phone|tel|call|fax|mobile|cell|anruf|telefon", True, "\\+",
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3}(?![A-Za-z0-9]))?+(?![A-Za-z0-9])",
        mod97, 0.6, "iban|account|bank|konto|compte|cuenta",
    ),
    Kind(
        "shortcard",
        r"(?<![0-9.])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}+(?![ -]?[0-9])",
        lambda x: luhn(_digits(x)), 0.3, "card|visa|amex|credit|debit|carte|karte|tarjeta",
    ),
    Kind(
        "localphone",
        r"(?<![0-9+.-])\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}(?![0-9-])",
        lambda x: F.lit(True), 0.3, "phone|tel|call|fax|mobile|cell|anruf|telefon",
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        lambda x: F.lit(True), 0.3, "ssn|social security|insurance",
    ),
)
BASE = tuple(k.name for k in KINDS if k.base)


def running(lengths: Column) -> Column:
    """Sum of all earlier elements, for each element; in steps, so that no long array grows by one element at a time."""
    steps = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / STEP).cast("int"))
    blocks = F.transform(steps, lambda b: F.slice(lengths, b * STEP + 1, F.lit(STEP)))
    empty = F.array().cast("array<bigint>")
    none = F.array().cast("array<struct<at:bigint,done:array<bigint>>>")

    def block(done: Column, part: Column) -> Column:
        first = F.coalesce(F.try_element_at(done, F.lit(-1))["at"], F.lit(0).cast("bigint"))
        start = F.struct(first.alias("at"), empty.alias("done"))
        one = F.aggregate(part, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["done"], F.array(s["at"])).alias("done")))
        return F.concat(done, F.array(one))

    return F.flatten(F.transform(F.aggregate(blocks, none, block), lambda b: b["done"]))


def _hits(kind: Kind, pieces: Column, at: Column) -> Column:
    """The confirmed matches of one kind: every second piece, with its place and score."""

    def found(i: Column) -> Column:
        around = F.concat(F.right(F.get(pieces, i - 1), F.lit(BEFORE)), F.lit(" "), F.left(F.get(pieces, i + 1), F.lit(AFTER)))
        score = F.lit(kind.score) + F.when(around.rlike(rf"(?i)\b(?:{kind.words})\b"), CONTEXT_BONUS).otherwise(0.0)
        end = F.get(at, i) + F.length(F.get(pieces, i))
        return F.struct(F.lit(kind.name).alias("kind"), F.get(at, i).alias("start"), end.alias("end"), score.alias("score"))

    places = F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))
    return F.transform(F.filter(places, lambda i: kind.check(F.get(pieces, i))), found)


def _parts(spans_: Column) -> Column:
    """Spans by start, in about as many parts as each has spans, with the start and the greatest end of each part.

    A span is compared with the parts first: twice the root of their number, not all of them.
    """
    ordered = F.array_sort(F.transform(spans_, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(spans_)))).cast("int")
    cut_up = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans_) - 1) / width).cast("int")), lambda i: F.slice(ordered, i * width + 1, width))
    return F.transform(cut_up, lambda p: F.struct(p[0]["start"].alias("start"), F.array_max(F.transform(p, lambda x: x["end"])).alias("end"), p.alias("spans")))


def spans(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """Add ``out``: array of (kind, start, end, score), by kind in the order of ``KINDS``, then start; end is exclusive."""
    mine = [c for c in docs.columns if c != out]
    df = docs.select(*(F.col(f"`{c}`") for c in mine), F.translate(text_or_empty(text_col), MARK, OTHER).alias("__llm_text"))
    text = F.col("__llm_text")
    whole = F.array(F.lit("")).cast("array<string>")
    cut_up = {k.name: F.split(F.regexp_replace(text, f"({k.pattern})", f"{MARK}$1{MARK}"), MARK, -1) for k in KINDS}
    df = df.select(*(F.col(f"`{c}`") for c in mine), *(F.when(text.rlike(k.hint), cut_up[k.name]).otherwise(whole).alias(f"__llm_{k.name}") for k in KINDS))
    pieces = {k.name: F.col(f"__llm_{k.name}") for k in KINDS}
    zero = F.array().cast("array<bigint>")
    starts = {n: F.when(F.size(p) > 1, running(F.transform(p, lambda x: F.length(x).cast("bigint")))).otherwise(zero) for n, p in pieces.items()}
    df = df.select("*", *(s.alias(f"__llm_{n}_at") for n, s in starts.items()))
    nothing = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    for k in KINDS:
        hits = _hits(k, pieces[k.name], F.col(f"__llm_{k.name}_at"))
        df = df.withColumn(f"__llm_{k.name}_hits", F.when(F.size(pieces[k.name]) > 1, hits).otherwise(nothing))
    base = F.concat(*(F.col(f"__llm_{n}_hits") for n in BASE))
    df = df.withColumn("__llm_base", base)
    more = F.concat(*(F.col(f"__llm_{k.name}_hits") for k in KINDS if not k.base))
    df = df.withColumn("__llm_more", more).withColumn("__llm_parts", F.when((F.size("__llm_more") > 0) & (F.size("__llm_base") > 0), _parts(F.col("__llm_base"))))
    meets = lambda b, x: (b["start"] < x["end"]) & (x["start"] < b["end"])
    clash = lambda x: F.exists("__llm_parts", lambda p: meets(p, x) & F.exists(p["spans"], lambda b: meets(b, x)))
    strong = F.filter("__llm_more", lambda x: x["score"] >= THRESHOLD)
    # The parts are named twice, so the planner keeps them as a column and does not make them anew for every span.
    added = F.when(F.size("__llm_more") == 0, nothing).when(F.col("__llm_parts").isNull(), strong).otherwise(F.filter(strong, lambda x: ~clash(x)))
    return df.select(*(F.col(f"`{c}`") for c in mine), F.concat("__llm_base", added).alias(out))


def number(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")


def written(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: Column, found: Column) -> Column:
    """Every span becomes its kind in brackets; overlapping spans become one, under the kind that starts first."""
    order = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, (s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int"))
        tag = F.when(x["start"] >= s["at"], F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], F.array(gap, tag)).alias("out"))

    rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    return F.when(F.size(found) > 0, F.aggregate(order, start, step, rest)).otherwise(text)
