"""Personal data, with DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for IBANs), and words near a span
adjust its score. A span is reported from a score of ``LEAST``.

Spark has no function for the places of all matches. A text splits at the matches of a pattern into the gaps between
them, so a match begins after the gaps and matches before it; running sums over both lists give the places in one
pass. Patterns are possessive and begin only where a run of their characters begins or the last match ended, which
matches the same and stays linear on very long runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let

#: Patterns of the base kinds, in order.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Patterns of the kinds that this method adds.
ADDED = {
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "pan": r"(?<![0-9A-Za-z])[0-9]{14,19}(?![0-9A-Za-z])",
    "tel": r"(?<![0-9A-Za-z+])\(?0[0-9]{1,4}\)?[\x20/-]?[0-9]{3,4}[\x20-]?[0-9]{3,5}(?![0-9A-Za-z])",
}
KINDS = (*PATTERNS, *ADDED)
#: Score of a span that its pattern and checksum leave, and words nearby that add ``NEAR``.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "pan": 0.6, "tel": 0.3}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|tel[ée]fono)\b",
    "iban": r"(?i)\b(?:iban|bank|konto|account|cuenta|compte)\b",
    "pan": r"(?i)\b(?:card|visa|mastercard|credit|karte|tarjeta|carte)\b",
    "tel": r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|tel[ée]fono)\b",
}
NEAR, LEAST, AROUND = 0.3, 0.5, 40
CHUNK = 64


def prefix_folds(items: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each i from 0 to the size of a non-empty array, the fold of its first i items.

    Chunks of ``CHUNK`` items are folded first and the chunks' results next, so a long array does not cost its square.
    """
    fold = lambda xs: F.aggregate(xs, zero, add)
    chunk = lambda i: F.floor(i / CHUNK).cast("int")
    chunks = F.sequence(F.lit(0), chunk(F.size(items)))
    sums = F.transform(chunks, lambda k: fold(F.slice(items, k * CHUNK + 1, F.lit(CHUNK))))
    step = lambda whole: lambda i: F.aggregate(F.slice(items, chunk(i) * CHUNK + 1, i % CHUNK), F.get(whole, chunk(i)), add)
    every = F.sequence(F.lit(0), F.size(items))
    return let(sums, lambda s: let(F.transform(chunks, lambda k: fold(F.slice(s, F.lit(1), k))), lambda whole: F.transform(every, step(whole))))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 of 97."""
    turned = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def confirmed(kind: str, found: Column) -> Column:
    """Whether a match of ``kind`` is what it seems."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
        return found.rlike(rf"\A(?=[0-9]){part}(?:\.(?=[0-9]){part}){{3}}\z")
    if kind in ("card", "pan"):
        return F.when((n >= 14) & (n <= 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    if kind == "iban":
        return mod97(F.regexp_replace(found, " ", ""))
    return (n >= 8) & (n <= 12)


NONE = "array<struct<start:int,number:int,end:int,kind:string,score:double>>"


def _spans(kind: str, text: Column) -> Column:
    """The spans of a kind in a text, in order."""
    pattern, number = (PATTERNS | ADDED)[kind], KINDS.index(kind)

    def span(gaps: Column, ends: Column) -> Callable[[Column, Column], Column]:
        def of(m: Column, i: Column) -> Column:
            near = F.concat_ws(" ", F.substring(F.get(gaps, i), -AROUND, AROUND), F.substring(F.get(gaps, i + 1), 1, AROUND))
            score = F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), NEAR).otherwise(0.0)
            sure = F.when(confirmed(kind, m), F.least(F.lit(1.0), score)).otherwise(0.0)
            return F.struct((F.get(ends, i + 1) - F.length(m)).alias("start"), F.lit(number).alias("number"), F.get(ends, i + 1).alias("end"), F.lit(kind).alias("kind"), sure.alias("score"))

        return of

    def placed(found: Column) -> Callable[[Column], Column]:
        def of(gaps: Column) -> Column:
            sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
            ends = lambda z: prefix_folds(z, F.lit(0), lambda a, x: a + x)
            return let(sizes, lambda z: let(ends(z), lambda e: F.filter(F.transform(found, span(gaps, e)), lambda s: s["score"] >= LEAST)))

        return of

    none = F.array().cast(NONE)
    rough = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, F.lit(True))
    matched = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), placed(m))).otherwise(none))
    return F.when(rough, matched).otherwise(none)


def with_spans(docs: DataFrame, text_col: str = "text", name: str = "__spans") -> DataFrame:
    """``docs`` with a column of that name: an array of (start, kind number, end, kind, score), in code points, end exclusive, sorted.

    A null text is empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    outside = lambda base: lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    # what the method adds stands outside the base spans
    both = lambda base: F.concat(base, *(F.filter(_spans(k, text), outside(base)) for k in ADDED))
    return docs.withColumn(name, F.array_sort(let(F.concat(*(_spans(k, text) for k in PATTERNS)), both)))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, score (of the surest span, 0 without).

    A null text is empty and has none. Repeated rows are kept; an empty table gives none. Long texts are read whole. Of spans of one kind the
    leftmost come first and none overlap; those of several kinds may. Other columns are not read, whatever their names.
    """
    df = with_spans(docs.select(id_col, text_col), text_col)
    base = F.filter("__spans", lambda s: s["number"] < len(PATTERNS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = [F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in PATTERNS]
    return df.select(
        id_col,
        *count,
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("__spans")).alias("spans"),
        F.size(F.filter("__spans", lambda s: s["number"] >= len(PATTERNS))).cast("long").alias("n_added"),
        F.coalesce(F.array_max(F.transform("__spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets (overlapping spans by the first one's), and the length of the
    text renewed where ``length_col`` is among the columns. Texts without spans stay as they are, null and empty ones included; long texts
    are masked whole. Repeated rows are kept, an empty table stays empty, and all columns are kept, whatever their names."""
    (name,) = fresh(docs, "__spans")
    df = with_spans(docs, text_col, name)
    text, spans = F.col(text_col), F.col(name)

    def masked(reach: Column) -> Column:
        """The text before and between the spans, and marks; reach: how far the spans before each one go."""
        piece = lambda s, i: F.when(s["start"] >= F.get(reach, i), F.concat(F.substring(text, F.get(reach, i) + 1, s["start"] - F.get(reach, i)), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, F.element_at(reach, -1) + 1, F.length(text)))

    ends = F.transform(spans, lambda s: s["end"])
    done = let(ends, lambda e: let(prefix_folds(e, F.lit(0), lambda a, x: F.greatest(a, x)), masked))
    none = F.size(spans) == 0
    out = {text_col: F.when(none, text).otherwise(done)}
    if length_col in docs.columns:
        out[length_col] = F.when(none, F.col(length_col)).otherwise(F.length(done).cast(docs.schema[length_col].dataType))
    return df.withColumns(out).select(*docs.columns)
