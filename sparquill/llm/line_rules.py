"""Quality rules, line first: every line is judged by rules on punctuation, navigation and boilerplate, lines that fail are
removed, and a document that loses too much of its text so goes as a whole.

Rules of a line that has a word (others cannot fail):

* symbols: two or more of the characters ``#*$%&|<>`` and over one in four words;
* punctuation: ``LONG_LINE`` words or more, of which none ends a sentence;
* navigation: three separators or more that stand alone, one in four words at least; or a short line of menu words only;
* boilerplate: a stock phrase in a line of up to ``PHRASE_LINE`` words; or a third of the words repeat the word before; or the line equals an
  earlier line of its document.

A document is judged within its own row, so nothing is shuffled and no key is hot. Repeated five-word windows are counted exactly by numbering the
distinct words, pairs, fours and fives of a text, in memory of some hundred bytes a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_rows, fresh

WINDOW = 5
LEAST_WORDS = 10  # a document of fewer words fails
MOST_REPEATED = 20  # percent of the words in repeated windows
MOST_LOST = 30  # percent of the characters in words that failing lines may hold
LONG_LINE = 8
PHRASE_LINE = 30
SEPARATORS = ("|", ">", "/", "-", "*", "»", "›", "•", "·", "→")
MENU = tuple("about account archive back basket blog cart categories checkout contact faq forum gallery help home imprint legal login logout menu news next previous print privacy products register search services share shop sitemap store subscribe support tags terms top".split())
PHRASES = (
    "accept all cookies", "all rights reserved", "back to top", "click here", "cookie policy", "copyright ©", "enable javascript", "follow us on", "lorem ipsum", "powered by", "privacy policy", "read more",
    "share this", "sign up for", "skip to content", "subscribe to our", "terms and conditions", "terms of service", "terms of use", "we use cookies",
)
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
#: The end of a sentence: a mark, quotes or brackets that close, then white space or the end of the line.
SENTENCE = "[.!?…。！？][\"')\\]’”»]*(?:[\\x20\\x09-\\x0D]|$)"
_SENTENCE = re.compile(SENTENCE)
_UNCOUNTED = bytes(b for b in range(256) if (b & 0xC0) == 0x80 or b in SPACES)  # bytes that do not begin a character of a word
_SEPARATOR, _MENU, _PHRASE = {s.encode() for s in SEPARATORS}, {m.encode() for m in MENU}, re.compile(b"|".join(re.escape(p.encode()) for p in PHRASES))


def word_characters(text: bytes) -> int:
    return len(text.translate(None, _UNCOUNTED))


def symbols_of(text: bytes) -> int:
    return len(text) - len(text.translate(None, SYMBOLS))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that are found twice or more, first ones included."""
    if len(words) <= window:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    one = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    runs = one
    for k in range(1, window):  # a number for each distinct run of k + 1 words
        runs = runs[:-1] * len(number) + one[k:]
        if k == window - 1 or len(number) ** (k + 2) >= 1 << 62:
            _, runs = np.unique(runs, return_inverse=True)
    twice = np.bincount(runs)[runs] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:-window][twice] += 1
    cover[window:][twice] -= 1
    return int((np.cumsum(cover[:-1]) > 0).sum())


def line_fails(line: bytes, words: list[bytes]) -> str | None:
    """The rule that a line with these words fails by itself, or None."""
    n = len(words)
    symbols = symbols_of(line)
    if symbols >= 2 and 4 * symbols > n:
        return "symbols"
    separators = sum(map(_SEPARATOR.__contains__, words))
    low = line.translate(LOWER)
    if (separators >= 3 and 4 * separators >= n) or (n < LONG_LINE and _MENU.issuperset(low.split())):
        return "navigation"
    if n >= LONG_LINE and not _SENTENCE.search(line.decode("utf-8", "replace")):
        return "punctuation"
    if (n <= PHRASE_LINE and _PHRASE.search(low)) or 3 * sum(map(eq, words, words[1:])) >= n > 1:
        return "boilerplate"
    return None


def judged(text: bytes | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_removed, lost_chars, cleaned) of a text."""
    text = text or b""
    words = text.split()
    seen: set[bytes] = set()
    n_lines = repeats = removed = lost = 0
    stay = []
    for line in text.split(b"\n"):
        own = line.split()
        fails = False
        if own:
            n_lines += 1
            again = line in seen
            seen.add(line)
            repeats += again
            if fails := again or line_fails(line, own) is not None:
                removed += 1
                lost += word_characters(line)
        if not fails:
            stay.append(line)
    chars, repeated = word_characters(text), repeated_words(words)
    base = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words)
    kept = not base and 100 * lost <= MOST_LOST * chars
    return len(words), chars, symbols_of(text), repeats, repeated, base, kept, n_lines, removed, lost, b"\n".join(stay)


FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_removed long, lost_chars long"


def judge(docs: DataFrame, carried: list[str], text_col: str = "text", cleaned: str | None = None) -> DataFrame:
    """The ``carried`` columns and the figures and verdict of each row; with ``cleaned``, a column of that name with the text less its failing lines.

    Null and empty texts have no words and fail; a null one's cleaned text is null. Repeated rows are judged each, long texts whole; a line equal to
    several earlier ones counts once. An empty table gives no rows. Other columns than ``carried`` and the text are not read, whatever their names;
    a carried column named like a figure is refused.
    """
    names = [f.split()[0] for f in FIGURES.split(", ")]
    if clash := set(carried) & {*names, cleaned}:
        raise ValueError(f"carried columns named like results: {', '.join(sorted(clash))}")
    kinds = [pa.bool_() if f.endswith("boolean") else pa.int64() for f in FIGURES.split(", ")]

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_rows(batches):
            found = [judged(t) for t in texts]
            cols = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            if cleaned:
                cols.append(pa.array([None if t is None else f[-1] for t, f in zip(texts, found, strict=True)], pa.binary()))
            yield pa.record_batch([*part.columns[:-1], *cols], names=[*carried, *names, *([cleaned] if cleaned else [])])

    own = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carried)
    (raw,) = fresh(docs, "__text")
    out = docs.select(*carried, F.col(text_col).cast("binary").alias(raw)).mapInArrow(give, own + FIGURES + (f", `{cleaned}` binary" if cleaned else ""))
    return out.withColumn(cleaned, F.col(cleaned).cast("string")) if cleaned else out


def keep_clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` less the rejected rows, failing lines removed from the texts; all columns are kept, whatever their names.

    Null and empty texts have no words and are rejected; repeated rows share their fate; an empty table stays empty; long texts are cleaned whole.
    """
    columns = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    found = judge(docs.toDF(*columns), columns, columns[at], cleaned="cleaned").where("kept")
    return found.select(*(F.col("cleaned" if i == at else c).alias(name) for i, (c, name) in enumerate(zip(columns, docs.columns, strict=True))))


def report(docs: DataFrame) -> DataFrame:
    return judge(docs, ["doc_id"])


def sql() -> str:
    """The same in SQL over ``documents``."""
    quoted = lambda names: ", ".join(f"'{n}'" for n in names)
    phrases = " OR ".join(f"contains(low, '{p}')" for p in PHRASES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sentence = SENTENCE.replace("'", "''")
    word = "[^\\x20\\x09-\\x0D]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS place FROM (SELECT r, regexp_extract_all(text, '{word}') AS words FROM d)),
runs AS (SELECT r, place, word || ' ' || string_agg(word, ' ') OVER f AS run, count(*) OVER f AS more FROM w WINDOW f AS (PARTITION BY r ORDER BY place ROWS BETWEEN 1 FOLLOWING AND {WINDOW - 1} FOLLOWING)),
twice AS (SELECT r, place, count(*) OVER (PARTITION BY r, run) > 1 AS again FROM runs WHERE more = {WINDOW - 1}),
hit AS (SELECT r, count(DISTINCT place + k) AS n_repeat_words FROM (SELECT r, place, unnest(range({WINDOW})) AS k FROM twice WHERE again) GROUP BY r),
cut AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM (SELECT r, string_split(text, chr(10)) AS lines FROM d)),
l AS (SELECT r, line, {lower.format('line')} AS low, regexp_extract_all(line, '{word}') AS words, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars,
 length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols, row_number() OVER (PARTITION BY r, line ORDER BY place) > 1 AS again FROM cut WHERE regexp_matches(line, '{word}')),
f AS (SELECT r, chars, again, again OR (symbols >= 2 AND 4 * symbols > len(words))
 OR (len(list_filter(words, lambda x: x IN ({quoted(SEPARATORS)}))) >= 3 AND 4 * len(list_filter(words, lambda x: x IN ({quoted(SEPARATORS)}))) >= len(words))
 OR (len(words) < {LONG_LINE} AND len(list_filter(regexp_extract_all(low, '{word}'), lambda x: x NOT IN ({quoted(MENU)}))) = 0)
 OR (len(words) >= {LONG_LINE} AND NOT regexp_matches(line, '{sentence}'))
 OR (len(words) <= {PHRASE_LINE} AND ({phrases}))
 OR (len(words) > 1 AND 3 * len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) >= len(words)) AS fails FROM l),
g AS (SELECT r, count(*) AS n_lines, CAST(count_if(again) AS BIGINT) AS n_dup_lines, CAST(count_if(fails) AS BIGINT) AS n_removed, coalesce(sum(chars) FILTER (WHERE fails), 0) AS lost_chars FROM f GROUP BY r),
b AS (SELECT doc_id, len(regexp_extract_all(text, '{word}')) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
 length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
 coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars FROM d LEFT JOIN hit USING (r) LEFT JOIN g USING (r)),
c AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost_chars <= {MOST_LOST} * word_chars AS kept, n_lines, n_removed, lost_chars FROM c"""
