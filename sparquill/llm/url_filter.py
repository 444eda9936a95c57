"""URL filter: a weighted vocabulary found by Aho-Corasick, with boundary checks.

A strict term rejects a URL on its own; soft terms reject it when several distinct ones weigh ``LIMIT`` together, whatever
their number of occurrences. No soft term weighs as much alone. A term counts only between characters that are no letters or digits. Rules on hosts
and paths come first and are plain columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Terms that reject on their own.
STRICT = tuple(
    "adult-x bestiality bukkake camgirl camgirls camsex casino casinos cheap-pills cialis cumshot deepfake-porn escort escorts fakepassport gangbang hardcore-sex hentai "
    "keygen keygens malware nulled onlinecasino phentermine phishing porn porno pornography pornhub rapidgator redtube sexcam sexcams sexchat slotmachine spam-farm sportsbook "
    "steroids-online tramadol upskirt viagra warez xanax xhamster xnxx xvideos xxx youporn".split()
)
#: Soft terms by weight: distinct ones that weigh ``LIMIT`` together reject. Of weight 1 are words that clean addresses have too, of 2 such as need
#: one more beside them, of 3 hardly ever innocent ones.
SOFT = {
    **dict.fromkeys("ads adult affiliate bargain bonus camera-deals cash coupon coupons credit date deal deals discount download earn farm free girls hot invest lottery luxury miracle model money offer pills promo replica "
                    "rich sale sales single singles spin track trial vape win winner".split(), 1),
    **dict.fromkeys("bet bets betting bitcoin-doubler cam cheap crack cracked crypto-bonus dating diet-pills fetish forex gambling hookup jackpot kinky loan loans lingerie nude payday poker roulette serial-key sex sexy slots spam "
                    "torrent torrents weight-loss".split(), 2),
    **dict.fromkeys("blackjack erotic erotica freebies-casino get-rich-quick milf naked nsfw payday-loans sexdating strip-poker webcam-girls".split(), 3),
}
LIMIT = 4


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host and path of a url column; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        site, _, start = rule.partition("/")
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _hits(automaton, url: str | None) -> tuple[int, int]:
    """Distinct strict terms and weight of the distinct soft terms in a url."""
    low = (url or "").lower()
    strict, soft = set(), {}
    for end, (term, weight) in automaton.iter(low) if low else ():
        start = end - len(term) + 1
        if (start == 0 or not low[start - 1].isalnum()) and (end + 1 == len(low) or not low[end + 1].isalnum()):
            if weight:
                soft[term] = weight
            else:
                strict.add(term)
    return len(strict), sum(soft.values())


def url_filter(pages: DataFrame, carried: list[str], url_col: str = "url", strict: tuple = STRICT, soft: dict = SOFT, limit: int = LIMIT, rules: tuple = RULES) -> DataFrame:
    """The ``carried`` columns, host, path, rule, verdict, n_strict, soft_weight of each row.

    A null or empty url, or one without ``://``, has an empty host and path, and no rule; null has no terms. Repeated rows
    are judged each, long urls whole; rules of equal length cannot both fit but by equal text. An empty table gives no rows. Other columns than
    ``carried`` are not read, whatever their names.
    """

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in strict:
            automaton.add_word(term, (term, 0))
        for term, weight in soft.items():
            automaton.add_word(term, (term, weight))
        automaton.make_automaton()
        for batch in batches:
            hits = [_hits(automaton, u) for u in batch.column(batch.num_columns - 1).to_pylist()]
            cols = [pa.array([h[i] for h in hits], pa.int32()) for i in (0, 1)]
            yield pa.record_batch([*batch.columns, *cols], names=[*carried, "__url", "n_strict", "soft_weight"])

    own = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in carried)
    found = pages.select(*carried, F.col(url_col).alias("__url")).mapInArrow(give, own + "__url string, n_strict int, soft_weight int")
    host, path = host_and_path("__url")
    placed = found.withColumns({"host": host, "path": path}).withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    method = F.when((F.col("n_strict") > 0) | (F.col("soft_weight") >= limit), "block").otherwise("allow")
    verdict = method
    for rule, said in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(said)).otherwise(verdict)
    return placed.select(*carried, "host", "path", "rule", verdict.alias("verdict"), "n_strict", "soft_weight")


def sql() -> str:
    """The same in SQL: a term between boundaries is a regular expression."""
    hit = lambda term: f"regexp_matches(lower(coalesce(url, '')), '(^|[^\\p{{L}}\\p{{N}}]){term}([^\\p{{L}}\\p{{N}}]|$)')"
    strict = " + ".join(f"CAST({hit(t)} AS INT)" for t in STRICT)
    soft = " + ".join(f"{w} * CAST({hit(t)} AS INT)" for t, w in SOFT.items())
    fits = lambda rule: f"(host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}')"
    order = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in order) + " END"
    said = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in order)
    return f"""
WITH a AS (SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT page_id, host, path, {rule} AS rule, CAST({strict} AS INT) AS n_strict, CAST({soft} AS INT) AS soft_weight FROM b)
SELECT page_id, host, path, rule, {said} ELSE CASE WHEN n_strict > 0 OR soft_weight >= {LIMIT} THEN 'block' ELSE 'allow' END END AS verdict,
 n_strict, soft_weight FROM c"""
