"""Operators over texts against brute force, on a fixture of hard cases and on the smallest tables."""

import hashlib
import re
from zlib import crc32

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from sparquill.llm import decontaminate, license_scan, lm_score, media, packing, pii, quality, simhash
from sparquill.llm.queries import queries, tokenizer_path

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}x" for i in range(30_000))
TEXTS = [
    None, "", " \t\n\v\f\r ", "one", "Two words", "three small words", "a b c d", "A B C D", "ÄÖ ü ß éé 日本語 text joined x y",
    LONG, LONG + " tail", LONG, "x" * 5000, "mail a@b.c.d@e.fg, x@y and .%+-@a-b.c", "ip 1.2.3.4.5.6.7.8 256.1.1.1 0001.002.03.255 1.2.3",
    "card 4111 1111 1111 1111 then 4111111111111111 4111111111111111 and 5500-0000-0000-0004 9", "call +1 (017) 555-7713 or +49.30.1234567 or +12 ++1234567890123456",
    "iban GB82 WEST 1234 5698 7654 32 ok; phone 030 1234 5678", "日本 a@b.cd 語 +1234567890", "7" * 3000, "a@" * 500, "1." * 800, "+1 " * 400, "it's we'll 12ab\x1cx\x85y <|endoftext|> fin",
    "Released under the MIT License.", "so: Licensed under the\nApache License, version 2.0! yes", "This work is licensed under the GNU General Public License, version 3.",
]
SCHEMA = "text string, doc_id long, component_id string, piece string, row string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(t, i, "c", "p", "r") for i, t in enumerate(TEXTS)] + [(TEXTS[4], 4, "c", None, "r"), ("no id", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def small(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


# simhash -------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_simhash(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))), key=repr)


def test_simhash(spark, docs, empty):
    for df in (docs, empty, small(spark, "documents")):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        assert rows_of(simhash.near_duplicates(df)) == brute_simhash(rows)


def test_ball_links_and_components(spark):
    import random

    rng = random.Random(1)
    fps = {0, -1, -(1 << 63), (1 << 63) - 1}
    for _ in range(40):
        f = rng.getrandbits(64) - (1 << 63)
        for _ in range(rng.randrange(1, 30)):  # chains of near fingerprints
            fps.add(f)
            for _ in range(rng.randrange(1, 4)):
                f ^= (1 << rng.randrange(63)) if rng.random() < 0.95 else -(1 << 63)
    df = spark.createDataFrame([(i, f) for i, f in enumerate(sorted(fps))], "id long, fp long")
    order = sorted(fps)
    for radius in (0, 1, 2):
        root = {f: f for f in fps}

        def find(f, root=root):
            while root[f] != f:
                f = root[f]
            return f

        for i, a in enumerate(order):
            for b in order[:i]:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        got = {r.fp: r.component_id for r in simhash.component_of(df, "id", radius).collect()}
        assert got == {f: order.index(find(f)) for f in fps}


def test_keep_one(spark, docs):
    for df in (docs, small(spark, "documents").withColumn("__k1", F.lit("mine"))):
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        heads = brute_near([tuple(r) for r in df.select("doc_id", "text").collect()])
        assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(h for h in heads if h is not None)
    twice = docs.union(docs)
    assert simhash.keep_one(twice).count() == simhash.keep_one(docs).count()
    assert simhash.keep_one(docs.where("false")).count() == 0


def test_similar_texts_are_found(spark):
    """Of pairs of texts at known similarities of 0.8 and a little more, nearly all are joined; below it none."""
    import random

    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for i in range(200):
        own = [word() for _ in range(204)]  # 200 shingles
        near, far = list(own), list(own)
        for k in range(4):  # each changed word takes five shingles: 180 shared of 220
            near[20 + 40 * k] = word()
        for k in range(6):  # 170 of 230
            far[20 + 30 * k] = word()
        rows += [(3 * i, " ".join(own)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(far))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(3 * i + 1 not in kept for i in range(200)) >= 198 and all(3 * i + 2 in kept for i in range(200))


def test_stage_links_fingerprints_by_balls(spark, monkeypatch):
    """The stage's first candidates meet in balls of radius one: without any sample's bucket, texts whose fingerprints are within two bits are still joined."""
    rng = np.random.default_rng(3)
    fps = [0, 1, 3, 7 << 20, 7 << 20] + [int(x) for x in rng.integers(1 << 40, 1 << 62, 20)]
    links = simhash.fingerprint_links(spark.createDataFrame([(10 * i, f) for i, f in enumerate(fps)], "node long, fp long")).collect()
    assert all(r.u > r.v for r in links) and {(r.u, r.v) for r in links} >= {(40, 30)} and {r.u for r in links} | {r.v for r in links} == {0, 10, 20, 30, 40}
    alone = iter(range(10**6))
    monkeypatch.setattr(simhash, "sample_links", lambda buckets: buckets.select(F.col("node").alias("u"), F.col("node").alias("v")).where("false"))
    monkeypatch.setattr(simhash, "likely_links", lambda buckets, least: buckets.select(F.col("node").alias("u"), F.col("node").alias("v")).where("false"))
    text = [f"w{next(alone)}" for _ in range(4000)]
    near = [*text[:-1], "other"]
    kept = simhash.keep_one(spark.createDataFrame([(1, " ".join(text)), (2, " ".join(near)), (3, " ".join(text[::-1]))], "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {1, 3}


def test_a_bucket_gives_no_more_links_than_join_it(spark):
    """Of a bucket of near copies a link less than there are components leaves, not each pair; texts below the similarity stay apart, also where a bucket goes over batches."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    rows = []
    for bucket in range(9):
        for k in range(60):
            own = base.copy()
            own[:2] = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
            if k % 20 == 19:
                own[:100] = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
            node = 1000 * bucket + k
            rows.append((bucket, node, node if k > 4 else 1000 * bucket, simhash.min_hashes(own), np.unique(own).tobytes()))
    buckets = spark.createDataFrame(rows, "key long, node long, root long, sketch binary, shingles binary")
    links = [(r.u, r.v) for r in simhash.likely_links(buckets, 0.8).collect()]
    assert len(links) == 9 * (57 - 5) and all(u > v and u // 1000 == v // 1000 and u % 20 != 19 != v % 20 for u, v in links)
    assert len({u for u, v in links} | {v for u, v in links}) == 9 * 57 - 9 * 4 + len({v for u, v in links if 0 < v % 1000 <= 4} | {u for u, v in links if 0 < u % 1000 <= 4})
    met = {r.node for r in simhash.likely_members(buckets.drop("shingles"), 0.62).collect()}
    assert met == {n for _, n, *_ in rows if n % 20 != 19}


@pytest.mark.parametrize("most", [30, 128])
def test_crowded_buckets_lose_no_link(spark, most):
    """Families whose members share long passages, so buckets hold many texts of which only some are similar; small buckets and large ones."""
    import random

    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for _ in range(3):
        base = [word() for _ in range(150)]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.choice((1, 1, 2, 3))):
                own[rng.randrange(len(own))] = word()
            at = rng.randrange(100)
            if rng.random() < 0.4:
                own[at : at + rng.randrange(25)] = [word() for _ in range(rng.randrange(40))]
            rows.append((len(rows), " ".join(own)))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), small=most).collect()}
    want = brute_near(rows)
    assert 3 < len(want) < len(rows) and kept >= want and len(kept) <= len(want) + 1


@pytest.mark.parametrize("most", [2, 8])
def test_pairs_of_large_buckets_are_all_found(spark, monkeypatch, most):
    """Texts that share a passage, so that they meet in large buckets only, are all below the similarity but for some pairs, which are a little above it: all are found, and the nodes of large buckets are not cut by
    each set of samples. Blocks of a rare shingle meet as well."""
    import random

    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(160)]
    rows = []
    for i in range(60):
        own = [*passage, *(word() for _ in range(44))]  # 156 shingles of 244 are shared
        near = list(own)
        for k in range(4):  # 180 of 220, one change in each quarter
            near[4 + 50 * k + rng.randrange(40)] = word()
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(near))]
    blocks = simhash.cut_to_blocks
    rounds = []
    monkeypatch.setattr(simhash, "cut_to_blocks", lambda rows, n: rounds.append(n) or blocks(rows, most))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), small=most).collect()}
    assert kept == brute_near(rows) == set(range(0, 120, 2)) and len(rounds) == 1


def test_near_duplicate_recall_on_whole_table(spark):
    """All pairs of different texts at 0.8 and more on a table of 10,000 rows, found by their shingles: 19 in 20 lose a text at least."""
    from collections import defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    least: dict = {}
    for r in docs.select("doc_id", "text").collect():
        key = b" ".join(re.sub("[A-Z]+", lambda m: m[0].lower(), r.text or "").encode().split())
        least[key] = min(least.get(key, r.doc_id), r.doc_id)
    sets = {d: frozenset(simhash.shingle_hashes(t, 5).tolist()) for t, d in least.items()}
    places = defaultdict(list)
    for d, s in sets.items():
        for h in s:
            places[h].append(d)
    shared: dict = defaultdict(int)
    for own in places.values():
        if len(own) <= 400:
            for i, a in enumerate(own):
                for b in own[:i]:
                    shared[min(a, b), max(a, b)] += 1
    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.5 * min(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    kept = {r.doc_id for r in simhash.keep_one(docs).select("doc_id").collect()}
    missed = [p for p in pairs if p[0] in kept and p[1] in kept]
    assert len(pairs) > 20 and len(missed) <= 0.05 * len(pairs), missed


def brute_near(rows, shingle=5, least=0.8):
    """The least id of each group of texts that are similar to another, by all pairs."""
    sets = []
    for _, t in rows:
        words = re.sub("[A-Z]+", lambda m: m[0].lower(), t or "").encode().split()
        sets.append(frozenset([b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []))
    at = list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a & b and len(a & b) >= least * len(a | b) - 1e-9):
                at[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return {min((x for x in g if x is not None), default=None) for g in groups.values()}


# decontamination -------------------------------------------------------------------------------------------------------


def brute_words(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_decontaminate(rows, items):
    wins = {}
    for item, text in items:
        w = brute_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[i : i + 10]), set()).update(() if item is None else (str(item),))
    lengths = {len(w) for w in wins}
    out = []
    for d, text in rows:
        w = brute_words(text)
        hit, names = set(), set()
        for i in range(len(w)):
            for k in lengths:
                if (own := tuple(w[i : i + k])) in wins and len(own) == k:
                    hit |= set(range(i, i + k))
                    names |= wins[own]
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [200_000, 7])
def test_decontaminate(spark, docs, empty, most, monkeypatch):
    monkeypatch.setattr(decontaminate, "WINDOWS", most)
    monkeypatch.setattr(decontaminate.matches, "__defaults__", (*decontaminate.matches.__defaults__[:-1], most))
    monkeypatch.setattr(decontaminate, "SEGMENT", 20_000)
    bench = [(1, "THREE small, words"), (2, "x a"), (3, " ".join(f"word{i % 977}x" for i in range(500, 530))), (20, "one"), (4, None), (5, "?!"), (6, "three small words"), (7, "d"), (None, "a B c d"), (None, None), (None, "two words")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    pairs = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = rows_of(decontaminate.report(docs, items).drop("n_near_items"))
    assert got == brute_decontaminate(pairs, bench)
    assert decontaminate.report(empty, items).count() == 0
    none = decontaminate.report(docs, items.where("false")).collect()
    assert len(none) == len(pairs) and not any(r.contaminated or r.n_near_items for r in none)
    kept = decontaminate.keep_clean(docs, items)
    assert kept.count() == sum(not r[-1] for r in got) and kept.columns == docs.columns


def test_decontaminate_small_tables(spark):
    docs, items = small(spark, "documents"), small(spark, "benchmark")
    got = rows_of(decontaminate.report(docs, items).drop("n_near_items"))
    want = brute_decontaminate([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert got == want and any(r[-1] for r in got)


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    near = item.replace("delta ", "delta new ").replace("iota", "iota")
    docs = spark.createDataFrame([(1, item), (2, near), (3, item.replace("delta", "other")), (4, near.replace("new", "new new new"))], "doc_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near_items) for r in decontaminate.report(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (0, 1), 3: (0, 0), 4: (0, 0)}


# packing -------------------------------------------------------------------------------------------------------------


def brute_best_fit(sizes, capacity):
    """Remaining capacities of the bins of plain best-fit decreasing."""
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits)[1]] -= s
        else:
            room.append(capacity - s)
    return sorted(room)


def test_plan_is_best_fit_decreasing():
    import random
    from collections import Counter

    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice((7, 10, 32, 100))
        sizes = [rng.randint(1, rng.choice((capacity, max(1, capacity // 3)))) for _ in range(rng.randrange(0, 120))]
        counts = Counter(sizes)
        bins, seen = {}, Counter()
        for size, first, last, start, offset in packing.plan(counts, capacity):
            for rank in range(first, last):
                seen[size, rank] += 1
                bins.setdefault(start + rank - first, []).append((offset, size))
        assert set(seen.values()) <= {1} and len(seen) == len(sizes)
        for own in bins.values():
            own.sort()
            assert [o for o, _ in own] == [sum(s for _, s in own[:i]) for i in range(len(own))]
        assert sorted(capacity - sum(s for _, s in own) for own in bins.values()) == brute_best_fit(sizes, capacity)


def check_packing(pairs, got):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_path())
    want = []
    for d, t in pairs:
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want.append((d, k, at, len(own), crc32(b"".join(x.to_bytes(4, "little") for x in own))))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(own[-1]) <= 4096
    assert len(bins) == len(brute_best_fit([w[3] for w in want], 4096))


def test_best_fit(spark, docs, empty):
    for df in (docs, empty, small(spark, "documents")):
        pairs = [tuple(r) for r in df.select("doc_id", "text").collect()]
        check_packing(pairs, packing.best_fit(df.repartition(3), tokenizer_path(), ["doc_id"]).collect())


# personal data -------------------------------------------------------------------------------------------------------


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    return sorted((m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m[0]))


def test_pii(spark, docs, empty):
    for df in (docs, small(spark, "documents")):
        got = pii.find(df).collect()
        pairs = [tuple(r) for r in df.select("doc_id", "text").collect()]
        want = []
        for d, t in pairs:
            spans = brute_spans(t)
            said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
            want.append((d, *(sum(s[3] == k for s in spans) for k in pii.PATTERNS), hashlib.sha256(said.encode()).hexdigest()))
        assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
        spans = {r.doc_id: r.spans for r in got}
        for d, t in pairs:
            assert set(f"{k}:{a}:{b}" for a, _, b, k in brute_spans(t)) <= set(spans[d].split(","))
    assert pii.find(empty).count() == 0
    added = {r.doc_id: r.spans for r in pii.find(docs).collect() if r.n_added}
    assert "iban:5:32" in added[17] and "tel:" in added[17]
    assert added[15].count("pan:") == 2


def test_redact(spark, docs):
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    found = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    for d, t in ((r.doc_id, r.text) for r in docs.collect()):
        if not found[d]:
            assert got[d] == t
            continue
        spans = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in found[d].split(",")))
        out, reach = "", 0
        for a, b, k in sorted(spans, key=lambda s: (s[0], pii.KINDS.index(s[2]))):
            if a >= reach:
                out += t[reach:a] + f"[{k.upper()}]"
            reach = max(reach, b)
        assert got[d] == out + t[reach:]


# licenses --------------------------------------------------------------------------------------------------------------


def brute_licenses(text):
    w = [x for x in re.split(license_scan.SPLIT, (text or "").lower()) if x]
    shingles = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = set()
    for name, t in license_scan.TEMPLATES:
        tw = [x for x in re.split(license_scan.SPLIT, t.lower()) if x]
        own = {tuple(tw[i : i + 5]) for i in range(len(tw) - 4)}
        n = len(tw) - 4
        if own and any(len(own & set(shingles[max(0, i - n) : i + 2 * n])) >= 0.8 * len(own) for i, s in enumerate(shingles) if s in own):
            out.add(name)
    return out


def test_licenses(spark, docs, empty):
    for df in (docs, small(spark, "documents")):
        got = {}
        for r in license_scan.scan(df, ["doc_id"]).collect():
            got.setdefault(r.doc_id, set()).add(r.license)
        for d, t in ((r.doc_id, r.text) for r in df.collect()):
            assert got.get(d, set()) == brute_licenses(t), d
    assert license_scan.scan(empty, ["doc_id"]).count() == 0
    long = " ".join(f"w{i}" for i in range(300))
    full = dict(license_scan.TEMPLATES)["mit-text"].replace("merge", "combine")
    one = spark.createDataFrame([(1, f"{long} {full} {long}")], "doc_id long, text string")
    (found,) = license_scan.scan(one, ["doc_id"]).collect()
    cut = lambda t: (w := [x.lower() for x in re.split(r"[^0-9A-Za-z\x80-\U0010ffff]+", t) if x]) and [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    own, there = set(cut(dict(license_scan.TEMPLATES)["mit-text"])), cut(f"{long} {full} {long}")
    assert (found.license, found.first_word) == ("mit-text", next(i for i, x in enumerate(there) if x in own))
    assert found.containment == pytest.approx(len(own & set(there)) / len(own), abs=1e-6) and found.n_windows >= 1
    with pytest.raises(ValueError, match="under 5 words: short"):
        license_scan.scan(one, ["doc_id"], given=(("short", "three words here"),))
    assert license_scan.scan(one, ["doc_id"], given=()).count() == 0


# quality and language model ------------------------------------------------------------------------------------------


def test_quality(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(table, labels).collect()}
    assert all(r.held_out == (crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    held = [(r.quality, got[r.doc_id].score) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = ([s for q, s in held if q == k] for k in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9 and sum(s >= 0.3 for s in good) >= 0.95 * len(good)
    odd = spark.createDataFrame([(0, 1), (0, None), (None, 0), (4, 0), (4, 1), (9, 1)], "doc_id long, quality int")
    assert quality.classify(docs, odd).count() == docs.count()
    none = quality.classify(docs, odd.where("false"))
    assert none.count() == docs.count()
    assert quality.classify(empty, odd).count() == 0
    assert quality.keep_good(docs, odd).columns == docs.columns


def test_quality_learns_one_row_of_an_id(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(quality, "fit", lambda rows, labels: sizes.append((len(rows), len(labels))))
    docs = spark.createDataFrame([(4, f"text {i % 3}") for i in range(50)] + [(9, "other"), (9, None)], "doc_id long, text string")
    quality.train(docs, spark.createDataFrame([(4, 1), (9, 0), (9, 0)], "doc_id long, quality int"))
    assert sizes == [(sum(crc32(str(d).encode()) % 5 != 0 for d in (4, 9)),) * 2]


def test_quality_pairs_identity():
    import numpy as np

    rng = np.random.default_rng(0)
    model = {"b": 0.3, "w": rng.standard_normal(quality.SIZE), "v": rng.standard_normal((quality.SIZE, quality.RANK)), "mean": np.zeros(quality.STATS), "spread": np.ones(quality.STATS)}
    cols, x = np.array([1, 5, 9]), np.array([0.5, -1.0, 2.0])
    pairs = sum(model["v"][cols[i]] @ model["v"][cols[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    got = quality.raw_score(model, np.zeros(3, int), cols, x, 1)[0]
    assert got == pytest.approx(0.3 + model["w"][cols] @ x + pairs)


def test_lm_score(spark, docs, empty):
    import numpy as np

    got = {r.doc_id: r for r in lm_score.lm_score(docs).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i].n_tokens == len(brute_words(t))
        assert (got[i].pll_mean is None) == (not brute_words(t)) and got[i].pll <= 0
    assert lm_score.lm_score(empty).count() == 0
    # each token's probabilities are normalised, and the sum over a document is what its tokens give one by one
    kind, inside = lm_score.vocabulary(lm_score.corpus_counts(docs))
    shares = np.bincount(kind, weights=np.exp(inside))
    assert np.allclose(np.delete(shares, lm_score.CLASSES), 1, atol=1e-4) and shares[lm_score.CLASSES] == 0  # no word is the boundary mark
    net = lm_score._Net(lm_score.train(docs, kind, lm_score.initial_weights()))
    words = lm_score._words(TEXTS[8].encode())
    line = [lm_score.CLASSES] * 2 + kind[words].tolist() + [lm_score.CLASSES] * 2
    total = 0.0
    for i, w in enumerate(words):
        h = np.tanh(sum(net.inside[k][line[i + 2 + o]] for k, o in enumerate(lm_score.OFFSETS)))
        logits = h @ net.out + net.bias
        p = np.exp(logits) / np.exp(logits).sum()
        assert p.sum() == pytest.approx(1, abs=1e-5)
        total += np.log(p[net.class_of[kind[w]]]) + inside[w]
        for c, _, member in net.shared(kind[[w]]):
            own = h @ net.words[0][c] + net.words[1][c]
            total += own[member[0]] - np.log(np.exp(own).sum())
    assert total == pytest.approx(got[8].pll, abs=0.02)


def test_lm_score_learns(spark):
    lines = ["the cat sat on the mat and the dog lay on the rug"] * 4000
    docs = spark.createDataFrame(list(enumerate([*lines, "mat rug the the on on sat lay dog cat and the"])), "doc_id long, text string")
    got = {r.doc_id: r.pll_mean for r in lm_score.lm_score(docs, passes=4).collect()}
    assert got[0] > got[4000] + 0.5


def test_lm_score_beats_the_unigram_on_held_out_documents(spark):
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").dropDuplicates(["text"])
    seen, held = docs.where("doc_id % 10 <> 0"), [r.text.encode() for r in docs.where("doc_id % 10 = 0").collect()]
    counts = lm_score.corpus_counts(seen)
    kind, _ = lm_score.vocabulary(counts)
    n = np.zeros(lm_score.BUCKETS)
    for r in counts.collect():
        n[r.bucket] = r.n
    share = np.bincount(kind, weights=n + 0.5)
    classes, at, _ = lm_score._stream(held, kind)
    unigram = np.log(share / share.sum())[classes[at]].mean()
    for shard in (1 << 21, 1 << 14):  # one shard and some twenty
        net = lm_score._Net(lm_score.train(seen, kind, lm_score.initial_weights(), shard=shard, passes=4))
        got = np.concatenate([net.log_probs(classes, at[i : i + 4096]) for i in range(0, len(at), 4096)]).mean()
        assert got > unigram + 0.02, shard


def test_lm_score_does_not_depend_on_the_partitions(spark):
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    kind, _ = lm_score.vocabulary(lm_score.corpus_counts(docs))
    nets = [lm_score.train(docs.repartition(parts), kind, lm_score.initial_weights(), shard=16384, passes=1) for parts in (1, 4, 32)]
    assert np.array_equal(nets[0], nets[1]) and np.array_equal(nets[0], nets[2])
    # repeated rows are learnt once, wherever they lie
    thrice = docs.union(docs).union(docs)
    again = [lm_score.lm_score(thrice.repartition(parts)).groupBy("doc_id").agg(F.min("pll").alias("a"), F.max("pll").alias("b"), F.count("*").alias("n")).collect() for parts in (1, 7)]
    one, seven = ({r.doc_id: r for r in rows} for rows in again)
    assert len(one) == docs.count() and all(r.n == 3 and r.b == pytest.approx(r.a, abs=5e-4) and seven[k].a == pytest.approx(r.a, abs=5e-4) for k, r in one.items())
    got = [{r.doc_id: r.pll for r in lm_score.score(docs.repartition(parts), nets[0], *lm_score.vocabulary(lm_score.corpus_counts(docs))).collect()} for parts in (1, 4, 32)]
    assert all(g[k] == pytest.approx(got[0][k], abs=5e-4) for g in got for k in got[0])


def test_lm_score_training_is_the_plain_loop(spark):
    """Shards, rounds and averages against a loop over a list."""
    import numpy as np

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    n = lm_score.tally(lm_score.corpus_counts(docs))
    kind, _ = lm_score.vocabulary(n)
    got = lm_score.train(docs.repartition(5), kind, lm_score.initial_weights(), n=n, shard=20_000, passes=2)
    shards = max(1, -(-int(n.sum()) // 20_000))
    rows = sorted((r.deal, r.text) for r in docs.select(F.xxhash64("doc_id", "text").alias("deal"), "text").collect())
    flat, squares = lm_score.from_frequencies(lm_score.initial_weights(), kind, n), None
    for turn in range(2 * lm_score.ROUNDS):
        total, seen = 0, 0
        for shard in range(shards):
            units = [kind[lm_score._words(t.encode())] for d, t in rows if d % shards == shard and (d >> 33) % lm_score.ROUNDS == turn % lm_score.ROUNDS]
            net = lm_score._Net(flat, squares)
            for i in range(0, len(units), 256):
                line, at = lm_score._joined(units[i : i + 256])
                at = np.random.default_rng(len(at)).permutation(at)
                for j in range(0, len(at), lm_score.BATCH):
                    net.learn(line, at[j : j + lm_score.BATCH])
            total = total + np.rint(np.stack([net.flat, net.squares]).astype(np.float64) / lm_score.GRAIN) * net.seen
            seen += net.seen
        if seen:
            flat, squares = (total * lm_score.GRAIN / seen).astype(np.float32)
    assert np.allclose(got, np.round(flat, 5), atol=2e-5)


def test_lm_score_tells_rare_words_of_a_class_by_their_neighbours(spark):
    import random

    rng = random.Random(3)
    left, right = [f"left{i}" for i in range(200)], [f"right{i}" for i in range(200)]
    texts = [" ".join(w for _ in range(30) for i in [rng.randrange(200)] for w in ("a", left[i % 2 * 100 + i // 2], f"mid{i % 2}", right[i])) for _ in range(2500)]
    n = np_counts(texts)
    kind, _ = lm_score.vocabulary(n)
    words = lm_score._words(" ".join(left + right).encode())
    assert len(set(kind[words].tolist())) > 250  # units of their own, not 40 classes
    # mid0 or mid1 tells which half the word on its left is from: the swapped texts have the same words in the wrong halves
    swapped = [t.replace("mid0", "midx").replace("mid1", "mid0").replace("midx", "mid1") for t in texts[:200]]
    docs = spark.createDataFrame(list(enumerate(texts + swapped)), "doc_id long, text string")
    got = {r.doc_id: r.pll_mean for r in lm_score.lm_score(docs, passes=4).collect()}
    assert sum(got[i] > got[2500 + i] + 0.1 for i in range(200)) > 190


def np_counts(texts):
    import numpy as np

    return np.bincount(np.concatenate([lm_score._words(t.encode()) for t in texts]), minlength=lm_score.BUCKETS).astype(float)


# media -------------------------------------------------------------------------------------------------------------


def test_media(spark, docs, empty):
    for df in (docs, small(spark, "documents")):
        got = {r.doc_id: r for r in media.stored_texts(df).collect()}
        for d, t in ((r.doc_id, r.text) for r in df.collect()):
            raw = (t or "").encode()
            payload = raw + b" " * (-len(raw) % 192 if raw else 192)
            r = got[d]
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-16:]))
    assert media.stored_texts(empty).count() == 0
    videos = media.to_avi(docs)
    assert videos.where("video is null").count() == 0 and media.clips(videos, "doc_id", "video").count() >= docs.count()


def test_avi_round_trip_of_any_bytes():
    import random

    rng = random.Random(0)
    payloads = [bytes(rng.choice((0, 255, rng.randrange(256))) for _ in range(192 * n)) for n in (1, 2, 63, 64, 65, 130)]
    videos = [media.write_avi(p) for p in payloads]
    assert [back for back, _ in media.analyse(videos)] == payloads
    for video in videos:
        no_index = video[: video.rfind(b"idx1")]
        assert media.read_avi(no_index)["frames"] == media.read_avi(video)["frames"]


def slow_blocks(frame):
    """Coefficients of a parsed frame, bit by bit."""
    import re

    codes = {}
    for key, (counts, symbols) in frame["huff"].items():
        code, i = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                codes[key, length, code] = symbols[i]
                code, i = code + 1, i + 1
            code *= 2
    order, out = frame["order"], []
    for piece in re.split(rb"\xff[\xd0-\xd7]", frame["data"]) if frame["restart"] else [frame["data"]]:
        bits = "".join(f"{b:08b}" for b in piece.replace(b"\xff\x00", b"\xff"))
        at, last = 0, {}

        def take(n):
            nonlocal at
            at += n
            return bits[at - n : at]

        def symbol(key):
            code = ""
            while (key, len(code), int(code or "0", 2)) not in codes or not code:
                code += take(1)
            return codes[key, len(code), int(code, 2)]

        def value(n):
            b = take(n)
            return 0 if not n else int(b, 2) if b[0] == "1" else int(b, 2) - 2**n + 1

        for _ in range(min(frame["restart"] or frame["mcus"], frame["mcus"] - len(out) // len(order))):
            for c in order:
                tables = frame["scan"][frame["parts"][c][0]]
                block = [0] * 64
                last[c] = block[0] = last.get(c, 0) + value(symbol(tables >> 4))
                k = 1
                while k < 64:
                    rs = symbol(16 | tables & 15)
                    if rs == 0:
                        break
                    k += rs >> 4
                    if rs & 15:
                        block[k] = value(rs & 15)
                    k += 1
                out.append(block)
    return out


def camera_frame(blocks, order, sampling, wide, high, restart, tables):
    """A baseline frame written by its definition: ``tables`` are left out of the file where they are the standard's."""
    import struct as st

    code_of = {}
    for key, (counts, symbols) in media.STANDARD.items():
        code, i = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                code_of[key, symbols[i]] = f"{code:0{length}b}"
                code, i = code + 1, i + 1
            code *= 2
    size = lambda v: abs(v).bit_length()
    bits_of = lambda v: f"{v if v > 0 else v + 2 ** size(v) - 1:0{size(v)}b}" if v else ""
    data, bits, last = b"", "", {}

    def flush():
        nonlocal bits
        raw = bits + "1" * (-len(bits) % 8)
        bits = ""
        return bytes(int(raw[i : i + 8], 2) for i in range(0, len(raw), 8)).replace(b"\xff", b"\xff\x00")

    for i, block in enumerate(blocks):
        mcu, c = i // len(order), order[i % len(order)]
        if restart and i % len(order) == 0 and mcu and mcu % restart == 0:
            data += flush() + bytes([0xFF, 0xD0 + (mcu // restart - 1) % 8])
            last = {}
        t = min(c, 1)
        d = block[0] - last.get(c, 0)
        last[c] = block[0]
        bits += code_of[t, size(d)] + bits_of(d)
        run = 0
        for k in range(1, 64):
            if not block[k]:
                run += 1
                continue
            while run > 15:
                bits += code_of[16 + t, 0xF0]
                run -= 16
            bits += code_of[16 + t, run * 16 + size(block[k])] + bits_of(block[k])
            run = 0
        if run:
            bits += code_of[16 + t, 0]
    data += flush()
    segment = lambda m, body: st.pack(">BBH", 0xFF, m, len(body) + 2) + body
    n = len(sampling)
    head = b"\xff\xd8" + segment(0xE0, b"AVI1") + segment(0xDB, b"\0" + bytes([3] * 64))
    head += segment(0xC0, st.pack(">BHHB", 8, high, wide, n) + b"".join(bytes([i + 1, f, 0]) for i, f in enumerate(sampling)))
    if tables:
        head += b"".join(segment(0xC4, bytes([k]) + counts + symbols) for k, (counts, symbols) in media.STANDARD.items())
    if restart:
        head += segment(0xDD, st.pack(">H", restart))
    return head + segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0x11 * min(i, 1)]) for i in range(n)) + b"\0\x3f\0") + data + b"\xff\xd9"


def as_avi(frames):
    import struct as st

    chunk = lambda name, body: name + st.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", st.pack("<14I", 100_000, *[0] * 7, 32, 32, *[0] * 4)))
    return chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", f) for f in frames)))


def test_camera_frames():
    """Frames of all samplings, with and without tables and restarts, written here, against their coefficients and a decoder that goes bit by bit."""
    import random

    import numpy as np

    rng = random.Random(4)
    frames, want = [], []
    for sampling, order, across, down in (((0x22, 0x11, 0x11), [0, 0, 0, 0, 1, 2], 16, 16), ((0x21, 0x11, 0x11), [0, 0, 1, 2], 16, 8), ((0x11, 0x11, 0x11), [0, 1, 2], 8, 8), ((0x11,), [0], 8, 8), ((0x22,), [0], 8, 8)):
        for restart in (0, 1, 3):
            for tables in (False, True):
                wide, high = rng.randrange(17, 50), rng.randrange(9, 40)
                mcus = -(-wide // across) * -(-high // down)
                blocks = [[rng.randrange(-900, 900) if not k else rng.choice((0, 0, 0, 0, 1, -1, rng.randrange(-500, 500))) if rng.random() < 0.6 else 0 for k in range(64)] for _ in range(mcus * len(order))]
                frames.append(camera_frame(blocks, order, sampling, wide, high, restart, tables))
                want.append(blocks)
    got = media.decode_frames(frames)
    for f, (c, samples), w in zip(frames, got, want, strict=True):
        assert np.array_equal(c, w) and slow_blocks(media._parse(f)) == w
        first = np.array([b for b, o in zip(w, media._parse(f)["order"] * len(w), strict=False) if o == 0])
        assert np.array_equal(samples, np.clip(np.rint((first * 3).astype(np.float32) @ media.IDCT + 128), 0, 255))
    payload = bytes(rng.randrange(256) for _ in range(192 * 5))
    own = media._parse(media.read_avi(media.write_avi(payload))["frames"][0])
    assert np.array_equal(media.decode_coefficients([own])[0], slow_blocks(own))
    # the inverse transform against its definition
    c = np.zeros((1, 64))
    c[0, 1] = 100
    each = np.array([[100 * 0.25 * (1 / np.sqrt(2)) * np.cos((2 * x + 1) * np.pi / 16) for x in range(8)] for _ in range(8)])
    assert np.allclose((c @ media.IDCT).reshape(8, 8), each, atol=1e-4)
    assert media.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


def test_clips_and_what_cannot_be_read(spark):
    dark, light = ([[v] + [0] * 63] * 6 for v in (-300, 300))
    shot = [camera_frame(dark, [0, 0, 0, 0, 1, 2], (0x22, 0x11, 0x11), 16, 16, 0, False)] * 4 + [camera_frame(light, [0, 0, 0, 0, 1, 2], (0x22, 0x11, 0x11), 16, 16, 0, False)] * 3
    cut = shot[0][:-4]
    progressive = shot[0].replace(b"\xff\xc0", b"\xff\xc2")
    rows = [(1, as_avi(shot)), (2, b"no video"), (3, None), (4, as_avi([cut])), (5, as_avi([progressive])), (6, as_avi([])), (1, as_avi(shot))]
    got = media.clips(spark.createDataFrame(rows, "id long, video binary"), "id", "video").collect()
    film = [(r.clip, r.first_frame, round(r.begin_s, 3), round(r.end_s, 3)) for r in got if r.id == 1]
    assert film == [(0, 0, 0.0, 0.4), (1, 4, 0.4, 0.7)] * 2
    assert sorted((r.id, r.clip) for r in got if r.error) == [(2, None), (4, None), (5, None)]
    assert not any(r.id in (3, 6) for r in got)


def test_shots():
    import numpy as np

    a, b = np.eye(32)[3], np.eye(32)[20]
    assert media.shots([a] * 10 + [b] * 10 + [a] * 5) == [0, 10, 20]
    assert media.shots([]) == [] and media.shots([a]) == [0]


def test_every_query_is_registered():
    assert [k.split("_")[0] for k in queries()] == [f"op{i}" for i in range(1, 14)]


def test_lm_score_cuts_a_text_into_words_once(spark, monkeypatch):
    """Counting, learning and scoring read the same hashed words, null and empty texts included."""
    made, own = [], lm_score.hashed
    monkeypatch.setattr(lm_score, "hashed", lambda *args: made.append(args) or own(*args))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", " . ", *["one two three two one"] * 5])], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.lm_score(docs).collect()}
    assert len(made) == 1 and [got[i].n_tokens for i in range(8)] == [0, 0, 0] + [5] * 5 and got[0].pll_mean is None
    words = {r.id: np.frombuffer(r.words, "<u4") for r in own(docs, "doc_id", "text").collect()}
    assert all(np.array_equal(words[r.doc_id], lm_score._words(r.text and r.text.encode())) for r in docs.collect())
