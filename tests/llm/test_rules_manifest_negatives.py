"""Line rules, Merkle manifests and hard negatives against brute force, on hard cases and on the smallest tables."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest

from sparquill.llm import hard_negatives, line_rules, merkle
from sparquill.llm.queries import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_line_rules", "op12_merkle", "op13_hard_negatives"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(oracle_sql()[name])
    got = queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


# line rules ----------------------------------------------------------------------------------------------------------

PROSE = "The first line of a plain text ends here. It goes on with some more words, and ends.\nA second line is like it, but other in all its words!\n"
TEXTS = [
    None, "", " \t\n\v\f\r ", "too short.", PROSE, PROSE + PROSE, PROSE * 50, "one two three four five six seven eight nine ten eleven", "Home | News | Contact | Login | Help\n" + PROSE,
    "a b c d e f a b c d e g h i j k.", "x# y$ z% w& " * 30, "All rights reserved.\nSkip to content\n" + PROSE, "word word word word word word word word word word word word.", "a\x00b c\x1cd e\x85f ü日 本 語。 eins zwei drei vier fünf sechs sieben.",
    " ".join(f"w{i % 5000}" for i in range(60_000)) + ".", "line one is equal here.\nline one is equal here. \nline one is equal here.\r\nline one is equal here.", "menu\n\nhome\n" + "Ein Satz „mit“ Zeichen… und (noch) einer.\n" * 1 + PROSE,
]


def brute_line_rules(text):
    text = text or ""
    split = lambda x: re.findall(r"[^\x20\x09-\x0D]+", x)
    words = split(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if split(x)]
    base = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    lost = removed = 0
    for i, x in enumerate(lines):
        w, symbols, low = split(x), len(re.findall(r"[#*$%&|<>]", x)), re.sub("[A-Z]", lambda m: m[0].lower(), x)
        alone = sum(a in line_rules.SEPARATORS for a in w)
        if x in lines[:i] or symbols >= 2 and 4 * symbols > len(w) or alone >= 3 and 4 * alone >= len(w) or len(w) < 8 and all(a in line_rules.MENU for a in split(low)) or (
            len(w) >= 8 and not any(re.search("[.!?…。！？][\"')\\]’”»]*$", a) for a in w)) or len(w) <= 30 and any(p in low for p in line_rules.PHRASES) or len(w) > 1 and 3 * sum(a == b for a, b in zip(w, w[1:])) >= len(w):
            removed += 1
            lost += sum(map(len, w))
    chars = sum(map(len, words))
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), base, not base and 100 * lost <= 30 * chars, len(lines), removed, lost)


def test_line_rules(spark):
    schema = "n_words string, doc_id long, text string, cleaned string"
    docs = spark.createDataFrame([("x", i, t, None) for i, t in enumerate(TEXTS)] + [(None, None, TEXTS[4], "c"), ("y", 4, TEXTS[4], None)], schema)
    got = sorted((tuple(r) for r in line_rules.report(docs).collect()), key=repr)
    want = [(i, *brute_line_rules(t)) for i, t in enumerate(TEXTS)] + [(None, *brute_line_rules(TEXTS[4])), (4, *brute_line_rules(TEXTS[4]))]
    assert got == sorted(want, key=repr)
    assert line_rules.report(docs.where("false")).collect() == []
    kept = line_rules.keep_clean(docs)
    assert kept.columns == docs.columns
    by_id = {r.doc_id: r.text for r in kept.collect()}
    assert set(by_id) == {w[0] for w in want if w[7]} and by_id[8] == PROSE and by_id[11] == PROSE
    with pytest.raises(ValueError):
        line_rules.judge(docs, ["n_words"])


def test_repeated_words_of_any_alphabet():
    rng = random.Random(1)
    for _ in range(200):
        words = [b"%d" % rng.randrange(rng.choice((2, 5, 40))) for _ in range(rng.randrange(60))]
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        assert line_rules.repeated_words(words) == len({i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)})
    many = [b"%d" % i for i in range(9000)]  # numbers of runs no longer fit at once
    assert line_rules.repeated_words(many + many[100:200]) == 200 and line_rules.repeated_words(many) == 0


# Merkle manifest -----------------------------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row, low=False):
    doc_id, source, lang, n_chars, text = row
    if low and text is not None:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """Digests of each level, from the leaves to the one that remains."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def steps(tree, at):
    for level in tree[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        yield at % 16, run[: at % 16] + run[at % 16 + 1 :]
        at //= 16


def brute_manifest(rows):
    null_first = lambda v: (v is not None, v if v is not None else 0)
    names = sorted({r[1] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    own = {n: sorted((r for r in rows if r[1] == n), key=lambda r: (null_first(r[0]), brute_leaf(r))) for n in names}
    trees = {n: climb([brute_leaf(r) for r in own[n]]) for n in names}
    top = climb([trees[n][-1][0] for n in names])
    out = []
    for i, n in enumerate(names):
        for at, r in enumerate(own[n]):
            way = [*steps(trees[n], at), *steps(top, i)]
            fold = brute_leaf(r, r[0] is not None and crc32(str(r[0]).encode()) % 5 == 0)
            for k, others in way:
                fold = digest(*others[:k], fold, *others[k:])
            out.append((r[0], brute_leaf(r), trees[n][-1][0], top[-1][0], digest(*(x for _, o in way for x in o)), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_manifest(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "hot", "hot", "hot", "Ä", "", None, "z"]), rng.choice(["en", None]), i * 3 if i % 7 else None, rng.choice([None, "", "Plain Text", "Ünï CODE 日本" * 9])) for i in range(700)]
    rows += [(None, "a", None, None, None), (None, None, None, None, None), (5, "one leaf", "en", 1, "X"), *rows[:40], *rows[:40], *[(9, "copies", "en", 4, "Same")] * 33, (9, "copies", "en", 4, "Other"), (1 << 60, "long", "en", -1, "Word " * 60_000)]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    docs = spark.createDataFrame(rows, schema).repartition(7)
    extra = docs.selectExpr("*", "1 AS tree", "2 AS pos", "'p' AS payload", "'h' AS hash", "3 AS size", "4 AS id", "5 AS salt")
    want = brute_manifest(rows)
    assert rows_of(merkle.manifest(extra)) == want
    assert sum(w[-1] for w in want) < len(want)
    single = [r for r in rows if r[1] == "one leaf"]
    assert rows_of(merkle.manifest(docs.where("source = 'one leaf'"))) == brute_manifest(single)
    assert merkle.manifest(docs.where("false")).collect() == []


def test_manifest_of_many_sources(spark):
    rows = [(i, f"s{i % 300}", None, i, f"Text {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert rows_of(merkle.manifest(docs)) == brute_manifest(rows)


def test_store_is_kept_by_level(spark, tmp_path):
    rows = [(i, "s", None, i, "t") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    made = merkle.build(docs, str(tmp_path / "store"), ["doc_id", "text"])
    assert [level.count() for level in made.above] == [19, 2, 1] and not made.over
    assert [spark.read.parquet(f"{made.folder}/level={k}").count() for k in (1, 2, 3)] == [19, 2, 1]
    proof = merkle.proofs(made).where("id = 299").first()
    assert [(s["at"], len(s["others"]) // 64) for s in proof.path] == [(11, 11), (2, 2), (1, 1)] and made.root == proof.subroot


# hard negatives ------------------------------------------------------------------------------------------------------


def brute_negatives(rows):
    known = []
    for i, (vec_id, label, v) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        changed = int(math.fmod(label + 1, 10)) if vec_id is not None and vec_id % 7 == 0 else label
        known.append((i, vec_id, changed, [math.floor(256.0 * float(np.float32(x))) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    key = lambda c: (-c[0], c[1] is None, c[1] if c[1] is not None else 0)
    out = []
    for i, a, label, v in known:
        if a is None or a % 100:
            continue
        scored = [(dot(v, w), b, o, j) for j, b, o, w in known if j != i]
        for p in sorted((c for c in scored if c[2] == label), key=key)[:5]:
            fits = [c for c in scored if c[2] != label and 30 * p[0] <= 100 * c[0] <= 90 * p[0]]
            out += [(a, p[1], k + 1, c[1], p[0], c[0]) for k, c in enumerate(sorted(fits, key=key)[:10])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard, block", [(4096, 4096), (37, 2)])
def test_hard_negatives(spark, monkeypatch, shard, block):
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rng = random.Random(3)
    vector = lambda: [rng.gauss(0.1, 0.3) for _ in range(6)]
    common = vector()
    rows = [(i, rng.randrange(4), common if rng.random() < 0.3 else vector()) for i in range(1, 601)]
    rows += [(100, 1, None), (200, None, vector()), (300, 2, [0.1, None, 0.2]), (400, 2, [math.nan] * 6), (500, 2, [math.inf] + [0.0] * 5), (None, 1, vector()), (None, 2, common), (700, 3, []), (100, 2, [0.5, 0.25]),
             (-100, 0, vector()), (-7, 0, common), (200, 2, common), (200, 2, common), (1400, -5, [0.3] * 6), (2100, 9, [0.0] * 6), (3000, 77, vector())]
    data = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 AS row", "2 AS shard", "3 AS block", "4 AS all", "5 AS v", "6 AS along")
    got = hard_negatives.mine(data.repartition(5))
    assert rows_of(got) == brute_negatives(rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert hard_negatives.mine(data.where("false")).collect() == [] and hard_negatives.mine(data.where("vec_id BETWEEN 1 AND 50")).collect() == []


def test_balls_hold_their_rows_and_prune():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 400, (12, 8))
    x = np.floor(np.concatenate([c + rng.normal(0, 9, (400, 8)) for c in centres]))
    tree = hard_negatives.BallTree(x, np.zeros(len(x), np.int64), leaf=32)
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    for centre, radius, a, b, *_ in tree.nodes:
        assert (np.sqrt(((tree.x[a:b] - centre) ** 2).sum(axis=1)) <= radius + 1e-6).all()
    looked = []
    real = hard_negatives.products
    hard_negatives.products = lambda q, v: looked.append(len(v)) or real(q, v)
    try:
        q = np.floor(centres[:1])
        far = (q @ x.T).ravel().max()
        query, row, score = hard_negatives.search(tree, np.arange(len(x)), q, np.array([0]), np.array([1]), np.array([-1]), np.array([0]), np.array([int(far * 0.9)]), 10, False)
    finally:
        hard_negatives.products = real
    want = sorted((s for s in (q @ tree.x.T).ravel().astype(int).tolist() if 0 <= s <= int(far * 0.9)), reverse=True)[:10]
    assert score.tolist() == want and sum(looked) < len(x) / 3
    with pytest.raises(ValueError):
        hard_negatives.products(np.array([[1e30]]), np.array([[1e30]]))
