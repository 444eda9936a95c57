"""Page operators and the pipeline against brute force."""

import random
import re

import corpus_pipeline
from sparquill.llm import html_extract, url_filter
from sparquill.llm.queries import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


def text_of(page):
    return "\n".join(b for b, kind in html_extract.blocks(page) if kind)


def core(page):
    return "\n".join(b for b, kind in html_extract.blocks(page) if kind == html_extract.CORE)


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="sidebar-left">
    <header><a href=x>Site</a></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">Cookies</div><!-- no <p>no</p> -->
    <article><header><h1>A &amp; B</h1></header><p>One  two<br>three <b>bold</b>text &eacute;&#233;<p>Next&nbsp;&lt;i&gt;<div class="ad">Ad</div>
    <ul><li>x<li>y</ul><form><p>field</p></form><aside>side</aside><table><tr><td>a<td>b</table><section id="comments"><article><p>Reply</p></article></section><p>last</article>
    <footer><p>&copy; foot</p></footer></body></html>"""
    assert core(page) == "A & B\nOne two three boldtext éé\nNext <i>\nx\ny\na\nb\nlast"
    assert core("<article><p>cut in the mid") == "cut in the mid" and core("<article><p>cut <b cla") == "cut"
    assert core("<ARTICLE CLASS='story'>A</ARTICLE>") == "A" and core("<div role=main><p>m</div><p>n") == "m"
    assert [text_of(x) for x in (None, "", " \n", "a < b", "<>", "<p></p>")] == ["", "", "", "a < b", "<>", ""]
    assert core('<div class="has-sidebar"><article class="post no-comments"><header class="entry-header"><h1 class="banner">T</h1></header><div class="comments">no</div><p>x</article></div>') == "T\nx"
    assert core("<article>" + '<a "' * 20_000) == "" and core("<article>x" + "</b>" * 50_000 + "<i>" * 50_000 + "y") == "xy"
    assert core("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"


def test_driver_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r.page_id: r.text for r in queries()["op5_html_extract"](spark, SMALL).collect()}
    import html

    for p in pages:  # these pages have one article of flat markup
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", p.html, re.S)
        parts = re.split(r"</?(?:h1|p|ul|li|div)\b[^>]*>", inner[1]) if inner else []
        want = [" ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", lambda m: " " if m[0].startswith("<br") else "", x)).split()) for x in parts]
        assert got[p.page_id] == "\n\n".join(x for x in want if x)


def test_shards_count_every_substring():
    """Names and numbers of pages, over several hosts and with several runs a page, as sets of substrings have them."""
    rng = random.Random(7)
    for length in (4, 8):
        for _ in range(20):
            boiler = [rng.choice("abc") for _ in range(15)]
            pages = []
            for _ in range(rng.randrange(0, 7)):
                runs = [[rng.choice("abcdefgh") for _ in range(rng.randrange(0, 30))] + boiler * rng.randrange(2) for _ in range(rng.randrange(0, 3))]
                pages.append((rng.randrange(-2, 2), runs))
            seen = {}
            for i, (host, runs) in enumerate(pages):
                for r in runs:
                    for j in range(len(r) - length + 1):
                        seen.setdefault((host, *r[j : j + length]), set()).add(i)
            name, n = html_extract.shard([(h, html_extract.encoded(r)) for h, r in pages], length)
            assert len(set(name.tolist())) == len(name) and sorted(n.tolist()) == sorted(map(len, seen.values()))


def brute_texts(pages, least=3):
    """Texts of (url, html) pages from the rule, by sets of substrings."""
    hosts = {}
    for url, page in pages:
        parts = html_extract.blocks(page)
        hosts.setdefault((url or "").split("://")[-1].split("/")[0], {})["\n".join(b for b, _ in parts)] = parts
    repeats = {}
    for host, own in hosts.items():
        seen = {}
        for key, parts in own.items():
            for s in html_extract.streams_of(parts):
                for j in range(len(s) - 7):
                    seen.setdefault(tuple(s[j : j + 8]), set()).add(key)
        repeats[host] = {w for w, keys in seen.items() if len(keys) >= least}
    out = []
    for url, page in pages:
        parts, known = html_extract.blocks(page), repeats[(url or "").split("://")[-1].split("/")[0]]
        if any(k == html_extract.CORE for _, k in parts):
            out.append("\n\n".join(b for b, k in parts if k == html_extract.CORE))
            continue
        runs = [[]]
        for b, k in parts:
            runs[-1].append((b.split(), b, k)) if len(b.split()) <= 50 else runs.extend(([(b.split(), b, k)], []))
        keep = []
        for run in runs:
            tokens = [t for own, _, _ in run for t in own]
            hit = {j + i for j in range(len(tokens) - 7) if len(run[0][0]) <= 50 and tuple(tokens[j : j + 8]) in known for i in range(8)}
            at = 0
            for own, b, k in run:
                if k == html_extract.OPEN and not set(range(at, at + len(own))) <= hit:
                    keep.append(b)
                at += len(own)
        out.append("\n\n".join(keep))
    return out


def test_unmarked_pages_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda k=60: f"w{rng.randrange(k)}"
    boiler = [" ".join(word() for _ in range(rng.randrange(2, 14))) for _ in range(12)]
    pages = []
    for i in range(260):
        host = rng.choice(["big.example"] * 6 + ["a.example", "b.example"])
        parts = []
        for _ in range(rng.randrange(0, 12)):
            text = rng.choice(boiler) if rng.random() < 0.6 else " ".join(word(2000) for _ in range(rng.choice((1, 5, 20, 49, 50, 51, 80))))
            parts.append(rng.choice(("<p>{}</p>", "<div>{}</div>", "<div class=ad>{}</div>", "<footer>{}</footer>", "<p><b>{}</b></p>")).format(text))
        page = "".join(parts)
        pages.append((f"http://{host}/{i}", f"<article>{page}</article>" if rng.random() < 0.1 else page))
    pages += pages[:20] + [("http://big.example/copy", p) for _, p in pages[20:40]]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    want = brute_texts(pages)
    assert sum(len(w) for w in want) < sum(len(" ".join(b for b, k in html_extract.blocks(p) if k)) for _, p in pages)
    for parts in (1, 7):
        assert {r.page_id: r.text for r in html_extract.extract(df.repartition(parts)).collect()} == dict(enumerate(want)), parts


def test_a_host_of_any_size_gives_the_same_text(spark):
    menu = " ".join(f"menu{i}" for i in range(12))
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    for size, unmarked in ((5, 5), (5000, 5000), (5000, 20)):  # in the last, most pages mark their text
        page = lambda i, n=unmarked: f"<body><p>{menu}</p><p>{own(i)}</p></body>" if i < n else f"<article>{own(i)}</article>"
        df = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(size)], "page_id long, url string, html string").repartition(9)
        assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == {i: own(i) for i in range(size)}


def test_unmarked_pages_lose_what_hosts_repeat(spark):
    menu = "<div><p>" + " ".join(f"menu{i}" for i in range(12)) + "</p></div>"
    rows = [(i, "http://h.example/" + str(i), f"<body>{menu}<div><p>{' '.join(f'w{i}x{j}' for j in range(20))}</p></div></body>") for i in range(5)]
    rows += [(10, "http://other.example/", f"<body>{menu}</body>"), (11, None, None), (12, "u", ""), (None, None, "<article>x</article>"), (0, rows[0][1], "<main>é</main>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df).collect()), key=repr)
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    want = [(i, own(i), len(own(i))) for i in range(5)] + [(10, " ".join(f"menu{i}" for i in range(12)), 77 - 1), (11, "", 0), (12, "", 0), (None, "x", 1), (0, "é", 1)]
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in sorted(want, key=repr)] and all(n == len(t) for _, t, n in got)
    assert html_extract.extract(df.where("false")).count() == 0


def test_copies_and_long_quotes_keep_their_text(spark):
    text = lambda k, n: " ".join(f"{k}x{j}" for j in range(n))
    rows = [(i, f"http://h.example/{i}", f"<body><p>{text('copy', 30)}</p></body>") for i in range(3)]
    rows += [(i, f"http://h.example/{i}", f"<body><p>{text('quote', 60)}</p><p>{text(f'w{i}', 20)}</p></body>") for i in range(10, 13)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: text("copy", 30) for i in range(3)} | {i: text("quote", 60) + "\n\n" + text(f"w{i}", 20) for i in range(10, 13)}
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == want


def brute_url(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = []
    for rule, verdict in url_filter.RULES:
        site, start = rule.split("/", 1)
        if (host == site or host.endswith("." + site)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    hit = lambda t: re.search(rf"(?<![^\W_]){re.escape(t)}(?![^\W_])", url.lower())
    strict, soft = sum(bool(hit(t)) for t in url_filter.STRICT), sum(w for t, w in url_filter.SOFT.items() if hit(t))
    rule = max(fits, default=(0, None, "block" if strict or soft >= url_filter.LIMIT else "allow"))
    return host, path, rule[1], rule[2], strict, soft


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "://x", "HTTP://EXAMPLE.Net/en/A?q", "http://net", "http://net/", "http://net?x", "http://a.net#f", "http://example.net/en", "http://a.example.com/de/x", "http://example.com/fr/", "http://b.org/fr/é", "https://free-bets.example.org/x", "http://freebets.org/", "http://x.org/free_win", "http://x.org/free/free", "http://casino.org", "http://mycasino.org", "http://x.com/" + "a" * 5000 + "/xxx", "http://org/fr/://"]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(1, "", "r")], "page_id long, url string, rule string")
    got = sorted((tuple(r) for r in url_filter.url_filter(df, ["page_id"]).collect()), key=repr)
    assert got == sorted([(i, *brute_url(u)) for i, u in enumerate(urls)] + [(1, *brute_url(""))], key=repr)
    assert url_filter.url_filter(df.where("false"), ["page_id"]).count() == 0


def test_weight_and_not_number_decides(spark):
    """Three light terms pass, a heavy one beside a light one does not, and no soft term rejects alone, however often it occurs."""
    urls = {"http://a.org/free/sale/trial": "allow", "http://a.org/naked-free": "block", "http://a.org/poker/sex": "block", "http://a.org/naked/naked/naked": "allow", "http://a.org/freedom/nakedly-sale": "allow", "http://a.org/casino": "block"}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    assert [r.verdict for r in url_filter.url_filter(df, ["page_id"]).orderBy("page_id").collect()] == list(urls.values())
    assert max(url_filter.SOFT.values()) < url_filter.LIMIT


def test_url_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    df = queries()["op3_url_filter"](spark, SMALL)
    want = con.sql(oracle_sql()["op3_url_filter"])
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def test_pipeline(spark):
    from test_documents import brute_decontaminate, brute_near, check_packing

    from sparquill.llm import pii, quality

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    heads = brute_near(rows)
    rows = [r for r in rows if r[0] in heads]
    dirty = {r[0] for r in brute_decontaminate(rows, bench) if r[-1]}
    kept = [r[0] for r in rows if r[0] not in dirty]
    assert 0 < len(kept) < len(heads) < len(good) < docs.count()
    masked = pii.redact(docs.where(docs.doc_id.isin(kept)))
    pairs = [(r.doc_id, r.text) for r in masked.collect()]
    assert sorted(d for d, _ in pairs) == sorted(kept)
    check_packing(pairs, corpus_pipeline.run(spark, SMALL).collect())


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.where("false"), SMALL).count() == 0
