import random
import re
from itertools import combinations

from gridweave.llm import urls
from gridweave.llm.queries import QUERIES


def slow(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, None
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = (0, None, None)
    for verdict, rule in urls.GIVEN_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = max(best, (len(rule), rule, verdict))
    return host, path, best[1], best[2]


def test_query_against_brute_force(spark, sf_dir):
    got = QUERIES["op6_url_rules"](spark, sf_dir).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        host, path, rule, verdict = slow(pages[r.page_id])
        # fewer labelled URLs than a rule needs: the method allows
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or "allow")


ODD = [None, "", "no scheme", "http://", "://x", "HTTP://WWW.Éxample.COM/en/1", "http://a.example.com/en/70?x#y", "http://example.com?en/7", "http://xcom/en/", "http://com/en/", "ftp://q.net/de/8#://z", "http://example.net/de/8", "http://b.org/es/" + "z" * 50_000]


def test_edge_cases(spark):
    rows = [(i, u, "x") for i, u in enumerate(ODD)] + [(None, ODD[5], "x"), (3, ODD[6], "x"), (3, ODD[6], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    none = urls.mine(spark.createDataFrame([], "url string, bad int"))
    got = urls.judge(pages, none).collect()
    assert len(got) == len(rows)
    want = {(i, *slow(u)[:3], slow(u)[3] or "allow") for i, u, _ in rows}
    assert {tuple(r) for r in got} == want
    assert urls.judge(pages.limit(0), none).count() == 0


def slow_rules(tokens, rows, support, confidence, least):
    """Rules of one to three tokens by counting, of tokens that stand for those in the same URLs."""
    where = {}
    for n, (u, b) in enumerate(rows):
        for t in tokens[u]:
            where.setdefault(t, set()).add(n)
    enough = max(support * len(rows), least)
    bad = {n for n, (_, b) in enumerate(rows) if b}
    firsts = {}
    for t in sorted(where):
        if len(where[t] & bad) >= enough:
            firsts.setdefault(frozenset(where[t]), t)
    names = sorted(firsts.values())
    found = {}
    for size in (1, 2, 3):
        for c in combinations(names, size):
            hit = set.intersection(*(where[t] for t in c))
            share = len(hit & bad) / len(hit) if hit else 0
            if len(hit & bad) >= enough and share >= confidence and not any(f <= set(c) and s >= share for f, s in found.items()):
                found[frozenset(c)] = share
    return set(found)


def planted(n=60):
    return [(f"http://{h}.test/{p}/{i}", int(h == "spam" and p == "buy")) for i in range(n) for h in ("spam", "good") for p in ("buy", "read")] + [("http://spam.test/read/1", None), (None, 1)]


def test_mined_rules_against_brute_force(spark):
    labelled = planted()
    df = spark.createDataFrame(labelled, "url string, bad int")
    tokens = {r.url: frozenset(r.t) for r in df.where("url is not null").select("url", urls.tokens_of(df.url).alias("t")).collect()}
    rows = [(u, b) for u, b in labelled if u and b is not None]
    for support, confidence, least in ((0.05, 0.9, 1), (0.05, 0.3, 1), (0.0, 0.9, 60), (0.0, 0.9, 61)):
        mined = urls.mine(df, support, confidence, least, held_out=False)
        sets = {frozenset(r.tokens) for r in mined.collect()}
        assert sets == slow_rules(tokens, rows, support, confidence, least) and (least > 60 or sets)
        hit = {r.url for r in urls.matched(df, mined).collect()}
        assert hit == {u for u in tokens if any(s <= tokens[u] for s in sets)}


def test_verdicts_of_mined_rules(spark):
    """What is mined decides URLs that were never labelled; chance makes no rule."""
    mined = urls.mine(spark.createDataFrame(planted(), "url string, bad int"))
    asked = [(1, "http://spam.test/buy/new"), (2, "http://spam.test/read/new"), (3, "http://good.test/buy/new"), (4, "http://SPAM.test/x/buy?a=1"), (5, "http://spam.test.com/en/buy")]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(asked, "page_id long, url string"), mined).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "block"}
    rng = random.Random(1)
    noise = [(f"http://h{rng.randrange(9)}.test/{rng.choice('abcdef')}/{rng.choice('uvwxyz')}/{i}", int(rng.random() < 0.3)) for i in range(1500)]
    assert urls.mine(spark.createDataFrame(noise, "url string, bad int")).count() == 0


def test_urls_with_many_tokens(spark):
    """Forty tokens that always go together have no power set of rules."""
    rows = [(f"http://spam.test/{'/'.join(f'w{chr(97 + j % 26)}{j}' for j in range(40))}/{i}", 1) for i in range(90)] + [(f"http://good.test/{i}", 0) for i in range(90)]
    rows += [("http://one.test/?" + "&".join(f"k{j}=1" for j in range(3000)), 1)]
    mined = urls.mine(spark.createDataFrame(rows, "url string, bad int")).collect()
    assert len(mined) == 1 and len(mined[0].tokens) == 1
