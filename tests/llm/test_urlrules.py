import random

from tallyforge.llm import urlrules as U

RULES = [U.Rule("net", "/", U.BLOCK), U.Rule("example.net", "/en/", U.ALLOW), U.Rule("example.com", "/de/", U.BLOCK), U.Rule("org", "/fr/", U.ALLOW)]


def stated(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host):].split("?", 1)[0].split("#", 1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else None


URLS = [
    None, "", "no scheme", "http://", "://x.net/", "HTTP://A.Example.NET/en/x?y=/de/#z", "http://example.net/en", "http://xexample.net/en/", "http://example.net", "https://net/", "http://a.net?x=/",
    "http://example.com/de/1", "http://b.example.com/de", "http://example.com/fr/", "http://x.org/fr/#", "http://org/fr/a", "http://xorg/fr/", "http://É.org/fr/", "a://b://c.net/", "http://h\n.net/",
]


def test_stated_rules_and_mined_combinations(spark):
    rows = [(k, u, "z") for k, u in enumerate(URLS)] + [(3, URLS[11], "again")]
    n = len(rows)
    rows += [(1000 + k, f"http://{'win-spam' if k % 4 == 0 else 'site'}{k % 3}.example.com/{'buy' if k % 4 == 0 else 'read'}/{k}", "z") for k in range(200)]
    bad = [(1000 + k, k % 4 == 0) for k in range(0, 160)] + [(None, True), (1, None), (1000, False)]
    df = spark.createDataFrame(rows, "page_id long, url string, tokens string")
    out = U.judge(df, spark.createDataFrame(bad, "page_id long, bad boolean"), RULES).collect()
    assert len(out) == len(rows)
    want = sorted(((i, *stated(u)[:3]) for i, u, _ in rows), key=repr)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in out), key=repr) == want
    for r in out:
        if r["rule"] is not None:
            assert r["verdict"] == next(x.verdict for x in RULES if x.name == r["rule"]) and r["mined"] is None
        elif r["page_id"] >= 1000:
            assert r["verdict"] == (U.BLOCK if (r["page_id"] - 1000) % 4 == 0 else U.ALLOW)
        else:
            assert r["verdict"] == U.ALLOW
    assert n == 21


def test_no_labels_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    assert [r["verdict"] for r in U.judge(pages, none, RULES).collect()] == [U.ALLOW]
    assert U.judge(pages.where("false"), none, RULES).collect() == []


def brute_rules(rows):
    """rows: (tokens, bad); all combinations of tokens, one for each set of pages, by counting."""
    import itertools

    n, bad = len(rows), sum(b for _, b in rows)
    base, least = bad / n, max(U.MIN_PAGES, U.MIN_SUPPORT * n)
    pages = {}
    for k, (tokens, _) in enumerate(rows):
        for t in tokens:
            pages.setdefault(t, set()).add(k)
    items = {}
    for t, at in pages.items():
        if least <= len(at) < n:
            items.setdefault(frozenset(at), []).append(t)
    sets = {}
    for size in range(1, 8):
        for chosen in itertools.combinations(sorted(items, key=lambda at: min(items[at])), size):
            at = frozenset.intersection(*chosen)
            hit = sum(rows[k][1] for k in at)
            if hit >= least:
                sets[frozenset(min(items[x]) for x in chosen)] = (sorted(t for x in chosen for t in items[x]), hit, len(at))
    z = U.sigmas(len(sets))
    z2, out = z * z, set()
    for key, (tokens, hit, of) in sets.items():
        confidence = hit / of
        lower = (hit + z2 / 2 - z * (hit * (of - hit) / of + z2 / 4) ** 0.5) / (of + z2)
        weaker = any(sets[p][1] / sets[p][2] >= confidence for k in range(1, len(key)) for p in map(frozenset, itertools.combinations(key, k)))
        if confidence >= U.MIN_CONFIDENCE and confidence >= U.MIN_LIFT * base and lower > base and not weaker:
            out.add((tuple(tokens), hit, of))
    return out


def test_mining_and_matching_match_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for k in range(240):
        tokens = [t for t in "abcdefg" if rng.random() < 0.4] + ["all"]
        if "a" in tokens:
            tokens += ["twin of a"]
        bad = ("a" in tokens and "b" in tokens and rng.random() < 0.98) or ("c" in tokens and "d" in tokens and rng.random() < 0.98) or rng.random() < 0.1
        rows.append((tokens, bad))
    df = spark.createDataFrame([(k, t, b) for k, (t, b) in enumerate(rows)], "uid long, tokens array<string>, bad boolean")
    rules = U.mine(df).collect()
    found = {(tuple(r["antecedent"]), r["n_bad"], r["n"]) for r in rules}
    assert found == brute_rules(rows) and len(found) >= 2
    by = {r["uid"]: r["mined"] for r in U.matched(df.select("uid", "tokens"), spark.createDataFrame(rules)).collect()}
    for k, (tokens, _) in enumerate(rows):
        fits = [(r["confidence"], " ".join(r["antecedent"])) for r in rules if set(r["antecedent"]) <= set(tokens)]
        assert by.get(k) == (max(fits)[1] if fits else None)


def test_tokens_that_always_come_together_make_one_rule(spark):
    many = [f"k:x{k}" for k in range(30)]
    rows = [(k, many if k % 3 == 0 else ["k:other", f"p:{k % 5}"], k % 3 == 0) for k in range(90)]
    rules = U.mine(spark.createDataFrame(rows, "uid long, tokens array<string>, bad boolean")).collect()
    assert [sorted(r["antecedent"]) for r in rules] == [sorted(many)]


def test_distant_labels_make_rules_that_block_and_a_join_gives_the_same(spark, monkeypatch):
    rows = [(k, f"http://{'www.' if k % 2 else ''}{'casino-win' if k % 5 == 0 else f'site{k % 7}'}.example.io/{'en' if k % 3 else 'de'}/{k}") for k in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, k in (3, 27, 58)) for k in range(100)], "page_id long, bad boolean")
    bad = U.page_labels(pages, labels)
    out = sorted(map(tuple, U.judge(pages, bad, RULES).collect()))
    assert [r[4] for r in out] == [U.BLOCK if k % 5 == 0 else U.ALLOW for k in range(100)]
    monkeypatch.setattr(U, "BROADCAST_RULES", 0)
    assert sorted(map(tuple, U.judge(pages, bad, RULES).collect())) == out
