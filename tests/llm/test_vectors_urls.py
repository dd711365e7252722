"""Vector links and url verdicts against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from llm_support import few_partitions, lower, smallest_reachable  # noqa: F401

from issuegrid.llm import egojoin, urlfilter


def brute(rows, cosine):
    good = {k: np.array(v, float) for k, (_, v) in enumerate(rows)
            if v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    unit = {k: v / np.sqrt(v @ v) for k, v in good.items()}
    keys = sorted(unit)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1:] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    label = smallest_reachable(range(len(rows)), links)
    low = {c: min(rows[k][0] for k in label if label[k] == c) for c in set(label.values())}
    n = Counter(k for e in links for k in e)
    return sorted((rows[k][0], n[k], low[label[k]], rows[k][0] == low[label[k]]) for k in range(len(rows)))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, label int, n string")


def test_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(egojoin, "BLOCK", 40)
    r, rows = np.random.default_rng(8), []
    for k in range(40):
        c = r.normal(0, 1, 12)
        for s in (0.0, 0.02, 0.08, 0.1, 0.12):
            rows.append((len(rows) * 7 % 10007, np.float32(c + s * r.normal(0, 1, 12) * np.sqrt(c @ c) / 2).tolist()))
    rows += [(20_000, rows[0][1]), (20_001, rows[0][1]), (20_001, rows[0][1]), (20_002, [0.0] * 12), (20_003, None), (20_004, [float("nan")] + [1.0] * 11),
             (20_005, [None] + [1.0] * 11), (20_006, [float("inf")] + [1.0] * 11), (20_007, []), (20_008, [1e-30] * 12), (20_009, [1e30] * 12)]
    random.Random(2).shuffle(rows)
    got = egojoin.near_vectors(vectors(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute(rows, 0.95)


def test_vectors_of_every_length_are_linked(spark, monkeypatch):
    monkeypatch.setattr(egojoin, "BLOCK", 10)
    r, rows = np.random.default_rng(3), []
    for width, groups in ((12, 12), (9, 6), (3, 9), (1, 2)):
        for _ in range(groups):
            c = r.normal(0, 1, width)
            for s in (0.0, 0.0, 0.05, 0.12):
                rows.append((len(rows) * 7 % 1009, np.float32(c + s * r.normal(0, 1, width) * np.sqrt(c @ c) / 2).tolist()))
    rows += [(2_000, [1.0, 1.0]), (2_001, [0.0] * 9), (2_002, [None] + [1.0] * 8), (2_003, None), (2_004, [])]
    random.Random(5).shuffle(rows)
    got = egojoin.near_vectors(vectors(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute(rows, 0.95)


def test_intervals_recursion(monkeypatch):
    monkeypatch.setattr(egojoin, "LEAF", 4)
    r = np.random.default_rng(1)
    u = np.sort(r.normal(0, 1, (90, 5)), axis=0)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    eps = math.sqrt(0.1)
    for a, b in ((slice(0, 90), slice(0, 90)), (slice(0, 31), slice(31, 90))):
        got = {(i, j) for x, y in egojoin.join_intervals(u, u[:, :3], a, b, 0.95, eps) for i, j in zip(x, y, strict=True)}
        assert got == {(i, j) for i in range(a.start, a.stop) for j in range(b.start, b.stop) if (a != b or i < j) and u[i] @ u[j] >= 0.95}


def test_vector_edges(spark):
    assert egojoin.near_vectors(vectors(spark, [])).collect() == []
    got = egojoin.near_vectors(vectors(spark, [(None, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None)])).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in got) == [(-1, 1, 3, False), (3, 1, 3, True), (4, 0, 4, True)]


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host):], maxsplit=1)[0]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = ["https://WWW.Example.com/en/1?q", "http://a.example.com/en/x#y", "https://example.com/en", "http://x.net/es/", "http://net/fr/9", "http://xnet/fr/9",
        "https://b.org/en/", "com/", "x://com", "x://com/", "a://b://c/d", "", None, "http://", "http://?q", "http://é.net/es/ü", "ftp://u.net/es", "http://a\nb.net/fr/x"]


def test_rules(spark):
    got = urlfilter.url_verdicts(spark.createDataFrame([(k, u, "h") for k, u in enumerate(URLS)], "page_id bigint, url string, host string")).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path = split(URLS[r.page_id])
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), URLS[r.page_id]
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
        assert (r.score is None) == (rule is not None)


def test_language_model_matches_brute_force(spark):
    r = random.Random(4)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(3, 6)))
    urls = [f"http://{word('abcde')}.com/{word('abcde')}" for _ in range(60)] + [f"http://{word('vwxyz')}.net/es/{word('vwxyz')}" for _ in range(50)]
    urls += [f"http://{word('abcde')}.org/{word('abcde')}" for _ in range(15)] + [f"http://{word('vwxyz')}.org/{word('vwxyz')}" for _ in range(15)]
    urls += urls[:20] + [None]
    got = urlfilter.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).collect()
    order, count = urlfilter.ORDER, {"allow": defaultdict(Counter), "block": defaultdict(Counter)}
    for u in urls:                            # every labelled url counts
        seen = "".join(split(u))
        verdict = rule_of(*split(u))[1]
        if verdict:
            padded = urlfilter.PAD * order + seen
            for k in range(len(seen)):
                gram = padded[k:k + order + 1]
                for n in range(order + 1):
                    count[verdict][gram[order - n:order]][gram[order]] += 1

    def log_p(verdict, gram):
        p = 1 / urlfilter.ALPHABET
        for n in range(order + 1):
            c = count[verdict][gram[order - n:order]]
            if c:
                p = (c[gram[order]] + len(c) * p) / (sum(c.values()) + len(c))
        return math.log(p)

    for x in got:
        if x.rule is None and x.host:
            seen = x.host + x.path
            padded = urlfilter.PAD * order + seen
            grams = [padded[k:k + order + 1] for k in range(len(seen))]
            expect = sum(log_p("block", g) - log_p("allow", g) for g in grams) / len(grams)
            assert abs(x.score - expect) < 1e-9
    by = {u: x for x, u in zip(sorted(got, key=lambda x: x.page_id), urls, strict=True)}
    assert all(by[u].verdict == "allow" for u in urls[110:125]) and all(by[u].verdict == "block" for u in urls[125:140])


def model_log_ratio(rows):
    """Brute force of the models over ``rows`` (text, verdict): a function from a text to its mean log ratio."""
    order, count = urlfilter.ORDER, {"allow": defaultdict(Counter), "block": defaultdict(Counter)}
    grams = lambda t: [(urlfilter.PAD * order + t)[k:k + order + 1] for k in range(len(t))]
    for text, verdict in rows:
        for gram in grams(text) if verdict else ():
            for n in range(order + 1):
                count[verdict][gram[order - n:order]][gram[order]] += 1

    def log_p(verdict, gram):
        p = 1 / urlfilter.ALPHABET
        for n in range(order + 1):
            c = count[verdict][gram[order - n:order]]
            if c:
                p = (c[gram[order]] + len(c) * p) / (sum(c.values()) + len(c))
        return math.log(p)

    return lambda t: sum(log_p("block", g) - log_p("allow", g) for g in grams(t)) / len(grams(t))


def test_every_labelled_url_is_counted(spark, monkeypatch):
    r = random.Random(6)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(3, 6)))
    fold = lambda seen: zlib.crc32(seen.encode()) % 5
    hot = next(u for u in iter(lambda: f"{word('vwxyz')}.net/es/{word('vwxyz')}", None) if fold(u) == 0)   # the only rejected text
    urls = [f"http://{hot}"] * 40 + [f"http://{word('abcde')}.com/{word('abcde')}" for _ in range(40)]
    urls += [f"http://{word('vwxyz')}.org/{word('vwxyz')}" for _ in range(8)] + [f"http://{hot.replace('.net/es', '.org/es')}"]
    scores = {}
    threshold = urlfilter._threshold
    monkeypatch.setattr(urlfilter, "_threshold", lambda s: scores.update({x.seen: (x.verdict, x.score) for x in s.collect()}) or threshold(s))
    got = urlfilter.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).collect()
    labelled = [("".join(split(u)), rule_of(*split(u))[1]) for u in urls]
    of_all = model_log_ratio(labelled)
    assert all(abs(x.score - of_all(x.host + x.path)) < 1e-9 for x in got if x.rule is None)
    others = {f: model_log_ratio([x for x in labelled if fold(x[0]) != f]) for f in range(5)}
    assert {t: v for t, (v, _) in scores.items()} == {t: v for t, v in labelled if v}
    assert all(abs(s - others[fold(t)](t)) < 1e-9 for t, (_, s) in scores.items())


def test_models_read_the_whole_url(spark):
    urls = [f"http://a{k}.com/abc?good=abc{k}#abc" for k in range(30)] + [f"http://b{k}.net/es/?bad=xyz{k}#xyz" for k in range(30)]
    asked = {"http://C.org/p?good=ABC": "c.org/p?good=ABC", "http://c.org/p?bad=xyz": "c.org/p?bad=xyz", "http://c.org/p#xyz": "c.org/p#xyz",
             "Good=abc": "Good=abc", "bad=xyz\n#xyz": "bad=xyz\n#xyz", "http://": "", None: ""}
    got = urlfilter.url_verdicts(spark.createDataFrame(list(enumerate([*urls, *asked])), "page_id bigint, url string")).collect()
    of_all = model_log_ratio([(u.removeprefix("http://"), rule_of(*split(u))[1]) for u in urls])
    score = {x.page_id - len(urls): x.score for x in got}
    for k, text in enumerate(asked.values()):
        assert abs(score[k] - (of_all(text) if text else 0.0)) < 1e-9, text
    assert len({score[k] for k in range(5)}) == 5


def test_no_pages(spark):
    assert urlfilter.url_verdicts(spark.createDataFrame([], "page_id bigint, url string")).collect() == []
