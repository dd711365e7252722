"""Personal data and disclosing terms against brute force; hostile texts; edge rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from llm_support import docs_of, few_partitions, lower, sentences  # noqa: F401

from issuegrid.llm import sanitise

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"


def luhn(text):
    digits = [int(c) for c in re.sub("[ -]", "", text)][::-1]
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0


def holds(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in text.split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(text),
            "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def base(text):
    return [(kind, m.start(), m.end()) for kind, p in PLAIN.items() for m in re.finditer(p, text or "", re.ASCII) if holds(kind, m[0])]


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def brute(texts):
    """All spans of every text by the method, straight from its definition."""
    texts = [t or "" for t in texts]
    words = [set(re.findall(TERM + "{2,}", lower(t))) for t in texts]
    n_entity, both, contexts = Counter(), Counter(), defaultdict(set)
    for text in texts:
        beside = defaultdict(lambda: defaultdict(set))
        for kind, pattern in PLAIN.items():
            # Contexts reach to the next match of the pattern that may count for the kind.
            matches = [m for m in re.finditer(pattern, text, re.ASCII) if kind != "card" or 13 <= len(re.sub("[ -]", "", m[0])) <= 19]
            for k, m in enumerate(matches):
                if not holds(kind, m[0]):
                    continue
                before = text[matches[k - 1].end() if k else 0:m.start()]
                after = text[m.end():matches[k + 1].start() if k + 1 < len(matches) else len(text)]
                if len(before) > sanitise.CONTEXT:
                    before = re.sub(f"^{TERM}+", "", before[-sanitise.CONTEXT - 1:])
                if len(after) > sanitise.CONTEXT:
                    after = re.sub(f"{TERM}+$", "", after[:sanitise.CONTEXT + 1])
                entity = kind + ":" + (lower(m[0]) if kind == "email" else m[0] if kind == "ip" else re.sub("[^0-9]", "", m[0]))
                context = " ".join((before, m[0], after))
                for t in set(re.findall(TERM + "{2,}", lower(context))):
                    beside[entity][t].add(context)
                beside[entity]
        for entity, terms in beside.items():
            n_entity[entity] += 1
            for t, c in terms.items():
                both[entity, t] += 1
                contexts[entity, t].add(frozenset(c))
    n_term = Counter(t for w in words for t in w)
    share = {}
    for (entity, t), n in both.items():
        if len(contexts[entity, t]) > 1 and n_entity[entity] < len(texts):
            s = 1 + math.log(n / n_term[t]) / math.log(len(texts) / n_entity[entity])
            share[t] = max(share.get(t, (-9, "")), (s, entity))
    out = []
    for text in texts:
        spans = base(text)
        more = []
        for m in re.finditer(TERM + "{2,}", text):
            if share.get(lower(m[0]), (-9, ""))[0] >= sanitise.GENERALISE and not any(a <= m.start() < b for _, a, b in spans):
                more.append(("term", m.start(), m.end()))
        out.append((spans, spans + more))
    return out


def check(got, expect):
    for r in got:
        spans, every = expect[r.doc_id]
        n = Counter(k for k, _, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in PLAIN), r
        assert r.base_sha256 == hashlib.sha256(written(spans).encode()).hexdigest()
        assert r.spans == written(every)


CASES = ["a@b.c", "a@b.c.", "a@b.c_d@e.f", "a@b.c-d@e.f", "a@b@c.d", "@x.y", "a@.b", "a@b..c x.y@z.w", "éjo.81@Mail7.example.com!", "%+@-.-", "1.2.3.4", "1.2.3.4.5.6.7.8",
         "999.1.2.3.4.5.6", "01.002.0003.255", "256.1.1.1", "1.2.3", "1.2.3.", "00000000000000000000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111 1111 1111",
         "4111111111111111 1", "4111111111111111-", " 4111111111111111\n5500005555555559", "5 4111111111111111", "4111111111111112", "1" * 13, "0" * 13, "0" * 19, "0" * 20,
         "+1 (017) 555-7713", "+1-", "+12345678", "+123456789", "+1234567890123456", "++49 30 123456 7", "+1 2 3 4 5 6 7 8 9 ()", "+1.2.3.4.5.6.7.8.9", "x +49 30 1234567 y", "", None]


def test_base_spans_match_the_contract(spark, docs_of):
    r = random.Random(9)
    texts = CASES + ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for letters in ("ab.@-_ ", "01.5 ", "0149- ", "+012 ().-", "a1.@+ -é🙂") for _ in range(400)]
    texts += ["".join(r.choice(["4111111111111111", "a@b.cd", "1.2.3.4", "+1 (017) 555-7713", " ", "é", "x", ",", "5500005555555559"]) for _ in range(30)) for _ in range(60)]
    got = sanitise.base_matches(docs_of([(k, t or "") for k, t in enumerate(texts)]).select("doc_id", "text")).collect()
    assert len(got) == len(texts)
    for row in got:
        assert [(k, m["from"], m["to"]) for k in PLAIN for m in row[k]] == base(texts[row.doc_id]), texts[row.doc_id]


@pytest.fixture(scope="module")
def corpus():
    r, plain = random.Random(2), sentences(11, 260, words=40, vocabulary=500)
    for k in range(0, 40, 2):          # an entity with a name of its own beside it, in different contexts
        words = plain[k].split()
        words[20:20] = ["Quentin", "Zyzzyva", "q.zyz@corp.example.org"] if k % 4 else ["Ødegård", "reached", "at", "+47 22 33 44 55", "or", "10.1.2.3"]
        plain[k] = " ".join(words)
    for k in range(41, 45):
        plain[k] += " zyzzyva wrote this"
    copy = "Unique words stand near 4111 1111 1111 1111 in this copied passage"
    return plain + [copy] * 9 + CASES[:12] + [r.choice(plain) for _ in range(5)]


def test_disclosing_terms_match_brute_force(spark, docs_of, corpus):
    expect = brute(corpus)
    got = sanitise.sanitised_digest(docs_of(list(enumerate(corpus))).repartition(4)).collect()
    assert len(got) == len(corpus)
    check(got, expect)
    assert all("term:" in written(expect[k][1]) for k in range(41, 45))                 # named without the address
    assert not any("term:" in written(expect[k][1]) for k in range(100, 260))
    assert "term:" not in written(expect[265][1])                                         # copies of one passage


def test_texts_are_cleaned(spark, docs_of, corpus):
    got = {r.doc_id: r.text for r in sanitise.sanitised(docs_of(list(enumerate(corpus)))).collect()}
    assert "[email]" in got[2] and "zyzzyva" not in got[2].lower() and "zyzzyva" not in got[43].lower()
    assert got[100] == corpus[100] and got[265].endswith("near [card] in this copied passage")


def test_hostile_texts(spark, docs_of):
    """Long runs that cost a careless pattern its stack or quadratic time (they cost the brute force that, too)."""
    n = 20_000
    texts = {"a" * n: (), "a@" * n: (), "a." * n + "@x.y": (("email", 0, 2 * n + 4),), "a@" + "b." * n + "c": (("email", 0, 2 * n + 3),), "1" * n: (), "1 " * n: (),
             "1." * n: tuple(("ip", k, k + 7) for k in range(0, 2 * n, 8)), "+" * n: (), "+1" + "(" * n: (),
             "4111111111111111\n" * 1_500: tuple(("card", 17 * k, 17 * k + 16) for k in range(1_500)), "a@b.c " * 1_500: tuple(("email", 6 * k, 6 * k + 5) for k in range(1_500)),
             "é" * n + " a@b.c": (("email", n + 1, n + 6),)}
    got = sanitise.sanitised_digest(docs_of(list(enumerate(texts))).repartition(4)).collect()
    expect = list(texts.values())
    check(got, [(e, e) for e in expect])


def test_edges(spark, docs_of):
    assert sanitise.sanitised_digest(docs_of([])).collect() == []
    empty = hashlib.sha256(b"").hexdigest()
    got = sanitise.sanitised_digest(docs_of([(None, None), (3, ""), (3, ""), (None, "a@b.c")])).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.base_sha256 == empty, r.spans) for r in got) == [(0, 0, True, ""), (0, 1, False, "email:0:5"), (3, 0, True, ""), (3, 0, True, "")]


def test_native(spark, docs_of):
    plan = sanitise.sanitised_digest(docs_of([(1, "a@b.c")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
