"""Near-duplicates against brute force over all pairs."""

import random
import re

import pytest
from llm_support import docs_of, few_partitions, lower, sentences, smallest_reachable  # noqa: F401

from issuegrid.llm.components import components
from issuegrid.llm.minhash import near_duplicates


def brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = smallest_reachable(ids, links)
    return {i: (len(sets[i]), label[i], label[i] == i) for i in ids}


def edited(text, r, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = "edit%d" % r.randrange(10**6)
    return " ".join(w)


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_matches_brute_force(docs_of, words, percent):
    r = random.Random(4)
    base = sentences(1, 12, 60)
    rows = [(k, t) for k, t in enumerate(base)]
    for edits in (0, 1, 1, 2, 2, 3, 4):                  # copies on both sides of the threshold, also of each other
        rows += [(100 * edits + 20 + k + 1000 * len(rows), edited(t, r, edits)) for k, t in enumerate(base)]
    rows += [(5, ""), (7, None)] + [(900_000 + k, t) for k, t in enumerate(["one", "ONE", "one two", "one  two\n", "a b c", "a b c d", "   "])]
    rows = list(dict(rows).items())
    r.shuffle(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_duplicates(docs_of(rows), words, percent).collect()}
    assert got == brute(rows, words, percent)


def test_links_between_copies_that_the_centre_does_not_reach(docs_of):
    # A family in which few members are within reach of any one of them.
    r, text, rows = random.Random(9), sentences(2, 1, 80)[0], []
    for k in range(40):
        text = edited(text, r, 1)
        rows.append((k, text))
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_duplicates(docs_of(rows)).collect()}
    assert got == brute(rows, 3, 85)


def test_repeated_rows_null_ids_and_empty_table(docs_of):
    t = sentences(3, 2)
    got = near_duplicates(docs_of([(4, t[0]), (4, t[0]), (2, t[0]), (None, t[0]), (None, "alone here"), (None, None), (9, t[1])])).collect()
    assert sorted((x.doc_id or -1, x.component_id, x.kept) for x in got if x.n_shingles > 1) == [
        (-1, 2, False), (2, 2, True), (4, 2, False), (4, 2, False), (9, 9, True)]
    assert len(got) == 7
    assert near_duplicates(docs_of([])).collect() == []


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(400, 450)]
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    ids = {i for e in edges if e[0] != e[1] for i in e}
    assert got == {i: c for i, c in smallest_reachable({i for e in edges for i in e}, edges).items() if i in ids}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
