"""Fixtures and brute-force helpers of these tests."""

import random
import re

import pytest

SF_SMALL, SF_LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
CLASHING = ("doc_id bigint, text string, score double, kept boolean, words int, part int, d string, component int, ids string, "
            "n_words int, n_hit int, n_items int, items string, hits string, contaminated boolean, `a.b` int")


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text) rows with extra columns of clashing names."""
    return lambda rows: spark.createDataFrame([(i, t, 0.5, True, 1, 2, "x", 3, "y", 4, 5, 6, "z", "w", False, 7) for i, t in rows], CLASHING)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def smallest_reachable(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def sentences(seed, n, words=40, vocabulary=300):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghi") for _ in range(r.randint(2, 7))) for _ in range(vocabulary)]
    return [" ".join(r.choice(vocab) for _ in range(words)) for _ in range(n)]
