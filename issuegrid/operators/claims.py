"""Unique natural keys, exactly as if requests came one by one.

A request (an insert or an update) claims one key per unique column for its row. It is
refused, and claims nothing, when another row holds one of its keys at that moment; an
accepted update releases the key that its row held before. What a request meets therefore
depends on what became of the requests before it.

Keys are compared under the case- and accent-insensitive collation. Each distinct key gets
one representative first, so that everything after it runs on binary keys with hash joins and
hash aggregates. Printable ASCII keys are equal there if their lower-case forms are, so that
form is their representative; the collation is asked only about keys with other characters.

``ROUNDS`` rounds decide, by aggregates per key and per row, the requests whose outcome
does not depend on an undecided one: the first claim of a free key, a claim of a key whose
holder has not moved yet, and claims of keys that are held for good. Hot keys and hot rows
are decided there, from partial aggregates. What is left are chains (one request waits for
another, which waits for a third): their requests are grouped into connected components
and each component is replayed in request order, so a chain of any length is exact. A
component is one task's work; the order inside it cannot be split.
"""

from __future__ import annotations

import functools
import itertools
import operator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .lookup import INSENSITIVE

ROUNDS = 3
BINARY = "UTF8_BINARY"


def _plain(raw: str | Column) -> Column:
    """Whether the binary string is printable ASCII: every such character has a weight of its own."""
    return (F.col(raw) if isinstance(raw, str) else raw).rlike(r"\A[ -~]*\z")


def _binary(requests: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with the binary string ``key`` in the place of their collated key ``ck``: one for
    all keys that are equal under the collation."""
    raw = F.collate("ck", BINARY)
    requests, held = (df.withColumn("raw", raw).withColumn("key", F.when(_plain("raw"), F.lower("raw"))) for df in (requests, held))
    asked = requests.select("o", "ck", "raw", "key")
    others = asked.filter("key is null").unionByName(held.filter("key is null").select("o", "ck", "raw", "key")).groupBy("o", "raw").agg(
        F.any_value("ck").alias("ck")).checkpoint()
    if others.isEmpty():
        return requests.drop("ck", "raw"), held.drop("ck", "raw")
    # The others' strings among themselves, and with the plain ones that are equal to them.
    plain = [df.filter("key is not null").select("o", "key").distinct().withColumn("ck", F.collate("key", INSENSITIVE)) for df in (requests, held)]
    groups = others.groupBy("o", "ck").agg(F.min("raw").alias("low"))
    same = plain[0].unionByName(plain[1]).join(groups.select("o", "ck"), ["o", "ck"]).groupBy("o", "ck").agg(F.min("key").alias("same"))
    names = others.join(groups.join(same, ["o", "ck"], "left"), ["o", "ck"]).select("o", "raw", F.coalesce("same", "low").alias("name")).checkpoint()

    def named(df: DataFrame) -> DataFrame:
        rest = df.filter("key is null").join(names, ["o", "raw"]).withColumn("key", F.col("name"))
        cols = [c for c in df.columns if c not in ("ck", "raw")]
        return df.filter("key is not null").select(*cols).unionByName(rest.select(*cols))

    return named(requests), named(held)


def _round(open_requests: DataFrame) -> DataFrame:
    """``(id, refused, accepted)`` of the undecided requests that this round can decide.

    ``open_requests``: ``(id, row, o, key, holder, done)`` of all requests not refused so far;
    ``holder``: the row that held the key at the start, ``done``: already accepted.
    """
    moves = ~F.col("holder").eqNullSafe(F.col("row"))                 # leaves the key the row began with
    rows = open_requests.groupBy("row", "o").agg(
        F.max("id").alias("last"), F.min(F.when(moves, F.col("id"))).alias("moves"),
        F.min(F.when(moves & F.col("done"), F.col("id"))).alias("moved"))
    marked = open_requests.join(rows.select("row", "o", "last"), ["row", "o"])
    keys = marked.groupBy("o", "key").agg(
        F.min("id").alias("first"), F.min(F.when(F.col("done") & (F.col("id") == F.col("last")), F.col("id"))).alias("for_good"))
    holders = rows.select(F.col("row").alias("holder"), "o", F.col("moves").alias("holder_moves"), F.col("moved").alias("holder_moved"))
    met = open_requests.filter(~F.col("done")).join(keys, ["o", "key"]).join(holders, ["holder", "o"], "left")
    other = F.coalesce(F.col("holder") != F.col("row"), F.lit(False))
    refused = (other & F.coalesce(F.col("holder_moves") > F.col("id"), F.lit(True))) | F.coalesce(F.col("for_good") < F.col("id"), F.lit(False))
    free = (F.col("first") == F.col("id")) & (~other | F.coalesce(F.col("holder_moved") < F.col("id"), F.lit(False)))
    return met.groupBy("id").agg(F.max(refused).alias("refused"), F.min(free & ~refused).alias("accepted")).filter("refused or accepted")


def _components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of requests linked through nodes: ``links (id, node)``; component =
    smallest request reachable. Smallest labels spread over the nodes, and labels are
    followed to their own label (pointer jumping), so a chain takes a logarithmic number
    of rounds; each is written to the shared folder."""
    links = links.checkpoint()
    labels = links.select("id").distinct().withColumn("label", F.col("id"))
    while True:
        near = links.join(labels, "id").groupBy("node").agg(F.min("label").alias("low"))
        spread = links.join(near, "node").groupBy("id").agg(F.min("low").alias("low")).join(labels, "id")
        # What the old label has found goes to all that carry it; then every label is followed once.
        found = spread.groupBy("label").agg(F.min("low").alias("low"))
        hooked = spread.select("id", "label", F.col("low").alias("own")).join(found, "label").select(
            "id", "label", F.least("own", "low").alias("next"))
        jump = hooked.select(F.col("id").alias("next"), F.col("next").alias("after"))
        done = hooked.join(jump, "next").select("id", "label", "after").checkpoint()
        changed = done.filter(F.col("label") != F.col("after"))
        labels = done.select("id", F.col("after").alias("label"))
        if changed.isEmpty():
            return labels.select("id", F.col("label").alias("component"))


def _replay(part: pd.DataFrame) -> pd.DataFrame:
    """Outcomes of one component's requests, taken in order."""
    holder = {(o, k): h for o, k, h in zip(part["o"], part["key"], part["holder"], strict=True) if h == h and h is not None}
    current = {(h, o): k for (o, k), h in holder.items()}
    out = []
    part = part.sort_values(["id", "o"])
    in_order = zip(part["id"], zip(part["row"], part["o"], part["key"], strict=True), strict=True)
    for request, rows in itertools.groupby(in_order, operator.itemgetter(0)):
        claims = [claim for _, claim in rows]
        good = all(holder.get((o, k), row) == row for row, o, k in claims)
        if good:
            for row, o, k in claims:
                old = current.get((row, o))
                if old is not None and old != k:
                    del holder[o, old]
                holder[o, k], current[row, o] = row, k
        out.append((request, good))
    return pd.DataFrame(out, columns=["id", "accepted"])


def one_by_one(requests: DataFrame, held: DataFrame, columns: int, rounds: int = ROUNDS) -> DataFrame:
    """``(id, lost)`` of the refused requests: the sorted numbers of the columns whose key was taken.

    ``requests``: ``(id, row, o, ck)``, one row for each unique column a request sets (nulls
    left out), ``id`` unique and in request order, ``row`` a string that names the row (for
    an insert a name of its own); ``held``: ``(row, o, ck)`` at the start. Requests that set
    several columns must be inserts (their rows release nothing); with a single column
    inserts and updates may be mixed.
    """
    checkpoint_dir(requests.sparkSession)
    requests, held = _binary(requests, held)
    held = held.select("o", "key", F.col("row").alias("holder"))
    if columns > 1:                      # inserts never hold a key before: any holder refuses them
        held = held.groupBy("o", "key").agg(F.min("holder").alias("holder"))
    claims = requests.join(held, ["o", "key"], "left").select("id", "row", "o", "key", "holder").checkpoint()
    open_requests = claims.withColumn("done", F.lit(False))
    undecided = True
    for _ in range(rounds):
        verdict = _round(open_requests)
        after = open_requests.join(verdict, "id", "left").filter(~F.coalesce("refused", F.lit(False)))
        after = after.select("id", "row", "o", "key", "holder", (F.col("done") | F.coalesce("accepted", F.lit(False))).alias("done"))
        open_requests = after.checkpoint()
        undecided = not open_requests.filter(~F.col("done")).isEmpty()
        if not undecided:
            break
    accepted = open_requests.select("id").distinct()
    if undecided and columns > 1:
        # Inserts release nothing: the accepted refuse the later claims of their keys and have
        # no more say, and only what is left is replayed.
        done = open_requests.filter("done")
        since = done.groupBy("o", "key").agg(F.min("id").alias("since"))
        left = open_requests.filter(~F.col("done"))
        late = left.join(since, ["o", "key"]).filter(F.col("since") < F.col("id")).select("id")
        open_requests = left.join(late, "id", "left_anti").checkpoint()
        accepted = done.select("id").distinct().unionAll(open_requests.select("id").distinct()).checkpoint()
    if undecided:
        node = lambda kind, *cols: F.concat_ws("\x1f", F.lit(kind), *(F.col(c).cast("string") for c in cols))
        # A holder counts only where it has requests of its own; without, it is just a taken key.
        busy = open_requests.select(F.col("row").alias("holder"), "o").distinct()
        links = open_requests.select("id", node("key", "o", "key").alias("node")).unionAll(
            open_requests.select("id", node("row", "row", "o").alias("node"))).unionAll(
            open_requests.join(busy, ["holder", "o"], "left_semi").select("id", node("row", "holder", "o").alias("node")))
        components = _components(links.distinct())
        waiting = open_requests.filter(~F.col("done")).join(components, "id").select("component").distinct()
        components = components.join(waiting, "component", "left_semi")
        left = open_requests.join(components, "id")
        kind = dict(left.dtypes)["id"]
        replayed = left.groupBy("component").applyInPandas(
            lambda part: _replay(part), f"id {kind}, accepted boolean").checkpoint()
        accepted = accepted.join(replayed.filter(~F.col("accepted")).select("id"), "id", "left_anti")
    refused = claims.join(accepted, "id", "left_anti")
    if columns == 1:
        return refused.groupBy("id").agg(F.array_sort(F.collect_set("o")).alias("lost"))
    # Inserts release nothing: a key is taken from the start or from its first accepted claim on.
    taken = claims.join(accepted, "id", "left_semi").groupBy("o", "key").agg(F.min("id").alias("since"))
    lost = F.col("holder").isNotNull() | F.coalesce(F.col("since") < F.col("id"), F.lit(False))
    return refused.join(taken, ["o", "key"], "left").groupBy("id").agg(
        F.array_sort(F.collect_set(F.when(lost, F.col("o")))).alias("lost"))


def codes(columns: list[str], lost: str = "lost") -> Column:
    """``<column>:duplicate`` for every column number in the array ``lost``."""
    names = F.array(*[F.lit(f"{c}:duplicate") for c in columns])
    return F.transform(F.col(lost), lambda o: names[o])


def claims_of(df: DataFrame, request: Column, row: Column, columns: list[tuple[int, Column]]) -> DataFrame:
    """``(id, row, o, ck)`` of the non-null keys of each row of ``df``."""
    parts = [df.select(request.alias("id"), row.cast("string").alias("row"), F.lit(o).alias("o"), c.alias("ck")).filter(F.col("ck").isNotNull()) for o, c in columns]
    return functools.reduce(DataFrame.unionByName, parts)
