"""URL filter: rules, then a character language-model ratio (operator 10).

Rules decide the urls they fit. They also label the corpus: urls that a rule accepts and
urls that a rule rejects each train a variable-order Markov model of characters. The
models back off with Witten-Bell weights: the probability of a character after its last
``ORDER`` characters is mixed with that after one character less, down to a uniform one.
A url without a rule is blocked if its length-normalised log-likelihood difference lies
above a threshold. The threshold is calibrated by cross-fitting: labelled url texts are
dealt into folds, and each is scored by models of the other folds' counts. The urls without
a rule are scored by models that count every labelled url. Everything is DataFrame
expressions, aggregates and equi-joins.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import saved

ORDER = 4                # characters of context at most
ALPHABET = 256           # characters that the uniform model at the bottom spreads over
PAD = "\u0002"           # stands before a url's first character
CALIBRATE = 5            # folds of the labelled url texts, for the threshold
#: The rules of the contract (fixed values): verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """``(host, path)``: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return _lower(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def modelled(url: Column) -> Column:
    """What the models read: the lower-cased host and all behind it; without ``://`` the url as it is."""
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(_lower(host), F.regexp_extract(rest, r"(?s)\A[^/?#]*(.*)", 1))).otherwise(url)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest fitting rule; null where none fits."""
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in order]
    pick = lambda values: functools.reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), reversed(list(zip(fits, values, strict=True))), F.lit(None).cast("string"))
    return pick([F.lit(h + p) for _, h, p in order]), pick([F.lit(v) for v, *_ in order])


def _grams(texts: DataFrame, *keep: str) -> DataFrame:
    """``(*keep, gram)``: each character of ``seen`` with the ``ORDER`` characters before it."""
    padded = F.concat(F.lit(PAD * ORDER), F.col("seen"))
    at = F.explode(F.sequence(F.lit(1), F.length("seen")))
    return texts.where(F.length("seen") > 0).select(*keep, padded.alias("__t"), at.alias("__k")).select(
        *keep, F.expr(f"substring(__t, __k, {ORDER + 1})").alias("gram"))


def log_ratios(counts: DataFrame, models: tuple[str, ...] = ("",)) -> DataFrame:
    """``(gram, ratio of each model)``: log P(last character | those before) of the rejected less the accepted model.

    ``counts``: ``(gram, good, bad)`` for every gram that is to be scored, zeros for unseen;
    several pairs of models have columns of their own, told by their names' ends.
    """
    names = [c + m for m in models for c in ("good", "bad")]
    p = {c: F.lit(1.0 / ALPHABET) for c in names}
    table = counts
    for n in range(ORDER + 1):                               # from no context to the longest
        gram = F.expr(f"right(gram, {n + 1})")
        context = F.expr(f"left(right(gram, {n + 1}), {n})")
        of_gram = counts.groupBy(gram.alias("__g")).agg(*(F.sum(c).alias(f"n_{c}") for c in names))
        of_context = of_gram.groupBy(F.expr(f"left(__g, {n})").alias("__c")).agg(
            *(F.sum(f"n_{c}").alias(f"all_{c}") for c in names), *(F.sum((F.col(f"n_{c}") > 0).cast("int")).alias(f"kinds_{c}") for c in names))
        table = table.join(of_gram, gram == F.col("__g")).join(of_context, context == F.col("__c"))
        for c in names:
            kinds, total = F.col(f"kinds_{c}"), F.col(f"all_{c}")
            p[c] = F.when(total > 0, (F.col(f"n_{c}") + kinds * p[c]) / (total + kinds)).otherwise(p[c])
        table = table.select("gram", *(v.alias(f"p_{c}") for c, v in p.items()))
        p = {c: F.col(f"p_{c}") for c in p}
    return table.select("gram", *((F.log(p["bad" + m]) - F.log(p["good" + m])).alias("ratio" + m) for m in models))


def _threshold(scores: DataFrame) -> float:
    """The difference above which labelled urls are rejected with the fewest balanced errors.

    Labelled scores are counted in bins of 0.02 from -20 to 20; only the bins reach the driver.
    Without urls of both kinds the threshold is 0.
    """
    bins = scores.groupBy(F.floor(F.least(F.greatest("score", F.lit(-20.0)), F.lit(20.0)) * 50).alias("bin")).agg(
        F.sum((F.col("verdict") == "allow").cast("int")).alias("good"), F.sum((F.col("verdict") == "block").cast("int")).alias("bad"))
    rows = sorted((r.bin, r.good, r.bad) for r in bins.collect())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return 0.0
    below_bad, above_good, best = 0, good, (1.0, rows[0][0] / 50)
    for (b, g, x), after in zip(rows, [*(r[0] for r in rows[1:]), rows[-1][0] + 1], strict=True):
        below_bad, above_good = below_bad + x, above_good - g
        best = min(best, (below_bad / bad + above_good / good, (b + 1 + after) / 100))   # the middle of the gap
    return best[1]


def url_verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` for every row of ``pages (page_id, url)``.

    ``score`` is the length-normalised log-likelihood difference of the url behind its scheme,
    query and fragment included, or of all of it if it has no ``://`` (null where a rule
    decides); with nothing there it is 0. A null url, or one without ``://``, has an empty
    host and path, which no rule fits. Repeated rows are judged alike,
    rows without page_id like any other; other columns are ignored. Without urls of both
    kinds the threshold is 0, and a score above the threshold blocks.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")).select(
        "page_id", host.alias("host"), path.alias("path"), modelled(F.col("url")).alias("seen"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"))

    # Equal urls are counted together before they are cut into grams.
    texts = rows.groupBy("seen", "verdict").agg(F.count("*").alias("n"))
    texts = texts.withColumn("fold", F.when(F.col("verdict").isNotNull(), F.pmod(F.crc32(F.col("seen").cast("binary")), F.lit(CALIBRATE)).cast("int")))
    texts = saved(texts, "urls")
    tally = lambda v, f: F.sum(F.when((F.col("verdict") == v) & (F.col("fold") == f), F.col("n")).otherwise(0))
    kinds, folds = {"good": "allow", "bad": "block"}, range(CALIBRATE)
    counts = saved(_grams(texts, "verdict", "fold", "n").groupBy("gram").agg(*(tally(v, f).alias(f"{c}_{f}") for c, v in kinds.items() for f in folds)), "grams")
    # One pair of models counts all labelled urls, and one for each fold those of the other folds.
    of = lambda c, but: functools.reduce(Column.__add__, [F.col(f"{c}_{f}") for f in folds if f != but])
    models = {"": None} | {f"_but_{f}": f for f in folds}
    ratios = saved(log_ratios(counts.select("gram", *(of(c, but).alias(c + m) for m, but in models.items() for c in kinds)), tuple(models)), "ratios")

    own = F.coalesce(*(F.when(F.col("fold") == but, F.col("ratio" + m)) for m, but in models.items() if m), F.col("ratio"))
    scored = _grams(texts, "seen", "verdict", "fold").groupBy("seen", "verdict", "fold", "gram").agg(F.count("*").alias("k")).join(ratios, "gram").groupBy(
        "seen", "verdict").agg((F.sum(own * F.col("k")) / F.sum("k")).alias("score"))
    scored = saved(scored, "scores")
    cut = _threshold(scored.where("verdict is not null"))
    scored = scored.where("verdict is null")
    out = rows.withColumn("key", F.when(F.col("verdict").isNull(), F.col("seen"))).join(
        scored.select(F.col("seen").alias("key"), "score"), "key", "left")
    score = F.when(F.col("verdict").isNull(), F.coalesce("score", F.lit(0.0)))
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(score > cut, "block").otherwise("allow")).alias("verdict"),
                      score.alias("score"))
