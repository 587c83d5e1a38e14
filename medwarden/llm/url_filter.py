"""URL filters: host and path rules, then a ratio of two character language models.

Urls that a rule allows or blocks teach two Markov models of variable order. Order k predicts a
character from the k before it and falls back, by Witten-Bell smoothing, on order k - 1; the
orders are mixed from the longest context down to a uniform one. All counts stay distributed: each
position of a url is one window of ``ORDER`` + 1 characters, every order's counts are sums over
windows, and a window's log ratio is computed once however many urls hold it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medwarden.llm.common import stage

ORDER = 4
# Characters a model knows nothing of share one chance among so many.
ALPHABET = 256
# One in so many rule-labelled urls sets the threshold and teaches nothing.
CALIBRATE = 5
# Bins of the calibration histogram, 0.01 wide, on each side of zero.
_BINS = 500
# (verdict, host, path) of a rule.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_START, _END = "\x02", "\x03"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")


def host_of(rest: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower())


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, NULL where none does."""
    fits = reduce(
        lambda e, r: e.when(
            ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2]),
            F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict")),
        ),
        sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)),
        F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict"))),
    )
    return fits


def windows_of(text: str) -> Column:
    """The window that ends at each character of column ``text``, and at its end."""
    chars = f"split(concat('{_START * ORDER}', {text}, '{_END}'), '')"
    rest = "".join(f", get(_c, i + {k})" for k in range(1, ORDER + 1))
    return F.expr(
        f"transform(filter(array({chars}), x -> true), _c ->"
        f" transform(slice(_c, 1, greatest(size(_c) - {ORDER}, 0)), (c, i) -> concat(c{rest})))[0]"
    )


def _counts(windows: DataFrame, key: Column, name: str, context: bool) -> DataFrame:
    """Counts of both classes by a part of the window; for contexts also of the next characters."""
    sums = [F.sum("a").alias(f"a_{name}"), F.sum("r").alias(f"r_{name}")]
    if context:
        sums += [
            F.sum((F.col("a") > 0).cast("long")).alias(f"ka_{name}"),
            F.sum((F.col("r") > 0).cast("long")).alias(f"kr_{name}"),
        ]
    return windows.groupBy(key.alias(f"_{name}")).agg(*sums)


def window_ratios(windows: DataFrame) -> DataFrame:
    """(window, ratio): log of the accepted over the rejected model's chance of the last character.

    ``windows`` has one row per window with its counts ``a`` and ``r`` in accepted and rejected
    urls; windows without either are scored all the same.
    """
    out = windows
    chance = {"a": F.lit(1.0 / ALPHABET), "r": F.lit(1.0 / ALPHABET)}
    for k in range(ORDER + 1):
        gram = F.substring("window", ORDER + 1 - k, k + 1)
        context = F.substring("window", ORDER + 1 - k, k) if k else F.lit("")
        grams = _counts(windows, gram, f"g{k}", False)
        contexts = _counts(
            grams.select(
                F.substring(F.col(f"_g{k}"), 1, k).alias("x"),
                F.col(f"a_g{k}").alias("a"),
                F.col(f"r_g{k}").alias("r"),
            ),
            F.col("x"),
            f"c{k}",
            True,
        )
        # Files are far smaller than what is made of them, so sizes mislead the choice of a join.
        out = out.join(grams.hint("merge"), gram == F.col(f"_g{k}"))
        if k:
            out = out.join(contexts.hint("merge"), context == F.col(f"_c{k}"))
        else:
            out = out.crossJoin(F.broadcast(contexts))  # the empty context is one row
        for m in ("a", "r"):
            kinds = F.col(f"k{m}_c{k}")
            seen = F.col(f"{m}_c{k}") + kinds
            chance[m] = F.when(
                seen > 0, (F.col(f"{m}_g{k}") + kinds * chance[m]) / seen
            ).otherwise(chance[m])
        out = out.withColumns({f"p{m}{k}": chance[m] for m in ("a", "r")}).drop(
            *[f"{m}_{x}{k}" for m in ("a", "r", "ka", "kr", "") for x in "gc"]
        )
        chance = {m: F.col(f"p{m}{k}") for m in ("a", "r")}
    return out.select("window", F.log(chance["a"] / chance["r"]).alias("ratio"))


def _threshold(scored: DataFrame) -> float:
    """Score from which a url is accepted: fewest errors of both kinds, as shares of each class."""
    binned = F.greatest(F.least(F.round(F.col("score") * 100), F.lit(_BINS)), F.lit(-_BINS))
    rows = (
        scored.filter(F.col("_calibrates"))
        .groupBy(binned.cast("int").alias("bin"))
        .agg(
            F.count_if(F.col("_verdict") == "allow").alias("a"),
            F.count_if(F.col("_verdict") == "block").alias("r"),
        )
        .orderBy("bin")
        .collect()  # at most 2 * _BINS + 1 rows
    )
    accepted, rejected = sum(r.a for r in rows), sum(r.r for r in rows)
    if not accepted or not rejected:
        return 0.0
    best, at, lost, caught = None, 0.0, 0, 0
    for r in rows:
        # From this bin on everything is accepted.
        error = lost / accepted + (rejected - caught) / rejected
        if best is None or (error, abs(r.bin)) < best:
            best, at = (error, abs(r.bin)), (r.bin - 0.5) / 100
        lost, caught = lost + r.a, caught + r.r
    return at


def url_filter(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES
) -> DataFrame:
    """(id, host, path, rule, verdict, score) per row of ``pages``.

    ``score`` is the mean log ratio per character, rounded to 6 digits; it decides where no rule
    fits. A NULL url, or one without ``://``, has empty host and path and fits no rule; a NULL or
    empty url has score 0, and a score of 0 without any labelled urls is accepted. Repeated rows
    are judged alike; an empty table gives no rows.
    """
    rest = _after_scheme(F.col("_url"))
    rows = (
        pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
        .withColumn("_rest", F.coalesce(rest, F.lit("")))
        .select("_id", "_url", host_of(F.col("_rest")).alias("host"), path_of(F.col("_rest")).alias("path"))
        .withColumn("_fit", rule_of(F.col("host"), F.col("path"), rules))
        .select("_id", "_url", "host", "path", "_fit.rule", F.col("_fit.verdict").alias("_verdict"))
    )
    # Equal urls are scored once, and counted as often as they occur.
    distinct = stage(
        rows.filter(F.length("_url") > 0)
        .groupBy("_url")
        .agg(F.first("_verdict").alias("_verdict"), F.count(F.lit(1)).alias("n"))
        .withColumn("_calibrates", F.crc32("_url") % CALIBRATE == 0),
        "urls",
    )
    each = distinct.select(
        F.xxhash64("_url").alias("_h"), "_verdict", "n", "_calibrates", F.explode(windows_of("_url")).alias("window")
    )
    teaches = ~F.col("_calibrates")
    windows = stage(
        each.groupBy("window").agg(
            F.sum(F.when(teaches & (F.col("_verdict") == "allow"), F.col("n")).otherwise(0)).alias("a"),
            F.sum(F.when(teaches & (F.col("_verdict") == "block"), F.col("n")).otherwise(0)).alias("r"),
        ),
        "windows",
    )
    ratios = stage(window_ratios(windows), "ratios")
    scores = (
        each.select("_h", "window")
        .hint("merge")
        .join(ratios, "window")
        .groupBy("_h")
        .agg(F.round(F.avg("ratio"), 6).alias("score"))
    )
    scored = stage(
        distinct.join(scores, F.xxhash64("_url") == F.col("_h")).select(
            F.col("_url").alias("_u"), "_verdict", "_calibrates", "score"
        ),
        "scores",
    )
    cut = F.lit(_threshold(scored))
    # The url is the only key the rows share with their score; hot urls are one row there.
    joined = rows.join(scored.select("_u", "score"), F.col("_url") == F.col("_u"), "left")
    score = F.coalesce("score", F.lit(0.0))
    empty = F.coalesce(F.length("_url"), F.lit(0)) == 0
    return joined.select(
        F.col("_id").alias(id_col), "host", "path", "rule",
        F.coalesce("_verdict", F.when(empty | (score >= cut), "allow").otherwise("block")).alias("verdict"),
        score.alias("score"),
    )
