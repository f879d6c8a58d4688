"""URL filters: host and path rules, and a character language-model ratio for the URLs that no rule decides.

Two variable-order Markov models, of the URLs that the rules accept and of those that they reject, give every character of a URL
a probability after the longest context that training has seen (up to ``ORDER`` characters). Orders are mixed by Witten-Bell
smoothing: a context seen n times with t different successors gives its own counts the weight n / (n + t). The score of a URL is
the difference of the two log-likelihoods per character; the threshold is calibrated on rule-decided URLs kept out of training.

Only DataFrame functions are used. Characters fold to ``ALPHABET`` and one class for the rest, so a model has at most
``len(ALPHABET) + 1`` to the power ``ORDER + 1`` entries, whatever the corpus size; that bound allows broadcasting it.

Null URLs have an empty host and path and score 0. With no training URL of one kind every score is 0 and every verdict is allow.
Equal URLs get equal verdicts; repeated rows stay repeated. Only the id and URL columns are read; others are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tanteo.llm.store import stored

ALPHABET = "abcdefghijklmnopqrstuvwxyz/.-"
ORDER = 3
#: One URL in so many is kept out of training, for the threshold.
HELD_OUT = 5
#: Scores are counted in bins of this width for the threshold, between -LIMIT and LIMIT.
BIN, LIMIT = 0.01, 10.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (``host/path``) and its verdict, else nulls. ``rules`` is a short list of (rule, verdict)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        top, _, rest = rule.partition("/")
        fits = ((host == top) | host.endswith(f".{top}")) & path.startswith(f"/{rest}")
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _folded(url: Column) -> Column:
    """Host and path in the small alphabet behind ``ORDER`` start marks; digits become one class and others another."""
    text = F.lower(F.concat(host_of(url), path_of(url)))
    digits = F.translate(text, "0123456789", "0" * 10)
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(digits, f"[^{ALPHABET.replace('-', '')}0-]", "~"), F.lit("$"))


def _spots(frame: DataFrame, url: str, *keep: str) -> DataFrame:
    """A row per character and order: ``gram`` is the character behind its context of 0 to ``ORDER`` characters."""
    at = frame.select(*keep, _folded(F.col(url)).alias("_text"))
    at = at.select(*keep, "_text", F.explode(F.sequence(F.lit(ORDER + 1), F.length("_text"))).alias("_at"))
    return at.select(*keep, "_at", F.explode(F.array(*[F.expr(f"substring(_text, _at - {k}, {k + 1})") for k in range(ORDER + 1)])).alias("gram"))


def model(training: DataFrame, url: str, accepted: str) -> DataFrame:
    """Log-probability ratio of each gram seen in ``training`` (``accepted``: boolean): (gram, ratio)."""
    yes = F.sum(F.when(F.col(accepted), F.col("n")).otherwise(0)).alias("yes")
    no = F.sum(F.when(F.col(accepted), F.lit(0)).otherwise(F.col("n"))).alias("no")
    once = training.groupBy(url, accepted).agg(F.count(F.lit(1)).alias("n"))
    counts = stored(_spots(once, url, accepted, "n").groupBy("gram").agg(yes, no))
    size = len(ALPHABET) + 4
    lower = None
    levels = []
    for k in range(ORDER + 1):
        level = counts.where(F.length("gram") == k + 1).withColumn("context", F.expr(f"substring(gram, 1, {k})"))
        followed = level.groupBy("context").agg(*[
            f(kind).alias(f"{name}_{kind}") for kind in ("yes", "no")
            for name, f in (("n", F.sum), ("t", lambda c: F.count_if(F.col(c) > 0)))
        ])
        level = level.join(followed, "context").withColumn("suffix", F.expr("substring(gram, 2)"))
        if lower is None:
            level = level.withColumns({"lower_yes": F.lit(1 / size), "lower_no": F.lit(1 / size)})
        else:
            level = level.join(lower, "suffix")
        for kind in ("yes", "no"):
            n, t, c = F.col(f"n_{kind}"), F.col(f"t_{kind}"), F.col(kind)
            # the small part of the uniform share keeps a character possible that a kind never has
            level = level.withColumn(f"p_{kind}", F.when(n + t > 0, (c + t * F.col(f"lower_{kind}")) / (n + t)).otherwise(F.col(f"lower_{kind}")))
            level = level.withColumn(f"p_{kind}", F.greatest(f"p_{kind}", F.lit(1e-9)))
        level = stored(level.select("gram", "p_yes", "p_no"))
        levels.append(level)
        lower = level.select(F.col("gram").alias("suffix"), F.col("p_yes").alias("lower_yes"), F.col("p_no").alias("lower_no"))
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    return whole.select("gram", (F.log("p_yes") - F.log("p_no")).alias("ratio"))


def scored(urls: DataFrame, ratios: DataFrame, url: str) -> DataFrame:
    """``urls`` with ``score``: the ratio of the longest known gram at each character, averaged. Repeated rows stay repeated."""
    keys = urls.columns
    once = urls.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    # the model is bounded by the alphabet and the order (module docstring)
    known = _spots(once, url, *keys, "_copies").join(F.broadcast(ratios), "gram")
    longest = known.groupBy(*keys, "_copies", "_at").agg(F.max(F.struct(F.length("gram"), F.col("ratio")))["ratio"].alias("_ratio"))
    found = longest.groupBy(*keys, "_copies").agg(F.avg("_ratio").alias("score"))
    return found.select(*keys, "score", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")


def threshold(scores: DataFrame, accepted: str) -> float:
    """The score at or above which URLs are accepted: the middle of the bins with the best balanced accuracy on held-out rows."""
    binned = F.floor(F.greatest(F.least("score", F.lit(LIMIT)), F.lit(-LIMIT)) / BIN)
    counts = {r.at: (r.yes, r.no) for r in scores.groupBy(binned.alias("at")).agg(F.count_if(accepted).alias("yes"), F.count_if(~F.col(accepted)).alias("no")).collect()}
    all_yes, all_no = (sum(c[i] for c in counts.values()) for i in (0, 1))
    if not all_yes or not all_no:
        return 0.0
    best, at, below_yes, below_no = -1.0, [], 0, 0
    for cut in sorted({*counts, *(c + 1 for c in counts)}):
        below_yes, below_no = (sum(c[i] for k, c in counts.items() if k < cut) for i in (0, 1))
        right = (all_yes - below_yes) / all_yes + below_no / all_no
        if right > best + 1e-12:
            best, at = right, [cut]
        elif math.isclose(right, best, abs_tol=1e-12):
            at.append(cut)
    return (at[0] + at[-1]) / 2 * BIN


def judged(pages: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, host, path, rule, score, verdict) of every row; ``score`` is null where a rule decides."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    parsed = pages.select(page_id, url).withColumns({"host": host, "path": path}).withColumns({"rule": rule, "_says": says})
    ruled = parsed.where("rule is not null")
    training = ruled.select(F.col(url), (F.col("_says") == "allow").alias("_accepted"))
    part = F.pmod(F.xxhash64(url), F.lit(HELD_OUT))
    kinds = training.agg(F.count_if("_accepted").alias("yes"), F.count_if(~F.col("_accepted")).alias("no")).first()
    open_rows = parsed.where("rule is null").select(page_id, url, "host", "path")
    if kinds.yes and kinds.no:
        ratios = stored(model(training.where(part != 0), url, "_accepted"))
        cut = threshold(scored(training.where(part == 0), ratios, url), "_accepted")
        marked = scored(open_rows, ratios, url) if ratios.head(1) else open_rows.withColumn("score", F.lit(0.0))
    else:
        cut, marked = 0.0, open_rows.withColumn("score", F.lit(0.0))
    decided = ruled.select(page_id, url, "host", "path", "rule", F.lit(None).cast("double").alias("score"), F.col("_says").alias("verdict"))
    by_model = marked.select(
        page_id, url, "host", "path", F.lit(None).cast("string").alias("rule"), "score",
        F.when(F.col("score") >= cut, "allow").otherwise("block").alias("verdict"),
    )
    return decided.unionByName(by_model)
