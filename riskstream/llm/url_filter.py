"""URL filter: host and path rules, and for urls without one the ratio of two
variable-order character Markov models.

The rules' own verdicts are the training labels: one model is fitted to the
urls the rules allow, one to those they block. An order-k probability is the
Witten-Bell mixture of the context's counts with order k - 1, down to a
uniform law, so that a context never seen costs no order but its own. A url's
score is its log-likelihood difference per symbol. Half of the judged urls (by
hash) fits the counts; over the others the threshold is chosen that keeps the
two error rates' sum smallest (ties: the lowest), then all is fixed.

Scale: the alphabet is fixed, so there are at most 31**4 grams: the model's
broadcast is bounded by that, whatever the corpus. Urls are reduced to
distinct ones without a rule before they are cut into grams; the grams of a
url are joined and summed in the task that cut them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: (host suffix, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
ORDER = 3          # symbols of context
SYMBOLS = 32       # upper bound of the alphabet after normalisation
BIN = 0.01         # width of the score bins of the threshold search
SPAN = 8.0         # scores are clamped to +-SPAN for that search
MAX_GRAMS = 31 ** (ORDER + 1)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0], r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def symbols(url: Column) -> Column:
    """The url in the model's alphabet, with its start and end marked. Letters
    are lower-cased, digits are one symbol, other characters one too."""
    s = F.translate(F.coalesce(url, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
                    "abcdefghijklmnopqrstuvwxyz" + "0" * 10)
    s = F.regexp_replace(s, r"(?s)[^a-z0./\-]", "?")
    return F.concat(F.lit("^" * ORDER), s, F.lit("$"))


def grams(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each symbol of ``sym`` with its context: (keep..., g)."""
    pos = F.explode(F.sequence(F.lit(1), F.length("sym") - ORDER)).alias("_p")
    return df.select(*keep, "sym", pos).select(
        *keep, F.expr(f"substring(sym, _p, {ORDER + 1})").alias("g"))


def fit(train: DataFrame, wanted: DataFrame) -> DataFrame:
    """train (sym, label 1/0), wanted (g) -> (g, ratio): log of the accepted
    over the rejected model's probability, for each wanted gram."""
    counts = (grams(train, "label").groupBy("g")
              .agg(F.sum("label").alias("na"), F.sum(1 - F.col("label")).alias("nr")))
    model = wanted.withColumn("pa", F.lit(1.0 / SYMBOLS)).withColumn("pr", F.lit(1.0 / SYMBOLS))
    for k in range(ORDER + 1):
        # counts of the last k + 1 symbols, and of the k before the last one
        tail = F.expr(f"substring(g, {ORDER + 1 - k}, {k + 1})")
        cut = F.expr(f"substring(g, {ORDER + 1 - k}, {k})") if k else F.lit("")
        t = counts.groupBy(tail.alias("t")).agg(F.sum("na").alias("na"), F.sum("nr").alias("nr"))
        c = (t.groupBy((F.expr(f"substring(t, 1, {k})") if k else F.lit("")).alias("c"))
             .agg(F.sum("na").alias("ca"), F.sum((F.col("na") > 0).cast("int")).alias("ta"),
                  F.sum("nr").alias("cr"), F.sum((F.col("nr") > 0).cast("int")).alias("tr")))
        model = (model.withColumn("t", tail).withColumn("c", cut)
                 .join(F.broadcast(t), "t", "left").join(F.broadcast(c), "c", "left")
                 .withColumn("pa", F.when(F.col("ca") > 0, (F.coalesce("na", F.lit(0)) + F.col("ta") * F.col("pa"))
                                          / (F.col("ca") + F.col("ta"))).otherwise(F.col("pa")))
                 .withColumn("pr", F.when(F.col("cr") > 0, (F.coalesce("nr", F.lit(0)) + F.col("tr") * F.col("pr"))
                                          / (F.col("cr") + F.col("tr"))).otherwise(F.col("pr")))
                 .select("g", "pa", "pr"))
    return model.select("g", F.log(F.col("pa") / F.col("pr")).alias("ratio"))


def score(df: DataFrame, model: DataFrame) -> DataFrame:
    """df (url, label, sym), a row for each url -> (url, label, score)."""
    return (grams(df, "url", "label").join(F.broadcast(model), "g")
            .groupBy("url", "label").agg(F.avg("ratio").alias("score")))


def threshold(scored: DataFrame) -> DataFrame:
    """(label, score) -> one row (cut): the bin edge with the smallest sum of
    the two error rates, 0 if a class is missing. At most 2 * SPAN / BIN bins
    reach the final sort."""
    b = F.floor(F.least(F.greatest("score", F.lit(-SPAN)), F.lit(SPAN)) / F.lit(BIN)).cast("int")
    bins = (scored.groupBy(b.alias("b"))
            .agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("r")))
    bins = (bins.groupBy().agg(F.sort_array(F.collect_list(F.struct("b", "a", "r"))).alias("x"))
            .select(F.posexplode("x").alias("i", "y"), "x")
            .select(F.col("y.b").alias("b"),
                    F.aggregate(F.slice("x", 1, F.col("i")), F.lit(0).cast("long"), lambda s, v: s + v["a"]).alias("below_a"),
                    F.aggregate(F.slice("x", 1, F.col("i")), F.lit(0).cast("long"), lambda s, v: s + v["r"]).alias("below_r"),
                    F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v["a"]).alias("ta"),
                    F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v["r"]).alias("tr")))
    err = F.col("below_a") / F.col("ta") + (F.col("tr") - F.col("below_r")) / F.col("tr")
    best = bins.where("ta > 0 and tr > 0").agg(F.min(F.struct(F.round(err, 12).alias("e"), "b")).alias("m"))
    return best.select(F.coalesce(F.col("m.b") * F.lit(BIN), F.lit(0.0)).alias("cut"))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """All rows and columns of ``pages`` with host, path, rule, verdict (and
    ``url_score``: null where a rule decides). The columns replace any of
    the same names. Null urls have an empty host and path and an empty url's
    score; repeated rows all stay. An empty table gives an empty result; with
    no url judged by a rule of either class the threshold is 0 and a score of
    at least that allows."""
    host, path = url_parts(F.col("url"))
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "url_score")]
    base = pages.select(*own).withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("_v", verdict)
    urls = (base.groupBy(F.coalesce("url", F.lit("")).alias("url"))
            .agg(F.first("_v").alias("_v"))
            .select("url", (F.col("_v") == "allow").cast("int").alias("label"), symbols(F.col("url")).alias("sym"),
                    (F.substring(F.md5("url"), 1, 1) < "8").alias("fits")))
    train = urls.where("label is not null and fits")
    rest = urls.where("label is null or not fits")
    model = fit(train, grams(rest).distinct())
    scored = score(rest, model)
    cut = threshold(scored.where("label is not null"))
    free = scored.where("label is null").select(F.col("url").alias("_u"), F.col("score").alias("url_score"))
    out = base.join(free, (F.coalesce("url", F.lit("")) == F.col("_u")) & F.col("_v").isNull(), "left")
    method = F.when(F.col("url_score") >= cut.scalar(), "allow").otherwise("block")
    return out.withColumn("verdict", F.coalesce("_v", method)).drop("_v", "_u")
