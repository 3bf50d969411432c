"""URL filter by empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (bad or not) are counted per host, and shrunk through
beta-binomial priors: the corpus is the prior of a public suffix, a suffix
that of its registered domains, a domain that of its hosts. The strength of
each level's prior is fitted by moments from the spread of its children. A
host is blocked if the lower posterior bound of its bad-page rate exceeds a
limit, so a handful of bad pages cannot block a host whose domain is clean.
Explicit rules come before reputation; the longest fitting rule wins.

Counts are partial aggregates, so a host with a third of all pages is reduced
in each map task; page bodies are read once and never shuffled.

Defined results: a null url, or one without ``://``, has empty host and path
and is judged by the rules alone; pages without an outcome add no evidence; a
corpus without outcomes allows everything no rule blocks; repeated rows count
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

#: (verdict, rule): a rule is a host and a path prefix.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Second-level labels that belong to the public suffix, as in co.uk.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Words of a host or path, between other characters than letters, that name what training data should not come from.
BAD_WORDS = ("ad", "ads", "adult", "bet", "bets", "betting", "casino", "crack", "escort", "gambling", "lottery", "malware", "payday", "phishing", "pill", "pills", "poker", "porn", "sex", "spam", "torrent", "tracker", "track", "viagra", "warez", "xxx")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(name: Column) -> Column:
    labels = F.split(name, r"\.")
    n = F.size(labels)
    two = (n >= 3) & F.element_at(labels, -2).isin(*SECOND_LEVEL) & (F.length(F.element_at(labels, -1)) == 2)
    return F.when(two, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).otherwise(F.element_at(labels, -1))


def domain_of(name: Column) -> Column:
    """The suffix and the label before it; addresses and bare names stand for themselves."""
    labels = F.split(name, r"\.")
    keep = F.size(F.split(suffix_of(name), r"\.")) + 1
    whole = (F.size(labels) <= keep) | name.rlike(r"\A[0-9.]+\z") | name.contains("[")
    return F.when(whole, name).otherwise(F.array_join(F.slice(labels, F.size(labels) - keep + 1, keep), "."))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as text; null if none does. Of equal lengths the first listed wins."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def bad_words_pattern(words=BAD_WORDS) -> str:
    return "(?:^|[^a-z])(?:" + "|".join(words) + ")(?:[^a-z]|$)"


def page_is_bad(html: Column, url: Column, min_words: int = 20, max_marked: float = 0.3, words=BAD_WORDS) -> Column:
    """A weak page outcome from the page itself: 1 if its host or path names a listed word, or its visible text is very short or mostly symbol runs and shouting."""
    seen = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<(?:script|style)\b.*?</(?:script|style)\s*>|<[^>]*>", " ")
    n = F.regexp_count(seen, F.lit(r"\S+"))
    marked = F.regexp_count(seen, F.lit(r"[#*$%|!]{2,}|(?:&amp;){2,}"))
    named = F.concat(host_of(url), F.lower(path_of(url))).rlike(bad_words_pattern(words))
    return F.when(named | (n < min_words) | (marked > max_marked * n), 1).otherwise(0)


def _level(children: DataFrame, parent: str, prior: DataFrame, name: str, max_strength: float, few: int = 1) -> DataFrame:
    """Posterior means of ``parent`` groups and the strength with which they pull their children.

    ``prior`` has the mean and strength that stand above ``parent``; moments:
    with rates p_c of children of n_c pages around the mean m, the between
    variance is v = sum(n_c (p_c - m)^2 - m (1 - m)) / sum(n_c), and the
    strength m (1 - m) / v - 1. A group of at most ``few`` children with
    outcomes has nothing to add to them, so it passes on what stands above.
    """
    t = children.groupBy(parent).agg(F.sum("bad").alias("b"), F.sum("n").alias("k"), F.sum(F.when(F.col("n") > 0, F.col("bad") * F.col("bad") / F.col("n")).otherwise(0.0)).alias("bb"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("c"))
    t = t.join(prior, prior.columns[0]) if prior.columns[0] in t.columns else t.crossJoin(prior)
    mean = (F.col("b") + F.col("up_mean") * F.col("up_pull")) / (F.col("k") + F.col("up_pull"))
    t = t.withColumn("mean", mean)
    q = F.col("mean") * (1 - F.col("mean"))
    spread = F.col("bb") - 2 * F.col("mean") * F.col("b") + F.col("mean") * F.col("mean") * F.col("k") - F.col("c") * q
    pull = F.when((F.col("k") > 0) & (spread > 0), F.least(F.lit(max_strength), F.greatest(F.lit(2.0), q * F.col("k") / spread - 1))).otherwise(F.lit(max_strength))
    alone = F.col("c") <= few
    return t.select(F.col(parent), F.when(alone, F.col("up_mean")).otherwise(F.col("mean")).alias(f"{name}_mean"), F.when(alone, F.col("up_pull")).otherwise(pull).alias(f"{name}_pull"))


def reputation(outcomes: DataFrame, max_strength: float = 50.0, z: float = 1.645) -> DataFrame:
    """Per host: ``host, n, bad, prior_mean, prior_strength, mean, lower, upper, corpus_upper``.

    ``outcomes`` has ``host`` and ``bad`` (1, 0 or null, if unlabelled). Bounds
    are the posterior mean and ``z`` standard deviations of the beta posterior.
    ``corpus_upper`` is the upper bound of the corpus's prior of hosts.
    """
    hosts = outcomes.groupBy("host").agg(F.sum(F.coalesce("bad", F.lit(0))).cast("double").alias("bad"), F.count("bad").cast("double").alias("n"))
    name = F.regexp_replace("host", r":[0-9]*\z", "")
    hosts = hosts.select("host", "bad", "n", domain_of(name).alias("domain"), suffix_of(name).alias("suffix"))
    hosts = materialise(hosts, "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    flat = hosts.sparkSession.range(1).select(F.lit(0.5).alias("up_mean"), F.lit(2.0).alias("up_pull"))
    root = _level(suffixes.withColumn("all", F.lit(1)), "all", flat, "root", max_strength, 0).select(F.col("root_mean").alias("up_mean"), F.col("root_pull").alias("up_pull"))
    by_suffix = _level(domains, "suffix", root, "suffix", max_strength)
    above = domains.select("domain", "suffix").join(by_suffix, "suffix").select("domain", F.col("suffix_mean").alias("up_mean"), F.col("suffix_pull").alias("up_pull"))
    by_domain = _level(hosts, "domain", above, "domain", max_strength)
    corpus = _level(hosts.withColumn("all", F.lit(1)), "all", flat, "corpus", max_strength, 0)
    m, pull = F.col("corpus_mean"), F.col("corpus_pull")
    corpus = corpus.select(F.least(F.lit(1.0), m + z * F.sqrt(m * (1 - m) / (pull + 1))).alias("corpus_upper"))
    # one row
    r = hosts.join(by_domain, "domain").crossJoin(F.broadcast(corpus))
    a, b = F.col("bad") + F.col("domain_mean") * F.col("domain_pull"), F.col("n") - F.col("bad") + (1 - F.col("domain_mean")) * F.col("domain_pull")
    r = r.withColumn("a", a).withColumn("b", b).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("a") + F.col("b") + 1))
    return r.select("host", "n", "bad", F.col("domain_mean").alias("prior_mean"), F.col("domain_pull").alias("prior_strength"), "mean", F.greatest(F.lit(0.0), F.col("mean") - z * sd).alias("lower"), F.least(F.lit(1.0), F.col("mean") + z * sd).alias("upper"), "corpus_upper")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", bad: Column | None = None, rules=RULES, least: float = 0.3) -> DataFrame:
    """One row per page: ``id, host, path, rule, verdict, bad_rate_lower``.

    ``bad`` is the page's labelled outcome, by default the weak label that
    ``page_is_bad`` reads from ``html`` and the url. A host is blocked if the
    lower bound of its rate is above ``least`` and above what the corpus's
    prior of hosts explains.
    """
    bad = page_is_bad(F.col("html"), F.col(url_col)) if bad is None else bad
    rows = materialise(pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), bad.cast("int").alias("bad")), "pages")
    rep = materialise(reputation(rows).select("host", "lower", "corpus_upper"), "reputation")
    out = rows.join(rep, "host", "left").withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    of_rule = F.lit(None).cast("string")
    for verdict, rule in rules:
        of_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(of_rule)
    by_host = F.when((F.col("host") != "") & (F.col("lower") > F.greatest(F.lit(least), F.col("corpus_upper"))), "block").otherwise("allow")
    return out.select("id", "host", "path", "rule", F.coalesce(of_rule, by_host).alias("verdict"), F.col("lower").alias("bad_rate_lower"))
