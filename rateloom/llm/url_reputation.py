"""URL filter: rules on hosts and paths, else an empirical-Bayes reputation of the host. DataFrame operations only.

Labelled page outcomes (bad or not) are counted for each host. The rate of a suffix is shrunk towards that of all
pages, the rate of a registered domain towards its suffix, the rate of a host towards its domain, each by a
beta-binomial prior whose weight comes from the spread between the groups (method of moments). A page is blocked if the
lower bound of its host's posterior bad rate reaches the limit. Hosts without labels get their domain's prior.

A page's outcome comes from its own content: ``page_outcomes`` finds the labelled document whose text the page carries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import attach, save

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level names under which domains are registered, as in example.co.uk.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: More rules than these are joined as a table.
LISTED_RULES = 500


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. ``rules``: (verdict, "host/path")."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(kind)).otherwise(verdict)
    return found, verdict


def with_rules(rows: DataFrame, rules: Sequence[tuple[str, str]], listed: int = LISTED_RULES) -> DataFrame:
    """``rows`` with ``rule`` and ``rule_verdict``. A long list is joined by (parent of the host, start of the path of a rule's length)."""
    if len(rules) <= listed:
        rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
        return rows.withColumns({"rule": rule, "rule_verdict": verdict})
    split = [(kind, rule, rule.partition("/")) for kind, rule in rules]
    known = rows.sparkSession.createDataFrame([(name, slash + rest, rule, kind) for kind, rule, (name, slash, rest) in split], "name string, start string, rule string, rule_verdict string")
    lengths = sorted({len(slash + rest) for _, _, (_, slash, rest) in split})
    rows = save(rows.withColumn("_row", F.monotonically_increasing_id()), "ruled-rows")
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    tried = rows.select("_row", "path", F.explode(parents).alias("name")).select("_row", "path", "name", F.explode(F.array(*map(F.lit, lengths))).alias("n")).filter("length(path) >= n")
    found = tried.select("_row", "name", F.substring("path", 1, F.col("n")).alias("start")).join(known, ["name", "start"])
    best = found.groupBy("_row").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "rule_verdict")).alias("best"))
    return rows.join(best, "_row", "left").withColumns({"rule": F.col("best.rule"), "rule_verdict": F.col("best.rule_verdict")}).drop("_row", "best")


SPACES = r"[\x09-\x0D\x20]+"
#: Patterns and what takes their place, in this order: what is no text, tags inside words, other tags.
MARKUP = ((r"(?is)<(?:script|style|h1|nav|aside|form|footer)\b.*?</(?:script|style|h1|nav|aside|form|footer)\s*>", " "), (r"(?i)</?(?:a|b|em|i|span|strong)\b[^>]*>", ""), (r"<[^>]*>", " "))
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
ARTICLE = r"(?is)<article\b[^>]*>(.*)</article\s*>"


def folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))


def carried_text(html: Column) -> Column:
    """Text of a page's article (of the whole page, if it has none) without its heading, by patterns; white space is folded."""
    inside = F.regexp_extract(html, ARTICLE, 1)
    text = F.when(inside != "", inside).otherwise(html)
    for pattern, other in MARKUP:
        text = F.regexp_replace(text, pattern, other)
    for name, other in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(other))
    return folded(text)


def page_outcomes(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``page_id, bad``: a page is as good as the labelled documents (doc_id, quality 0/1) whose whole text is the text that it
    carries; bad is the smallest of their labels' (1 - quality), so a text that any label calls good is good. Pages whose text
    has no label, and empty texts, give no row; repeated pages give one each."""
    known = labels.filter("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # digests are made where the texts are read, so that no text is exchanged
    keys = docs.select("doc_id", folded(F.col("text")).alias("body")).filter("body != ''").select("doc_id", F.sha2("body", 256).alias("key"))
    texts = keys.join(known, "doc_id").groupBy("key").agg(F.min(1 - F.col("quality")).cast("int").alias("bad"))
    rows = save(pages.select("page_id", F.sha2(carried_text(F.col("html")), 256).alias("key")), "page-keys")
    return attach(rows, texts, "key", F.col("page_id")).filter("bad IS NOT NULL").select("page_id", "bad")


def domain_of(host: Column) -> Column:
    bare = F.regexp_replace(host, r":\d*$", "")
    two_level = F.regexp_extract(bare, rf"(?:^|\.)([^.]+\.(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})$", 1)
    return F.when(two_level != "", two_level).otherwise(F.substring_index(bare, ".", -2))


def suffix_of(domain: Column) -> Column:
    return F.regexp_replace(domain, r"^[^.]*\.", "")


def prior_weight(groups: DataFrame, mean: float) -> float:
    """Pages that a prior counts as: moment estimate from the groups' spread around ``mean``; 1 to 10,000."""
    rate = F.col("bad") / F.col("n")
    k, n, nn, s = groups.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * (rate - mean) * (rate - mean))).first()
    within, spare = mean * (1 - mean), (n or 0) - (nn or 0) / max(n or 1, 1)
    if not k or k < 2 or within <= 0 or spare <= 0:
        return 10_000.0
    between = (s - (k - 1) * within) / spare
    return 10_000.0 if between <= 0 else min(10_000.0, max(1.0, within / between - 1))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], limit: float = 0.25, z: float = 1.645, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, bad_rate, bad_rate_low``.

    ``outcomes``: (page_id, bad 0/1), any number per page or none; their mean is the page's, and a page that stands in the table more
    than once adds them once for each row. Pages without outcomes and null outcomes add nothing.
    Null urls and urls without ``://`` have empty host and path and share one reputation. Repeated rows are judged
    alike; other columns are not read; an empty table gives no rows.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = outcomes.select(F.col(outcomes.columns[0]).alias("page_id"), F.col(outcomes.columns[1]).cast("long").alias("bad")).groupBy("page_id").agg(F.avg("bad").alias("bad")).filter("bad IS NOT NULL").withColumn("n", F.lit(1))
    rows = save(rows.join(known, "page_id", "left"), "url-rows")
    hosts = rows.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"))
    hosts = save(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain"))), "hosts")
    totals = lambda over, *more: over.groupBy(*more).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains, suffixes = totals(hosts, "domain", "suffix"), totals(hosts, "suffix")
    n, bad = hosts.agg(F.sum("n"), F.sum("bad")).first()
    mean = (bad + 1) / (n + 2) if n else 0.5
    weight = {name: prior_weight(t, mean) for name, t in (("suffix", suffixes), ("domain", domains), ("host", hosts))}

    def shrunk(prior: Column, w: float) -> Column:
        return (F.col("bad") + w * prior) / (F.col("n") + w)

    suffixes = suffixes.select("suffix", shrunk(F.lit(mean), weight["suffix"]).alias("suffix_rate"))
    domains = attach(domains, suffixes, "suffix", F.col("domain")).select("domain", shrunk(F.col("suffix_rate"), weight["domain"]).alias("domain_rate"))
    hosts = attach(hosts, domains, "domain", F.col("host")).select("host", shrunk(F.col("domain_rate"), weight["host"]).alias("bad_rate"), (F.col("n") + weight["host"]).alias("seen"))
    hosts = hosts.withColumn("bad_rate_low", F.col("bad_rate") - z * F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("seen") + 1)))
    rows = with_rules(attach(rows, hosts.drop("seen"), "host", F.col("page_id")), rules)
    own = F.when(F.col("bad_rate_low") >= limit, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "bad_rate", "bad_rate_low")
