"""URL filters: rules by host and path, and an empirical-Bayes reputation of hosts (operator 6, native).

Reputation: labelled page outcomes (bad or not) are counted by host, pre-aggregated before any
shuffle. The bad rate of a suffix is shrunk to the rate of all pages, that of a registered
domain to its suffix, that of a host to its domain; the strength of each prior comes from the
spread between the children by the method of moments. A host is blocked if the lower bound of its
posterior bad rate is above ``LIMIT``: an unknown or barely known host never is, and where
hosts do not differ, so that all are shrunk to one rate, none is.

Names: the reputation of a host is that of its name, without user, port and a dot at the end. The
suffix of a name is what ``SUFFIXES`` lists, else its last label; its registered domain is one
label more. An address (IPv4, or IPv6 in brackets) is a domain of its own under one suffix for all.

Rules: a rule fits its host and all subdomains if the url's path starts with the rule's; the
longest rule that fits decides before any reputation.

Defined results: a null url, or one without ``://``, has empty host and path; it fits no rule
and the empty host is judged like any other. Repeated pages are judged one by one; an outcome
counts as often as its page is there. No labels at all: nothing is blocked by reputation. An empty
table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.store import settle

#: (rule, verdict); a rule is a host, then a path from its first slash.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
LIMIT = 0.5
Z = 1.645
STRENGTH = (1.0, 1000.0)
# Public suffixes of two labels, under which names are registered by anyone.
SUFFIXES = (
    "co.uk", "org.uk", "me.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "org.nz", "ac.nz", "govt.nz",
    "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp", "co.kr", "or.kr", "go.kr", "com.cn", "net.cn", "org.cn", "edu.cn", "gov.cn", "com.tw", "org.tw", "com.hk", "org.hk",
    "co.in", "net.in", "org.in", "ac.in", "gov.in", "com.sg", "com.my", "co.id", "or.id", "co.th", "com.vn", "com.ph", "com.pk", "com.bd",
    "com.br", "net.br", "org.br", "gov.br", "com.ar", "com.mx", "org.mx", "com.co", "com.pe", "com.ve", "com.ec", "com.uy",
    "co.za", "org.za", "co.ke", "com.ng", "com.eg", "com.gh", "com.tr", "org.tr", "co.il", "org.il", "ac.il", "com.sa", "com.ua", "com.pl", "com.pt", "com.es", "com.gr", "com.cy", "com.mt", "co.at", "or.at", "co.hu",
    "blogspot.com", "wordpress.com", "tumblr.com", "github.io", "gitlab.io", "netlify.app", "vercel.app", "web.app", "herokuapp.com",
)
ADDRESS = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, slash, rest = text.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def name_of(host: Column) -> Column:
    """What a host is known by: no user, no port, no dot at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.$", "")


def suffix_of(name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(ADDRESS), F.lit("address")).when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registered domain: the suffix and one label more, or all there is."""
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(ADDRESS), name).when(two.isin(*suffixes), F.substring_index(name, ".", -3)).otherwise(two)


def _strength(children: DataFrame, parent: list[str]) -> DataFrame:
    """The prior strength that the spread of children around their parents tells; one row."""
    own = children.groupBy(*parent).agg(F.sum("n").alias("pn"), F.sum("k").alias("pk"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"), F.count("*").alias("c"))
    p = F.col("pk") / F.col("pn")
    spread = F.col("kk") - F.col("pk") * F.col("pk") / F.col("pn")
    even = p * (1 - p)
    sums = own.agg(
        F.sum(spread - even * (F.col("c") - 1)).alias("over"),
        F.sum(even * (F.col("pn") - F.col("nn") / F.col("pn") - (F.col("c") - 1))).alias("room"),
    )
    rho = F.least(F.greatest(F.coalesce(F.when(F.col("room") > 0, F.col("over") / F.col("room")), F.lit(0.0)), F.lit(1 / (1 + STRENGTH[1]))), F.lit(1 / (1 + STRENGTH[0])))
    return sums.select((1 / rho - 1).alias("m"))


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, bad) outcomes to (host, n, k, mean, low): the posterior bad rate and its lower bound, by ``name_of`` hosts."""
    hosts = outcomes.where("bad is not null").groupBy(name_of(F.col("host")).alias("host")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("k"))
    hosts = settle(hosts.select("*", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")), "url-hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0.0)).alias("k"))
    # four numbers, from one row each
    base = whole.select(((F.col("k") + 1) / (F.col("n") + 2)).alias("p")).first()["p"]
    m = [_strength(x, by).first()["m"] or STRENGTH[1] for x, by in ((suffixes, []), (domains, ["suffix"]), (hosts, ["domain"]))]
    shrunk = lambda k, n, mean, w: (F.col(k) + w * mean) / (F.col(n) + w)
    top = suffixes.select("suffix", shrunk("k", "n", F.lit(base), m[0]).alias("suffix_mean"))
    middle = domains.join(top, "suffix").select("domain", shrunk("k", "n", F.col("suffix_mean"), m[1]).alias("domain_mean"))
    low = hosts.join(middle, "domain").select("host", "n", "k", shrunk("k", "n", F.col("domain_mean"), m[2]).alias("mean"))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + m[2] + 1))
    return settle(low.select("*", (F.col("mean") - Z * sd).alias("low")), "url-reputation")


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """(page_id, url) and (host, bad) to page_id, host, path, rule, verdict, bad_rate, bad_rate_low."""
    at = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    ranks = reputation(outcomes).select(F.col("host").alias("name"), F.col("mean").alias("bad_rate"), F.col("low").alias("bad_rate_low"))
    out = at.select("*", rule.alias("rule"), says.alias("says"), name_of(F.col("host")).alias("name")).join(ranks, "name", "left")
    own = F.when(F.col("bad_rate_low") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("says", own).alias("verdict"), "bad_rate", "bad_rate_low")


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes (host, bad) of the pages whose document, the number in the url's path, has a label."""
    number = F.try_to_number(F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html)?/?$", 1), F.lit("999999999999999999")).cast("long")
    at = pages.select(host_of(F.col("url")).alias("host"), number.alias("doc_id")).where("doc_id is not null")
    bad = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return at.join(bad, "doc_id").select("host", "bad")
