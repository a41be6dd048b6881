"""URL verdicts: listed rules first, else the reputation of the host.

Labelled page outcomes (good or not) are counted per host.  Beta-binomial priors shrink them
level by level: a suffix towards all pages, a registered domain towards its suffix, a host
towards its domain.  The strength of each prior is estimated from the spread of the groups
of that level (method of moments).  A host passes when the lower bound of its posterior
(mean minus ``z`` standard deviations) reaches ``least``.  A host without labels
has the posterior of its domain, suffix or of all pages.

Only DataFrame and SQL functions are used.  Outcomes are aggregated before any join; one join by host
takes the verdicts to the pages, where adaptive execution splits a host that owns a large share of them.

Defined results: a null URL, or one without ``://``, has an empty host and path and is judged by
the rate of all pages; repeated pages are judged alike; a null outcome is no outcome; with no
outcomes at all the rate is 1/2, which blocks; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefield.llm.common import lower_ascii, table

# The rules of the query as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Bounds of the share of variance between groups, and the rate's bounds.
RHO = (0.0001, 0.5)
Z = 1.645
LEAST = 0.5


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def bare(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def registered_domain(host: Column) -> Column:
    """The last two labels; a single label stands for itself."""
    return F.substring_index(bare(host), ".", -2)


def suffix(host: Column) -> Column:
    return F.substring_index(bare(host), ".", -1)


def rule_column(host: Column, path: Column, rules=RULES, verdict: bool = False) -> Column:
    """The longest rule that fits, or its verdict; null where none does."""
    out = None
    for says, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        value = F.lit(says if verdict else rule_host + rule_path)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("string")


def _strength(groups: DataFrame, rate: float) -> float:
    """Prior pseudo-count of a level from the spread of its groups' rates around ``rate``."""
    row = groups.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count(F.lit(1)).alias("g"),
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.lit(rate), 2.0)).alias("spread")).first()
    n, g, var = row["n"] or 0, row["g"], rate * (1 - rate)
    free = (n - row["nn"] / n - (g - 1)) * var if n else 0.0
    rho = (row["spread"] - (g - 1) * var) / free if free > 0 else RHO[0]
    rho = min(max(rho, RHO[0]), RHO[1])
    return (1 - rho) / rho


def reputation(hosts: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """Posterior per host: ``host, n, rate, bound``.

    ``hosts`` has a row per host to be judged (``host``), ``outcomes`` a row per labelled page (``host, good``).
    """
    known = outcomes.filter("good is not null").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("bigint")).alias("good"))
    known = known.withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host"))})
    domains = known.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = known.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = total["good"] / total["n"] if total["n"] else 0.5
    by_suffix, by_domain, by_host = (_strength(level, rate) for level in (suffixes, domains, known))

    def counts(level: DataFrame, keys: list[str], tag: str) -> DataFrame:
        return level.select(*keys, F.col("n").alias(f"n_{tag}"), F.col("good").alias(f"good_{tag}"))

    def shrunk(tag: str, towards: Column, strength: float) -> Column:
        good, n = (F.coalesce(F.col(f"{c}_{tag}"), F.lit(0)) for c in ("good", "n"))
        return (good + F.lit(strength) * towards) / (n + F.lit(strength))

    out = (
        hosts.select("host").distinct()
        .withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host"))})
        .join(counts(suffixes, ["suffix"], "s"), "suffix", "left")
        .join(counts(domains, ["domain", "suffix"], "d"), ["domain", "suffix"], "left")
        .join(counts(known, ["host"], "h"), "host", "left")
    )
    out = out.withColumn("rate_s", shrunk("s", F.lit(rate), by_suffix))
    out = out.withColumn("rate_d", shrunk("d", F.col("rate_s"), by_domain))
    out = out.withColumn("rate", shrunk("h", F.col("rate_d"), by_host))
    weight = F.coalesce(F.col("n_h"), F.lit(0)) + F.lit(by_host)
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (weight + 1))
    return out.select("host", F.coalesce("n_h", F.lit(0)).alias("n"), "rate", (F.col("rate") - F.lit(z) * spread).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, z: float = Z, least: float = LEAST, id_col: str = "page_id") -> DataFrame:
    """``page_id, host, path, rule, verdict, rate, bound`` for every page.

    ``outcomes`` has ``page_id`` and ``good`` (boolean) for labelled pages.
    """
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labelled = parsed.join(outcomes.select("page_id", "good"), "page_id").select("host", "good")
    judged = parsed.join(reputation(parsed, labelled, z), "host", "left")
    host, path = F.col("host"), F.col("path")
    own = F.when(F.col("bound") >= F.lit(least), "allow").otherwise("block")
    return judged.select(
        "page_id", "host", "path", rule_column(host, path, rules).alias("rule"),
        F.coalesce(rule_column(host, path, rules, verdict=True), own).alias("verdict"), "rate", "bound")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged; a page is good when the label of its id says quality 1 and toxic 0."""
    labels = table(spark, sf_dir, "labels").filter("doc_id is not null").groupBy("doc_id").agg(
        F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    outcomes = labels.select(F.col("doc_id").alias("page_id"), "good")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
with p as (
    select page_id,
           translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
    from pages),
l as (select doc_id, min(case when quality = 1 and toxic = 0 then 1 when quality is not null and toxic is not null then 0 end) as good
      from labels where doc_id is not null group by doc_id),
q as (select *, list_aggregate(string_split(bare, '.')[-2:], 'string_agg', '.') as domain, string_split(bare, '.')[-1] as suffix
      from (select *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as bare from p)),
h as (select host, any_value(domain) as domain, any_value(suffix) as suffix, count(*)::double as n, sum(good)::double as good
      from q join l on page_id = doc_id where good is not null group by host),
d as (select domain, suffix, sum(n) as n, sum(good) as good from h group by all),
s as (select suffix, sum(n) as n, sum(good) as good from h group by all),
r as (select coalesce(sum(good) / nullif(sum(n), 0), 0.5) as rate from s),
m as (select lev, count(*) as g, sum(n) as n, sum(n * n) as nn, sum(n * (good / n - rate) ** 2) as spread, any_value(rate * (1 - rate)) as v
      from (select 's' as lev, n, good from s union all select 'd', n, good from d union all select 'h', n, good from h), r group by lev),
k as (select lev, (1 - rho) / rho as k from (
        select lev, least(greatest(case when (n - nn / n - (g - 1)) * v > 0 then (spread - (g - 1) * v) / ((n - nn / n - (g - 1)) * v) else 0.0001 end,
                                   0.0001), 0.5) as rho from m)),
c as (select coalesce(max(k) filter (lev = 's'), 9999) as ks, coalesce(max(k) filter (lev = 'd'), 9999) as kd,
             coalesce(max(k) filter (lev = 'h'), 9999) as kh from k),
x as (select q.page_id, q.host, q.path, coalesce(h.n, 0) as n, coalesce(h.good, 0) as good, kh,
             (coalesce(d.good, 0) + kd * ((coalesce(s.good, 0) + ks * rate) / (coalesce(s.n, 0) + ks))) / (coalesce(d.n, 0) + kd) as rate_d
      from q cross join r cross join c left join h on h.host = q.host
      left join d on d.domain = q.domain and d.suffix = q.suffix left join s on s.suffix = q.suffix),
y as (select *, (good + kh * rate_d) / (n + kh) as rate from x),
z as (select *, case
        when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
        when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
        when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
        when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
        when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end as rule from y)
select page_id, host, path, rule, case when rule in ('www.example.com/en/', 'com/') then 'allow' when rule is not null then 'block'
       when rate - 1.645 * sqrt(rate * (1 - rate) / (n + kh + 1)) >= 0.5 then 'allow' else 'block' end as verdict
from z
"""
