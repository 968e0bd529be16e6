"""URL rules, and trust over the graph of hosts, in native expressions only.

A page's verdict comes from the longest rule that fits its URL. Where no rule fits, its host decides: the shares of a host's
pages that rules allow and block are its trust and distrust seeds; trust spreads along links to other hosts (personalised
PageRank), distrust against them, to the hosts that link to distrusted ones; a host with more distrust than trust, and no less
than ``THRESHOLD``, is blocked. Both walks go on until what still moves can change no host's verdict, or is at most ``RESIDUAL``.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import materialised

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
RESIDUAL = 1e-6
STRIDE = 6
SQL_ROUNDS = 100
THRESHOLD = 0.5
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(after, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. A rule is ``host/path`` with allow or block."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(a, b, weight): share of the links from pages of host a to other hosts that go to b; ``pages`` has ``host``."""
    links = pages.select("host", F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))).alias("to"))
    links = links.select(F.col("host").alias("a"), F.translate("to", UPPER, LOWER).alias("b"))
    counts = links.where("a <> '' and b <> '' and a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    totals = counts.groupBy("a").agg(F.sum("n").alias("all"))
    return counts.join(totals, "a").select("a", "b", (F.col("n") / F.col("all")).alias("weight"))


def spread(seeds: DataFrame, edges: DataFrame, enough, damping: float = DAMPING) -> DataFrame:
    """(kind, host, score) for each kind of walk: score = seed + damping * scores of the hosts with an edge to it, by weight.

    ``seeds`` has kind, host and score, ``edges`` kind, a, b and weight, no more than 1 over the edges from one host. What moves
    falls by ``damping`` a round at least, so all that can still arrive anywhere is at most moving * damping / (1 - damping).
    The walk ends when ``enough`` of the scores and of that bound by kind. Every few rounds the scores are written to the
    shared folder, which bounds the plan and what a lost executor repeats.
    """
    ends = seeds.select("kind", "host").union(edges.select("kind", "a")).union(edges.select("kind", "b")).distinct()
    stay = ends.select("kind", F.col("host").alias("a"), F.col("host").alias("b"), F.lit(None).cast("double").alias("weight"))
    steps = materialised(edges.select("kind", "a", "b", "weight").unionByName(stay), "host-steps")
    state = seeds.select("kind", "host", "score", F.col("score").alias("moving"))
    while True:
        for _ in range(STRIDE):
            come = F.col("moving") * F.col("weight") * damping
            rows = state.join(steps.withColumnRenamed("kind", "of"), (F.col("kind") == F.col("of")) & (F.col("host") == F.col("a")))
            rows = rows.where("weight IS NULL OR moving > 0").select(
                "kind",
                F.col("b").alias("host"),
                F.coalesce(come, "score").alias("score"),
                F.coalesce(come, F.lit(0.0)).alias("moving"),
            )
            state = rows.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("moving").alias("moving"))
        state = materialised(state, "host-scores")
        left = {r["kind"]: r["all"] * damping / (1 - damping) for r in state.groupBy("kind").agg(F.sum("moving").alias("all")).collect()}
        if enough(state, left):
            return state.select("kind", "host", "score")


def _scores(state: DataFrame) -> DataFrame:
    """host, trust, distrust."""
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)).alias(kind)
    return state.groupBy("host").agg(of("trust"), of("distrust"))


def settled(state: DataFrame, left: dict[str, float], threshold: float = THRESHOLD, residual: float = RESIDUAL) -> bool:
    """Whether no verdict can change by what is left of both walks, or hardly anything is left."""
    more_trust, more_distrust = left.get("trust", 0.0), left.get("distrust", 0.0)
    if max(more_trust, more_distrust) <= residual:
        return True
    distrust, trust = F.col("distrust"), F.col("trust")
    stays_bad = (distrust >= threshold) & (distrust > trust + more_trust)
    stays_good = (distrust + more_distrust < threshold) | (distrust + more_distrust <= trust)
    return _scores(state).where(~(stays_bad | stays_good)).isEmpty()


def blocked_hosts(pages: DataFrame, damping: float = DAMPING, threshold: float = THRESHOLD, residual: float = RESIDUAL) -> DataFrame:
    """Hosts that the method blocks; ``pages`` has ``host``, ``ruled`` (allow, block or null) and ``html``."""
    named = pages.where("host <> ''")
    share = lambda what: F.avg(F.when(F.col("ruled") == what, 1.0).otherwise(0.0))
    by_host = materialised(named.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "host-seeds")
    edges = materialised(host_edges(named), "host-edges")
    state = by_host.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "score")).where("score > 0")
    if not edges.isEmpty():
        back = edges.groupBy("b").agg(F.sum("weight").alias("all"))
        reverse = edges.join(back, "b").select(F.lit("distrust").alias("kind"), F.col("b").alias("a"), F.col("a").alias("b"), F.col("weight") / F.col("all"))
        both = edges.select(F.lit("trust").alias("kind"), "a", "b", "weight").union(reverse)
        state = spread(state, both, lambda now, left: settled(now, left, threshold, residual), damping)
    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return _scores(state).where(bad).select("host")


def judged(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    Null urls and such without ``://`` have an empty host and path, fit no rule and are allowed; null html has no links.
    Without rows there are none. Other columns are ignored, whatever their names.
    """
    url = F.col(f"`{url_col}`")
    own = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(f"`{html_col}`").alias("html"))
    rule, ruled = fitting_rule(rules, F.col("host"), F.col("path"))
    own = own.withColumns({"rule": rule, "ruled": ruled})
    bad = blocked_hosts(own).withColumn("bad", F.lit(True))
    method = F.when(F.col("bad"), "block").otherwise("allow")
    return own.drop("html").join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"))


def rules_sql(rules: list[tuple[str, str]], column: str) -> str:
    """The same choice as a CASE expression over ``host`` and ``path``; ``column`` is rule or verdict."""
    whens = []
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, slash, rest = text.partition("/")
        value = text if column == "rule" else what
        whens.append(f"WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{slash + rest}') THEN '{value}'")
    return f"CASE {' '.join(whens)} END"


def judged_sql(rules: list[tuple[str, str]]) -> str:
    """DuckDB SQL for ``judged`` over ``pages``: both walks for ``SQL_ROUNDS`` rounds, after which 1e-7 of a seed still moves."""
    link = LINK.replace("'", "''")
    return f"""
WITH RECURSIVE u AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS (SELECT *, {rules_sql(rules, "rule")} AS rule, {rules_sql(rules, "verdict")} AS ruled FROM u),
seed AS (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS trust,
                avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS distrust FROM p WHERE host <> '' GROUP BY host),
l AS (SELECT host AS a, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS b FROM p),
c AS (SELECT a, b, count(*) AS n FROM l WHERE a <> '' AND b <> '' AND a <> b GROUP BY a, b),
e AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS w FROM c),
r AS (SELECT b AS a, a AS b, w / sum(w) OVER (PARTITION BY b) AS w FROM e),
g AS (SELECT 'trust' AS kind, a, b, w FROM e UNION ALL SELECT 'distrust', a, b, w FROM r),
walk AS (
  SELECT 0 AS i, 'trust' AS kind, host, trust AS moving FROM seed WHERE trust > 0
  UNION ALL SELECT 0, 'distrust', host, distrust FROM seed WHERE distrust > 0
  UNION ALL SELECT i + 1, walk.kind, b, sum(moving * w * {DAMPING}) FROM walk JOIN g ON walk.kind = g.kind AND host = a
  WHERE i < {SQL_ROUNDS} GROUP BY i, walk.kind, b),
bad AS (SELECT host FROM walk GROUP BY host
  HAVING sum(moving) FILTER (kind = 'distrust') >= {THRESHOLD}
     AND sum(moving) FILTER (kind = 'distrust') > coalesce(sum(moving) FILTER (kind = 'trust'), 0))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM p
"""
