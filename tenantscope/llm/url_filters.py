"""Operator 4: URL verdicts from rules and link-graph propagation.

All of it is DataFrame and SQL functions. A url's longest fitting rule decides
it. Other urls are decided by their host: trust starts at hosts with allowed
urls and flows along links (personalised PageRank); distrust starts at hosts
with blocked urls and flows against them, because who links to a blocked host
shares in its blame. A host whose share of distrust reaches the threshold is
blocked.

Links are the absolute and protocol-relative ``href`` and ``src`` values of the
pages, reduced to distinct host pairs before any join. Ranks are one row per
host and kind; one iteration is an equi-join and a sum. Rounds go on until no
host is new and no rank moves any more, however long the paths are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenantscope.session import shared_path

#: (verdict, host, path): the rules of the registered query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DAMPING = 0.85
#: Rounds of the SQL, which cannot stop by itself.
ITERATIONS = 10
#: Ranks have settled when none changes by more than this share of itself in
#: ``ROUNDS`` rounds, after which they are compared.
TOLERANCE, ROUNDS = 1e-6, 5
#: A rank that a host has got is never less (no double falls to 0 on long paths).
RANK_LEAST = 1e-300
#: A host is blocked when distrust makes up at least this share of its scores.
THRESHOLD = 0.75
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits (null: none).
    Equal lengths: the rule listed first."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct links between different hosts: ``src, dst``."""
    found = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)\s(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)"""), F.lit(1))
    hosts = F.array_distinct(F.transform(found, lambda u: url_host(F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("x:"), u)).otherwise(u))))
    src = url_host(F.col("url"))
    links = pages.where("url is not null and html like '%//%'").select(src.alias("src"), F.explode(hosts).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").distinct()


def propagate(links: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank of two kinds at once. ``seeds``: ``kind, host,
    seed`` (weights sum to 1 per kind); trust flows from src to dst, distrust
    from dst to src, each host dividing what it has among its links. Ends when
    all ranks have settled (``tolerance``). Returns ``kind, host, rank``."""
    path = shared_path(links.sparkSession, "host-graph")
    flows = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to")) \
        .unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to")))
    degree = flows.groupBy("kind", "host").agg(F.count("*").alias("degree"))
    flows.join(degree, ["kind", "host"]).write.parquet(f"{path}/flows")
    seeds.write.parquet(f"{path}/seeds")
    flows, seeds = (links.sparkSession.read.parquet(f"{path}/{t}") for t in ("flows", "seeds"))
    rank = seeds.withColumnRenamed("seed", "rank")
    start = seeds.select("kind", "host", ((1 - damping) * F.col("seed")).alias("rank"))
    while True:
        before = rank.withColumnRenamed("rank", "was")
        for _ in range(ROUNDS):
            moved = flows.join(rank, ["kind", "host"]).select(
                "kind", F.col("to").alias("host"), (damping * F.col("rank") / F.col("degree")).alias("rank"))
            rank = moved.unionByName(start).groupBy("kind", "host").agg(F.greatest(F.sum("rank"), F.lit(RANK_LEAST)).alias("rank"))
        rank = rank.checkpoint()
        # A host once reached stays reached, so the new ranks have all hosts.
        moves = F.col("was").isNull() | (F.abs(F.col("rank") - F.col("was")) > tolerance * F.col("rank"))
        if not rank.join(before, ["kind", "host"], "left").agg(F.count_if(moves).alias("n")).first()["n"]:
            return rank


def judge_urls(pages: DataFrame, rules=RULES, *, threshold: float = THRESHOLD, damping: float = DAMPING,
               tolerance: float = TOLERANCE) -> DataFrame:
    """Verdict of every url: ``page_id, host, path, rule, verdict, distrust``.

    ``rule`` is the longest fitting rule as host and path, else null;
    ``verdict`` is ``allow`` or ``block``, the rule's, else the host's.
    ``distrust`` is the host's share of distrust (null where no score reaches
    the host, which allows it). Null urls and urls without ``://`` have empty
    host and path and are allowed; null html has no links; repeated rows are
    judged each for itself and weigh as often; an empty table gives no row.
    Other columns are ignored.
    """
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    urls = urls.withColumn("m", matching_rule(F.col("host"), F.col("path"), rules)) \
        .select("page_id", "host", "path", "m.rule", "m.verdict")
    ruled = urls.where("verdict is not null and host <> ''").groupBy("host", "verdict").agg(F.count("*").alias("n"))
    kind = F.when(F.col("verdict") == "allow", "trust").otherwise("distrust")
    total = ruled.groupBy("verdict").agg(F.sum("n").alias("total"))
    seeds = ruled.join(total, "verdict").select(kind.alias("kind"), "host", (F.col("n") / F.col("total")).alias("seed"))
    rank = propagate(host_links(pages), seeds, damping=damping, tolerance=tolerance)
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0))
    score = rank.groupBy("host").agg((of("distrust") / (of("trust") + of("distrust"))).alias("distrust"))
    own = F.when(F.col("distrust") >= threshold, "block").otherwise("allow")
    return urls.join(score, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "distrust")


def op4_url_filters(pages: DataFrame) -> DataFrame:
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    rules = "".join(f"""
      WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'"""
                    for v, h, p in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2])))
    host = lambda u: f"translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
    steps = "".join(f""",
r{i + 1} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (
    SELECT f.kind, f.dst AS host, {DAMPING} * r.rank / f.degree AS rank FROM flows f JOIN r{i} r USING (kind, host)
    UNION ALL SELECT kind, host, (1 - {DAMPING}) * rank FROM r0) GROUP BY kind, host)""" for i in range(ITERATIONS))
    return f"""
WITH u0 AS (
  SELECT page_id, html, coalesce({host('url')}, '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
u AS MATERIALIZED (SELECT *, CASE {rules} END AS m FROM u0),
links AS (
  SELECT DISTINCT src, dst FROM (
    SELECT host AS src, {host("CASE WHEN starts_with(l, '//') THEN 'x:' || l ELSE l END")} AS dst FROM (
      SELECT host, unnest(regexp_extract_all(html, '(?i)\\s(?:href|src)\\s*=\\s*["'']?\\s*((?:https?:)?//[^\\s"''<>]+)', 1)) AS l FROM u))
  WHERE src <> '' AND dst <> '' AND src <> dst),
both_ways AS (SELECT 'trust' AS kind, src AS host, dst FROM links UNION ALL SELECT 'distrust', dst, src FROM links),
flows AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY kind, host) AS degree FROM both_ways),
r0 AS MATERIALIZED (
  SELECT CASE WHEN m LIKE 'allow %' THEN 'trust' ELSE 'distrust' END AS kind, host,
         count(*) / sum(count(*)) OVER (PARTITION BY m LIKE 'allow %') AS rank
  FROM u WHERE m IS NOT NULL AND host <> '' GROUP BY host, m LIKE 'allow %', kind){steps},
score AS (
  SELECT host, coalesce(sum(rank) FILTER (kind = 'distrust'), 0) / sum(rank) AS distrust FROM r{ITERATIONS} GROUP BY host)
SELECT page_id, u.host AS host, path, substring(m, 7) AS rule,
       CASE WHEN m IS NOT NULL THEN substring(m, 1, 5) WHEN distrust >= {THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN score s ON u.host = s.host"""


ORACLE = _oracle()
