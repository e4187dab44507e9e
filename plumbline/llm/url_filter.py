"""URL filter: host and path rules, and link-graph propagation where no rule fits.

Rules decide first; the longest that fits wins. The hosts of urls that rules allow are
trusted seeds, those of urls that rules block are blocked seeds, weighted by their urls.
Trust follows host edges (personalised PageRank), distrust follows them backwards. Host
edges are the links of the pages to other hosts, and a host and its parent host where
both have pages. A host is blocked where more distrust than trust reaches it.

Scores are whole numbers (10**15 is all trust there is), so every engine and every
partitioning gives the same ones. Rounds go on until the scores are settled: each round
moves at most 85 % of what the last one moved, so that after the last one less than six
times SETTLED, 0.06 % of all trust, could still move. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import keep, remove

TOTAL = 10**15
DAMPING_PERCENT = 85
#: Scores are settled when a round changes them by no more than this in all.
SETTLED = TOTAL // 10**4
LINK = r"(?i)\shref\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]*)"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, rule): a rule is a host and the path's beginning.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def host_of(url: F.Column) -> F.Column:
    """Between the first :// and the next / ? # or end; empty without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: F.Column, path: F.Column, rules: tuple[tuple[str, str], ...]) -> F.Column:
    """(rule, verdict) of the longest rule that fits, else null.

    Of equally long ones the last in string order wins.
    """
    found = []
    for verdict, rule in rules:
        at, _, start = rule.partition("/")
        fits = (host == at) | host.endswith("." + at)
        fits = fits & path.startswith("/" + start)
        found.append(
            F.when(fits, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
        )
    return F.array_max(F.array_compact(F.array(*found)))


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Distinct (u, v): u's pages link to v, or one is the other's parent; both in hosts."""
    found = F.regexp_extract_all("html", F.lit(LINK), F.lit(1))
    lowered = F.transform(found, lambda x: F.translate(x, UPPER, LOWER))
    links = pages.select(F.col("host").alias("u"), F.explode(F.array_distinct(lowered)).alias("v"))
    parent = F.regexp_extract("host", r"^[^.]*\.(.*)$", 1)
    up = hosts.select(F.col("host").alias("u"), parent.alias("v"))
    both = up.union(up.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = links.union(both).filter("u <> v and u <> '' and v <> ''").distinct()
    known = hosts.select(F.col("host").alias("v"))
    return edges.join(known, "v", "left_semi").join(
        known.withColumnRenamed("v", "u"), "u", "left_semi"
    )


def host_scores(hosts: DataFrame, edges: DataFrame, settled: int = SETTLED) -> DataFrame:
    """(host, trust, distrust) from (host, trusted, blocked) counts of seed urls.

    Without edges the seeds stand as they are.
    """
    sums = hosts.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b")).first()

    def seed(count: str, total: int) -> F.Column:
        if not total:
            return F.lit(0).cast("long")
        return F.expr(f"cast(cast({count} as decimal(20, 0)) * {TOTAL} div {total} as bigint)")

    state = keep(
        hosts.select(
            "host",
            seed("trusted", sums["t"] or 0).alias("seed_t"),
            seed("blocked", sums["b"] or 0).alias("seed_b"),
        ).withColumns({"trust": F.col("seed_t"), "distrust": F.col("seed_b")})
    )
    if not edges.limit(1).count():
        return state.select("host", "trust", "distrust")
    degrees = keep(edges.groupBy(F.col("u").alias("host")).agg(F.count("*").alias("n_out")))
    into = keep(edges.groupBy(F.col("v").alias("host")).agg(F.count("*").alias("n_in")))
    flow = "bigint(({seed} * {rest} + coalesce({got}, 0) * {damping}) div 100)"
    shares = {"rest": 100 - DAMPING_PERCENT, "damping": DAMPING_PERCENT}
    moved = settled + 1
    while moved > settled:
        sent = state.join(degrees, "host", "left").join(into, "host", "left").select(
            "host", F.expr("trust div n_out").alias("t"), F.expr("distrust div n_in").alias("b")
        )
        forward = edges.join(sent, edges.u == sent.host).select(F.col("v").alias("host"), "t", F.lit(0).cast("long").alias("b"))
        back = edges.join(sent, edges.v == sent.host).select(F.col("u").alias("host"), F.lit(0).cast("long").alias("t"), "b")
        got = forward.union(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
        turned = keep(
            state.withColumnsRenamed({"trust": "old_t", "distrust": "old_b"}).join(got, "host", "left").select(
                "host", "seed_t", "seed_b", "old_t", "old_b",
                F.expr(flow.format(seed="seed_t", got="t", **shares)).alias("trust"),
                F.expr(flow.format(seed="seed_b", got="b", **shares)).alias("distrust"),
            )
        )
        moved = turned.agg(F.expr("sum(abs(trust - old_t) + abs(distrust - old_b))")).first()[0]
        remove(state)
        state = turned.drop("old_t", "old_b")
    return state.select("host", "trust", "distrust")


def judged(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rules: tuple[tuple[str, str], ...] = RULES,
    settled: int = SETTLED,
) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, trust, distrust.

    A null url, or one without ://, has an empty host and path; the empty host gets no
    score and is allowed where no rule fits. Null html has no links. Repeated rows count
    as often as they are there. Other columns are not looked at. rules is a list written
    by hand, one expression each. An empty table gives an empty one; very long pages are
    read whole. A host with as much trust as distrust is allowed.
    """
    url = F.col(url_col)
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        F.col(html_col).alias("html"),
    ).withColumn("fit", ruled(F.col("host"), F.col("path"), rules))
    verdict = F.col("fit.verdict")
    hosts = keep(
        rows.groupBy("host").agg(
            F.count_if(verdict == "allow").alias("trusted"),
            F.count_if(verdict == "block").alias("blocked"),
        )
    )
    edges = keep(host_edges(rows.select("host", "html"), hosts))
    scores = host_scores(hosts, edges, settled)
    bad = F.coalesce(F.col("distrust") > F.col("trust"), F.lit(False))
    return rows.drop("html").join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(verdict, F.when((F.col("host") != "") & bad, "block").otherwise("allow")).alias("verdict"),
        "trust",
        "distrust",
    )
