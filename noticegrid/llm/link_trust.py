"""URL filters: rules decide pages, and what they decide spreads over the links between hosts.

Pages that a rule allows give their host trust, pages that one blocks give it distrust, counted in
pages. Trust follows links (whom a trusted host links to), distrust goes against them (who links to a
blocked host); both are personalised PageRanks with the decided pages as seeds. A host whose distrust
outweighs its trust and its undecided pages is blocked, and with it those undecided pages.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrid.llm.leading import looked_up
from noticegrid.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, ROUNDS, SHARE = 0.85, 30, 0.5
SLACK = 1e-6  # rounding never decides; a host at the threshold is not blocked
# Host of a link with an address of its own; a relative one stays on its host.
LINKED_HOST = r"""(?i)<a\s[^>]*?\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>\\]+)"""


class Rule(NamedTuple):
    """``verdict`` (allow or block) for a host with its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str


# The rules of the registered query, a fixed list.
RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
)


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: str) -> Column:
    """Between the first ``://`` and the next ``/ ? #``, A-Z lowered; empty without one."""
    return lowered(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: str) -> Column:
    """After the host up to ``? #``; empty without a host part."""
    return F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def longest_rule(rules) -> Column:
    """``(size, host_size, blocks, rule, verdict)`` of the longest rule that fits ``host`` and ``path``; null where none does.

    Of equally long ones the one with the longer host wins, then a blocking one. A rule is one
    expression, so lists of some hundred rules are meant.
    """
    fits = []
    for r in rules:
        text = r.host + r.path
        mine = (F.col("host") == r.host) | F.endswith(F.col("host"), F.lit(f".{r.host}"))
        row = F.struct(
            F.lit(len(text)).alias("size"), F.lit(len(r.host)).alias("host_size"), F.lit(r.verdict == "block").alias("blocks"),
            F.lit(text).alias("rule"), F.lit(r.verdict).alias("verdict"),
        )
        fits.append(F.when(mine & F.startswith(F.col("path"), F.lit(r.path)), row))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,host_size:int,blocks:boolean,rule:string,verdict:string>")


def decided(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, ruled`` of every page; the last two are null where no rule fits."""
    cut = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of("url").alias("host"), path_of("url").alias("path"))
    return cut.withColumn("best", longest_rule(rules)).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"))


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, forth, back`` for every pair of linked hosts: its share of the links that leave
    ``src`` and of those that reach ``dst``. Links are counted, those of one host to itself do not count."""
    found = pages.select(host_of("url").alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(LINKED_HOST), 1)).alias("dst"))
    pairs = materialise(
        found.withColumn("dst", lowered(F.col("dst"))).filter((F.col("src") != F.col("dst")) & (F.col("src") != ""))
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    )
    out = pairs.groupBy("src").agg(F.sum("n").alias("out"))
    into = pairs.groupBy("dst").agg(F.sum("n").alias("into"))
    return pairs.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("out")).alias("forth"), (F.col("n") / F.col("into")).alias("back"))


def host_scores(pages: DataFrame, rules=RULES, *, damping: float = DAMPING, rounds: int = ROUNDS, share: float = SHARE, tolerance: float = 1e-6) -> DataFrame:
    """``host, allowed, blocked, undecided, trust, distrust, shut`` of every host with pages or links.

    ``trust`` and ``distrust`` are in pages and sum to the pages that rules allow and block: the walk
    of a host without a next one goes back to the seeds. ``shut``: distrust is more than ``share`` of
    distrust, trust and undecided pages. The walk ends after ``rounds`` steps, or when less than
    ``tolerance`` of all pages still moves. Each step is a written table of one row a host.
    """
    is_ruled = lambda v: F.count_if(F.coalesce(F.col("ruled") == v, F.lit(False)))
    counts = decided(pages, rules).filter("host <> ''").groupBy("host").agg(
        is_ruled("allow").alias("allowed"), is_ruled("block").alias("blocked"), F.count_if(F.col("ruled").isNull()).alias("undecided"),
    )
    links = materialise(host_links(pages))
    ends = links.select(F.col("src").alias("host"), F.lit(1).alias("leaves"), F.lit(0).alias("reached")).union(
        links.select("dst", F.lit(0), F.lit(1))
    ).groupBy("host").agg(F.max("leaves").alias("leaves"), F.max("reached").alias("reached"))
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("allowed", "blocked", "undecided", "leaves", "reached")}
    hosts = materialise(counts.join(ends, "host", "full").withColumns(filled))
    totals = hosts.agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"), F.max("leaves").alias("linked")).first()
    mass = hosts.select("host", F.col("allowed").cast("double").alias("trust"), F.col("blocked").cast("double").alias("distrust"))
    if totals.linked and (totals.allowed or totals.blocked):
        mass = walked(hosts, links, mass, totals.allowed, totals.blocked, damping, rounds, tolerance)
    weighed = hosts.join(mass, "host")
    shut = F.col("distrust") > (share + SLACK) * (F.col("distrust") + F.col("trust") + F.col("undecided"))
    return weighed.select("host", "allowed", "blocked", "undecided", "trust", "distrust", shut.alias("shut"))


def walked(hosts, links, mass, allowed: int, blocked: int, damping: float, rounds: int, tolerance: float) -> DataFrame:
    for _ in range(rounds):
        # Mass at hosts where the walk ends; two numbers come to the driver.
        lost = hosts.join(mass, "host").agg(
            F.sum(F.when(F.col("leaves") == 0, F.col("trust")).otherwise(0.0)).alias("trust"),
            F.sum(F.when(F.col("reached") == 0, F.col("distrust")).otherwise(0.0)).alias("distrust"),
        ).first()
        zero = F.lit(0.0)
        forth = links.join(mass, links["src"] == mass["host"]).select(F.col("dst").alias("host"), (F.col("trust") * F.col("forth")).alias("trust"), zero.alias("distrust"))
        back = links.join(mass, links["dst"] == mass["host"]).select(F.col("src").alias("host"), zero.alias("trust"), (F.col("distrust") * F.col("back")).alias("distrust"))
        came = forth.union(back).groupBy("host").agg(F.sum("trust").alias("trust_in"), F.sum("distrust").alias("distrust_in"))

        def after(seed: str, came_in: str, lost_mass: float, total: int) -> Column:
            restart = 1 - damping + (damping * lost_mass / total if total else 0.0)
            return F.col(seed) * F.lit(restart) + F.lit(damping) * F.coalesce(F.col(came_in), F.lit(0.0))

        before = mass.select("host", F.col("trust").alias("trust_was"), F.col("distrust").alias("distrust_was"))
        stepped = materialise(
            hosts.select("host", "allowed", "blocked").join(came, "host", "left").join(before, "host").select(
                "host", after("allowed", "trust_in", lost.trust, allowed).alias("trust"), after("blocked", "distrust_in", lost.distrust, blocked).alias("distrust"),
                "trust_was", "distrust_was",
            )
        )
        change = F.abs(F.col("trust") - F.col("trust_was")) + F.abs(F.col("distrust") - F.col("distrust_was"))
        moved = stepped.agg(F.sum(change).alias("moved")).first().moved
        mass = stepped.select("host", "trust", "distrust")
        if moved <= tolerance * (allowed + blocked):
            break
    return mass


def judged(pages: DataFrame, rules=RULES, **options) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``page_id, url, html``.

    The longest rule that fits decides; pages without one are blocked where their host is shut (see
    ``host_scores``) and allowed elsewhere. A url that is null or has no ``://`` has an empty host and
    path: no rule fits, no host shuts it. A null html has no links. Repeated rows and ids are judged
    each by itself; an empty table gives no row.
    """
    shut = materialise(host_scores(pages, rules, **options).filter("shut").select("host", "shut"))
    rows = looked_up(decided(pages, rules), shut, "host")
    method = F.when(F.col("shut"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"))
