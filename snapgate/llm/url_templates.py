"""URL filter: explicit rules first, then the purity of path templates.

Every host has a tree of path segments. Level by level, segments that vary become a
wildcard. A template's labels are the pages that an explicit rule decides; templates whose
share of allowed pages does not differ from that of their host by a test of proportions are
merged with the host's, others stand alone. A template is rejected when its smoothed purity
is below one half. Only Spark functions run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgate.llm.common import ascii_lower, stored


@dataclass(frozen=True)
class Rule:
    """``verdict`` for pages of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
FANOUT = 8       # a level with more children than this may be variable,
VARIED = 0.5     # if children are more than this share of its distinct paths
SIMILAR = 3.84   # squared z below which two shares do not differ (95 %)
SMOOTHING = 2.0  # pages' worth of the overall share added to each template
KEEP = 0.5       # purity from which a template is allowed
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as ``struct<text, verdict>``; NULL if none does.

    Of rules of one length the first given wins.
    """
    found = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):  # later ones are asked first
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(
            path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.text).alias("text"),
                                      F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def path_templates(paths: DataFrame) -> DataFrame:
    """Distinct ``paths`` (``host``, ``path``, ...) with their ``template``.

    At each level of a host's tree, a segment with a digit is variable, and so are all
    children of a node that has more than ``FANOUT`` of them if they are more than
    ``VARIED`` of its distinct paths, however often pages repeat. An extension is kept: ``12.html`` becomes ``*.html``. Trailing
    slashes do not matter.
    """
    at = paths.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn(
        "template", F.lit(""))
    depth = at.agg(F.coalesce(F.max(F.size("segments")), F.lit(0))).first()[0]
    for level in range(depth):
        at = at.withColumn("segment", F.get("segments", F.lit(level)))
        here = at.where("segment IS NOT NULL").groupBy("host", "template", "segment").agg(
            F.count("*").alias("n"))
        nodes = here.groupBy("host", "template").agg(
            F.count("*").alias("children"), F.sum("n").alias("n")).where(
            f"children > {FANOUT} AND children > {VARIED} * n").select(
            "host", "template", F.lit(True).alias("varied"))
        stem = F.regexp_extract("segment", r"(\.[A-Za-z]+)$", 1)
        step = F.when(F.coalesce("varied", F.lit(False)) | F.rlike("segment", F.lit("[0-9]")),
                      F.concat(F.lit("*"), stem)).otherwise(F.col("segment"))
        at = at.join(nodes, ["host", "template"], "left").withColumn(
            "template", F.concat("template", F.coalesce(F.concat(F.lit("/"), step), F.lit(""))))
        at = at.drop("segment", "varied")
        if level % 4 == 3:
            at = stored(at, "url-tree")
    return at.drop("segments")


def judge(df: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule``, ``verdict``, ``template`` and ``purity``.

    A NULL url or one without ``://`` has an empty host and path and is judged like a page
    of the host "". Hosts or templates without a labelled page take the overall share of
    allowed pages, and without any labelled page at all everything is allowed. Repeated rows
    are judged alike and each counts as a page; columns of these names are replaced; an
    empty table gives no rows.

    Pages are folded to distinct paths before anything is joined, so a hot host is partial
    sums; joins back are on host and path, or host and template.
    """
    names = ("host", "path", "rule", "verdict", "template", "purity")
    base = df.drop(*names).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    base = base.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    paths = base.groupBy("host", "path").agg(
        F.count_if(F.col("fit.verdict") == "allow").alias("good"),
        F.count_if(F.col("fit").isNotNull()).alias("labelled"))
    paths = stored(path_templates(paths), "url-templates")
    own = paths.groupBy("host", "template").agg(
        F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
    hosts = own.groupBy("host").agg(
        F.sum("good").alias("host_good"), F.sum("labelled").alias("host_labelled"))
    overall = hosts.agg(F.sum("host_good").alias("all_good"), F.sum("host_labelled").alias("all_labelled"))
    # Squared z of the template against the rest of its host.
    rest_n = F.col("host_labelled") - F.col("labelled")
    pooled = F.try_divide("host_good", "host_labelled")
    gap = F.try_divide("good", "labelled") - F.try_divide(F.col("host_good") - F.col("good"), rest_n)
    spread = pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), "labelled") + F.try_divide(F.lit(1.0), rest_n))
    z2 = F.try_divide(gap * gap, spread)
    differs = (F.col("labelled") > 0) & (rest_n > 0) & (pooled > 0) & (pooled < 1) & (z2 > SIMILAR)
    prior = F.coalesce(F.try_divide("all_good", "all_labelled"), F.lit(1.0))
    split = own.join(hosts, "host").withColumn("differs", F.coalesce(differs, F.lit(False)))
    # Templates like their host share one pool, which leaves out those that stand alone.
    pool = split.where("NOT differs").groupBy("host").agg(
        F.sum("good").alias("pool_good"), F.sum("labelled").alias("pool_labelled"))
    judged = split.join(pool, "host", "left").join(F.broadcast(overall)).select(
        "host", "template",
        ((F.when(F.col("differs"), F.col("good")).otherwise(F.col("pool_good")) + SMOOTHING * prior)
         / (F.when(F.col("differs"), F.col("labelled")).otherwise(F.col("pool_labelled"))
            + SMOOTHING)).alias("purity"))
    by_path = paths.join(judged, ["host", "template"]).select("host", "path", "template", "purity")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("purity") >= KEEP, "allow").otherwise("block"))
    return base.join(by_path, ["host", "path"]).select(
        *[F.col(f"`{c}`") for c in df.columns if c not in names],
        "host", "path", F.col("fit.text").alias("rule"), verdict.alias("verdict"), "template", "purity")
