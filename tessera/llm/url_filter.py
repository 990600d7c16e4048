"""URL filter by a path-template tree.

Per host, the path is a branch of a tree of segments, built level by level from the labelled urls. Segments with digits, and very
long ones, are variable and become the wildcard `*`. A branch keeps its name if its share of bad urls differs from that of the other
branches of its node (a two-proportion test); branches that say statistically the same, or have too few labels to tell, are
merged under the wildcard. A node whose labels all say the same, or are too few to be told apart, is not split further: its
template ends in `/**`, which stands for all paths below. The depth follows from the labels alone, and so does the number of branches.

A template's purity is its share of bad urls, smoothed towards the share of its host and that towards the share of all, so
a host without labels has the share of all; a template whose purity passes a threshold is rejected.

Counts are gathered by (host, node, segment) in partial aggregates, and what they decide is looked up by a broadcast of checked size or a salted
join, so a host, template or url with a third of all rows is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import checkpoint, looked_up

#: Words of a url that mark it as bad, as a source of labels.
BAD_WORDS = ["adult", "ads", "bets", "casino", "pills", "porn", "spam", "xxx"]
#: Segments that vary: those with digits and those of over 40 characters.
VARIABLE = r"[0-9]|^.{41,}$"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_host_and_path(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """`host` (A-Z lower-cased) and `path` of each url; both empty for null and where `://` is missing."""
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.lit(2**31 - 1))).otherwise("")
    return urls.withColumns({"host": ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def rule_column(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does. rules: (verdict, host, path)."""
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def word_labels(urls: DataFrame, rules: list[tuple[str, str, str]]) -> Column:
    """Labels where no others are known, of the urls that no rule fits: 1 where a word of BAD_WORDS stands in the host's name or the path, else
    0, as nothing speaks against them. Urls that a rule decides are no evidence on others and have none."""
    words = F.split(ascii_lower(F.concat_ws("/", "host", "path")), "[^a-z]+")
    bad = F.arrays_overlap(words, F.array(*map(F.lit, BAD_WORDS)))
    return F.when(rule_column(rules)[1].isNull(), bad.cast("int"))


def path_templates(urls: DataFrame, *, least_known: int = 4, alike_z: float = 1.64) -> DataFrame:
    """`urls`, which has host, path and `bad` (0, 1 or null), with template.

    A branch with fewer than `least_known` labels, or a test value of at most `alike_z`, is merged under the wildcard; a node with
    fewer than twice as many labels, or labels of one kind, ends in `/**`. One or two small jobs for each level on which labels differ.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = urls.withColumns({"__seg": segments, "__at": F.lit(""), "__live": F.lit(True), "__more": F.lit(False)})
    level = 0
    while True:
        own = F.get("__seg", F.lit(level))
        rows = rows.withColumn("__own", F.when(F.col("__live"), F.when(own.rlike(VARIABLE), "*").otherwise(own)))
        stats = rows.where("__live").groupBy("host", "__at", "__own").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("b"), F.count("bad").alias("k"))
        stats = checkpoint(stats)
        nodes = stats.groupBy("host", "__at").agg(F.sum("b").alias("all_b"), F.sum("k").alias("all_k"), F.count("__own").alias("below"))
        nodes = checkpoint(nodes.where((F.col("all_k") >= 2 * least_known) & (F.col("all_b") > 0) & (F.col("all_b") < F.col("all_k")) & (F.col("below") > 0)))
        n_nodes = nodes.count()
        # a branch against the others of its node
        k, b, rest_k, rest_b = F.col("k"), F.col("b"), F.col("all_k") - F.col("k"), F.col("all_b") - F.col("b")
        share = F.col("all_b") / F.col("all_k")
        z = F.abs(b / k - rest_b / F.nullif(rest_k, F.lit(0))) / F.sqrt(share * (1 - share) * (1 / k + 1 / F.nullif(rest_k, F.lit(0))))
        branches = stats.where((k >= least_known) & (F.col("__own") != "*")).join(nodes, ["host", "__at"])
        kept = branches.where((F.col("below") == 1) | (z > alike_z)).select("host", "__at", "__own", F.lit(True).alias("__kept"))
        kept = checkpoint(kept) if n_nodes else kept.limit(0)
        rows = looked_up(rows, nodes.select("host", "__at", F.lit(True).alias("__split")), ["host", "__at"], n_nodes)
        rows = looked_up(rows, kept, ["host", "__at", "__own"], kept.count() if n_nodes else 0)
        goes = F.col("__live") & F.col("__split").isNotNull() & F.col("__own").isNotNull()
        stays = F.col("__live") & F.col("__split").isNull() & F.col("__own").isNotNull()
        rows = rows.withColumns({
            "__at": F.when(goes, F.concat_ws("/", "__at", F.when(F.col("__kept"), F.col("__own")).otherwise("*"))).otherwise(F.col("__at")),
            "__more": F.col("__more") | stays, "__live": goes,
        }).drop("__split", "__kept", "__own")
        if not n_nodes:
            break
        level += 1
        rows = checkpoint(rows) if level % 4 == 0 else rows
    template = F.when(F.col("__more"), F.concat("__at", F.lit("/**"))).when(F.col("__at") == "", "/").otherwise(F.col("__at"))
    return rows.withColumn("template", template).drop("__seg", "__at", "__live", "__more")


def judge_urls(urls: DataFrame, *, url_col: str = "url", rules: list[tuple[str, str, str]] = (), reject_at: float = 0.65, weight: float = 2.0, bad_col: str | None = None, **tree) -> DataFrame:
    """Every row of `urls` with host, path, template, purity (share of bad, smoothed), rule and verdict ("allow" or "block").

    The longest fitting rule decides, else the template: it is rejected if its purity is at least `reject_at`. `weight`: how many labels the
    share of the host, and of all, counts as. `bad_col` names labels (0, 1, null unknown); without it words of
    the urls label those that no rule fits (`word_labels`). Null urls have empty host and path and template "/"; without any label all
    purities are 0.5. Equal urls get equal results. Columns with the new names are replaced; the others are carried through every
    level, so select what is needed.
    """
    made = ["host", "path", "bad", "template", "purity", "rule", "verdict"]
    own = urls.withColumn("__bad", F.col(f"`{bad_col}`").cast("int") if bad_col else F.lit(None).cast("int"))
    own = with_host_and_path(own.drop(*[c for c in made if c != url_col]), url_col)
    rows = path_templates(own.withColumn("bad", F.col("__bad") if bad_col else word_labels(own, list(rules))).drop("__bad"), **tree)
    per = checkpoint(rows.groupBy("host", "template").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("b"), F.count("bad").alias("k")))
    hosts = checkpoint(per.groupBy("host").agg(F.sum("b").alias("host_b"), F.sum("k").alias("host_k")))
    n_hosts, all_b, all_k = hosts.agg(F.count("*"), F.coalesce(F.sum("host_b"), F.lit(0)), F.coalesce(F.sum("host_k"), F.lit(0))).first()
    overall = (all_b + 0.5) / (all_k + 1)
    host_share = (F.col("host_b") + weight * overall) / (F.col("host_k") + weight)
    purity = (F.col("b") + weight * F.col("__share")) / (F.col("k") + weight)
    scored = looked_up(per, hosts.select("host", host_share.alias("__share")), ["host"], n_hosts).select("host", "template", purity.alias("purity"))
    judged = looked_up(rows.drop("bad"), scored, ["host", "template"], per.count())
    rule, verdict = rule_column(list(rules))
    return judged.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("purity") >= reject_at, "block").otherwise("allow"))})
