"""URL filters: host and path rules, and a path-template tree judged by labelled purity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.operators.joins import skew_join
from shelfsift.session import stage

#: (host, path, verdict), a rule for the host and its subdomains where the path starts so.
Rule = tuple[str, str, str]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host_: Column, path_: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null where none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host_ == name) | F.endswith(host_, F.lit("." + name))) & F.startswith(path_, F.lit(start))
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


LEAST_ROWS = 20  # a segment seen less often is variable
SAME = 1.96  # branches whose purities differ by fewer standard errors are merged
STRENGTH = 5.0  # pseudo-labels at the overall purity
LEAST_PURITY = 0.5


def _literal(segment: Column) -> Column:
    """A segment as it stands in templates: never the marks ``*`` (variable) or ``~`` (merged), which stay apart from segments of that name."""
    return F.when(segment.rlike(r"^[*~\\]"), F.concat(F.lit("\\"), segment)).otherwise(segment)


def _generalised(rows: DataFrame) -> DataFrame:
    """``rows`` (_host, _path, ...) with ``_template``: the path with its variable segments as ``*``.

    Paths of one host and one length form a tree. On each of its levels a segment stays a literal where
    it is frequent, however many such segments there are. Every path is taken apart once, its segments
    are counted with partial sums per (host, length, level, segment) and meet those that are frequent in
    a salted join, so neither a host that holds most rows nor one with very many sections is one task.
    """
    at = ["_host", "_length", "_level", "_segment"]
    paths = stage(rows.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("_n")))
    segments = F.split(F.substring("_path", 2, 1 << 30), "/")
    single = paths.where("_path != ''").select("_host", "_path", "_n", F.size(segments).alias("_length"), F.posexplode(segments).alias("_level", "_segment"))
    frequent = stage(single.groupBy(*at).agg(F.sum("_n").alias("_n")).where(F.col("_n") >= LEAST_ROWS))
    known = skew_join(single.drop("_n"), frequent.select(*at, F.lit(True).alias("_literal")), at, frequent, rows="_n", how="left")
    kept = F.struct("_level", F.when(F.col("_literal"), _literal(F.col("_segment"))).otherwise("*").alias("kept"))
    templates = known.groupBy("_host", "_path").agg(F.concat(F.lit("/"), F.array_join(F.sort_array(F.collect_list(kept))["kept"], "/")).alias("_template"))
    return skew_join(rows, stage(templates), ["_host", "_path"], paths, rows="_n", how="left").withColumn("_template", F.coalesce("_template", F.lit("")))


def _merged(templates: DataFrame) -> DataFrame:
    """(_host, _template, _merged, _good, _labels) per template: branches of one parent that do not differ are one.

    A branch is compared with all branches of its parent by the difference of their shares of good
    labels in standard errors; those within SAME are pooled under ``{parent}/~``.
    """
    parent = F.regexp_replace("_template", "/[^/]*$", "")
    pooled = templates.withColumn("_parent", parent)
    whole = pooled.groupBy("_host", "_parent").agg(F.sum("_good").alias("_all_good"), F.sum("_labels").alias("_all_labels"))
    compared = pooled.join(whole, ["_host", "_parent"])
    share = (F.col("_all_good") + 1) / (F.col("_all_labels") + 2)
    error = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1.0), "_labels") + F.try_divide(F.lit(1.0), "_all_labels")))
    # Null, hence no difference, where a branch has no labels.
    differs = F.abs(F.try_divide("_good", "_labels") - F.try_divide("_all_good", "_all_labels")) > SAME * error
    named = compared.withColumn("_merged", F.when(F.coalesce(differs, F.lit(False)), F.col("_template")).otherwise(F.concat("_parent", F.lit("/~"))))
    sums = named.groupBy("_host", "_merged").agg(F.sum("_good").alias("_good"), F.sum("_labels").alias("_labels"))
    return named.select("_host", "_template", "_merged").join(sums, ["_host", "_merged"])


def judge(
    pages: DataFrame, labels: DataFrame, rules: Sequence[Rule] = (), key: str = "page_id", url: str = "url",
    label_key: str = "page_id", good: str = "good",
) -> DataFrame:
    """(key, host, path, rule, template, purity, verdict) of every row of ``pages``.

    The longest fitting rule decides. Other rows go by their path template: per host the segments are
    generalised into a tree, similar branches are merged, and a template is blocked where its purity -
    the share of good rows of ``labels`` (label_key, good 0/1), smoothed towards the overall share - is
    below LEAST_PURITY. In templates ``*`` is a variable segment, a last ``~`` stands for branches merged,
    and a segment that begins with one of these or a backslash has a backslash before it. Empty segments count as segments. Urls without ``://`` and null urls have an empty host and
    path and form one template. Rows with null labels or keys count as unlabelled; repeated labels of one
    key count by their mean; without labels all is allowed. Equal rows get equal verdicts; an empty table
    gives no rows; other columns are not read.
    """
    link = F.col(url).alias("_url")
    rows = pages.select(F.col(key).alias("_key"), link).select("_key", host(F.col("_url")).alias("_host"), path(F.col("_url")).alias("_path"))
    rows = stage(rows)
    marked = labels.select(F.col(label_key).alias("_key"), F.col(good).cast("double").alias("_good")).where("_key IS NOT NULL AND _good IS NOT NULL")
    marked = marked.groupBy("_key").agg(F.avg("_good").alias("_good"))

    placed = stage(_generalised(rows).join(marked, "_key", "left").select("_key", "_host", "_path", "_template", "_good"))
    templates = stage(placed.groupBy("_host", "_template").agg(F.coalesce(F.sum("_good"), F.lit(0.0)).alias("_good"), F.count("_good").alias("_labels")))
    overall = templates.agg(F.coalesce(F.try_divide(F.sum("_good"), F.sum("_labels")), F.lit(1.0))).first()[0]
    purity = (F.col("_good") + STRENGTH * overall) / (F.col("_labels") + STRENGTH)
    verdicts = _merged(templates).select(F.col("_host").alias("_h"), F.col("_template").alias("_t"), F.col("_merged"), purity.alias("_purity"))

    judged = placed.drop("_good").join(stage(verdicts), (F.col("_host") == F.col("_h")) & (F.col("_template") == F.col("_t")))
    ruled = judged.withColumn("_rule", rule_for(F.col("_host"), F.col("_path"), rules))
    by_template = F.when(F.col("_purity") < LEAST_PURITY, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.select(
        F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"),
        F.col("_merged").alias("template"), F.col("_purity").alias("purity"), F.coalesce("_rule.verdict", by_template).alias("verdict"))
