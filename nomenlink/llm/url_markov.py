"""URL filter: rules first, then the likelihood ratio of two character models.

Host and path rules decide the urls that they fit, the longest rule first. Those urls
also teach two variable-order Markov models, one of allowed and one of blocked urls: the
probability of a character after up to ``ORDER`` others, where each order is smoothed by
the next lower one in proportion to the number of different characters seen after the
context (Witten-Bell), down to a uniform one. A context never seen falls through to the
lower order, so the order varies with the data.

The score of a url is the mean over its characters (and its end) of the log ratio of both
probabilities. A fold of the ruled urls stays out of the counts and calibrates the
threshold: the one with the best balanced accuracy there, the lowest of equals. Urls
without a rule are allowed from the threshold upwards.

All steps are DataFrame functions. Urls are made distinct first. Counts are aggregated
per n-gram before anything is joined, and each distinct n-gram is scored once.

Defined results: a null url and one without ``://`` have an empty host and path and fit
no rule; a null url counts as empty for the models. Without ruled urls of both kinds the
ratio is 0 for every url, the threshold 0, and all urls without a rule are allowed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ORDER = 4
# The scored n-grams are broadcast up to this number of rows.
BROADCAST_ROWS = 300_000
# Bins per unit of the score when the threshold is looked for, and the widest score.
BINS = 1000
WIDEST = 30

ALLOW, BLOCK = "allow", "block"
_START, _END = "\x02", "\x03"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# First hexadecimal digits of the md5 of a url in the calibration fold.
_FOLD = ("0", "1", "2")


class Rule(NamedTuple):
    """A verdict on a host with its subdomains and a prefix of the path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _by_length(rules: tuple[Rule, ...]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r.name), r.name))


def host(url: Column) -> Column:
    """What stands between the first ``://`` and the path, query or fragment."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _CAPITALS, _CAPITALS.lower()), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _first_fit(rules: tuple[Rule, ...], field: str) -> Column:
    """A field of the longest rule that fits the columns host and path; else null."""
    out = F.lit(None).cast("string")
    for rule in reversed(_by_length(rules)):
        same = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        out = F.when(same & F.col("path").startswith(rule.path), getattr(rule, field)).otherwise(out)
    return out


def _grams(urls: DataFrame, *columns: str) -> DataFrame:
    """One row per character of the padded url, with the characters before it."""
    padded = F.concat(F.lit(_START * ORDER), "url", F.lit(_END))
    letters = F.split(padded, "")
    exploded = urls.select(*columns, letters.alias("letters")).select(
        *columns,
        "letters",
        F.explode(F.sequence(F.lit(1), F.size("letters") - ORDER)).alias("at"),
    )
    gram = F.array_join(F.slice("letters", F.col("at"), ORDER + 1), "")
    return exploded.select(*columns, gram.alias("gram"))


def _probabilities(counts: DataFrame) -> DataFrame:
    """``gram, allow, block``: the probability of the last character of each n-gram.

    ``counts`` has ``gram, allow, block``, one row for every n-gram that will be scored.
    """
    kinds = (ALLOW, BLOCK)
    known = None
    for order in range(ORDER + 1):
        event = F.expr(f"right(gram, {order + 1})")
        events = counts.groupBy(event.alias("event")).agg(*(F.sum(k).alias(k) for k in kinds))
        events = events.withColumn("context", F.expr(f"left(event, {order})"))
        contexts = events.groupBy("context").agg(
            *(F.sum(k).alias(f"all_{k}") for k in kinds),
            *(F.count(F.when(F.col(k) > 0, 1)).alias(f"kinds_{k}") for k in kinds),
            *([F.count(F.lit(1)).alias("letters")] if order == 0 else []),
        )
        joined = events.join(contexts, "context")
        if known is None:
            lower = dict.fromkeys(kinds, 1 / (F.col("letters") + 1))
        else:
            joined = joined.withColumn("shorter", F.expr(f"right(event, {order})")).join(known, "shorter")
            lower = {k: F.col(f"lower_{k}") for k in kinds}
        # A context without counts has neither, and the lower order decides alone.
        mixed = [
            F.when(F.col(f"all_{k}") == 0, lower[k])
            .otherwise(
                (F.col(k) + F.col(f"kinds_{k}") * lower[k]) / (F.col(f"all_{k}") + F.col(f"kinds_{k}"))
            )
            .alias(f"p_{k}")
            for k in kinds
        ]
        found = joined.select("event", *mixed)
        known = found.select(
            F.col("event").alias("shorter"), *(F.col(f"p_{k}").alias(f"lower_{k}") for k in kinds)
        )
    return found.select(F.col("event").alias("gram"), *(F.col(f"p_{k}").alias(k) for k in kinds))


def _threshold(scored: DataFrame) -> float:
    """The bin edge of best balanced accuracy over ruled urls of the fold."""
    bins = F.floor(F.greatest(F.least("score", F.lit(WIDEST)), F.lit(-WIDEST)) * BINS)
    ruled = scored.where(F.col("fold") & F.col("label").isNotNull())
    per_bin = ruled.groupBy(bins.alias("bin")).agg(
        *(F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(k) for k in (ALLOW, BLOCK))
    )
    # At most so many rows as there are bins.
    upwards = Window.orderBy("bin").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    passed = F.sum(ALLOW).over(upwards) / F.sum(ALLOW).over(whole)
    stopped = F.coalesce(F.sum(BLOCK).over(below), F.lit(0)) / F.sum(BLOCK).over(whole)
    gain = F.round(passed + stopped, 9).alias("gain")
    best = per_bin.select("bin", gain).where("gain is not null").orderBy(F.desc("gain"), "bin").first()
    return best.bin / BINS if best else 0.0


def score_urls(labelled: DataFrame) -> DataFrame:
    """``url, label, n, fold, score`` of distinct urls.

    ``labelled`` has ``url`` (null counts as empty), ``label`` (allow, block or null) and
    ``n``, the number of rows.
    """
    fold = F.substring(F.md5("url"), 1, 1).isin(*_FOLD)
    urls = written(
        labelled.select(
            "url", "label", "n", fold.alias("fold"), F.monotonically_increasing_id().alias("uid")
        ),
        "urls",
    )
    learned = ~F.col("fold")
    weights = [
        F.sum(F.when(learned & (F.col("label") == k), F.col("n")).otherwise(0)).alias(k)
        for k in (ALLOW, BLOCK)
    ]
    counts = _grams(urls, "label", "n", "fold").groupBy("gram").agg(*weights)
    found = _probabilities(written(counts, "counts"))
    # Without one kind of url there is no ratio.
    ratio = F.log(F.col(ALLOW)) - F.log(F.col(BLOCK))
    ratios = written(found.select("gram", ratio.alias("ratio")), "ratios")
    trained = urls.where(learned & F.col("label").isNotNull()).select("label").distinct().count()
    few = ratios.count() <= BROADCAST_ROWS
    places = _grams(urls, "uid").join(F.broadcast(ratios) if few else ratios, "gram")
    score = F.round(F.avg("ratio"), 9) if trained == 2 else F.avg(F.lit(0.0))
    scores = places.groupBy("uid").agg(score.alias("score"))
    return urls.join(scores, "uid").drop("uid")


def judge(pages: DataFrame, rules: tuple[Rule, ...], url: str = "url", page_id: str = "page_id") -> DataFrame:
    """``page_id, host, path, rule, score, verdict`` of every page.

    ``score`` is null where a rule decides.
    """
    parts = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    distinct = parts.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    ruled = distinct.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    ruled = ruled.select("url", "n", _first_fit(rules, "verdict").alias("label"))
    scored = written(score_urls(ruled), "scores")
    threshold = _threshold(scored)

    # Only urls without a rule need their score; a page with a rule joins nothing.
    own = parts.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    own = own.withColumns({"rule": _first_fit(rules, "name"), "label": _first_fit(rules, "verdict")})
    needed = scored.where("label is null").select("url", "score")
    decided = own.where("label is not null")
    decided = decided.withColumns({"score": F.lit(None).cast("double"), "verdict": F.col("label")})
    verdict = F.when(F.col("score") >= threshold, ALLOW).otherwise(BLOCK)
    asked = own.where("label is null").join(needed, "url").withColumn("verdict", verdict)
    columns = ["page_id", "host", "path", "rule", "score", "verdict"]
    return decided.select(*columns).unionByName(asked.select(*columns))


def oracle(rules: tuple[Rule, ...]) -> str:
    """DuckDB SQL for ``page_id, host, path, rule, verdict`` over the table pages."""

    def fit(field: str) -> str:
        cases = " ".join(
            f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}') "
            f"THEN '{getattr(r, field)}'"
            for r in _by_length(rules)
        )
        return f"CASE {cases} END"

    fold = ", ".join(f"'{x}'" for x in _FOLD)
    steps = []
    for order in range(ORDER + 1):
        lower = {k: f"lower.{k}" if order else "1.0 / (letters + 1)" for k in (ALLOW, BLOCK)}
        mixed = ", ".join(
            f"CASE WHEN all_{k} = 0 THEN {lower[k]} ELSE "
            f"(e.{k} + kinds_{k} * {lower[k]}) / (all_{k} + kinds_{k}) END AS {k}"
            for k in (ALLOW, BLOCK)
        )
        steps.append(
            f"""events{order} AS (
  SELECT substr(gram, {ORDER + 1 - order}, {order + 1}) AS event,
    substr(gram, {ORDER + 1 - order}, {order}) AS context,
    sum(allow) AS allow, sum(block) AS block FROM counts GROUP BY ALL),
contexts{order} AS (
  SELECT context, sum(allow) AS all_allow, sum(block) AS all_block,
    count(*) FILTER (WHERE allow > 0) AS kinds_allow,
    count(*) FILTER (WHERE block > 0) AS kinds_block, count(*) AS letters
  FROM events{order} GROUP BY context),
p{order} AS (
  SELECT e.event, {mixed} FROM events{order} e JOIN contexts{order} c ON e.context = c.context
  {f"JOIN p{order - 1} lower ON lower.event = substr(e.event, 2)" if order else ""})"""
        )
    probabilities = ",\n".join(steps)
    return f"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      '{_CAPITALS}', '{_CAPITALS.lower()}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (SELECT *, {fit("name")} AS rule, {fit("verdict")} AS label FROM parts),
urls AS (
  SELECT url, label, count(*) AS n, md5(url)[1] IN ({fold}) AS fold,
    repeat(chr(2), {ORDER}) || url || chr(3) AS padded
  FROM ruled GROUP BY url, label),
places AS (
  SELECT url, label, n, fold,
    substr(padded, unnest(range(1, length(padded) - {ORDER} + 1)), {ORDER + 1}) AS gram
  FROM urls),
counts AS (
  SELECT gram, coalesce(sum(n) FILTER (WHERE label = 'allow' AND NOT fold), 0) AS allow,
    coalesce(sum(n) FILTER (WHERE label = 'block' AND NOT fold), 0) AS block
  FROM places GROUP BY gram),
{probabilities},
trained AS (
  SELECT count(DISTINCT label) = 2 AS able FROM urls WHERE NOT fold AND label IS NOT NULL),
scores AS (
  SELECT url, any_value(label) AS label, any_value(n) AS n, any_value(fold) AS fold,
    CASE WHEN any_value(able) THEN round(avg(ln(p.allow) - ln(p.block)), 9) ELSE 0 END AS score
  FROM places JOIN p{ORDER} p ON p.event = places.gram, trained GROUP BY url),
bins AS (
  SELECT floor(greatest(least(score, {WIDEST}), -{WIDEST}) * {BINS}) AS bin,
    coalesce(sum(n) FILTER (WHERE label = 'allow'), 0) AS allow,
    coalesce(sum(n) FILTER (WHERE label = 'block'), 0) AS block
  FROM scores WHERE fold AND label IS NOT NULL GROUP BY 1),
gains AS (
  SELECT bin, round(sum(allow) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
      / nullif(sum(allow) OVER (), 0)
    + coalesce(sum(block) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      / nullif(sum(block) OVER (), 0), 9) AS gain FROM bins),
best AS (
  SELECT coalesce((SELECT bin FROM gains WHERE gain IS NOT NULL ORDER BY gain DESC, bin LIMIT 1), 0)
    / {BINS}.0 AS threshold)
SELECT page_id, host, path, rule,
  coalesce(ruled.label, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled JOIN scores ON ruled.url = scores.url, best
"""
