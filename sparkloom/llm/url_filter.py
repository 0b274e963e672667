"""URL filters: a blocklist of host and path rules, and for all other URLs a character language-model ratio.

Two variable-order Markov models, of accepted and of rejected URLs, are learnt from the URLs that a rule decides.
The probability of a character after the ``ORDER`` before it is smoothed down to the order below, p = (count +
PRIOR * lower) / (context + PRIOR), to the uniform at the end. A URL's score is the difference of its two
log-likelihoods over its length, and it is allowed from a threshold on that is calibrated on the decided URLs held
out from learning: the score, in steps of 1 / ``BINS``, with most of each class on its side.

All in DataFrame functions. Counts cover every URL a rule decides, and the tables grow with them; they are joined by
n-gram, where a gram that is in every URL is split by AQE; sums are of whole millionths, so the order of rows does
not show. Learning and scoring see host and path, as queries and fragments hold session data.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no rule fits it and it scores 0;
without URLs of both classes all scores and the threshold are 0, so all is allowed; repeated rows score alike; an empty
table gives an empty result; columns of other names pass through, those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Workspace, shuffle_parts, table

#: (verdict, rule): a rule fits its host and all subdomains where the URL's path starts with the rule's; longest wins.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
ORDER = 4
PRIOR = 4.0
ALPHABET = 128.0
#: One in so many decided URLs, by a hash, calibrates instead of teaching.
HELD = 5
BINS, SPAN = 200, 5
#: A model of so many grams at most is broadcast; a larger one is joined by sorting both sides.
BROADCAST_GRAMS = 200_000
MILLION = 1_000_000


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls; of equally long ones the first in code point order."""
    rule = verdict = None
    for decision, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        rule_host, slash, rule_path = text.partition("/")
        rule_host = rule_host.lower()
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(decision)) if verdict is None else verdict.when(fits, F.lit(decision))
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def grams(text: Column, order: int = ORDER) -> Column:
    """Each character with the order ones before it; the start is padded."""
    padded = F.concat(F.lit("\x02" * order), text, F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(order + 1)))


def gram_scores(work: Workspace, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, a, r): how often accepted and rejected URLs hold each full gram, to (gram, score): log-likelihood difference in millionths.

    Each gram's shorter forms share one table of counts; p is built from the shortest form up.
    """
    forms = counts.select("a", "r", F.explode(F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda k: F.substring("gram", F.lit(order + 2) - k, k))).alias("form"))
    forms = work.keep(forms.groupBy("form").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "forms")
    context = forms.groupBy(F.expr("left(form, length(form) - 1)").alias("context"), F.length("form").alias("size")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
    context = work.keep(context, "contexts")
    full = forms.withColumns({"size": F.length("form"), "context": F.expr("left(form, length(form) - 1)")}).join(context, ["context", "size"])
    full = work.keep(full.select("form", "size", "a", "r", "ca", "cr"), "counted")
    p = None
    for size in range(1, order + 2):
        own = full.where(F.col("size") == size).drop("size")
        if p is None:
            own = own.withColumns({"pa": F.lit(1 / ALPHABET), "pr": F.lit(1 / ALPHABET)})
        else:  # a form is longer than its lower one by a character, so few rows share one
            own = own.withColumn("lower", F.expr(f"right(form, {size - 1})")).join(p.select(F.col("form").alias("lower"), "pa", "pr"), "lower")
        smooth = lambda n, c, q: (F.col(n) + PRIOR * F.col(q)) / (F.col(c) + PRIOR)
        p = work.keep(own.select("form", smooth("a", "ca", "pa").alias("pa"), smooth("r", "cr", "pr").alias("pr")), f"p{size}")
    return p.select(F.col("form").alias("gram"), F.round((F.log("pa") - F.log("pr")) * MILLION).cast("long").alias("score"))


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """pages with host, path, rule, verdict and score (millionths a character)."""
    spark = pages.sparkSession
    work = Workspace(spark, "urls")
    mine = ("host", "path", "rule", "verdict", "score")
    kept = [c for c in pages.columns if c not in mine]
    row = F.struct(*(pages[c] for c in kept)) if kept else F.lit(None).cast("struct<none:int>")
    parts = pages.select(row.alias("row"), url_host(pages[url_col]).alias("host"), url_path(pages[url_col]).alias("path")).withColumn("text", F.concat("host", "path"))
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": rule, "decided": decided})
    # one row for each different host and path, as only they are read
    texts = parts.select("text", "decided").groupBy("text").agg(F.count("*").alias("n"), F.max("decided").alias("decided"))
    texts = work.keep(texts.where("text <> ''"), "texts")
    held = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long") % HELD == 0

    # a small file, as URLs compress well, but a row for each character: dealt to all tasks before it is exploded
    split = texts.select("text", "decided", "n", held.alias("held")).repartition(shuffle_parts(spark))
    exploded = split.select("*", F.explode(grams(F.col("text"), order)).alias("gram"))
    teach = F.col("decided").isNotNull() & ~F.col("held")
    own = lambda verdict: F.sum(F.when(teach & (F.col("decided") == verdict), F.col("n")).otherwise(F.lit(0).cast("long")))
    counts = work.keep(exploded.groupBy("gram").agg(own("allow").alias("a"), own("block").alias("r")), "counts")
    model = work.keep(gram_scores(work, counts, order), "model")
    # each text meets one row for each of its characters: never the side to broadcast, which its compressed size would suggest
    model = F.broadcast(model) if model.count() <= BROADCAST_GRAMS else model.hint("merge")
    both = counts.agg(F.sum("a"), F.sum("r")).first()
    scored = exploded.select("text", "gram").join(model, "gram").groupBy("text").agg(F.sum("score").alias("total"), F.count("*").alias("length"))
    score = F.floor(F.col("total") / F.col("length")).cast("long") if all(both) else F.lit(0).cast("long")
    # as many rows as different URLs: joined by sorting, however small its file is compressed
    scored = work.keep(scored.select("text", score.alias("score")), "scores").hint("merge")

    threshold = calibrate(texts.where(held).join(scored, "text")) if all(both) else 0
    out = parts.join(scored, "text", "left")
    verdict = F.coalesce("decided", F.when(F.coalesce("score", F.lit(0)) >= threshold, "allow").otherwise("block"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in kept), "host", "path", "rule", verdict.alias("verdict"), F.coalesce("score", F.lit(0).cast("long")).alias("score"))


def calibrate(held: DataFrame) -> int:
    """The threshold, in millionths, with the largest sum of the classes' shares on their sides; of several the one nearest 0."""
    step = MILLION // BINS
    bin_ = F.least(F.greatest(F.floor(F.col("score") / step), F.lit(-SPAN * BINS)), F.lit(SPAN * BINS))
    rows = held.where("decided is not null").groupBy(bin_.alias("bin")).agg(F.sum(F.when(F.col("decided") == "allow", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("decided") == "block", F.col("n")).otherwise(0)).alias("r")).collect()
    found = {x["bin"]: (x["a"], x["r"]) for x in rows}  # at most 2 * SPAN * BINS + 1 rows
    total_a, total_r = (max(1, sum(x[k] for x in found.values())) for k in (0, 1))
    best, below_a, below_r = (float("-inf"), 0, 0), 0, 0
    for k in range(-SPAN * BINS, SPAN * BINS + 2):
        value = below_r / total_r - below_a / total_a
        best = max(best, (value, -abs(k), k))
        a, r = found.get(k, (0, 0))
        below_a, below_r = below_a + a, below_r + r
    return best[2] * step


def op1_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def _rules_sql() -> str:
    """CASE arms (verdict, rule) of the rules, longest first."""
    arms = []
    for verdict, text in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        arms.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}')", verdict, text))
    return ", ".join(f"CASE {' '.join(f"WHEN {fits} THEN '{(verdict, text)[k]}'" for fits, verdict, text in arms)} END AS {name}" for k, name in ((0, "decided"), (1, "rule")))


def _levels_sql() -> str:
    parts, smooth = [], lambda n, c, q: f"({n} + {PRIOR} * {q}) / ({c} + {PRIOR})"
    for size in range(1, ORDER + 2):
        lower = f"(SELECT *, CAST({1 / ALPHABET!r} AS DOUBLE) AS qa, CAST({1 / ALPHABET!r} AS DOUBLE) AS qr FROM counted)" if size == 1 else f"(SELECT counted.*, p{size - 1}.pa AS qa, p{size - 1}.pr AS qr FROM counted JOIN p{size - 1} ON right(counted.form, {size - 1}) = p{size - 1}.form)"
        parts.append(f"p{size} AS (SELECT form, {smooth('a', 'ca', 'qa')} AS pa, {smooth('r', 'cr', 'qr')} AS pr FROM {lower} x WHERE len(form) = {size})")
    return ",\n".join(parts)


ORACLE = rf"""
WITH split AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages
), ruled AS (SELECT *, host || path AS text, {_rules_sql()} FROM split),
texts AS (SELECT text, count(*) AS n, max(decided) AS decided, ('0x' || substr(md5(text), 1, 8))::UBIGINT % {HELD} = 0 AS held FROM ruled WHERE text <> '' GROUP BY text),
gram AS (SELECT *, substring(repeat(chr(2), {ORDER}) || text || chr(3), i, {ORDER + 1}) AS gram FROM (SELECT *, unnest(range(1, len(text) + 2)) AS i FROM texts) g),
counts AS (SELECT gram, coalesce(sum(n) FILTER (WHERE NOT held AND decided = 'allow'), 0)::BIGINT AS a, coalesce(sum(n) FILTER (WHERE NOT held AND decided = 'block'), 0)::BIGINT AS r FROM gram GROUP BY gram),
form AS (SELECT right(gram, k) AS form, sum(a)::BIGINT AS a, sum(r)::BIGINT AS r FROM counts, range(1, {ORDER + 2}) t(k) GROUP BY 1),
context AS (SELECT left(form, len(form) - 1) AS context, len(form) AS size, sum(a)::BIGINT AS ca, sum(r)::BIGINT AS cr FROM form GROUP BY 1, 2),
counted AS (SELECT form, a, r, ca, cr FROM form JOIN context ON left(form, len(form) - 1) = context AND len(form) = size),
{_levels_sql()},
ready AS (SELECT sum(a) > 0 AND sum(r) > 0 AS ok FROM counts),
scored AS (SELECT text, CASE WHEN ok THEN floor(sum(s)::DOUBLE / count(*))::BIGINT ELSE 0 END AS score FROM (SELECT text, round((ln(pa) - ln(pr)) * {MILLION})::BIGINT AS s FROM gram JOIN p{ORDER + 1} ON gram = form) z, ready GROUP BY text, ok),
bins AS (SELECT least(greatest(floor(score::DOUBLE / {MILLION // BINS})::BIGINT, {-SPAN * BINS}), {SPAN * BINS}) AS bin, coalesce(sum(n) FILTER (WHERE decided = 'allow'), 0) AS a, coalesce(sum(n) FILTER (WHERE decided = 'block'), 0) AS r FROM texts JOIN scored USING (text) WHERE held AND decided IS NOT NULL GROUP BY 1),
line AS (SELECT k, coalesce(sum(r) OVER w, 0)::DOUBLE / (SELECT greatest(1, coalesce(sum(r), 0)) FROM bins) - coalesce(sum(a) OVER w, 0)::DOUBLE / (SELECT greatest(1, coalesce(sum(a), 0)) FROM bins) AS value
  FROM range({-SPAN * BINS}, {SPAN * BINS + 2}) t(k) LEFT JOIN bins ON k = bin WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT CASE WHEN ok THEN (SELECT k FROM line ORDER BY value DESC, abs(k), k DESC LIMIT 1) * {MILLION // BINS} ELSE 0 END AS threshold FROM ready)
SELECT page_id, url, host, path, rule, coalesce(decided, CASE WHEN coalesce(score, 0) >= threshold THEN 'allow' ELSE 'block' END) AS verdict, coalesce(score, 0)::BIGINT AS score FROM ruled LEFT JOIN scored USING (text), cut
"""
