"""URL filter: explicit rules, and for other URLs the likelihood ratio of two character models.

Both models are variable-order Markov models over a small fixed alphabet, interpolated from order 0 to
order 2 by Witten-Bell weights. They are counted on all URLs that the rules accept or reject; the
length-normalised log ratio is compared with a threshold calibrated on the same URLs. DataFrame
functions only; the model has N**3 rows whatever the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.runtime import written

#: Start, end, letters, any digit, URL signs, anything else: the models' alphabet by position.
ALPHABET = "^$abcdefghijklmnopqrstuvwxyz0/.-_~"
N = len(ALPHABET)
#: verdict, host, path
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null and for texts without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. The rules are a parameter."""
    chain = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain if chain is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def trigrams(host: Column, path: Column) -> Column:
    """Codes of all character trigrams of ^^host/path$, as one array of integers below N**3."""
    text = F.regexp_replace(F.regexp_replace(F.lower(F.concat(host, path)), r"[0-9]", "0"), r"[^a-z0/.\-_]", "~")
    codes = F.transform(F.split(F.concat(F.lit("^^"), text, F.lit("$")), ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.transform(
        F.array(F.filter(codes, lambda c: c >= 0)),
        lambda c: F.transform(F.sequence(F.lit(2), F.size(c) - 1), lambda i: (F.get(c, i - 2) * N + F.get(c, i - 1)) * N + F.get(c, i)),
    )[0]


def log_ratio_model(labelled: DataFrame) -> DataFrame:
    """(code, ratio): log P(c | ab, allow) - log P(c | ab, block) for each of the N**3 codes of abc.

    ``labelled`` has rows (verdict, grams, n): n URLs share the grams. With n(ab) tokens and t(ab) kinds
    after ab, P(c|ab) = (n(abc) + t(ab) P(c|b)) / (n(ab) + t(ab)), likewise P(c|b) from P(c), which is
    smoothed by one of each character; a context never seen takes the shorter one's probability.
    """
    counts = labelled.select((F.col("verdict") == "allow").cast("int").alias("cls"), "n", F.explode("grams").alias("code")).groupBy("cls", "code").agg(F.sum("n").alias("n"))
    # At most 2 N**3 cells whatever the input, so they are smoothed in one partition without a shuffle.
    grid = labelled.sparkSession.range(0, 2 * N**3, 1, 1).select((F.col("id") / N**3).cast("int").alias("cls"), (F.col("id") % N**3).cast("int").alias("code"))
    cells = grid.join(counts.repartition(1).hint("merge"), ["cls", "code"], "left").select(
        "cls", "code", F.coalesce("n", F.lit(0)).alias("n"), (F.col("code") % N).alias("c"), F.floor(F.col("code") / N).cast("int").alias("ab"), F.floor(F.col("code") / N % N).cast("int").alias("b")
    )
    over = lambda *keys: Window.partitionBy("cls", *keys)
    within = cells.select("*", F.sum("n").over(over("b", "c")).alias("n_bc"), F.sum("n").over(over("c")).alias("n_c"), F.sum("n").over(over()).alias("n_all"))
    within = within.select(
        "*", F.sum("n").over(over("ab")).alias("n_ab"), F.count_if(F.col("n") > 0).over(over("ab")).alias("t_ab"),
        F.sum("n").over(over("b")).alias("n_b"), (F.count_if(F.col("n_bc") > 0).over(over("b")) / N).alias("t_b"),
    )

    def smoothed(n: str, total: str, kinds: str, shorter: Column) -> Column:
        return F.when(F.col(total) > 0, (F.col(n) + F.col(kinds) * shorter) / (F.col(total) + F.col(kinds))).otherwise(shorter)

    p = smoothed("n", "n_ab", "t_ab", smoothed("n_bc", "n_b", "t_b", (F.col("n_c") + 1) / (F.col("n_all") + N)))
    return within.groupBy("code").agg(F.sum(F.when(F.col("cls") == 1, F.log(p)).otherwise(-F.log(p))).alias("ratio"))


def calibrated(scored: DataFrame, bins: int = 400, low: float = -4.0, high: float = 4.0) -> float:
    """The threshold with the least balanced error on rows (verdict, score); 0 if a class is missing.

    Works on a histogram of ``bins`` bins, so a bounded number of counts reaches the driver."""
    width = (high - low) / bins
    binned = scored.where("verdict is not null").select(
        "verdict", F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("score") - low) / width))).cast("int").alias("bin")
    )
    rows = binned.groupBy("bin").agg(F.count_if(F.col("verdict") == "allow").alias("allow"), F.count_if(F.col("verdict") == "block").alias("block")).collect()
    allow, block = sum(r["allow"] for r in rows), sum(r["block"] for r in rows)
    if not allow or not block:
        return 0.0
    best, errors, missed, caught = (2.0, 0.0), [], 0, 0
    by_bin = {r["bin"]: r for r in rows}
    for k in range(bins + 1):
        error = missed / allow + (block - caught) / block
        errors.append(error)
        best = min(best, (error, abs(low + k * width), k))
        if k in by_bin:
            missed, caught = missed + by_bin[k]["allow"], caught + by_bin[k]["block"]
    least = [k for k, e in enumerate(errors) if e <= best[0] + 1e-12]
    return low + (least[0] + least[-1]) / 2 * width


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Judge every URL of (page_id, url): by the longest fitting rule, else by the character models.

    Returns page_id, host, path, rule, verdict, score (log ratio per character, higher: like accepted
    URLs) and threshold. Null URLs and those without :// have an empty host and path and are scored
    as an empty text. Rows with a null or repeated page_id are judged each on its own; an empty table
    gives no rows; further columns are ignored. Without accepted or rejected URLs the threshold is 0.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = written(parts.withColumn("r", matching_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", "r.verdict"), "url-parts")
    # Equal URLs share their score, so the distinct ones are counted and scored; a common URL is one row here.
    # They are numbered, so that what is made of their characters carries a number and not the URL.
    counted = known.groupBy("host", "path", "verdict").agg(F.count("*").alias("n"))
    urls = written(counted.withColumns({"url_no": F.monotonically_increasing_id(), "grams": trigrams(F.col("host"), F.col("path"))}), "urls")
    model = F.broadcast(log_ratio_model(urls.where("verdict is not null").select("verdict", "grams", "n")))  # N**3 rows
    numbered = urls.select("url_no", F.explode("grams").alias("code")).join(model, "code").groupBy("url_no").agg(F.avg("ratio").alias("score"))
    scores = written(urls.select("url_no", "host", "path", "verdict").join(numbered.hint("merge"), "url_no").drop("url_no"), "url-scores")
    threshold = calibrated(scores)
    # Null and malformed URLs are one empty URL; its one score is a literal, so that they need no join.
    blank = (F.col("host") == "") & (F.col("path") == "")
    empty = scores.where(blank).select("score").first()
    own = scores.where(~blank).select(F.col("host").alias("_h"), F.col("path").alias("_p"), "score")
    judged = known.where(~blank).join(own, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p"))).select(*known.columns, "score")
    judged = judged.unionByName(known.where(blank).withColumn("score", F.lit(empty["score"] if empty else 0.0)))
    verdict = F.coalesce("verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", F.lit(threshold).alias("threshold"))
