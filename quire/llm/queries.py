"""The queries opN_<name>: each applies one operator to its whole table and derives the fixed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.ann import nearest_neighbours
from quire.llm.collocations import collocations
from quire.llm.decontamination import contaminated
from quire.llm.jaccard_join import jaccard_join
from quire.llm.line_dedup import line_dedup
from quire.llm.minhash_dedup import near_duplicates
from quire.llm.packing import pack
from quire.llm.pii import KINDS, find_pii
from quire.llm.quality import held_out, score_quality, train
from quire.llm.suffix_dedup import remove_repeats
from quire.llm.token_counts import token_counts
from quire.llm.url_filter import ALPHABET, RULES, N, filter_urls
from quire.llm.whitening import whiten
from quire.session import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"))
    scored = score_quality(documents, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_* and base_sha256 describe the base spans; n_all_* also count what deobfuscation adds."""
    found = find_pii(table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda x: x["base"]))

    def count(spans: str, kind: str) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")

    def counts(spans: str, prefix: str) -> list[Column]:
        return [count(spans, k).alias(prefix + k) for k in KINDS]

    return found.select(
        "doc_id", *counts("base", "n_"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), *counts("spans", "n_all_")
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document what is left, as a digest, and how many lines and runs of lines went."""
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), short_repeats=True)
    return kept.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and threshold are rounded, so that sums in another order give the same row."""
    judged = filter_urls(table(spark, sf_dir, "pages"))
    return judged.withColumns({c: F.round(c, 6) for c in ("score", "threshold")})


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_ALL = (
    op1_quality, op2_ann, op3_suffix_dedup, op4_pii, op5_line_dedup, op6_decontamination, op7_jaccard_join, op8_url_filter, op9_packing, op10_token_counts, op11_whitening,
    op12_minhash_dedup, op13_collocations,
)
QUERIES = {q.__name__: q for q in _ALL}

#: All strings of 200 bytes as hexadecimal text, by brute force.
_OP3 = """WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
    w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT doc_id, x, unnest(range(CAST(length(x) / 2 AS BIGINT) - 199)) AS i FROM d)),
    again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
    marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM again),
    runs AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM marked) GROUP BY doc_id, r),
    gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b, b - a AS gone FROM runs),
    cut AS (SELECT g.doc_id, string_agg(substr(d.x, 2 * g.a + 1, 2 * (g.b - g.a)), '' ORDER BY g.a) AS kept, sum(gone) AS gone, count(*) AS n FROM gaps g JOIN d ON g.doc_id = d.doc_id GROUP BY g.doc_id),
    tail AS (SELECT doc_id, max(b) AS b FROM runs GROUP BY doc_id)
    SELECT d.doc_id, CAST(length(d.x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(c.gone, 0) AS BIGINT) AS n_removed, coalesce(c.n, 0) AS n_spans,
        sha256(unhex(CASE WHEN c.doc_id IS NULL THEN d.x ELSE c.kept || substr(d.x, 2 * t.b + 1) END)) AS kept_sha256
    FROM d LEFT JOIN cut c ON c.doc_id = d.doc_id LEFT JOIN tail t ON t.doc_id = d.doc_id"""
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
#: Windows of 13 words with 11 equal; items of up to 12 words whole.
_OP6 = f"""WITH dw AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS p, len(w) AS n FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
    bw AS (SELECT item_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS q, len(w) AS m FROM (SELECT min(item_id) AS item_id, {_WORDS} AS w FROM benchmark GROUP BY text) WHERE len(w) >= 1),
    eq AS (SELECT doc_id, item_id, p, p - q AS diagonal, greatest(0, p - q) AS lo, least(n, m + p - q) AS hi, least(13, m) AS size, CASE WHEN m >= 13 THEN 11 ELSE m END AS least FROM dw JOIN bw USING (w)),
    near AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, diagonal) AS k FROM eq) WHERE k >= least AND hi - lo >= size),
    s AS (SELECT doc_id, item_id, diagonal, size, least, unnest(range(lo, hi - size + 1)) AS s FROM (SELECT DISTINCT doc_id, item_id, diagonal, lo, hi, size, least FROM near)),
    good AS (SELECT s.doc_id, s.item_id, s.diagonal, s.s, s.size, s.least FROM s JOIN near n ON n.doc_id = s.doc_id AND n.item_id = s.item_id AND n.diagonal = s.diagonal AND n.p BETWEEN s.s AND s.s + s.size - 1 GROUP BY ALL HAVING count(*) >= s.least),
    cover AS (SELECT DISTINCT doc_id, item_id, diagonal, unnest(range(s, s + size)) AS p FROM good),
    sums AS (SELECT c.doc_id, c.item_id, c.diagonal, min(c.p) AS doc_start, count(*) AS n_words, count(n.p) AS n_equal FROM cover c LEFT JOIN near n ON n.doc_id = c.doc_id AND n.item_id = c.item_id AND n.diagonal = c.diagonal AND n.p = c.p GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, doc_start, doc_start - diagonal) AS r FROM sums)
    SELECT doc_id, item_id, CAST(doc_start AS INT) AS doc_start, CAST(doc_start - diagonal AS INT) AS item_start, CAST(n_words AS INT) AS n_words, CAST(n_equal AS INT) AS n_equal FROM best WHERE r = 1"""
_OP7 = f"""WITH RECURSIVE t AS (SELECT text, min(doc_id) AS id, count(*) AS docs FROM documents GROUP BY text),
    w AS (SELECT id, {_WORDS} AS w FROM t),
    sh AS (SELECT DISTINCT id, g FROM (SELECT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)),
    size AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
    pairs AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
    links AS (SELECT x, y FROM pairs JOIN size s ON s.id = x JOIN size u ON u.id = y WHERE 5 * k >= 4 * (s.n + u.n - k)),
    reach(id, root) AS (SELECT id, id FROM t UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.id),
    class AS (SELECT id, min(root) AS class_id FROM reach GROUP BY id),
    n AS (SELECT x AS id, count(*) AS n_links, sum(u.docs) AS linked FROM links JOIN t u ON u.id = y GROUP BY x),
    filled AS (SELECT t.id FROM t JOIN size ON size.id = t.id)
    SELECT d.doc_id, CASE WHEN f.id IS NULL THEN d.doc_id ELSE t.id END AS copy_id, CASE WHEN f.id IS NULL THEN d.doc_id ELSE c.class_id END AS class_id, coalesce(n.n_links, 0) AS n_links,
        CAST(CASE WHEN f.id IS NULL THEN 0 ELSE coalesce(n.linked, 0) + t.docs - 1 END AS BIGINT) AS n_linked_docs
    FROM documents d JOIN t ON t.text = d.text JOIN class c ON c.id = t.id LEFT JOIN n ON n.id = t.id LEFT JOIN filled f ON f.id = t.id"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP12 = f"""WITH RECURSIVE t AS (SELECT text, min(doc_id) AS id FROM documents GROUP BY text),
    w AS (SELECT id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM t),
    sh AS (SELECT DISTINCT id, g FROM (SELECT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)),
    size AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
    pairs AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
    links AS (SELECT x, y FROM pairs JOIN size s ON s.id = x JOIN size u ON u.id = y WHERE 100 * k >= 85 * (s.n + u.n - k)),
    reach(id, root) AS (SELECT id, id FROM t UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.id),
    class AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, CASE WHEN s.n IS NULL THEN d.doc_id ELSE c.root END AS component_id, s.n IS NULL OR d.doc_id = c.root AS kept
    FROM documents d JOIN t ON t.text IS NOT DISTINCT FROM d.text JOIN class c ON c.id = t.id LEFT JOIN size s ON s.id = t.id"""
_OP13 = f"""WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
    n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
    g AS (SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, greatest(1, len(w) - k + 2)), lambda i: w[i : i + k - 1])))) AS g FROM w),
    f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
    c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1),
    inner_of AS (SELECT lang, g[i : j] AS g, a FROM (SELECT lang, g, a, i, unnest(range(i + 1, len(g) + 1)) AS j FROM (SELECT *, unnest(range(1, len(g))) AS i FROM c)) WHERE j - i + 1 < len(g)),
    gone AS (SELECT DISTINCT c.lang, c.g FROM c JOIN inner_of o ON o.lang = c.lang AND o.g = c.g WHERE 100 * o.a >= 100 * c.a),
    cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM c WHERE (lang, g) NOT IN (SELECT (lang, g) FROM gone)),
    scored AS (SELECT x.lang, x.g, k, a, l.f AS l, r.f AS r, n, CAST(1000 * CAST(a AS HUGEINT) * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
        FROM cuts x JOIN f l ON l.lang = x.lang AND l.g = x.g[1 : k] JOIN f r ON r.lang = x.lang AND r.g = x.g[k + 1 :] JOIN n ON n.lang = x.lang),
    least AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM scored) WHERE o = 1),
    ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM least)
    SELECT * FROM ranked WHERE rank <= 2000"""


def _rule_case(value: int) -> str:
    """The longest rule that fits, or its verdict, as a CASE."""
    whens = []
    for verdict, host, path in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        whens.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{(host + path, verdict)[value]}'")
    return "CASE " + " ".join(whens) + " END"


_OP8 = f"""WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    hosts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM cut),
    parts AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM hosts),
    known AS (SELECT page_id, host, path, {_rule_case(0)} AS rule, {_rule_case(1)} AS own FROM parts),
    urls AS (SELECT host, path, own, count(*) AS n FROM known GROUP BY ALL),
    letters AS (SELECT *, list_transform(string_split('^^' || regexp_replace(regexp_replace(lower(host || path), '[0-9]', '0', 'g'), '[^a-z0/.\\-_]', '~', 'g') || '$', ''), lambda x: instr('{ALPHABET}', x) - 1) AS c FROM urls),
    grams AS (SELECT host, path, own, n, unnest(list_transform(range(3, len(c) + 1), lambda i: (c[i - 2] * {N} + c[i - 1]) * {N} + c[i])) AS code FROM letters),
    counts AS (SELECT own = 'allow' AS cls, code, sum(n) AS n FROM grams WHERE own IS NOT NULL GROUP BY ALL),
    grid AS (SELECT cls, code FROM (SELECT unnest([TRUE, FALSE]) AS cls), (SELECT unnest(range({N**3})) AS code)),
    cells AS (SELECT g.cls, g.code, CAST(coalesce(n, 0) AS DOUBLE) AS n, g.code % {N} AS c, g.code // {N} AS ab, g.code // {N} % {N} AS b FROM grid g LEFT JOIN counts k ON k.cls = g.cls AND k.code = g.code),
    sums AS (SELECT *, sum(n) OVER (PARTITION BY cls, b, c) AS n_bc, sum(n) OVER (PARTITION BY cls, c) AS n_c, sum(n) OVER (PARTITION BY cls) AS n_all, sum(n) OVER (PARTITION BY cls, ab) AS n_ab,
        count(*) FILTER (n > 0) OVER (PARTITION BY cls, ab) AS t_ab, sum(n) OVER (PARTITION BY cls, b) AS n_b FROM cells),
    kinds AS (SELECT *, count(*) FILTER (n_bc > 0) OVER (PARTITION BY cls, b) / CAST({N} AS DOUBLE) AS t_b, (n_c + 1) / (n_all + {N}) AS p1 FROM sums),
    pairs AS (SELECT *, CASE WHEN n_b > 0 THEN (n_bc + t_b * p1) / (n_b + t_b) ELSE p1 END AS p2 FROM kinds),
    model AS (SELECT code, sum(CASE WHEN cls THEN 1 ELSE -1 END * ln(CASE WHEN n_ab > 0 THEN (n + t_ab * p2) / (n_ab + t_ab) ELSE p2 END)) AS ratio FROM pairs GROUP BY code),
    scores AS (SELECT host, path, own, avg(ratio) AS score FROM grams JOIN model USING (code) GROUP BY ALL),
    bins AS (SELECT least(399, greatest(0, CAST(floor((score + 4.0) / 0.02) AS INT))) AS bin, count(*) FILTER (own = 'allow') AS a, count(*) FILTER (own = 'block') AS b FROM scores WHERE own IS NOT NULL GROUP BY 1),
    totals AS (SELECT CAST(sum(a) AS DOUBLE) AS all_a, CAST(sum(b) AS DOUBLE) AS all_b FROM bins),
    errors AS (SELECT k, coalesce(sum(a), 0) / all_a + (all_b - coalesce(sum(b), 0)) / all_b AS e FROM (SELECT unnest(range(401)) AS k) CROSS JOIN totals LEFT JOIN bins ON bin < k GROUP BY k, all_a, all_b),
    cutoff AS (SELECT coalesce(-4.0 + (min(k) + max(k)) / 2.0 * 0.02, 0.0) AS threshold FROM errors WHERE e <= (SELECT min(e) FROM errors) + 1e-12)
    SELECT page_id, k.host, k.path, rule, coalesce(k.own, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score, round(CAST(threshold AS DOUBLE), 6) AS threshold
    FROM known k JOIN scores s ON s.host = k.host AND s.path = k.path CROSS JOIN cutoff"""

#: The others need learned models, hash functions or tokenisers that SQL does not have; they are tested
#: against brute force, exact round trips and held-out labels.
ORACLE: dict[str, str] = {"op3_suffix_dedup": _OP3, "op6_decontamination": _OP6, "op7_jaccard_join": _OP7, "op8_url_filter": _OP8, "op12_minhash_dedup": _OP12, "op13_collocations": _OP13}
