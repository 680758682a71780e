"""Registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadworthy.llm import (
    decontamination, language_id, licenses, mixing, pivot_index, quality, sharding, simhash, spelling, suffix_dedup, url_filter, vptree, whitening,
)
from roadworthy.llm.common import ascii_lower, table

QUALITY_LEAST = 0.3
ANN_K, ANN_RECALL = 10, 0.96
SHARDS = 24
SIMHASH_SHINGLE, SIMHASH_BITS = 3, 2
MIX_RATIO, MIX_EPOCHS, MIX_SEED = 1.0, 2, 7
WORD_LENGTH, WORD_LEAST, WORD_RATIO = 5, 3, 2.0
WHITE_COMPONENTS = 32
TOP_K = 20
#: Unequal target weights of a level's nodes (1 where not named); powers of two, so that sums of them are exact.
MIX_WEIGHTS = {
    "domain": {"d0": 4.0, "d1": 2.0, "other": 0.5},
    "lang": {"en": 4.0, "de": 2.0, "fr": 0.5},
    "source": {"src0": 2.0, "src1": 0.25, "src7": 4.0, "src12": 0.5},
}


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's nearest neighbours; queries are the rows whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vptree.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=ANN_K, factor=None, recall=ANN_RECALL)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = language_id.learn(docs.where(~held_out).select("text", F.col("lang").alias("label")))
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents chosen for the mixture, each with its leaf, tokens and number of copies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    tokens, leaves = mixing.plan(docs, MIX_RATIO, MIX_EPOCHS, MIX_SEED)
    return mixing.copies(tokens, leaves, MIX_SEED)


def op3_mixing_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op3_mixing``, to the unequal weights of ``MIX_WEIGHTS`` at every level."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    tokens, leaves = mixing.plan(docs, MIX_RATIO, MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS)
    return mixing.copies(tokens, leaves, MIX_SEED)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    held_out = fold(F.col("doc_id"), 5) == 0
    net = quality.learn(docs, labels.where(~held_out))
    found = quality.score(docs.withColumn("held_out", held_out), net)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.scan(docs, table(spark, sf_dir, "benchmark"))
    found = found.select("doc_id", "n_words", "items", decontamination.hit_words(F.col("words")).alias("n_hit"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        decontamination.sha256_of(F.col("items")).alias("items_sha256"),
        decontamination.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.deduplicate(docs, keep_bytes=False)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices and whole licence texts, as units and as windows of words; tested against a brute-force version."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), licenses.whole_texts(), within=True)
    return found.withColumn("score", F.round("score", 6))


def op8_license_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notices that are units of a text (a line, a paragraph or all of it), as the SQL has them."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("score", F.round("score", 6))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, shingle=SIMHASH_SHINGLE, distance=SIMHASH_BITS)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.assign(docs, ["doc_id"], [1.0] * SHARDS, next_weight=1.0, ties=["text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def spelled(docs: DataFrame, length: int) -> DataFrame:
    """(word, n): every run of at least ``length`` letters, some with one letter left out, as their crc32 says."""
    runs = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"[a-z\u00C0-\u00FF]{{{length},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h, at = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % 97 == 0, less).otherwise(F.col("run")).alias("word"), F.lit(1).alias("n"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A run never gets longer, so shorter ones than the least word are left out at once.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(spelled(docs, WORD_LENGTH), WORD_LENGTH, WORD_LEAST, WORD_RATIO)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), WHITE_COMPONENTS)
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = pivot_index.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=TOP_K, scale=64.0)
    return found.select("query_id", "rank", "vec_id", "score")


def _water_fill(children: str, parent: str, budget: str, order: str) -> str:
    """DuckDB: children (cap, weight) with ``share`` of their parent's budget."""
    return f"""
      SELECT * EXCLUDE (rate, whole, open_rate),
             CASE WHEN whole THEN cap ELSE CAST(floor(open_rate * weight) AS BIGINT) END AS share FROM (
        SELECT *, max(CASE WHEN NOT whole THEN rate END) OVER (PARTITION BY {parent}) AS open_rate FROM (
          SELECT *, cap <= rate * weight AS whole FROM (
            SELECT *, ({budget} - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / weight, {order}
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                      / sum(weight) OVER (PARTITION BY {parent} ORDER BY cap / weight, {order}
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
            FROM {children})))"""


def _pay(children: str, parent: str, budget: str) -> str:
    """DuckDB: children (taken, offer) with ``paid``, whether their parent's rest reaches their offer."""
    return f"""
      SELECT *, offer IS NOT NULL AND
        sum(offer.n) OVER (PARTITION BY {parent} ORDER BY offer NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        <= {budget} - sum(taken) OVER (PARTITION BY {parent}) AS paid FROM {children}"""


_UP = "sum(taken + CASE WHEN paid THEN offer.n ELSE 0 END) AS taken, min(CASE WHEN NOT paid THEN offer END) AS offer, max(total) AS total"


def _weight_sql(level: str, weights: dict[str, dict[str, float]]) -> str:
    named = weights.get(level)
    if not named:
        return "1.0::DOUBLE"
    return f"CASE {level} {' '.join(f'WHEN {_quoted(k)} THEN {w}::DOUBLE' for k, w in named.items())} ELSE 1.0::DOUBLE END"


def mix_sql(ratio: float, epochs: int, seed: int, weights: dict[str, dict[str, float]] | None = None) -> str:
    by_domain, by_lang, by_source = (_weight_sql(level, weights or {}) for level in mixing.LEAF)
    return f"""
WITH tok AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) <> ''
              THEN 'd' || CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1)::INT // 5 AS VARCHAR) ELSE 'other' END AS domain,
         CAST(coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0) AS BIGINT) AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM tok GROUP BY ALL),
capped AS (SELECT *, CAST(tokens * {epochs} AS BIGINT) AS cap, {by_source} AS weight FROM leaf),
lang0 AS (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap, {by_lang} AS weight FROM capped GROUP BY ALL),
dom0 AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, {by_domain} AS weight, '' AS root,
                (SELECT CAST(least(floor(sum(tokens) * {ratio}), sum(cap)) AS BIGINT) FROM capped) AS total
         FROM capped GROUP BY ALL),
dom AS ({_water_fill("dom0", "root", "total", "domain")}),
lang1 AS (SELECT l.*, d.share AS b, d.total FROM lang0 l JOIN dom d USING (domain)),
lng AS ({_water_fill("lang1", "domain", "b", "domain, lang")}),
leaf1 AS (SELECT c.*, l.share AS b, l.b AS domain_b, l.total FROM capped c JOIN lng l USING (domain, lang)),
shares AS ({_water_fill("leaf1", "domain, lang", "b", "domain, lang, source")}),
plan AS (SELECT domain, lang, source, tokens, b AS lang_b, domain_b, total,
                CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS epochs,
                share - CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END * tokens AS rest FROM shares),
keyed AS (SELECT t.*, p.epochs, p.rest,
                 md5('{seed}:' || p.epochs || ':' || coalesce(CAST(t.doc_id AS VARCHAR), '')) AS key
          FROM tok t JOIN plan p USING (domain, lang, source)),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM keyed),
prefix AS (SELECT domain, lang, source, coalesce(max(upto) FILTER (upto <= rest), 0) AS used,
                  min(key) FILTER (upto > rest) AS next_key, min(upto) FILTER (upto > rest) AS next_upto
           FROM run WHERE rest > 0 GROUP BY ALL),
leaf2 AS (SELECT p.*, next_key, epochs * tokens + coalesce(used, 0) AS taken,
                 CASE WHEN next_key IS NOT NULL
                      THEN {{'n': next_upto - used, 'domain': domain, 'lang': lang, 'source': source}} END AS offer
          FROM plan p LEFT JOIN prefix USING (domain, lang, source)),
leaf3 AS ({_pay("leaf2", "domain, lang", "lang_b")}),
lang3 AS ({_pay(f"(SELECT domain, lang, max(domain_b) AS domain_b, {_UP} FROM leaf3 GROUP BY domain, lang)", "domain", "domain_b")}),
dom3 AS ({_pay(f"(SELECT domain, '' AS root, {_UP} FROM lang3 GROUP BY domain)", "root", "total")}),
paid AS (SELECT unnest(offer) FROM (SELECT offer FROM leaf3 WHERE paid UNION ALL SELECT offer FROM lang3 WHERE paid
                                    UNION ALL SELECT offer FROM dom3 WHERE paid)),
handed AS (SELECT domain, lang, source, next_key FROM leaf2 JOIN paid USING (domain, lang, source)),
counted AS (
  SELECT r.*, epochs + CASE WHEN rest > 0 AND (upto <= rest OR key <= next_key) THEN 1 ELSE 0 END AS c
  FROM run r LEFT JOIN handed USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, CAST(c AS INT) AS copies FROM counted WHERE c > 0
"""

OP6_SQL = """
WITH cut AS (
  SELECT page_id, row_number() OVER () AS r, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosted AS (SELECT page_id, r, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
seen AS (
  SELECT page_id, r, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM hosted),
rules(rule, rhost, rpath, rverdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
  ('com/de/', 'com', '/de/', 'block')),
ruled AS (
  SELECT s.page_id, s.r, s.host, s.path, max_by(u.rule, length(u.rule)) AS rule, max_by(u.rverdict, length(u.rule)) AS rverdict
  FROM seen s LEFT JOIN rules u
    ON (s.host = u.rhost OR suffix(s.host, '.' || u.rhost)) AND starts_with(s.path, u.rpath)
  GROUP BY ALL),
hosts AS (
  SELECT host, count(rverdict) AS n, count(*) FILTER (rverdict = 'block') AS k,
         list_reverse(string_split(host, '.')) AS l FROM ruled GROUP BY host),
named AS (
  SELECT host, n, k, l[1] AS last1, CASE WHEN len(l) > 1 THEN l[2] || '.' || l[1] ELSE l[1] END AS last2,
         CASE WHEN len(l) > 2 THEN l[3] || '.' || l[2] || '.' || l[1] ELSE host END AS last3 FROM hosts),
tree AS (
  SELECT host, n, k,
         CASE WHEN last2 IN ('ac.uk', 'co.jp', 'co.uk', 'com.au', 'com.br', 'org.uk') THEN last3 ELSE last2 END AS domain,
         CASE WHEN last2 IN ('ac.uk', 'co.jp', 'co.uk', 'com.au', 'com.br', 'org.uk') THEN last2 ELSE last1 END AS suffix
  FROM named),
r0 AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS p FROM tree),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT p FROM r0) AS p FROM tree GROUP BY suffix),
s1 AS (SELECT 1 / least(greatest(coalesce(CASE WHEN sum(n * (n - 1)) > 0
         THEN (sum((k - n * p) * (k - n * p) / (p * (1 - p))) - sum(n)) / sum(n * (n - 1)) END, 0.9), 0.001), 0.9) - 1 AS w FROM s0),
s2 AS (SELECT suffix, (k + w * p) / (n + w) AS p FROM s0, s1),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k, any_value(s2.p) AS p FROM tree JOIN s2 USING (suffix) GROUP BY ALL),
d1 AS (SELECT 1 / least(greatest(coalesce(CASE WHEN sum(n * (n - 1)) > 0
         THEN (sum((k - n * p) * (k - n * p) / (p * (1 - p))) - sum(n)) / sum(n * (n - 1)) END, 0.9), 0.001), 0.9) - 1 AS w FROM d0),
d2 AS (SELECT domain, (k + w * p) / (n + w) AS p FROM d0, d1),
h0 AS (SELECT host, n, k, d2.p FROM tree JOIN d2 USING (domain)),
h1 AS (SELECT 1 / least(greatest(coalesce(CASE WHEN sum(n * (n - 1)) > 0
         THEN (sum((k - n * p) * (k - n * p) / (p * (1 - p))) - sum(n)) / sum(n * (n - 1)) END, 0.9), 0.001), 0.9) - 1 AS w FROM h0),
h2 AS (SELECT host, k + w * p AS a, n - k + w * (1 - p) AS b FROM h0, h1),
bad AS (SELECT host FROM h2 WHERE a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5)
SELECT page_id, host, path, rule, coalesce(rverdict, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NORMAL = "replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'licence', 'license')"
_WORDS = "regexp_extract_all({}, '[a-z0-9]+')"

OP8_UNITS_SQL = f"""
WITH template(license, t) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in licenses.TEMPLATES.items())}),
template_words AS (SELECT license, {_WORDS.format(_NORMAL.format("t"))} AS w FROM template),
template_pairs AS (
  SELECT license, pair, count(*) AS n FROM (
    SELECT license, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM template_words) GROUP BY ALL),
docs AS (SELECT doc_id, row_number() OVER () AS r, string_split({_NORMAL.format("text")}, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, r, unnest(l) AS x, CAST(unnest(range(0, len(l))) AS INT) AS i FROM docs),
worded AS (SELECT doc_id, r, i, {_WORDS.format("x")} AS w FROM line),
placed AS (SELECT *, sum(CASE WHEN len(w) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS p FROM worded),
filled AS (SELECT * FROM placed WHERE len(w) > 0),
unit AS (
  SELECT doc_id, r, i AS first_line, i AS last_line, w FROM filled
  UNION ALL
  SELECT doc_id, r, min(i), max(i), flatten(list(w ORDER BY i)) FROM filled GROUP BY doc_id, r, p HAVING count(*) > 1
  UNION ALL
  SELECT doc_id, r, min(i), max(i), flatten(list(w ORDER BY i)) FROM filled GROUP BY doc_id, r HAVING count(DISTINCT p) > 1),
unit_pairs AS (
  SELECT doc_id, r, first_line, last_line, size, pair, count(*) AS n FROM (
    SELECT doc_id, r, first_line, last_line, len(w) - 1 AS size,
           unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair
    FROM unit WHERE len(w) BETWEEN 2 AND 200) GROUP BY ALL),
scored AS (
  SELECT u.doc_id, u.r, u.first_line, u.last_line, t.license,
         2 * sum(least(u.n, t.n)) / (any_value(u.size) + any_value(len(w.w) - 1)) AS score
  FROM unit_pairs u JOIN template_pairs t USING (pair) JOIN template_words w USING (license) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r, first_line, last_line ORDER BY score DESC, license) AS k
           FROM scored WHERE score >= {licenses.LEAST})
SELECT doc_id, first_line, last_line, license, round(score, 6) AS score FROM ranked WHERE k = 1
"""

OP13_SQL = f"""
WITH given AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS x FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(coalesce(list_dot_product(q.x, v.x), 0) AS BIGINT) AS score
  FROM given q JOIN given v ON len(q.x) = len(v.x) AND q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP_K}
"""

QUERIES = {
    "op1_ann": op1_ann,
    "op2_language_id": op2_language_id,
    "op3_mixing": op3_mixing,
    "op3_mixing_weighted": op3_mixing_weighted,
    "op4_quality": op4_quality,
    "op5_decontamination": op5_decontamination,
    "op6_url_filter": op6_url_filter,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_licenses": op8_licenses,
    "op8_license_units": op8_license_units,
    "op9_simhash": op9_simhash,
    "op10_sharding": op10_sharding,
    "op11_spelling": op11_spelling,
    "op12_whitening": op12_whitening,
    "op13_top_k": op13_top_k,
}
ORACLE = {"op3_mixing": mix_sql(MIX_RATIO, MIX_EPOCHS, MIX_SEED),
          "op3_mixing_weighted": mix_sql(MIX_RATIO, MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS), "op6_url_filter": OP6_SQL, "op8_license_units": OP8_UNITS_SQL,
          "op13_top_k": OP13_SQL}
