"""The engine's queries over the driver's tables, each beside its SQL.

Stand-ins: a document is an item (doc_id its path and order, its text's digest
its bytes), labels.quality its label, an embedding a picture's vector, a page an
upload, an event a journal line. Two signals score a document: a, its length
against 2,000 characters, and b, the share of its words that differ.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triage import config
from triage.functions import boxes, hashing, scores, text
from triage.operators import dedup, evaluation, signals, workflow
from triage.sources import tables

SETTINGS = config.Settings(thresholds={"a": (0.40, 0.80), "b": (0.55, 0.75)}, signals=("a", "b"))
TERMS = ("blue steel", "small brass", "promo tin")
FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL if there is one."""

    def add(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict:
    return {k: f for k, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for k, (_, q) in FOUND.items() if q}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- scored items ---------------------------------------------------------


def scored_documents(docs: DataFrame) -> DataFrame:
    a = F.least(F.lit(1.0), F.col("n_chars") / 2000.0)
    tokens = F.split("text", " ")
    b = F.size(F.array_distinct(tokens)).cast("double") / F.size(tokens)
    return docs.select("doc_id", F.array(signals.signal_struct("a", a, None, F.lit("")), signals.signal_struct("b", b, None, F.lit(""))).alias("signals"), a.alias("a"), b.alias("b"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label"))
    return labels.join(scored_documents(table(spark, sf_dir, "documents")), F.col("item") == F.col("doc_id")).drop("doc_id")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.judged(scored(spark, sf_dir), SETTINGS)


def judged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.judged(scored_documents(table(spark, sf_dir, "documents")), SETTINGS)


_SCORES = """least(1.0, n_chars / 2000.0)::DOUBLE AS a,
  len(list_distinct(string_split(text, ' ')))::DOUBLE / len(string_split(text, ' ')) AS b"""
_DOCS = f"docs AS (SELECT doc_id, text, {_SCORES} FROM documents)"
_SCORED = f"{_DOCS}, scored AS (SELECT d.doc_id AS item, CASE WHEN l.quality = 1 THEN 'positive' ELSE 'negative' END AS label, a, b FROM docs d JOIN labels l ON l.doc_id = d.doc_id)"


def _norm(x: str, weak: float, strong: float) -> str:
    return (
        f"CASE WHEN {x} >= {strong} THEN 0.85 + ({x} - {strong}::DOUBLE) / (1.0 - {strong})::DOUBLE * (1.0 - 0.85) "
        f"WHEN {x} >= {weak} THEN 0.5 + ({x} - {weak}::DOUBLE) / ({strong} - {weak})::DOUBLE * (0.85 - 0.5) "
        f"ELSE {x} / {weak}::DOUBLE * 0.5 END::DOUBLE"
    )


def _rank(x: str, weak: float, strong: float) -> str:
    return f"CASE WHEN {x} >= {strong} THEN 2 WHEN {x} >= {weak} THEN 1 ELSE 0 END"


def _judged(base: str, a=(0.4, 0.8), b=(0.55, 0.75)) -> str:
    return f"""ranked AS (SELECT *, {_rank('a', *a)} AS ra, {_rank('b', *b)} AS rb, {_norm('a', *a)} AS na, {_norm('b', *b)} AS nb FROM {base}),
judged AS (SELECT *, greatest(ra, rb) AS r,
  CASE greatest(ra, rb) WHEN 2 THEN 'positive' WHEN 1 THEN 'review' ELSE 'negative' END AS band,
  CASE WHEN ra > rb THEN na WHEN rb > ra THEN nb ELSE greatest(na, nb) END AS confidence,
  CASE WHEN greatest(ra, rb) = 0 THEN 'none' WHEN ra > rb THEN 'a' WHEN rb > ra THEN 'b' WHEN na >= nb THEN 'a+b' ELSE 'b+a' END AS method FROM ranked)"""


_J = f"WITH {_SCORED}, {_judged('scored')}"
_JD = f"WITH {_DOCS}, {_judged('docs')}"
#: Thresholds that many items miss, so that reports of misses have rows.
STRICT = config.Settings(thresholds={"a": (0.90, 0.95), "b": (0.90, 0.97)}, signals=("a", "b"))
_JS = f"WITH {_SCORED}, {_judged('scored', *STRICT.thresholds.values())}"


@query(f"{_J} SELECT item, band, round(confidence, 9) AS confidence, method FROM judged")
def decide_bands(spark, sf_dir):
    return judged(spark, sf_dir).select("item", "band", F.round("confidence", 9).alias("confidence"), "method")


@query(f"WITH {_DOCS} SELECT doc_id, round({_norm('a', .4, .8)}, 9) AS conf_a, round({_norm('b', .55, .75)}, 9) AS conf_b, {_rank('a', .4, .8)} AS rank_a FROM docs")
def normalize_confidence(spark, sf_dir):
    rows = scored_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.round(scores.normalize(F.col("a"), 0.4, 0.8), 9).alias("conf_a"), F.round(scores.normalize(F.col("b"), 0.55, 0.75), 9).alias("conf_b"), scores.band_rank(F.col("a"), 0.4, 0.8).alias("rank_a"))


@query(f"""{_J}, grid AS (SELECT * FROM (VALUES ('positive'), ('negative')) l(label), (VALUES ('positive'), ('review'), ('negative')) b(band))
SELECT g.label, g.band, count(j.item) AS n FROM grid g LEFT JOIN judged j ON j.label = g.label AND j.band = g.band GROUP BY ALL""")
def confusion_matrix(spark, sf_dir):
    return evaluation.counts(judged(spark, sf_dir))


_METRICS = """count(*) AS images, count(*) FILTER (label = 'positive') AS positives, count(*) FILTER (label <> 'positive') AS negatives,
 count(*) FILTER (band = 'positive') AS flagged, count(*) FILTER (band <> 'negative' AND label = 'positive') AS caught, count(*) FILTER (band = 'review') AS in_review,
 count(*) FILTER (band = 'negative' AND label = 'positive') AS missed,
 round(coalesce(count(*) FILTER (band = 'positive' AND label = 'positive')::DOUBLE / nullif(count(*) FILTER (band = 'positive'), 0), 0), 4) AS precision,
 round(coalesce(count(*) FILTER (band <> 'negative' AND label = 'positive')::DOUBLE / nullif(count(*) FILTER (label = 'positive'), 0), 0), 4) AS catch_recall,
 round(coalesce(count(*) FILTER (band = 'review')::DOUBLE / nullif(count(*), 0), 0), 4) AS review_share"""


@query(f"{_J} SELECT {_METRICS} FROM judged")
def decision_metrics(spark, sf_dir):
    return evaluation.metrics(judged(spark, sf_dir))


@query(f"{_J} SELECT split_part(method, '+', 1) AS signal, count(*) AS wins FROM judged WHERE band <> 'negative' GROUP BY 1")
def signal_wins(spark, sf_dir):
    return evaluation.wins(judged(spark, sf_dir))


@query(f"{_JS} SELECT item FROM judged WHERE label = 'positive' AND band = 'negative'")
def false_negatives(spark, sf_dir):
    return evaluation.misses(evaluation.judged(scored(spark, sf_dir), STRICT))


@query(f"{_J} SELECT item FROM judged WHERE label = 'negative' AND band = 'positive'")
def false_positives(spark, sf_dir):
    return evaluation.false_alarms(judged(spark, sf_dir))


@query(f"""{_JS} SELECT item, CASE WHEN a <= 0 AND b <= 0 THEN 'invisible to every signal' WHEN a >= b THEN printf('a reached %.2f, needs 0.90', round(a, 2)) ELSE printf('b reached %.2f, needs 0.90', round(b, 2)) END AS reason
FROM judged WHERE label = 'positive' AND band = 'negative'""")
def miss_reasons(spark, sf_dir):
    rows = evaluation.judged(scored(spark, sf_dir), STRICT).filter("label = 'positive' and band = 'negative'")
    return rows.select("item", evaluation.miss_reason(F.col("signals"), STRICT).alias("reason"))


@query(f"{_J} SELECT method, count(*) AS n FROM judged GROUP BY method")
def method_histogram(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


# -- sweeps and calibration -----------------------------------------------

_LONG = "long AS (SELECT 'a' AS signal, label, a AS score FROM scored UNION ALL SELECT 'b', label, b FROM scored)"
_GRID = "grid AS (SELECT round(0.05 * i, 2)::DOUBLE AS t FROM range(1, 20) r(i))"
_SHARE = "coalesce(({})::DOUBLE / nullif({}, 0), 0)"


@query(f"""WITH {_SCORED}, {_LONG}, {_GRID} SELECT signal, t AS threshold,
 round({_SHARE.format("count(*) FILTER (score >= t AND label = 'positive')", "count(*) FILTER (label = 'positive')")}, 4) AS recall,
 round({_SHARE.format("count(*) FILTER (score >= t AND label = 'positive')", "count(*) FILTER (score >= t)")}, 4) AS precision FROM long, grid GROUP BY ALL""")
def threshold_curve(spark, sf_dir):
    return evaluation.curve(evaluation.long_scores(scored(spark, sf_dir)))


_SWEEP = f"""sweep AS (SELECT signal, g.t AS review_t, h.t AS positive_t,
 {_SHARE.format("count(*) FILTER (score >= h.t AND label = 'positive')", "count(*) FILTER (score >= h.t)")} AS precision,
 {_SHARE.format("count(*) FILTER (score >= g.t AND label = 'positive')", "count(*) FILTER (label = 'positive')")} AS catch_recall,
 {_SHARE.format("count(*) FILTER (score >= g.t AND score < h.t)", "count(*)")} AS review_share,
 count(*) FILTER (score < g.t AND label = 'positive') AS missed FROM long, grid g JOIN grid h ON g.t <= h.t GROUP BY ALL)"""
_ROUNDED = "round(precision, 6) AS precision, round(catch_recall, 6) AS catch_recall, round(review_share, 6) AS review_share"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "catch_recall", "review_share")})


@query(f"WITH {_SCORED}, {_LONG}, {_GRID}, {_SWEEP} SELECT signal, review_t, positive_t, {_ROUNDED}, missed FROM sweep")
def pair_sweep(spark, sf_dir):
    return _rounded(evaluation.sweep(evaluation.long_scores(scored(spark, sf_dir))))


_BEST = "QUALIFY row_number() OVER (PARTITION BY signal ORDER BY catch_recall DESC, precision DESC, review_share, review_t, positive_t) = 1"


@query(f"WITH {_SCORED}, {_LONG}, {_GRID}, {_SWEEP}, best AS (SELECT * FROM sweep {_BEST}) SELECT signal, review_t, positive_t, {_ROUNDED}, missed FROM best")
def best_operating_point(spark, sf_dir):
    return _rounded(evaluation.best_point(evaluation.sweep(evaluation.long_scores(scored(spark, sf_dir)))))


@query(f"WITH {_SCORED}, long AS (SELECT 'all' AS signal, label, greatest(a, b) AS score FROM scored), {_GRID}, {_SWEEP}, best AS (SELECT * FROM sweep {_BEST}) SELECT signal, review_t, positive_t, {_ROUNDED}, missed FROM best")
def naive_or(spark, sf_dir):
    return _rounded(evaluation.best_point(evaluation.sweep(evaluation.combined(scored(spark, sf_dir)))))


_COMBOS = f"""WITH {_SCORED}, g AS (SELECT round(0.05 * i, 2)::DOUBLE AS t FROM range(1, 21) r(i)), wa AS (SELECT w.t AS w, s.t AS s FROM g w JOIN g s ON w.t <= s.t),
combos AS (SELECT x.w AS a_weak, x.s AS a_strong, y.w AS b_weak, y.s AS b_strong,
 count(*) FILTER (a >= x.s - 1e-9 OR b >= y.s - 1e-9) AS flagged, count(*) FILTER ((a >= x.s - 1e-9 OR b >= y.s - 1e-9) AND label = 'positive') AS tp,
 count(*) FILTER ((a >= x.w - 1e-9 OR b >= y.w - 1e-9) AND label = 'positive') AS caught, count(*) FILTER (label = 'positive') AS positives, count(*) AS items,
 count(*) FILTER (NOT (a >= x.s - 1e-9 OR b >= y.s - 1e-9) AND (a >= x.w - 1e-9 OR b >= y.w - 1e-9)) AS in_review FROM scored, wa x, wa y GROUP BY ALL),
rated AS (SELECT *, {_SHARE.format("tp", "flagged")} AS precision, {_SHARE.format("caught", "positives")} AS catch_recall, {_SHARE.format("in_review", "items")} AS review_share FROM combos),
want AS (SELECT count(*) FILTER (catch_recall >= .97 - 1e-9 AND review_share <= .1 + 1e-9) AS feasible, max(catch_recall) FILTER (review_share <= .1 + 1e-9) AS under, max(catch_recall) AS anywhere FROM rated),
asked AS (SELECT feasible, coalesce(under, anywhere) AS attainable, CASE WHEN feasible > 0 THEN .97 ELSE coalesce(under, anywhere) END::DOUBLE AS target, CASE WHEN feasible > 0 OR under IS NOT NULL THEN .1 ELSE 1.0 END::DOUBLE AS cap FROM want),
chosen AS (SELECT * FROM rated, asked WHERE catch_recall >= target - 1e-9 AND review_share <= cap + 1e-9 ORDER BY precision DESC, catch_recall DESC, review_share, a_weak DESC, a_strong DESC, b_weak DESC, b_strong DESC LIMIT 1)"""


@query(f"{_COMBOS} SELECT a_weak, a_strong, b_weak, b_strong, flagged, tp, {_ROUNDED}, feasible FROM chosen")
def grid_search_best(spark, sf_dir):
    best = evaluation.search(scored(spark, sf_dir), ["a", "b"])
    return _rounded(best).select("a_weak", "a_strong", "b_weak", "b_strong", "flagged", "tp", "precision", "catch_recall", "review_share", "feasible")


@query(f"{_COMBOS} SELECT feasible, round(attainable, 6) AS attainable, round(target, 6) AS target, cap FROM asked")
def attainable_recall(spark, sf_dir):
    want = evaluation.relaxed_target(evaluation.combinations(scored(spark, sf_dir), ["a", "b"]), config.TARGET_RECALL, config.TARGET_REVIEW)
    return want.select("feasible", F.round("attainable", 6).alias("attainable"), F.round("target", 6).alias("target"), "cap")


@query(f"""{_J}, m AS (SELECT {_METRICS} FROM judged) SELECT catch_recall >= .97 - 1e-9 AND review_share <= .1 + 1e-9 AS passed,
 concat_ws('; ', CASE WHEN catch_recall < .97 - 1e-9 THEN printf('catch recall %.3f is under 0.97', catch_recall::DOUBLE) END, CASE WHEN review_share > .1 + 1e-9 THEN printf('review share %.3f is over 0.10', review_share::DOUBLE) END) AS failures FROM m""")
def gate_verdict(spark, sf_dir):
    return evaluation.gate(evaluation.metrics(judged(spark, sf_dir)))


# -- duplicates -----------------------------------------------------------

_EXACT = "exact AS (SELECT doc_id, sha256(text) AS digest, nullif(min(doc_id) OVER (PARTITION BY text), doc_id) AS duplicate_of FROM documents)"


def digested(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2("text", 256).alias("digest"))


@query(f"WITH {_EXACT} SELECT * FROM exact")
def exact_dedup(spark, sf_dir):
    return dedup.exact(digested(table(spark, sf_dir, "documents")), "digest", "doc_id")


@query(f"WITH {_EXACT} SELECT count(*) AS items, count(DISTINCT digest) AS originals, count(duplicate_of) AS copies FROM exact")
def dedup_summary(spark, sf_dir):
    rows = exact_dedup(spark, sf_dir)
    return rows.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("duplicate_of").isNull()).alias("originals"), F.count("duplicate_of").alias("copies"))


@query(f"{_JD}, {_EXACT} SELECT e.doc_id, e.duplicate_of, j.band, round(j.confidence, 9) AS confidence, j.method FROM exact e JOIN judged j ON j.doc_id = coalesce(e.duplicate_of, e.doc_id)")
def copy_verdict(spark, sf_dir):
    rows = exact_dedup(spark, sf_dir).select("doc_id", "duplicate_of")
    heads = judged_documents(spark, sf_dir).select("doc_id", "band", F.round("confidence", 9).alias("confidence"), "method")
    return dedup.copied(rows, heads, "doc_id").select("doc_id", "duplicate_of", "band", "confidence", "method")


_DHASH = "dh AS (SELECT vec_id, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, len(embedding)), lambda i: (embedding[i] > embedding[i + 1])::BIGINT)), lambda x, y: x * 2 + y) AS dhash FROM embeddings)"


@query(f"WITH {_DHASH} SELECT vec_id, dhash, lpad(lower(to_hex(dhash)), 16, '0') AS hex FROM dh")
def vector_dhash(spark, sf_dir):
    h = hashing.vector_dhash(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", h.alias("dhash")).select("vec_id", "dhash", hashing.to_hex(F.col("dhash")).alias("hex"))


@query(f"WITH {_DHASH} SELECT vec_id FROM dh WHERE dhash IS NOT NULL")
def hash_round_trip(spark, sf_dir):
    rows = vector_dhash(spark, sf_dir)
    return rows.filter(hashing.from_hex(F.col("hex")) == F.col("dhash")).select("vec_id")


@query(f"WITH {_DHASH}, c AS (SELECT DISTINCT dhash FROM dh) SELECT x.dhash AS h1, y.dhash AS h2, bit_count(xor(x.dhash, y.dhash))::INTEGER AS distance FROM c x JOIN c y ON x.dhash < y.dhash AND bit_count(xor(x.dhash, y.dhash)) <= 14")
def hamming_pairs(spark, sf_dir):
    """Pairs within 14 bits: a piece of 12 or 13 bits may differ in two; with the engine's own budget of 4, in none."""
    rows = vector_dhash(spark, sf_dir)
    return dedup.near_pairs(rows, "vec_id", "dhash", 14, every=True)


@query()
def near_dedup_greedy(spark, sf_dir):
    docs = hashing.text_simhash(table(spark, sf_dir, "documents"), "doc_id", "text")
    return dedup.greedy(dedup.cut(docs), "doc_id", "simhash").select("doc_id", "duplicate_of")


@query("""SELECT doc_id, CASE WHEN first <> doc_id THEN 'duplicate-of:' || first::VARCHAR ELSE '' END AS note
FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha1(text) ORDER BY lang, doc_id) AS first FROM documents)""")
def collect_sha1_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), "lang", F.sha1(F.col("text").cast("binary")).alias("sha1"))
    return dedup.first_by_digest(docs, "sha1", "lang", "doc_id").select("doc_id", "note")


# -- vectors --------------------------------------------------------------

_COS = """t AS (SELECT 'label' || label::VARCHAR AS template, arg_min(embedding, vec_id)::DOUBLE[] AS vec FROM embeddings GROUP BY label),
c AS (SELECT vec_id, template, list_dot_product(embedding::DOUBLE[], vec) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(vec, vec)) AS cosine FROM embeddings, t),
top AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, template) = 1)"""


def _templates(rows: DataFrame) -> DataFrame:
    """A template a label: its first vector."""
    return rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vec")).select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("template"), "vec")


@query(f"WITH {_COS} SELECT vec_id, template, round(cosine, 6) AS cosine FROM top")
def cosine_top_template(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return signals.top_templates(rows, _templates(rows)).withColumn("cosine", F.round("cosine", 6))


@query(f"WITH {_COS} SELECT vec_id, CASE WHEN cosine < .3 THEN 0.0 ELSE round(cosine, 6) END::DOUBLE AS score, CASE WHEN cosine < .3 THEN 'below floor' ELSE '' END AS detail FROM top")
def cosine_floor(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    best = signals.top_templates(rows, _templates(rows)).withColumn("f", signals.floored(F.col("cosine")))
    return best.select("vec_id", F.round("f.score", 6).alias("score"), "f.detail")


# -- journal and reports --------------------------------------------------


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def resume_antijoin(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id")
    return tables.pending(files, table(spark, sf_dir, "labels").select("doc_id"), key="doc_id")


_LAST = "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"


@query(_LAST)
def journal_compaction(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    last = events.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("e"))
    return last.select("user_id", "event_type", "e.event_id", "e.value")


@query("SELECT 'u' || user_id::VARCHAR AS path, 'negative' AS band, arg_max(value, event_id) AS ts FROM events GROUP BY user_id")
def journal_lines(spark, sf_dir):
    """Events as journal lines of JSON: the last of a path wins."""
    line = F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("value").alias("ts")))
    rows = table(spark, sf_dir, "events").select(line.alias("value"), F.col("event_id").alias("seq"))
    torn = rows.agg(F.lit('{"path": "half-writ').alias("value"), F.lit(1 << 60).alias("seq"))
    return tables.journal_lines(rows.unionByName(torn)).select("path", "band", "ts")


@query("SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def props_json(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


@query(f"""{_JD}, {_EXACT} SELECT count(*) AS images, count(*) FILTER (band = 'positive') AS positive, count(*) FILTER (band = 'review') AS review, count(*) FILTER (band = 'negative') AS negative,
 count(duplicate_of) AS duplicates, 0::BIGINT AS errors, 100::BIGINT AS processed, 5::BIGINT AS skipped, 8.0::DOUBLE AS seconds, 12.5::DOUBLE AS images_per_second, 800.0::DOUBLE AS eta_10k_seconds
 FROM exact e JOIN judged j ON j.doc_id = coalesce(e.duplicate_of, e.doc_id)""")
def scan_summary(spark, sf_dir):
    rows = copy_verdict(spark, sf_dir).select("band", F.col("duplicate_of").cast("string").alias("duplicate_of"), F.lit("").alias("error"))
    return tables.summary(rows, 100, 5, 8.0)


@query("SELECT doc_id::VARCHAR AS path, 'negative' AS band, 0.0::DOUBLE AS confidence, 'none' AS method, '' AS duplicate_of, 'only ' || n_chars::VARCHAR || ' characters' AS error FROM documents WHERE n_chars < 100")
def error_rows(spark, sf_dir):
    short = table(spark, sf_dir, "documents").filter("n_chars < 100")
    return tables.error_entries(short.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("only "), F.col("n_chars").cast("string"), F.lit(" characters")).alias("reason")))


@query(f"{_JD} SELECT lang || '/' || d.doc_id::VARCHAR AS filename, band = 'positive' AS contains_logo, band, round(confidence, 9) AS confidence, method FROM judged j JOIN documents d ON d.doc_id = j.doc_id ORDER BY 1")
def report_sorted(spark, sf_dir):
    rows = judged_documents(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    named = rows.select(F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("filename"), (F.col("band") == "positive").alias("contains_logo"), "band", F.round("confidence", 9).alias("confidence"), "method")
    return tables.ordered(named)


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 5")
def limit_per_class(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("doc_id").alias("path"))
    return tables.limited(rows, 5, "lang").select("doc_id", "lang")


@query("""SELECT 'both' AS side, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL
SELECT 'documents only', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL
SELECT 'either', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) UNION ALL
SELECT 'rows', count(*) FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels)""")
def label_sets(spark, sf_dir):
    a, b = (table(spark, sf_dir, t).select("doc_id") for t in ("documents", "labels"))
    parts = {"both": a.intersect(b), "documents only": a.subtract(b), "either": a.union(b).distinct(), "rows": a.unionByName(b)}
    out = None
    for side, rows in parts.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT l.doc_id::VARCHAR AS filename, CASE WHEN l.quality = 1 THEN 'positive' ELSE 'negative' END AS label, e.label::DOUBLE AS score FROM labels l LEFT JOIN embeddings e ON e.vec_id = l.doc_id")
def cache_reuse(spark, sf_dir):
    found = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("filename"), F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label"))
    cached = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("filename"), F.create_map(F.lit("a"), F.col("label").cast("double")).alias("scores"))
    return tables.reuse(found, cached).select("filename", "label", F.col("scores")["a"].alias("score"))


@query("SELECT o_orderkey, CASE WHEN s // 3600 > 0 THEN printf('%dh %02dm %02ds', s // 3600, s // 60 % 60, s % 60) WHEN s // 60 > 0 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS took FROM (SELECT o_orderkey, o_orderkey % 20000 AS s FROM orders)")
def duration_text(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scores.duration(F.col("o_orderkey") % 20000).alias("took"))


# -- audit and labels -----------------------------------------------------

_POOL = f"{_JD}, {_EXACT}, pool AS (SELECT j.doc_id, j.confidence FROM judged j JOIN exact e ON e.doc_id = j.doc_id WHERE band = 'negative' AND duplicate_of IS NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = j.doc_id))"


def _pool(spark, sf_dir) -> DataFrame:
    rows = judged_documents(spark, sf_dir).join(exact_dedup(spark, sf_dir).select("doc_id", "duplicate_of"), "doc_id")
    results = rows.select(F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("filename"), "doc_id", "band", "confidence", F.col("duplicate_of").cast("string").alias("duplicate_of"), F.lit("").alias("error"))
    labels = table(spark, sf_dir, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("filename"))
    return workflow.eligible(results, labels)


@query(f"{_POOL} SELECT doc_id, round(confidence, 9) AS confidence FROM pool")
def audit_candidates(spark, sf_dir):
    return _pool(spark, sf_dir).select("doc_id", F.round("confidence", 9).alias("confidence"))


@query(f"{_POOL} SELECT doc_id, round(confidence, 9) AS confidence FROM pool ORDER BY pool.confidence DESC, doc_id::VARCHAR || '.png' LIMIT 3")
def near_miss_topk(spark, sf_dir):
    return workflow.near_misses(_pool(spark, sf_dir), 3).select("doc_id", F.round("confidence", 9).alias("confidence"))


@query()
def seeded_sample(spark, sf_dir):
    return workflow.sample(_pool(spark, sf_dir), 3, 7).select("doc_id")


_WILSON = "p AS (SELECT {key}, {hits} AS hits, count(*) AS total FROM {table} GROUP BY ALL), w AS (SELECT *, hits::DOUBLE / total AS share, 1 + 1.96 * 1.96 / total AS d FROM p)"
_LOW, _HIGH = (f"round(greatest(0, least(1, (share + 1.96 * 1.96 / (2 * total) {s} 1.96 * sqrt(share * (1 - share) / total + 1.96 * 1.96 / (4.0 * total * total))) / d)), 6)" for s in "-+")


@query(f"WITH {_WILSON.format(key='quality', hits='count(*) FILTER (toxic = 1)', table='labels')} SELECT quality, hits, total, {_LOW}::DOUBLE AS low, {_HIGH}::DOUBLE AS high FROM w")
def wilson_miss_rate(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").groupBy("quality").agg(F.count_if(F.col("toxic") == 1).alias("hits"), F.count(F.lit(1)).alias("total"))
    w = scores.wilson(F.col("hits"), F.col("total"))
    return rows.select("quality", "hits", "total", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


@query("""SELECT count(*) AS sample, count(*) FILTER (toxic = 1) AS hits, round(count(*) FILTER (toxic = 1)::DOUBLE / count(*), 6) AS miss_rate,
 round(1000 * count(*) FILTER (toxic = 1)::DOUBLE / count(*), 4) AS missed, round(40.0 / (40.0 + 1000 * count(*) FILTER (toxic = 1)::DOUBLE / count(*) + 3), 6)::DOUBLE AS recall FROM labels""")
def audit_recall(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    manifest = labels.select(F.col("doc_id").cast("string").alias("sample_name"), F.lit("random").alias("mode"))
    found = labels.filter("toxic = 1").select(F.col("doc_id").cast("string").alias("sample_name"))
    report = workflow.audit_report(manifest, found, pool=1000, negatives=1000, known_misses=3, confirmed=40)
    return report.select("sample", "hits", F.round("miss_rate", 6).alias("miss_rate"), F.round("missed", 4).alias("missed"), F.round("recall", 6).alias("recall"))


@query("SELECT d.lang || '/' || (n_chars // 50)::VARCHAR AS target, count(DISTINCT l.quality) AS labels FROM documents d JOIN labels l USING (doc_id) GROUP BY 1 HAVING count(DISTINCT l.quality) > 1")
def label_conflicts(spark, sf_dir):
    """Documents of one language and about one length are taken as one target: some are labelled both ways."""
    target = F.concat_ws("/", "lang", F.floor(F.col("n_chars") / 50).cast("string"))
    rows = table(spark, sf_dir, "documents").select("doc_id", target.alias("target")).join(table(spark, sf_dir, "labels"), "doc_id")
    return workflow.conflicts(rows.select("target", F.col("quality").alias("label")))


@query("SELECT doc_id::VARCHAR AS target, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS label, l.quality AS existing FROM documents JOIN labels l USING (doc_id) WHERE (n_chars >= 1000) <> (l.quality = 1)")
def label_disagreements(spark, sf_dir):
    targets = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("target"), F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("label"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("filename"), F.col("quality").alias("label"))
    return workflow.disagreements(targets, labels)


@query(f"""WITH {_DHASH}, v AS (SELECT d.*, e.label FROM dh d JOIN embeddings e USING (vec_id)), crops AS (SELECT label, min(vec_id) AS first FROM v GROUP BY label)
SELECT 's' || c.label::VARCHAR || '_crop.jpg' AS crop, arg_min('p' || o.vec_id::VARCHAR, [bit_count(xor(o.dhash, k.dhash))::BIGINT, 0]::BIGINT[] || ascii_of) AS target, count(DISTINCT o.vec_id) AS candidates
FROM crops c JOIN v k ON k.vec_id = c.first JOIN (SELECT *, [vec_id] AS ascii_of FROM v) o ON o.label = c.label AND o.vec_id <> c.first GROUP BY ALL""")
def crop_to_original(spark, sf_dir):
    """A crop for each label, and the vectors of that label as results of its stem: the closest hash is its original."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", hashing.vector_dhash(F.col("embedding")).alias("dhash"))
    first = rows.groupBy("label").agg(F.min(F.struct("vec_id", "dhash")).alias("f"))
    crops = first.select(F.format_string("s%d_crop.jpg", "label").alias("crop"), F.col("label").cast("string").alias("label"), F.col("f.dhash").alias("dhash"))
    others = rows.join(first, "label").filter(F.col("vec_id") != F.col("f.vec_id"))
    # Ids as names of equal width, so that their order is their numbers'.
    name = F.format_string("p%d/s%d.jpg", "vec_id", "label")
    results = others.select(name.alias("filename"), F.format_string("%012d", "vec_id").alias("duplicate_of"), F.lit(1).alias("x"), F.col("dhash").alias("crop_hash"))
    best = workflow.crop_targets(crops, results)
    return best.select("crop", F.concat(F.lit("p"), F.col("target").cast("long").cast("string")).alias("target"), "candidates")


@query("""WITH f AS (SELECT page_id, '2020-' || lpad((page_id % 12 + 1)::VARCHAR, 2, '0') AS period, 'photo' || (page_id % 9)::VARCHAR AS stem, (page_id // 7) % 4 AS k, (ARRAY['jpg', 'png', 'webp', 'txt'])[(page_id // 3) % 4 + 1] AS ext, length(html) AS size FROM pages),
g AS (SELECT *, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS kind, CASE k WHEN 2 THEN 150 * 150 WHEN 3 THEN 1024 * 768 ELSE 0 END AS area FROM f WHERE ext <> 'txt')
SELECT period, stem, page_id AS best, CASE kind WHEN 0 THEN 'original' WHEN 1 THEN 'scaled' ELSE 'largest-variant' END AS reason, count(*) OVER (PARTITION BY period, stem) - 1 AS variants_ignored
FROM g QUALIFY row_number() OVER (PARTITION BY period, stem ORDER BY kind, area DESC, CASE ext WHEN 'webp' THEN 3 ELSE 0 END, size DESC, lpad(page_id::VARCHAR, 12, '0')) = 1""")
def collect_best_variant(spark, sf_dir):
    """Pages under upload names: an original, a scaled one, or one of two sizes of a photo."""
    ext = F.element_at(F.array(*[F.lit(x) for x in ("jpg", "png", "webp", "txt")]), (F.floor(F.col("page_id") / 3) % 4 + 1).cast("int"))
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("", "-scaled", "-150x150", "-1024x768")]), (F.floor(F.col("page_id") / 7) % 4 + 1).cast("int"))
    period = F.format_string("2020-%02d", F.col("page_id") % 12 + 1)
    files = table(spark, sf_dir, "pages").select(F.format_string("%012d", "page_id").alias("path"), period.alias("period"), F.concat(F.format_string("photo%d", F.col("page_id") % 9), suffix).alias("name_stem"), ext.alias("ext"), F.length("html").alias("size"))
    return workflow.best_variants(files).select("period", "stem", F.col("path").cast("long").alias("best"), "reason", "variants_ignored")


@query("""SELECT lang AS label, count(*) AS files, round(sum(n_chars) / 1e6::DOUBLE, 3) AS total_mb, round(min(n_chars) / 1e3::DOUBLE, 3) AS min_kb,
 round(list_sort(list(n_chars))[count(*) // 2 + 1] / 1e3::DOUBLE, 3) AS median_kb, round(max(n_chars) / 1e3::DOUBLE, 3) AS max_kb, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 4) AS share FROM documents GROUP BY lang""")
def class_size_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("label"), F.col("n_chars").alias("size"))
    return workflow.class_sizes(rows)


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 12 THEN c_name ELSE substr(c_name, 1, 5) || '~' || substr(sha1(c_name), 1, 6) END AS name FROM customer")
def fitted_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", workflow.fitted(F.lit("x" * 242), F.col("c_name")).alias("name"))


# -- text and boxes -------------------------------------------------------


@query("SELECT doc_id, md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^0-9a-z]+', ' ', 'g'))) AS spaced, length(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^0-9a-z]+', '', 'g')) AS letters FROM documents")
def brand_normalize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(text.normalized(F.col("text")).cast("binary")).alias("spaced"), F.length(text.compacted(F.col("text"))).cast("long").alias("letters"))


@query()
def brand_match(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", text.brand_match(F.col("p_name"), TERMS).alias("m"))
    return rows.select("p_partkey", F.round("m.score", 3).alias("score"), "m.term")


_FRAME = "f AS (SELECT page_id, (100 + length(html) % 900)::INTEGER AS w, (100 + page_id % 700)::INTEGER AS h FROM pages)"


def _frames(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", (100 + F.length("html") % 900).cast("int").alias("w"), (100 + F.col("page_id") % 700).cast("int").alias("h"))


@query(f"""WITH {_FRAME} SELECT page_id, 'full' AS source, 0 AS x, 0 AS y, w AS bw, h AS bh FROM f UNION ALL
SELECT page_id, 'tile', x::INTEGER, y::INTEGER, (least(w, x + tw) - x)::INTEGER, (least(h, y + th) - y)::INTEGER FROM (SELECT page_id, w, h,
 round_even(c * (w / 4::DOUBLE), 0) AS x, round_even(r * (h / 4::DOUBLE), 0) AS y, round_even(w / 3::DOUBLE, 0) AS tw, round_even(h / 3::DOUBLE, 0) AS th FROM f, range(4) a(c), range(4) b(r)) WHERE least(w, x + tw) > x AND least(h, y + th) > y""")
def tile_regions(spark, sf_dir):
    rows = _frames(spark, sf_dir).select("page_id", F.explode(boxes.tiles(F.col("w"), F.col("h"))).alias("t"))
    return rows.select("page_id", "t.source", "t.bbox.x", "t.bbox.y", F.col("t.bbox.w").alias("bw"), F.col("t.bbox.h").alias("bh"))


_BOXES = "b AS (SELECT p_partkey AS id, (p_partkey % 60)::INTEGER AS x1, (p_size % 40)::INTEGER AS y1, (p_size + 10)::INTEGER AS w1, 50 AS h1, (p_size % 50)::INTEGER AS x2, (p_partkey % 30)::INTEGER AS y2, 60 AS w2, (p_partkey % 45 + 5)::INTEGER AS h2 FROM part)"


def _boxes(spark, sf_dir) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(k.alias("id"), boxes.box(k % 60, s % 40, s + 10, F.lit(50)).alias("a"), boxes.box(s % 50, k % 30, F.lit(60), k % 45 + 5).alias("b"))


@query(f"""WITH {_BOXES}, o AS (SELECT *, greatest(0, least(x1 + w1, x2 + w2) - greatest(x1, x2)) * greatest(0, least(y1 + h1, y2 + h2) - greatest(y1, y2)) AS shared FROM b)
SELECT id, round(shared::DOUBLE / (w1 * h1 + w2 * h2 - shared), 6) AS iou, least(x1, x2) AS ux, least(y1, y2) AS uy, greatest(x1 + w1, x2 + w2) - least(x1, x2) AS uw, greatest(y1 + h1, y2 + h2) - least(y1, y2) AS uh FROM o""")
def iou_pairs(spark, sf_dir):
    u = boxes.union(F.col("a"), F.col("b"))
    return _boxes(spark, sf_dir).select("id", F.round(boxes.iou(F.col("a"), F.col("b")), 6).alias("iou"), *[u[c].alias(f"u{c}") for c in "xywh"])


@query(f"""WITH {_BOXES}, g AS (SELECT id, round_even(x1 - w1 * .15::DOUBLE, 0) AS gx, round_even(y1 - h1 * .15::DOUBLE, 0) AS gy, round_even(w1 + 2 * (w1 * .15::DOUBLE), 0) AS gw, round_even(h1 + 2 * (h1 * .15::DOUBLE), 0) AS gh, w1 * h1 / 8000.0 AS area FROM b),
p AS (SELECT id, greatest(0, gx) AS x0, greatest(0, gy) AS y0, least(100, gx + gw) AS x1, least(80, gy + gh) AS y1, area FROM g)
SELECT id, x0::INTEGER AS px, y0::INTEGER AS py, (x1 - x0)::INTEGER AS pw, (y1 - y0)::INTEGER AS ph, area BETWEEN .0004 AND .9 AS fair FROM p""")
def box_pad_clip(spark, sf_dir):
    w, h = F.lit(100), F.lit(80)
    p = boxes.pad(F.col("a"), w, h)
    return _boxes(spark, sf_dir).select("id", *[p[c].alias(f"p{c}") for c in "xywh"], boxes.area_ok(F.col("a"), w, h).alias("fair"))


@query()
def merge_regions(spark, sf_dir):
    rows = _boxes(spark, sf_dir)
    hints = F.array(*[F.struct(F.col(c).alias("bbox"), F.lit(s).alias("source")) for c, s in (("a", "text"), ("b", "mser"))])
    found = rows.select("id", F.posexplode(boxes.propose(hints, F.lit(120), F.lit(100))).alias("nth", "r"))
    return found.select("id", "nth", "r.source", "r.bbox.x", "r.bbox.y", "r.bbox.w", "r.bbox.h")


# -- streams --------------------------------------------------------------


def _stream(spark, sf_dir, judge) -> DataFrame:
    from triage.streaming import scan

    base = dedup.shared_folder(spark)
    folder = f"scan-{uuid.uuid4().hex}"
    journal, state = f"{base}/{folder}/journal", f"{base}/{folder}/state"
    schema = table(spark, sf_dir, "documents").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/document*.parquet")
    rows = rows.select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), "n_chars")
    query_ = scan.run(rows, journal, state, judge)
    query_.awaitTermination()
    return spark.read.parquet(f"{journal}/batch=*")


@query(f"WITH {_EXACT} SELECT doc_id AS path, duplicate_of FROM exact")
def streaming_dedup(spark, sf_dir):
    return _stream(spark, sf_dir, lambda rows: rows).select("path", "duplicate_of")


@query(f"WITH {_EXACT} SELECT e.doc_id AS path, CASE WHEN duplicate_of IS NULL THEN CASE WHEN n_chars >= 1600 THEN 'positive' WHEN n_chars >= 800 THEN 'review' ELSE 'negative' END END AS band FROM exact e JOIN documents d ON d.doc_id = e.doc_id")
def incremental_scan(spark, sf_dir):
    def judge(rows: DataFrame) -> DataFrame:
        a: Column = F.least(F.lit(1.0), F.col("n_chars") / 2000.0)
        return rows.withColumn("band", scores.band_of(a, 0.4, 0.8))

    return _stream(spark, sf_dir, judge).select("path", "band")
