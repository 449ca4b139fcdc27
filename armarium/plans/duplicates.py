"""Near-duplicate queries bound to the given tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup as dd
from . import views as v
from .normalise import TOKENS_SQL

TODAY = "2024-02-15"


def docs(spark, d):
    return v.texts(spark, d)


def fps(spark, d):
    return dd.fingerprints(docs(spark, d), "doc_id")


def simhash(spark, d):
    return fps(spark, d)


def simhash_fnv(spark, d):
    return dd.fnv_fingerprints(docs(spark, d), "doc_id")


def near_pairs(spark, d):
    """Near pairs of distinct fingerprints, with the number of texts behind each side."""
    f = dd.cut_lineage(fps(spark, d))
    n = f.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    p = dd.near_pairs(f)
    a, b = n.toDF("fp_a", "n_a", "doc_a"), n.toDF("fp_b", "n_b", "doc_b")
    return p.join(a, "fp_a").join(b, "fp_b").select("doc_a", "doc_b", "distance", "n_a", "n_b")


def greedy_dedup(spark, d):
    return dd.deduplicate(dd.cut_lineage(fps(spark, d)).select(F.col("doc_id").alias("item"), "fp"))


def stored_dedup(spark, d):
    """Odd documents against stored even ones inside the retention window."""
    f = dd.cut_lineage(fps(spark, d))
    created = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int"))
    stored = f.where("doc_id % 2 = 0 or doc_id % 7 = 0").select(F.col("doc_id").alias("stored_id"), "fp", F.col("doc_id").alias("pos"), created.cast("timestamp").alias("created_at"))
    kept = dd.retained(stored, F.lit(TODAY).cast("date")).drop("created_at")
    return dd.deduplicate(f.where("doc_id % 2 = 1").select(F.col("doc_id").alias("item"), "fp"), kept)


def exact_copies(spark, d):
    """Texts equal after normalisation point to their first document."""
    s = dd.shingles(docs(spark, d)).where("shingles is not null").select("doc_id", F.md5(F.array_join("shingles", " ")).alias("h"))
    s = dd.cut_lineage(s)  # read twice below
    firsts = s.groupBy("h").agg(F.min("doc_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return s.join(firsts, "h").where("doc_id <> original").select("doc_id", "original")


def age_out(spark, d):
    created = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).cast("timestamp")
    stored = docs(spark, d).select("doc_id", created.alias("created_at"))
    return dd.retained(stored, F.lit(TODAY).cast("date")).groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def known_keys(spark, d):
    ev = v.table(spark, d, "events").withColumn("day", F.to_date("ts"))
    known, batch = ev.where("ts < '2024-01-16'"), ev.where("ts >= '2024-01-10'")
    keys = ["user_id", "event_type", "day"]
    return dd.unseen(batch, known, keys).groupBy("day").agg(F.count(F.lit(1)).alias("n_new"), F.countDistinct("user_id").alias("n_users"))


QUERIES = {
    "mj14_simhash": simhash, "mj14_simhash_fnv": simhash_fnv, "mj15_near_pairs": near_pairs, "mj16_greedy_dedup": greedy_dedup,
    "mj16_stored_dedup": stored_dedup, "mj16_exact_copies": exact_copies, "mj17_known_keys": known_keys, "ts7_age_out": age_out,
}

_PAIRS = f"""tk AS (SELECT doc_id, {TOKENS_SQL} w FROM documents), sh AS (SELECT doc_id, list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || '_' || z[2]) s FROM tk WHERE len(w) >= 8)"""
_BITS = " + ".join(f"CASE WHEN 2 * sum((h >> {i}) & 1) > count(*) THEN {1 << i}::HUGEINT ELSE 0 END" for i in range(64))
FPS = f"""{_PAIRS}, hs AS (SELECT doc_id, ('0x' || substr(md5(unnest(s)), 1, 16))::UBIGINT h FROM sh),
  u AS (SELECT doc_id, {_BITS} f FROM hs GROUP BY 1), fp AS (SELECT doc_id, CASE WHEN f >= 9223372036854775808 THEN f - 18446744073709551616 ELSE f END::BIGINT fp FROM u)"""
_KEPT = """list_reduce(list({'id': doc_id, 'fp': fp} ORDER BY doc_id), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: bit_count(xor(k.fp, x.fp)) <= 8)) > 0
    THEN acc ELSE list_append(acc, x) END, []::STRUCT(id BIGINT, fp BIGINT)[])"""
_STORED = """st AS (SELECT * FROM fp WHERE (doc_id % 2 = 0 OR doc_id % 7 = 0) AND DATE '2024-01-01' + (doc_id % 60)::INT >= DATE '2024-02-15' - 30),
  bt AS (SELECT * FROM fp WHERE doc_id % 2 = 1), vs AS (SELECT b.doc_id item, min(s.doc_id) original FROM bt b JOIN st s ON s.doc_id <> b.doc_id AND bit_count(xor(b.fp, s.fp)) <= 8 GROUP BY 1),
  rs AS (SELECT * FROM bt WHERE doc_id NOT IN (SELECT item FROM vs))"""

ORACLE = {
    "mj14_simhash": f"WITH {FPS} SELECT doc_id, fp FROM fp",
    "mj15_near_pairs": f"""WITH {FPS}, n AS (SELECT fp, count(*) n, min(doc_id) doc FROM fp GROUP BY 1)
        SELECT a.doc doc_a, b.doc doc_b, bit_count(xor(a.fp, b.fp)) distance, a.n n_a, b.n n_b FROM n a JOIN n b ON a.fp < b.fp AND bit_count(xor(a.fp, b.fp)) <= 8""",
    "mj16_greedy_dedup": f"""WITH {FPS}, kept AS (SELECT unnest({_KEPT}, recursive := true) FROM fp)
        SELECT f.doc_id item, min(k.id) original FROM fp f JOIN kept k ON k.id < f.doc_id AND bit_count(xor(f.fp, k.fp)) <= 8 GROUP BY 1""",
    "mj16_stored_dedup": f"""WITH {FPS}, {_STORED}, kept AS (SELECT unnest({_KEPT}, recursive := true) FROM rs)
        SELECT item, original FROM vs UNION ALL SELECT f.doc_id, min(k.id) FROM rs f JOIN kept k ON k.id < f.doc_id AND bit_count(xor(f.fp, k.fp)) <= 8 GROUP BY 1""",
    "mj16_exact_copies": f"""WITH {_PAIRS}, h AS (SELECT doc_id, md5(array_to_string(s, ' ')) h FROM sh), o AS (SELECT h, min(doc_id) original FROM h GROUP BY 1)
        SELECT doc_id, original FROM h JOIN o USING (h) WHERE doc_id <> original""",
    "mj17_known_keys": """WITH ev AS (SELECT *, ts::DATE AS day FROM events), kn AS (SELECT DISTINCT user_id, event_type, day FROM ev WHERE ts < '2024-01-16'),
        bt AS (SELECT DISTINCT user_id, event_type, day FROM ev WHERE ts >= '2024-01-10')
        SELECT day, count(*) n_new, count(DISTINCT user_id) n_users FROM (FROM bt EXCEPT FROM kn) GROUP BY 1""",
    "ts7_age_out": """SELECT (DATE '2024-01-01' + (doc_id % 60)::INT)::DATE AS day, count(*) n FROM documents WHERE DATE '2024-01-01' + (doc_id % 60)::INT >= DATE '2024-01-16' GROUP BY 1""",
}
