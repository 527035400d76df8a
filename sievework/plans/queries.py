"""The engine's operators over the driver tables, each with the equivalent DuckDB SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, replies, scores, tiers, vectors
from ..operators import dedup, report, review, scoring, select, sessions, similarity
from ..params import DEFAULT
from ..sources import files, tables
from ..sources.scratch import stage
from ..streaming import sessions as streams

#: Radii and thresholds for these tables; the products' defaults are in Params.
FACE_MATCH = 0.3
EXCLUSIVE = [(0, 1), (2, 3)]
NEW_WEIGHTS = {"aesthetic": 0.4, "emotion": 0.1, "memorability": 0.2, "rot": 0.2, "prominence": 0.1}
TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SQL_TIME = "'%Y-%m-%d %H:%M:%S.%f'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def time_text(column: str) -> Column:
    return F.date_format(column, TIME)


# --- tiers, null blocks, tags ---------------------------------------------------------------------------------------

METRICS_SQL = """
m AS (SELECT l.*, l_quantity * 2.5 AS blur, CAST(l_partkey % 256 AS DOUBLE) AS exposure FROM lineitem l),
t AS (SELECT *, CASE WHEN blur < 40 THEN 'hard_reject' WHEN blur < 100 THEN 'soft_blur' ELSE 'pass' END AS tier FROM m),
s AS (SELECT *, CASE WHEN tier = 'hard_reject' THEN 'rejected_blur'
        WHEN (exposure < 30 OR exposure > 225) AND tier = 'soft_blur' THEN 'rejected_blur_and_exposure'
        WHEN exposure < 30 THEN 'rejected_dark' WHEN exposure > 225 THEN 'rejected_bright'
        WHEN tier = 'soft_blur' THEN 'soft_blur_surviving' ELSE 'surviving' END AS status FROM t)"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumns({"blur": F.col("l_quantity") * 2.5, "exposure": (F.col("l_partkey") % 256).cast("double")})
    return rows.withColumns({"tier": tiers.blur_tier(F.col("blur")), "status": tiers.status(F.col("blur"), F.col("exposure"))})


@query(f"WITH {METRICS_SQL} SELECT tier, status, count(*) AS n FROM s GROUP BY tier, status")
def tier_classify(spark, sf_dir):
    return measured(spark, sf_dir).groupBy("tier", "status").agg(F.count("*").alias("n"))


@query(f"""WITH {METRICS_SQL}, a AS (SELECT *, status IN ('surviving', 'soft_blur_surviving') AS alive FROM s)
SELECT l_orderkey, l_linenumber, l_extendedprice, status, CASE WHEN alive THEN l_linenumber ELSE 0 END AS faces_detected,
CASE WHEN alive THEN l_returnflag ELSE 'unknown' END AS moment_label, CASE WHEN alive THEN round(l_tax, 6) END AS final_score FROM a""")
def dead_row_nullblock(spark, sf_dir):
    values = {"faces_detected": F.col("l_linenumber"), "moment_label": F.col("l_returnflag"), "final_score": F.round("l_tax", 6)}
    rows = tiers.when_alive(measured(spark, sf_dir), values, {"faces_detected": F.lit(0), "moment_label": F.lit("unknown")})
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", "status", "faces_detected", "moment_label", "final_score")


TAGS_SQL = f"""WITH {METRICS_SQL}, g AS (SELECT *, l_linenumber - 1 AS faces, l_quantity / greatest(l_discount * 400, 1) AS ratio FROM s),
tagged AS (SELECT *, list_filter([CASE WHEN faces = 1 THEN 'solo_portrait' WHEN faces = 2 THEN 'couple' WHEN faces >= 3 THEN 'group' END,
  CASE WHEN tier = 'soft_blur' THEN 'candid' END, CASE WHEN faces = 0 AND ratio < 1.5 THEN 'detail' WHEN faces = 0 THEN 'venue' END], lambda x: x IS NOT NULL) AS tags FROM g)"""


def tagged(spark, sf_dir):
    rows = measured(spark, sf_dir).withColumn("faces", F.col("l_linenumber") - 1)
    ratio = tiers.aspect_ratio(F.col("l_quantity"), F.col("l_discount") * 400)
    return rows.withColumn("tags", tiers.shot_tags(F.col("faces"), F.col("tier"), ratio))


@query(TAGS_SQL + " SELECT l_orderkey, l_linenumber, l_extendedprice, array_to_string(tags, ',') AS tags, tags[1] AS primary_shot_type, faces >= 3 AS is_group_photo FROM tagged")
def shot_tags(spark, sf_dir):
    rows = tagged(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", F.array_join("tags", ",").alias("tags"), F.get("tags", F.lit(0)).alias("primary_shot_type"), tiers.is_group(F.col("faces")).alias("is_group_photo"))


@query(TAGS_SQL + " SELECT " + ", ".join(f"count(*) FILTER (WHERE list_contains(tags, '{t}')) AS n_{t}" for t in ("solo_portrait", "couple", "group", "candid", "detail", "venue")) + " FROM tagged")
def shot_tag_counts(spark, sf_dir):
    return report.tag_counts(tagged(spark, sf_dir), "tags", ["solo_portrait", "couple", "group", "candid", "detail", "venue"])


# --- joins, sets, files -----------------------------------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def skip_anti_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "source")
    return files.without_skipped(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"))).select(F.col("path").alias("doc_id"), "source")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN (SELECT doc_id, arg_max(quality, toxic) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def cache_left_join(spark, sf_dir):
    known = files.known_hashes(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.col("quality").alias("phash"), F.col("toxic").alias("file_ord")))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    return files.with_known_hashes(docs, known).select(F.col("path").alias("doc_id"), F.col("phash").alias("quality"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' UNION (SELECT doc_id FROM documents WHERE lang <> 'en' EXCEPT SELECT doc_id FROM labels WHERE quality = 0)")
def keepset_union_except(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    worse = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    rest = docs.where("lang <> 'en'").select("doc_id").join(worse, "doc_id", "left_anti")
    return docs.where("lang = 'en'").select("doc_id").unionByName(rest).distinct()


@query("SELECT source AS folder_rel, count(*) AS n_files FROM documents GROUP BY source")
def folder_counts(spark, sf_dir):
    return files.folder_counts(table(spark, sf_dir, "documents").withColumnRenamed("source", "folder_rel"))


@query("SELECT p_partkey, keep FROM (SELECT p_partkey, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_size DESC, p_retailprice DESC, p_partkey) = 1 AS keep FROM part)")
def filename_dedup(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.lower("p_name").alias("filename_lower"), F.col("p_size").alias("pixels"), F.col("p_retailprice").alias("file_size"))
    return dedup.keep_largest(parts, "filename_lower").select(F.col("ord").alias("p_partkey"), "keep")


@query("SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) = 1 AS keep FROM documents")
def exact_doc_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.md5(F.col("text").cast("binary")).alias("hash"), F.col("n_chars").alias("pixels"), F.lit(0).alias("file_size"))
    return dedup.keep_largest(docs, "hash").select(F.col("ord").alias("doc_id"), "keep")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE NOT keep) AS skipped, count(*) FILTER (WHERE keep) AS unique_files, round(count(*) FILTER (WHERE keep) * 0.87 / 3600, 1) AS hours FROM (SELECT row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) = 1 AS keep FROM documents)")
def scan_estimate(spark, sf_dir):
    return report.scan_estimate(exact_doc_dedup(spark, sf_dir)).withColumnRenamed("unique", "unique_files")


@query(r"""SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS base, regexp_replace(url, '[/\\]?[^/\\]*$', '') AS folder,
coalesce(try_cast(nullif(regexp_extract(regexp_extract(url, '([^/\\]*)$', 1), '([0-9]+)', 1), '') AS BIGINT), -1) AS seq,
lower(regexp_extract(url, '\.([^./\\]+)$', 1)) AS ext FROM pages""")
def path_functions(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", paths.basename(url).alias("base"), paths.folder(url).alias("folder"), paths.sequence_number(url).alias("seq"), tiers.extension(url).alias("ext"))


@query(f"""SELECT event_id, strftime(date_trunc('second', ts), {SQL_TIME}) AS parsed, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events""")
def time_parse(spark, sf_dir):
    raw = F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    rows = table(spark, sf_dir, "events").withColumn("parsed", paths.exif_time(F.lit("no time"), raw))
    return rows.select("event_id", time_text("parsed").alias("parsed"), paths.iso_time(F.col("ts")).alias("iso"))


# --- hashes and clusters ----------------------------------------------------------------------------------------------

SIMHASH_SQL = (
    r"""w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS word FROM documents),
h AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS a, CAST('0x' || substr(md5(word), 9, 8) AS BIGINT) AS b FROM w),
sh AS (SELECT doc_id, """
    + ", ".join("(" + " + ".join(f"CASE WHEN sum(CASE WHEN ({c} >> {i}) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN {1 << i} ELSE 0 END" for i in range(32)) + f") AS {n}" for c, n in (("a", "hi"), ("b", "lo")))
    + """ FROM h GROUP BY doc_id),
r AS (SELECT min(s.doc_id) AS ord, s.hi, s.lo, d.source AS folder FROM sh s JOIN documents d USING (doc_id) GROUP BY s.hi, s.lo, d.source),
pairs AS (SELECT x.ord AS a, y.ord AS b, CAST(bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) AS INTEGER) AS distance, x.folder = y.folder AS same FROM r x JOIN r y ON x.ord < y.ord)"""
)


def simhashes(spark, sf_dir) -> DataFrame:
    """ord, hi, lo, folder of documents: 64 bits by majority over the distinct words' MD5 bits, so near copies are near."""
    docs = table(spark, sf_dir, "documents")
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    hashed = docs.select("doc_id", F.explode(words).alias("word")).withColumn("m", F.md5(F.col("word").cast("binary")))
    halves = hashed.select("doc_id", *[F.conv(F.substring("m", at, 8), 16, 10).cast("long").alias(n) for at, n in ((1, "a"), (9, "b"))])
    votes = [F.sum(F.when(F.shiftright(F.col(c), i).bitwiseAND(1) == 1, 1).otherwise(-1)).alias(f"{c}{i}") for c in ("a", "b") for i in range(32)]
    voted = halves.groupBy("doc_id").agg(*votes)
    bits = lambda c: sum((F.when(F.col(f"{c}{i}") > 0, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(1, 32)), F.when(F.col(f"{c}0") > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    return voted.select("doc_id", bits("a").alias("hi"), bits("b").alias("lo")).join(docs.select("doc_id", F.col("source").alias("folder"), "n_chars"), "doc_id").withColumnRenamed("doc_id", "ord")


@query(f"WITH {SIMHASH_SQL} SELECT a, b, distance FROM pairs WHERE same AND distance <= 8")
def hamming_pairs_same(spark, sf_dir):
    return dedup.hamming_pairs(dedup.representatives(simhashes(spark, sf_dir)), DEFAULT.hash_same)


@query(f"WITH {SIMHASH_SQL} SELECT a, b, distance FROM pairs WHERE distance <= CASE WHEN same THEN 8 ELSE 4 END")
def hamming_pairs_two_tier(spark, sf_dir):
    return dedup.hamming_pairs(dedup.representatives(simhashes(spark, sf_dir)), DEFAULT.hash_same, DEFAULT.hash_cross)


# the pair queries are over the first document of each hash and source; every link is a pair of members of such a pair, or
# of one first document (distance 0)
@query(f"WITH {SIMHASH_SQL} SELECT s.doc_id, r.ord AS first, CAST(0 AS INTEGER) AS distance FROM sh s JOIN documents d USING (doc_id) JOIN r ON r.hi = s.hi AND r.lo = s.lo AND r.folder IS NOT DISTINCT FROM d.source")
def hamming_members(spark, sf_dir):
    return dedup.members(simhashes(spark, sf_dir)).select(F.col("ord").alias("doc_id"), "first", F.lit(0).alias("distance"))


# orders of a few customers as near copies: a customer's hash with two bits flipped by the order's number
@query("""WITH o AS (SELECT o_orderkey AS ord, o_orderpriority AS folder, xor(CAST('0x' || substr(md5((o_custkey % 3000)::VARCHAR), 1, 8) AS BIGINT), 1::BIGINT << (o_orderkey % 32)::INTEGER) AS hi,
xor(CAST('0x' || substr(md5((o_custkey % 3000)::VARCHAR), 9, 8) AS BIGINT), 1::BIGINT << (o_orderkey // 32 % 32)::INTEGER) AS lo FROM orders),
p AS (SELECT x.ord AS a, y.ord AS b, CAST(bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) AS INTEGER) AS distance, x.folder = y.folder AS same FROM o x JOIN o y ON x.ord < y.ord)
SELECT a, b, distance FROM p WHERE distance <= CASE WHEN same THEN 8 ELSE 3 END""")
def hamming_orders(spark, sf_dir):
    text, key = F.md5((F.col("o_custkey") % 3000).cast("string").cast("binary")), F.col("o_orderkey")
    half = lambda at, bit: F.conv(F.substring(text, at, 8), 16, 10).cast("long").bitwiseXOR(F.pow(F.lit(2), bit).cast("long"))
    rows = table(spark, sf_dir, "orders").select(key.alias("ord"), half(1, key % 32).alias("hi"), half(9, F.floor(key / 32) % 32).alias("lo"), F.col("o_orderpriority").alias("folder"))
    return dedup.hamming_pairs(rows, DEFAULT.hash_same, 3)


@query(f"""WITH RECURSIVE {SIMHASH_SQL},
member AS (SELECT s.doc_id AS ord, r.ord AS rep FROM sh s JOIN documents d USING (doc_id) JOIN r ON r.hi = s.hi AND r.lo = s.lo AND r.folder = d.source),
e AS (SELECT a, b FROM pairs WHERE distance <= CASE WHEN same THEN 8 ELSE 4 END), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(node, root) AS (SELECT ord, ord FROM r UNION SELECT u.b, reach.root FROM reach JOIN u ON u.a = reach.node),
comp AS (SELECT m.ord, min(x.root) AS root FROM member m JOIN reach x ON x.node = m.rep GROUP BY m.ord),
sized AS (SELECT ord, root, count(*) OVER (PARTITION BY root) AS n FROM comp),
named AS (SELECT ord, CASE WHEN n > 1 THEN root END AS root FROM sized),
ids AS (SELECT root, CAST(row_number() OVER (ORDER BY root) AS INTEGER) AS cluster_id FROM (SELECT DISTINCT root FROM named WHERE root IS NOT NULL))
SELECT n.ord AS doc_id, ids.cluster_id, n.root IS NULL OR row_number() OVER (PARTITION BY coalesce(n.root, -n.ord - 1) ORDER BY d.n_chars DESC, n.ord) = 1 AS is_best
FROM named n JOIN documents d ON d.doc_id = n.ord LEFT JOIN ids ON ids.root = n.root""")
def dup_components_best(spark, sf_dir):
    rows = stage(simhashes(spark, sf_dir), "hashes")
    links = dedup.hamming_links(rows, DEFAULT.hash_same, DEFAULT.hash_cross)
    return dedup.clusters(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "n_chars"), links, F.desc("n_chars")).select(F.col("ord").alias("doc_id"), "cluster_id", "is_best")


@query(r"""WITH g AS (SELECT *, dense_rank() OVER (ORDER BY md5(text)) AS c, count(*) OVER (PARTITION BY md5(text)) AS n, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) = 1 AS keep FROM documents),
x AS (SELECT min(doc_id) OVER (PARTITION BY c) AS first, * FROM g WHERE n > 1)
SELECT first, string_agg(doc_id || ' ' || source || ' ' || (n_chars % 640) || 'x480 ' || CASE WHEN keep THEN 'keep' ELSE 'skip' END, ', ' ORDER BY doc_id) AS entries FROM x GROUP BY first""")
def scan_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("path"), F.col("source").alias("folder_rel"), F.md5(F.col("text").cast("binary")).alias("hash"), F.col("n_chars").alias("pixels"), F.lit(0).alias("file_size"), (F.col("n_chars") % 640).alias("width"), F.lit(480).alias("height"))
    grouped = docs.groupBy("hash").agg(F.min("ord").alias("cluster_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = report.groups(dedup.keep_largest(docs.join(grouped, "hash", "left"), "cluster_id"))
    return found.select(F.col("cluster_id").alias("first"), F.array_join(F.transform("entries", lambda e: F.concat_ws(" ", e["path"], e["folder"], e["res"], e["decision"])), ", ").alias("entries"))


# --- sessions and bursts ------------------------------------------------------------------------------------------------

MOMENT_SQL = """f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, CAST(sum(fresh) OVER (ORDER BY ts, event_id) AS INTEGER) AS moment_id FROM f)"""


def moments(spark, sf_dir):
    return sessions.moments(table(spark, sf_dir, "events"), "ts", "event_id")


@query(f"""WITH {MOMENT_SQL} SELECT event_id, moment_id, printf('moment_%02d', moment_id) AS moment_label,
strftime(min(ts) OVER (PARTITION BY moment_id), {SQL_TIME}) AS moment_start, strftime(max(ts) OVER (PARTITION BY moment_id), {SQL_TIME}) AS moment_end FROM g""")
def moments_global(spark, sf_dir):
    return moments(spark, sf_dir).select("event_id", "moment_id", "moment_label", time_text("moment_start").alias("moment_start"), time_text("moment_end").alias("moment_end"))


@query(f"""WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS session FROM f)
SELECT event_id, user_id, session, strftime(min(ts) OVER (PARTITION BY user_id, session), {SQL_TIME}) AS session_start, strftime(max(ts) OVER (PARTITION BY user_id, session), {SQL_TIME}) AS session_end FROM g""")
def moments_user(spark, sf_dir):
    rows = sessions.sessions_by_key(table(spark, sf_dir, "events"), "user_id", "ts", sessions.minutes(30), "event_id")
    return rows.select("event_id", "user_id", "session", time_text("session_start").alias("session_start"), time_text("session_end").alias("session_end"))


@query(f"WITH {MOMENT_SQL} SELECT count(ts) AS n_timed, count(DISTINCT moment_id) AS n_moments, CAST(floor(count(ts) / greatest(count(DISTINCT moment_id), 1)) AS BIGINT) AS per_moment FROM g")
def moment_summary(spark, sf_dir):
    return report.moment_summary(moments(spark, sf_dir).withColumnRenamed("ts", "capture_time"))


@query(r"""WITH p AS (SELECT page_id, lower(replace(regexp_extract(regexp_replace(url, '[/\\]?[^/\\]*$', ''), '([^/\\]*)$', 1), ' ', '_')) AS label FROM pages),
l AS (SELECT page_id, CASE WHEN label = '' THEN 'unknown' ELSE label END AS moment_label FROM p),
i AS (SELECT moment_label, CAST(10000 + row_number() OVER (ORDER BY min(page_id)) AS INTEGER) AS moment_id FROM l GROUP BY moment_label)
SELECT page_id, moment_label, moment_id FROM l JOIN i USING (moment_label)""")
def moment_fallback_ids(spark, sf_dir):
    return sessions.fallback_moments(table(spark, sf_dir, "pages").select("page_id", "url"), "url", "page_id").select("page_id", "moment_label", "moment_id")


# a moment that lasts long is cut by day, so that a group does not grow with the table
BURST_SQL = """d AS (SELECT *, CAST(ts AS DATE) AS day FROM events),
bf AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY day ORDER BY ts, event_id) > INTERVAL 2 MINUTE THEN 1 ELSE 0 END AS split FROM d),
b AS (SELECT *, CAST(1 + sum(split) OVER (PARTITION BY day ORDER BY ts, event_id) AS INTEGER) AS burst FROM bf),
bp AS (SELECT *, CAST(row_number() OVER (PARTITION BY day, burst ORDER BY ts, event_id) AS INTEGER) AS burst_pos, count(*) OVER (PARTITION BY day, burst) AS burst_size FROM b)"""


def bursts(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return sessions.burst_groups(events, moment="day", time="ts", path="event_type", tie="event_id")


@query(f"WITH {BURST_SQL} SELECT event_id, burst, burst_pos, burst_size FROM bp")
def burst_time_groups(spark, sf_dir):
    return bursts(spark, sf_dir).select("event_id", "burst", "burst_pos", "burst_size")


@query(f"""WITH {MOMENT_SQL},
bf AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY moment_id ORDER BY ts, event_id) > INTERVAL 2 MINUTE THEN 1 ELSE 0 END AS split FROM g),
b AS (SELECT *, CAST(1 + sum(split) OVER (PARTITION BY moment_id ORDER BY ts, event_id) AS INTEGER) AS burst FROM bf)
SELECT event_id, moment_id, burst, CAST(row_number() OVER (PARTITION BY moment_id, burst ORDER BY ts, event_id) AS INTEGER) AS burst_pos, count(*) OVER (PARTITION BY moment_id, burst) AS burst_size FROM b""")
def burst_moments(spark, sf_dir):
    rows = sessions.timed_bursts(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id")
    return rows.select("event_id", "moment_id", "burst", "burst_pos", "burst_size")


@query("""WITH c AS (SELECT c_custkey, c_mktsegment, c_nationkey, CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT) AS seq FROM customer),
f AS (SELECT *, lag(seq) OVER (PARTITION BY c_nationkey ORDER BY seq, c_custkey) AS before FROM c),
g AS (SELECT *, CASE WHEN before IS NOT NULL AND (seq < 0 OR before < 0 OR seq - before > 5) THEN 1 ELSE 0 END AS split FROM f)
SELECT c_custkey, CAST(1 + sum(split) OVER (PARTITION BY c_nationkey ORDER BY seq, c_custkey) AS INTEGER) AS burst FROM g""")
def burst_seq_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("time", F.lit(None).cast("timestamp_ntz"))
    return sessions.burst_groups(rows, moment="c_nationkey", time="time", path="c_name", tie="c_custkey").select("c_custkey", "burst")


KEEP_SQL = f"""{BURST_SQL},
rn AS (SELECT *, row_number() OVER (PARTITION BY day, burst ORDER BY coalesce(value, 0) DESC, burst_pos) AS rn FROM bp),
tp AS (SELECT *, first_value(event_type) OVER (PARTITION BY day, burst ORDER BY rn) AS top FROM rn),
pp AS (SELECT *, min(CASE WHEN event_type <> top THEN rn END) OVER (PARTITION BY day, burst) AS p FROM tp),
k AS (SELECT *, CAST(CASE WHEN p IS NULL OR rn = 1 THEN rn WHEN rn >= p THEN rn - p + 2 ELSE (burst_size - p + 2) + (rn - 1) END AS INTEGER) AS keep_order FROM pp)"""


@query(f"WITH {KEEP_SQL} SELECT event_id, keep_order, keep_order <= 3 AS kept, CAST(row_number() OVER (PARTITION BY day, burst, keep_order <= 3 ORDER BY burst_pos) + CASE WHEN keep_order <= 3 THEN 0 ELSE 3 END AS INTEGER) AS burst_pos_rank FROM k")
def burst_keep_k(spark, sf_dir):
    rows = bursts(spark, sf_dir).withColumn("none", F.lit(None).cast("double"))
    return sessions.burst_keepers(rows, ["day", "burst"], "event_type", "value", "none").select("event_id", "keep_order", "kept", "burst_pos_rank")


@query(f"WITH {BURST_SQL} SELECT event_id, round(CASE WHEN burst_size BETWEEN 2 AND 8 AND burst_pos <= 4 THEN coalesce(nullif(value / 100, 0), 0.5) * CASE burst_pos WHEN 1 THEN 1.15 WHEN 2 THEN 1.05 ELSE 0.95 END ELSE value / 100 END, 6) AS burst_emotion_score FROM bp")
def burst_multiplier(spark, sf_dir):
    compared = F.col("burst_size").between(*DEFAULT.burst_groups) & (F.col("burst_pos") <= DEFAULT.burst_compare)
    rows = bursts(spark, sf_dir).select("event_id", F.when(compared, F.col("burst_pos")).alias("rank"), (F.col("value") / 100).alias("emotion"))
    return rows.select("event_id", F.round(scores.burst_emotion(F.col("rank"), F.col("emotion")), 6).alias("burst_emotion_score"))


# the model's list names the places from the best on: 2, 3, .., 1; the list for three rows is too short and counts for none
@query(f"""WITH {BURST_SQL}, c AS (SELECT event_id, value / 100 AS emotion, least(burst_size, 4) AS n, burst_size, row_number() OVER (PARTITION BY day, burst ORDER BY event_id) AS place FROM bp),
r AS (SELECT *, CASE WHEN burst_size BETWEEN 2 AND 8 AND place <= 4 AND n <> 3 THEN CASE WHEN place = 1 THEN n ELSE place - 1 END END AS rank FROM c)
SELECT event_id, CAST(rank AS INTEGER) AS burst_llm_rank, round(CASE WHEN rank IS NULL THEN emotion ELSE coalesce(nullif(emotion, 0), 0.5) * CASE rank WHEN 1 THEN 1.15 WHEN 2 THEN 1.05 ELSE 0.95 END END, 6) AS burst_emotion_score FROM r""")
def burst_compare(spark, sf_dir):
    group = F.concat_ws("/", F.col("day").cast("string"), "burst")
    rows = bursts(spark, sf_dir).select(F.col("event_id").alias("ord"), F.col("event_type").alias("path"), group.alias("burst_group_id"), F.lit("surviving").alias("status"), (F.col("value") / 100).alias("emotion_score"), F.lit(None).cast("int").alias("burst_llm_rank"))
    sizes = scoring.burst_subsets(rows).groupBy("burst_group_id").agg(F.max("n").alias("n"))
    names = F.when(F.col("n") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.concat(F.sequence(F.lit(2), F.col("n")), F.array(F.lit(1))))
    found = scoring.compared_bursts(rows, sizes.select("burst_group_id", F.to_json(names).alias("reply")))
    return found.select(F.col("ord").alias("event_id"), "burst_llm_rank", F.round("burst_emotion_score", 6).alias("burst_emotion_score"))


@query(f"""WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM f)
SELECT user_id, strftime(min(ts), {SQL_TIME}) AS session_start, strftime(max(ts), {SQL_TIME}) AS session_end, count(*) AS n FROM g GROUP BY user_id, s""")
def session_stream(spark, sf_dir):
    rows = streams.key_sessions(table(spark, sf_dir, "events"), "user_id", "ts")
    return rows.select("user_id", time_text("session_start").alias("session_start"), time_text("session_end").alias("session_end"), "n")


# --- vectors ------------------------------------------------------------------------------------------------------------

CENTROID_SQL = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
x AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS pos FROM v),
mean AS (SELECT label, pos, avg(x) AS m, count(*) AS n FROM x GROUP BY label, pos),
cen AS (SELECT label, list(m ORDER BY pos) AS m, max(n) AS n FROM mean GROUP BY label),
centroid AS (SELECT label, list_transform(m, lambda y: y / coalesce(nullif(sqrt(list_inner_product(m, m)), 0), 1)) AS c, n FROM cen),
sims AS (SELECT v.vec_id, v.label AS own, c.label, round(list_cosine_similarity(v.e, c.c), 6) AS sim FROM v, centroid c)"""


def matched(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return similarity.similarities(rows, "embedding", similarity.centroids(rows, "label", "embedding"), "label", "centroid")


@query(f"WITH {CENTROID_SQL} SELECT label, n, i - 1 AS pos, round(c[i], 6) AS x FROM (SELECT label, n, c, unnest(generate_series(1, len(c))) AS i FROM centroid)")
def centroid_enroll(spark, sf_dir):
    rows = similarity.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return rows.select("label", "n", F.posexplode("centroid").alias("pos", "x")).select("label", "n", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"WITH {CENTROID_SQL} SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS INTEGER) AS place, label, sim FROM sims WHERE sim >= {FACE_MATCH}")
def person_match(spark, sf_dir):
    return similarity.rank_matches(similarity.matches(matched(spark, sf_dir), FACE_MATCH), "vec_id")


CONFUSED_SQL = f"""{CENTROID_SQL}, f AS (SELECT * FROM sims WHERE sim >= {FACE_MATCH}),
partner(label, other) AS (VALUES {', '.join(f'({a}, {b}), ({b}, {a})' for a, b in EXCLUSIVE)}),
lost AS (SELECT f.vec_id, f.label FROM f JOIN partner p ON p.label = f.label JOIN f o ON o.vec_id = f.vec_id AND o.label = p.other AND (o.sim > f.sim OR (o.sim = f.sim AND o.label < f.label)))"""


@query(f"""WITH {CONFUSED_SQL}, kept AS (SELECT f.vec_id, f.own, f.label FROM f ANTI JOIN lost ON lost.vec_id = f.vec_id AND lost.label = f.label)
SELECT e.label AS own, coalesce((SELECT string_agg(DISTINCT k.label::VARCHAR, ',' ORDER BY k.label::VARCHAR) FROM kept k WHERE k.own = e.label), '') AS persons_matched,
EXISTS (SELECT 1 FROM lost l JOIN v ON v.vec_id = l.vec_id WHERE v.label = e.label) AS confusion_warning FROM (SELECT DISTINCT label FROM v) e""")
def confusion_resolve(spark, sf_dir):
    rows = similarity.resolve_confusions(similarity.matches(matched(spark, sf_dir), FACE_MATCH), EXCLUSIVE)
    return similarity.persons_of(rows.withColumnRenamed("label", "own"), "own").select("own", F.array_join("persons_matched", ",").alias("persons_matched"), "confusion_warning")


@query(f"WITH {CENTROID_SQL} SELECT vec_id, string_agg(label::VARCHAR, ',' ORDER BY sim DESC, label) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS rn FROM sims) WHERE rn <= 2 GROUP BY vec_id")
def zero_shot_top2(spark, sf_dir):
    return similarity.best_labels(matched(spark, sf_dir)).select("vec_id", F.array_join("top", ",").alias("tags"))


@query(f"WITH {CENTROID_SQL} SELECT label AS tag, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS rn FROM sims) WHERE rn <= 2 GROUP BY label ORDER BY n DESC, tag LIMIT 5")
def tag_histogram(spark, sf_dir):
    return similarity.tag_histogram(similarity.best_labels(matched(spark, sf_dir)), "top")


@query("SELECT 100.0 * avg(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END) AS coverage_percent, 100.0 * avg(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END) >= 50 AS enough FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def coverage_gate(spark, sf_dir):
    name = lambda t: table(spark, sf_dir, t).select(F.col("doc_id").alias("path"))
    return tables.coverage(name("documents"), name("labels"))


# --- scores -------------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT d.doc_id, CAST(l.quality AS DOUBLE) AS b, CAST(nullif(l.toxic, 1) AS DOUBLE) AS l, CASE WHEN d.n_chars > 2000 THEN 0.25 END AS m FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, round(coalesce((coalesce(b * 0.2, 0) + coalesce(l * 0.4, 0) + coalesce(m * 0.4, 0)) / nullif(CASE WHEN b IS NULL THEN 0 ELSE 0.2 END + CASE WHEN l IS NULL THEN 0 ELSE 0.4 END + CASE WHEN m IS NULL THEN 0 ELSE 0.4 END, 0), 0.5), 6) AS aesthetic_score FROM s""")
def blend_null_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.withColumns({"brisque_score": F.col("quality").cast("double"), "laion_score": F.nullif(F.col("toxic"), F.lit(1)).cast("double"), "musiq_score": F.when(F.col("n_chars") > 2000, 0.25)})
    return scoring.with_aesthetic(rows).select("doc_id", "aesthetic_score")


def _digest_scorer(name: str, every: int) -> scoring.Scorer:
    """A scorer by content digest that fails on every n-th content length."""

    def score(content: bytes) -> float:
        if len(content) % every == 0:
            raise ValueError(name)
        return int.from_bytes(hashlib.sha256(name.encode() + content).digest()[:4], "big") / 4294967295.0

    return scoring.Scorer(name, lambda: score)


DIGEST_SQL = "CASE WHEN strlen(url) % {every} <> 0 THEN round(CAST('0x' || substr(sha256('{name}' || url), 1, 8) AS BIGINT) / 4294967295.0, 6) END"


@query(f"""WITH s AS (SELECT page_id, {DIGEST_SQL.format(name='brisque', every=3)} AS b, {DIGEST_SQL.format(name='laion', every=4)} AS l, {DIGEST_SQL.format(name='musiq', every=5)} AS m FROM pages),
t AS (SELECT page_id, coalesce(b, 0.5) AS b, coalesce(l, b, 0.5) AS l, CASE WHEN l IS NULL THEN 'brisque' ELSE 'laion' END AS laion_method, m FROM s)
SELECT page_id, b AS brisque_score, l AS laion_score, laion_method, m AS musiq_score,
round((b * 0.2 + l * 0.4 + coalesce(m * 0.4, 0)) / (0.6 + CASE WHEN m IS NULL THEN 0 ELSE 0.4 END), 6) AS aesthetic_score FROM t""")
def aesthetic_fallback(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("url").cast("binary").alias("content"))
    broken = scoring.Scorer("nima", lambda: 1 / 0)
    found = scoring.aesthetics(pages, _digest_scorer("brisque", 3), _digest_scorer("laion", 4), broken, _digest_scorer("musiq", 5))
    return scoring.with_aesthetic(found).select(F.col("path").cast("long").alias("page_id"), "brisque_score", "laion_score", "laion_method", "musiq_score", "aesthetic_score")


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, round(greatest(0, least(1, 1 - l_quantity * 2.5 / 100)), 6) AS brisque, round(greatest(0, least(1, l_quantity * 2.5 / 100)), 6) AS musiq,
round(greatest(0, least(1, l_quantity / 4 / 10)), 6) AS laion, round(list_sum(list_transform(range(1, 11), lambda i: i * ((l_partkey + i) % 10) / 45.0)) / 10, 6) AS nima FROM lineitem""")
def score_scales(spark, sf_dir):
    raw = F.col("l_quantity") * 2.5
    bins = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: ((F.col("l_partkey") + i) % 10) / 45.0)
    rated = [scores.inverted_percent(raw).alias("brisque"), scores.percent(raw).alias("musiq"), scores.tenth(F.col("l_quantity") / 4).alias("laion"), scores.expected_rating(bins).alias("nima")]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", *rated)
    return rows.withColumns({c: F.round(c, 6) for c in ("brisque", "musiq", "laion", "nima")})


SCORED_SQL = """o AS (SELECT o_orderkey, o_totalprice % 125 AS blur, CAST((o_custkey * 7) % 256 AS DOUBLE) AS exposure, (o_totalprice % 1000) / 1000 AS aesthetic,
  (o_custkey % 10) / 10.0 AS emotion, (o_orderkey % 7) / 7.0 AS memorability, (o_custkey % 13) / 13.0 AS rot, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 11) / 11.0 END AS prominence,
  o_orderstatus = 'P' AS candid, o_orderstatus = 'F' AND o_orderkey % 3 = 0 AS closed, CASE WHEN o_custkey % 4 = 0 THEN 0.9 ELSE 0.0 END AS distraction FROM orders),
z AS (SELECT *, CASE WHEN blur < 40 THEN FALSE WHEN exposure < 30 OR exposure > 225 THEN FALSE ELSE TRUE END AS alive, blur >= 40 AND blur < 100 AS soft FROM o),
y AS (SELECT *, {weights} AS base, CASE WHEN candid THEN 1.1 ELSE 1.0 END * CASE WHEN closed THEN 0.85 ELSE 1.0 END * CASE WHEN soft THEN 0.95 ELSE 1.0 END * coalesce(nullif(distraction, 0), 1.0) AS factor FROM z),
scored AS (SELECT *, CASE WHEN alive THEN round(base, 6) END AS base_score, CASE WHEN alive THEN round(base * factor, 6) END AS final_score FROM y)"""


def weighted_sql(w: dict[str, float]) -> str:
    return SCORED_SQL.format(weights=f"aesthetic * {w['aesthetic']} + emotion * {w['emotion']} + memorability * {w['memorability']} + rot * {w['rot']} + coalesce(prominence, 0.5) * {w['prominence']}")


def order_records(spark, sf_dir) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").withColumns(
        {
            "blur_score": F.col("o_totalprice") % 125,
            "exposure_mean": ((customer * 7) % 256).cast("double"),
            "aesthetic_score": (F.col("o_totalprice") % 1000) / 1000,
            "emotion_score": (customer % 10) / 10,
            "memorability_score": (key % 7) / 7,
            "rot_score": (customer % 13) / 13,
            "prominence_score": F.when(key % 5 != 0, (key % 11) / 11),
            "shot_type": F.when(F.col("o_orderstatus") == "P", F.array(F.lit("group"), F.lit("candid"))).otherwise(F.array(F.lit("group"))),
            "has_closed_eyes": (F.col("o_orderstatus") == "F") & (key % 3 == 0),
            "distraction_penalty": F.when(customer % 4 == 0, 0.9).otherwise(0.0),
            "laion_score": F.lit(None).cast("double"),
            "nima_score": F.lit(None).cast("double"),
        }
    )
    return rows.withColumns({"blur_tier": tiers.blur_tier(F.col("blur_score")), "status": tiers.status(F.col("blur_score"), F.col("exposure_mean"))})


@query(f"WITH {weighted_sql(DEFAULT.weights)} SELECT o_orderkey, base_score, final_score FROM scored")
def final_score(spark, sf_dir):
    return scoring.with_final(order_records(spark, sf_dir)).select("o_orderkey", "base_score", "final_score")


@query(f"WITH {weighted_sql(NEW_WEIGHTS)} SELECT o_orderkey, base_score, final_score FROM scored")
def reweight(spark, sf_dir):
    return scoring.reweight(order_records(spark, sf_dir), NEW_WEIGHTS).select("o_orderkey", "base_score", "final_score")


@query(f"WITH {weighted_sql(DEFAULT.weights)} SELECT count(final_score) AS n, round(min(final_score), 6) AS low, round(max(final_score), 6) AS high, round(avg(final_score), 6) AS mean, round(median(final_score), 6) AS middle FROM scored")
def score_summary(spark, sf_dir):
    found = report.statistics(scoring.with_final(order_records(spark, sf_dir)), "final_score")
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("low", "high", "mean", "middle")])


@query(f"""WITH {weighted_sql(DEFAULT.weights)} SELECT count(*) FILTER (WHERE alive AND candid) AS n_candid_bonus, count(*) FILTER (WHERE alive AND closed) AS n_closed_eyes_penalty,
count(*) FILTER (WHERE alive AND soft) AS n_soft_blur_penalty, count(*) FILTER (WHERE alive AND distraction > 0) AS n_distraction_penalty FROM scored""")
def modifier_counts(spark, sf_dir):
    rows = scoring.with_final(order_records(spark, sf_dir)).withColumns({"laion_method": F.lit("laion"), "llava_fallback": F.lit(False)})
    return report.method_counts(rows).drop("n_laion", "n_fallback")


@query(f"WITH {weighted_sql(DEFAULT.weights)} SELECT o_orderkey, final_score FROM scored WHERE alive ORDER BY final_score DESC, o_orderkey LIMIT 10")
def top10(spark, sf_dir):
    rows = scoring.with_final(order_records(spark, sf_dir).where(tiers.is_alive(F.col("status"))))
    return report.top(rows, "final_score", "o_orderkey").select("o_orderkey", "final_score")


@query("SELECT avg(CASE WHEN l_linenumber > 1 THEN l_linenumber - 1 END) AS mean_faces, count(*) FILTER (WHERE l_tax * 10 > 0.7) AS n_smiling, count(*) FILTER (WHERE l_returnflag = 'R') AS n_closed_eyes, 0::BIGINT AS n_errors FROM lineitem")
def face_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") - 1).alias("faces_detected"), (F.col("l_tax") * 10).alias("max_smile_score"), (F.col("l_returnflag") == "R").alias("has_closed_eyes"))
    return report.face_summary(rows)


BOX_SQL = """b AS (SELECT l_orderkey, CAST(l_partkey % 500 AS INTEGER) AS x, CAST(l_suppkey % 300 AS INTEGER) AS y, CAST(l_quantity AS INTEGER) AS w, CAST(l_linenumber * 10 AS INTEGER) AS h FROM lineitem)"""


def framed(spark, sf_dir) -> DataFrame:
    """Orders as frames of 640 x 480 with a box for each line."""
    box = F.struct((F.col("l_partkey") % 500).cast("int").alias("x"), (F.col("l_suppkey") % 300).cast("int").alias("y"), F.col("l_quantity").cast("int").alias("w"), (F.col("l_linenumber") * 10).cast("int").alias("h"))
    boxes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(box).alias("boxes"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = orders.join(boxes, "l_orderkey", "left").withColumns({"width": F.lit(640), "height": F.lit(480)})
    return rows.withColumns({"peak_x": F.col("l_orderkey") % 640, "peak_y": F.col("l_orderkey") % 480})


@query(f"""WITH {BOX_SQL}, p(px, py) AS (VALUES (640 / 3, 480 / 3), (640 * 2 / 3, 480 / 3), (640 / 3, 480 * 2 / 3), (640 * 2 / 3, 480 * 2 / 3)),
s AS (SELECT l_orderkey, max(exp(-(pow(x + w / 2 - px, 2) + pow(y + h / 2 - py, 2)) / (2 * pow(480 * 0.12, 2)))) AS best FROM b, p GROUP BY l_orderkey)
SELECT o_orderkey AS l_orderkey, round(CASE WHEN best IS NULL THEN 0.5 ELSE greatest(best, 0) END, 6) AS rot_score FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def rule_of_thirds(spark, sf_dir):
    return framed(spark, sf_dir).select("l_orderkey", F.round(scores.rule_of_thirds(F.col("boxes"), F.col("width"), F.col("height")), 6).alias("rot_score"))


@query(f"WITH {BOX_SQL}, s AS (SELECT l_orderkey, max(w * h) AS area FROM b GROUP BY l_orderkey) SELECT o_orderkey AS l_orderkey, round(CASE WHEN area IS NULL THEN 0.5 ELSE least(1.0, area / (640 * 480)) END, 6) AS prominence_score FROM orders LEFT JOIN s ON l_orderkey = o_orderkey")
def prominence(spark, sf_dir):
    return framed(spark, sf_dir).select("l_orderkey", F.round(scores.prominence(F.col("boxes"), F.col("width"), F.col("height")), 6).alias("prominence_score"))


@query(f"WITH {BOX_SQL}, s AS (SELECT l_orderkey, min(sqrt(pow(x + w / 2 - l_orderkey % 640, 2) + pow(y + h / 2 - l_orderkey % 480, 2))) AS nearest FROM b GROUP BY l_orderkey) SELECT o_orderkey AS l_orderkey, CASE WHEN nearest > 160.0 THEN 0.9 ELSE 1.0 END AS distraction_penalty FROM orders LEFT JOIN s ON l_orderkey = o_orderkey")
def distraction(spark, sf_dir):
    return framed(spark, sf_dir).select("l_orderkey", scores.distraction(F.col("peak_x"), F.col("peak_y"), F.col("boxes"), F.col("width"), F.col("height")).alias("distraction_penalty"))


@query("SELECT event_id, CASE WHEN try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL THEN round(greatest(0, least(1, try_cast(json_extract_string(props, '$.k') AS DOUBLE) / 10)), 6) END AS k, CAST(json_extract(props, '$.k') AS INTEGER) AS first_rank FROM events")
def llm_reply_parse(spark, sf_dir):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    listed = F.concat(F.lit("["), F.regexp_extract("props", r"([0-9]+)", 1), F.lit(", 2]"))
    rows = table(spark, sf_dir, "events").select("event_id", replies.ratings(fenced, ("k",)).alias("r"), replies.rank_list(listed, F.lit(2)).alias("ranks"))
    return rows.select("event_id", F.round("r.k", 6).alias("k"), F.get("ranks", F.lit(0)).alias("first_rank"))


# --- selection ------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderpriority, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 15")
def greedy_one_cap(spark, sf_dir):
    return select.one_cap(table(spark, sf_dir, "orders"), "o_orderpriority", DEFAULT.moment_cap, "o_totalprice", "o_orderkey").select("o_orderkey", "o_orderpriority", "place")


# a fold over the orders from the greatest price on, one for each step, with a count for each month and each priority
@query("""WITH RECURSIVE o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos, dense_rank() OVER (ORDER BY strftime(o_orderdate, '%Y-%m')) AS m, dense_rank() OVER (ORDER BY o_orderpriority) AS s FROM orders),
fold(pos, months, kinds, n, chosen) AS (
  SELECT 0::BIGINT, list_transform(range(1 + (SELECT max(m) FROM o)), lambda x: 0), list_transform(range(1 + (SELECT max(s) FROM o)), lambda x: 0), 0, NULL::BIGINT
  UNION ALL
  SELECT o.pos, CASE WHEN f.ok THEN list_transform(f.months, lambda x, i: CASE WHEN i = o.m THEN x + 1 ELSE x END) ELSE f.months END,
    CASE WHEN f.ok THEN list_transform(f.kinds, lambda x, i: CASE WHEN i = o.s THEN x + 1 ELSE x END) ELSE f.kinds END, f.n + CASE WHEN f.ok THEN 1 ELSE 0 END, CASE WHEN f.ok THEN o.o_orderkey END
  FROM (SELECT fold.*, months[p.m] < 15 AND kinds[p.s] < 320 AS ok FROM fold JOIN o p ON p.pos = fold.pos + 1 WHERE n < 800) f JOIN o ON o.pos = f.pos + 1)
SELECT chosen AS o_orderkey, CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS selection_rank FROM fold WHERE chosen IS NOT NULL""")
def greedy_two_caps(spark, sf_dir):
    """800 orders under 15 for each month and 320 for each priority."""
    orders = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM"))
    return select.greedy(orders, DEFAULT.select_n, "day", DEFAULT.moment_cap, "o_orderpriority", DEFAULT.shot_cap, "o_totalprice", "o_orderkey")


@query("""WITH RECURSIVE c AS (SELECT vec_id AS id, ((vec_id * 37) % 101) / 100.0 AS score, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
m AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.e, b.e) AS sim FROM c a, c b),
pick(step, ids, id, val) AS (
  SELECT * FROM (SELECT 1 AS step, [id] AS ids, id, round(0.7 * score, 6) AS val FROM c ORDER BY score DESC, id LIMIT 1)
  UNION ALL
  SELECT step + 1, list_append(ids, id), id, round(v, 6) FROM (
    SELECT p.step, p.ids, c.id, c.score, 0.7 * c.score - (1.0 - 0.7) * max(m.sim) AS v FROM pick p JOIN c ON NOT list_contains(p.ids, c.id) JOIN m ON m.a = c.id AND list_contains(p.ids, m.b)
    WHERE p.step < 20 GROUP BY p.step, p.ids, c.id, c.score) QUALIFY row_number() OVER (ORDER BY v DESC, score DESC, id) = 1)
SELECT CAST(step AS INTEGER) AS selection_rank, id AS vec_id, val AS mmr_score FROM pick""")
def mmr_select(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("score", ((F.col("vec_id") * 37) % 101) / 100)
    return select.diverse(rows, 20, "score", "embedding", "vec_id").select("selection_rank", "vec_id", "mmr_score")


# the same under quotas: six for each label, fifteen for each third of the ids
@query("""WITH RECURSIVE c AS (SELECT vec_id AS id, ((vec_id * 37) % 101) / 100.0 AS score, label, vec_id % 3 AS third, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
m AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.e, b.e) AS sim FROM c a, c b),
pick(step, ids, labels, thirds, id, val) AS (
  SELECT * FROM (SELECT 1 AS step, [id] AS ids, [label] AS labels, [third] AS thirds, id, round(0.7 * score, 6) AS val FROM c ORDER BY score DESC, id LIMIT 1)
  UNION ALL
  SELECT step + 1, list_append(ids, id), list_append(labels, label), list_append(thirds, third), id, round(v, 6) FROM (
    SELECT p.step, p.ids, p.labels, p.thirds, c.id, c.label, c.third, c.score, 0.7 * c.score - (1.0 - 0.7) * max(m.sim) AS v
    FROM pick p JOIN c ON NOT list_contains(p.ids, c.id) AND len(list_filter(p.labels, lambda x: x = c.label)) < 6 AND len(list_filter(p.thirds, lambda x: x = c.third)) < 15 JOIN m ON m.a = c.id AND list_contains(p.ids, m.b)
    WHERE p.step < 40 GROUP BY p.step, p.ids, p.labels, p.thirds, c.id, c.label, c.third, c.score) QUALIFY row_number() OVER (ORDER BY v DESC, score DESC, id) = 1)
SELECT CAST(step AS INTEGER) AS selection_rank, id AS vec_id, val AS mmr_score FROM pick""")
def mmr_quotas(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumns({"score": ((F.col("vec_id") * 37) % 101) / 100, "third": F.col("vec_id") % 3})
    return select.diverse(rows, 40, "score", "embedding", "vec_id", moment="label", moment_cap=6, shot="third", shot_cap=15).select("selection_rank", "vec_id", "mmr_score")


@query()
def mmr_800(spark, sf_dir):
    """800 of the embeddings under the products' quotas, at the size of the reference's run; tests hold diverse() against a loop."""
    rows = table(spark, sf_dir, "embeddings").withColumn("score", ((F.col("vec_id") * 37) % 101) / 100)
    third = rows.withColumn("shot", (F.col("vec_id") % 5).cast("string")).withColumn("moment", F.floor(F.col("vec_id") / 12).cast("string"))
    return select.diverse(third, DEFAULT.select_n, "score", "embedding", "vec_id", moment="moment", shot="shot", shot_cap=DEFAULT.shot_cap).select("selection_rank", "vec_id", "mmr_score")


@query("SELECT o_orderpriority, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent, count(*) * 100.0 / sum(count(*)) OVER () > 60 AS dominant FROM orders GROUP BY o_orderpriority")
def diversity_share(spark, sf_dir):
    return report.shares(table(spark, sf_dir, "orders"), "o_orderpriority").withColumn("percent", F.round("percent", 6))


# --- review ---------------------------------------------------------------------------------------------------------------

REVIEW_SQL = """ev AS (SELECT event_id AS seq, user_id AS path, CASE event_type WHEN 'purchase' THEN 'status' WHEN 'view' THEN 'status' WHEN 'signup' THEN 'cycle' ELSE 'toggle' END AS action,
  CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'view' THEN 'rejected' WHEN 'signup' THEN NULL ELSE 'p' || (event_id % 3) END AS arg FROM events),
st AS (SELECT path, max(seq) AS last_at, arg_max(arg, seq) AS set_to FROM ev WHERE action = 'status' GROUP BY path),
cy AS (SELECT ev.path, count(*) AS turns FROM ev LEFT JOIN st USING (path) WHERE action = 'cycle' AND seq > coalesce(last_at, -1) GROUP BY ev.path),
tg AS (SELECT path, arg, max(seq) AS last_at FROM ev WHERE action = 'toggle' GROUP BY path, arg HAVING count(*) % 2 = 1),
rv AS (SELECT p.path, CASE WHEN coalesce(turns, 0) = 0 THEN coalesce(set_to, 'unreviewed') WHEN (coalesce(set_to, 'unreviewed') = 'approved') = (turns % 2 = 0) THEN 'approved' ELSE 'unreviewed' END AS status
  FROM (SELECT DISTINCT path FROM ev WHERE action IN ('status', 'cycle') UNION SELECT path FROM tg) p LEFT JOIN st USING (path) LEFT JOIN cy USING (path))"""


def review_events(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind.isin("purchase", "view"), "status").when(kind == "signup", "cycle").otherwise("toggle")
    arg = F.when(kind == "purchase", "approved").when(kind == "view", "rejected").when(kind != "signup", F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("path"), action.alias("action"), arg.alias("arg"))


@query(f"WITH {REVIEW_SQL} SELECT path, status, coalesce((SELECT string_agg(arg, ',' ORDER BY last_at) FROM tg WHERE tg.path = rv.path), '') AS person_tags FROM rv")
def review_fold(spark, sf_dir):
    return review.fold(review_events(spark, sf_dir)).select("path", "status", F.array_join("person_tags", ",").alias("person_tags"))


def reviewed(spark, sf_dir) -> DataFrame:
    """Customers with the reviews of the users of their number."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_custkey").alias("path"), F.col("c_name"), F.col("c_mktsegment").alias("primary_shot_type"), (F.col("c_acctbal") / 10000).alias("final_score"))
    return review.with_reviews(rows, review.fold(review_events(spark, sf_dir)))


REVIEWED_SQL = f"""{REVIEW_SQL}, rows AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal / 10000 AS score, coalesce(status, 'unreviewed') AS status FROM customer LEFT JOIN rv ON rv.path = c_custkey)"""


@query(f"WITH {REVIEWED_SQL} SELECT c_custkey FROM rows WHERE coalesce(score, 0) BETWEEN 0.1 AND 0.9 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND status IN ('approved', 'unreviewed')")
def facet_filter(spark, sf_dir):
    facets = review.Facets(shots=("BUILDING", "MACHINERY"), low=0.1, high=0.9, statuses=("approved", "unreviewed"))
    return reviewed(spark, sf_dir).where(review.facet_test(facets)).select(F.col("path").alias("c_custkey"))


@query(f"WITH {REVIEWED_SQL} SELECT c_custkey FROM rows WHERE coalesce(score, 0) BETWEEN 0.0 AND 1.0 AND EXISTS (SELECT 1 FROM tg WHERE tg.path = c_custkey AND tg.arg IN ('p0', 'p2'))")
def facet_tags(spark, sf_dir):
    return reviewed(spark, sf_dir).where(review.facet_test(review.Facets(tags=("p0", "p2")))).select(F.col("path").alias("c_custkey"))


@query(f"WITH {REVIEWED_SQL} SELECT count(*) FILTER (WHERE status <> 'unreviewed') AS reviewed, count(*) FILTER (WHERE status = 'unreviewed') AS remaining FROM rows")
def review_resume(spark, sf_dir):
    rows = reviewed(spark, sf_dir)
    return review.resume_counts(rows, rows.select("path", F.col("review_status").alias("status")))


@query(f"""WITH {REVIEWED_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'approved') AS approved, count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) FILTER (WHERE status = 'unreviewed') AS unreviewed,
count(*) FILTER (WHERE status = 'approved') > 200 AS warning, {', '.join(f"count(*) FILTER (WHERE EXISTS (SELECT 1 FROM tg WHERE tg.path = c_custkey AND tg.arg = '{p}')) AS n_{p}" for p in ('p0', 'p1', 'p2'))} FROM rows""")
def review_summary(spark, sf_dir):
    return review.summary(reviewed(spark, sf_dir), ["p0", "p1", "p2"])


@query(f"""WITH {REVIEWED_SQL}, plan AS (SELECT c_custkey AS ord, 'IMG_' || (c_custkey % 20) || '.jpg' AS base, 'out' AS folder FROM rows WHERE status = 'approved'
  UNION ALL SELECT c_custkey, 'IMG_' || (c_custkey % 20) || '.jpg', 'out/' || tg.arg FROM rows JOIN tg ON tg.path = c_custkey),
numbered AS (SELECT *, row_number() OVER (PARTITION BY folder, base ORDER BY ord) AS n FROM plan)
SELECT ord, folder, folder || '/' || CASE WHEN n = 1 THEN base ELSE replace(base, '.jpg', '') || '_' || n || '.jpg' END AS target FROM numbered""")
def export_plan(spark, sf_dir):
    rows = reviewed(spark, sf_dir).withColumn("path", F.concat(F.lit("/photos/"), F.col("ord"), F.lit("/IMG_"), F.col("ord") % 20, F.lit(".jpg")))
    return review.export_plan(rows, "out").select("ord", "folder", "target")


