"""The catalogue: each operator over the documents listing, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import any_of
from ..functions.paths import as_folders, basename, escape_path, from_folders, message, relative_path
from ..functions.sizes import format_bytes
from ..model import CACHE_VERSION, CHUNK, PROBE, SKIPPED, SYMLINK
from ..operators import cache, filters, plan, screen, verify
from ..sources.listing import contents, listing, roots, union_roots

MIN_SIZE, GLOBS, PRUNED = 100, ("*.bak", "[1-4]*[^0]?.t?p"), ("src1*", "de")
PRIORITY = ("/src3", "/links", "/src1")
#: Small probes, so that documents of a few KB take several stages.
SMALL_PROBE, SMALL_CHUNK = 4, 4096
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BASE = """
docs AS (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents),
base AS (SELECT '/' || source || '/' || lang || '/' || doc_id || CASE doc_id % 10 WHEN 0 THEN '.bak' WHEN 1 THEN '.tmp' ELSE '.txt' END AS path,
  CAST(strlen(text) AS BIGINT) AS size, 1600000000000000000 + doc_id AS mtime_ns, TRY_CAST(substr(source, 4) AS BIGINT) % 2 AS dev, doc_id AS ino, text, source FROM docs),
bag AS (SELECT *, 0 AS root_idx FROM base
  UNION ALL SELECT * REPLACE ('/links' || path AS path), 1 FROM base WHERE ino % 7 = 0
  UNION ALL SELECT * REPLACE ('/mirror' || path AS path, dev + 10 AS dev), 2 FROM base WHERE ino % 5 = 0
  UNION ALL SELECT *, 3 FROM base WHERE source = 'src1'),
listing AS (SELECT *, count(*) OVER (PARTITION BY dev, ino) AS nlink FROM bag)"""


def siblings_sql(key: str) -> str:
    return f""",
siblings AS (SELECT {key}, min(path) AS rep_path, arg_min(nlink, path) AS rep_nlink, arg_min(mtime_ns, path) AS rep_mtime_ns, arg_min(text, path) AS rep_text, count(*) AS n_paths FROM listing GROUP BY {key}),
candidates AS (SELECT * FROM siblings WHERE size IN (SELECT size FROM siblings GROUP BY size HAVING count(*) >= 2)),
confirmed AS (SELECT *, size || ':' || sha256(rep_text) AS group_id FROM candidates QUALIFY count(*) OVER (PARTITION BY size, sha256(rep_text)) >= 2)"""


INO, DEV_INO = siblings_sql("size, ino"), siblings_sql("size, dev, ino")
MEMBERS = """,
paths AS (SELECT DISTINCT size, ino, path, dev, mtime_ns FROM listing),
members AS (SELECT c.group_id, c.ino, c.size, c.rep_path, c.rep_nlink, p.path, p.dev, p.mtime_ns FROM confirmed c JOIN paths p ON c.size = p.size AND c.ino = p.ino)"""


def sources_sql(prefixes: tuple[str, ...]) -> str:
    pref = "CASE " + " ".join(f"WHEN starts_with(path, '{p}') THEN {k}" for k, p in enumerate(prefixes)) + " END" if prefixes else "CAST(NULL AS INTEGER)"
    return f""",
ranked AS (SELECT *, {pref} AS pref FROM members),
sources AS (SELECT group_id, path AS source, ino AS source_ino, dev AS source_dev FROM ranked
  QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY pref IS NULL, pref,
    CASE WHEN pref IS NULL THEN (CASE WHEN path = rep_path THEN 0 ELSE 1 END) END, CASE WHEN pref IS NULL THEN -rep_nlink END, rep_path, path) = 1),
actions AS (SELECT m.group_id, s.source, m.path AS target, m.size, m.mtime_ns,
  CASE WHEN m.dev IS NOT DISTINCT FROM s.source_dev THEN 'hardlink' ELSE 'symlink' END AS action
  FROM members m JOIN sources s ON m.group_id = s.group_id WHERE m.ino <> s.source_ino)"""


ACTIONS = INO + MEMBERS + sources_sql(PRIORITY)


def query(sql: str, base: bool | None = True) -> Callable[[Query], Query]:
    """Registers a query with its SQL, which follows the listing's tables (base), other tables of its own (None) or stands alone."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {BASE}{sql}" if base else f"WITH {sql}" if base is None else sql
        return f

    return add


def regex(globs: tuple[str, ...]) -> str:
    """The pattern of any_of for DuckDB's full match."""
    return any_of(globs).removeprefix(r"(?s)\A").removesuffix(r"\z").replace("*+", "*")


NAME = "regexp_extract(path, '[^/]*$')"


@query(f" SELECT count(*) AS n_scanned, CAST(sum(size) AS BIGINT) AS bytes_scanned, count(*) FILTER (WHERE size >= {MIN_SIZE} AND NOT regexp_full_match({NAME}, '{regex(GLOBS)}')) AS n_matched, CAST(coalesce(sum(size) FILTER (WHERE size >= {MIN_SIZE} AND NOT regexp_full_match({NAME}, '{regex(GLOBS)}')), 0) AS BIGINT) AS bytes_matched FROM bag")
def scan_stats(spark, sf):
    return filters.scan_stats(union_roots(roots(spark.read.parquet(f"{sf}/documents.parquet"))), filters.large_enough(MIN_SIZE) & filters.not_excluded(GLOBS))


def _bag(spark: SparkSession, sf: str) -> DataFrame:
    return union_roots(roots(spark.read.parquet(f"{sf}/documents.parquet"))).drop("content", "source")


@query(f" SELECT path, size, root_idx FROM bag WHERE size >= {MIN_SIZE}")
def filter_min_size(spark, sf):
    return _bag(spark, sf).where(filters.large_enough(MIN_SIZE)).select("path", "size", "root_idx")


@query(f" SELECT path, size, root_idx FROM bag WHERE NOT regexp_full_match({NAME}, '{regex(GLOBS)}')")
def exclude_glob(spark, sf):
    return _bag(spark, sf).where(filters.not_excluded(GLOBS)).select("path", "size", "root_idx")


@query(f" SELECT path, size, root_idx FROM bag WHERE len(list_filter(string_split(path, '/')[:-2], lambda d: regexp_full_match(d, '{regex(PRUNED)}'))) = 0")
def prune_dirs(spark, sf):
    return _bag(spark, sf).where(filters.not_pruned(PRUNED)).select("path", "size", "root_idx")


@query(" SELECT root_idx, path, size, ino, dev FROM bag")
def multi_root_union(spark, sf):
    return _bag(spark, sf).select("root_idx", "path", "size", "ino", "dev")


@query(" SELECT size, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM bag GROUP BY size")
def group_by_size(spark, sf):
    return screen.by_size(_bag(spark, sf))


@query(INO + " SELECT size, ino, n_paths, rep_path FROM siblings")
def siblings_by_ino(spark, sf):
    return screen.siblings(listing(spark, sf)).select("size", "ino", "n_paths", "rep_path")


@query(DEV_INO + " SELECT size, dev, ino, n_paths, rep_path FROM siblings")
def siblings_by_dev_ino(spark, sf):
    return screen.siblings(listing(spark, sf), True).select("size", "dev", "ino", "n_paths", "rep_path")


@query(INO + " SELECT size, count(*) AS n_inodes, CAST(sum(size) AS BIGINT) AS bytes FROM candidates GROUP BY size")
def candidates(spark, sf):
    return screen.screen(listing(spark, sf)).groupBy("size").agg(F.count("*").alias("n_inodes"), F.sum("size").cast("long").alias("bytes"))


@query(DEV_INO + " SELECT size, count(*) AS n_inodes, CAST(sum(size) AS BIGINT) AS bytes FROM candidates GROUP BY size")
def candidates_trust_dev(spark, sf):
    return screen.screen(listing(spark, sf), True).groupBy("size").agg(F.count("*").alias("n_inodes"), F.sum("size").cast("long").alias("bytes"))


@query(INO + " SELECT size, ino, rep_path, rep_nlink, rep_mtime_ns FROM siblings")
def representatives(spark, sf):
    return screen.siblings(listing(spark, sf)).select("size", "ino", "rep_path", "rep_nlink", "rep_mtime_ns")


@query(" SELECT size, ino, string_agg(path, ',' ORDER BY path) AS paths FROM listing GROUP BY size, ino")
def sibling_paths(spark, sf):
    return listing(spark, sf).groupBy("size", "ino").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"))


@query(INO + " SELECT count(*) AS n_inodes, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM candidates")
def screen_stats(spark, sf):
    return screen.screen_stats(screen.screen(listing(spark, sf)))


def _range_sql(p: int, c: int) -> str:
    return f""", s AS (SELECT DISTINCT size FROM bag),
k AS (SELECT size, unnest(range(0, CAST(CASE WHEN size <= {p} THEN 1 WHEN size <= 2 * {p} THEN 2 ELSE 2 + (size - 2 * {p} + {c} - 1) // {c} END AS BIGINT))) AS stage FROM s),
r AS (SELECT size, stage, CAST(CASE stage WHEN 0 THEN 0 WHEN 1 THEN greatest({p}, size - {p}) ELSE {p} + (stage - 2) * {c} END AS BIGINT) AS start,
  CAST(CASE stage WHEN 0 THEN least({p}, size) WHEN 1 THEN least({p}, size - {p}) ELSE least({c}, size - 2 * {p} - (stage - 2) * {c}) END AS BIGINT) AS len FROM k)
SELECT size, stage, start, len, CAST(sum(len) OVER (PARTITION BY size ORDER BY stage) AS BIGINT) AS total_bytes, sum(len) OVER (PARTITION BY size ORDER BY stage) = size AS done FROM r"""


@query(_range_sql(SMALL_PROBE, SMALL_CHUNK))
def range_plan(spark, sf):
    return verify.range_plan(_bag(spark, sf).select("size").distinct(), SMALL_PROBE, SMALL_CHUNK)


@query(_range_sql(PROBE, CHUNK))
def range_plan_default(spark, sf):
    return verify.range_plan(_bag(spark, sf).select("size").distinct())


def _hash_sql(stage: int) -> str:
    p, c = SMALL_PROBE, SMALL_CHUNK
    start, length, enough = [("0", f"least({p}, size)", "true"), (f"greatest({p}, size - {p})", f"least({p}, size - {p})", f"size > {p}"), (f"{p}", f"least({c}, size - 2 * {p})", f"size > 2 * {p}")][stage]
    return f" SELECT path, CAST({start} AS BIGINT) AS start, CAST({length} AS BIGINT) AS len, sha256(encode(text)[({start}) + 1 : ({start}) + ({length})]) AS hash FROM bag WHERE root_idx < 3 AND {enough}"


@query(_hash_sql(0))
def range_hash_head(spark, sf):
    return verify.hash_contents(contents(spark, sf), 0, SMALL_PROBE, SMALL_CHUNK)


@query(_hash_sql(1))
def range_hash_tail(spark, sf):
    return verify.hash_contents(contents(spark, sf), 1, SMALL_PROBE, SMALL_CHUNK)


@query(_hash_sql(2))
def range_hash_chunk(spark, sf):
    return verify.hash_contents(contents(spark, sf), 2, SMALL_PROBE, SMALL_CHUNK)


def confirmed(spark: SparkSession, sf: str, trust_device: bool = False) -> DataFrame:
    return verify.one_pass(screen.screen(listing(spark, sf), trust_device), contents(spark, sf))


@query(INO + " SELECT size, sha256(rep_text) AS hash, count(*) AS n_inodes, min(rep_path) AS first_path FROM confirmed GROUP BY ALL")
def verify_onepass(spark, sf):
    return confirmed(spark, sf).groupBy("size", "hash").agg(F.count("*").alias("n_inodes"), F.min("rep_path").alias("first_path"))


@query(DEV_INO + " SELECT size, sha256(rep_text) AS hash, count(*) AS n_inodes, min(rep_path) AS first_path FROM confirmed GROUP BY ALL")
def verify_onepass_trust_dev(spark, sf):
    return confirmed(spark, sf, True).groupBy("size", "hash").agg(F.count("*").alias("n_inodes"), F.min("rep_path").alias("first_path"))


def _staged(spark: SparkSession, sf: str, probe: int, chunk: int) -> verify.Verified:
    return verify.staged(screen.screen(listing(spark, sf)), verify.table_hasher(contents(spark, sf), probe, chunk), None, probe, chunk)


@query(INO + " SELECT size, count(*) AS n_inodes, min(rep_path) AS first_path FROM confirmed GROUP BY size, group_id")
def verify_staged(spark, sf):
    found = _staged(spark, sf, SMALL_PROBE, SMALL_CHUNK).confirmed
    return found.groupBy("group_id", "size").agg(F.count("*").alias("n_inodes"), F.min("rep_path").alias("first_path")).drop("group_id")


def _stages_sql(p: int, c: int) -> str:
    """Each inode drops out at the first stage at which no other shares all bytes known; a round reads all its stages of those that it begins with."""
    return f""", e AS (SELECT size, ino, encode(rep_text) AS b, CAST(CASE WHEN size <= {p} THEN 1 WHEN size <= 2 * {p} THEN 2 ELSE 2 + (size - 2 * {p} + {c} - 1) // {c} END AS BIGINT) AS n_stages FROM candidates),
k AS (SELECT *, unnest(range(0, n_stages)) AS stage FROM e),
r AS (SELECT size, ino, stage, n_stages, CASE WHEN stage < 3 THEN stage ELSE 1 + CAST(pow(2, floor(log2(stage - 1))) AS BIGINT) END AS first,
  CASE stage WHEN 0 THEN least({p}, size) WHEN 1 THEN least({p}, size - {p}) ELSE least({c}, size - 2 * {p} - (stage - 2) * {c}) END AS len,
  sha256(b[1:{p}]) || CASE WHEN stage > 0 THEN sha256(b[greatest({p}, size - {p}) + 1:size]) ELSE '' END || CASE WHEN stage > 1 THEN sha256(b[{p} + 1:{p} + least((stage - 1) * {c}, size - 2 * {p})]) ELSE '' END AS known FROM k),
g AS (SELECT *, count(*) OVER (PARTITION BY size, stage, known) AS n FROM r),
a AS (SELECT *, min(stage) FILTER (WHERE n < 2) OVER (PARTITION BY size, ino) AS alone_at, CASE WHEN first < 3 THEN first + 1 ELSE 2 * first - 1 END AS last FROM g),
t AS (SELECT *, coalesce(alone_at >= first, true) AS open, size - CASE WHEN last >= n_stages THEN size WHEN last = 1 THEN {p} ELSE 2 * {p} + (last - 2) * {c} END AS unread FROM a)
SELECT CAST(stage AS INTEGER) AS stage, CAST(sum(len) FILTER (WHERE open) AS BIGINT) AS verified, CAST(0 AS BIGINT) AS cached, CAST(coalesce(sum(unread) FILTER (WHERE stage = alone_at), 0) AS BIGINT) AS skipped, count(*) FILTER (WHERE stage = alone_at) AS eliminated FROM t GROUP BY stage HAVING count(*) FILTER (WHERE open) > 0"""


@query(INO + _stages_sql(SMALL_PROBE, SMALL_CHUNK))
def verify_stats(spark, sf):
    return _staged(spark, sf, SMALL_PROBE, SMALL_CHUNK).stats


@query(INO + ", g AS (SELECT group_id, size, count(*) AS n FROM confirmed GROUP BY ALL) SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_inodes, CAST(coalesce(sum((n - 1) * size), 0) AS BIGINT) AS bytes, count(*) AS n_sets FROM g")
def confirmed_stats(spark, sf):
    return verify.confirmed_stats(confirmed(spark, sf))


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return screen.members(listing(spark, sf), confirmed(spark, sf))


@query(INO + MEMBERS + sources_sql(PRIORITY) + " SELECT group_id, source FROM sources")
def select_source_priority(spark, sf):
    return plan.sources(_members(spark, sf), PRIORITY).select("group_id", "source")


@query(INO + MEMBERS + sources_sql(()) + " SELECT group_id, source FROM sources")
def select_source_nlink(spark, sf):
    return plan.sources(_members(spark, sf)).select("group_id", "source")


def actions(spark: SparkSession, sf: str) -> DataFrame:
    return plan.plan(_members(spark, sf), PRIORITY, True)


@query(ACTIONS + " SELECT group_id, source, target, size AS bytes_saved FROM actions")
def dedupe_plan(spark, sf):
    return actions(spark, sf).select("group_id", "source", "target", "bytes_saved")


@query(ACTIONS + " SELECT source, target, CASE action WHEN 'symlink' THEN 'skipped' ELSE action END AS action, CASE action WHEN 'symlink' THEN 0 ELSE size END AS bytes_saved, CASE action WHEN 'symlink' THEN 'cross-device link' END AS err, 'hardlink' AS dry_run_action FROM actions")
def plan_actions(spark, sf):
    return plan.plan(_members(spark, sf), PRIORITY, False).select("source", "target", "action", "bytes_saved", "err", "dry_run_action")


@query(ACTIONS + " SELECT count(*) AS n_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes_saved, count(DISTINCT group_id) AS n_sets FROM actions")
def dedupe_stats(spark, sf):
    return plan.dedupe_stats(actions(spark, sf))


@query(INO + ", g AS (SELECT group_id, sum(n_paths) - arg_min(n_paths, rep_path) AS n FROM confirmed GROUP BY group_id) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n_targets FROM g")
def target_count(spark, sf):
    return plan.target_count(confirmed(spark, sf))


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    start, length, _ = verify.range_columns(F.col("size"), F.lit(0), SMALL_PROBE, SMALL_CHUNK)
    return screen.screen(listing(spark, sf)).withColumn("start", start).withColumn("len", length)


def _old_cache(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the heads from an earlier run; some have changed since, some entries are broken, some are of files that are gone."""
    heads = _requests(spark, sf).join(verify.hash_contents(contents(spark, sf), 0, SMALL_PROBE, SMALL_CHUNK).select(F.col("path").alias("rep_path"), "hash"), "rep_path").where("ino % 3 = 0")
    known = F.when(F.col("ino") % 11 == 0, F.unhex(F.substring("hash", 1, 32))).otherwise(F.unhex("hash"))
    gone = F.when(F.col("ino") % 13 == 0, F.concat("rep_path", F.lit(".gone"))).otherwise(F.col("rep_path"))
    return heads.select(F.lit(CACHE_VERSION).alias("key_version"), gone.alias("path"), F.col("size").alias("file_size"), "ino", (F.col("rep_mtime_ns") + F.when(F.col("ino") % 7 == 0, 1).otherwise(0)).alias("mtime_ns"), "start", "len", known.alias("hash"))


CACHED = "ino % 3 = 0 AND ino % 7 <> 0 AND ino % 11 <> 0 AND ino % 13 <> 0"
HEAD = f"sha256(encode(rep_text)[1:{SMALL_PROBE}])"


@query(INO + f" SELECT rep_path, size, {HEAD} AS cached_hash FROM candidates WHERE {CACHED}")
def cache_hits(spark, sf):
    return cache.lookup(_requests(spark, sf), _old_cache(spark, sf)).where("cached_hash is not null").select("rep_path", "size", "cached_hash")


@query(INO + f" SELECT rep_path, size FROM candidates WHERE NOT ({CACHED})")
def cache_misses(spark, sf):
    return cache.lookup(_requests(spark, sf), _old_cache(spark, sf)).where("cached_hash is null").select("rep_path", "size")


@query(INO + f" SELECT rep_path AS path, size AS file_size, ino, rep_mtime_ns AS mtime_ns, CAST(0 AS BIGINT) AS start, CAST(least(size, {SMALL_PROBE}) AS BIGINT) AS len, {HEAD} AS hash FROM candidates")
def cache_rewrite(spark, sf):
    asked = cache.lookup(_requests(spark, sf), _old_cache(spark, sf))
    done = verify.table_hasher(contents(spark, sf), SMALL_PROBE, SMALL_CHUNK)(asked.withColumn("stage", F.lit(0).cast("long")), 0)
    used = done.select(F.col("rep_path").alias("path"), F.col("size").alias("file_size"), "ino", F.col("rep_mtime_ns").alias("mtime_ns"), "start", "len", F.unhex(F.coalesce("cached_hash", "hash")).alias("hash"))
    return cache.rewritten(used).select("path", "file_size", "ino", "mtime_ns", "start", "len", F.lower(F.hex("hash")).alias("hash"))


@query(ACTIONS + ", fresh AS (SELECT DISTINCT path, CASE WHEN ino % 4 = 0 THEN mtime_ns + 1 ELSE mtime_ns END AS mtime_now FROM listing WHERE ino % 9 <> 0) SELECT a.source, a.target, a.mtime_ns, coalesce(f.mtime_now, -1) AS mtime_now FROM actions a LEFT JOIN fresh f ON a.target = f.path WHERE f.mtime_now IS DISTINCT FROM a.mtime_ns")
def stale_targets(spark, sf):
    now = listing(spark, sf).where("ino % 9 <> 0").withColumn("mtime_ns", F.col("mtime_ns") + F.when(F.col("ino") % 4 == 0, 1).otherwise(0))
    return plan.stale(actions(spark, sf), now).withColumn("mtime_now", F.coalesce("mtime_now", F.lit(-1).cast("long")))


@query("SELECT doc_id, replace(replace(replace(text, chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r') AS escaped FROM documents", base=False)
def escaped_paths(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", escape_path(F.col("text")).alias("escaped"))


@query(""", n AS (SELECT ino, size * (CASE ino % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 1000000000 END) AS n FROM base),
e AS (SELECT ino, n, CASE WHEN n >= 1::BIGINT << 60 THEN 6 WHEN n >= 1::BIGINT << 50 THEN 5 WHEN n >= 1::BIGINT << 40 THEN 4 WHEN n >= 1::BIGINT << 30 THEN 3 WHEN n >= 1::BIGINT << 20 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS e FROM n),
v AS (SELECT *, floor(CAST(n AS DOUBLE) / pow(1024.0, e) * 10 + 0.5) / 10 AS v FROM e)
SELECT ino, CAST(n AS BIGINT) AS n, CASE WHEN n < 10 THEN n || ' B' WHEN v < 10 THEN format('{:.1f} {}', v, (['B', 'KiB', 'MiB', 'GiB', 'TiB', 'PiB', 'EiB'])[e + 1]) ELSE format('{:.0f} {}', v, (['B', 'KiB', 'MiB', 'GiB', 'TiB', 'PiB', 'EiB'])[e + 1]) END AS shown FROM v""")
def formatted_bytes(spark, sf):
    n = F.col("size") * F.when(F.col("ino") % 4 == 0, F.lit(1)).when(F.col("ino") % 4 == 1, 1000).when(F.col("ino") % 4 == 2, 1_000_000).otherwise(1_000_000_000).cast("long")
    return _bag(spark, sf).where("root_idx = 0").select("ino", n.alias("n")).select("ino", "n", format_bytes(F.col("n")).alias("shown"))


@query(ACTIONS + " SELECT target, CASE WHEN action = 'hardlink' THEN 'Replaced ' || target || ' with hardlink to ' || source WHEN ends_with(target, '2.txt') THEN 'skipped ' || target || ': file in use' ELSE 'Replaced ' || target || ' with symlink to ' || source END AS message FROM actions")
def action_messages(spark, sf):
    busy = (F.col("action") == SYMLINK) & F.endswith(F.col("target"), F.lit("2.txt"))
    done = F.when(busy, SKIPPED).otherwise(F.col("action"))
    return actions(spark, sf).select("target", message(done, F.col("source"), F.col("target"), F.when(busy, "file in use")).alias("message"))


@query("WITH e AS (SELECT event_id, coalesce(props, '') AS props FROM events) SELECT CAST(strlen(props) AS BIGINT) AS size, sha256(props) AS hash, count(*) AS n_inodes, min(event_id) AS first_id FROM e GROUP BY ALL HAVING count(*) >= 2", base=False)
def dup_props(spark, sf):
    """Values that repeat very often: only counts are shuffled."""
    props = F.coalesce(F.col("props"), F.lit(""))
    return spark.read.parquet(f"{sf}/events.parquet").groupBy(F.octet_length(props).cast("long").alias("size"), F.sha2(props, 256).alias("hash")).agg(F.count("*").alias("n_inodes"), F.min("event_id").alias("first_id")).where("n_inodes >= 2")


@query("WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages) SELECT CAST(strlen(html) AS BIGINT) AS size, sha256(html) AS hash, count(*) AS n_inodes, min(page_id) AS first_id FROM p GROUP BY ALL HAVING count(*) >= 2", base=False)
def empty_result(spark, sf):
    html = F.coalesce(F.col("html"), F.lit(""))
    return spark.read.parquet(f"{sf}/pages.parquet").groupBy(F.octet_length(html).cast("long").alias("size"), F.sha2(html, 256).alias("hash")).agg(F.count("*").alias("n_inodes"), F.min("page_id").alias("first_id")).where("n_inodes >= 2")


def _shared(a: str, b: str) -> str:
    return f"(SELECT max(k) FROM unnest(range(0, least(len({a}), len({b}) - 1) + 1)) AS t(k) WHERE {a}[1:k] = {b}[1:k])"


@query(ACTIONS + f""", p AS (SELECT source, target, string_split(target, '/')[2:-2] AS here, string_split(source, '/')[2:] AS there FROM actions),
q AS (SELECT *, {_shared('here', 'there')} AS shared FROM p)
SELECT source, target, repeat('../', len(here) - shared) || array_to_string(there[shared + 1:], '/') AS link FROM q""")
def relative_symlink(spark, sf):
    return actions(spark, sf).select("source", "target", relative_path(F.col("source"), F.col("target")).alias("link"))


TREE = """, d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
tree AS (SELECT source || '/' || doc_id || CASE WHEN doc_id % 10 = 0 THEN '.bak' ELSE '.txt' END AS path, CAST(strlen(text) AS BIGINT) AS size, text FROM d)"""


def written_tree(spark: SparkSession, sf: str, apart: bool = False) -> str:
    """All documents as files under the shared folder (or the warehouse, if only that is mounted), each written by the task that reads it. A
    document without a path is no file. Documents of one path are one file unless they are kept apart: then each lies, its source as
    as_folders has it, below a folder for its task and how often that has had its path before."""
    import os
    import uuid
    from collections import Counter
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark import TaskContext

    shared = (verify.shared_folder(spark), spark.conf.get("spark.sql.warehouse.dir"))
    folder = next(filter(None, (verify.mounted(spark, f) for f in shared)), None)
    if folder is None:
        raise RuntimeError(f"no folder to write files to: none of {', '.join(shared)} is on a mounted file system")
    root = f"{folder}/tree-{uuid.uuid4().hex}"
    kind = F.when(F.col("doc_id") % 10 == 0, ".bak").otherwise(".txt")
    name = F.concat(F.col("doc_id").cast("string"), kind)
    named = spark.read.parquet(f"{sf}/documents.parquet").select("source", name.alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content")).where("source is not null and name is not null")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, had = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for source, name, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                path = f"{source}/{name}"
                if apart:
                    had[path] += 1
                    path = f"{task}-{had[path]}/{as_folders(source)}/{name}"
                at = f"{root}/{path}"
                os.makedirs(os.path.dirname(at), exist_ok=True)
                own = f"{at}.{uuid.uuid4().hex}"
                with open(own, "wb") as file:
                    file.write(content)
                os.replace(own, at)  # a task that is run again puts the same file there
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    named.mapInArrow(write, "n long").agg(F.sum("n")).first()
    return root


@query(TREE.replace(", d AS", "d AS", 1) + " SELECT path, size, CAST(1 AS BIGINT) AS nlink FROM tree WHERE NOT ends_with(path, '.bak')", base=None)
def files_source(spark, sf):
    """Lists a tree of files that holds all documents."""
    from ..sources.files import scan

    root = written_tree(spark, sf, apart=True)
    rows = scan(spark, [root], 0, ("*.bak",)).where("error is null")
    below = F.regexp_extract(F.substring("path", len(root) + 2, 1 << 20), "(?s)^[^/]*/(.*)/[^/]*$", 1)
    return rows.select(F.concat(from_folders(below), F.lit("/"), basename(F.col("path"))).alias("path"), "size", "nlink")


@query(TREE.replace(", d AS", "d AS", 1) + " SELECT min(path) OVER (PARTITION BY size, text) AS source, path AS target, 'hardlink' AS action, size AS bytes_saved FROM tree WHERE size > 0 QUALIFY path > min(path) OVER (PARTITION BY size, text)", base=None)
def apply_links(spark, sf):
    """The whole engine on a tree of files that holds all documents: copies become links, of which the report is returned."""
    from ..model import DedupeOptions
    from .engine import Engine

    root = written_tree(spark, sf)
    done: list[tuple] = []
    Engine(spark, DedupeOptions(dry_run=False)).run([root], act=True, on_result=lambda r: done.append((r.source[len(root) + 1 :], r.target[len(root) + 1 :], r.action, r.bytes_saved)))
    return spark.createDataFrame(done, "source string, target string, action string, bytes_saved long")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The sets of equal documents, by their smallest path."""
    return verify_onepass(spark, sf).orderBy("first_path")


