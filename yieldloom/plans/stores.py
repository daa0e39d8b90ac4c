"""Registered queries of what changes a store: elections, uploads, references, retention, streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from yieldloom.functions import records
from yieldloom.operators import archive, cross, deltas, election, facts, qr, retention, star
from yieldloom.plans import bindings as b
from yieldloom.plans.registry import big, n, query
from yieldloom.sources import sinks
from yieldloom.streaming import streams

_W = f"WITH {b.PLOG}, {b.WINNERS}"
_RANK = "row_number() OVER (PARTITION BY line, dedup_key ORDER BY dedup_time, created_at, id)"


def _winners(spark, d):
    return election.elect_winners(b.plog(spark, d))


# ---------------------------------------------------------------- elections and uploads


@query(f"{_W} SELECT id, line, status FROM winners WHERE dedup_key IS NOT NULL")
def winner_rows(spark, d):
    """Full rows of winners that are known by candidate_id only."""
    known = _winners(spark, d).where(~election.blank()).select(F.col("id").alias("candidate_id"))
    return election.winner_rows(known, b.plog(spark, d)).select("id", "line", "status")


@query(f"WITH {b.PLOG} SELECT id, line, file_name FROM plog WHERE file_name NOT IN ('F1', 'F2') OR id % 2 = 0")
def active_candidates(spark, d):
    """Rows of the job that counts for their file: two files have a job that was replaced."""
    log = b.plog(spark, d).withColumn("job_id", F.expr("CASE WHEN file_name IN ('F1', 'F2') AND id % 2 = 1 THEN 'OLD' ELSE job_id END"))
    return election.active_candidates(log, b.heads(spark, d)).select("id", "line", "file_name")


@query(f"""WITH {b.PLOG}, o AS (SELECT * FROM plog WHERE file_name <> 'F7' AND dedup_key IS NOT NULL), w AS (SELECT * FROM (SELECT *, {_RANK} AS r FROM o) WHERE r = 1),
u AS (SELECT id, line, dedup_key, dedup_time, machine, 0 AS turn FROM w UNION ALL SELECT id, line, dedup_key, dedup_time, machine, 1 FROM plog WHERE file_name = 'F7' AND dedup_key IS NOT NULL),
m AS (SELECT id, line, dedup_key, row_number() OVER p AS r, coalesce(first_value(nullif(machine, '') IGNORE NULLS) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), machine) AS machine FROM u WINDOW p AS (PARTITION BY line, dedup_key ORDER BY dedup_time, turn, id))
SELECT id, line, dedup_key, machine FROM m WHERE r = 1 UNION ALL SELECT id, line, dedup_key, machine FROM plog WHERE dedup_key IS NULL""")
def merge_batches(spark, d):
    log = b.plog(spark, d)
    old, new = election.elect_winners(log.where("file_name <> 'F7'")), log.where("file_name = 'F7'")
    return election.merge_batches(old, new, unknown="").select("id", "line", "dedup_key", "machine")


@query(f"""{_W}, a AS (SELECT line, dedup_key, dedup_time FROM winners WHERE dedup_key IS NOT NULL)
SELECT p.id, a.dedup_time AS archived_time FROM plog p JOIN a ON a.line = p.line AND a.dedup_key = p.dedup_key WHERE p.dedup_time - 86400000 * (p.id % 9) < a.dedup_time""")
def earlier_than_archive(spark, d):
    """Late rows, set back by up to eight days, that are earlier than the archived row of their key."""
    late = b.plog(spark, d).withColumn("dedup_time", F.expr("dedup_time - 86400000 * (id % 9)"))
    return election.earlier_than_archive(late, _winners(spark, d).where(~election.blank())).select("id", "archived_time")


@query(f"WITH {b.PLOG} SELECT id, report_date FROM plog WHERE report_date < '2024-01-12'")
def before_cutoff(spark, d):
    return election.before_cutoff(b.plog(spark, d), "2024-01-12").select("id", "report_date")


_PARTS = "SELECT 'J' || o_custkey % 40 AS job_id, 'DAF' AS line, o_orderkey % 6 AS part, o_orderstatus AS hash, o_orderkey % 2 AS n_rows FROM orders"


def _parts(spark, d):
    """Parts of uploads: job 7 lacks its last part, job 9 its first."""
    rows = b.table(spark, d, "orders").select(F.expr("concat('J', o_custkey % 40)").alias("job_id"), F.lit("DAF").alias("line"), F.expr("o_orderkey % 6").alias("part"), F.col("o_orderstatus").alias("hash"), F.expr("o_orderkey % 2").alias("n_rows"))
    return rows.where("not (job_id = 'J7' and part = 5) and not (job_id = 'J9' and part = 0)")


def _ledger(spark, d):
    jobs = b.table(spark, d, "orders").select(F.expr("concat('J', o_custkey % 40)").alias("job_id"), F.lit("DAF").alias("line")).distinct()
    return jobs.withColumn("expected", F.lit(6)).unionByName(jobs.select(F.concat("job_id", F.lit("-empty")).alias("job_id"), "line", F.lit(0).alias("expected")))


_PART_SQL = f"""p AS (SELECT * FROM ({_PARTS}) WHERE NOT (job_id = 'J7' AND part = 5) AND NOT (job_id = 'J9' AND part = 0)),
j AS (SELECT DISTINCT 'J' || o_custkey % 40 AS job_id, 'DAF' AS line FROM orders), l AS (SELECT job_id, line, 6 AS expected FROM j UNION ALL SELECT job_id || '-empty', line, 0 FROM j)"""


@query(f"WITH {_PART_SQL}, g AS (SELECT job_id, count(DISTINCT part) AS k FROM p GROUP BY 1) SELECT l.job_id, l.line, expected = 0 OR coalesce(k, 0) = 6 AS complete FROM l LEFT JOIN g ON g.job_id = l.job_id")
def chunks_complete(spark, d):
    return election.chunks_complete(_parts(spark, d), _ledger(spark, d)).select("job_id", "line", F.coalesce("complete", F.lit(False)).alias("complete"))


@query(f"WITH {_PART_SQL}, g AS (SELECT job_id, count(DISTINCT part) AS k FROM p GROUP BY 1) SELECT l.job_id, l.line, coalesce(k, 0) AS received, expected FROM l LEFT JOIN g ON g.job_id = l.job_id")
def upload_status(spark, d):
    return election.upload_status(_ledger(spark, d), _parts(spark, d))


@query(f"""WITH {_PART_SQL}, s AS (SELECT job_id, line, part, min(hash) AS hash, min(n_rows) AS n_rows FROM p GROUP BY ALL), a AS (SELECT job_id, line, part, CASE WHEN part = 2 THEN '?' ELSE hash END AS hash, n_rows FROM s)
SELECT 'new' AS kind, j.job_id, j.line, CAST(9 AS BIGINT) AS part FROM j UNION ALL SELECT 'contradicts', job_id, line, part FROM a WHERE part = 2""")
def chunk_replay(spark, d):
    """Parts that arrive again: those of number 2 with other content, and a new one of each job, twice."""
    stored = _parts(spark, d).groupBy("job_id", "line", "part").agg(F.min("hash").alias("hash"), F.min("n_rows").alias("n_rows"))
    again = stored.withColumn("hash", F.expr("if(part = 2, '?', hash)"))
    fresh = stored.select("job_id", "line").distinct().select("*", F.lit(9).cast("long").alias("part"), F.lit("h").alias("hash"), F.lit(1).cast("long").alias("n_rows"))
    new, odd = election.chunk_replay(stored, again.unionByName(fresh).unionByName(fresh))
    return new.select(F.lit("new").alias("kind"), "job_id", "line", "part").unionByName(odd.select(F.lit("contradicts").alias("kind"), "job_id", "line", "part"))


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0 AND (CAST(o_orderdate AS DATE), sha256(o_orderpriority)) IN (SELECT (CAST(o_orderdate AS DATE), sha256(o_orderpriority)) FROM orders WHERE o_orderkey % 3 <> 0)""")
def duplicate_uploads(spark, d):
    rows = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr("cast(o_orderdate AS date)").alias("production_date"), F.sha2("o_orderpriority", 256).alias("content_hash"))
    return election.is_duplicate_upload(rows.where("id % 3 <> 0"), rows.where("id % 3 = 0")).select("id")


@query("""WITH x AS (SELECT DISTINCT event_id % 30 AS batch_id, CAST(ts AS DATE) AS date, (event_id % 30) % 7 AS uploaded_at FROM events)
SELECT batch_id, date, uploaded_at FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY uploaded_at DESC, batch_id DESC) AS r FROM x) WHERE r = 1""")
def claim_dates(spark, d):
    rows = b.table(spark, d, "events").selectExpr("event_id % 30 AS batch_id", "cast(ts AS date) AS date", "(event_id % 30) % 7 AS uploaded_at").distinct()
    return election.claim_dates(rows)


_MEMORY = "SELECT 'FP-A' || (event_id % 9) AS code, CASE WHEN event_id % 13 = 0 THEN '' ELSE 'M' || (event_id % 9) || CASE WHEN event_id % 9 < 3 THEN '-' || (event_id % 2) ELSE '' END END AS model, event_id AS updated_at FROM events"


def _memory(spark, d):
    model = "CASE WHEN event_id % 13 = 0 THEN '' ELSE concat(' m', event_id % 9, CASE WHEN event_id % 9 < 3 THEN concat('-', event_id % 2) ELSE '' END) END"
    return b.table(spark, d, "events").select(F.expr("concat('x,fp-a', event_id % 9, ',y')").alias("code"), F.expr(model).alias("model"), F.col("event_id").alias("updated_at"))


@query(f"WITH m AS ({_MEMORY}) SELECT code, CASE WHEN code = 'FP-A5' THEN 'FIXED' ELSE arg_max(model, updated_at) END AS model FROM m WHERE model <> '' GROUP BY code")
def model_memory(spark, d):
    return election.normalise_memory(_memory(spark, d), {"FP-A5": "FIXED"})[0]


@query(f"WITH m AS ({_MEMORY}) SELECT code, count(DISTINCT model) AS models FROM m WHERE model <> '' GROUP BY code HAVING count(DISTINCT model) > 1")
def model_conflicts(spark, d):
    return election.normalise_memory(_memory(spark, d), {})[1]


@query("SELECT max(event_id) AS id, 'N' || (user_id % 50) AS key FROM events GROUP BY user_id % 50")
def unique_by_name(spark, d):
    """The last of equal names, whatever their case and outer space."""
    rows = b.table(spark, d, "events").select(F.col("event_id").alias("id"), F.expr("CASE event_id % 3 WHEN 0 THEN concat(' n', user_id % 50) WHEN 1 THEN concat('N', user_id % 50, ' ') ELSE concat('n', user_id % 50) END").alias("name"))
    return election.unique_by_name(rows, "id").select("id", F.upper(F.trim("name")).alias("key"))


@query(f"""WITH {b.PLOG}, f AS (SELECT line, count(*) AS accepted FROM (SELECT *, {_RANK} AS r FROM plog) WHERE file_name = 'F7' AND (dedup_key IS NULL OR r = 1) GROUP BY line),
w AS (SELECT line, dedup_key FROM plog WHERE file_name <> 'F7' AND dedup_key IS NOT NULL), g AS (SELECT line, count(*) AS duplicates FROM plog WHERE file_name = 'F7' AND (line, dedup_key) IN (SELECT (line, dedup_key) FROM w) GROUP BY line)
SELECT coalesce(f.line, g.line) AS line, coalesce(accepted, 0) AS accepted, coalesce(duplicates, 0) AS duplicates FROM f FULL JOIN g ON f.line = g.line""")
def publish_counts(spark, d):
    """Rows accepted of file F7, and its rows whose key wins in another file."""
    log, heads = b.plog(spark, d), b.heads(spark, d)
    others, own = log.where("file_name <> 'F7'"), log.where("file_name = 'F7'")
    return election.publish(election.elect_winners(others), others, heads.where("file_name <> 'F7'"), own, heads.where("file_name = 'F7'"))[2]


@query(f"""WITH {b.PLOG}, o AS (SELECT * FROM plog WHERE NOT (file_name = 'F7' AND line = 'FT1')) SELECT id, line, file_name FROM o WHERE dedup_key IS NULL
UNION ALL SELECT id, line, file_name FROM (SELECT *, {_RANK} AS r FROM o WHERE dedup_key IS NOT NULL) WHERE r = 1""")
def delete_one_file(spark, d):
    log, heads = b.plog(spark, d), b.heads(spark, d)
    return election.delete_file(election.elect_winners(log), log, heads, "FT1", "F7")[0].select("id", "line", "file_name")


_DAY = "2024-01-10"
#: State after a compaction at _DAY without file F7, and an upload of F7's later rows over it.
_OVER = f"""WITH {b.PLOG}, others AS (SELECT * FROM plog WHERE file_name <> 'F7'), inc AS (SELECT * FROM plog WHERE file_name = 'F7' AND report_date >= '{_DAY}'),
w0 AS (SELECT * FROM (SELECT *, {_RANK} AS r FROM others WHERE dedup_key IS NOT NULL) WHERE r = 1), arch AS (SELECT * FROM w0 WHERE report_date < '{_DAY}'),
pool AS (SELECT * FROM others UNION ALL SELECT * FROM inc), live AS (SELECT * FROM pool WHERE dedup_key IS NOT NULL AND (line, dedup_key) NOT IN (SELECT (line, dedup_key) FROM arch)),
now AS (SELECT * EXCLUDE (r) FROM (SELECT *, {_RANK} AS r FROM live) WHERE r = 1 UNION ALL SELECT * FROM pool WHERE dedup_key IS NULL AND report_date >= '{_DAY}'),
moved AS (SELECT * EXCLUDE (r) FROM arch UNION ALL SELECT * FROM others WHERE dedup_key IS NULL AND report_date < '{_DAY}')"""


def _compacted(spark, d):
    """Winners, candidates, heads, groups and archive after a compaction, without file F7; F7's rows and head."""
    # a store holds its candidates and its winners: they are written once, and no use parses the log or ranks it again
    log = sinks.staged(b.plog(spark, d))
    heads = sinks.staged(log.select("line", "file_name", "job_id").distinct())
    others = log.where("file_name <> 'F7'")
    winners = sinks.staged(election.elect_winners(others))
    stay, groups, keys = retention.compact(winners, facts.compact_groups(others.limit(0)), dt.date.fromisoformat(_DAY))
    state = stay, others, heads.where("file_name <> 'F7'"), sinks.staged(groups), archive.Archive.create(keys, buckets=16)
    return *state, log.where(f"file_name = 'F7' and report_date >= '{_DAY}'"), heads.where("file_name = 'F7'")


def _published(spark, d):
    stay, others, heads, groups, keys, incoming, head = _compacted(spark, d)
    return archive.publish(stay, others, heads, incoming, head, keys, groups, _DAY), others.unionByName(incoming), groups, keys


@query(f"{_OVER} SELECT id, line, file_name FROM now")
def publish_archived(spark, d):
    """File F7 is published over an archive: archived units don't win again."""
    return _published(spark, d)[0].winners.select("id", "line", "file_name")


@query(f"""{_OVER}, a AS (SELECT line, count(*) AS accepted FROM now WHERE file_name = 'F7' GROUP BY 1), u AS (SELECT * FROM w0 WHERE report_date >= '{_DAY}'),
k AS (SELECT i.line, {n("(i.line, i.dedup_key) IN (SELECT (line, dedup_key) FROM u)")} AS duplicates, {n("(i.line, i.dedup_key) IN (SELECT (line, dedup_key) FROM arch)")} AS archived_duplicates FROM inc i WHERE i.dedup_key IS NOT NULL GROUP BY 1)
SELECT coalesce(a.line, k.line) AS line, coalesce(accepted, 0) AS accepted, coalesce(duplicates, 0) AS duplicates, coalesce(archived_duplicates, 0) AS archived_duplicates FROM a FULL JOIN k ON a.line = k.line WHERE accepted > 0 OR duplicates > 0 OR archived_duplicates > 0""")
def publish_archived_counts(spark, d):
    """Rows of F7 that count, those whose unit wins in another file, and those whose unit is archived."""
    return _published(spark, d)[0].counts


@query(f"""{_OVER}, f AS (SELECT line, file_name, status, input_included FROM now UNION ALL SELECT line, file_name, status, input_included FROM moved),
h AS (SELECT DISTINCT line, file_name FROM plog)
SELECT h.line, h.file_name, count(f.line) AS row_count, {n("input_included")} AS input_count, {n("input_included AND status = 'GOOD'")} AS good_count, {n("input_included AND status = 'FAIL'")} AS fail_count
FROM h LEFT JOIN f ON f.line = h.line AND f.file_name = h.file_name GROUP BY ALL""")
def publish_archived_summaries(spark, d):
    """File summaries after that: those of touched files are made anew, from units and groups, others stay. A file none of whose
    units counts has a summary too."""
    stay, others, heads, groups, keys, incoming, head = _compacted(spark, d)
    none = F.lit(None).cast("string")
    blank_details = dict.fromkeys(("model_name", "product_code", "work_order", "report_date", "date_start", "date_end"), none)
    stored = sinks.staged(facts.refresh_summaries(facts.fact_view(stay, None, groups), heads.withColumns(blank_details).drop("job_id")))
    done = archive.publish(stay, others, heads, incoming, head, keys, groups, _DAY)
    after = done.summaries(stored, done.heads.withColumns(blank_details).drop("job_id"), groups)
    return after.select("line", "file_name", "row_count", "input_count", "good_count", "fail_count")


@query(f"""{_OVER}, left_ AS (SELECT * FROM live WHERE NOT (file_name = 'F7' AND line = 'FT1')) SELECT id, line, file_name FROM (SELECT *, {_RANK} AS r FROM left_) WHERE r = 1
UNION ALL SELECT id, line, file_name FROM now WHERE dedup_key IS NULL AND NOT (file_name = 'F7' AND line = 'FT1')""")
def delete_promotes(spark, d):
    """F7 is taken back on one line: the next earliest candidate of each freed unit that isn't archived is promoted."""
    done, candidates, groups, keys = _published(spark, d)
    return archive.delete_file(done.winners, candidates, done.heads, "FT1", "F7", keys, groups).winners.select("id", "line", "file_name")


_CONTENT = ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in facts.DIMENSIONS)
_CONTENT_LANES = ", ".join(f"CAST('0x' || substr(md5(concat_ws(chr(31), {_CONTENT})), {at}, 16) AS UBIGINT)::HUGEINT AS l{at}" for at in (1, 17))


@query(f"""{_OVER}, f AS (SELECT * FROM now WHERE NOT (file_name = 'F5' AND line = 'DAF') UNION ALL SELECT * EXCLUDE (r) FROM (SELECT *, {_RANK} AS r FROM live WHERE NOT (file_name = 'F5' AND line = 'DAF')
AND (line, dedup_key) IN (SELECT (line, dedup_key) FROM now WHERE file_name = 'F5' AND line = 'DAF')) WHERE r = 1), h AS (SELECT line, report_date, {_CONTENT_LANES} FROM f)
SELECT line, report_date, {", ".join(f"CAST(sum(l{at}) % 18446744073709551616 AS UBIGINT)::VARCHAR AS {name}" for at, name in ((1, 'low'), (17, 'high')))}, {big("count(*)")} AS quantity FROM h GROUP BY ALL""")
def digests_by_changes(spark, d):
    """Fingerprints of each line and day, carried through a publication and a deletion by their touched units alone,
    against fingerprints of everything there is afterwards."""
    stay, others, heads, groups, keys, incoming, head = _compacted(spark, d)
    stored = sinks.staged(facts.day_digests(facts.weighted(stay)))
    done = archive.publish(stay, others, heads, incoming, head, keys, groups, _DAY)
    after = sinks.staged(done.digests(stored))
    gone = archive.delete_file(done.winners, others.unionByName(incoming), done.heads, "DAF", "F5", keys)
    return gone.digests(after).withColumns({c: F.col(c).cast("string") for c in facts.LANES})


@query(f"{_W} SELECT DISTINCT line, file_name FROM plog WHERE file_name IN ('F1', 'F2', 'F3') AND (line, file_name) IN (SELECT (line, file_name) FROM winners WHERE report_date < '2024-01-03')")
def archived_files(spark, d):
    """Files that have archived rows and may not be replaced."""
    files = b.heads(spark, d).where("file_name in ('F1', 'F2', 'F3')").select("line", "file_name")
    return election.guard_archived(_winners(spark, d).where("report_date < '2024-01-03'"), files)


@query(f"WITH {b.PLOG}, f AS (SELECT unnest(['F1', 'NONE']) AS file_name) SELECT file_name, EXISTS (SELECT 1 FROM plog p WHERE p.line = 'FT1' AND p.file_name = f.file_name) AS found FROM f")
def file_exists(spark, d):
    heads = b.heads(spark, d)
    asked = spark.createDataFrame([("FT1", "F1"), ("FT1", "NONE")], "line string, file_name string")
    return election.files_exist(heads, heads.where("line = 'DAF'"), asked).select("file_name", "found")


@query(f"WITH {b.PLOG}, r AS (SELECT DISTINCT 'U' || user_id || '-9' AS dedup_key FROM plog UNION SELECT DISTINCT dedup_key FROM plog WHERE dedup_key IS NOT NULL) SELECT dedup_key FROM r WHERE dedup_key LIKE '%-9'")
def unmatched_references(spark, d):
    log = b.plog(spark, d)
    keys = log.select(F.expr("concat('U', user_id, '-9')").alias("dedup_key")).union(log.where(~election.blank()).select("dedup_key")).distinct()
    return election.unmatched_references(keys, log)


_NEWEST = "u AS (SELECT DISTINCT ON (line, file_name) * FROM plog ORDER BY line, file_name, created_at DESC, id DESC), i AS (SELECT unnest([0, 1]) AS o)"


@query(f"""WITH {b.PLOG}, {_NEWEST} SELECT u.line, u.file_name, u.created_at, md5(u.file_name) AS job_id, i.o AS row_id, CASE i.o WHEN 0 THEN u.id ELSE u.id + 1000000 END AS id FROM u, i""")
def backfill(spark, d):
    """Every row is an upload of its file with two records; the newest upload of each file counts."""
    log = b.plog(spark, d)
    batches = log.select("id", "line", "file_name", F.col("created_at").alias("uploaded_at"), F.expr("concat('[{\"id\":', id, '},{\"id\":', id + 1000000, '}]')").alias("records"))
    return election.backfill(batches, "id long", ["id"])


@query(f"""WITH {b.PLOG}, {_NEWEST}, r AS (SELECT u.line, u.file_name, created_at, id + o * 1000000 AS id, CASE WHEN u.id % 3 <> 0 THEN 'K' || (u.id % 9) END AS dedup_key, u.id % 7 AS dedup_time FROM u, i)
SELECT line, file_name, id FROM r WHERE dedup_key IS NULL UNION ALL SELECT line, file_name, id FROM (SELECT *, {_RANK} AS k FROM r WHERE dedup_key IS NOT NULL) WHERE k = 1""")
def backfill_winners(spark, d):
    """Units of stored uploads stand for election as they are filled in: winners over all files."""
    def record(k):
        return F.struct((F.col("id") + k).alias("id"), F.expr("CASE WHEN id % 3 <> 0 THEN concat('K', id % 9) END").alias("dedup_key"), F.expr("id % 7").alias("dedup_time"))

    batches = b.plog(spark, d).select("id", "line", "file_name", F.col("created_at").alias("uploaded_at"), F.to_json(F.array(record(0), record(1_000_000))).alias("records"))
    candidates, heads, winners = election.backfill_winners(batches, "id long, dedup_key string, dedup_time long", ["id"])
    return election.active_candidates(winners, heads).select("line", "file_name", "id")


# ---------------------------------------------------------------- facts over stores


@query(f"{_W} SELECT id, line, file_name, status, work_order FROM winners")
def attach_group(spark, d):
    """Each winner finds the group of its dimensions: the group is named by its content."""
    winners = _winners(spark, d)
    groups = facts.compact_groups(winners).withColumn("group_id", F.concat_ws("|", "line", "file_name", "status", "work_order"))
    found = facts.attach_group(winners, groups)
    same = F.col("group_id") == F.concat_ws("|", "line", "file_name", "status", "work_order")
    return found.where(same).select("id", "line", "file_name", "status", "work_order")


@query(f"""{_W}, c AS (SELECT line, report_date, {n("input_included")} AS input, {n("status = 'FAIL'")} AS defects FROM plog GROUP BY ALL) SELECT * FROM c""")
def merge_summaries(spark, d):
    """Day sums of two stores added up."""
    log = b.plog(spark, d)
    parts = [log.where(f"id % 2 = {k}").groupBy("line", "report_date").agg(F.count_if("input_included").alias("input"), F.count_if(F.expr("status = 'FAIL'")).alias("defects")) for k in range(2)]
    return facts.merge_summaries(parts, ["line", "report_date"])


_SUM = f"""s AS (SELECT line, file_name, min(report_date) AS date_start, max(report_date) AS date_end, array_to_string(list_sort(list(DISTINCT model_name)), '、') AS model_name, array_to_string(list_sort(list(DISTINCT work_order)), '、') AS work_order,
{n("input_included AND status = 'GOOD'")} AS good, {n("input_included AND status = 'FAIL'")} AS fail, {n("status NOT IN ('GOOD', 'FAIL')")} AS odd FROM winners GROUP BY ALL)"""


def _summaries(spark, d):
    none = F.lit(None).cast("string")
    heads = b.heads(spark, d).withColumns({c: none for c in ("model_name", "product_code", "work_order", "report_date", "date_start", "date_end")})
    return facts.refresh_summaries(facts.fact_view(_winners(spark, d)), heads.drop("job_id"))


@query(f"""{_W}, {_SUM}, u AS (SELECT *, 'GOOD' AS status, good AS quantity, true AS input_included FROM s UNION ALL SELECT *, 'FAIL', fail, true FROM s UNION ALL SELECT *, 'UNKNOWN', odd, false FROM s)
SELECT line, file_name, model_name, work_order, '2024-01-15' AS report_date, status, quantity, input_included FROM u WHERE quantity > 0 AND date_start <= '2024-01-15' AND date_end >= '2024-01-15'""")
def summary_day(spark, d):
    return facts.summary_day(_summaries(spark, d), "2024-01-15")


_ROW = "md5(concat_ws(chr(31), file_name, line, quantity, status))"
_SUMMED = " || '-' || ".join(f"lpad(to_hex(CAST(sum(CAST('0x' || substr({_ROW}, {at}, 16) AS UBIGINT)::HUGEINT) % 18446744073709551616 AS UBIGINT)), 16, '0')" for at in (1, 17))


@query(f"""{_W}, s AS (SELECT line, file_name, status, CAST(count(*) AS VARCHAR) AS quantity FROM winners GROUP BY ALL)
SELECT line, {big("count(*)")} AS rows, {_SUMMED} AS version FROM s GROUP BY line""")
def line_versions(spark, d):
    summaries = _winners(spark, d).groupBy("line", "file_name", "status").agg(F.count(F.lit(1)).alias("quantity"))
    return facts.per_line(spark, facts.line_versions(summaries), {"rows": 0, "version": ""})


@query(f"WITH {b.PLOG} SELECT DISTINCT report_date FROM plog WHERE file_name IN ('F1', 'F9')")
def affected_days(spark, d):
    log = b.plog(spark, d)
    return facts.affected(log.where("file_name = 'F1'"), log.where("file_name = 'F9'"))


@query(f"WITH {b.PLOG} SELECT id FROM plog WHERE id % 3 = 0 AND file_name = 'F1'")
def removed_ids(spark, d):
    log = b.plog(spark, d)
    return facts.removed_ids(log, log.where("not (id % 3 = 0 and file_name = 'F1')"))


@query(f"WITH {b.PLOG} SELECT DISTINCT machine FROM plog WHERE machine <> ''")
def label_union(spark, d):
    log = b.plog(spark, d)
    return facts.label_union([log.where("line = 'DAF'"), log.where("line <> 'DAF'")], "machine")


@query(f"WITH {b.PLOG} SELECT id, status, 'first' AS only_in FROM plog WHERE id % 50 = 0 UNION ALL SELECT id, 'X', 'second' FROM plog WHERE id % 50 = 0")
def assert_same(spark, d):
    """Rows that only one of two tables has: every fiftieth has another status."""
    log = b.plog(spark, d).select("id", "status")
    return records.assert_same(log, log.withColumn("status", F.expr("if(id % 50 = 0, 'X', status)")))


@query(f"WITH {b.PLOG}, u AS (SELECT user_id, max(id) AS a, min(id) AS z FROM plog GROUP BY 1) SELECT user_id, CASE WHEN user_id % 2 = 0 THEN a ELSE z END AS id FROM u")
def merge_maps(spark, d):
    log = b.plog(spark, d)
    primary = log.where("user_id % 2 = 0").groupBy("user_id").agg(F.max("id").alias("id"))
    return records.merge_maps(primary, log.groupBy("user_id").agg(F.min("id").alias("id")), "user_id", "id")


@query(f"""WITH {b.PLOG} SELECT 'P' || (id % 7) AS product_code, {big("count(*)")} AS rows, 'P' || (id % 7) AS sample, array_to_string(list_sort(list(DISTINCT work_order)), ',') AS work_orders FROM plog WHERE id % 7 > 4 GROUP BY id % 7""")
def unknown_products(spark, d):
    """Codes 5 and 6 have no known model."""
    units = b.plog(spark, d).withColumns({"product_code": F.expr("concat('P', id % 7)"), "model_name": F.expr("CASE WHEN id % 7 > 4 THEN '未識別機種' ELSE model_name END")})
    return facts.unknown_products(units).withColumn("work_orders", F.array_join("work_orders", ","))


@query(f"WITH {b.PLOG} SELECT product_code AS code, arg_min(model_name, id) AS model FROM plog WHERE product_code <> 'P1' GROUP BY 1")
def learn_mappings(spark, d):
    log = b.plog(spark, d)
    return facts.learn_mappings(log, log.where("product_code = 'P1'").select(F.col("product_code").alias("code")).distinct())


@query(f"WITH {b.PLOG} SELECT id, CASE product_code WHEN 'P1' THEN 'LEARNED' WHEN 'P2' THEN 'TK14-Goodix' ELSE '未識別機種' END AS model_name FROM plog")
def resolve_model(spark, d):
    log = b.plog(spark, d).select("id", F.expr("CASE WHEN product_code = 'P2' THEN 'FP-D01607MB11' ELSE product_code END").alias("product_code"))
    memory = log.where("product_code = 'P1'").select(F.col("product_code").alias("code"), F.lit("LEARNED").alias("model")).distinct()
    return facts.resolve_model(log, memory).select("id", "model_name")


@query(f"WITH {b.PLOG} SELECT id, CASE WHEN id % 5 = 2 THEN NULL WHEN id % 5 IN (0, 1) THEN 'MODEL-' || (id % 5) END AS model, id % 5 = 2 AS conflict FROM plog")
def match_rules(spark, d):
    """Rules from a table: one contains, one is exact, two disagree on one text (one of them a single character)."""
    rows = b.plog(spark, d).select("id", F.expr("concat('vendor，abc-', id % 5, ' rev')").alias("product_text"))
    kinds = rows.select(F.expr("id % 5").alias("k")).distinct().where("k < 3")
    rules = kinds.select(F.concat(F.lit("r"), "k").alias("id"), F.expr("if(k = 1, 'exact', 'contains')").alias("match_type"), F.expr("if(k = 1, ' vendor,ABC-1  rev', concat('abc-', k))").alias("match_text"), F.expr("concat('model-', k)").alias("model"))
    other = kinds.where("k = 2").select(F.lit("x").alias("id"), F.lit("contains").alias("match_type"), F.lit("2").alias("match_text"), F.lit("model-x").alias("model"))
    return facts.match_rules(rows, facts.upsert_rules(rules.unionByName(other)))


@query(f"WITH {b.PLOG} SELECT DISTINCT work_order AS name FROM plog WHERE work_order NOT IN ('WO1', 'WO2')")
def new_members(spark, d):
    log = b.plog(spark, d)
    known = log.where("work_order in ('WO1', 'WO2')").select(F.lower("work_order").alias("name")).distinct()
    return facts.new_members(log, known, "work_order")


# ---------------------------------------------------------------- retention


@query(f"""{_W}, r AS (SELECT line, CAST(report_date AS DATE) AS day, dense_rank() OVER (PARTITION BY line ORDER BY report_date DESC) AS k FROM winners WHERE report_date <= '2024-01-25'),
c AS (SELECT min(day) AS cutoff FROM r WHERE k = 7) SELECT greatest(cutoff, DATE '2024-01-02') AS late, greatest(cutoff, DATE '2024-01-24') AS kept FROM c""")
def advance_watermark(spark, d):
    """The cutoff never goes back: once from an older stored one, once from a newer one."""
    days, today = facts.producing_dates(_winners(spark, d)), dt.date(2024, 1, 25)
    stored = spark.createDataFrame([("late", dt.date(2024, 1, 2)), ("kept", dt.date(2024, 1, 24))], "name string, cutoff date")
    moved = retention.advanced(stored, days, today=today)
    return moved.agg(*[F.max(F.when(F.col("name") == n, F.col("cutoff"))).alias(n) for n in ("late", "kept")])


@query(f"""{_W}, a AS (SELECT {', '.join(facts.DIMENSIONS)}, id FROM winners WHERE report_date < '2024-01-10') SELECT {', '.join(facts.DIMENSIONS)}, {big("sum(CASE WHEN id % 2 = 0 THEN 5 ELSE 1 END)")} AS quantity FROM a GROUP BY ALL""")
def migrate_facts(spark, d):
    """Archived rows with an odd id join the groups, which hold the others five times."""
    old = _winners(spark, d).where("report_date < '2024-01-10'")
    groups = facts.compact_groups(old.where("id % 2 = 0")).withColumn("quantity", F.col("quantity") * 5)
    return retention.migrate_facts(old.where("id % 2 = 1"), groups)


@query(f"{_W} SELECT id FROM plog WHERE id IN (SELECT id FROM winners) OR file_name NOT IN ('F1', 'F2')")
def prune_superseded(spark, d):
    log = b.plog(spark, d)
    return retention.prune_superseded(log, election.elect_winners(log), b.heads(spark, d).where("file_name not in ('F1', 'F2')")).select("id")


_JOBS = "SELECT event_id AS job_id, CASE event_id % 4 WHEN 0 THEN 'superseded' WHEN 1 THEN 'failed' WHEN 2 THEN 'published' ELSE 'staging' END AS state, ts AS updated_at FROM events"


def _jobs(spark, d):
    return b.table(spark, d, "events").selectExpr("event_id AS job_id", "CASE event_id % 4 WHEN 0 THEN 'superseded' WHEN 1 THEN 'failed' WHEN 2 THEN 'published' ELSE 'staging' END AS state", "cast(ts AS timestamp) AS updated_at")


@query(f"WITH j AS ({_JOBS}) SELECT job_id FROM j WHERE NOT (state IN ('superseded', 'failed') AND updated_at < TIMESTAMP '2024-01-16 12:00:00')")
def prune_ledger(spark, d):
    return retention.prune_ledger(_jobs(spark, d), dt.datetime(2024, 2, 15, 12, tzinfo=dt.timezone.utc)).select("job_id")


@query(f"""WITH j AS ({_JOBS}) SELECT job_id, CASE WHEN updated_at < TIMESTAMP '2024-01-15 12:00:00' THEN 'expired' WHEN updated_at >= TIMESTAMP '2024-01-16 11:45:00' THEN 'recent' ELSE 'idle' END AS activity FROM j WHERE state = 'staging'""")
def expire_uploads(spark, d):
    return retention.expire_uploads(_jobs(spark, d), dt.datetime(2024, 1, 16, 12, tzinfo=dt.timezone.utc))


_RAW = f"WITH {b.PLOG}, s AS (SELECT id, report_date BETWEEN '2024-01-05' AND '2024-01-19' AND id % 9 <> 0 AS due FROM plog)"


def _stripped(spark, d):
    log = b.plog(spark, d).withColumns({"raw": F.col("id").cast("string"), "status": F.expr("if(id % 9 = 0, NULL, status)")})
    return log, retention.strip_raw(log, "2024-01-20", "2024-01-05")


@query(f"{_RAW} SELECT id, CASE WHEN NOT due THEN CAST(id AS VARCHAR) END AS raw FROM s")
def strip_raw(spark, d):
    """Payloads of days that are old but not archived go, where the columns can rebuild them."""
    return _stripped(spark, d)[1].select("id", "raw")


@query(f"{_RAW} SELECT count(*) AS rows, count(*) AS with_raw, {n('due')} AS to_strip FROM s")
def preview_strip(spark, d):
    return retention.preview_strip(*_stripped(spark, d))


@query(f"""{_W}, r AS (SELECT dedup_key, CASE WHEN count(DISTINCT machine) = 1 THEN min(machine) END AS m FROM plog WHERE id % 3 = 0 AND machine <> '' AND dedup_key IS NOT NULL GROUP BY 1)
SELECT w.id, r.m IS NOT NULL AND r.m <> w.machine AS changed, coalesce(r.m, w.machine) AS machine FROM winners w LEFT JOIN r ON r.dedup_key = w.dedup_key WHERE w.dedup_key IS NOT NULL""")
def repoint_keys(spark, d):
    log = b.plog(spark, d)
    refs = election.machine_references(log.where("id % 3 = 0 and machine <> ''"))
    keys = election.elect_winners(log).where(~election.blank()).select("id", "dedup_key", "machine")
    return retention.repoint_keys(keys, refs).select("id", "changed", "machine")


@query(f"""{_W}, r AS (SELECT line, CAST(report_date AS DATE) AS day, dense_rank() OVER (PARTITION BY line ORDER BY report_date DESC) AS k FROM winners WHERE report_date <= '2024-01-25'), c AS (SELECT CAST(min(day) AS VARCHAR) AS cutoff FROM r WHERE k = 7)
SELECT 'units' AS store, {n("report_date >= cutoff")} AS quantity FROM winners, c UNION ALL SELECT 'groups', {n("report_date < cutoff")} FROM winners, c UNION ALL SELECT 'keys', {n("report_date < cutoff AND dedup_key IS NOT NULL")} FROM winners, c UNION ALL SELECT 'candidates', count(*) FROM plog""")
def run_maintenance(spark, d):
    """One maintenance run: what is left as units, moved into groups, archived as keys, kept as candidates."""
    log = b.plog(spark, d)
    winners = election.elect_winners(log)
    keys = archive.Archive.create(winners.limit(0), buckets=16)
    done = retention.run_maintenance(winners, log, b.heads(spark, d), facts.compact_groups(winners.limit(0)), None, dt.date(2024, 1, 25), keys)
    groups = done["groups"].agg(F.lit("groups").alias("store"), F.coalesce(F.sum("quantity"), F.lit(0)).alias("quantity"))
    rows = {"units": done["winners"], "keys": done["keys"], "candidates": done["candidates"]}
    for name, df in rows.items():
        groups = groups.unionByName(df.agg(F.lit(name).alias("store"), F.count(F.lit(1)).alias("quantity")))
    return groups


_CUTS = ("2024-01-06", "2024-01-12")


@query(f"""{_W}, c AS (SELECT line, report_date, dedup_key, report_date < '{_CUTS[1]}' AS old FROM winners) SELECT line, 'units' AS store, {n("NOT old")} AS quantity FROM c GROUP BY line
UNION ALL SELECT line, 'groups', {n("old")} FROM c GROUP BY line UNION ALL SELECT line, 'archive', {n("old AND dedup_key IS NOT NULL")} FROM c GROUP BY line""")
def compact_twice(spark, d):
    """Two compactions at successive cutoffs, each verified before its groups come out; the archive gathers the keys of both."""
    units = sinks.staged(_winners(spark, d))
    groups, keys = facts.compact_groups(units.limit(0)), archive.Archive.create(units.limit(0), buckets=16)
    for cutoff in _CUTS:
        units, groups = retention.compact_verified(units, groups, dt.date.fromisoformat(cutoff), keys)
    sums = [df.groupBy("line").agg(F.lit(name).alias("store"), q.alias("quantity")) for name, df, q in (("units", units, F.count(F.lit(1))), ("groups", groups, F.sum("quantity")), ("archive", keys.rows(), F.count(F.lit(1))))]
    return sums[0].unionByName(sums[1]).unionByName(sums[2])


# ---------------------------------------------------------------- code scans and replacement


@query(f"WITH {b.QR}, s AS (SELECT report_date, count(DISTINCT qr_hash) AS n FROM qr GROUP BY 1) SELECT report_date, n AS daily_count FROM s WHERE n > 0")
def refresh_days(spark, d):
    """Day counts that were wrong on some days, counted anew for those."""
    entries = qr.qr_set(b.qr(spark, d))
    wrong = qr.qr_daily(entries).withColumn("daily_count", F.expr("if(day(report_date) % 5 = 0, 999, daily_count)"))
    return qr.refresh_days(wrong, entries, entries.where("day(report_date) % 5 = 0").select("report_date"))


@query(f"WITH {b.QR}, r AS (SELECT file_name, report_date, qr_hash FROM qr WHERE file_name <> 'F4' UNION SELECT 'F4', report_date + 1, qr_hash FROM qr WHERE file_name = 'F4') SELECT report_date, count(DISTINCT qr_hash) AS daily_count FROM r GROUP BY 1")
def replace_qr_file(spark, d):
    """File F4 comes again with all scans a day later."""
    entries = qr.qr_set(b.qr(spark, d))
    moved = entries.where("file_name = 'F4'").withColumn("report_date", F.date_add("report_date", 1))
    return qr.replace_qr_file(entries, qr.qr_daily(entries), "F4", moved)[1]


def _bitmaps(spark, d):
    """Code bitmaps of all files, the numbers of the codes, and the day counts."""
    entries = b.qr(spark, d)
    codes = sinks.staged(qr.number_codes(entries.select("qr_hash").limit(0).withColumn("number", F.lit(0).cast("long")), entries))
    bits = sinks.staged(qr.code_bitmaps(entries, codes))
    return entries, codes, bits, sinks.staged(qr.bitmap_daily(bits))


@query(f"WITH {b.QR}, r AS (SELECT report_date, qr_hash FROM qr WHERE file_name <> 'F4' UNION ALL SELECT report_date + 1, qr_hash FROM qr WHERE file_name = 'F4' UNION ALL SELECT report_date + 1, sha256('new' || qr_hash) FROM qr WHERE file_name = 'F4') SELECT report_date, count(DISTINCT qr_hash) AS daily_count FROM r GROUP BY 1")
def replace_qr_bitmaps(spark, d):
    """File F4 comes again with its scans a day later, and as many codes that nobody has seen: only bitmaps are read."""
    entries, codes, bits, summary = _bitmaps(spark, d)
    moved = entries.where("file_name = 'F4'").withColumn("report_date", F.date_add("report_date", 1))
    rows = moved.unionByName(moved.withColumn("qr_hash", F.sha2(F.concat(F.lit("new"), "qr_hash"), 256)))
    codes = sinks.staged(qr.number_codes(codes, rows))
    return qr.replace_bitmaps(bits, summary, ["F4"], qr.code_bitmaps(rows, codes))[1]


@query(f"WITH {b.QR} SELECT report_date, count(DISTINCT qr_hash) AS daily_count FROM qr WHERE file_name NOT IN ('F1', 'F2') GROUP BY 1")
def delete_qr_bitmaps(spark, d):
    _, _, bits, summary = _bitmaps(spark, d)
    return qr.replace_bitmaps(bits, summary, ["F1", "F2"])[1]


@query(f"WITH {b.QR} SELECT CAST(date_trunc('week', report_date) AS DATE) AS week, count(DISTINCT qr_hash) AS codes FROM qr GROUP BY 1")
def weekly_codes(spark, d):
    """Distinct codes of a week, from the bitmaps of its days."""
    return qr.bitmap_counts(_bitmaps(spark, d)[2].withColumn("week", F.trunc("report_date", "week")), ["week"], "codes")


@query(f"WITH {b.PLOG} SELECT id, CASE WHEN id % 4 = 0 THEN 'NEW' ELSE status END AS status FROM plog UNION ALL SELECT -id, 'NEW' FROM plog WHERE id % 40 = 4")
def upsert_rows(spark, d):
    """Rows of known ids replaced, others added."""
    log = b.plog(spark, d).select("id", "status")
    new = log.where("id % 4 = 0").withColumn("status", F.lit("NEW"))
    return sinks.upsert(log, new.unionByName(log.where("id % 40 = 4").select((-F.col("id")).alias("id"), F.lit("NEW").alias("status"))), ["id"])


@query(f"WITH {b.PLOG} SELECT id, file_name FROM plog WHERE file_name <> 'F3' UNION ALL SELECT id + 1000000, file_name FROM plog WHERE file_name = 'F3' AND id % 2 = 0")
def replace_file(spark, d):
    log = b.plog(spark, d).select("id", "file_name")
    return sinks.replace_file(log, "F3", log.where("file_name = 'F3' and id % 2 = 0").withColumn("id", F.col("id") + 1_000_000))


# ---------------------------------------------------------------- streams


def _log_stream(spark, d, parts=1):
    """The test log as a stream of files, written from the events once; in so many ``parts``, of which later ones hold earlier
    days too, each in micro-batches of its own, if given."""
    path = sinks.scratch_path(spark)
    log = b.plog(spark, d).select("id", "line", "dedup_key", "dedup_time", "report_date", "created_at", F.timestamp_millis("dedup_time").alias("ts"), F.col("status").alias("type"))
    for k in range(parts):
        log.where(f"pmod(-day(cast(report_date AS date)), {parts}) = {k}").write.mode("append").parquet(path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema)
    per_trigger = -(-len(spark.read.schema(schema).parquet(path).inputFiles()) // parts)
    return streams.stream_files(spark, path, schema, per_trigger=per_trigger).drop("source_file")


def _run(spark, stream, mode):
    """What a stream emits until its input is read, as a table."""
    path = sinks.scratch_path(spark)

    def write(rows, batch):
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{path}/rows")


@query(f"""WITH {b.PLOG} SELECT id, line FROM plog WHERE dedup_key IS NULL UNION ALL SELECT id, line FROM (SELECT id, line, row_number() OVER (PARTITION BY line, dedup_key ORDER BY dedup_time, id) AS r FROM plog WHERE dedup_key IS NOT NULL) WHERE r = 1""")
def stream_winners(spark, d):
    """The earliest row of each key by a stream of three micro-batches, in which earlier rows come later; a sink that keeps
    the earlier of old and new."""
    streams.use_state_store(spark)
    found = _run(spark, streams.stream_dedup(_log_stream(spark, d, parts=3)), "update")
    loose = found.where(election.blank())
    kept = found.where(~election.blank()).groupBy("line", "dedup_key").agg(F.min_by("id", F.struct("dedup_time", "id")).alias("id"))
    return loose.select("id", "line").unionByName(kept.select("id", "line"))


@query("WITH e AS (SELECT date_trunc('hour', ts) AS start, event_id % 23 = 0 AS re, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 0 AS bad FROM events) SELECT start, CASE WHEN re THEN 'RETEST' WHEN bad THEN 'FAIL' ELSE 'GOOD' END AS type, count(*) AS qty FROM e GROUP BY ALL")
def stream_counts(spark, d):
    """Events an hour, counted by a stream; each later emission of a window replaces the earlier."""
    counted = _run(spark, streams.stream_counts(_log_stream(spark, d), late="90 days"), "update")
    return counted.groupBy("start", "type").agg(F.max("qty").alias("qty")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"WITH {b.PLOG} SELECT id, CASE WHEN dedup_key LIKE 'U%1-%' THEN '1號機' ELSE '未分類機台' END AS machine FROM plog WHERE dedup_key IS NULL OR dedup_key LIKE 'U%1-%'")
def stream_machines(spark, d):
    """Log rows with the machine of their key's reference; rows that still wait are not out yet."""
    streams.use_state_store(spark)
    log = _log_stream(spark, d).select("id", "dedup_key", "ts")
    refs = _log_stream(spark, d).where("dedup_key like 'U%1-%'").select("dedup_key", F.lit("1號機").alias("machine"), "ts")
    return _run(spark, streams.stream_machine_join(log, refs), "append").select("id", F.col("machine_by_reference").alias("machine"))


@query(f"WITH {b.PLOG} SELECT line, count(*) AS n FROM plog WHERE report_date >= '2024-01-10' GROUP BY line")
def stream_publish(spark, d):
    """Files published once each by a stream, without what the late-data policy refuses."""
    path = sinks.scratch_path(spark)

    def publish(rows, batch):
        rows.where(streams.within_days(F.col("report_date"), "2024-01-10")).select("line", "id").write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    streams.stream_ingest(_log_stream(spark, d), publish, f"{path}/state").awaitTermination()
    return spark.read.schema("line string, id long").option("recursiveFileLookup", True).parquet(f"{path}/rows").groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {b.PLOG} SELECT 'line' AS kind, line AS name, 0 AS n FROM plog WHERE id % 5 <> 0 GROUP BY line UNION ALL SELECT 'removed', '', {n('id % 5 = 0')} FROM plog")
def stream_changes(spark, d):
    """A change feed: the lines that inserts touch, and the ids that deletes remove."""
    path = sinks.scratch_path(spark)

    def refresh(lines, removed, batch):
        lines.write.mode("overwrite").parquet(f"{path}/lines/batch={batch}")
        removed.write.mode("overwrite").parquet(f"{path}/removed/batch={batch}")

    changes = _log_stream(spark, d).select("id", "line", F.expr("CASE WHEN id % 5 = 0 THEN 'delete' WHEN id % 5 = 1 THEN 'update' ELSE 'insert' END").alias("op"))
    streams.stream_file_summaries(changes, refresh, f"{path}/state").awaitTermination()
    lines = spark.read.schema("line string").parquet(f"{path}/lines/batch=*").distinct().select(F.lit("line").alias("kind"), F.col("line").alias("name"), F.lit(0).cast("long").alias("n"))
    return lines.unionByName(spark.read.schema("id long").parquet(f"{path}/removed/batch=*").distinct().agg(F.lit("removed").alias("kind"), F.lit("").alias("name"), F.count(F.lit(1)).alias("n")))


_FED = "SELECT * FROM plog WHERE id % 5 <> 0 UNION ALL SELECT * REPLACE (true AS input_included, 'GOOD' AS status) FROM plog WHERE id % 10 = 5"


@query(f"""WITH {b.PLOG}, f AS ({_FED}) SELECT line, report_date, {big("count(*)")} AS rows, {n("input_included")} AS input, {n("input_included AND status = 'GOOD'")} AS good, {n("input_included AND status = 'FAIL'")} AS defects FROM f GROUP BY ALL""")
def stream_day_sums(spark, d):
    """Day sums that follow a change feed: all rows are inserted, every fifth is deleted, of which every other comes back
    corrected. Batches that come twice change nothing, before and after the deltas were folded."""
    path = sinks.scratch_path(spark)
    log = b.plog(spark, d).withColumn("op", F.lit("insert"))
    fixed = log.where("id % 10 = 5").withColumns({"op": F.lit("update_after"), "status": F.lit("GOOD"), "input_included": F.lit(True)})
    feed = [log, log.where("id % 10 = 0").withColumn("op", F.lit("delete")), log.where("id % 10 = 5").withColumn("op", F.lit("update_before")).unionByName(fixed)]
    for part in feed:
        part.write.mode("append").parquet(f"{path}/feed")
    per_trigger = -(-len(spark.read.schema(log.schema).parquet(f"{path}/feed").inputFiles()) // len(feed))
    source = streams.stream_files(spark, f"{path}/feed", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema), per_trigger=per_trigger)
    sums = deltas.DaySums(spark, f"{path}/sums")
    streams.stream_ingest(source, lambda rows, batch: sums.apply(batch, *deltas.changes(rows)), f"{path}/state").awaitTermination()
    again = [facts.weighted(part) for part in (feed[0], feed[0].limit(0))]
    sums.apply(-1, *again)
    sums.fold(0)
    sums.apply(0, *again)
    return sums.rows()


# ---------------------------------------------------------------- reports of the surface-mount line


_MADE = "p AS (SELECT l_orderkey * 8 + l_linenumber AS production_id, l_orderkey AS wo_id, CAST(l_shipdate AS DATE) AS production_date, CAST(l_quantity AS BIGINT) AS input_quantity, l_returnflag, l_linenumber FROM lineitem)"


def _made(spark, d, own="l_orderkey * 8 + l_linenumber"):
    rows = b.table(spark, d, "lineitem")
    made = rows.selectExpr(f"{own} AS id", "l_orderkey AS wo_id", "cast(l_shipdate AS date) AS production_date", "cast(l_quantity AS bigint) AS input_quantity")
    bad = rows.where("l_returnflag = 'R'").selectExpr(f"{own} AS production_id", "l_linenumber AS defect_type_id", "l_linenumber AS location_id", "cast(l_linenumber AS bigint) AS quantity")
    return made, bad


@query("""WITH p AS (SELECT max(l_orderkey * 8 + l_linenumber) AS top FROM lineitem), r AS (SELECT o_orderkey AS source_row, o_custkey AS wo_id, o_custkey % 7 + 1 AS q FROM orders)
SELECT source_row, top + row_number() OVER (ORDER BY source_row) AS production_id, wo_id, q AS input_quantity, q AS quantity FROM r, p""")
def publish_report(spark, d):
    """A report with a row for each order is published over the production: new ids follow the old ones."""
    made, bad = _made(spark, d)
    orders = b.table(spark, d, "orders")
    rows = orders.selectExpr("o_orderkey AS source_row", "o_custkey AS wo_id", "cast(o_orderdate AS date) AS production_date", "cast(o_custkey % 7 + 1 AS bigint) AS input_qty")
    own = orders.selectExpr("o_orderkey AS source_row", "1 AS defect_type_id", "1 AS location_id", "cast(o_custkey % 7 + 1 AS bigint) AS quantity")
    production, defects, manifest = star.publish_report(made, bad, rows, own)
    new = production.join(manifest, production["id"] == manifest["production_id"]).select("source_row", "production_id", "wo_id", "input_quantity")
    return new.join(defects, "production_id").select("source_row", "production_id", "wo_id", "input_quantity", "quantity")


@query(f"WITH {_MADE} SELECT 'production' AS store, count(*) AS n, {big('sum(input_quantity)')} AS qty FROM p WHERE wo_id % 3 <> 0 UNION ALL SELECT 'defects', count(*), {big('sum(l_linenumber)')} FROM p WHERE wo_id % 3 <> 0 AND l_returnflag = 'R'")
def delete_upload(spark, d):
    """An upload of every third order's rows is taken back, as nothing has changed since."""
    made, bad = _made(spark, d, b.ROW_ID)
    sums = bad.groupBy(F.col("production_id").alias("id")).agg(F.sum("quantity").alias("defect_qty"))
    manifest = made.where("wo_id % 3 = 0").join(sums, "id", "left").select(F.col("id").alias("production_id"), "input_quantity", F.coalesce("defect_qty", F.lit(0)).alias("defect_qty"))
    made, bad = star.delete_upload(made, bad, manifest)
    return made.agg(F.lit("production").alias("store"), F.count(F.lit(1)).alias("n"), F.sum("input_quantity").alias("qty")).unionByName(bad.agg(F.lit("defects").alias("store"), F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("qty")))


@query(f"WITH {b.STAR} SELECT 'two' AS part, {big('count(*)')} AS rows FROM (SELECT DISTINCT type, location FROM prod WHERE qty IS NOT NULL) UNION ALL SELECT 'trend', count(*) FROM (SELECT DISTINCT production_date, type FROM prod WHERE qty IS NOT NULL)")
def export_sections(spark, d):
    """Sections of a report written as CSV files and counted from there."""
    scan = star.scan_production(b.scan(spark, d))
    path, out = sinks.scratch_path(spark), None
    sections = {"two": cross.cross_tabs(scan, [("type", "location")]), "trend": cross.type_trend(scan)}
    sinks.export_event_sections(sections, path)
    for name in sections:
        part = spark.read.option("header", True).csv(f"{path}/{name}").agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"{_W} SELECT id FROM winners WHERE dedup_key IS NOT NULL AND report_date >= '2024-01-02'")
def accepted_upload(spark, d):
    """An upload of rows as old as the archived ones of their keys and not before the cutoff: nothing is refused."""
    archive = _winners(spark, d).where(~election.blank())
    incoming = archive.where("report_date >= '2024-01-02'")
    return election.reject_archived_dates(election.reject_earlier(incoming, archive), "2024-01-02").select("id")
