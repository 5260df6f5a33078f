"""The registered queries over the driver's tables, with equivalent DuckDB SQL."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import collections as C
from stratalog.functions import statements as ST
from stratalog.functions import vocabulary as V
from stratalog.functions.checkpoint import settle
from stratalog.operators import branching, commits, containment, history, netting, ontology, replay, services, snapshot
from stratalog.operators.branch import Repository, complete_merger
from stratalog.sources import log as logs
from stratalog.sources.oplog import WEEK_MS, read_operations
from stratalog.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SPO = ["subject", "predicate", "object"]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


# Parts of the SQL: operations, net changes and what is built on them.
_OPS = """ops AS (
  SELECT event_id AS seq, ((user_id//10)%3)::int AS branch_id,
    ((epoch_us(ts)-1704067200000000)//604800000000)::int AS commit_seq,
    ((epoch_us(ts)-1704067200000000)%604800000000) >= 302400000000 AS late,
    'http://ex/artifact/'||(user_id%10)::varchar AS subject, 'http://ex/p#'||event_type AS predicate,
    ((props->>'$.k')::int%5)::varchar AS object, 'http://www.w3.org/2001/XMLSchema#int' AS datatype,
    CASE WHEN ((props->>'$.k')::int//5)%2=0 THEN 1 ELSE -1 END AS delta
  FROM events)"""
_NET = (
    _OPS
    + """, walk1 AS (
  SELECT *, row_number() OVER w AS rn, lag(delta) OVER w AS pd, count(*) OVER (PARTITION BY branch_id, commit_seq, subject, predicate, object) AS n
  FROM ops WINDOW w AS (PARTITION BY branch_id, commit_seq, subject, predicate, object ORDER BY seq)),
walk2 AS (SELECT *, coalesce(max(CASE WHEN delta=pd THEN rn END) OVER (PARTITION BY branch_id, commit_seq, subject, predicate, object), 1) AS p FROM walk1),
net AS (SELECT branch_id, commit_seq, subject, predicate, object, max(CASE WHEN rn=p AND (n-p)%2=0 THEN delta END)::int AS net, min(seq) AS first_seq
  FROM walk2 GROUP BY ALL HAVING max(CASE WHEN rn=p AND (n-p)%2=0 THEN delta END) IS NOT NULL),
log AS (SELECT branch_id, commit_seq, 'c-'||branch_id||'-'||commit_seq AS commit_id, coalesce(lag('c-'||branch_id||'-'||commit_seq) OVER (PARTITION BY branch_id ORDER BY commit_seq), '') AS preceding_id, commit_seq::bigint*604800000 AS ts FROM (SELECT DISTINCT branch_id, commit_seq FROM net))"""
)
_SNAP = _NET + ", snap AS (SELECT branch_id, subject, predicate, object FROM (SELECT *, row_number() OVER (PARTITION BY branch_id, subject, predicate, object ORDER BY commit_seq DESC) AS r FROM net) WHERE r=1 AND net=1)"
_HIST = _SNAP + ", hist AS (SELECT branch_id, 'c-'||branch_id||'-'||commit_seq AS commit_id, commit_seq::bigint*604800000 AS ts, first_seq AS seq, CASE WHEN net>0 THEN 'ADD' ELSE 'REMOVE' END AS op, subject, predicate, object FROM net)"
_SCOPE_ROWS = [(f"http://ex/artifact/{s}", f"http://ex/p#{p}") for s, p in ((1, "click"), (1, "view"), (2, "click"), (5, "purchase"))]
_MORE_ROWS = [*_SCOPE_ROWS, ("http://ex/artifact/3", "http://ex/p#view"), ("http://ex/artifact/7", "http://ex/p#signup")]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_SCOPED = _HIST + f", scope(subject, predicate) AS (VALUES {_values(_SCOPE_ROWS)}), more(subject, predicate) AS (VALUES {_values(_MORE_ROWS)}), scoped AS (SELECT h.* FROM hist h SEMI JOIN scope s ON h.subject=s.subject AND h.predicate=s.predicate)"
_ROUTE_ROWS = [(0, 1), (1, 2), (2, 0)]
_ROUTED = _SNAP + f", routes(src, dst) AS (VALUES {_values(_ROUTE_ROWS)})"
_ORDER = "struct_pack(a := ts, b := op='REMOVE', c := seq)"


def _net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return netting.net(read_operations(spark, sf_dir))


def _hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history(_net(spark, sf_dir))


def _scope(spark: SparkSession, rows: list[tuple] = _SCOPE_ROWS) -> DataFrame:
    return spark.createDataFrame(rows, "subject string, predicate string")


def _routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_ROUTE_ROWS, "src int, dst int")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Netting and commits


@query(f"WITH {_NET} SELECT branch_id, commit_seq, subject, predicate, object, CASE WHEN net>0 THEN 'ADD' ELSE 'REMOVE' END AS op FROM net")
def net_commits(spark, sf_dir):
    return netting.with_op(_net(spark, sf_dir)).select("branch_id", "commit_seq", *_SPO, "op")


@query(f"WITH {_NET} SELECT branch_id, commit_seq, count(*) FILTER (net>0) AS n_add, count(*) FILTER (net<0) AS n_remove FROM net GROUP BY ALL")
def commit_counts(spark, sf_dir):
    return netting.counts(_net(spark, sf_dir))


@query(f"WITH {_OPS} SELECT branch_id, commit_seq, subject, predicate, object, min(seq) AS seq FROM ops WHERE delta=1 GROUP BY ALL")
def first_additions(spark, sf_dir):
    ops = read_operations(spark, sf_dir).where("delta = 1")
    return netting.first_occurrences(ops, ["branch_id", "commit_seq", *_SPO])


@query(
    f"WITH {_NET}, l AS (SELECT *, coalesce(lag(net) OVER (PARTITION BY branch_id, subject, predicate, object ORDER BY commit_seq), -1) AS b FROM net) "
    "SELECT branch_id, commit_seq, subject, predicate, object, CASE WHEN net>0 THEN 'ADD' ELSE 'REMOVE' END AS op FROM l WHERE net<>b"
)
def effective_changes(spark, sf_dir):
    return netting.with_op(netting.effective(_net(spark, sf_dir))).select("branch_id", "commit_seq", *_SPO, "op")


@query(
    f"""WITH {_OPS}, s AS (SELECT branch_id, commit_seq, subject, predicate, object, bool_or(delta=1 AND NOT late) ba, bool_or(delta=-1 AND NOT late) br, bool_or(delta=1 AND late) a, bool_or(delta=-1 AND late) r FROM ops GROUP BY ALL),
    k AS (SELECT *, ba OR a AS added, br OR r AS removed FROM s WHERE NOT ((ba OR a) AND (br OR r) AND NOT (ba AND br)))
    SELECT branch_id, commit_seq, subject, predicate, object, 'ADD' AS op FROM k WHERE added UNION ALL SELECT branch_id, commit_seq, subject, predicate, object, 'REMOVE' FROM k WHERE removed"""
)
def effectless_removal(spark, sf_dir):
    ops = read_operations(spark, sf_dir).withColumn("by_service", F.col("late"))
    return netting.without_effectless(ops).select("branch_id", "commit_seq", *_SPO, "op")


@query(f"WITH {_SNAP}, last AS (SELECT branch_id, max(commit_seq) AS commit_seq FROM net GROUP BY 1) SELECT n.branch_id, n.commit_seq, subject, predicate, object, CASE WHEN net<0 THEN 'ADD' ELSE 'REMOVE' END AS op FROM net n JOIN last USING (branch_id, commit_seq)")
def commit_undo(spark, sf_dir):
    net = _net(spark, sf_dir)
    last = net.groupBy("branch_id").agg(F.max("commit_seq").alias("commit_seq"))
    return netting.with_op(snapshot.undo(net.join(last, ["branch_id", "commit_seq"]))).select("branch_id", "commit_seq", *_SPO, "op")


@query(f"WITH {_NET} SELECT branch_id::varchar AS branch_id, commit_id, preceding_id, ts, count(*) FILTER (net>0) AS n_add, count(*) FILTER (net<0) AS n_remove FROM net JOIN log USING (branch_id, commit_seq) GROUP BY ALL")
def commit_nested(spark, sf_dir):
    nested = commits.nest(_net(spark, sf_dir))
    return nested.select("branch_id", F.col("commitId").alias("commit_id"), F.col("precedingCommitId").alias("preceding_id"), F.col("timeStamp").alias("ts"), F.size("addedStatements").cast("long").alias("n_add"), F.size("removedStatements").cast("long").alias("n_remove"))


_FLAT = f"WITH {_NET} SELECT branch_id::varchar AS branch_id, commit_id, preceding_id, ts, CASE WHEN net>0 THEN 'ADD' ELSE 'REMOVE' END AS op, (row_number() OVER (PARTITION BY branch_id, commit_seq ORDER BY net DESC, first_seq)-1)::int AS pos, subject, predicate, object FROM net JOIN log USING (branch_id, commit_seq)"
_FLAT_COLUMNS = ["branch_id", "commit_id", "preceding_id", "ts", "op", "pos", *_SPO]


@query(_FLAT)
def commit_flatten(spark, sf_dir):
    return commits.rows(_net(spark, sf_dir)).select(*_FLAT_COLUMNS)


@query(_FLAT)
def commit_json_roundtrip(spark, sf_dir):
    return commits.rejoin_rows(commits.split_rows(commits.rows(_net(spark, sf_dir)))).select(*_FLAT_COLUMNS)


@query(_FLAT)
def commit_rejoin(spark, sf_dir):
    return commits.rejoin_rows(commits.split_rows(commits.rows(_net(spark, sf_dir)), 50)).select(*_FLAT_COLUMNS)


@query(_FLAT)
def commit_nested_roundtrip(spark, sf_dir):
    """Whole commits as single JSON values, for commits that are known to be small."""
    return commits.flatten(logs.decode(logs.encode(commits.nest(_net(spark, sf_dir))))).select(*_FLAT_COLUMNS)


@query(
    f"WITH {_NET}, b AS (SELECT *, ((row_number() OVER (PARTITION BY branch_id, commit_seq ORDER BY net DESC, subject, predicate, object)-1)//50+1)::int AS batch_id, ceil(count(*) OVER (PARTITION BY branch_id, commit_seq)/50)::int AS total_batches FROM net) "
    "SELECT branch_id, commit_seq, batch_id, total_batches, count(*) FILTER (net>0) AS n_add, count(*) FILTER (net<0) AS n_remove FROM b GROUP BY ALL"
)
def commit_split_batches(spark, sf_dir):
    split = commits.batches(_net(spark, sf_dir), 50)
    return split.groupBy("branch_id", "commit_seq", "batch_id", "total_batches").agg(F.count_if(F.col("net") > 0).alias("n_add"), F.count_if(F.col("net") < 0).alias("n_remove"))


_WINDOW = "PARTITION BY branch_id, commit_seq ORDER BY net DESC, subject, predicate, object"


@query(
    f"""WITH {_NET}, b AS (SELECT *, octet_length(encode(to_json(struct_pack(subject := subject, predicate := predicate, datatype := 'http://www.w3.org/2001/XMLSchema#int', object := object))::varchar)) + 1 AS bytes, row_number() OVER ({_WINDOW}) AS rn FROM net),
    c AS (SELECT *, (sum(bytes) OVER ({_WINDOW}) - bytes) // 2000 AS cell FROM b),
    d AS (SELECT *, CASE WHEN rn = 1 OR bytes > 2000 OR lag(bytes) OVER ({_WINDOW}) > 2000 OR lag(cell) OVER ({_WINDOW}) <> cell OR (rn - 1) % 8000 = 0 THEN 1 ELSE 0 END AS fresh FROM c)
    SELECT branch_id, commit_seq, (sum(fresh) OVER ({_WINDOW}))::bigint AS part, subject, predicate, object, bytes::bigint AS bytes, bytes > 4000 AS oversized FROM d"""
)
def commit_split_payload(spark, sf_dir):
    return commits.payload_parts(_net(spark, sf_dir), 4_000).select("branch_id", "commit_seq", "part", *_SPO, "bytes", "oversized")


# Snapshots


@query(f"WITH {_SNAP} SELECT * FROM snap")
def snapshot_latest(spark, sf_dir):
    return snapshot.snapshot(_net(spark, sf_dir)).select("branch_id", *_SPO)


@query(_SNAP.join(["WITH ", " SELECT branch_id, subject, predicate, object FROM snap2"]).replace("snap AS (", "snap2 AS (").replace("FROM net) WHERE r=1", "FROM net WHERE commit_seq<=2) WHERE r=1"))
def snapshot_asof_week2(spark, sf_dir):
    return snapshot.snapshot(_net(spark, sf_dir), until=2).select("branch_id", *_SPO)


def _two(spark, sf_dir):
    snap = snapshot.snapshot(_net(spark, sf_dir))
    return snapshot.of_branch(snap, 0), snapshot.of_branch(snap, 1)


_B = "SELECT subject, predicate, object FROM snap WHERE branch_id={}"


@query(f"WITH {_SNAP}, a AS ({_B.format(0)}), b AS ({_B.format(1)}) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def snapshot_diff_branches(spark, sf_dir):
    return snapshot.diff(*_two(spark, sf_dir)).select(*_SPO, "side")


@query(f"WITH {_SNAP} {_B.format(0)} UNION {_B.format(1)}")
def snapshot_union(spark, sf_dir):
    return snapshot.union(*_two(spark, sf_dir)).select(*_SPO)


@query(f"WITH {_SNAP} {_B.format(0)} INTERSECT {_B.format(1)}")
def snapshot_intersect(spark, sf_dir):
    return snapshot.intersection(*_two(spark, sf_dir)).select(*_SPO)


@query(f"WITH {_SNAP} {_B.format(0)} EXCEPT {_B.format(1)}")
def snapshot_except(spark, sf_dir):
    return snapshot.difference(*_two(spark, sf_dir)).select(*_SPO)


# The log


@query(f"WITH {_NET} SELECT branch_id, commit_seq, commit_id FROM log WHERE branch_id=1 AND commit_seq > (SELECT commit_seq FROM log WHERE commit_id='c-1-1')")
def log_suffix_after(spark, sf_dir):
    log = commits.log(_net(spark, sf_dir)).where("branch_id = 1")
    return commits.suffix(log, "c-1-1", False, "commit_id", "commit_seq").select("branch_id", "commit_seq", "commit_id")


@query(f"WITH {_NET} SELECT branch_id, commit_seq, commit_id FROM log WHERE branch_id=1 AND commit_seq >= (SELECT commit_seq FROM log WHERE commit_id='c-1-1')")
def log_suffix_from(spark, sf_dir):
    log = commits.log(_net(spark, sf_dir)).where("branch_id = 1")
    return commits.suffix(log, "c-1-1", True, "commit_id", "commit_seq").select("branch_id", "commit_seq", "commit_id")


@query(f"WITH {_NET} SELECT branch_id, max_by(commit_id, commit_seq) AS commit_id FROM log GROUP BY 1")
def last_commit(spark, sf_dir):
    return commits.last(commits.log(_net(spark, sf_dir)), ["branch_id"])


@query("SELECT event_type AS key, max_by(value, event_id) AS value FROM events GROUP BY 1")
def latest_state(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return logs.latest_state(events.select(F.col("event_type").alias("key"), "value", F.col("event_id").alias("seq")))


# History and replay

_HROWS = ["commit_id", "ts", "op", *_SPO]


@query(f"WITH {_HIST} SELECT commit_id, ts, op, subject, predicate, object FROM hist WHERE branch_id=0 AND subject='http://ex/artifact/3'")
def history_by_resource(spark, sf_dir):
    return history.of_resource(_hist(spark, sf_dir), 0, "http://ex/artifact/3").select(*_HROWS)


@query(f"WITH {_SCOPED} SELECT branch_id, commit_id, ts, op, subject, predicate, object FROM scoped WHERE ts>=604800000")
def history_by_scope(spark, sf_dir):
    return history.since(history.in_scope(_hist(spark, sf_dir), _scope(spark)), WEEK_MS).select("branch_id", *_HROWS)


@query(f"WITH {_HIST} SELECT DISTINCT branch_id, commit_id, subject FROM hist")
def history_distinct_subjects(spark, sf_dir):
    return history.subjects(_hist(spark, sf_dir))


def _branch_zero(spark, sf_dir):
    net = _net(spark, sf_dir)
    state = snapshot.of_branch(snapshot.snapshot(net), 0)
    return state, history.history(net).where("branch_id = 0")


_DECIDE = "SELECT subject, predicate, object FROM {base} b ANTI JOIN {by} v USING (subject, predicate, object) UNION ALL SELECT subject, predicate, object FROM {by} WHERE op='{keep}'"
_REVERTED = (
    _SCOPED
    + f", zero AS ({_B.format(0)}), firsts AS (SELECT subject, predicate, object, min_by(op, {_ORDER}) AS op FROM scoped WHERE branch_id=0 GROUP BY ALL), reverted AS ("
    + _DECIDE.format(base="zero", by="firsts", keep="REMOVE")
    + ")"
)


@query(f"WITH {_REVERTED} SELECT * FROM reverted")
def replay_revert(spark, sf_dir):
    state, rows = _branch_zero(spark, sf_dir)
    return replay.revert(state, history.in_scope(rows, _scope(spark))).select(*_SPO)


@query(f"WITH {_REVERTED}, lasts AS (SELECT subject, predicate, object, max_by(op, {_ORDER}) AS op FROM scoped WHERE branch_id=0 AND ts<=604800000 GROUP BY ALL) " + _DECIDE.format(base="reverted", by="lasts", keep="ADD"))
def replay_forward_step(spark, sf_dir):
    state, rows = _branch_zero(spark, sf_dir)
    scoped = history.in_scope(rows, _scope(spark))
    return replay.forward(replay.revert(state, scoped), scoped, WEEK_MS).select(*_SPO)


@query(f"WITH {_SCOPED} SELECT branch_id, ts, count(*) AS n_entries, dense_rank() OVER (PARTITION BY branch_id ORDER BY ts)::int AS step FROM scoped GROUP BY branch_id, ts")
def replay_steps(spark, sf_dir):
    return replay.steps(history.in_scope(_hist(spark, sf_dir), _scope(spark)), ["branch_id"]).select("branch_id", "ts", "n_entries", "step")


@query(
    f"WITH {_SCOPED}, zero AS ({_B.format(0)}), fresh AS (SELECT * FROM more EXCEPT SELECT * FROM scope), firsts AS (SELECT h.subject, h.predicate, object, min_by(op, {_ORDER}) AS op FROM hist h SEMI JOIN fresh f ON h.subject=f.subject AND h.predicate=f.predicate WHERE branch_id=0 AND ts>=1209600000 GROUP BY ALL) "
    + _DECIDE.format(base="zero", by="firsts", keep="REMOVE")
)
def replay_add_to_scope(spark, sf_dir):
    state, rows = _branch_zero(spark, sf_dir)
    return replay.widen(state, rows, _scope(spark), _scope(spark, _MORE_ROWS), 2 * WEEK_MS).select(*_SPO)


# Branching


@query(f"WITH {_ROUTED} SELECT branch_id, dst::int AS dst, commit_id FROM log JOIN routes ON branch_id=src")
def route_fanout(spark, sf_dir):
    return branching.fan_out(commits.log(_net(spark, sf_dir)), _routes(spark)).select("branch_id", "dst", "commit_id")


_TRANSITIVE = _ROUTED.replace("ops AS", "RECURSIVE ops AS", 1) + ", hops AS (SELECT commit_id, branch_id AS origin, branch_id AS dst, 0 AS hop FROM log UNION ALL SELECT commit_id, origin, r.dst, hop+1 FROM hops JOIN routes r ON hops.dst=r.src WHERE hop<4), reached AS (SELECT commit_id, origin, dst, min(hop)::int AS hop FROM hops GROUP BY ALL HAVING min(hop)>0)"


@query(f"WITH {_TRANSITIVE} SELECT commit_id, origin, dst::int AS dst, hop FROM reached")
def merge_transitive(spark, sf_dir):
    return branching.propagate(commits.log(_net(spark, sf_dir)), _routes(spark)).select("commit_id", "origin", "dst", "hop")


def _arrivals(spark, sf_dir):
    log = commits.log(_net(spark, sf_dir))
    hops = branching.propagate(log, _routes(spark))
    # Each branch sends on whatever it has seen; a commit also comes back to where it began.
    routes = _routes(spark)
    held = hops.select("commit_id", "origin", "dst").union(log.select("commit_id", F.col("branch_id").alias("origin"), F.col("branch_id").alias("dst")))
    sent = held.withColumnRenamed("dst", "src").join(routes, "src").select("commit_id", "origin", "dst")
    return log, sent


@query(f"WITH {_TRANSITIVE}, held AS (SELECT commit_id, origin, dst FROM reached UNION ALL SELECT commit_id, branch_id, branch_id FROM log) SELECT DISTINCT h.commit_id, h.origin, r.dst::int AS dst FROM held h JOIN routes r ON h.dst=r.src WHERE h.origin<>r.dst")
def merge_dedup(spark, sf_dir):
    log, sent = _arrivals(spark, sf_dir)
    return branching.unseen(sent, log.select(F.col("branch_id").alias("dst"), "commit_id")).select("commit_id", "origin", "dst")


_RECEIVED = (
    _ROUTED
    + ", changes AS (SELECT branch_id AS dst, branch_id AS origin, commit_seq, subject, predicate, object, net FROM net UNION ALL SELECT r.dst, branch_id, commit_seq, subject, predicate, object, net FROM net JOIN routes r ON branch_id=r.src)"
)


@query(f"WITH {_RECEIVED} SELECT dst::int AS dst, subject, predicate, object FROM (SELECT *, row_number() OVER (PARTITION BY dst, subject, predicate, object ORDER BY commit_seq DESC, origin DESC, net DESC) AS r FROM changes) WHERE r=1 AND net=1")
def merge_snapshot(spark, sf_dir):
    net = _net(spark, sf_dir)
    arrivals = branching.fan_out(commits.log(net), _routes(spark)).withColumnRenamed("branch_id", "origin")
    return branching.merged_state(branching.received(net, arrivals)).select("dst", *_SPO)


@query(f"WITH {_ROUTED} SELECT commit_id, dst::int AS branch_id, coalesce(lag(commit_id) OVER (PARTITION BY dst ORDER BY commit_seq, branch_id), '') AS preceding_id FROM log JOIN routes ON branch_id=src")
def merge_commits(spark, sf_dir):
    arrivals = branching.fan_out(commits.log(_net(spark, sf_dir)).drop("preceding_id"), _routes(spark)).withColumnRenamed("branch_id", "origin")
    return branching.merge_commits(arrivals).select("commit_id", "branch_id", "preceding_id")


@query(f"WITH {_ROUTED} SELECT commit_id, dst::int AS dst, CASE WHEN dst=1 THEN 'REJECTED' ELSE 'ACCEPTED' END AS status FROM log JOIN routes ON branch_id=src")
def delivery_status(spark, sf_dir):
    sent = branching.fan_out(commits.log(_net(spark, sf_dir)), _routes(spark))
    return branching.with_status(sent, spark.createDataFrame([(0,), (2,)], "dst int")).select("commit_id", "dst", "status")


@query(f"WITH {_ROUTED}, cursors(src, dst, last_seq) AS (VALUES (0,1,1),(1,2,0),(2,0,NULL)) SELECT src::int AS src, dst::int AS dst, commit_seq, commit_id FROM log JOIN cursors ON branch_id=src WHERE last_seq IS NULL OR commit_seq>last_seq")
def pending_forward(spark, sf_dir):
    cursors = spark.createDataFrame([(0, 1, 1), (1, 2, 0), (2, 0, None)], "src int, dst int, last_seq int")
    return branching.pending_forward(commits.log(_net(spark, sf_dir)), cursors)


@query(f"WITH {_ROUTED} SELECT commit_id, dst::int AS dst FROM log JOIN routes ON branch_id=src WHERE commit_seq>1")
def pending_merge(spark, sf_dir):
    log = commits.log(_net(spark, sf_dir))
    sent = branching.fan_out(log, _routes(spark))
    return branching.pending_merge(sent, sent.where("commit_seq <= 1").select("dst", "commit_id")).select("commit_id", "dst")


@query(f"WITH {_NET} SELECT commit_id FROM (SELECT commit_id FROM log UNION ALL SELECT 'c-'||branch_id||'-'||(max(commit_seq)+1) FROM log GROUP BY branch_id) EXCEPT SELECT commit_id FROM log")
def pending_preliminary(spark, sf_dir):
    log = commits.log(_net(spark, sf_dir))
    ahead = log.groupBy("branch_id").agg((F.max("commit_seq") + 1).alias("s")).select(commits.commit_id(F.col("branch_id"), F.col("s")).alias("commit_id"))
    return branching.pending_preliminary(log.select("commit_id").union(ahead), log)


@query(f"WITH {_NET} SELECT b::int AS branch_id, b IN (SELECT branch_id FROM log) AS there FROM range(0, 6) t(b)")
def branch_exists(spark, sf_dir):
    asked = spark.range(6).select(F.col("id").cast("int").alias("branch_id"))
    return branching.existing(asked, commits.log(_net(spark, sf_dir)))


def _folder(spark) -> str:
    """A new folder where the session's checkpoints are."""
    settle(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


@query(f"WITH {_ROUTED} SELECT commit_seq::bigint AS seq, commit_id AS \"commitId\", branch_id::varchar AS \"sendingBranchId\", '1' AS \"receivingBranchId\", 'ACCEPTED' AS status FROM log JOIN routes ON branch_id=src WHERE dst=1 AND commit_seq>(SELECT commit_seq FROM log WHERE commit_id='c-0-1')")
def delivery_log_after(spark, sf_dir):
    """What a branch was sent after a commit, read back from the delivery log on disk."""
    deliveries = logs.Deliveries(spark, _folder(spark))
    sent = branching.fan_out(commits.log(_net(spark, sf_dir)), _routes(spark))
    deliveries.append(sent.select(F.col("commit_seq").cast("long").alias("seq"), F.col("commit_id").alias("commitId"), F.col("branch_id").cast("string").alias("sendingBranchId"), F.col("dst").cast("string").alias("receivingBranchId"), F.lit("ACCEPTED").alias("status")))
    return deliveries.after("1", "c-0-1")


@query(_FLAT.replace(", pos", "").replace("(row_number() OVER (PARTITION BY branch_id, commit_seq ORDER BY net DESC, first_seq)-1)::int AS pos, ", ""))
def commit_log_on_disk(spark, sf_dir):
    """All commits, split in parts, appended to a log on disk and joined again row by row."""
    log = logs.CommitLog(spark, _folder(spark))
    log.append(commits.split_rows(commits.rows(_net(spark, sf_dir)), 50, 20_000))
    return log.rows().select("branch_id", "commit_id", "preceding_id", "ts", "op", *_SPO)


@query("SELECT 'http://ex/r/'||r_name AS subject, 'label' AS predicate, lower(r_name) AS object FROM region UNION ALL SELECT 'http://ex/r/'||r_name, 'label', r_name FROM region")
def branch_recovery(spark, sf_dir):
    """A branch whose service fails after the commit was written ahead, and its destination's graph once both were loaded again."""
    path, regions = _folder(spark), [r.r_name for r in _table(spark, sf_dir, "region").collect()]

    def broken(*_):
        raise RuntimeError("the service fails")

    def lower(_, new, graph):
        return new.where("delta > 0").withColumn("object", F.lower("object"))

    first = Repository(spark, "http://ex/repo", path=path).get_or_create("one")
    first.services = [broken]
    for name in regions:
        first.add(f"http://ex/r/{name}", "label", name, V.XSD + "string")
    with contextlib.suppress(RuntimeError):
        first.commit("regions")
    again = Repository(spark, "http://ex/repo", path=path)
    one, two = again.get_or_create("one"), again.get_or_create("two")
    one.services, two.mergers, one.destinations = [lower], [complete_merger], [two]
    one.recover()
    two.merge()
    return two.state.select(*_SPO)


# Collections


def _parts(spark, sf_dir):
    return containment.lists(_table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_partkey")


def _exploded(df, items="items"):
    return df.select("l_orderkey", F.posexplode(items).alias("idx", "part"))


# Lines of an order with the same number come in the order of their part, as in the arrays.
_LISTS = "lists AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS items FROM lineitem GROUP BY 1)"
_EXPLODED = "SELECT l_orderkey, (unnest(range(len({x})))::int) AS idx, unnest({x}) AS part FROM lists"


@query(f"WITH {_LISTS} " + _EXPLODED.format(x="items"))
def list_assemble(spark, sf_dir):
    return _exploded(_parts(spark, sf_dir))


@query(f"WITH {_LISTS} " + _EXPLODED.format(x="(items[1:1] || [0::bigint] || items[2:])"))
def list_insert(spark, sf_dir):
    return _exploded(_parts(spark, sf_dir).withColumn("items", C.list_insert(F.col("items"), 1, F.lit(0).cast("long"))))


@query(f"WITH {_LISTS} " + _EXPLODED.format(x="(list_filter(items, lambda x, i: i <> list_position(items, items[len(items)])))"))
def list_remove(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    return _exploded(parts.withColumn("items", C.list_remove(F.col("items"), F.element_at("items", -1))))


@query(f"WITH {_LISTS} " + _EXPLODED.format(x="(items[2:3])"))
def list_slice(spark, sf_dir):
    return _exploded(_parts(spark, sf_dir).withColumn("items", C.list_slice(F.col("items"), 1, 3)))


@query(f"WITH {_LISTS} SELECT l_orderkey, len(items)::int AS n, items[2] AS second, (coalesce(list_position(items, items[len(items)]), 0)-1)::int AS first_of_last, list_contains(items, 7) AS has_seven, (len(items[:1])+2+len(items[2:]))::int AS n_inserted FROM lists")
def list_functions(spark, sf_dir):
    x = F.col("items")
    two = F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))
    return _parts(spark, sf_dir).select("l_orderkey", C.list_size(x).alias("n"), C.list_get(x, 1).alias("second"), C.list_index_of(x, F.element_at(x, -1)).alias("first_of_last"), C.list_contains(x, F.lit(7).cast("long")).alias("has_seven"), F.size(C.list_insert_all(x, 1, two)).alias("n_inserted"))


@query(f"WITH {_LISTS} SELECT 'o'||l_orderkey AS owner, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#_'||(idx+1) AS predicate, part::varchar AS object FROM ({_EXPLODED.format(x='items')})")
def list_to_triples(spark, sf_dir):
    parts = _parts(spark, sf_dir).withColumn("owner", F.concat(F.lit("o"), F.col("l_orderkey").cast("string")))
    return containment.list_statements(parts, "owner", "items")


@query(
    f"WITH {_LISTS}, a AS ({_EXPLODED.format(x='items')}), b AS ({_EXPLODED.format(x='([0::bigint] || items)')}), d AS (SELECT l_orderkey, 'REMOVE' AS op FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT l_orderkey, 'ADD' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) SELECT l_orderkey AS owner, op, count(*) AS n FROM d GROUP BY ALL"
)
def list_insert_delta(spark, sf_dir):
    parts = _parts(spark, sf_dir).withColumn("more", C.list_insert(F.col("items"), 0, F.lit(0).cast("long")))
    return containment.list_change(parts, "l_orderkey", "items", "more").groupBy("owner", "op").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LISTS} " + _EXPLODED.format(x="([0::bigint] || items[2:])"))
def list_set(spark, sf_dir):
    return _exploded(_parts(spark, sf_dir).withColumn("items", C.list_set(F.col("items"), 0, F.lit(0).cast("long"))))


@query(f"WITH {_LISTS} " + _EXPLODED.format(x="(items || [7::bigint])"))
def list_add(spark, sf_dir):
    return _exploded(_parts(spark, sf_dir).withColumn("items", C.list_add(F.col("items"), F.lit(7).cast("long"))))


@query(f"WITH {_LISTS} " + _EXPLODED.format(x="(items[:1] || [0::bigint, 1::bigint] || items[2:])"))
def list_insert_all(spark, sf_dir):
    two = F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))
    return _exploded(_parts(spark, sf_dir).withColumn("items", C.list_insert_all(F.col("items"), 1, two)))


@query(f"WITH {_LISTS} " + _EXPLODED.format(x="(list_filter(items[2:], lambda x, i: i <> coalesce(list_position(items[2:], items[len(items)]), 0)))"))
def list_remove_all(spark, sf_dir):
    x = F.col("items")
    return _exploded(_parts(spark, sf_dir).withColumn("items", C.list_remove_all(x, F.array(F.element_at(x, 1), F.element_at(x, -1)))))


@query(f"WITH {_LISTS} " + _EXPLODED.format(x="(list_filter(items, lambda x: x % 2 = 0))"))
def list_retain_all(spark, sf_dir):
    """Each element beyond the even ones takes away one of its kind, so all of them go."""
    x = F.col("items")
    return _exploded(_parts(spark, sf_dir).withColumn("items", C.list_retain_all(x, F.filter(x, lambda v: v % 2 == 0))))


def _nation_lists(spark, sf_dir):
    """Owners whose property asks for a list; every other nation has it already."""
    n = _table(spark, sf_dir, "nation")
    owner, prop, null = F.concat(F.lit("http://ex/n/"), F.col("n_name")), "http://ex/p#tags", F.lit(None).cast("string")
    ask = n.select(owner.alias("owner"), F.lit(prop).alias("property"), F.lit(prop + "_list").alias("range"))
    state = n.where("n_nationkey % 2 = 0").select(owner.alias("subject"), F.lit(prop).alias("predicate"), F.concat(owner, F.lit("#tags")).alias("object"), null.alias("datatype"))
    return ask, state


_MADE = f"odd AS (SELECT 'http://ex/n/'||n_name AS owner FROM nation WHERE n_nationkey%2=1), made AS (SELECT owner||'#tags' AS subject, '{V.TYPE}' AS predicate, '{V.LIST_CLASS}' AS object FROM odd UNION ALL SELECT owner||'#tags', '{V.TYPE}', 'http://ex/p#tags_list' FROM odd UNION ALL SELECT owner||'#tags', '{V.LIST_OWNER}', owner FROM odd UNION ALL SELECT owner, 'http://ex/p#tags', owner||'#tags' FROM odd)"


@query(f"WITH {_MADE} SELECT * FROM made")
def list_get_or_create(spark, sf_dir):
    return containment.get_or_create_lists(*_nation_lists(spark, sf_dir)).select(*_SPO)


@query(f"WITH {_MADE} SELECT * FROM made WHERE NOT starts_with(subject, 'http://ex/n/NATION_1') OR predicate='http://ex/p#tags'")
def list_delete(spark, sf_dir):
    made = containment.get_or_create_lists(*_nation_lists(spark, sf_dir))
    doomed = made.where(F.col("subject").startswith("http://ex/n/NATION_1") & F.col("subject").endswith("#tags")).select(F.col("subject").alias("list")).distinct()
    return containment.delete_lists(made, doomed).select(*_SPO)


@query("SELECT DISTINCT user_id, event_type AS item FROM events")
def set_assemble(spark, sf_dir):
    return containment.sets(_table(spark, sf_dir, "events"), ["user_id"], "event_type").select("user_id", F.explode("items").alias("item"))


_WEEKS = "a AS (SELECT DISTINCT user_id, event_type AS item FROM events WHERE event_id%2=0), b AS (SELECT DISTINCT user_id, event_type AS item FROM events WHERE value>50)"


@query(
    f"WITH {_WEEKS} SELECT user_id, 'retain' AS op, item FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT user_id, 'remove', item FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT user_id, 'add', item FROM (SELECT * FROM a UNION SELECT * FROM b)"
)
def set_ops(spark, sf_dir):
    events = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") > 50, F.col("event_type"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    ops = F.array(*[F.struct(F.lit(n).alias("op"), f(a, b).alias("items")) for n, f in (("retain", C.set_retain_all), ("remove", C.set_remove_all), ("add", C.set_add_all))])
    return events.select("user_id", F.explode(ops).alias("o")).select("user_id", "o.op", F.explode("o.items").alias("item"))


def _user_maps(spark, sf_dir):
    events = _table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return containment.maps(events, ["user_id"], "event_type", "k", "event_id")


_MAPS = "maps AS (SELECT user_id, event_type AS key, max_by(props->>'$.k', event_id) AS value FROM events GROUP BY 1, 2)"


@query(f"WITH {_MAPS} SELECT * FROM maps")
def map_assemble(spark, sf_dir):
    return _user_maps(spark, sf_dir).select("user_id", F.explode("entries").alias("key", "value"))


@query(f"WITH {_MAPS} SELECT user_id, key, CASE WHEN key='click' THEN '-1' ELSE value END AS value FROM maps WHERE key<>'click' UNION ALL SELECT DISTINCT user_id, 'click', '-1' FROM maps UNION ALL SELECT DISTINCT user_id, 'new', '5' FROM maps")
def map_put(spark, sf_dir):
    m = C.map_put(C.map_put(F.col("entries"), F.lit("click"), F.lit("-1")), F.lit("new"), F.lit("5"))
    return _user_maps(spark, sf_dir).select("user_id", F.explode(m).alias("key", "value"))


@query(f"WITH {_MAPS} SELECT user_id AS owner, CASE WHEN bool_or(key='click') THEN 1 ELSE 5 END::int AS n_add, CASE WHEN bool_or(key='click') THEN 1 ELSE 0 END::int AS n_remove FROM maps GROUP BY 1")
def map_put_delta(spark, sf_dir):
    owned = _user_maps(spark, sf_dir).withColumn("owner", F.col("user_id").cast("string"))
    state = containment.map_statements(owned, "owner", "entries", "http://ex/p#props")
    puts = owned.select("owner", F.lit("click").alias("key"), F.lit("-1").alias("value"))
    ops = containment.put_change(state, puts, "http://ex/p#props")
    owner = F.split_part("subject", F.lit("/"), F.lit(1)).cast("long").alias("owner")
    return ops.groupBy(owner).agg(F.count_if(F.col("op") == "ADD").cast("int").alias("n_add"), F.count_if(F.col("op") == "REMOVE").cast("int").alias("n_remove"))


@query(f"WITH {_MAPS} SELECT 'u'||user_id AS owner, key, value FROM maps")
def map_entries(spark, sf_dir):
    owned = _user_maps(spark, sf_dir).withColumn("owner", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return containment.read_maps(containment.map_statements(owned, "owner", "entries", "http://ex/p#props"), "http://ex/p#props")


# Checks and schemas


@query(f"WITH {_SNAP} SELECT branch_id, subject, predicate, count(*) AS n FROM snap WHERE predicate IN ('http://ex/p#click', 'http://ex/p#view') GROUP BY ALL HAVING count(*)>1")
def single_violations(spark, sf_dir):
    single = spark.createDataFrame([("http://ex/p#click",), ("http://ex/p#view",)], "property string")
    return ontology.single_violations(snapshot.snapshot(_net(spark, sf_dir)), single)


_MIXED = "mixed AS (SELECT c_custkey AS id, c_name AS object FROM customer UNION ALL SELECT c_custkey, c_nationkey::varchar FROM customer UNION ALL SELECT p_partkey, (p_size*10)::varchar FROM part)"


@query(f"WITH {_MIXED} SELECT id, object FROM mixed WHERE NOT coalesce(regexp_full_match(object, '[+-]?[0-9]+') AND try_cast(object AS tinyint) IS NOT NULL, false)")
def type_rejects(spark, sf_dir):
    c, p = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "part")
    mixed = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("object")).union(c.select("c_custkey", F.col("c_nationkey").cast("string"))).union(p.select("p_partkey", (F.col("p_size") * 10).cast("string")))
    return ontology.assignable_literals(mixed, V.XSD + "byte")[1]


def _turns(spark, sf_dir):
    """Conversations own lists of turns: the graph, and a commit that changes every turn and drops those of assistants."""
    t = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    conv, seq = F.concat(F.lit("http://ex/conv/"), F.col("conv_id").cast("string")), F.concat(F.lit("http://ex/turn/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    null = F.lit(None).cast("string")
    row = lambda s, p, o, d: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), d.alias("datatype"))
    links = F.array(row(seq, V.TYPE, F.lit(V.LIST_CLASS), null), row(seq, V.LIST_OWNER, conv, null), row(conv, "http://ex/p#turns", seq, null))
    value = row(seq, V.RDF + "_1", F.col("role"), F.lit(V.XSD + "string"))
    kept = t.where("role <> 'assistant'")
    state = kept.select(F.explode(links).alias("s")).select("s.*")
    gone = t.where("role = 'assistant'").select(F.explode(F.concat(links, F.array(value))).alias("s")).select("s.*", F.lit("REMOVE").alias("op"))
    new = kept.select(value.alias("s")).select("s.*", F.lit("ADD").alias("op"))
    return state, new.union(gone)


_TURNS = "t AS (SELECT DISTINCT conv_id, turn, role FROM conversations), named AS (SELECT 'http://ex/conv/'||conv_id AS conv, 'http://ex/turn/'||conv_id||'/'||turn AS seq, role FROM t)"


@query(f"WITH {_TURNS} SELECT seq AS subject, role AS object, conv AS containingsubject, 'http://ex/p#turns' AS containmentpredicate FROM named WHERE role<>'assistant'")
def containment_attribution(spark, sf_dir):
    state, ops = _turns(spark, sf_dir)
    return containment.attribute(ops, state).where("op = 'ADD'").select("subject", "object", "containingsubject", "containmentpredicate")


@query(f"WITH {_TURNS} SELECT seq AS subject, conv AS containingsubject, 'http://ex/p#turns' AS containmentpredicate, 3::bigint AS n FROM named WHERE role='assistant'")
def containment_deleted(spark, sf_dir):
    state, ops = _turns(spark, sf_dir)
    gone = containment.attribute(ops, state).where("op = 'REMOVE' and containingsubject is not null")
    return gone.groupBy("subject", "containingsubject", "containmentpredicate").agg(F.count(F.lit(1)).alias("n"))


def _typed_elements(spark, sf_dir):
    """Turns as lists, map entries and things without a type, all of which refer to their conversation; and a value for each."""
    t = _table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    conv, element = F.concat(F.lit("http://ex/conv/"), F.col("conv_id").cast("string")), F.concat(F.lit("http://ex/turn/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    null, kind = F.lit(None).cast("string"), F.col("turn") % 3
    row = lambda s, p, o: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), null.alias("datatype"))
    typed = F.when(kind == 0, row(element, V.TYPE, F.lit(V.LIST_CLASS))).when(kind == 1, row(element, V.TYPE, F.lit(V.MAP_ENTRY)))
    rows = F.array_compact(F.array(typed, row(element, V.LIST_OWNER, conv), F.when(kind == 1, row(element, V.MAP_OWNER, conv)), row(conv, "http://ex/p#parts", element)))
    state = t.select(F.explode(rows).alias("s")).select("s.*")
    return t.select(element.alias("subject"), F.lit(V.RDF + "_1").alias("predicate"), F.lit("x").alias("object"), F.lit(V.XSD + "string").alias("datatype"), F.lit("ADD").alias("op")), state


@query("SELECT DISTINCT 'http://ex/turn/'||conv_id||'/'||turn AS subject, CASE WHEN turn%3<2 THEN 'http://ex/conv/'||conv_id END AS containingsubject, CASE WHEN turn%3<2 THEN 'http://ex/p#parts' END AS containmentpredicate FROM conversations")
def containment_typed(spark, sf_dir):
    ops, state = _typed_elements(spark, sf_dir)
    return containment.attribute_typed(ops, state, ontology.meta_model(spark)).select("subject", "containingsubject", "containmentpredicate")


@query(f"WITH {_TURNS} SELECT seq AS subject FROM named WHERE role='assistant'")
def was_list(spark, sf_dir):
    return ontology.was_instance(_turns(spark, sf_dir)[1], ontology.meta_model(spark), V.LIST_CLASS)


@query(
    f"WITH {_NET}, o AS (SELECT *, CASE WHEN net>0 THEN 'ADD' ELSE 'REMOVE' END AS op, min(first_seq) OVER (PARTITION BY branch_id, commit_seq, subject) AS first_touch FROM net) "
    "SELECT branch_id, commit_seq, subject, predicate, object, op, first_touch, dense_rank() OVER (PARTITION BY branch_id, commit_seq ORDER BY first_touch, subject)::int AS rank, row_number() OVER (PARTITION BY branch_id, commit_seq, subject ORDER BY op, first_seq)::int AS pos FROM o"
)
def operations_per_instance(spark, sf_dir):
    ops = netting.with_op(_net(spark, sf_dir)).withColumnRenamed("first_seq", "seq")
    return containment.per_instance(ops, ["branch_id", "commit_seq"]).select("branch_id", "commit_seq", *_SPO, "op", "first_touch", "rank", "pos")


def _definitions(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, (V.PROPERTY, V.OBJECT_PROPERTY, V.DATA_PROPERTY, V.CLASS))), F.col("p_size") % 4 + 1)
    op = F.when(F.col("p_partkey") % 2 == 0, "ADD").otherwise("REMOVE")
    name = F.concat(F.lit("http://ex/p#"), F.col("p_partkey").cast("string"))
    ops = p.select(name.alias("subject"), F.lit(V.TYPE).alias("predicate"), kind.alias("object"), op.alias("op"))
    return ops, p.where("p_partkey % 3 = 0").select(name.alias("property")).distinct()


_DEFS = "defs AS (SELECT DISTINCT 'http://ex/p#'||p_partkey AS property, p_partkey%2=0 AS added FROM part WHERE p_size%4<3), known AS (SELECT DISTINCT 'http://ex/p#'||p_partkey AS property FROM part WHERE p_partkey%3=0)"


@query(f"WITH {_DEFS} SELECT DISTINCT property FROM defs d ANTI JOIN known USING (property) WHERE added")
def property_defs_added(spark, sf_dir):
    return ontology.property_changes(*_definitions(spark, sf_dir))[0]


@query(f"WITH {_DEFS} SELECT DISTINCT property FROM defs d SEMI JOIN known USING (property) WHERE NOT added")
def property_defs_removed(spark, sf_dir):
    return ontology.property_changes(*_definitions(spark, sf_dir))[1]


def _schema(spark, sf_dir):
    """A class for each region with its nations as properties of all kinds, and a subclass for each nation."""
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    name = lambda c: F.concat(F.lit("http://ex/s#"), F.col(c))
    joined = n.join(r, n.n_regionkey == r.r_regionkey)
    cls = joined.select(F.concat(name("n_name"), F.lit("Class")).alias("class"), name("r_name").alias("super")).union(r.select(name("r_name"), F.lit(None).cast("string")))
    return ontology.classes(cls).union(_properties(spark, sf_dir)).union(ontology.meta_model(spark)), cls


def _properties(spark, sf_dir):
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    name = lambda c: F.concat(F.lit("http://ex/s#"), F.col(c))
    kind = F.element_at(F.array(*map(F.lit, ("SINGLE", "LIST", "MAP", "SET"))), F.col("n_nationkey") % 4 + 1)
    props = n.join(r, n.n_regionkey == r.r_regionkey).select(name("n_name").alias("property"), kind.alias("kind"), name("r_name").alias("domain"), F.lit(V.XSD + "string").alias("range"), F.lit(True).alias("literal"))
    return ontology.define(props)


@query("SELECT 'http://ex/s#'||n_name AS property, ['SINGLE','LIST','MAP','SET'][n_nationkey%4+1] AS kind, 'http://ex/s#'||r_name AS domain FROM nation JOIN region ON n_regionkey=r_regionkey")
def schema_kinds(spark, sf_dir):
    state, _ = _schema(spark, sf_dir)
    mine = ontology.kinds(state).where(F.col("property").startswith("http://ex/s#"))
    return mine.join(ontology.members(state), "property", "left_anti").where(~ST.is_entry_property(F.col("property"))).select("property", "kind", "domain")


def _made_for(kind: int, rows: list[tuple[str, str, str, str]]) -> str:
    """SQL of the statements of one kind of property: p is the property, d its domain; the range is a string."""
    cells = ", ".join(f"struct_pack(subject := {s}, predicate := '{p}', object := {o}, datatype := {t})" for s, p, o, t in rows)
    return f"SELECT unnest([{cells}], recursive := true) FROM (SELECT 'http://ex/s#'||n_name AS p, 'http://ex/s#'||r_name AS d FROM nation JOIN region ON n_regionkey=r_regionkey WHERE n_nationkey%4={kind})"


def _schema_sql() -> str:
    null, string = "NULL::varchar", f"'{V.XSD}string'"
    q = lambda x: f"'{x}'"
    one = "'anon::'||p||'::maxOneCardinality'"
    plain = [("p", V.TYPE, q(V.DATA_PROPERTY), null), ("p", V.DOMAIN, "d", null), ("p", V.RANGE, string, null)]
    most = lambda target, on: [(one, V.TYPE, q(V.OWL + "Restriction"), null), (one, V.OWL + "onProperty", "p", null), (one, V.OWL + "maxQualifiedCardinality", "'1'", q(V.XSD + "nonNegativeInteger")), (one, V.OWL + on, target, null), ("d", V.SUB_CLASS, one, null)]
    single = [*plain, *most(string, "onDataRange"), ("p", V.SUB_PROPERTY, q(V.SINGLE_LITERAL), null)]
    seq, li, only = "p||'_list'", "p||'_liLiteral'", "'anon::'||p||'_liLiteral::valueRestriction'"
    listed = [(seq, V.TYPE, q(V.CLASS), null), (seq, V.SUB_CLASS, q(V.LIST_CLASS), null), ("p", V.TYPE, q(V.OBJECT_PROPERTY), null), ("p", V.DOMAIN, "d", null), ("p", V.RANGE, seq, null), *most(seq, "onClass"), ("p", V.SUB_PROPERTY, q(V.LIST_REF), null)]
    listed += [(li, V.TYPE, q(V.DATA_PROPERTY), null), (li, V.SUB_PROPERTY, q(V.MEMBER), null), (li, V.DOMAIN, seq, null), (li, V.RANGE, string, null), (only, V.TYPE, q(V.OWL + "Restriction"), null), (only, V.OWL + "onProperty", li, null), (only, V.OWL + "allValuesFrom", string, null), (seq, V.SUB_CLASS, only, null)]
    entry, value = "p||'EntryType'", "p||'/literalValue'"
    mapped = [(entry, V.TYPE, q(V.CLASS), null), (entry, V.SUB_CLASS, q(V.MAP_ENTRY), null), ("p", V.TYPE, q(V.OBJECT_PROPERTY), null), ("p", V.DOMAIN, "d", null), ("p", V.RANGE, entry, null), ("p", V.SUB_PROPERTY, q(V.MAP_REF), null), (value, V.TYPE, q(V.DATA_PROPERTY), null), (value, V.DOMAIN, entry, null), (value, V.RANGE, string, null), (value, V.SUB_PROPERTY, q(V.MAP_LITERAL), null)]
    parts = " UNION ALL ".join(_made_for(k, rows) for k, rows in enumerate((single, listed, mapped, plain)))
    return f"SELECT DISTINCT * FROM ({parts})"


@query(_schema_sql())
def schema_triples(spark, sf_dir):
    return _properties(spark, sf_dir).select(*V.STATEMENT)


@query(f"SELECT 'http://ex/s#'||n_name AS property FROM nation WHERE n_nationkey%4=2 UNION ALL SELECT '{V.MAP_REF}'")
def schema_map_ranges(spark, sf_dir):
    return ontology.has_map_entry_range(_schema(spark, sf_dir)[0])


@query(f"WITH t AS (SELECT s_suppkey, CASE s_suppkey%3 WHEN 0 THEN '{V.XSD}int' WHEN 1 THEN '{V.RDFS}Literal' ELSE 'http://ex/s#C'||s_nationkey END AS uri FROM supplier) SELECT s_suppkey, uri, s_suppkey%3<2 AS is_primitive FROM t")
def value_types(spark, sf_dir):
    uri = F.when(F.col("s_suppkey") % 3 == 0, V.XSD + "int").when(F.col("s_suppkey") % 3 == 1, V.RDFS + "Literal").otherwise(F.concat(F.lit("http://ex/s#C"), F.col("s_nationkey").cast("string")))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", ontology.value_type(uri).alias("t")).select("s_suppkey", "t.uri", "t.is_primitive")


@query("SELECT 'http://ex/supplier/'||s_suppkey AS object FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE r_name<>'ASIA'")
def type_rejects_objects(spark, sf_dir):
    """Suppliers are instances of their nation's class; those of no subclass of ASIA are rejected."""
    state, _ = _schema(spark, sf_dir)
    s, n = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "nation")
    name = F.concat(F.lit("http://ex/supplier/"), F.col("s_suppkey").cast("string"))
    types = s.join(n, s.s_nationkey == n.n_nationkey).select(name.alias("subject"), F.lit(V.TYPE).alias("predicate"), F.concat(F.lit("http://ex/s#"), F.col("n_name"), F.lit("Class")).alias("object"), F.lit(None).cast("string").alias("datatype"))
    return ontology.assignable_objects(s.select(name.alias("object")), state.select(*V.STATEMENT).union(types), "http://ex/s#ASIA")[1]


@query("SELECT 'http://ex/s#'||n_name AS property FROM nation JOIN region ON n_regionkey=r_regionkey WHERE r_name='ASIA'")
def schema_declared(spark, sf_dir):
    return ontology.declared(_schema(spark, sf_dir)[0], "http://ex/s#ASIA")


@query("SELECT 'http://ex/s#'||n_name AS property, ['SINGLE','LIST','MAP','SET'][n_nationkey%4+1] AS kind FROM nation JOIN region ON n_regionkey=r_regionkey WHERE r_name<>'ASIA'")
def schema_drop_class(spark, sf_dir):
    state, _ = _schema(spark, sf_dir)
    left = ontology.kinds(ontology.drop_class(state, "http://ex/s#ASIA", subclasses=True)).where(F.col("property").startswith("http://ex/s#"))
    return left.join(ontology.members(state), "property", "left_anti").where(~ST.is_entry_property(F.col("property"))).select("property", "kind")


@query(
    """WITH RECURSIVE e AS (SELECT 'c'||c_custkey AS sub, 'n'||c_nationkey AS super FROM customer UNION ALL SELECT 's'||s_suppkey, 'n'||s_nationkey FROM supplier UNION ALL SELECT 'n'||n_nationkey, 'r'||n_regionkey FROM nation UNION ALL SELECT 'r'||r_regionkey, 'world' FROM region),
    t AS (SELECT sub, super, 1 AS depth FROM e UNION ALL SELECT t.sub, e.super, depth+1 FROM t JOIN e ON t.super=e.sub) SELECT sub, super, min(depth)::int AS depth FROM t GROUP BY ALL"""
)
def subclass_closure(spark, sf_dir):
    pair = lambda t, a, b, x, y: _table(spark, sf_dir, t).select(F.concat(F.lit(x), F.col(a).cast("string")).alias("sub"), F.concat(F.lit(y), F.col(b).cast("string")).alias("super"))
    edges = pair("customer", "c_custkey", "c_nationkey", "c", "n").union(pair("supplier", "s_suppkey", "s_nationkey", "s", "n")).union(pair("nation", "n_nationkey", "n_regionkey", "n", "r"))
    world = _table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.lit("world"))
    return ontology.closure(edges.union(world))


@query(
    """WITH RECURSIVE flips AS (SELECT 'http://ex/n#'||n_name AS subject, 1::bigint AS v, 0 AS n FROM nation UNION ALL SELECT subject, CASE WHEN v>0 THEN -(v+1) ELSE -v+1 END, n+1 FROM flips WHERE n<20)
    SELECT subject, v::varchar AS object FROM flips WHERE n=20"""
)
def service_fixpoint_signflip(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select(F.concat(F.lit("http://ex/n#"), F.col("n_name")).alias("subject"), F.lit(V.RDFS + "label").alias("predicate"), F.lit("1").alias("object"), F.lit(V.XSD + "int").alias("datatype"))
    ops = n.withColumn("delta", F.lit(1)).withColumn("seq", F.lit(0).cast("long"))
    done, graph, _ = services.fixpoint(ops, n.limit(0), [services.sign_flip(V.RDFS + "label", 1), services.sign_flip(V.RDFS + "label", -1)])
    return graph.select("subject", "object")


@query("SELECT c_custkey, 'http://ex/repo::'||CASE WHEN c_custkey%5=0 THEN '' ELSE c_mktsegment END AS uri, CASE WHEN c_custkey%5=0 THEN NULL ELSE c_mktsegment END AS name FROM customer")
def branch_names(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    uri = ST.branch_uri(F.lit("http://ex/repo"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_mktsegment")))
    return c.select("c_custkey", uri.alias("uri"), ST.branch_name(uri).alias("name"))


# Streams


@query(ORACLES["net_commits"])
def stream_net_commits(spark, sf_dir):
    return netting.with_op(jobs.net_commits(spark, sf_dir)).select("branch_id", "commit_seq", *_SPO, "op")


@query(ORACLES["snapshot_latest"])
def stream_snapshot_latest(spark, sf_dir):
    return jobs.snapshot(_net(spark, sf_dir).drop("first_seq")).select("branch_id", *_SPO)


@query(ORACLES["merge_dedup"])
def stream_merge_dedup(spark, sf_dir):
    log, sent = _arrivals(spark, sf_dir)
    return jobs.merge_dedup(sent.where("origin <> dst")).select("commit_id", "origin", "dst")


@query(ORACLES["history_by_resource"].replace("WHERE branch_id=0 AND", "WHERE"))
def stream_history_index(spark, sf_dir):
    return jobs.of_container(jobs.index_history(_net(spark, sf_dir)), "http://ex/artifact/3").select(*_HROWS)
