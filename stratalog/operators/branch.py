"""Branches and repositories: the engine's front."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import vocabulary as V
from stratalog.functions.checkpoint import settle
from stratalog.operators import commits as C
from stratalog.operators import ontology
from stratalog.operators import services as S
from stratalog.operators.netting import net
from stratalog.operators.snapshot import apply
from stratalog.sources import log as L

_OPS = "subject string, predicate string, object string, datatype string, delta int, seq long"


@dataclass
class Commit:
    """Metadata and net changes (statement, net).  Two are the same if id and branch are."""

    id: str
    branch: str
    message: str
    preceding: str
    ts: int
    changes: DataFrame = field(compare=False)

    def count(self) -> tuple[int, int]:
        """Additions and removals."""
        row = self.changes.agg(F.count_if(F.col("net") > 0), F.count_if(F.col("net") < 0)).first()
        return row[0], row[1]


class Store:
    """What the branches of a repository keep on disk.

    Commits, and those written ahead of their services, are logs; deliveries and what was
    forwarded are tables of records.  Nothing is ever changed in place, so a crash leaves
    either the record or nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.log, self.ahead = L.CommitLog(spark, f"{path}/commits"), L.CommitLog(spark, f"{path}/ahead")
        self.deliveries, self.snapshots = L.Deliveries(spark, f"{path}/deliveries"), L.Snapshots(spark, f"{path}/snapshots")
        self.forwards = f"{path}/forwards"

    def write(self, log: L.CommitLog, branch: str, commit: Commit, seq: int) -> None:
        null = F.lit(None).cast("string")
        rows = commit.changes.select(
            F.lit(branch).alias("branch_id"), F.lit(seq).cast("long").alias("seq"), F.lit(commit.id).alias("commit_id"), F.lit(commit.preceding).alias("preceding_id"), F.lit(commit.ts).cast("long").alias("ts"), F.lit(commit.message).alias("message"),
            F.when(F.col("net") > 0, "ADD").otherwise("REMOVE").alias("op"), F.hash(*V.STATEMENT).alias("pos"), null.alias("containingsubject"), "subject", null.alias("containmentpredicate"), "predicate", "datatype", "object",
        )
        events = C.split_rows(rows)
        if commit.changes.isEmpty():
            head = self.spark.createDataFrame([(branch, seq, commit.id, branch, commit.message, commit.preceding, commit.ts, [], [])], f"branch_id string, seq long, {V.COMMIT_DDL}")
            events = C.split(head)
        log.append(events)

    def read(self, log: L.CommitLog, branch: str, uri: str) -> list[tuple[int, Commit]]:
        """Place and commit of all whole commits, oldest first; their changes are read when they are needed."""
        heads = sorted(log.heads(branch).collect(), key=lambda h: h.seq)  # one row for each commit of the branch
        return [(h.seq, Commit(h.commitId, uri, h.commitMessage, h.precedingCommitId, h.timeStamp, self.changes(log, branch, h.commitId))) for h in heads]

    def changes(self, log: L.CommitLog, branch: str, commit_id: str) -> DataFrame:
        rows = log.rows(branch).where(F.col("commit_id") == commit_id)
        return rows.select(*V.STATEMENT, F.when(F.col("op") == "ADD", 1).otherwise(-1).alias("net"))

    def state(self, branch: str) -> DataFrame:
        """The graph after all commits of the log, on top of the graph the branch was created with."""
        last = self.log.rows(branch).groupBy(*V.STATEMENT).agg(F.max_by("op", F.struct("seq", F.col("op") == "ADD")).alias("_op"))
        base = self.snapshots.load(branch)
        netted = last.select(*V.STATEMENT, F.when(F.col("_op") == "ADD", 1).otherwise(-1).alias("net"))
        return netted.where("net > 0").select(*V.STATEMENT) if base is None else apply(base, netted)

    def exists(self, branch: str) -> bool:
        """Whether the repository has a branch of this name, with a graph or with commits."""
        return self.snapshots.load(branch) is not None or not self.log.events().where(F.col("branch_id") == branch).limit(1).isEmpty()

    def deliver(self, seq: int, commit_id: str, sender: str, receiver: str, status: str) -> None:
        self.deliveries.append(self.spark.createDataFrame([(seq, commit_id, sender, receiver, status)], L.Deliveries.SCHEMA))

    def forwarded(self, seq: int, src: str, dst: str, commit_id: str) -> None:
        self.spark.createDataFrame([(src, dst, commit_id, seq)], "src string, dst string, commit_id string, seq long").write.mode("append").parquet(self.forwards)

    def cursors(self, src: str) -> dict[str, str]:
        """The last commit forwarded to each destination."""
        try:
            sent = self.spark.read.schema("src string, dst string, commit_id string, seq long").parquet(self.forwards)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return {}
            raise
        rows = L.latest_state(sent.where(F.col("src") == src).select(F.col("dst").alias("key"), F.col("commit_id").alias("value"), "seq"))
        return {r.key: r.value for r in rows.collect()}  # one row for each destination


class Branch:
    """A named graph with a log, services, mergers and destinations.

    Graphs are immutable tables, so a transaction is a pending list of operations: dropping
    it undoes it.  With a store, a commit is written before its services run and after, and
    deliveries and what was forwarded are recorded, so `load` goes on where a crash left off.
    """

    def __init__(self, spark: SparkSession, uri: str, state: DataFrame | None = None, clock: Callable[[], int] = lambda: int(time.time() * 1000), store: Store | None = None):
        self.spark, self.uri, self.clock, self.store = spark, uri, clock, store
        self.name = uri.rsplit("::", 1)[-1]
        if store is not None and state is not None:
            store.snapshots.save(self.name, state)
        self.state = state if state is not None else spark.createDataFrame([], "subject string, predicate string, object string, datatype string")
        self.services: list[S.Service] = []
        self.mergers: list[Callable[[DataFrame, Commit], DataFrame]] = []
        self.destinations: list[Branch] = []
        self.commits: list[Commit] = []
        self.deliveries: list[tuple[str, str, str]] = []  # commit id, from, status
        self.queue: list[Commit] = []
        self.cursors: dict[str, str] = {}
        self.seen: set[str] = set()
        self.properties: set[str] | None = None
        self._pending: list[tuple] = []
        self.active = True

    # Configuration: what is appended and there already moves to the end

    def append(self, chain: list, handler: object) -> None:
        """chain: services, mergers or destinations."""
        self.detach(chain, handler)
        chain.append(handler)

    def detach(self, chain: list, handler: object) -> bool:
        found = [h for h in chain if h is handler]
        chain[:] = [h for h in chain if h is not handler]
        return bool(found)

    # Transactions

    def add(self, subject: str, predicate: str, obj: str, datatype: str | None = None) -> None:
        self._pending.append((subject, predicate, obj, datatype, 1, len(self._pending)))

    def remove(self, subject: str, predicate: str, obj: str, datatype: str | None = None) -> None:
        self._pending.append((subject, predicate, obj, datatype, -1, len(self._pending)))

    def undo(self) -> None:
        self._pending.clear()

    def commit(self, message: str = "") -> Commit | None:
        """The net changes as a commit, after services; None if nothing changed."""
        if not self.active:
            raise RuntimeError("the branch is not active")
        ops = self.spark.createDataFrame(self._pending, _OPS)
        self._pending = []
        if net(ops, group=[]).isEmpty():
            return None
        return self._conclude(ops, str(uuid.uuid4()), message)

    def _conclude(self, ops: DataFrame, commit_id: str, message: str) -> Commit:
        before = self.commits[-1].id if self.commits else ""
        if self.store is not None:
            first = settle(net(ops, group=[]).select(*V.STATEMENT, "net"))
            self.store.write(self.store.ahead, self.name, Commit(commit_id, self.uri, message, before, self.clock(), first), len(self.commits))
        done, _, _ = S.fixpoint(ops, self.state, self.services)
        changes = settle(net(done, group=[]).select(*V.STATEMENT, "net"))
        new = Commit(commit_id, self.uri, message, before, self.clock(), changes)
        if self.store is not None:
            self.store.write(self.store.log, self.name, new, len(self.commits))
        self.state = settle(apply(self.state, changes))
        self._note_properties(changes)
        self.commits.append(new)
        self.seen.add(commit_id)
        for d in list(self.destinations):
            self._forward(new, d)
        return new

    def _note_properties(self, changes: DataFrame) -> None:
        """Keeps the cache of known properties, where there is one; a commit's definitions are few."""
        if self.properties is None:
            return
        ops = changes.withColumn("op", F.when(F.col("net") > 0, "ADD").otherwise("REMOVE"))
        known = self.spark.createDataFrame([(p,) for p in sorted(self.properties)], "property string")
        added, removed = ontology.property_changes(ops, known)
        still = ontology.known_properties(self.state)
        gone = removed.join(still, "property", "left_anti")
        self.properties = (self.properties | {r.property for r in added.collect()}) - {r.property for r in gone.collect()}

    def cache_properties(self) -> set[str]:
        """The known properties; from now on commits and merges keep them up to date."""
        self.properties = {r.property for r in ontology.known_properties(self.state).collect()}
        return self.properties

    # Propagation

    def _forward(self, commit: Commit, destination: Branch) -> None:
        destination.receive(commit, self.name)
        self.cursors[destination.uri] = commit.id
        if self.store is not None:
            self.store.forwarded([c.id for c in self.commits].index(commit.id), self.uri, destination.uri, commit.id)

    def receive(self, commit: Commit, sender: str | None = None) -> bool:
        """Queues a commit that was not seen before; without a merger it is recorded and rejected."""
        if commit.id in self.seen or any(c.id == commit.id for c in self.queue):
            return False
        accepted = bool(self.mergers)
        status = "ACCEPTED" if accepted else "REJECTED"
        if self.store is not None:
            self.store.deliver(len(self.deliveries), commit.id, sender or commit.branch.rsplit("::", 1)[-1], self.name, status)
        self.deliveries.append((commit.id, commit.branch, status))
        if accepted:
            self.queue.append(commit)
        return accepted

    def merge(self) -> list[Commit]:
        """Merges what is queued; merge commits keep id and message, even if empty, and go on to destinations.

        Each merger works on the graph that the one before left, and what all of them do is the
        merge commit.
        """
        out = []
        while self.queue:
            commit, graph = self.queue[0], self.state
            ops = self.spark.createDataFrame([], _OPS)
            for k, merger in enumerate(self.mergers):
                changes = settle(merger(graph, commit).select(*V.STATEMENT, "net"))
                graph = apply(graph, changes)
                ops = ops.union(changes.select(*V.STATEMENT, F.col("net").cast("int").alias("delta"), (F.lit(2 * k) + F.when(F.col("net") < 0, 0).otherwise(1)).cast("long").alias("seq")))
            out.append(self._conclude(ops, commit.id, commit.message))
            self.queue.pop(0)
        return out

    def after(self, commit_id: str | None) -> list[Commit]:
        """Commits after the one named; all for None, none for an unknown one."""
        ids = [c.id for c in self.commits]
        if commit_id is None:
            return list(self.commits)
        return self.commits[ids.index(commit_id) + 1 :] if commit_id in ids else []

    def catch_up(self, destination: Branch) -> int:
        """Sends a destination what it has not been sent yet."""
        pending = self.after(self.cursors.get(destination.uri))
        for c in pending:
            self._forward(c, destination)
        return len(pending)

    def deactivate(self) -> None:
        self.active = False
        self.queue.clear()

    # Recovery

    def load(self) -> Branch:
        """Takes log, graph, deliveries and cursors from the store."""
        self.commits = [c for _, c in self.store.read(self.store.log, self.name, self.uri)]
        self.seen, self.state = {c.id for c in self.commits}, settle(self.store.state(self.name))
        rows = self.store.deliveries.all().where(F.col("receivingBranchId") == self.name).orderBy("seq").collect()
        self.deliveries = [(r.commitId, r.sendingBranchId, r.status) for r in rows]
        self.cursors = self.store.cursors(self.uri)
        return self

    def recover(self) -> dict[str, int]:
        """Ends what a crash interrupted, after load and configuration; how many there were of each.

        Commits written ahead that the log lacks go through the services again; accepted
        deliveries that no commit answers are queued and merged; destinations are sent what
        they have not been sent.
        """
        prefix = self.uri.rsplit("::", 1)[0]
        unmerged = [(i, sender) for i, sender, status in self.deliveries if status == "ACCEPTED" and i not in self.seen]
        awaited = {i for i, _ in unmerged}
        ahead = [c for _, c in self.store.read(self.store.ahead, self.name, self.uri) if c.id not in self.seen and c.id not in awaited]
        done = set()
        for c in ahead:
            if c.id not in done:
                ops = c.changes.select(*V.STATEMENT, F.col("net").alias("delta"), F.when(F.col("net") < 0, 0).otherwise(1).cast("long").alias("seq"))
                self._conclude(ops, c.id, c.message)
                done.add(c.id)
        for commit_id, sender in unmerged:
            head = self.store.log.heads(sender).where(F.col("commitId") == commit_id).first()
            if head is not None and all(c.id != commit_id for c in self.queue):
                self.queue.append(Commit(commit_id, f"{prefix}::{sender}", head.commitMessage, head.precedingCommitId, head.timeStamp, self.store.changes(self.store.log, sender, commit_id)))
        merged = len(self.merge())
        return {"preliminary": len(done), "unmerged": merged, "unforwarded": sum(self.catch_up(d) for d in self.destinations)}


def complete_merger(state: DataFrame, commit: Commit) -> DataFrame:
    """Takes a commit as it is."""
    return commit.changes


class Repository:
    """Branches by name, and the services they are configured with; with a path, they are kept on disk."""

    def __init__(self, spark: SparkSession, uri: str, registry: S.Registry | None = None, path: str | None = None):
        self.spark, self.uri, self.registry = spark, uri, registry or S.Registry()
        self.store = Store(spark, path) if path else None
        self.branches: dict[str, Branch] = {}
        self.configured: dict[str, list[tuple[str, dict]]] = {}

    def exists(self, name: str) -> bool:
        return name in self.branches or (self.store is not None and self.store.exists(name))

    def get_or_create(self, name: str = "main", **options: object) -> Branch:
        """The branch of this name: the one in memory, the one on disk, or a new one."""
        if name not in self.branches:
            kept = self.store is not None and self.store.exists(name)
            branch = Branch(self.spark, f"{self.uri}::{name}", store=self.store, **({k: v for k, v in options.items() if k != "state"} if kept else options))
            if kept:
                branch.load()
            branch.services = self.registry.build(branch.uri, self.configured.get(name, []))
            self.branches[name] = branch
        return self.branches[name]

    def configure(self, name: str, service: str, config: dict | None = None) -> None:
        """Appends a service; one that is there already moves to the end."""
        entries = [e for e in self.configured.setdefault(name, []) if e[0] != service]
        self.configured[name] = [*entries, (service, config or {})]
