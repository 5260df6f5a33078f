"""Small scenarios with known outcomes."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.functions import collections as C
from stratalog.functions import statements as ST
from stratalog.functions import vocabulary as V
from stratalog.operators import branching, commits, containment, history, netting, ontology, replay, services, snapshot
from stratalog.operators.branch import Branch, Repository, complete_merger
from stratalog.sources import log as logs

OPS = "branch_id int, commit_seq int, seq long, subject string, predicate string, object string, datatype string, delta int"


def ops_of(spark, words, commit=0):
    rows = [(0, commit, i * 10 + j, f"s{i}", "p", "1", V.XSD + "int", 1 if c == "A" else -1) for i, w in enumerate(words) for j, c in enumerate(w)]
    return spark.createDataFrame(rows, OPS)


def two_sets(word):
    """A literal machine: an operation cancels its opposite, if there is one, else it is noted."""
    added = removed = False
    for c in word:
        if c == "A":
            added, removed = (added, False) if removed else (True, removed)
        else:
            added, removed = (False, removed) if added else (added, True)
    return int(added) - int(removed)


def test_netting_is_a_clamped_walk(spark):
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("AR", repeat=n)]
    for chunk in (netting.CHUNK, 2):
        got = {r.subject: r.net for r in netting.net(ops_of(spark, words), chunk=chunk).collect()}
        assert [got.get(f"s{i}", 0) for i in range(len(words))] == [two_sets(w) for w in words]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("AR", min_size=1, max_size=9), min_size=1, max_size=12))
def test_netting_of_random_operations(spark, words):
    got = {r.subject: r.net for r in netting.net(ops_of(spark, words), chunk=3).collect()}
    assert [got.get(f"s{i}", 0) for i in range(len(words))] == [two_sets(w) for w in words]


def test_literals_of_different_types_do_not_cancel(spark):
    rows = [(0, 0, 0, "a", "p", "1", V.XSD + "int", 1), (0, 0, 1, "a", "p", "1", V.XSD + "double", -1), (0, 0, 2, "a", "p", "b", None, 1), (0, 0, 3, "a", "p", "b", None, -1)]
    assert netting.net(spark.createDataFrame(rows, OPS)).count() == 2


def test_snapshot_revert_and_replay(spark):
    ops = ops_of(spark, ["A", "R", "A"], 0).union(ops_of(spark, ["R", "A"], 1)).union(ops_of(spark, ["A"], 2))
    net = netting.net(ops)
    state = snapshot.snapshot(net)
    assert {r.subject for r in state.collect()} == {"s0", "s1", "s2"}
    rows = history.history(net)
    flat = state.select(*V.STATEMENT)
    assert {r.subject for r in replay.revert(flat, rows).collect()} == {"s1"}
    assert {r.subject for r in replay.forward(replay.revert(flat, rows), rows, 0).collect()} == {"s0", "s2"}
    stops = replay.steps(rows, [])
    assert [(r.step, r.n_entries) for r in stops.orderBy("step").collect()] == [(1, 3), (2, 2), (3, 1)]
    assert replay.next_timestamp(stops, 3) == -1


def issue_history(spark):
    """Three commits of one issue: priority 1, 2, 3 and state InProgress, Resolved, Closed."""
    rows, states = [], ["InProgress", "Resolved", "Closed"]
    for c in range(3):
        new = [("priority", str(c + 1), V.XSD + "long", 1), ("state", states[c], V.XSD + "string", 1)]
        old = [] if not c else [("priority", str(c), V.XSD + "long", -1), ("state", states[c - 1], V.XSD + "string", -1)]
        rows += [(0, c, c * 10 + i, "issue", p, o, d, s) for i, (p, o, d, s) in enumerate(new + old)]
    return netting.net(spark.createDataFrame(rows, OPS))


def test_scoped_replay_session(spark):
    net = issue_history(spark)
    scope = lambda *p: spark.createDataFrame([("issue", x) for x in p], "subject string, predicate string")
    state = snapshot.snapshot(net).select(*V.STATEMENT)
    session = replay.Session(state, history.history(net), scope("priority"))
    session.revert()
    assert [session.play_forward().count() for _ in range(4)] == [1, 2, 2, 0]
    with pytest.raises(ValueError):
        session.widen(scope("state"))
    session = replay.Session(state, history.history(net), scope("priority"))
    session.revert()
    assert session.play_forward().count() == 1
    session.widen(scope("state"))
    assert {r.object for r in session.state.where("predicate = 'state'").collect()} == {"InProgress"}
    assert [session.play_forward().count() for _ in range(3)] == [4, 4, 0]
    assert replay.Session(state, history.history(net), scope().limit(0) if False else scope("none")).play_forward().count() == 0


def test_collections(spark):
    df = spark.range(1).select(F.array(*map(F.lit, "ABCA")).alias("a"), F.create_map(F.lit("k"), F.lit("v")).alias("m"))
    a, m = F.col("a"), F.col("m")
    row = df.select(
        C.list_insert(a, 1, F.lit("X")).alias("insert"), C.list_remove(a, F.lit("A")).alias("remove"), C.list_remove_at(a, 3).alias("at"),
        C.list_remove_all(a, F.array(F.lit("A"), F.lit("B"))).alias("all"), C.list_retain_all(a, F.array(F.lit("B"))).alias("retain"), C.list_index_of(a, F.lit("Z")).alias("no"),
        C.list_set(a, 0, F.lit("Y")).alias("set"), C.list_slice(a, 1, 3).alias("slice"), C.list_get(a, 9).alias("none"), C.list_clear(a).alias("clear"),
        C.map_put(m, F.lit("k"), F.lit("w")).alias("put"), C.map_remove(m, F.lit("k")).alias("gone"), C.map_get(m, F.lit("x")).alias("missing"), C.set_contains_all(a, F.array(F.lit("C"))).alias("has"),
    ).first()
    assert row.insert == list("AXBCA") and row.remove == list("BCA") and row.at == list("ABC")
    assert row.all == list("CA") and row.retain == ["B"] and row.no == -1 and row.set == list("YBCA") and row.slice == ["B", "C"]
    assert row.none is None and row.clear == [] and row.put == {"k": "w"} and row.gone == {} and row.missing is None and row.has
    with pytest.raises(NotImplementedError):
        C.list_last_index_of()


def test_inserting_at_the_head_of_a_list_moves_all(spark):
    df = spark.createDataFrame([("o", ["A", "B"], ["N", "A", "B"])], "owner string, a array<string>, b array<string>")
    assert {r.op: r["count"] for r in containment.list_change(df, "owner", "a", "b").groupBy("op").count().collect()} == {"REMOVE": 2, "ADD": 3}


def test_commits_split_rejoin_and_json(spark):
    net = netting.net(ops_of(spark, ["A"] * 7 + ["R"] * 5))
    nested = commits.nest(net)
    parts = commits.split(nested, 4)
    assert parts.count() == 3
    again = commits.rejoin_events(parts)
    key = ["op", "subject", "object"]
    assert sorted(commits.flatten(again).select(*key).collect()) == sorted(commits.flatten(nested).select(*key).collect())
    assert commits.rejoin_events(parts.where("batchId < 3")).count() == 0
    assert logs.decode(logs.encode(nested)).first().addedStatements == nested.first().addedStatements
    keys = [*key, "pos"]
    assert sorted(commits.rejoin_rows(parts).select(*keys).collect()) == sorted(commits.flatten(nested).select(*keys).collect())
    assert commits.rejoin_rows(parts.where("batchId < 3")).count() == 0 and commits.rejoin_rows(parts.union(parts)).count() == 12
    tight = commits.split(nested, 1000, 400)
    assert tight.count() > 3 and commits.rejoin_rows(tight).count() == 12
    nothing = commits.split(nested.withColumn("addedStatements", F.slice("addedStatements", 1, 0)).withColumn("removedStatements", F.slice("removedStatements", 1, 0)))
    assert nothing.count() == 1 and commits.rejoin_events(nothing).count() == 1
    sizes = commits.payload_parts(net, 300).groupBy("part").agg(F.sum("bytes").alias("b"), F.max("oversized").alias("o")).collect()
    assert all(r.b <= 300 for r in sizes) and not any(r.o for r in sizes)
    assert commits.payload_parts(net, 5).where("oversized").count() == 12


def test_log_files(spark, tmp_path):
    log = logs.CommitLog(spark, str(tmp_path / "log"))
    assert log.commits().count() == 0
    for c in range(3):
        log.append(commits.split(commits.nest(netting.net(ops_of(spark, ["A", "R"], c))), 1))
    assert [r.commitId for r in log.commits("0").orderBy("seq").collect()] == ["c-0-0", "c-0-1", "c-0-2"]
    assert [r.commitId for r in log.after("0", "c-0-1").collect()] == ["c-0-2"]
    assert log.after("0", "c-0-2").count() == 0 and log.after("0", None).count() == 3 and log.after("0", "unknown").count() == 0
    log.drop("0")
    assert log.commits().count() == 0
    snaps = logs.Snapshots(spark, str(tmp_path / "snaps"))
    assert snaps.load("x") is None
    snaps.save("x", ops_of(spark, ["A"]))
    assert snaps.load("x").count() == 1 and snaps.remove("x")


def test_triples_round_trip(spark, tmp_path):
    rows = [("http://a", "http://p", "http://b", None), ("n1", "http://p", 'say "hi"\nback\\slash', V.XSD + "string"), ("http://a", "http://q", "1", V.XSD + "int")]
    rows += [("http://a", "http://w", "C:\\new\\table", V.XSD + "string"), ("http://a", "http://w", "tab\there\r\n", V.XSD + "string"), ("http://a", "http://w", "Zürich 𝕏", logs.LANG_STRING + "@de"), ("http://a", "http://w", "", V.XSD + "string")]
    df = spark.createDataFrame(rows, "subject string, predicate string, object string, datatype string")
    logs.write_triples(df, str(tmp_path / "t"))
    assert {tuple(r) for r in logs.read_triples(spark, str(tmp_path / "t")).collect()} == set(rows)


def test_triples_of_other_writers(spark, tmp_path):
    path = tmp_path / "x.nt"
    path.write_text('<http://a> <http://p> "caf\\u00E9 \\U0001D54F \\\\u0041 \\\'"@fr-CA . # remark\nno triple\n# remark\n<http://a> <http://p> "plain" .\n')
    got = {tuple(r) for r in logs.read_triples(spark, str(path)).collect()}
    assert got == {("http://a", "http://p", "café 𝕏 \\u0041 '", logs.LANG_STRING + "@fr-CA"), ("http://a", "http://p", "plain", V.XSD + "string")}
    assert logs.read_triples(spark, str(tmp_path / "missing")).count() == 0


def label(branch, value, message=""):
    branch.add("http://a", V.RDFS + "label", value, V.XSD + "string")
    return branch.commit(message)


def test_mergers_work_one_after_the_other(spark):
    one, two = Branch(spark, "http://r::one"), Branch(spark, "http://r::two")
    one.destinations.append(two)
    found = []

    def shout(state, commit):
        found.append(state.count())
        return commit.changes.withColumn("object", F.upper("object"))

    empty = lambda state, commit: commit.changes.limit(0)
    for m in (shout, complete_merger, empty):
        two.append(two.mergers, m)
    two.append(two.mergers, shout)  # moves to the end
    label(one, "x")
    assert two.merge()[0].count() == (2, 0) and {r.object for r in two.state.collect()} == {"x", "X"} and found == [1]
    assert two.detach(two.mergers, shout) and not two.detach(two.mergers, shout) and len(two.mergers) == 2


def test_branches_go_on_after_a_restart(spark, tmp_path):
    path = str(tmp_path / "repo")
    repo = Repository(spark, "http://r", path=path)
    base = spark.createDataFrame([("http://b", "p", "1", None)], "subject string, predicate string, object string, datatype string")
    one, two = repo.get_or_create("one", state=base), repo.get_or_create("two")
    two.mergers.append(complete_merger)
    one.destinations.append(two)
    first = label(one, "1", "first")
    assert repo.exists("one") and not repo.exists("three") and [m.id for m in two.merge()] == [first.id]

    def broken(*_):
        raise OSError("crash")

    # A service fails: the commit was written ahead.
    one.services.append(broken)
    with pytest.raises(OSError):
        label(one, "2", "second")
    again = Repository(spark, "http://r", path=path)
    one = again.get_or_create("one")
    assert [c.message for c in one.commits] == ["first"] and one.state.count() == 2 and one.commits[0].count() == (1, 0)
    assert one.recover() == {"preliminary": 1, "unmerged": 0, "unforwarded": 0}
    assert [c.message for c in one.commits] == ["first", "second"] and one.state.count() == 3
    assert one.recover()["preliminary"] == 0
    # It was not forwarded; once it is, the merge is interrupted.
    two = again.get_or_create("two")
    two.mergers.append(broken)
    one.destinations.append(two)
    assert one.recover()["unforwarded"] == 1
    with pytest.raises(OSError):
        two.merge()
    last = Repository(spark, "http://r", path=path)
    one, two = last.get_or_create("one"), last.get_or_create("two")
    two.mergers.append(complete_merger)
    one.destinations.append(two)
    assert two.recover() == {"preliminary": 0, "unmerged": 1, "unforwarded": 0} and one.recover() == {"preliminary": 0, "unmerged": 0, "unforwarded": 0}
    assert [c.message for c in two.commits] == ["first", "second"] and two.state.count() == 2
    records = last.store.deliveries
    assert [(r.seq, r.sendingBranchId, r.status) for r in records.after("two", None).orderBy("seq").collect()] == [(0, "one", "ACCEPTED"), (1, "one", "ACCEPTED")]
    assert records.after("two", first.id).count() == 1 and records.after("two", one.commits[-1].id).count() == 0
    assert last.get_or_create("one").commits == one.commits and one.after(first.id) == one.commits[1:]


def test_known_properties_follow_commits(spark):
    branch = Branch(spark, "http://r::s")
    branch.add("p", V.TYPE, V.DATA_PROPERTY)
    branch.commit()
    assert branch.cache_properties() == {"p"}
    branch.add("q", V.TYPE, V.OBJECT_PROPERTY)
    branch.add("q", V.TYPE, V.PROPERTY)
    branch.remove("p", V.TYPE, V.DATA_PROPERTY)
    branch.commit()
    assert branch.properties == {"q"}
    branch.remove("q", V.TYPE, V.PROPERTY)
    branch.commit()
    assert branch.properties == {"q"}


def test_limits_of_services_start_anew_with_each_commit(spark):
    name = V.RDFS + "label"
    branch = Branch(spark, "http://r::s")
    branch.services = [services.sign_flip(name, 1, 1), services.sign_flip(name, -1, 1)]
    for subject in ("a", "b"):
        branch.add(subject, name, "1", V.XSD + "int")
        branch.commit()
        branch.remove(subject, name, "3", V.XSD + "int")
        branch.services, kept = [], branch.services
        branch.commit()
        branch.services = kept
        assert branch.state.isEmpty()
    assert branch.services[0].describe(1)[0][2] == "1" and len(branch.services[0].describe(1)) == 4


def test_maps_and_lists_made_and_told_apart(spark):
    schema = "subject string, predicate string, object string, datatype string"
    props = spark.createDataFrame([("p#m", "MAP", "D", V.XSD + "string", True), ("p#l", "LIST", "D", V.XSD + "string", True)], "property string, kind string, domain string, range string, literal boolean")
    model = ontology.meta_model(spark).union(ontology.define(props))
    assert {r.property for r in ontology.has_map_entry_range(model).collect()} == {"p#m", V.MAP_REF}
    owned = spark.createDataFrame([("o", {"k": "v"})], "owner string, entries map<string,string>")
    state = model.union(containment.map_statements(owned, "owner", "entries", "p#m"))
    assert [tuple(r) for r in ontology.checked_maps(state, "p#m").collect()] == [("o", "k", "v")]
    with pytest.raises(TypeError):
        ontology.checked_maps(state, "p#l")
    puts = spark.createDataFrame([("o", "k", "w"), ("o", "new", "1")], "owner string, key string, value string")
    assert {(r.op, r["count"]) for r in containment.put_change(state, puts, "p#m").groupBy("op").count().collect()} == {("ADD", 6), ("REMOVE", 1)}
    assert containment.put_change(state, puts.where("key = 'k'").withColumn("value", F.lit("v")), "p#m").isEmpty()
    ask = spark.createDataFrame([("o", "http://x/y#labels", "p#l_list"), ("o", "p#m", "p#l_list")], "owner string, property string, range string")
    made = containment.get_or_create_lists(ask, state)
    assert made.count() == 4 and {r.subject for r in made.collect()} == {"o", "o#labels"} and containment.get_or_create_lists(ask, state.union(made)).isEmpty()
    lists = spark.createDataFrame([("o#labels",)], "list string")
    assert containment.delete_lists(state.union(made), lists).subtract(state).count() == 1
    ops = spark.createDataFrame([("e", V.TYPE, "p#mEntryType", None, "REMOVE"), ("x", V.TYPE, "p#l_list", None, "REMOVE"), ("y", V.TYPE, "D", None, "REMOVE"), ("z", V.TYPE, "p#l_list", None, "ADD")], schema + ", op string")
    assert [r.subject for r in ontology.was_instance(ops, model, V.MAP_ENTRY).collect()] == ["e"] and [r.subject for r in ontology.was_instance(ops, model, V.LIST_CLASS).collect()] == ["x"]
    mixed = spark.createDataFrame([("e", V.TYPE, V.MAP_ENTRY, None), ("e", V.TYPE, V.LIST_CLASS, None), ("e", V.MAP_OWNER, "o", None), ("e", V.LIST_OWNER, "q", None), ("o", "m", "e", None), ("q", "l", "e", None), ("u", V.LIST_OWNER, "q", None), ("q", "l", "u", None)], schema)
    about = spark.createDataFrame([("e", "v", "1", None, "ADD"), ("u", "v", "1", None, "ADD")], schema + ", op string")
    assert {(r.subject, r.containingsubject) for r in containment.attribute_typed(about, mixed, model).collect()} == {("e", "o"), ("u", None)}
    steps = spark.createDataFrame([("b", "p", "1", None, "REMOVE", 0, 1), ("a", "p", "1", None, "ADD", 1, 1), ("b", "p", "2", None, "ADD", 2, 1)], schema + ", op string, seq long, g int")
    assert [(r.subject, r.rank, r.pos, r.op) for r in containment.per_instance(steps, ["g"]).orderBy("rank", "pos").collect()] == [("b", 1, 1, "ADD"), ("b", 1, 2, "REMOVE"), ("a", 2, 1, "ADD")]
    kinds = spark.createDataFrame([(V.XSD + "int",), ("http://c",)], "u string").select(ontology.value_type(F.col("u")).alias("t")).collect()
    assert [(r.t.uri, r.t.is_primitive) for r in kinds] == [(V.XSD + "int", True), ("http://c", False)]


def test_propagation_ends_in_a_ring(spark):
    log = spark.createDataFrame([(0, 0, "c-0-0"), (1, 0, "c-1-0")], "branch_id int, commit_seq int, commit_id string")
    routes = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src int, dst int")
    got = {(r.commit_id, r.dst, r.hop) for r in branching.propagate(log, routes).collect()}
    assert got == {("c-0-0", 1, 1), ("c-0-0", 2, 2), ("c-1-0", 2, 1), ("c-1-0", 0, 2)}


def test_branch_commits_services_and_merges(spark):
    clock = itertools.count(1).__next__
    one, two, three = (Branch(spark, f"http://r::{n}", clock=clock) for n in ("one", "two", "three"))
    two.mergers.append(complete_merger)
    one.destinations += [two, three]
    two.destinations.append(one)
    one.add("a", "label", "1", V.XSD + "int")
    one.remove("a", "label", "1", V.XSD + "int")
    assert one.commit() is None
    one.add("a", "label", "1", V.XSD + "int")
    one.remove("a", "label", "2", V.XSD + "int")
    one.remove("a", "label", "2", V.XSD + "int")
    first = one.commit("first")
    assert first.count() == (1, 1) and one.state.count() == 1
    assert [m.id for m in two.merge()] == [first.id] and two.state.count() == 1
    assert not one.queue and three.deliveries == [(first.id, one.uri, "REJECTED")]
    assert not one.receive(first)
    assert one.catch_up(two) == 0 and one.after(None) == one.commits and one.after("unknown") == []
    one.deactivate()
    with pytest.raises(RuntimeError):
        one.commit()


def test_services_settle(spark):
    label = V.RDFS + "label"
    branch = Branch(spark, "http://r::s")
    branch.services = [services.sign_flip(label, 1, 2), services.sign_flip(label, -1, 2)]
    branch.add("a", label, "1", V.XSD + "int")
    commit = branch.commit()
    assert commit.count() == (1, 0) and branch.state.first().object == "5"
    undone = Branch(spark, "http://r::u")
    undone.services = [services.undo_all()]
    undone.add("a", label, "1", V.XSD + "int")
    assert undone.commit().count() == (0, 0) and undone.state.count() == 0


def test_repository_needs_factories(spark):
    registry = services.Registry()
    repo = Repository(spark, "http://r", registry)
    repo.configure("main", "undo")
    with pytest.raises(LookupError):
        repo.get_or_create()
    registry.register("undo", lambda branch, config: services.undo_all())
    assert len(repo.get_or_create().services) == 1 and repo.get_or_create().uri == "http://r::main"


def test_schema_definitions_and_removal(spark):
    cls = spark.createDataFrame([("Demo", None), ("SubDemo", "Demo")], "class string, super string")
    props = spark.createDataFrame([(f"p{k}", k, "Demo", V.XSD + "string", True) for k in ("SINGLE", "LIST", "MAP", "SET")], "property string, kind string, domain string, range string, literal boolean")
    base = ontology.meta_model(spark).union(ontology.classes(cls))
    state = base.union(ontology.define(props))
    found = {r.property: r.kind for r in ontology.kinds(state).collect() if r.property in {"pSINGLE", "pLIST", "pMAP", "pSET"}}
    assert found == {"pSINGLE": "SINGLE", "pLIST": "LIST", "pMAP": "MAP", "pSET": "SET"}
    assert ontology.define(props.where("kind = 'LIST'")).count() == 19
    assert ontology.meta_model(spark).count() == 19
    assert ontology.define_new(props, state).count() == 0
    assert {r.property for r in ontology.declared(state, "Demo").collect()} == {"pSINGLE", "pLIST", "pMAP", "pSET"}
    assert ontology.drop_class(state, "Demo").where("subject = 'SubDemo' and predicate like '%type'").count() == 1
    assert ontology.drop_class(state, "Demo", subclasses=True).count() == ontology.meta_model(spark).count()
    typed = state.union(spark.createDataFrame([("x", V.TYPE, "SubDemo", None)], state.schema))
    assert [r.subject for r in ontology.instances(typed, "Demo").collect()] == ["x"]
    with pytest.raises(Exception, match="not assignable"):
        ontology.strict(spark.createDataFrame([("q",)], "object string"), V.XSD + "int").collect()


def test_containment(spark):
    schema = "subject string, predicate string, object string, datatype string"
    state = spark.createDataFrame([("list", V.LIST_OWNER, "art", None), ("art", "labels", "list", None), ("lost", V.LIST_OWNER, "art", None), ("C", V.TYPE, V.CLASS, None)], schema)
    ops = spark.createDataFrame([("list", V.RDF + "_1", "A", "s", "ADD"), ("lost", V.RDF + "_1", "A", "s", "ADD"), ("gone", V.TYPE, V.LIST_CLASS, None, "REMOVE"), ("gone", V.LIST_OWNER, "art", None, "REMOVE"), ("art", "tags", "gone", None, "REMOVE")], schema + ", op string")
    got = {(r.subject, r.containingsubject, r.containmentpredicate) for r in containment.attribute(ops, state).collect()}
    assert got == {("list", "art", "labels"), ("lost", None, None), ("gone", "art", "tags"), ("art", None, None)}


def test_names_and_literals(spark):
    df = spark.createDataFrame([("r::a::b",), ("r::",), ("r",)], "u string")
    assert [r.n for r in df.select(ST.branch_name(F.col("u")).alias("n")).collect()] == ["b", None, None]
    values = spark.createDataFrame([("12",), ("1.5",), ("300",), (None,)], "object string")
    good, bad = ontology.assignable_literals(values, V.XSD + "byte")
    assert [r.object for r in good.collect()] == ["12"] and bad.count() == 3


TURTLE = """@prefix : <http://x#> . @base <http://base/dir/> .
PREFIX owl: <http://www.w3.org/2002/07/owl#>
prefix xsd: <http://www.w3.org/2001/XMLSchema#>
# a remark with <http://no> . in it
:Issue a owl:Class ; :note "one # two", 'it''s' , \"\"\"long "quoted"
text\\u00e9\"\"\"@en-GB ; .
<rel> :n 1, -2.5, 1e3, true ; :typed "7"^^xsd:int ; :list ( :a "b" [ :deep _:b1 ] ) .
[ :of :Issue ] .
[] :p :a.b , :c\\,d .
"""


def test_turtle(spark, tmp_path):
    from stratalog.sources import turtle

    text = TURTLE.replace("'it''s'", "'it\\'s'")
    rows = set(turtle.parse(text))
    x = lambda n: "http://x#" + n
    assert {(x("Issue"), V.TYPE, V.CLASS, None), (x("Issue"), x("note"), "one # two", V.XSD + "string"), (x("Issue"), x("note"), "it's", V.XSD + "string"), (x("Issue"), x("note"), 'long "quoted"\ntexté', logs.LANG_STRING + "@en-GB")} <= rows
    rel = "http://base/dir/rel"
    assert {(rel, x("n"), "1", V.XSD + "integer"), (rel, x("n"), "-2.5", V.XSD + "decimal"), (rel, x("n"), "1e3", V.XSD + "double"), (rel, x("n"), "true", V.XSD + "boolean"), (rel, x("typed"), "7", V.XSD + "int")} <= rows
    heads = {o for s, p, o, _ in rows if (s, p) == (rel, x("list"))}
    firsts = {s: (o, d) for s, p, o, d in rows if p == V.RDF + "first"}
    rests = {s: o for s, p, o, _ in rows if p == V.RDF + "rest"}
    at, items = heads.pop(), []
    while at != V.RDF + "nil":
        items.append(firsts[at])
        at = rests[at]
    assert items[:2] == [(x("a"), None), ("b", V.XSD + "string")] and (items[2][0], x("deep"), "b1", None) in rows
    assert {o for s, p, o, _ in rows if p == x("p")} == {x("a.b"), x("c,d")} and len({s for s, p, *_ in rows if p == x("of")}) == 1
    for bad in ("no turtle", ":a :b :c .", "<a> <b> <c>", '<a> <b> "open .'):
        with pytest.raises(ValueError):
            turtle.parse(bad)
    (tmp_path / "good.ttl").write_text(text)
    (tmp_path / "bad.ttl").write_text("no turtle")
    assert {tuple(r) for r in turtle.read_ontology(spark, str(tmp_path / "good.ttl")).collect()} == rows
    assert turtle.read_ontology(spark, str(tmp_path / "bad.ttl")).isEmpty() and turtle.read_ontology(spark, str(tmp_path / "none.ttl")).isEmpty()
    state = turtle.read_turtle(spark, str(tmp_path / "good.ttl"))
    logs.write_triples(state, str(tmp_path / "out.nt"))
    assert turtle.read_ontology(spark, str(tmp_path / "out.nt")).count() > 10
