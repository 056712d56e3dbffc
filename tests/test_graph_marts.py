"""Graph and marts against a direct evaluation of their rules on a random small lake."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from conftest import naive, rows
from loomwork import schemas
from loomwork.functions.text import STOPWORDS
from loomwork.operators import graph, marts, serving, topics

WORDS = "alpha beta gamma delta omega sigma kappa lambda theta zeta the run".split()
PEOPLE = ["Ann <ann@x>", "ann lee <ANN@x>", "Bob <bob@x>", "<cy@x>", None, "Dee <dee@x>"]


@pytest.fixture(scope="module")
def lake(spark):
    rng = random.Random(3)
    arts, edges = [], []

    def art(i, kind, actor, day, said, repo="r", extra=None):
        source = "git" if kind in ("commit", "file") else "claude_code"
        arts.append((i, kind, source, repo, actor, naive(2024, 1, day), i, said, None, None, extra))

    for n in range(40):
        modality = '{"modality":"code"}' if n % 3 else None
        art(f"file:{n:02}", "file", None, 1, "alpha never counts", rng.choice("rs"), modality)
    for n in range(90):
        actor = rng.choice(PEOPLE)
        cid = f"commit:{n:02}"
        art(cid, "commit", actor, rng.randrange(1, 28), " ".join(rng.sample(WORDS, 3)), rng.choice("rs"))
        touched = rng.sample(range(42), rng.randrange(0, 6))  # 40 and 41 are no artifacts
        edges += [(cid, f"file:{f:02}", "modified", 1.0) for f in touched]
        if actor and n != 7:
            edges.append((person(actor), cid, "authored", 1.0))
    for n in range(8):
        sid = f"ai_session:{n}"
        actor = PEOPLE[n % 3]
        art(sid, "ai_session", actor, 20, rng.choice(WORDS), rng.choice("rs"))
        edges.append((person(actor), sid, "authored", 1.0))
        edges.append((sid, f"file:{n:02}", "ai_touched_file", 0.0 if n else 3.0))
        for k in range(3):
            art(f"ai_message:{n}{k}", "ai_message", "assistant", 21, rng.choice(WORDS), None)
            edges.append((f"ai_message:{n}{k}", sid, "message_of_session", 1.0))
    edges += [("file:00", "file:01", "co_edited", 2.0), ("file:02", "file:02", "co_edited", 1.0), ("file:03", "file:99", "co_edited", 1.0)]
    edges.append(("person:ghost", "file:05", "authored", 1.0))
    a = spark.createDataFrame(arts, schemas.ARTIFACTS).cache()
    e = spark.createDataFrame([(*x, naive(2024, 1, 1)) for x in edges], schemas.EDGES).cache()
    return arts, edges, a, e


def person(actor):
    import hashlib

    m = re.search("<([^>]+)>", actor)
    key = (m.group(1) if m else actor).strip().lower()
    return "person:" + hashlib.sha256(f"person|{key}".encode()).hexdigest()[:40]


class Model:
    """The rules, evaluated row by row."""

    def __init__(self, arts, edges):
        kind = {a[0]: a[1] for a in arts}
        actor = {a[0]: a[4] for a in arts}
        toks = {
            a[0]: set(t.lower() for t in re.findall("[a-zA-Z][a-zA-Z0-9_+#-]{2,}", f"{a[6]} {a[7]}")) - set(STOPWORDS)
            for a in arts if a[1] != "file"
        }
        df = Counter(t for s in toks.values() for t in s)
        self.terms = [t for t, n in sorted(df.items(), key=lambda x: (-x[1], x[0])) if n >= 2][:24]
        files_of, session_of = defaultdict(list), {}
        for s, d, rel, _ in edges:
            if rel == "modified":
                files_of[s].append(d)
            if rel == "message_of_session":
                session_of[s] = d
        self.members = {t: {"a": set(), "p": set(), "f": set(), "s": set()} for t in self.terms}
        for aid, found in toks.items():
            for t in found & set(self.terms):
                m = self.members[t]
                m["a"].add(aid)
                if kind[aid] == "commit":
                    if actor[aid]:
                        m["p"].add(person(actor[aid]))
                    m["f"].update(files_of[aid])
                else:
                    sid = aid if kind[aid] == "ai_session" else session_of.get(aid)
                    m["s"].add(sid)
                    if actor.get(sid):
                        m["p"].add(person(actor[sid]))
        self.people = {s for s, d, rel, _ in edges if rel == "authored" and kind.get(d) in ("commit", "ai_session")}
        self.nodes = self.people | {i for i, k in kind.items() if k in ("file", "ai_session")} | {f"topic:{t}" for t in self.terms}
        out = {}
        for cid, fs in files_of.items():
            for f in fs:
                if actor[cid]:
                    k = ("modified", person(actor[cid]), f)
                    out[k] = out.get(k, 0) + 1.0
        for s, d, rel, w in edges:
            if rel == "co_edited":
                out[rel, s, d] = w or 1.0
            if rel == "ai_touched_file":
                out["ai_touched", s, d] = w or 1.0
            if rel == "authored" and kind.get(d) == "ai_session":
                out["ran", s, d] = 1.0
        for t, m in self.members.items():
            for x in [*m["p"], *m["s"], *m["f"]]:
                out["about", f"topic:{t}", x] = 1.0
        self.edges = {
            (s, d, rel, w) for (rel, s, d), w in out.items() if s != d and s in self.nodes and d in self.nodes
        }


@pytest.fixture(scope="module")
def model(lake):
    return Model(lake[0], lake[1])


@pytest.fixture(scope="module")
def members(lake):
    return topics.members(lake[2], lake[3])


@pytest.fixture(scope="module")
def built(lake, members):
    g = graph.build(lake[2], lake[3], members)
    return graph.Graph(g.nodes.cache(), g.edges.cache(), g.members.cache())


def test_terms_and_members(model, members):
    assert members.terms == model.terms
    want = {(t, k, x) for t, m in model.members.items()
            for k, xs in (("person", m["p"]), ("ai_session", m["s"]), ("file", m["f"])) for x in xs}
    assert set(rows(topics.member_rows(members))) == want


def test_nodes(model, built, lake):
    got = {r["id"]: r for r in built.nodes.collect()}
    assert set(got) == model.nodes
    for t, m in model.members.items():
        node = got[f"topic:{t}"]
        assert node["artifact_count"] == len(m["a"])
    listed = defaultdict(set)
    for node, artifact in rows(built.members):
        listed[node].add(artifact)
    assert {n: len(a) for n, a in listed.items()} == {i: r["artifact_count"] for i, r in got.items()}
    assert all(listed[f"topic:{t}"] == m["a"] for t, m in model.members.items())
    assert got["file:00"]["modality"] == "" and got["file:01"]["modality"] == "code"
    # A person without a name part is shown by the whole actor here ...
    cy = person("<cy@x>")
    assert got[cy]["label"] == "<cy@x>"
    # ... and by the empty name part in the author mart.
    assert {r["person_id"]: r["name"] for r in marts.author_activity(lake[2], lake[3]).collect()}[cy] == ""


def test_edges(model, built):
    assert set(rows(built.edges, "source", "target", "relation", "weight")) == model.edges
    assert built.edges.count() == len(model.edges)


def test_long_node_lists_are_whole(spark):
    arts = [(f"commit:{i:03}", "commit", "git", "r", "Ann <a@x>", naive(2024, 1, 1), "t", "word", None, None, None) for i in range(75)]
    edges = [(person("Ann <a@x>"), a[0], "authored", 1.0, None) for a in arts]
    a, e = spark.createDataFrame(arts, schemas.ARTIFACTS), spark.createDataFrame(edges, schemas.EDGES)
    g = graph.build(a, e)
    assert {r["artifact_count"] for r in g.nodes.collect()} == {75}
    assert {r["count"] for r in g.members.groupBy("node").count().collect()} == {75}
    node = g.nodes.first()["id"]
    assert graph.node_artifacts(g, a, node).count() == 75 and graph.node_artifacts(g, a, node, 20).count() == 20


def test_focus_and_fallback(model, built):
    node = f"topic:{model.terms[0]}"
    near = {node} | {d for s, d, _, _ in model.edges if s == node} | {s for s, d, _, _ in model.edges if d == node}
    got = graph.focus(built, node)
    assert {r["id"] for r in got.nodes.collect()} == near
    assert set(rows(got.edges, "source", "target", "relation", "weight")) == {e for e in model.edges if e[0] in near and e[1] in near}
    assert rows(graph.view(built, focus_on="nobody").nodes, "id") == rows(graph.view(built).nodes, "id")


def test_bound_cuts_before_the_kind_filter(model, built):
    degree = Counter(x for e in model.edges for x in e[:2])
    linked = {d for s, d, rel, _ in model.edges if rel == "about" and d.startswith("file:")}
    overview = [n for n in model.nodes if not n.startswith("file:") or n in linked]
    top = sorted(overview, key=lambda n: (-degree[n], n))[:15]
    got = graph.view(built, kinds=["person", "file"], max_nodes=15)
    assert {r["id"] for r in got.nodes.collect()} == {n for n in top if n.startswith(("person:", "file:"))}
    assert graph.view(built, scoped=True, max_nodes=10_000).nodes.count() == len(model.nodes)


def test_repo_scope(lake):
    arts, edges, a, e = lake
    got_a, got_e = graph.scope_to_repo(a, e, "s")
    own = {x[0] for x in arts if x[3] == "s"}
    of = {s: d for s, d, rel, _ in edges if rel == "message_of_session"}
    keep = own | {m for m, s in of.items() if s in own}
    assert {r["id"] for r in got_a.collect()} == keep
    ok = lambda n: n in keep or n.startswith("person:")
    assert rows(got_e, "src_id", "dst_id", "relation") == sorted(
        ((s, d, r) for s, d, r, _ in edges if ok(s) and ok(d)), key=repr
    )


def test_node_drill_down(built, lake, model):
    t = model.terms[0]
    got = graph.node_artifacts(built, lake[2], f"topic:{t}")
    assert {r["id"] for r in got.collect()} == model.members[t]["a"]


def test_topic_summary_counts_all_files(lake, members, model):
    kind = {a[0] for a in lake[0] if a[1] == "file"}
    got = {r["topic"]: tuple(r)[1:] for r in marts.topic_summary(lake[2], lake[3], members).collect()}
    for t, m in model.members.items():
        assert got[t] == (len(m["a"]), len(m["p"] & model.people), len(m["f"] & kind), len(m["s"]))


def test_author_activity(lake):
    arts, edges, a, e = lake
    kind, day = {x[0]: x[1] for x in arts}, {x[0]: x[5].date().isoformat() for x in arts}
    got = {r["person_id"]: r for r in marts.author_activity(a, e).collect()}
    owns = defaultdict(set)
    for s, d, rel, _ in edges:
        if rel == "authored" and kind[d] != "file":
            owns[s].add(d)
    assert set(got) == set(owns)
    for p, xs in owns.items():
        r = got[p]
        files = {d for s, d, rel, _ in edges if rel == "modified" and s in xs}
        assert (r["commits"], r["ai_sessions"], r["files_touched"]) == (
            sum(kind[x] == "commit" for x in xs), sum(kind[x] == "ai_session" for x in xs), len(files))
        assert (r["first_activity"], r["last_activity"]) == (min(day[x] for x in xs), max(day[x] for x in xs))
    # Of two spellings the first seen is the name.
    seen = min((x[5], x[4]) for x in arts if x[4] and "ann@" in x[4].lower())[1]
    assert got[person("Ann <ann@x>")]["name"] == seen.split("<")[0].strip()


def test_hotspots(lake):
    got = {r["file_id"]: r for r in marts.file_hotspots(lake[2], lake[3]).collect()}
    assert len(got) == 40
    modified = Counter(d for s, d, rel, _ in lake[1] if rel == "modified")
    assert all(r["times_modified"] == modified[f] for f, r in got.items())
    assert got["file:00"]["modality"] == "unknown" and got["file:00"]["ai_touches"] == 1
    assert got["file:01"]["coedit_degree"] == 1 and got["file:39"]["coedit_degree"] == 0


@pytest.fixture(scope="module")
def crowd(spark):
    """People over few topic sets, one of them held by a third of all."""
    rng = random.Random(5)
    masks = [0b111, 0b1, 0b1000, 0b11111, 0b10100, 1 << 20 | 1]
    people = [(f"person:{i:03}", masks[0] if rng.random() < 0.33 else rng.choice(masks)) for i in range(60)]
    df = spark.createDataFrame(people, "node string, mask long")
    names = spark.createDataFrame([(p, p[-3:]) for p, _ in people[:-1]], "person string, name string")
    return people, df, names, [f"t{i:02}" for i in range(21)]


def brute_pairs(people, terms):
    out = []
    for (a, x), (b, y) in combinations(sorted(people), 2):
        shared = sorted(t for i, t in enumerate(terms) if x & y & (1 << i))
        if shared:
            out.append((a, b, len(shared), ", ".join(shared[:8])))
    return out


def test_pairs_of_people(crowd):
    people, df, names, terms = crowd
    got = marts.cross_silo(df, names, terms)
    assert rows(got, "person_a", "person_b", "shared_topics", "topics") == sorted(brute_pairs(people, terms), key=repr)
    shown = {(r["person_a"], r["person_a_name"]) for r in got.collect()} | {(r["person_b"], r["person_b_name"]) for r in got.collect()}
    assert all(n == p[-3:] or p == people[-1][0] for p, n in shown)
    assert marts.cross_silo_size(marts.set_sizes(df)).first()["rows"] == got.count()


def test_pairs_of_people_come_from_stored_people_and_no_copies_are_broadcast(spark, crowd, monkeypatch):
    people, df, names, terms = crowd
    made, write = [], marts.materialize
    monkeypatch.setattr(marts, "topic_people", lambda artifacts, edges, m: df)
    monkeypatch.setattr(marts.graph, "person_names", lambda artifacts: names)
    monkeypatch.setattr(marts, "materialize", lambda frame, label: made.append(label) or write(frame, label))
    none = topics.TopicMembers(terms, df, df, df, df)
    got = marts.gold_cross_silo(df, df, none)
    assert sorted(made) == ["person_names", "topic_people"]
    assert rows(got, "person_a", "person_b", "shared_topics", "topics") == sorted(brute_pairs(people, terms), key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [bit#" in plan and "BroadcastHashJoin [bit#" not in plan


@pytest.mark.parametrize("k", [1, 5, 40, 5000])
def test_top_pairs_equal_the_sorted_mart(crowd, k):
    people, df, names, terms = crowd
    want = sorted(brute_pairs(people, terms), key=lambda r: (-r[2], r[0], r[1]))[:k]
    got = marts.top_cross_silo(df, names, terms, k).select("person_a", "person_b", "shared_topics", "topics").collect()
    assert [tuple(r) for r in got] == want


def test_partners_of_one_person(crowd):
    people, df, names, terms = crowd
    me = people[4][0]
    got = rows(marts.partners(df, names, terms, me), "person", "shared_topics")
    want = [(b if a == me else a, n) for a, b, n, _ in brute_pairs(people, terms) if me in (a, b)]
    assert got == sorted(want, key=repr)


def test_at_least_min_shared(crowd):
    people, df, names, terms = crowd
    for least in (2, 3, 5):
        got = rows(marts.cross_silo(df, names, terms, least), "person_a", "person_b")
        assert got == sorted((a, b) for a, b, n, _ in brute_pairs(people, terms) if n >= least)


def test_empty_input_gives_empty_marts(spark):
    a, e = schemas.empty(spark, schemas.ARTIFACTS), schemas.empty(spark, schemas.EDGES)
    m = topics.members(a, e)
    for name, build in marts.mart_builders(a, e, m).items():
        df = build()
        assert df.schema.names == schemas.GOLD[name].names and df.count() == 0


def test_counts_add_up(lake):
    _, _, a, e = lake
    got = {r["metric"]: r["value"] for r in serving.counts(a, e).collect()}
    assert got["artifacts_total"] == sum(v for k, v in got.items() if k.startswith("artifacts_") and k != "artifacts_total")
    assert got["edges_total"] == e.count()
    scoped = {r["metric"] for r in serving.counts(a, e, "r").collect()}
    assert "edges_total" not in scoped and "artifacts_ai_message" not in scoped
